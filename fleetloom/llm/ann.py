"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.session import cut_lineage

#: Vectors that the tree is fitted on at most, children of a node, and distinct vectors of a leaf aimed at.
FIT_SAMPLE = 20_000
BRANCHES = 8
LEAF = 128
#: Queries whose neighbours are found by brute force to set the number of leaves to visit, and the recall they must reach.
CALIBRATION = 128
RECALL = 0.96
#: Rows and queries that one task compares at once: small leaves share a cell, big ones are cut into several.
CELL = 32_768


class Tree:
    """Centres of nested clusters; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 7):
        self.centres, self.children, self.leaf_number = [sample.mean(axis=0)], [[]], [-1]
        self._rng = np.random.default_rng(seed)
        open_nodes, number = [(-len(sample), 0, sample)], 1
        while open_nodes and number < leaves:  # the largest cluster is split next
            _, node, rows = heapq.heappop(open_nodes)
            groups = self._split(rows, min(branches, leaves - number + 1))
            if len(groups) < 2:
                continue
            for centre, own in groups:
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.children.append([])
                self.leaf_number.append(-1)
                if len(own) > 1:
                    heapq.heappush(open_nodes, (-len(own), len(self.centres) - 1, own))
            number += len(groups) - 1
        self.centres = np.array(self.centres)
        leaf_nodes = [i for i, c in enumerate(self.children) if not c]
        for i, node in enumerate(leaf_nodes):
            self.leaf_number[node] = i
        self.leaves = len(leaf_nodes)

    def _split(self, rows: np.ndarray, k: int):
        k = min(k, len(rows))
        centres = rows[self._rng.choice(len(rows), k, replace=False)]
        near = None
        for _ in range(12):
            distance = (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T
            now = distance.argmin(axis=1)
            if near is not None and (now == near).all():
                break
            near = now
            centres = np.array([rows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        return [(centres[j], rows[near == j]) for j in range(k) if (near == j).any()]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        node = np.zeros(len(vectors), np.int64)
        moving = np.arange(len(vectors))
        while len(moving):
            ahead = []
            for parent in np.unique(node[moving]).tolist():
                own = moving[node[moving] == parent]
                if children := self.children[parent]:
                    centres = self.centres[children]
                    distance = (centres**2).sum(axis=1)[None, :] - 2 * vectors[own] @ centres.T
                    node[own] = np.array(children)[distance.argmin(axis=1)]
                    ahead.append(own)
            moving = np.concatenate(ahead) if ahead else moving[:0]
        return np.array(self.leaf_number)[node]

    def visits(self, vector: np.ndarray, enough: int, sizes: np.ndarray | None = None, fewest: int = 0) -> list[int]:
        """``enough`` leaves in the order of a best-bin-first traversal, and more until they hold ``fewest`` of ``sizes``."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < enough or held < fewest):
            _, node = heapq.heappop(queue)
            if children := self.children[node]:
                distance = ((self.centres[children] - vector) ** 2).sum(axis=1)
                for ahead in zip(distance.tolist(), children, strict=True):
                    heapq.heappush(queue, ahead)
            else:
                found.append(self.leaf_number[node])
                held += 0 if sizes is None else int(sizes[found[-1]])
        return found


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int, visited=None):
    """The ``k`` nearest (distance, id) of every query, of the rows that it visits; equal distances by the smaller id."""
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate([np.array(x, np.int64) for x in ids])
    owner = np.repeat(np.arange(len(ids)), lengths)
    for i, q in enumerate(queries):
        own = np.arange(len(rows)) if visited is None else np.flatnonzero(visited(i))
        to_own = np.sqrt(((rows[own] - q) ** 2).sum(axis=1))
        kth = np.partition(to_own, k - 1)[k - 1] if len(to_own) > k else np.inf
        distance, near = np.full(len(rows), np.inf), np.zeros(len(rows), bool)
        distance[own], near[own] = to_own, to_own <= kth
        close = np.flatnonzero(near[owner])
        order = close[np.lexsort((flat[close], distance[owner[close]]))[:k]]
        yield distance[owner[order]], flat[order], owner[order]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) with ids, whose vectors are finite, not zero and of the commonest dimension."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    usual = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(usual & F.exists("v", lambda x: x != 0))
    # -0.0 equals 0.0 but has other bits
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    fit_sample: int = FIT_SAMPLE,
    leaf: int = LEAF,
    recall: float = RECALL,
    calibration: int = CALIBRATION,
    cell: int = CELL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id is divisible by ``every``.

    Nearness is Euclidean distance on the given vectors; ties go to the smaller id; a query with fewer candidates gets
    all. Vectors that are null, empty, zero, or hold null or non-finite parts take no part, nor do rows without an id
    and vectors of another than the commonest dimension. Repeated rows count once. An id with several different vectors
    stands for as many rows: each is asked and each is a candidate, and the answers are ranked together. An empty table
    gives no rows.

    Equal vectors are one row of the index with their ``k + 1`` smallest ids, more of which no result can hold, so a
    vector in a third of all rows is no hot leaf. The tree is fitted on at most ``fit_sample`` of the vectors and
    indexes all. How many leaves are visited is widened until the true neighbours of ``calibration`` queries, found by
    brute force over all rows, are covered to ``recall``; a query whose leaves hold too few ids for ``k`` visits more.

    Queries meet the rows of their leaves by a shuffle on groups of neighbouring leaves, of about ``cell`` rows. Where a
    group has more rows or queries, both are dealt into cells, so that each pair of them meets in one cell and a task
    holds about ``cell`` of either; a query goes to a group once, with its leaves there.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], out)
    rows = cut_lineage(rows.where(F.size("v") == common["d"]).distinct())
    best = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = rows.withColumn("place", best).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = cut_lineage(index)
    size = index.count()
    share = min(1.0, fit_sample / size)
    sample = index.select("v") if share == 1 else index.select("v").sample(share, 11)
    fitted = np.array([r["v"] for r in sample.limit(fit_sample).collect()], float).reshape(-1, common["d"])
    if len(fitted) == 0:
        fitted = np.array([index.first()["v"]], float)
    tree = Tree(fitted, max(1, min(size // leaf, len(fitted) // 4)))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(sent.value.home(v) if len(v) else [], pa.int32())], names=["v", "ids", "leaf"])

    placed = cut_lineage(index.mapInArrow(place, "v array<double>, ids array<long>, leaf int"))
    asked = rows.where(F.col("vec_id") % every == 0)
    searches = cut_lineage(asked.select("v").distinct().withColumn("search", F.monotonically_increasing_id()))
    trial = np.array([r["v"] for r in searches.orderBy(F.xxhash64("v")).limit(calibration).collect()], float).reshape(-1, common["d"])
    visits = _calibrated(placed, tree, trial, k, recall)
    sizes, rows_of = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("rows")).collect():
        sizes[r["leaf"]], rows_of[r["leaf"]] = r["ids"], r["rows"]

    group_of = (np.cumsum(rows_of) - rows_of) // cell

    def choose(batches):
        for batch in batches:
            row, group, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"))):
                visited = np.array(sent.value.visits(q, visits, sizes, k + 1))
                for g in np.unique(group_of[visited]).tolist():
                    row.append(i)
                    group.append(g)
                    leaves.append(visited[group_of[visited] == g].tolist())
            kept = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("search").take(kept), batch.column("v").take(kept), pa.array(group, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))],
                names=["search", "q", "group", "leaves"],
            )

    requests = cut_lineage(searches.select("search", "v").mapInArrow(choose, "search long, q array<double>, group long, leaves array<int>"))
    # a row for each group or leaf, of which there are at most a quarter of the fitted sample
    asked_of = {r["group"]: r["count"] for r in requests.groupBy("group").count().collect()}
    rows_in = np.bincount(group_of, weights=rows_of)
    parts = spark.createDataFrame([(g, -(-int(rows_in[g]) // cell), -(-n // cell)) for g, n in asked_of.items() if rows_in[g]], "group long, row_parts int, query_parts int")
    groups = spark.createDataFrame(list(enumerate(group_of.tolist())), "leaf int, group long")
    # a side keeps its own part and goes to all parts of the other
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    part_of = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    here = placed.join(groups, "leaf").join(parts, "group").withColumn("row_part", part_of("v", "row_parts")).withColumn("query_part", all_of("query_parts"))
    there = requests.join(parts, "group").withColumn("query_part", part_of("search", "query_parts")).withColumn("row_part", all_of("row_parts"))
    key = ["group", "row_part", "query_part"]
    there, here = there.select(*key, "search", "q", "leaves"), here.select(*key, "leaf", "v", "ids")
    near = there.groupBy(*key).cogroup(here.groupBy(*key)).applyInArrow(_compare(tree.leaves, k + 1), "search long, vec_id long, score double")
    by_score = Window.partitionBy("search").orderBy("score", "vec_id")
    near = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1).select("search", "vec_id", "score")
    named = asked.select(F.col("vec_id").alias("query_id"), "v").join(searches, "v").select("query_id", "search")
    found = named.join(near, "search").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _compare(leaves: int, k: int):
    """The nearest rows of a cell for each of its queries, among those of the leaves that it visits."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        searches, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and rows.num_rows:
            leaf, wanted = rows.column("leaf").to_numpy(), asked.column("leaves").to_pylist()

            def visited(i):
                mask = np.zeros(leaves, bool)
                mask[wanted[i]] = True
                return mask[leaf]

            near = _nearest(_matrix(asked.column("q")), _matrix(rows.column("v")), rows.column("ids").to_pylist(), k, visited)
            for search, (distance, ids, _) in zip(asked.column("search").to_pylist(), near, strict=True):
                searches.append(np.full(len(ids), search, np.int64))
                found.append(ids)
                scores.append(distance)
        return pa.table({"search": np.concatenate(searches), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def _calibrated(placed: DataFrame, tree: Tree, trial: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaves whose visit covers ``recall`` of the true neighbours of the trial queries."""
    if tree.leaves == 1 or len(trial) == 0:
        return tree.leaves

    def brute(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            leaf, v = batch.column("leaf").to_numpy(zero_copy_only=False), _matrix(batch.column("v"))
            for q, (distance, found, owner) in enumerate(_nearest(trial, v, batch.column("ids").to_pylist(), k + 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(found), pa.int32()), pa.array(found), pa.array(distance), pa.array(leaf[owner], pa.int32())], names=["q", "vec_id", "score", "leaf"]
                )

    near = placed.mapInArrow(brute, "q int, vec_id long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    true = near.withColumn("place", place).where(F.col("place") <= k + 1).select("q", "leaf").collect()
    order = [{leaf: i + 1 for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q in trial]
    needed = sorted(order[r["q"]][r["leaf"]] for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves
