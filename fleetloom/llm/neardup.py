"""Near-duplicates: bottom-k sketches, inverted lists of the retained values, exact Jaccard on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import U64, bounded_batches, frugal, mix, shingles, slices, text_column, words
from fleetloom.session import cut_lineage, forget

#: Values that a sketch retains, and how many two sketches must at least share to be candidates: at a similarity of
#: 0.75 fewer than ten of 32 has a chance of 1e-8.
RETAINED = 32
LEAST_SHARED = 10
#: Links that a task of the components takes: a round over few links needs no more tasks than the cluster has cores.
LINKS_PER_TASK = 1 << 17
#: Documents that one task compares among themselves when a list is compared in blocks.
BLOCK = 512


def _sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Sorted distinct shingle hashes of every row: values and the rows' offsets among them."""
    hashes, _, _, places = words(data, offsets)
    counts = np.diff(places)
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + places[:-1][row]
    grams = shingles(hashes, size)
    values = np.empty(len(row), U64)
    long = counts[row] >= size
    values[long] = grams[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence; its length keeps it apart from others
        whole = shingles(hashes[places[i] : places[i + 1]], int(counts[i]))
        values[np.searchsorted(row, i)] = mix(whole + U64(counts[i]))[0]
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[first], row[first]
    return values, np.searchsorted(row, np.arange(len(counts) + 1))


def _sketched(size: int, retained: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            out_n, out_a, out_b, out_s, out_l = [], [], [], [], [0]
            for low, high in slices(offsets):
                base = offsets[low]
                values, places = _sets(data[base : offsets[high]], offsets[low : high + 1] - base, size)
                n = np.diff(places)
                out_n.append(n)
                out_a.append(_sums(values, places, 1))
                out_b.append(_sums(values, places, 2))
                own = np.arange(len(values)) - np.repeat(places[:-1], n) < retained
                out_s.append(values[own].view(np.int64))
                out_l += (np.minimum(n, retained).cumsum() + out_l[-1]).tolist()
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            sketches = pa.ListArray.from_arrays(pa.array(out_l, pa.int32()), pa.array(join(out_s, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(join(out_n, np.int64), pa.int64()), pa.array(join(out_a, np.int64)), pa.array(join(out_b, np.int64)), sketches],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "sketch"],
            )

    return run


def _sums(values: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Order-free sum of mixed values of every row: equal sets have equal sums."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(values + U64(salt)), dtype=U64)])
    return (sums[places[1:]] - sums[places[:-1]]).view(np.int64)


def _keyed_sets(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            for low, high in slices(offsets):
                base = offsets[low]
                values, places = _sets(data[base : offsets[high]], offsets[low : high + 1] - base, size)
                blobs = [values[a:b].tobytes() for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(places), pa.int64()), pa.array(_sums(values, places, 1)), pa.array(_sums(values, places, 2)), pa.array(blobs, pa.binary())],
                    names=["doc_id", "n", "sum_a", "sum_b", "members"],
                )

    return run


def _union_overlap(a: np.ndarray, b: np.ndarray, retained: int) -> int:
    """How many of the smallest values of the union both sorted sketches hold."""
    union = np.concatenate([a[:retained], b[:retained]])
    union.sort()
    same = union[1:] == union[:-1]
    distinct_before = np.arange(1, len(union)) - np.cumsum(same) + same
    return int((same & (distinct_before <= retained)).sum())


def _confirm(percent: int, retained: int, least: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left_members").to_pylist(), batch.column("right_members").to_pylist()
            kept = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(left, right, strict=True)):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                if _union_overlap(a, b, retained) < min(least, _required(min(len(a), len(b), retained), percent)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], names=["a", "b"])

    return run


def _required(n, percent: int):
    return -(-n * percent // 100)


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``links`` (a, b): the smallest node that can be reached.

    Alternating star contraction: every node hands its larger, then its smaller neighbours to the smallest one it
    knows, until all links are stars. Rows never outgrow the links, and each round is written, so a lost executor
    repeats one round only. Rounds have as many tasks as their links need: every round is a handful of stages, which cost
    most where many partitions hold next to nothing.
    """
    cores = links.sparkSession.sparkContext.defaultParallelism

    def gathered(df: DataFrame) -> DataFrame:
        return df.coalesce(max(cores, before[0] // LINKS_PER_TASK))

    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(gathered(gathered(large.where("a <> b")).distinct()))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        done = cut_lineage(gathered(gathered(small.where("a <> b")).distinct()))
        settled = (now := _digest(done)) == before
        forget(large, done if settled else links)
        if settled:
            break
        links, before = done, now
    inner = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _labelled(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return postings.withColumn("component", F.col("node"))
    return postings.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of every list's members with its hubs: the first document, and those of the first and last component.

    Linear in the list. Near copies mostly come after what they are copies of, so the first document is a good hub.
    """
    hub = F.struct("first_id", "node", "n", "component")
    hubs = lists.groupBy("value").agg(F.min(hub).alias("first"), F.min_by(hub, "component").alias("low"), F.max_by(hub, "component").alias("high"))
    hubs = hubs.where("low.component <> high.component").select("value", F.array_distinct(F.array("first", "low", "high")).alias("hubs"))
    met = lists.join(hubs, "value").select("node", "n", "component", F.explode("hubs").alias("hub"))
    fits = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    pairs = met.where((F.col("component") != F.col("hub.component")) & fits)
    return pairs.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct()


def _held(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


#: Rows of a block that make a value frequent there, and how many frequent values are counted at a time.
_FREQUENT, _AT_ONCE = 64, 1024


def _common(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many values every two of a block's rows share; a row holds a value once.

    Frequent values are counted by a product of matrices, for each of them pair by pair would be the square of a block.
    """
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
    held = np.diff(edges)
    shared = np.zeros((rows, rows), np.float32)
    frequent = np.flatnonzero(held >= _FREQUENT)
    for low in range(0, len(frequent), _AT_ONCE):
        some = frequent[low : low + _AT_ONCE]
        holds = np.zeros((rows, len(some)), np.float32)
        for k, v in enumerate(some.tolist()):
            holds[row[edges[v] : edges[v + 1]], k] = 1
        shared += holds @ holds.T
    rare = np.flatnonzero((held > 1) & (held < _FREQUENT))
    for s, e in zip(edges[rare].tolist(), edges[rare + 1].tolist(), strict=True):
        shared[np.ix_(row[s:e], row[s:e])] += 1
    return shared


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in names]


def _apart(comps: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which pairs are of different components and, for two blocks, of both."""
    apart = comps[:, None] != comps[None, :]
    if sides.max(initial=0) > 0:
        apart &= sides[:, None] != sides[None, :]
    return apart


def _candidates(table: pa.Table, retained: int, least: int, percent: int) -> pa.Table:
    """The rows of a block that have a partner there whose sketch shares enough.

    A pair counts in the first list only that has both, so that it is looked at once.
    """
    comps, sizes, sides, value = _columns(table, "component", "n", "side", "value")
    fits = np.minimum.outer(sizes, sizes) * 100 >= np.maximum.outer(sizes, sizes) * percent
    open_pairs = _apart(comps, sides) & fits
    listed, row = _held(table.column("listed"))
    earlier = listed < value[0]
    open_pairs &= _common(listed[earlier], row[earlier], len(comps)) == 0
    if open_pairs.any():
        shared = _common(*_held(table.column("sketch")), len(comps))
        open_pairs &= shared >= np.minimum(least, -(-np.minimum(np.minimum.outer(sizes, sizes), retained) * percent // 100))
    return table.select(["value", "home", "other", "side", "node", "n", "component"]).filter(pa.array(open_pairs.any(axis=0)))


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """Links by exact Jaccard among the rows of a block, only as many as join their components: fewer than rows."""
    nodes, comps, sizes, sides = _columns(table, "node", "component", "n", "side")
    blobs = [np.frombuffer(x.as_buffer(), U64) for x in table.column("members")]
    both = _common(np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(x) for x in blobs]), len(nodes)).astype(np.int64)
    linked = _apart(comps, sides) & (100 * both >= percent * (np.add.outer(sizes, sizes) - both))
    leader = {c: c for c in comps.tolist()}

    def find(c):
        while leader[c] != c:
            leader[c] = c = leader[leader[c]]
        return c

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        p, q = find(int(comps[i])), find(int(comps[j]))
        if p != q:
            leader[p] = q
            links.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _block_links(lists: DataFrame, described: DataFrame, sets: DataFrame, retained: int, least: int, percent: int, block: int) -> DataFrame:
    """What still links the components of a list, compared in blocks of about ``block`` rows.

    Blocks are few bytes and much work, so they are dealt over all partitions, which adaptive execution would coalesce to
    a task or two. A component of that size has blocks of its own, which are compared with all blocks but its own; smaller ones share
    blocks. The sketches choose which rows of two blocks have partners, the full sets of these decide; at most a
    forest of links leaves a task.
    """
    mixed = lists.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
    held = lists.join(mixed, "value").groupBy("value", "component").agg(F.count(F.lit(1)).alias("members"))
    held = cut_lineage(held)
    small = held.where(F.col("members") < block).groupBy("value").agg(F.sum("members").alias("small"))
    sizes = held.join(small, "value", "left")
    large = F.col("members") >= block
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("small") / block))
    name = F.struct(F.when(large, F.col("component")).alias("own"), F.when(large, spread).otherwise(shared).alias("part"))
    dealt = lists.join(sizes, ["value", "component"]).select("value", "node", "n", "component", name.alias("home"))
    blocks = dealt.select("value", "home").distinct()
    pairs = blocks.join(blocks.select("value", F.col("home").alias("other")), "value")
    pairs = pairs.where((F.col("home") <= F.col("other")) & (F.col("home.own").isNull() | ~F.col("home.own").eqNullSafe(F.col("other.own"))))
    key = ["value", "home", "other"]
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = dealt.join(pairs, ["value", "home"]).select(*key, "node", "n", "component", F.lit(0).alias("side"))
    second = dealt.withColumnRenamed("home", "other").join(pairs.where("home <> other"), ["value", "other"])
    second = second.select(*key, "node", "n", "component", F.lit(1).alias("side"))
    met = first.unionByName(second).join(described, "node")
    chosen = met.select(*key, "side", "node", "n", "component").schema
    partners = met.repartition(tasks, *key).groupBy(*key).applyInArrow(lambda t: _candidates(t, retained, least, percent), chosen)
    full = cut_lineage(partners).join(sets, "node")
    return full.repartition(tasks, *key).groupBy(*key).applyInArrow(lambda t: _forest(t, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 75, retained: int = RETAINED, least: int = LEAST_SHARED, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, ``kept`` for the smallest id of each group.

    A document's set has the distinct ``size``-word shingles of its text, words lower-cased in A-Z; a shorter text is
    one shingle; a null text or one without words has the empty set and is linked with nothing. Sets are held as
    64-bit hashes. Rows of equal id take part with each of their texts; a row without an id is linked with nothing,
    has no component and is kept.

    Equal sets become one class first. Of the sketches' values only those that more than one class retains are listed,
    and of these each class lists its rarest, as many as two classes sharing ``least`` values must have one in common.
    Lists are joined to their hubs, and what is confirmed is contracted; what still lies in several components of
    a list is compared in blocks. So no list is ever written out as all its pairs, and no pair is left out by a cap.
    """
    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = cut_lineage(columns.mapInArrow(frugal(_sketched(size, retained)), "doc_id long, n_shingles long, sum_a long, sum_b long, sketch array<long>"))
    key = ["n_shingles", "sum_a", "sum_b"]
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    # an id with several texts leads several classes, so the classes have numbers of their own
    classes = some.groupBy(*key).agg(F.min_by("sketch", "doc_id").alias("sketch"), F.min("doc_id").alias("first_id"))
    nodes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id())).withColumnRenamed("n_shingles", "n")
    values = nodes.select("node", "n", "first_id", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    needed = F.least(F.lit(least), F.ceil(F.col("held") * percent / 100))
    listed = values.join(shared, "value").groupBy("node", "n", "first_id", "held")
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("lists", "value"))).alias("by_rarity"))
    # values that nobody else has come first in the order by rarity and use up places
    places = (F.col("held") - needed + 1 - (F.col("held") - F.size("by_rarity"))).cast("int")
    prefix = listed.where(places > 0).select("node", "n", "first_id", F.explode(F.slice("by_rarity", 1, F.greatest(places, F.lit(1)))).alias("v"))
    prefix = prefix.select("node", "n", "first_id", F.col("v.value").alias("value"))
    again = prefix.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value")
    postings = cut_lineage(prefix.join(again, "value"))

    leaders = postings.select("node").distinct().join(nodes, "node").select(F.col("first_id").alias("doc_id"), "node", *[F.col(c) for c in ("n", "sum_a", "sum_b")])
    texts = columns.join(leaders.select("doc_id").distinct(), "doc_id", "left_semi")
    full = texts.mapInArrow(frugal(_keyed_sets(size)), "doc_id long, n long, sum_a long, sum_b long, members binary")
    sets = cut_lineage(full.join(leaders, ["doc_id", "n", "sum_a", "sum_b"]).groupBy("node").agg(F.first("members").alias("members")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("members").alias("left_members"))
        right = sets.select(F.col("node").alias("b"), F.col("members").alias("right_members"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(frugal(_confirm(percent, retained, least)), "a long, b long")

    links = cut_lineage(confirmed(_star_pairs(_labelled(postings, None), percent)))
    components = connected(links)
    more = cut_lineage(confirmed(_star_pairs(_labelled(postings, components), percent)))
    links = links.unionByName(more)
    components = connected(links)
    described = postings.groupBy("node").agg(F.collect_list("value").alias("listed")).join(nodes.select("node", "sketch"), "node")
    labelled = cut_lineage(_labelled(postings, components))
    rest = cut_lineage(_block_links(labelled, described, sets, retained, least, percent, block))
    forget(sets, postings, labelled)
    # rows that share an id are one document of several texts
    same = nodes.groupBy("first_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    same = nodes.join(same, "first_id").select(F.col("node").alias("a"), "b").where("a <> b")
    components = connected(links.unionByName(rest).unionByName(same))
    member = nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = member.join(smallest, "component").select(F.col("n").alias("n_shingles"), "sum_a", "sum_b", "component_id")
    out = sketched.select("doc_id", *key).join(found, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
