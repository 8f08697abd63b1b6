"""Benchmark decontamination by spaced-seed hashing with substitution-tolerant verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import FOLDED_VALUES, NOT_ALNUM, U64, bounded_batches, free_name, frugal, mix, slices, text_beside, text_column, words
from fleetloom.session import cut_lineage

#: Places that each seed looks at. Any two substitutions in thirteen words leave a place for one of the seeds.
SEEDS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
SPAN = 9
#: Items too short for the seeds are looked for whole, from this many words on; shorter ones only as a whole text.
WHOLE = 5
#: Words that an overlap needs, and the share of them that must be equal.
OVERLAP = 13
PERCENT_EQUAL = 80
#: Benchmark text that is sent to the executors at once (a larger benchmark goes in several blocks).
BLOCK_BYTES = 8 << 20
BLOCKS_A_PASS = 4
_HITS = 1 << 16  # hits verified at once
_FILTER = 22  # bits of the first look-up


def _hashes_at(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash for each place, of the words that lie under ``mask`` there."""
    n = max(0, len(hashes) - mask[-1])
    out = np.full(n, U64(salt))
    for place in mask:
        out = out * U64(0x9E3779B97F4A7C15) + hashes[place : place + n]
        out ^= out >> U64(32)
    return mix(out)


def _seed_hashes(hashes: np.ndarray, seed: int) -> np.ndarray:
    return _hashes_at(hashes, SEEDS[seed], seed + 1)


def _whole_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return _hashes_at(hashes, tuple(range(n)), len(SEEDS) + n)


class Benchmark:
    """A block of benchmark items: their words and, in the order of the hashes, where each seed or short item occurs."""

    def __init__(self, items: list[tuple[int, str]]):
        column = pa.array([text for _, text in items], pa.large_string())
        data, offsets = text_column(column)
        self.hashes, _, _, places = words(data, offsets, FOLDED_VALUES, NOT_ALNUM)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.starts, self.ends = places[:-1], places[1:]
        item = np.repeat(np.arange(len(items)), np.diff(places))
        found, at = [], []
        for seed in range(len(SEEDS)):
            values = _seed_hashes(self.hashes, seed)
            inside = np.flatnonzero(np.arange(len(values)) + SEEDS[seed][-1] < self.ends[item[: len(values)]]) if len(values) else np.zeros(0, np.int64)
            inside = inside[(self.ends - self.starts)[item[inside]] >= SPAN]
            found.append(values[inside])
            at.append(inside)
        found, at = np.concatenate(found), np.concatenate(at)
        order = np.argsort(found, kind="stable")
        self.seeds, self.at = found[order], at[order]
        self.item = item
        self.short = {}
        for n in range(1, SPAN):
            of = np.flatnonzero(self.ends - self.starts == n)
            if len(of):
                values = _whole_hashes(self.hashes, n)[self.starts[of]]
                order = np.argsort(values, kind="stable")
                self.short[n] = values[order], of[order]
        self.likely = np.zeros(1 << _FILTER, bool)
        self.likely[(self.seeds >> U64(64 - _FILTER)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray):
        """Places in a text and in the benchmark that a seed has in common, a bounded number at a time."""
        for seed in range(len(SEEDS)):
            values = _seed_hashes(hashes, seed)
            place = np.flatnonzero(self.likely[(values >> U64(64 - _FILTER)).astype(np.int64)])
            low = np.searchsorted(self.seeds, values[place], "left")
            n = np.searchsorted(self.seeds, values[place], "right") - low
            place, low, n = place[n > 0], low[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for s in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                k = np.arange(s, min(s + _HITS, int(ends[-1])))
                row = np.searchsorted(ends, k, "right")
                yield place[row], self.at[low[row] + k - (ends - n)[row]]

    def whole(self, hashes: np.ndarray, row_of: np.ndarray, places: np.ndarray):
        """Rows of a slice and the short items that they hold whole, a bounded number at a time."""
        for n, (known, items) in self.short.items():
            values = _whole_hashes(hashes, n)
            if n < WHOLE:
                place = places[:-1][np.diff(places) == n]
            else:
                place = np.flatnonzero(np.arange(len(values)) + n <= places[row_of[: len(values)] + 1])
            low = np.searchsorted(known, values[place], "left")
            count = np.searchsorted(known, values[place], "right") - low
            place, low, count = place[count > 0], low[count > 0], count[count > 0]
            ends = np.cumsum(count)
            for s in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                k = np.arange(s, min(s + _HITS, int(ends[-1])))
                hit = np.searchsorted(ends, k, "right")
                item = items[low[hit] + k - (ends - count)[hit]]
                reach = np.arange(n)
                equal = (hashes[place[hit][:, None] + reach] == self.hashes[self.starts[item][:, None] + reach]).all(axis=1)
                yield row_of[place[hit][equal]], item[equal]

    def verified(self, hashes: np.ndarray, place: np.ndarray, at: np.ndarray, row_start: np.ndarray, row_end: np.ndarray) -> np.ndarray:
        """Which hits lie in an aligned overlap long and equal enough, inside the row and the item."""
        item = self.item[at]
        reach = np.arange(-(OVERLAP - 1), SPAN + OVERLAP)
        a, b = place[:, None] + reach, at[:, None] + reach
        inside = (a >= row_start[:, None]) & (a < row_end[:, None]) & (b >= self.starts[item][:, None]) & (b < self.ends[item][:, None])
        a, b = np.clip(a, 0, len(hashes) - 1), np.clip(b, 0, len(self.hashes) - 1)
        equal = np.concatenate([np.zeros((len(place), 1), np.int16), np.cumsum(inside & (hashes[a] == self.hashes[b]), axis=1, dtype=np.int16)], axis=1)
        whole = np.concatenate([np.zeros((len(place), 1), np.int16), np.cumsum(inside, axis=1, dtype=np.int16)], axis=1)
        length = (self.ends - self.starts)[item]
        good = np.zeros(len(place), bool)
        for size in np.unique(np.minimum(length, OVERLAP)).tolist():
            needed = -(-size * PERCENT_EQUAL // 100) if size == OVERLAP else size
            of = np.minimum(length, OVERLAP) == size
            for s in range(OVERLAP):
                full = whole[:, s + size] - whole[:, s] == size if s + size < whole.shape[1] else np.zeros(len(place), bool)
                good |= of & full & (equal[:, min(s + size, equal.shape[1] - 1)] - equal[:, s] >= needed)
        return good


def _scan(sent, carried: list[str], name: str, so_far: str):
    def run(batches):
        blocks = [Benchmark(items) for items in sent.value]
        for batch in batches:
            data, offsets = text_column(batch.column(name))
            rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in slices(offsets):
                base = offsets[low]
                hashes, _, _, places = words(data[base : offsets[high]], offsets[low : high + 1] - base, FOLDED_VALUES, NOT_ALNUM)
                row_of = np.repeat(np.arange(high - low), np.diff(places))
                for block in blocks:
                    for place, at in block.hits(hashes):
                        row = row_of[place]
                        good = block.verified(hashes, place, at, places[row], places[row + 1])
                        pairs = np.unique(np.stack([row[good] + low, block.ids[block.item[at[good]]]]), axis=1)
                        rows.append(pairs[0])
                        ids.append(pairs[1])
                    for row, item in block.whole(hashes, row_of, places):
                        pairs = np.unique(np.stack([row + low, block.ids[item]]), axis=1)
                        rows.append(pairs[0])
                        ids.append(pairs[1])
            # rows without a text or a hit keep what earlier blocks have found
            found: list[set] = [set(x) for x in batch.column(so_far).to_pylist()]
            for row, item in zip(np.concatenate(rows).tolist(), np.concatenate(ids).tolist(), strict=True):
                found[row].add(item)
            kept = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], names=[*carried, so_far])

    return frugal(run)


def find_leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``items``: ids of the benchmark items that its text overlaps.

    Words are runs of ASCII letters, digits and all beyond ASCII, lower-cased in A-Z. A text overlaps an item if, laid
    beside it, thirteen neighbouring words of both agree in at least eleven places; an item of five to twelve words
    must be there whole; one of fewer words is common speech in a longer text, so it must be the whole text. An item
    without words overlaps nothing. Null texts, ids and tables
    without rows overlap nothing; items without an id are left out; repeated rows are judged alike. The new column is
    ``items``, with an underscore more where ``columns`` has that name.

    The benchmark goes to the executors in blocks of bounded size, a few in a pass over the documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    extra, name = text_beside(docs, columns)
    so_far = free_name("_items", [*columns, *extra])
    out = docs.select(*columns, *(F.col("text").cast("string").alias(c) for c in extra), F.array().cast("array<long>").alias(so_far))
    for first in range(0, blocks, BLOCKS_A_PASS):
        taken = range(first, min(first + BLOCKS_A_PASS, blocks))
        block = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([[tuple(r) for r in block(k).collect()] for k in taken])
        if first:
            out = cut_lineage(out)
        out = out.mapInArrow(_scan(sent, [*columns, *extra], name, so_far), out.schema)
    return out.select(*columns, F.col(so_far).alias(free_name("items", columns)))
