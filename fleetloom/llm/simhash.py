"""SimHash near-duplicates: fingerprints of word shingles, linked through covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm.neardup import connected
from fleetloom.llm.textops import U64, bounded_batches, frugal
from fleetloom.session import cut_lineage

BITS = 64
SEED = 42
#: Bytes of one text whose words are held at a time.
PIECE = 1 << 20
#: Distinct fingerprints of a bucket that are compared among themselves; a larger bucket is dealt by further masks.
DIRECT = 512
#: Free bits at which a bucket is bounded well enough, by the fingerprints that they tell apart, to be compared whole.
LAST_BITS = 12

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = U64(0x0101010101010101)


def _word_runs(raw: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces; each piece begins with the last ``size - 1`` words of the one before."""
    at, carried = 0, []
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        found = carried + raw[at:end].split()
        yield found
        carried, at = found[max(0, len(found) - size + 1) :], end


def _hashes(found: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every ``size`` neighbouring words joined by a space."""
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), U64, len(found) - size + 1)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: 255 hashes at a time, eight bits to a word of byte lanes."""
    counts = np.zeros((8, 8), np.int64)
    groups = np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> U64(bit)) & _LANES, groups)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts.ravel()


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of a text: a bit is one if more than half of the shingles' hashes have it."""
    raw = (text or "").encode().translate(_LOWER)
    counts, n, short = np.zeros(BITS, np.int64), 0, []
    for found in _word_runs(raw, size):
        if len(found) < size:
            short = found
            continue
        hashes = _hashes(found, size)
        counts, n = counts + _set_bits(hashes), n + len(hashes)
    if not n and short:
        counts, n = _set_bits(_hashes(short, len(short))), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprinted(size: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(text.as_py(), size) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, U64).view(np.int64))], names=["doc_id", "fp"])

    return run


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` such that any ``radius`` of the bits are all outside of some mask.

    Every bit has a nonzero vector of radius + 1 binary places, dealt in turn. There is a mask for each nonzero v: the
    bits whose vectors have an odd overlap with v. The vectors of ``radius`` bits span at most ``radius`` dimensions, so
    a nonzero v is orthogonal to all of them, and its mask holds none of these bits. About half of the bits are in a mask.
    """
    span = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (1 + i % span & v).bit_count() % 2) for v in range(1, span + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _refined(held: list[int], radius: int) -> list[tuple[int, int]]:
    """(mask, larger mask): every mask extended by a cover of the bits that it leaves free."""
    return [(m, m | sub) for m in held for sub in covering_masks([b for b in range(BITS) if not m >> b & 1], radius)]


def _bucket_forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius among the fingerprints of a bucket, only as many as join its components."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    leader = list(range(len(fps)))

    def find(i):
        while leader[i] != i:
            leader[i] = i = leader[leader[i]]
        return i

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
        p, q = find(i), find(j)
        if p != q:
            leader[p] = q
            links.append((i, j))
    return links


def _compared(radius: int):
    def run(batches):
        for batch in batches:
            left, right = [], []
            for row in batch.column("fps"):
                fps = row.values.to_numpy(zero_copy_only=False)
                for i, j in _bucket_forest(fps.view(U64), radius):
                    left.append(max(fps[i], fps[j]))
                    right.append(min(fps[i], fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_fingerprints(fps: DataFrame, radius: int = 3, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` (long) within ``radius`` differing bits of each other.

    Every pair within the radius agrees under some mask of the cover, so it meets in a bucket. Buckets of two are decided
    as they are counted; up to ``direct`` fingerprints are compared in one place. Those of a larger bucket are dealt again
    by covers of the bits that its mask leaves free: pairs within the radius still meet, and as about half of the free bits
    go each time (at most 32, 16, 8 are left), a bucket can hold no more distinct fingerprints than its free bits tell
    apart. So no bucket is capped, and none is written out as all its pairs.
    """
    spark: SparkSession = fps.sparkSession
    links, held, rows = None, [0], fps.select("fp")
    while True:
        steps = _refined(held, radius)
        if held == [0]:
            dealt = rows.select("fp", F.explode(F.array(*[F.lit(_signed(n)) for _, n in steps])).alias("held"))
        else:
            # at most 225, then 3375 rows for a radius of three; two steps may lead to one mask
            masks = spark.createDataFrame([(_signed(m), _signed(n)) for m, n in steps], "held long, next long")
            dealt = rows.join(F.broadcast(masks), "held").select("fp", F.col("next").alias("held")).distinct()
        met = dealt.withColumn("value", F.expr("fp & held"))
        counts = met.groupBy("held", "value").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("b"), F.max("fp").alias("a")).where("n > 1")
        counts = cut_lineage(counts)
        free = BITS - min(n.bit_count() for _, n in steps)
        limit = direct if free > LAST_BITS else 1 << free
        twos = counts.where((F.col("n") == 2) & (F.bit_count(F.expr("a ^ b")) <= radius)).select("a", "b")
        some = met.join(counts.where((F.col("n") > 2) & (F.col("n") <= limit)).select("held", "value"), ["held", "value"])
        lists = some.groupBy("held", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = cut_lineage(twos.unionByName(lists.mapInArrow(frugal(_compared(radius)), "a long, b long")).distinct())
        links = found if links is None else links.unionByName(found)
        large = counts.where(F.col("n") > limit).select("held", "value")
        if large.isEmpty():
            return links
        rows = cut_lineage(met.join(large, ["held", "value"]).select("fp", "held").distinct())
        held = sorted({n for _, n in steps})


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: the 64-bit fingerprint of the whole text as a long.

    Words are lower-cased in A-Z and joined by one space, repeated shingles count each time, a shorter text is one
    shingle, and a null text or one without words has fingerprint zero. A long text is read in pieces.
    """
    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(frugal(_fingerprinted(size)), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, direct: int = DIRECT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is the smallest id that can be reached.

    Fingerprints link at ``radius`` or fewer differing bits, texts without words (fingerprint zero) like any others. Rows
    of equal fingerprint become one class before anything is linked, so copies are never paired. Rows that share an id
    are one document: what either reaches, both reach. A row without an id has its fingerprint and no component, and
    links nothing. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    told = cut_lineage(fingerprints(docs, size))
    some = told.where("doc_id is not null")
    classes = cut_lineage(some.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = near_fingerprints(classes.select("fp"), radius, direct)
    several = some.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a <> b")
    same = some.join(several, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")
    member = classes.join(connected(links.unionByName(same)), classes["fp"] == F.col("node"), "left")
    member = member.select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = member.join(smallest, "component").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return told.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)
