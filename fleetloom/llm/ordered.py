"""Order within a key without one task for a key: positions, and digests of ordered strings."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.session import cut_lineage

#: Bytes of joined strings that are held before they are sent on.
PIECE = 1 << 20


def with_position(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each in its key from 0; equal rows get their places in any order.

    Rows are dealt by ranges of key and order, so a key with most of the rows is many ranges. A row's place is the one in
    its range, moved by what the key has in the ranges before; only a range's first key can have rows before it.
    """
    dealt = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    local = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    held = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_held"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select(key, "_range", F.sum("_held").over(earlier).alias("_moved")).where("_moved > 0")
    placed = dealt.withColumn("pos", local.cast("long")).join(moved, [key, "_range"], "left")
    return placed.withColumn("pos", F.col("pos") + F.coalesce("_moved", F.lit(0))).drop("_range", "_moved")


def _runs(batches, n_keys: int):
    """(key, string) of every row, in order; the key is None after the last one."""
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for row in zip(*columns, strict=True):
            yield row[:n_keys], row[n_keys:]
    yield None, None


def _pieces(schema: pa.Schema, n_keys: int, separator: bytes, limit: int):
    """Digests of keys that lie inside a range; of the first and last one, and of long ones, the joined pieces."""

    def run(batches):
        key, first, held, size, n, out = None, True, [], 0, 0, []

        def piece(last: bool):
            nonlocal held, size, n
            if last and n == 0 and not first:
                out.append((*key, None, None, hashlib.sha256(separator.join(held)).hexdigest(), None))
            elif held:
                out.append((*key, part, n, None, separator.join(held)))
                n += 1
            held, size = [], 0

        part = None
        for now, rest in _runs(batches, n_keys):
            if key is not None and now != key:
                if now is None:
                    first = True  # the last key of a range may go on in the next one
                piece(True)
                first, n = False, 0
            key = now
            if key is None:
                break
            text, part = rest
            held.append(text.encode())
            size += len(held[-1])
            if size >= limit:
                piece(False)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
                out.clear()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    return run


def _joined(schema: pa.Schema, n_keys: int, separator: bytes):
    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:n_keys] != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = row[:n_keys], hashlib.sha256()
                else:
                    digest.update(separator)
                digest.update(row[n_keys])
        if key is not None:
            out.append((*key, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    return run


def joined_sha256(rows: DataFrame, keys: list[str], order: str, separator: str = ",", limit: int = PIECE) -> DataFrame:
    """``keys`` (longs, never null) and ``sha256``: the hex digest of each key's ``order`` values as text, ascending, joined.

    Ranges of (key, order) are sorted each on its own; keys inside a range are done there, others send what they joined,
    in pieces, to one place, where the pieces are hashed as they pass. So nothing holds the values of a key, though
    hashing itself goes from one end to the other.
    """
    names = ", ".join(f"{k} long" for k in keys)
    fields = [(k, pa.int64()) for k in keys]
    dealt = rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    dealt = dealt.select(*keys, F.col(order).cast("string").alias("_text"), F.spark_partition_id().alias("_range"))
    schema = pa.schema([*fields, ("_range", pa.int32()), ("_piece", pa.int64()), ("sha256", pa.string()), ("_bytes", pa.binary())])
    told = dealt.mapInArrow(_pieces(schema, len(keys), separator.encode(), limit), f"{names}, _range int, _piece long, sha256 string, _bytes binary")
    told = cut_lineage(told)
    rest = told.where("sha256 is null").repartition(*keys).sortWithinPartitions(*keys, "_range", "_piece").select(*keys, "_bytes")
    done = rest.mapInArrow(_joined(pa.schema([*fields, ("sha256", pa.string())]), len(keys), separator.encode()), f"{names}, sha256 string")
    return told.where("sha256 is not null").select(*keys, "sha256").unionByName(done)
