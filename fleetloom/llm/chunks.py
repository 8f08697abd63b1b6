"""Documents packed into chunks, so that tasks exchange sorted blobs instead of a row for every word or byte.

A chunk is about four megabytes of whole texts with their ids, compressed. Operators that must look across documents
send what they need to know, sorted, from each chunk to hash buckets, and the buckets answer every chunk in the order
in which it asked. Chunks are written as a table, so a chunk that is computed again asks again in the same order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import bounded_batches, long_column, slices, text_column
from fleetloom.session import cut_lineage

CHUNK_BYTES = 4 << 20
_SCHEMA = "chunk_id long, docs int, size long, ids binary, known binary, offsets binary, payload binary"
_ARROW = pa.schema([("chunk_id", pa.int64()), ("docs", pa.int32()), ("size", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary())])


def pack(data) -> bytes:
    data = np.ascontiguousarray(data)
    return pa.Codec("zstd", 1).compress(data.tobytes(), asbytes=True) if data.size else b""


def unpack(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=size), np.uint8) if size else np.zeros(0, np.uint8)


def _chunked(batches):
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = text_column(batch.column("text"))
        ids, known = long_column(batch.column("doc_id"))
        for low, high in slices(offsets, CHUNK_BYTES):
            own = offsets[low : high + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + n], pa.int64()),
                    pa.array([high - low], pa.int32()),
                    pa.array([int(own[-1] - own[0])], pa.int64()),
                    pa.array([ids[low:high].tobytes()], pa.binary()),
                    pa.array([known[low:high].tobytes()], pa.binary()),
                    pa.array([(own - own[0]).tobytes()], pa.binary()),
                    pa.array([pack(data[own[0] : own[-1]])], pa.binary()),
                ],
                schema=_ARROW,
            )
            n += 1


def chunk_table(docs: DataFrame) -> DataFrame:
    """The texts and ids of ``docs`` (null text: empty) as a written table of chunks."""
    bounded_batches(docs.sparkSession, "16m")  # chunks of CHUNK_BYTES are cut from a batch
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(columns.mapInArrow(_chunked, _SCHEMA))


class Chunk:
    """A row of the chunk table: ids, which ids are known, text bytes, offsets of the documents."""

    def __init__(self, row: dict):
        self.id, self.size = row["chunk_id"], row["size"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = unpack(row["payload"], row["size"])
        self.answers = row.get("answers") or []

    @property
    def rank(self) -> np.ndarray:
        """Ids in their order; a null id comes after all others."""
        return np.where(self.known, self.ids, np.iinfo(np.int64).max)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.known)


def each_chunk(batches):
    """The chunks of Arrow batches, one in memory at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)})


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with what the buckets answered them: an array of (kind, bucket, n, blob); bounded by the chunk's size."""
    told = None
    for kind, answer in enumerate(answers):
        own = answer.select("chunk_id", F.struct(F.lit(kind).alias("kind"), "bucket", "n", "blob").alias("answer"))
        told = own if told is None else told.unionByName(own)
    told = told.groupBy("chunk_id").agg(F.collect_list("answer").alias("answers"))
    return chunks.join(told, "chunk_id", "left")


def text_bytes(chunks: DataFrame) -> int:
    """Bytes of all texts."""
    return chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
