"""Best-fit packing of tokenised documents into sequences of a fixed length, by hierarchical residual packing."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import bounded_batches, frugal, long_column
from fleetloom.session import cut_lineage

#: Items that one packing task takes; later rounds use fewer tasks, never larger ones.
ITEMS_PER_TASK = 65_536
#: A bin with at most this share of a sequence free is nearly full and leaves the rounds.
NEARLY_FULL = 1 / 512
_CACHE_WORDS = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TAIL = re.compile(rb"([^\x00-\x40\x5b-\x60\x7b-\x7f]+)([!-&(-/:-@\[-`{-~]+)")
_tokenizers: dict[str, _Words] = {}


class _Words(dict):
    """Ids of whitespace-free words as little-endian bytes, kept for the words seen lately.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its words. Plain Latin
    words go to the tokenizer's model directly, everything else through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
        self.spelled = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[word] = self._encode(word)
        return found

    def _encode(self, word: bytes) -> bytes:
        if (parts := _TAIL.fullmatch(word)) and _plain(parts[1].decode()) and _plain(parts[1].decode().lower()):
            return self[parts[1]] + self[parts[2]]
        text = word.decode()
        lower = text.lower()
        if _plain(text) and _plain(lower):
            ids = [token.id for token in self.model.tokenize(lower.translate(self.spelled))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def _plain(text: str) -> bool:
    """Latin letters alone, none of which composes with another."""
    return text.isalpha() and max(text) < "\u0250"


def token_bytes(path: str, text: bytes) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers, without special tokens."""
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    folded = text if b"<|" in text else text.lower()  # the special tokens' strings count in lower case only
    return b"".join(map(_tokenizers[path].__getitem__, folded.split()))


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: where it starts in the document's ids, its length and checksum.

    A null text is empty; every document ends with ``end_id``, so each has a piece. Only documents longer than
    ``length`` are cut. Null ids and repeated rows keep their pieces.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * length

    def cut(batches):
        for batch in batches:
            ids, known = long_column(batch.column("doc_id"))
            out = [[], [], [], [], []]
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                tokens = token_bytes(tokenizer, raw) + end
                for piece, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + step]
                    for column, value in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            rows = np.array(out[0], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows], pa.int64(), mask=~known[rows]), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(frugal(cut), _PIECES)


#: A piece in a bin: which row it is (id, known, piece, start, length, checksum) and where it lies in the bin.
_MEMBER = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8"), ("offset", "<i8")])


def _as_items(batches):
    for batch in batches:
        ids, known = long_column(batch.column("doc_id"))
        members = np.zeros(batch.num_rows, _MEMBER)
        members["doc_id"], members["known"] = ids, known
        for name, column in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            members[name] = batch.column(column).to_numpy(zero_copy_only=False)
        raw, size = members.tobytes(), _MEMBER.itemsize
        yield pa.RecordBatch.from_arrays(
            [pa.array(members["length"], pa.int64()), pa.array([raw[i * size : (i + 1) * size] for i in range(len(members))], pa.binary())],
            names=["fill", "members"],
        )


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes into the fullest open bin that takes it. Bins as lists of item positions."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0  # bit r is set while a bin with r free exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_sizes >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = free[room].pop()
            if not free[room]:
                open_sizes ^= 1 << room
        else:
            room, target = capacity, len(bins)
            bins.append([])
        bins[target].append(i)
        left = room - size
        if left:
            if not free[left]:
                open_sizes |= 1 << left
            free[left].append(target)
    return bins


def _pack_partition(capacity: int, slack: int):
    def run(batches):
        sizes, members = [], []
        for batch in batches:
            sizes.append(batch.column("fill").to_numpy(zero_copy_only=False))
            members += batch.column("members").to_pylist()
        if not members:
            return
        sizes = np.concatenate(sizes)
        fills, blobs = [], []
        for items in best_fit(sizes, capacity):
            at, parts = 0, []
            for i in items:
                part = np.frombuffer(members[i], _MEMBER).copy()
                part["offset"] += at
                at += int(sizes[i])
                parts.append(part.tobytes())
            fills.append(at)
            blobs.append(b"".join(parts))
        fills = np.array(fills, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fills), pa.array(blobs, pa.binary()), pa.array(capacity - fills <= slack)], names=["fill", "members", "done"]
        )

    return run


def pack_items(items: DataFrame, capacity: int, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Bins (fill, members) of items of at most ``capacity``, each item once.

    Every task packs its own items best-fit decreasing and lets nearly full bins go; the underfull ones are the items
    of the next round, in fewer tasks of the same size, until one task takes them all or a round no longer helps. A
    bin has at most ``capacity`` members, a task ``items_per_task`` items on average, whatever the input.
    """
    slack, done = int(capacity * NEARLY_FULL), []
    left = items.count()
    while left:
        tasks = -(-left // items_per_task)
        packed = cut_lineage(items.repartition(tasks).mapInArrow(_pack_partition(capacity, slack), "fill long, members binary, done boolean"))
        open_bins = packed.where(~F.col("done")).select("fill", "members")
        remaining = open_bins.count()
        last = tasks == 1 or remaining > 0.9 * left
        done.append((packed if last else packed.where("done")).select("fill", "members"))
        if last:
            break
        items, left = open_bins, remaining
    if not done:
        return items.select("fill", "members")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _members_out(batches):
    for batch in batches:
        numbers = batch.column("sequence_id").to_numpy(zero_copy_only=False)
        blobs = batch.column("members").to_pylist()
        members = np.frombuffer(b"".join(blobs), _MEMBER)
        sequence = np.repeat(numbers, [len(b) // _MEMBER.itemsize for b in blobs])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(members["doc_id"], pa.int64(), mask=members["known"] == 0),
                pa.array(members["piece"].astype(np.int32)),
                *(pa.array(np.ascontiguousarray(members[name])) for name in ("start", "length", "crc")),
                pa.array(sequence),
                pa.array(np.ascontiguousarray(members["offset"])),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Every document's pieces with the sequence and the offset they are packed at.

    Null texts are empty documents (their end token alone), null ids stay null, repeated rows are packed as often as
    they come, an empty table gives no rows, and columns other than ``doc_id`` and ``text`` are not looked at.
    """
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer, length, end_id))
    items = pieces.mapInArrow(_as_items, "fill long, members binary")
    full = items.where(F.col("fill") == length)
    bins = pack_items(items.where(F.col("fill") < length), length, items_per_task).unionByName(full)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.mapInArrow(
        _members_out, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
