"""Windows that occur more than once in a corpus: candidates by anchors, confirmed by a text index per shard.

The anchor of a window is the smallest hash of the short runs of tokens inside it, so equal windows have equal anchors
and neighbouring windows mostly share theirs. Chunks tell hash buckets which anchors they have; where more than one
place has an anchor, the stretch of windows under it (a segment) goes to the shard of that anchor, and the shard's
index decides which of its windows are equal. Equal segments of a chunk travel once, so a passage in a third of all
documents costs its shard one segment a chunk. Under an anchor with more stretches than a shard should get, every
window travels by itself, to the shard of its own hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.chunks import Chunk, chunk_table, each_chunk, pack, text_bytes, unpack, with_answers
from fleetloom.llm.textops import BYTE_VALUES, U64, bucket_of, mix, shingles, sliding_minimum, words
from fleetloom.session import cut_lineage

#: Windows of one segment at most (a longer stretch under one anchor is cut, as every window is judged on its own).
SEGMENT_WINDOWS = 64
#: Windows whose anchors are found in one pass, so that its arrays stay in the processor's cache.
PASS_WINDOWS = 1 << 15
#: Text for which there is one bucket of anchors, and shards at least.
BUCKET_BYTES = 16 << 20
FEWEST_BUCKETS = 12


class Windows:
    """What a window is made of: ``width`` tokens, bytes or words; anchors are hashes of ``gram`` tokens.

    ``shard_tokens`` is about how many tokens of segments a shard gets.
    """

    def __init__(self, width: int, gram: int, of_words: bool, shard_tokens: int):
        self.width, self.gram, self.of_words, self.shard_tokens = width, gram, of_words, shard_tokens

    @property
    def segment_tokens(self) -> float:
        """Tokens of a segment on average, if anchors were random."""
        return self.width + (self.width - self.gram) / 2

    @property
    def most_stretches(self) -> float:
        """Stretches of one anchor that may share a shard."""
        return self.shard_tokens / self.segment_tokens

    @property
    def spread(self) -> float:
        """Segments' worth of tokens that a stretch is when its windows travel one by one."""
        return ((self.width - self.gram) / 2 + 1) * self.width / self.segment_tokens

    def tokens(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of a chunk and the documents' offsets among them."""
        if not self.of_words:
            return chunk.data, chunk.offsets
        hashes, _, _, places = words(chunk.data, chunk.offsets, BYTE_VALUES)
        return hashes, places

    def _grams(self, tokens: np.ndarray) -> np.ndarray:
        if self.of_words:
            return shingles(tokens, self.gram)
        n = len(tokens)
        if n < self.gram:
            return np.zeros(0, U64)
        eights = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(tokens), strides=(1,)).copy()
        return shingles(eights, self.gram - 7, 8, self.gram // 8)

    def stretches(self, tokens: np.ndarray, places: np.ndarray):
        """Stretches of neighbouring windows under one anchor: anchors, first window, windows, document."""
        none = np.zeros(0, np.int64)
        if len(tokens) < self.width:
            return np.zeros(0, U64), none, none, none
        least = np.empty(len(tokens) - self.width + 1, U64)
        for low in range(0, len(least), PASS_WINDOWS):
            grams = self._grams(tokens[low : low + PASS_WINDOWS + self.width - 1])
            least[low : low + PASS_WINDOWS] = sliding_minimum(grams, self.width - self.gram + 1)
        counts = np.maximum(np.diff(places) - self.width + 1, 0)
        has = np.flatnonzero(counts)
        if len(has) == 0:
            return np.zeros(0, U64), none, none, none
        change = np.zeros(len(least) + 1, bool)
        change[1:-1] = least[1:] != least[:-1]
        first = places[:-1][has]
        change[first] = True
        change[first + counts[has]] = True
        starts = np.flatnonzero(change[:-1])
        ends = np.append(starts[1:], len(least))
        doc = np.searchsorted(places, starts, "right") - 1
        good = starts < places[doc] + counts[doc]
        starts, ends, doc = starts[good], ends[good], doc[good]
        if (pieces := -(-(ends - starts) // SEGMENT_WINDOWS)).max() > 1:
            row = np.repeat(np.arange(len(starts)), pieces)
            part = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, ends, doc = starts[row] + part * SEGMENT_WINDOWS, np.minimum(ends[row], starts[row] + (part + 1) * SEGMENT_WINDOWS), doc[row]
        return mix(least[starts]), starts, ends - starts, doc  # smallest values are mixed, to fill the buckets evenly

    def anchor_places(self, tokens: np.ndarray) -> np.ndarray:
        """The anchor at every place where a run of tokens is the smallest of some window."""
        span = self.width - self.gram + 1
        if len(tokens) < self.width:
            return np.zeros(0, U64)
        grams = self._grams(tokens)
        least = ~sliding_minimum(grams, span)
        rim = np.full(span - 1, ~U64(0))
        return mix(grams[~sliding_minimum(np.concatenate([rim, least, rim]), span) == grams])

    def content(self, tokens: np.ndarray) -> tuple[bytes, int]:
        """The tokens as bytes, and the bytes of a token."""
        return tokens.tobytes(), tokens.dtype.itemsize


def _asked(windows: Windows, tokens: np.ndarray, anchors: np.ndarray, doc: np.ndarray, other_documents: bool):
    """The chunk's distinct anchors in order, which of them it has in several documents, or several places, and which
    of them each stretch has."""
    if not other_documents:
        values, times = np.unique(windows.anchor_places(tokens), return_counts=True)
        return values, times > 1, np.searchsorted(values, anchors)
    order = np.argsort(anchors, kind="stable")  # documents stay in order
    a, d = anchors[order], doc[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    edges = np.append(np.flatnonzero(first), len(a))
    several = d[edges[:-1]] != d[edges[1:] - 1] if len(a) else np.zeros(0, bool)
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(first) - 1
    return a[first], several, index


def _bounds(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1))


_BLOBS = "bucket int, chunk_id long, n int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())],
        names=["bucket", "chunk_id", "n", "blob"],
    )


def _ask(windows: Windows, buckets: int, other_documents: bool):
    def run(batches):
        for chunk in each_chunk(batches):
            tokens, places = windows.tokens(chunk)
            anchors, _, _, doc = windows.stretches(tokens, places)
            asked, several, index = _asked(windows, tokens, anchors, doc, other_documents)
            times = np.bincount(index, minlength=len(asked)).astype("<u4")
            bounds, rows = _bounds(asked, buckets), []
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                s, e = bounds[bucket], bounds[bucket + 1]
                rows.append((bucket, chunk.id, int(e - s), asked[s:e].astype(np.uint32).tobytes() + np.packbits(several[s:e]).tobytes() + pack(times[s:e])))
            yield _rows(rows)

    return run


def _tell(windows: Windows):
    """For every chunk of a bucket, which of its anchors are in several places and which of them have too many stretches
    for one shard (a bit for each, in order), and about how many segments the chunk sends for them."""

    def run(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_pylist()
        low, several, stretches = [], [], []
        for n, blob in zip(counts, table.column("blob"), strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            bits = 4 * n + -(-n // 8)
            low.append(raw[: 4 * n].view(np.uint32))
            several.append(np.unpackbits(raw[4 * n : bits], count=n))
            stretches.append(unpack(raw[bits:].tobytes(), 4 * n).view("<u4"))
        _, index, times = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        several, stretches = np.concatenate(several).astype(bool), np.concatenate(stretches).astype(np.int64)
        shared = times > 1
        shared[index[several]] = True
        total = np.zeros(len(times), np.int64)
        np.add.at(total, index, stretches)
        hot = (shared & (total > windows.most_stretches))[index]
        shared = shared[index]
        sent = np.where(shared, stretches, 0) * np.where(hot, windows.spread, 1.0)
        ends = np.cumsum(counts)
        own = [slice(e - n, e) for n, e in zip(counts, ends.tolist(), strict=True)]
        totals, blobs = [int(sent[x].sum()) for x in own], [np.packbits(shared[x]).tobytes() + np.packbits(hot[x]).tobytes() for x in own]
        return pa.table({"bucket": table.column("bucket"), "chunk_id": table.column("chunk_id"), "n": pa.array(totals, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _segments(windows: Windows, chunk: Chunk, buckets: int, shards: int, other_documents: bool):
    """Shared stretches of a chunk (first window, windows, document, number of the content), its distinct contents (shard,
    first stretch), its tokens as bytes and the bytes of a token.

    Contents are numbered shard by shard, and in a shard in the order of their first place, alike whenever the chunk is
    read. Equal contents have equal anchors, so they are in one shard.
    """
    tokens, places = windows.tokens(chunk)
    anchors, starts, counts, doc = windows.stretches(tokens, places)
    asked, _, index = _asked(windows, tokens, anchors, doc, other_documents)
    bounds, shared, hot = _bounds(asked, buckets), np.zeros(len(asked), bool), np.zeros(len(asked), bool)
    for answer in chunk.answers:
        if answer["kind"] == 0:
            s, e = bounds[answer["bucket"]], bounds[answer["bucket"] + 1]
            bits, half = np.frombuffer(answer["blob"], np.uint8), len(answer["blob"]) // 2
            shared[s:e] = np.unpackbits(bits[:half], count=int(e - s)).astype(bool)
            hot[s:e] = np.unpackbits(bits[half:], count=int(e - s)).astype(bool)
    good = shared[index]
    anchors, starts, counts, doc, alone = anchors[good], starts[good], counts[good], doc[good], hot[index][good]
    raw, width = windows.content(tokens)
    homes = anchors * U64(0x9E3779B97F4A7C15)
    if alone.any():  # equal windows have equal hashes, so they still meet
        n = np.where(alone, counts, 1)
        row = np.repeat(np.arange(len(n)), n)
        starts = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        counts, doc, homes, alone = np.where(alone, 1, counts)[row], doc[row], homes[row], alone[row]
        spans = (starts[alone] * width).tolist()
        homes[alone] = mix(np.array([zlib.crc32(raw[s : s + windows.width * width]) for s in spans], U64))
    shard = bucket_of(homes, shards)
    seen: dict[bytes, int] = {}
    spans = zip((starts * width).tolist(), ((starts + counts + windows.width - 1) * width).tolist(), strict=True)
    number = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in spans), np.int64, len(starts))
    firsts = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    order = np.argsort(shard[firsts], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return tokens, places, starts, counts, doc, place[number], shard[firsts[order]], firsts[order], raw, width


def _send(windows: Windows, buckets: int, shards: int, other_documents: bool):
    def run(batches):
        for chunk in each_chunk(batches):
            _, _, starts, counts, doc, number, homes, firsts, raw, width = _segments(windows, chunk, buckets, shards, other_documents)
            rank = chunk.rank[doc]
            head = np.zeros((4, len(firsts)), np.int64)  # lengths, smallest and largest document, places
            head[0], head[1], head[2] = counts[firsts] + windows.width - 1, np.iinfo(np.int64).max, np.iinfo(np.int64).min
            np.minimum.at(head[1], number, rank)
            np.maximum.at(head[2], number, rank)
            head[3] = np.bincount(number, minlength=len(firsts))
            begins, ends, rows = (starts[firsts] * width).tolist(), ((starts[firsts] + head[0]) * width).tolist(), []
            for home, s, e in zip(*(x.tolist() for x in _groups(homes)), strict=True):
                text = b"".join(raw[b:t] for b, t in zip(begins[s:e], ends[s:e], strict=True))
                rows.append((home, chunk.id, e - s, head[:, s:e].tobytes() + pack(np.frombuffer(text, np.uint8))))
            yield _rows(rows)

    return run


def _groups(values: np.ndarray):
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[edges], edges, np.append(edges[1:], len(values)) if len(values) else edges


class Shard:
    """The segments of one shard: distinct contents with their places, and who sent which."""

    def __init__(self, table: pa.Table, width: int):
        self.senders, contents = [], {}
        self.low, self.places = [], []
        for chunk, n, blob in zip(table.column("chunk_id").to_pylist(), table.column("n").to_pylist(), table.column("blob"), strict=True):
            raw = blob.as_buffer()
            lengths, low, high, places = np.frombuffer(raw, np.int64, 4 * n).reshape(4, n)
            size = int(lengths.sum()) * width
            text = unpack(bytes(memoryview(raw)[32 * n :]), size).tobytes()
            index, at = np.zeros(n, np.int64), 0
            for i, length in enumerate((lengths * width).tolist()):
                index[i] = contents.setdefault(text[at : at + length], len(contents))
                at += length
            self.senders.append((chunk, index, low, high, places))
        self.contents = list(contents)
        self.low = np.full(len(contents), np.iinfo(np.int64).max)
        self.places = np.zeros(len(contents), np.int64)
        for _, index, low, _, places in self.senders:
            np.minimum.at(self.low, index, low)
            np.add.at(self.places, index, places)
        self.lengths = np.array([len(c) // width for c in self.contents], np.int64)


_RUN = np.dtype([("number", "<i4"), ("first", "<i4"), ("last", "<i4"), ("least", "<i8")])


def _solve(windows: Windows, solver: Callable):
    width = 8 if windows.of_words else 1

    def run(table: pa.Table) -> pa.Table:
        shard = Shard(table, width)
        owner, window, least = solver(shard, windows.width)
        # neighbouring windows with the same answer make a run
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(owner))
        r_owner, r_first, r_last, r_least = owner[s], window[s], window[e - 1] if len(s) else window[s], least[s]
        at = np.searchsorted(r_owner, np.arange(len(shard.contents) + 1))
        rows = []
        for chunk, index, _, high, _ in shard.senders:
            n = at[index + 1] - at[index]
            number = np.repeat(np.arange(len(index)), n)
            run_at = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + at[index][number]
            useful = r_least[run_at] < high[number]
            number, run_at = number[useful], run_at[useful]
            out = np.zeros(len(number), _RUN)
            out["number"], out["first"], out["last"], out["least"] = number, r_first[run_at], r_last[run_at], r_least[run_at]
            if len(out):
                rows.append((table.column("bucket")[0].as_py(), chunk, len(out), pack(out.view(np.uint8))))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _covered(windows: Windows, chunk: Chunk, buckets: int, shards: int, other_documents: bool):
    """Which tokens of a chunk a repeated window covers, and the documents' offsets among them."""
    tokens, places, starts, _, doc, number, homes = _segments(windows, chunk, buckets, shards, other_documents)[:7]
    depth = np.zeros(len(tokens) + 1, np.int32)
    order = np.argsort(number, kind="stable")
    times = np.bincount(number, minlength=len(homes))
    begins = np.cumsum(times) - times
    rank = chunk.rank[doc]
    held = dict(zip(*(x.tolist() for x in _groups(homes)[:2]), strict=True))
    for answers in _some_runs(chunk.answers):
        runs = np.concatenate([unpack(x["blob"], x["n"] * _RUN.itemsize).view(_RUN) for x in answers])
        content = runs["number"] + np.repeat([held[x["bucket"]] for x in answers], [x["n"] for x in answers])
        n = times[content]
        row = np.repeat(np.arange(len(runs)), n)
        place = order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begins[content][row]]
        hit = rank[place] > runs["least"][row]
        row, place = row[hit], place[hit]
        np.add.at(depth, starts[place] + runs["first"][row], 1)
        np.add.at(depth, starts[place] + runs["last"][row] + windows.width, -1)
    return np.cumsum(depth[:-1]) > 0, places


def _some_runs(answers: list[dict], most: int = 1 << 16):
    """The shards' answers, some at a time: as many as have ``most`` runs, or one."""
    some, n = [], 0
    for answer in answers:
        if answer["kind"] != 1:
            continue
        if some and n + answer["n"] > most:
            yield some
            some, n = [], 0
        some.append(answer)
        n += answer["n"]
    if some:
        yield some


def repeated(docs: DataFrame, windows: Windows, solver: Callable, finish: Callable, schema: str, other_documents: bool) -> DataFrame:
    """``finish(chunk, covered, places)`` of every chunk of ``docs``, with the tokens that repeated windows cover.

    ``solver(shard, width)`` gives the repeated windows of a shard's contents, in order: content, window, and the
    smallest document that has it; a window counts in documents after that one.
    """
    chunks = chunk_table(docs)
    buckets = max(FEWEST_BUCKETS, text_bytes(chunks) // BUCKET_BYTES)
    asked = chunks.mapInArrow(_ask(windows, buckets, other_documents), _BLOBS)
    tell = _tell(windows)
    told = cut_lineage(asked.groupBy("bucket").applyInArrow(lambda t: tell(t), _BLOBS))
    shared = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(FEWEST_BUCKETS, int(shared * windows.segment_tokens / windows.shard_tokens))
    sent = with_answers(chunks, told).mapInArrow(_send(windows, buckets, shards, other_documents), _BLOBS)
    solve = _solve(windows, solver)
    solved = sent.groupBy("bucket").applyInArrow(lambda t: solve(t), _BLOBS)

    def run(batches):
        for chunk in each_chunk(batches):
            covered, places = _covered(windows, chunk, buckets, shards, other_documents)
            yield finish(chunk, covered, places)

    return with_answers(chunks, told, solved).mapInArrow(run, schema)
