"""Removal of repeated word windows: a compressed FM-index per shard, searched backwards for matching statistics."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetloom.llm.chunks import Chunk
from fleetloom.llm.repeats import Shard, Windows, repeated
from fleetloom.llm.suffix_dedup import suffix_array
from fleetloom.llm.textops import SPACES, U64


class Bits:
    """A bit vector with rank: 64-bit words and a running count for each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        word = i >> 6
        below = self.words[word] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(below)


class WaveletTree:
    """Symbols by their bits, level by level, each level sorted stably by the bit of the one above."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            bits = Bits(bit)
            self.levels.append((level, bits, len(symbols) - bits.ones))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top + 1)
        (self.starts,) = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, *places: np.ndarray):
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            places = [np.where(one, zeros + r, x - r) for r, x in ((bits.rank(x), x) for x in places)]
        return places

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Number of ``symbol`` before the places ``low`` and ``high``."""
        low, high = self._descend(symbol, low, high)
        return low - self.starts[symbol], high - self.starts[symbol]


class FmIndex:
    """The Burrows-Wheeler transform of a shard's contents in a wavelet tree, with the places behind each row."""

    def __init__(self, shard: Shard):
        self.words = np.frombuffer(b"".join(shard.contents), U64)
        self.vocabulary, codes = np.unique(self.words, return_inverse=True)
        n = len(shard.contents)
        ends = np.cumsum(shard.lengths)
        # every content ends in a mark of its own; marks come before all words and among themselves as the contents do
        text = np.insert(codes + n + 1, ends, np.arange(1, n + 1))
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(np.where(last > n, last - n, 0), len(self.vocabulary))
        counts = np.bincount(codes + 1, minlength=len(self.vocabulary) + 1)
        self.smaller = n + np.cumsum(counts) - counts
        owner = np.searchsorted(ends + np.arange(1, n + 1), order, "right")
        self.weight = np.concatenate([[0], np.cumsum(shard.places[owner])])
        self.codes, self.size = codes + 1, len(text)

    def matching_statistics(self, right: np.ndarray, longest: int, least: int = 2) -> np.ndarray:
        """How many words, up to ``longest``, ending before each place ``right`` are found at ``least`` times."""
        low, high = np.zeros(len(right), np.int64), np.full(len(right), self.size, np.int64)
        length, active = np.zeros(len(right), np.int64), np.arange(len(right))
        for step in range(1, longest + 1):
            symbol = self.codes[right[active] - step]
            low, high = self.tree.rank(symbol, low, high)
            base = self.smaller[symbol]
            low, high = low + base, high + base
            good = self.weight[high] - self.weight[low] >= least
            active, low, high = active[good], low[good], high[good]
            length[active] = step
            if len(active) == 0:
                break
        return length


def repeated_windows(shard: Shard, width: int):
    """The windows of a shard's contents that start in two places or more: content, window, a document before all.

    Every content is streamed through the index backwards from each of its window ends. A content that comes from
    several places repeats as a whole.
    """
    windows = shard.lengths - width + 1
    content = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(content)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = shard.places[content] > 1
    if not found.all():
        right = (np.cumsum(shard.lengths) - shard.lengths)[content] + window + width
        found[~found] = FmIndex(shard).matching_statistics(right[~found], width) == width
    content, window = content[found], window[found]
    return content, window, np.full(len(content), np.iinfo(np.int64).min)


def _finish(chunk: Chunk, covered: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    raw = chunk.data.tobytes()
    before = np.concatenate([[0], np.cumsum(covered)])
    removed = before[places[1:]] - before[places[:-1]]
    texts = []
    for i, (s, e) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
        words = raw[s:e].split()  # splits bytes at exactly the white space of SPACES
        if removed[i]:
            words = compress(words, (~covered[places[i] : places[i + 1]]).tolist())
        texts.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [chunk.id_array(), pa.array(np.diff(places)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept"],
    )


def _digested(chunk: Chunk, covered: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    out = _finish(chunk, covered, places)
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in out.column("kept")]
    return pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(digests, pa.string())], names=[*out.schema.names[:3], "kept_sha256"])


assert set(np.flatnonzero(SPACES).tolist()) == set(b" \t\n\r\x0b\f")
_COLUMNS = "doc_id long, n_words long, n_removed long"


def remove_repeated_words(docs: DataFrame, width: int = 35, digest: bool = False) -> DataFrame:
    """Every text without the words covered by a window of ``width`` words that also starts anywhere else.

    Rows (doc_id, n_words, n_removed, kept; with ``digest`` its SHA-256 instead), the kept words joined by one space.
    Words are runs of bytes other than ASCII white space, compared as they are; windows never cross rows; all places
    of a repeated window lose it, in the same row too. A null text has no words; ids, null or repeated, only label the
    rows; an empty table gives none.
    """
    if width < 12:
        raise ValueError("a width of at least 12 words is needed")
    windows = Windows(width, 10, of_words=True, shard_tokens=1 << 18)
    if digest:
        return repeated(docs, windows, repeated_windows, _digested, f"{_COLUMNS}, kept_sha256 string", other_documents=False)
    return repeated(docs, windows, repeated_windows, _finish, f"{_COLUMNS}, kept string", other_documents=False)
