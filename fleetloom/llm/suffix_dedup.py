"""Removal of byte strings that occur in an earlier document, by distributed difference-cover suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetloom.llm.chunks import Chunk
from fleetloom.llm.repeats import Shard, Windows, repeated

_BITS = 21  # three names of so many bits fit into one sort key


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers in the order of triples."""
    top = int(max(a.max(), b.max(), c.max())) + 1
    if top <= 1 << _BITS:
        return (a << (2 * _BITS)) | (b << _BITS) | c
    _, pairs = np.unique(a * top + b, return_inverse=True)
    return pairs * top + c


def _names(s: np.ndarray, ones: int, twos: int) -> tuple[np.ndarray, int]:
    """Dense names from 1 of the triples at the places 1, 4, … and 2, 5, …, in their order, and how many there are."""
    a, b, c = (np.concatenate([s[1 + k :: 3][:ones], s[2 + k :: 3][:twos]]) for k in range(3))
    values, names = np.unique(_keys(a, b, c), return_inverse=True)
    return names + 1, len(values)


def _merged(values: np.ndarray, added: np.ndarray) -> np.ndarray:
    """How many of ``values`` come before each of ``added``, both sorted first: one merge of two runs."""
    order = np.argsort(np.concatenate([np.sort(added), np.sort(values)]), kind="stable")
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places[: len(added)] - np.arange(len(added))


def suffix_array(letters: np.ndarray, depth: int | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of integers from 1 up, in their order, by the difference cover {1, 2} modulo 3.

    The triples at the sampled places are sorted and named; equal names are resolved by the suffix array of the names.
    The other suffixes are sorted by their first letter and the rank of what follows, and merged in by counting how
    many sampled ones come before each.

    With a ``depth`` the order is that of the first ``depth`` letters, and suffixes that agree in them stand together in
    any order: names are resolved no further than that, and what is merged may be out of order among such suffixes only.
    With ``wanted``, a flag for each place, only the suffixes that start there are merged and returned.
    """
    n = len(letters)
    wanted = np.ones(n, bool) if wanted is None else wanted
    if n < 16:
        listed = letters.tolist()
        return np.array(sorted(np.flatnonzero(wanted).tolist(), key=lambda i: listed[i:]), np.int64)
    s = np.concatenate([letters, np.zeros(4, np.int64)])
    if depth is not None and depth <= 3:
        places = np.flatnonzero(wanted)
        return places[np.argsort(_keys(s[places], s[places + 1], s[places + 2]))] if len(places) else places
    ones = np.arange(1, n + 1 if n % 3 == 1 else n, 3)  # with one empty triple where the last letter has place 0
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = _names(s, len(ones), len(twos))
    if distinct < len(sample):
        looked_up = np.concatenate([wanted, [True, True]])  # ranks of wanted places and of the two that follow
        looked_up[1:-1] |= wanted
        looked_up[2:] |= wanted
        order = suffix_array(names, None if depth is None else -(-depth // 3), looked_up[sample])
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(order) + 1)
    kept = np.concatenate([wanted, [False]])[sampled]
    sampled, is_one = sampled[kept], order[kept] < len(ones)

    base = n + 4
    rest = np.arange(0, n, 3)[wanted[::3]]
    key_one = s[rest] * base + rank[rest + 1]
    by_key = np.argsort(key_one)
    rest, key_one = rest[by_key], key_one[by_key]
    first, second = sampled[is_one], sampled[~is_one]
    before = _merged(s[first] * base + rank[first + 1], key_one)
    both = np.concatenate([second, rest])
    if int(letters.max()) < 1 << _BITS and base <= 1 << _BITS:
        pair = (s[both] << _BITS) | s[both + 1]
        shift = 1 << _BITS
    else:
        _, pair = np.unique(s[both] * (int(letters.max()) + 1) + s[both + 1], return_inverse=True)
        shift = base
    keys = pair * shift + rank[both + 2]
    before += _merged(keys[: len(second)], keys[len(second) :])
    out = np.empty(len(rest) + len(sampled), np.int64)
    places = np.arange(len(rest)) + before
    out[places] = rest
    left = np.ones(len(out), bool)
    left[places] = False
    out[left] = sampled
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number in byte order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def byte_suffixes(data: np.ndarray, depth: int | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of a byte string, in their order; ``depth`` and ``wanted`` as in :func:`suffix_array`.

    A letter is the eight bytes from a place. Written one after the other for each of the eight alignments, the
    letters are one string whose suffixes are those of the bytes, so that a triple covers 24 bytes.
    """
    n = len(data)
    _, letters = np.unique(_eights(data), return_inverse=True)
    places = np.concatenate([np.append(np.arange(r, n, 8), n) for r in range(8)])
    # a place past the end stands between the alignments; letters start at 2
    written = np.append(letters + 2, 1)[places]
    flags = np.append(np.ones(n, bool) if wanted is None else wanted, False)[places]
    return places[suffix_array(written, None if depth is None else -(-depth // 8), flags)]


def earliest_windows(shard: Shard, width: int):
    """The windows of a shard's contents that several documents may have: content, window, smallest document.

    All contents are one byte string; its suffixes are sorted by ``width`` bytes and those that start a window are compared
    with their neighbours over as many.
    """
    data = np.frombuffer(b"".join(shard.contents), np.uint8)
    ends = np.cumsum(shard.lengths)
    contents = np.repeat(np.arange(len(ends)), shard.lengths)
    wanted = np.arange(len(data)) + width <= ends[contents]
    order = byte_suffixes(data, width, wanted)
    eights = _eights(data)
    same = np.ones(max(0, len(order) - 1), bool)
    for step in [*range(0, width - 7, 8), width - 8]:
        part = eights[order + step]
        same &= part[1:] == part[:-1]
    starts = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(shard.low[contents[order]], starts) if len(starts) else np.zeros(0, np.int64)
    found = np.zeros(len(data), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    places = np.flatnonzero(wanted)
    content = contents[places]
    return content, places - (ends - shard.lengths)[content], found[places]


def _finish(chunk: Chunk, covered: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    before = np.concatenate([[0], np.cumsum(covered)])
    removed = before[places[1:]] - before[places[:-1]]
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    inner = places[1:-1][places[1:-1] < len(covered)]
    begins[inner] = covered[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    spans = spans[places[1:]] - spans[places[:-1]]
    texts = []
    for i, (s, e) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)):
        texts.append(chunk.data[s:e].tobytes() if not removed[i] else chunk.data[s:e][~covered[s:e]].tobytes())
    return pa.RecordBatch.from_arrays(
        [chunk.id_array(), pa.array(np.diff(places)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(texts, pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def _digested(chunk: Chunk, covered: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    out = _finish(chunk, covered, places)
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in out.column("kept")]
    return pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(digests, pa.string())], names=[*out.schema.names[:4], "kept_sha256"])


_COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long"


def remove_repeats(docs: DataFrame, width: int = 50, digest: bool = False) -> DataFrame:
    """Every text without the bytes covered by a ``width``-byte string that also starts in a document of smaller id.

    Rows (doc_id, n_bytes, n_removed, n_spans, kept binary; with ``digest`` its SHA-256 instead). Texts are taken as
    UTF-8 and strings never cross rows; a cut may part a character, so ``kept`` is binary. A null text is empty. A row
    without an id comes after all others, and rows of equal id do not take from each other. An empty table gives none.
    """
    if width < 32:
        raise ValueError("a width of at least 32 bytes is needed")
    windows = Windows(width, 24, of_words=False, shard_tokens=3 << 19)
    if digest:
        return repeated(docs, windows, earliest_windows, _digested, f"{_COLUMNS}, kept_sha256 string", other_documents=True)
    return repeated(docs, windows, earliest_windows, _finish, f"{_COLUMNS}, kept binary", other_documents=True)
