"""Vectorised text work inside tasks: Arrow text columns as byte arrays, word hashes, sliding windows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one numpy pass takes at a time (a longer document is a slice of its own).
SLICE = 1 << 18
_BLOCK = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_1, _MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: ``[\x20\x09-\x0D]``
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: One random value for every byte; the folded table gives A-Z the values of a-z.
BYTE_VALUES = np.random.default_rng(20_260).integers(1, 1 << 63, 256, dtype=U64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = (x ^ (x >> U64(30))) * _MIX_1
    x = (x ^ (x >> U64(27))) * _MIX_2
    return x ^ (x >> U64(31))


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def long_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an integer column (0 for null) and which are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.int64())
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=U64)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = FOLDED_VALUES, gaps: np.ndarray = SPACES):
    """Words of every row: 64-bit hashes, first bytes, ends, and the rows' offsets among the words.

    A word is a run of bytes not in ``gaps`` and never crosses rows. The hash is a polynomial over ``values``,
    taken from prefix sums, so no word becomes a Python object.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    starts = np.flatnonzero(inside & (change | edge[:-1]))
    change[:-1] = change[1:]
    change[-1] = True
    ends = np.flatnonzero(inside & (change | edge[1:])) + 1
    hashes = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):
        first = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        length = int(ends[high - 1] - first)
        up, down = _powers_of(max(length + 1, _BLOCK + 1))
        sums = np.zeros(length + 1, U64)
        np.cumsum(values[data[first : first + length]] * up[:length], out=sums[1:], dtype=U64)
        s, e = starts[low:high] - first, ends[low:high] - first
        hashes[low:high] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _MIX_1
        low = high
    return mix(hashes), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int, stride: int = 1, count: int | None = None) -> np.ndarray:
    """Hash of ``count`` values ``stride`` apart (``size`` neighbours by default) from every position that has them."""
    count = size if count is None else count
    reach = (count - 1) * stride
    n = max(0, len(hashes) - reach)
    out = np.zeros(n, U64)
    for j in range(count):
        out = out * _BASE + hashes[j * stride : j * stride + n]
        out ^= out >> U64(32)
    return mix(out)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash, in the order of the hashes."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def frugal(run):
    """``run`` over a partition's batches; afterwards free memory goes back to the system, as workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


#: Sizes that :func:`bounded_batches` has set.
_BATCHES: set[str] = set()


def bounded_batches(spark, most: str = "4m") -> None:
    """Arrow batches of at most ``most``, unless the session has another size than Spark's own or one set here.

    A batch lies in the JVM's own memory, in the worker's and once more on its way back, beside what the step makes of it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64m", "64MB", *_BATCHES):
        _BATCHES.add(most)
        spark.conf.set(key, most)


def free_name(name: str, taken) -> str:
    """``name`` with as many underscores after it as make it differ from all that are taken, in upper or lower case."""
    lower = {other.lower() for other in taken}
    while name.lower() in lower:
        name += "_"
    return name


def text_beside(docs, columns: list[str]) -> tuple[list[str], str]:
    """The columns to select for ``columns`` and the whole text, and the text's name there: it travels once."""
    if "text" in columns and docs.schema["text"].dataType.typeName() == "string":
        return [], "text"
    name = free_name("_text", columns)
    return [name], name
