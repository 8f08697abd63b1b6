"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.textops import LOWER_BYTES, U64, bounded_batches, free_name, frugal, mix, slices, text_beside, text_column

#: Hash buckets of the n-grams, and the longest n-gram.
BUCKETS = 1 << 15
LONGEST = 3
#: Languages that a model may have: bounds the matrix that is sent to every executor (languages x buckets doubles).
MOST_LANGUAGES = 512
UNDETERMINED = "und"

_LEAD = np.zeros(256, np.uint32)  # bytes of a character by its first byte
_LEAD[:0x80], _LEAD[0xC0:0xE0], _LEAD[0xE0:0xF0], _LEAD[0xF0:] = 1, 2, 3, 4
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_ANY_LETTER = regex.compile(r"\p{L}")


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 rows as integers, A-Z lower-cased, and the rows' offsets among them."""
    padded = np.concatenate([LOWER_BYTES[data], np.zeros(4, np.uint8)])
    places = np.flatnonzero(_LEAD[data])
    values = np.ndarray(len(data), "<u4", padded, strides=(1,))[places]
    return (values & _KEPT[_LEAD[data[places]]]).astype(U64), np.searchsorted(places, offsets)


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int):
    """For every n: buckets of the n-grams that lie inside a row, and the rows' offsets among them."""
    chars, places = _characters(data, offsets)
    state, counts = np.zeros(len(chars), U64), np.diff(places)
    for n in range(1, longest + 1):
        if len(state) > len(chars) - n + 1:
            state = state[: max(0, len(chars) - n + 1)]
        state = state * U64(0x9E3779B97F4A7C15) + chars[n - 1 :][: len(state)] + U64(n)
        kept = np.maximum(counts - n + 1, 0)
        inside = np.ones(len(chars) + 1, bool)
        for back in range(1, n):  # the last n - 1 characters of a row start no n-gram
            ends = places[1:] - back
            inside[ends[ends >= places[:-1]]] = False
        index = (mix(state) >> U64(40)).astype(np.int64) & (buckets - 1)
        yield index[inside[: len(index)]], np.concatenate([[0], np.cumsum(kept)])


def _sum_blobs(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("counts"))
    docs = sum(table.column("docs").to_pylist())
    return pa.table({"lang": table.column("lang").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // 1024], pa.int64()), "docs": pa.array([docs], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(labelled: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> dict:
    """A model from the ``text`` and ``lang`` of all rows of ``labelled`` where neither is null.

    Counts are summed per task, then over groups of tasks, so a language with most of the rows is no hot group. The
    model is bounded by ``MOST_LANGUAGES``; more labels than that raise a ValueError.
    """

    def count(batches):
        counts, docs = {}, {}
        for batch in batches:
            data, offsets = text_column(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for low, high in slices(offsets):
                base = offsets[low]
                own = data[base : offsets[high]]
                names, codes = np.unique(langs[low:high].astype(str), return_inverse=True)
                total = np.zeros(len(names) * buckets, np.int64)
                for index, places in _grams(own, offsets[low : high + 1] - base, buckets, longest):
                    total += np.bincount(index + np.repeat(codes, np.diff(places)) * buckets, minlength=len(total))
                for k, name in enumerate(names.tolist()):
                    docs[name] = docs.get(name, 0) + int((codes == k).sum())
                    counts[name] = counts.get(name, 0) + total[k * buckets : (k + 1) * buckets]
                if len(counts) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), pa.array([TaskContext.get().partitionId()] * len(counts), pa.int64()), pa.array([docs[x] for x in counts], pa.int64()), pa.array([counts[x].tobytes() for x in counts], pa.binary())],
                names=["lang", "part", "docs", "counts"],
            )

    schema = "lang string, part long, docs long, counts binary"
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sums = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(frugal(count), schema)
    sums = sums.groupBy("lang", F.expr("part div 1024")).applyInArrow(lambda t: _sum_blobs(t), schema)
    rows = sorted(sums.groupBy("lang").applyInArrow(lambda t: _sum_blobs(t), schema).limit(MOST_LANGUAGES + 1).collect())
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows], float).reshape(len(rows), buckets)
    docs = np.array([r["docs"] for r in rows], float)
    return {
        "langs": [r["lang"] for r in rows],
        "prior": np.log(docs / max(1.0, docs.sum())),
        "matrix": np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets)),
        "buckets": buckets,
        "longest": longest,
    }


def predict(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of every row with the likeliest language of its whole text and that language's probability.

    A null text, one without letters and any text under a model without languages is ``und`` with score 0. Ties go to
    the first language in the order of the names. Only ``text`` is looked at; other columns are handed through. The new
    columns are ``lang_pred`` and ``score``, with an underscore more where ``columns`` has such a name.
    """
    told, sureness = free_name("lang_pred", columns), free_name("score", columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    extra, name = text_beside(docs, columns)

    def score(batches):
        m = sent.value
        names = np.array([*m["langs"], UNDETERMINED], object)
        for batch in batches:
            data, offsets = text_column(batch.column(name))
            best, sure = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for low, high in slices(offsets) if m["langs"] else ():
                own, rows = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                logs = np.repeat(m["prior"][:, None], high - low, axis=1)
                for index, places in _grams(own, rows, m["buckets"], m["longest"]):
                    for k in range(len(logs)):
                        sums = np.concatenate([[0.0], np.cumsum(m["matrix"][k][index])])
                        logs[k] += sums[places[1:]] - sums[places[:-1]]
                winner = logs.argmax(axis=0)
                posterior = 1 / np.exp(logs - logs.max(axis=0)).sum(axis=0)
                letters = np.concatenate([[0], np.cumsum(_LETTERS[own])])
                plain = letters[rows[1:]] > letters[rows[:-1]]
                for i in np.flatnonzero(~plain):
                    plain[i] = _ANY_LETTER.search(own[rows[i] : rows[i + 1]].tobytes().decode()) is not None
                best[low:high] = np.where(plain, winner, len(names) - 1)
                sure[low:high] = np.where(plain, posterior, 0.0)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best].tolist(), pa.string()), pa.array(sure)], names=[*columns, told, sureness])

    chosen = docs.select(*columns, *(F.col("text").cast("string").alias(c) for c in extra))
    schema = chosen.select(*columns, F.lit("").alias(told), F.lit(0.0).alias(sureness)).schema
    return chosen.mapInArrow(frugal(score), schema)
