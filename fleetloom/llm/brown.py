"""Language-model scores from class-based n-grams whose word classes come from exchange clustering."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.chunks import Chunk, chunk_table, each_chunk, pack, text_bytes, unpack, with_answers
from fleetloom.llm.textops import FOLDED_VALUES, U64, bucket_of, words
from fleetloom.session import cut_lineage

#: Classes. Words that are at least this share of the training tokens (so at most 16,384) are exchanged among them in
#: rounds; all others that occur so often join the class that they lift the likelihood most in. They stay in their hash
#: buckets, so their number grows with the corpus. Still rarer words, known or not, form one more class.
CLASSES = 96
LEAST_SHARE = 1 / 16_384
LEAST_COUNT = 5
#: Rounds of exchange; in each, half of the words may move.
ROUNDS = 8
#: Weight of a class's share of all tokens in each transition from it.
PRIOR = 20.0
#: Text for which there is one bucket of words.
BUCKET_BYTES = 16 << 20
FEWEST_BUCKETS = 12
PAIR_BUCKETS = 48
#: The hash that stands for the end of a text.
END = U64(0xE17D_0000_0000_0001)


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


class _Tokens:
    """Tokens of a chunk, an end after each document, with the places of the documents among them."""

    def __init__(self, chunk: Chunk, folds: int, fold: int):
        hashes, _, _, places = words(chunk.data, chunk.offsets, FOLDED_VALUES)
        self.hashes = np.insert(hashes, places[1:], END)
        self.places = places + np.arange(len(places))
        self.held_out = np.array([is_held_out(i if k else None, folds, fold) for i, k in zip(chunk.ids.tolist(), chunk.known.tolist(), strict=True)], bool)
        self.training = np.repeat(~self.held_out, np.diff(self.places))


_COUNTS = "bucket int, chunk_id long, n int, blob binary, tokens long, distinct long"
#: Rows of a bucket's commonest words have this instead of a chunk.
_NO_CHUNK = -1


def _count_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk_id", "n", "blob", "tokens", "distinct"])


def _bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))


def _ask_counts(folds: int, fold: int, buckets: int):
    def run(batches):
        for chunk in each_chunk(batches):
            tokens = _Tokens(chunk, folds, fold)
            distinct, index = np.unique(tokens.hashes, return_inverse=True)
            counts = np.bincount(index[tokens.training], minlength=len(distinct)).astype("<u4")
            bounds = _bounds(distinct, buckets)
            yield _count_rows(
                [
                    (b, chunk.id, int(e - s), distinct[s:e].tobytes() + counts[s:e].tobytes(), 0, 0)
                    for b, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                    if e > s
                ]
            )

    return run


def _tell_counts(least_share: float):
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        hashes, counts = [], []
        for n, blob in zip(sizes, table.column("blob"), strict=True):
            raw = blob.as_buffer()
            hashes.append(np.frombuffer(raw, U64, n))
            counts.append(np.frombuffer(raw, "<u4", n, 8 * n))
        distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, index, np.concatenate(counts).astype(np.int64))
        bucket, ends = table.column("bucket")[0].as_py(), np.cumsum(sizes)
        rows = [
            (bucket, chunk, n, pack(total[index[e - n : e]]), 0, 0)
            for chunk, n, e in zip(table.column("chunk_id").to_pylist(), sizes, ends.tolist(), strict=True)
        ]
        common = (total > 0) & (total >= least_share * total.sum())  # all that can reach the share of the whole
        blob = distinct[common].tobytes() + total[common].tobytes()
        rows.append((bucket, _NO_CHUNK, int(common.sum()), blob, int(total.sum()), int((total > 0).sum())))
        return pa.Table.from_batches([_count_rows(rows)])

    return run


def _common_words(batches):
    for batch in batches:
        for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob"), strict=True):
            raw = blob.as_buffer()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(raw, np.int64, n)), pa.array(np.frombuffer(raw, np.int64, n, 8 * n))], names=["word", "count"]
            )


def _ids(common: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the clustered words; all others get the number after the last."""
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, at, len(common))


def _pairs(folds: int, fold: int, common: np.ndarray, buckets: int):
    """Neighbours in the training texts, the end of a text standing before its first word."""
    width, end = len(common) + 1, int(np.searchsorted(common, END))

    def run(batches):
        for chunk in each_chunk(batches):
            tokens = _Tokens(chunk, folds, fold)
            ids = _ids(common, tokens.hashes)
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[tokens.places[:-1][tokens.places[:-1] < len(ids)]] = end
            codes, counts = np.unique((before * width + ids)[tokens.training], return_counts=True)
            home = (codes // width) * buckets // width
            edges = np.searchsorted(home, np.arange(buckets + 1)).tolist()
            yield _count_rows(
                [
                    (b, chunk.id, e - s, pack(np.concatenate([codes[s:e], counts[s:e]])), 0, 0)
                    for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                    if e > s
                ]
            )

    return run


def _sum_pairs(table: pa.Table) -> pa.Table:
    codes, counts = [], []
    for n, blob in zip(table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True):
        both = unpack(blob, 16 * n).view(np.int64)
        codes.append(both[:n])
        counts.append(both[n:])
    codes, index = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, index, np.concatenate(counts))
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([_count_rows([(bucket, _NO_CHUNK, len(codes), pack(np.concatenate([codes, total])), 0, 0)])])


_SIDES = "part int, blob binary"


def _neighbour_classes(classes: np.ndarray, k: int, parts: int):
    """Per bucket of pairs, for a part of the words: counts of the classes before and after each word, and of itself."""
    width = len(classes)

    def run(batches):
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                both = unpack(blob, 16 * n).view(np.int64)
                first, second, counts = both[:n] // width, both[:n] % width, both[n:]
                table = np.zeros((width, 2 * k + 1), np.int64)
                np.add.at(table, (second, classes[first]), counts)
                np.add.at(table, (first, k + classes[second]), counts)
                same = first == second
                np.add.at(table, (first[same], 2 * k), counts[same])
                edges = np.linspace(0, width, parts + 1).astype(int).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int32()), pa.array([pack(table[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["part", "blob"]
                )

    return run


def _part_edges(width: int, parts: int, part: int) -> tuple[int, int]:
    edges = np.linspace(0, width, parts + 1).astype(int)
    return int(edges[part]), int(edges[part + 1])


def _sum_sides(width: int, k: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        s, e = _part_edges(width, parts, part)
        total = sum(unpack(b, (e - s) * (2 * k + 1) * 8).view(np.int64) for b in table.column("blob").to_pylist()) if e > s else np.zeros(0, np.int64)
        return pa.table({"part": pa.array([part], pa.int32()), "blob": pa.array([pack(total)], pa.binary())})

    return run


def _transitions(classes: np.ndarray, k: int, parts: int):
    """A part's share of the class bigrams: rows of words that come second, added to their class's column."""
    width = len(classes)

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                s, e = _part_edges(width, parts, part)
                sides = unpack(blob, (e - s) * (2 * k + 1) * 8).view(np.int64).reshape(e - s, 2 * k + 1)
                out = np.zeros((k, k), np.int64)
                np.add.at(out.T, classes[s:e], sides[:, :k])
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["blob"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(own: int, left: np.ndarray, right: np.ndarray, itself: int, bigrams: np.ndarray, movable: int) -> int:
    """The class, of the first ``movable``, that a word lifts the likelihood of the class bigrams most in.

    ``left`` and ``right`` count the classes before and after the word, ``itself`` how often it follows itself.
    """
    left, right = left.astype(float), right.astype(float)
    left[own] -= itself
    right[own] -= itself
    rest = bigrams.astype(float)
    rest[:, own] -= left
    rest[own, :] -= right
    rest[own, own] -= itself
    into = rest[:, :movable]
    outof = rest[:movable, :]
    gain = (_xlogx(into + left[:, None]) - _xlogx(into)).sum(axis=0) + (_xlogx(outof + right[None, :]) - _xlogx(outof)).sum(axis=1)
    at = np.arange(movable)
    middle = rest[at, at]
    gain -= _xlogx(middle + left[:movable]) + _xlogx(middle + right[:movable]) - 2 * _xlogx(middle)
    gain += _xlogx(middle + left[:movable] + right[:movable] + itself) - _xlogx(middle)
    # wherever the word goes, its neighbours keep it as theirs
    seconds, firsts = (rest.sum(axis=0) + right)[:movable], (rest.sum(axis=1) + left)[:movable]
    for sums, n in ((seconds, left.sum() + itself), (firsts, right.sum() + itself)):
        gain -= _xlogx(sums + n) - _xlogx(sums)
    return int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own


def _moves(classes: np.ndarray, k: int, parts: int, bigrams: np.ndarray, movable: int, turn: int):
    width = len(classes)

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                s, e = _part_edges(width, parts, part)
                sides = unpack(blob, (e - s) * (2 * k + 1) * 8).view(np.int64).reshape(e - s, 2 * k + 1)
                words_, moved = [], []
                for i in range(s, e):
                    if classes[i] >= movable or (i * 2_654_435_761 >> 7) % 2 != turn:
                        continue
                    row = sides[i - s]
                    to = best_class(int(classes[i]), row[:k], row[k : 2 * k], int(row[2 * k]), bigrams, movable)
                    if to != classes[i]:
                        words_.append(i)
                        moved.append(to)
                yield pa.RecordBatch.from_arrays([pa.array(words_, pa.int32()), pa.array(moved, pa.int32())], names=["word", "class"])

    return run


def likelihood(bigrams: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what does not depend on the classes."""
    b = bigrams.astype(float)
    return float(_xlogx(b).sum() - _xlogx(b.sum(axis=0)).sum() - _xlogx(b.sum(axis=1)).sum())


def exchange_clustering(pairs: DataFrame, counts: np.ndarray, end: int, k: int, rounds: int):
    """Classes of the clustered words (the rare class last) and the class bigrams, after rounds of exchange.

    Every round counts the neighbour classes of each word over all pairs, part by part, and then lets half of the words
    move to where the likelihood gains most. The classes of the best round are kept. The end and the rare words have
    the last two classes and stay there. Only classes, their bigrams and moves reach the driver: all bounded by
    ``LEAST_SHARE`` and ``k``.
    """
    width, movable = len(counts) + 1, k - 2
    classes = np.zeros(width, np.int64)
    classes[np.argsort(-counts, kind="stable")] = np.arange(len(counts)) % movable
    classes[end], classes[-1] = k - 2, k - 1
    parts = max(1, min(PAIR_BUCKETS, width // 64))
    best = None
    for turn in range(rounds + 1):
        summed = pairs.mapInArrow(_neighbour_classes(classes, k, parts), _SIDES).groupBy("part")
        add = _sum_sides(width, k, parts)
        sides = cut_lineage(summed.applyInArrow(lambda t: add(t), _SIDES))
        blobs = sides.mapInArrow(_transitions(classes, k, parts), "blob binary").collect()
        bigrams = sum((np.frombuffer(r["blob"], np.int64).reshape(k, k) for r in blobs), np.zeros((k, k), np.int64))
        if best is None or likelihood(bigrams) > best[0]:
            best = (likelihood(bigrams), classes.copy(), bigrams)
        if turn == rounds:
            break
        moves = sides.mapInArrow(_moves(classes, k, parts, bigrams, movable, turn % 2), "word int, class int").collect()
        if not moves and turn % 2:
            break
        classes = classes.copy()
        for word, to in moves:
            classes[word] = to
    return best[1], best[2]


class _Classed:
    """Tokens of a chunk with the counts of its distinct words, and which of them the buckets give classes."""

    def __init__(self, chunk: Chunk, folds: int, fold: int, buckets: int, model: dict):
        self.tokens = _Tokens(chunk, folds, fold)
        self.distinct, self.index = np.unique(self.tokens.hashes, return_inverse=True)
        self.bounds, self.counts = _bounds(self.distinct, buckets), np.zeros(len(self.distinct), np.int64)
        for answer in chunk.answers:
            if answer["kind"] == 0:
                s, e = self.bounds[answer["bucket"]], self.bounds[answer["bucket"] + 1]
                self.counts[s:e] = unpack(answer["blob"], 8 * answer["n"]).view(np.int64)
        self.ids = _ids(model["common"], self.distinct)
        self.klass = model["classes"][self.ids].copy()
        self.joined = np.flatnonzero((self.ids == len(model["common"])) & (self.counts >= model["least_count"]))
        self.joined_bounds = np.searchsorted(bucket_of(self.distinct[self.joined], buckets), np.arange(buckets + 1))
        for answer in chunk.answers:
            if answer["kind"] == 1:
                s, e = self.joined_bounds[answer["bucket"]], self.joined_bounds[answer["bucket"] + 1]
                self.klass[self.joined[s:e]] = unpack(answer["blob"], 2 * answer["n"]).view("<u2")

    def before(self, end_class: int) -> np.ndarray:
        """The class before each token; the end of a text stands before its first word."""
        now = self.klass[self.index]
        out = np.empty_like(now)
        out[1:] = now[:-1]
        out[self.tokens.places[:-1]] = end_class
        return out


_JOIN = "bucket int, chunk_id long, n int, blob binary, entries int, words long, tokens long"
_JOIN_ARROW = pa.schema([("bucket", pa.int32()), ("chunk_id", pa.int64()), ("n", pa.int32()), ("blob", pa.binary()), ("entries", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())])


def _ask_classes(folds: int, fold: int, buckets: int, model, k: int):
    """To each bucket a chunk's words that are to join a class, and how often each class stands before and after them."""

    def run(batches):
        m = model.value
        for chunk in each_chunk(batches):
            c = _Classed(chunk, folds, fold, buckets, m)
            now, training = c.klass[c.index], c.tokens.training
            after = np.empty_like(now)
            after[:-1], after[-1] = now[1:], 0
            place = np.full(len(c.distinct), -1)
            place[c.joined] = np.arange(len(c.joined))
            own = place[c.index]
            # the tokens to join are words, and a word always has an end after it
            chosen = (own >= 0) & training
            codes = np.concatenate([own[chosen] * 2 * k + c.before(m["end_class"])[chosen], own[chosen] * 2 * k + k + after[chosen]])
            codes, counts = np.unique(codes, return_counts=True)
            edges = np.searchsorted(codes // (2 * k), c.joined_bounds)
            rows = []
            for b in range(buckets):
                (s, e), (x, y) = c.joined_bounds[b : b + 2].tolist(), edges[b : b + 2].tolist()
                if e > s:
                    blob = c.distinct[c.joined[s:e]].tobytes() + (codes[x:y] - s * 2 * k).astype("<i4").tobytes() + counts[x:y].astype("<i4").tobytes()
                    rows.append((b, chunk.id, e - s, pack(np.frombuffer(blob, np.uint8)), y - x, 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, _JOIN_ARROW, strict=True)], schema=_JOIN_ARROW)

    return run


def joining_class(codes: np.ndarray, counts: np.ndarray, bigrams: np.ndarray, movable: int) -> int:
    """The class, of the first ``movable``, in which a new word lifts the likelihood of the class bigrams most.

    ``codes`` are classes before the word, and ``len(bigrams)`` more than classes after it, with their ``counts``.
    """
    k = len(bigrams)
    ahead = codes < k
    gain = np.zeros(movable)
    for rows, n in ((bigrams[codes[ahead], :movable], counts[ahead]), (bigrams[:movable, codes[~ahead] - k].T, counts[~ahead])):
        gain += (_xlogx(rows + n[:, None]) - _xlogx(rows)).sum(axis=0)
    for sums, n in ((bigrams.sum(axis=0)[:movable], counts[ahead].sum()), (bigrams.sum(axis=1)[:movable], counts[~ahead].sum())):
        gain -= _xlogx(sums + n) - _xlogx(sums)
    return int(gain.argmax())


def _tell_classes(bigrams: np.ndarray, movable: int):
    """A bucket gives each of its words a class, against the bigrams of the exchanged words, and tells every chunk."""
    k, table_of = len(bigrams), bigrams.astype(float)

    def run(table: pa.Table) -> pa.Table:
        asked = list(zip(table.column("chunk_id").to_pylist(), table.column("n").to_pylist(), table.column("entries").to_pylist(), table.column("blob").to_pylist(), strict=True))
        hashes, places, codes, counts, first = [], [], [], [], 0
        for _, n, m, blob in asked:
            raw = unpack(blob, 8 * n + 8 * m).tobytes()
            hashes.append(np.frombuffer(raw, U64, n))
            code = np.frombuffer(raw, "<i4", m, 8 * n).astype(np.int64)
            places.append(first + code // (2 * k))
            codes.append(code % (2 * k))
            counts.append(np.frombuffer(raw, "<i4", m, 8 * n + 4 * m).astype(np.int64))
            first += n
        distinct, index = np.unique(np.concatenate(hashes), return_inverse=True)
        keys, where = np.unique(index[np.concatenate(places)] * 2 * k + np.concatenate(codes), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys))
        edges = np.searchsorted(keys // (2 * k), np.arange(len(distinct) + 1)).tolist()
        found = np.array([joining_class(keys[s:e] % (2 * k), sums[s:e], table_of, movable) for s, e in zip(edges[:-1], edges[1:], strict=True)], "<u2")
        bucket, at, rows = table.column("bucket")[0].as_py(), 0, []
        for chunk, n, _, _ in asked:
            rows.append((bucket, chunk, n, pack(found[index[at : at + n]]), 0, 0, 0))
            at += n
        rows.append((bucket, _NO_CHUNK, 0, b"", 0, len(distinct), int(sums.sum()) // 2))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _JOIN_ARROW, strict=True)], schema=_JOIN_ARROW)

    return run


def _class_bigrams(folds: int, fold: int, buckets: int, model, k: int):
    """Class bigrams of a partition's training texts, as (code, n)."""

    def run(batches):
        m, total = model.value, np.zeros(k * k, np.int64)
        for chunk in each_chunk(batches):
            c = _Classed(chunk, folds, fold, buckets, m)
            total += np.bincount((c.before(m["end_class"]) * k + c.klass[c.index])[c.tokens.training], minlength=k * k)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["code", "n"])

    return run


def _score(folds: int, fold: int, buckets: int, model):
    def run(batches):
        m = model.value
        for chunk in each_chunk(batches):
            c = _Classed(chunk, folds, fold, buckets, m)
            tokens, index, counts = c.tokens, c.index, c.counts
            rare = c.klass == m["rare_class"]
            emission = np.log10(np.where(rare, (counts + 1) / m["rare_total"], np.maximum(counts, 1) / np.maximum(m["in_class"][c.klass], 1)))
            base = np.log10((counts + 1) / (m["tokens"] + m["vocabulary"] + 1))
            model_score = m["transition"][c.before(m["end_class"]), c.klass[index]] + emission[index]
            sums = lambda x: np.add.reduceat(x, tokens.places[:-1])  # noqa: E731  every document has an end
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.id_array(),
                    pa.array(tokens.held_out),
                    pa.array(np.diff(tokens.places)),
                    pa.array(sums((counts > 0)[index].astype(np.int64))),
                    pa.array(np.full(len(chunk.ids), m["tokens"], np.int64)),
                    pa.array(sums(base[index])),
                    pa.array(sums(model_score)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, classes: int = CLASSES, least_share: float = LEAST_SHARE, rounds: int = ROUNDS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Log10 probabilities of every whole text under a smoothed unigram base and a class bigram model.

    The texts whose crc32(id) modulo ``folds`` is not ``fold`` are learned from; a row without an id is one of them.
    Tokens are the words (A-Z lower-cased) and one end, so a null or empty text is its end alone; repeated rows count
    as often as they come; an empty table gives no rows. Without any training text every probability is that of an
    unknown word.

    P(word | before) = P(class | class before) x P(word | class), where a class keeps ``PRIOR`` counts for the used classes'
    shares of all tokens, and the rare class one for every word and one for all unknown words. Words of ``least_share``
    of the tokens are exchanged among the classes; then every other word with ``least_count`` occurrences joins one, in
    its own hash bucket, which tells the chunks: no list of words outgrows a bucket or reaches the driver. Bigrams are
    counted again over all training texts with the classes of all words.
    """
    chunks = chunk_table(docs)
    buckets = max(FEWEST_BUCKETS, text_bytes(chunks) // BUCKET_BYTES)
    asked = chunks.mapInArrow(_ask_counts(folds, fold, buckets), _COUNTS)
    tell = _tell_counts(least_share)
    told = cut_lineage(asked.groupBy("bucket").applyInArrow(lambda t: tell(t), _COUNTS))
    totals = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, vocabulary = int(totals[0]), int(totals[1])
    found = told.where(F.col("chunk_id") == _NO_CHUNK).mapInArrow(_common_words, "word long, count long")
    end = int(np.array([END]).view(np.int64)[0])
    rows = found.where((F.col("count") >= n * least_share) | (F.col("word") == end)).collect()
    common = np.array([r["word"] for r in rows], np.int64).view(U64)
    counts = np.array([r["count"] for r in rows], np.int64)
    if END not in common:  # an end is common unless the texts are very long; without training texts nothing is
        common, counts = np.append(common, END), np.append(counts, 0)
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    at_end = int(np.searchsorted(common, END))

    pairs = chunks.mapInArrow(_pairs(folds, fold, common, PAIR_BUCKETS), _COUNTS)
    pairs = cut_lineage(pairs.groupBy("bucket").applyInArrow(lambda t: _sum_pairs(t), _COUNTS))
    klass, bigrams = exchange_clustering(pairs, counts, at_end, classes, rounds)

    spark = docs.sparkSession
    model = {"common": common, "classes": klass, "end_class": classes - 2, "rare_class": classes - 1, "least_count": least_count}
    sent = spark.sparkContext.broadcast(model)
    answers = told.where(F.col("chunk_id") != _NO_CHUNK).select("bucket", "chunk_id", "n", "blob")
    asking = with_answers(chunks, answers).mapInArrow(_ask_classes(folds, fold, buckets, sent, classes), _JOIN)
    join = _tell_classes(bigrams, classes - 2)
    joined = cut_lineage(asking.groupBy("bucket").applyInArrow(lambda t: join(t), _JOIN))
    totals = joined.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    classed = joined.where(F.col("chunk_id") != _NO_CHUNK).select("bucket", "chunk_id", "n", "blob")
    whole = with_answers(chunks, answers, classed)
    found = whole.mapInArrow(_class_bigrams(folds, fold, buckets, sent, classes), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    bigrams = np.zeros(classes * classes, np.int64)
    for row in found.collect():  # at most a row for two classes
        bigrams[row["code"]] = row["n"]
    bigrams = bigrams.reshape(classes, classes)

    seen = bigrams.sum(axis=0)
    # a class without words gets no share: nothing could come out of it; the end and the rare words always may
    share = (seen + 1) * ((seen > 0) | (np.arange(classes) >= classes - 2))
    share = share / share.sum()
    transition = (bigrams + PRIOR * share[None, :]) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)
    known = vocabulary - int((counts > 0).sum()) - int(totals[0])
    rare_total = float(n - int(counts.sum()) - int(totals[1]) + known + 1)
    with np.errstate(divide="ignore"):
        transition = np.log10(transition)
    model |= {"transition": transition, "in_class": seen, "rare_total": rare_total, "tokens": n, "vocabulary": vocabulary}
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.mapInArrow(_score(folds, fold, buckets, sent), schema)
