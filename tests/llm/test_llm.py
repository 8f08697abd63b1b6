"""Training-data operators against brute force, on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetloom.llm import ann, brown, decontam, fm_dedup, langid, lines, neardup, packing, queries, repeats, suffix_dedup, textops, urls

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def awkward_rows():
    """Nulls, empty, long and periodic texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = np.random.default_rng(5)
    words = ["the", "of", "tion", "Über", "élan", "x1", "and,", "stone.", "river", "cloud", "ñandú", "low", "kite", "Moss"]
    say = lambda n: " ".join(words[i] + str(rng.integers(0, 40)) for i in rng.integers(0, len(words), n))
    base, passage = say(60), say(52)
    texts = [None, "", " \n\t", "one", "one two", "One two", base, base, base.replace("the", "teh", 1), say(40) + "\n" + passage, passage + "\n" + say(30)]
    texts += ["des " * 90, "sur, " * 200 + passage, say(3000), "a" * 400, "\x00 zero\x00", "naïve 漢字 текст ½ <|endoftext|> <|ENDOFTEXT|> it's I'LL é"]
    for i in range(30):
        edited = base.split()
        for j in rng.integers(0, len(edited), i % 7):
            edited[j] = f"new{rng.integers(0, 9)}"
        texts.append(" ".join(edited))
    texts += [say(int(n)) + "\nsame footer line" for n in rng.integers(1, 80, 40)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[9], (None, passage, "fr", "s0", 1), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, value string, leaf int, bucket int"


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def told(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_suffix_dedup_equals_brute_force(docs, rows):
    rank = lambda i: math.inf if i is None else i
    first = {}
    for i, text, *_ in sorted(rows, key=lambda r: rank(r[0])):
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], rank(i))
    expected = Counter()
    for i, text, *_ in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < rank(i):
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        expected[(i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert told(suffix_dedup.remove_repeats(docs, 50, digest=True), "*") == expected


def test_fm_dedup_equals_brute_force(docs, rows):
    texts = [SPACED.findall(t or "") for _, t, *_ in rows]
    counts = Counter(tuple(w[p : p + 35]) for w in texts for p in range(len(w) - 34))
    expected = Counter()
    for (i, *_), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if counts[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        expected[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert told(fm_dedup.remove_repeated_words(docs), "*") == expected


def test_suffixes_are_sorted_as_deep_and_where_they_are_wanted():
    rng = np.random.default_rng(9)
    for n in [*range(1, 70), 400, 1000]:
        for kinds, period in ((1, 1), (2, n), (3, 7), (200, 90)):
            data = np.resize(rng.integers(1, kinds + 1, period), n).astype(np.uint8)
            data[rng.integers(0, n, 3)] = 1
            raw, wanted = data.tobytes(), rng.random(n) < 0.4
            letters = data.astype(np.int64)
            assert suffix_dedup.suffix_array(letters).tolist() == sorted(range(n), key=lambda i: raw[i:])  # noqa: B023
            for depth in (1, 3, 4, 9, 10, 27, 50, None):
                for found in (suffix_dedup.suffix_array(letters, depth, wanted), suffix_dedup.byte_suffixes(data, depth, wanted)):
                    assert sorted(found.tolist()) == np.flatnonzero(wanted).tolist()
                    starts = [raw[i : i + (depth or n)] for i in found.tolist()]
                    assert starts == sorted(starts)


def test_windows_of_a_shard_are_sorted_no_deeper_than_their_width(monkeypatch):
    rng = np.random.default_rng(10)
    text = rng.integers(97, 123, 3000).astype(np.uint8).tobytes()
    shard = object.__new__(repeats.Shard)
    shard.contents = [text, text[:2900] + b"!" + text[2900:], text[100:], b"a" * 900, text[7:57]]
    shard.lengths, shard.low = np.array([len(c) for c in shard.contents]), np.array([5, 3, 9, 1, 2])
    sizes = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda s, *more, f=suffix_dedup.suffix_array: sizes.append(len(s)) or f(s, *more))
    got = list(zip(*(x.tolist() for x in suffix_dedup.earliest_windows(shard, 50)), strict=True))
    least = {}
    for c, low in zip(shard.contents, shard.low.tolist(), strict=True):
        for p in range(len(c) - 49):
            least[c[p : p + 50]] = min(low, least.get(c[p : p + 50], low))
    assert got == [(i, p, least[c[p : p + 50]]) for i, c in enumerate(shard.contents) for p in range(len(c) - 49)]
    assert len(sizes) == 2  # letters of 8 bytes, and names of 24: three of these cover a window


@pytest.mark.parametrize("windows", [repeats.Windows(50, 24, False, 1000), repeats.Windows(35, 10, True, 1000)])
def test_anchors_do_not_depend_on_the_passes(windows, monkeypatch):
    rng = np.random.default_rng(11)
    tokens = rng.integers(0, 4, 900).astype(np.uint64 if windows.of_words else np.uint8)
    places = np.array([0, 10, 10, 400, 436, 900])
    found = []
    for size in (1, 7, 100, 1 << 15):
        monkeypatch.setattr(repeats, "PASS_WINDOWS", size)
        found.append([x.tolist() for x in windows.stretches(tokens, places)])
    assert found[0] == found[1] == found[2] == found[3] and found[0][0]


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_answers_are_taken_some_at_a_time_and_none_is_lost(most):
    answers = [{"kind": int(i % 5 != 0), "n": n, "bucket": i} for i, n in enumerate([4, 1, 1, 1, 9, 2, 3, 1])]
    some = list(repeats._some_runs(answers, most))
    assert [a for group in some for a in group] == [a for a in answers if a["kind"] == 1]
    assert all(len(group) == 1 or sum(a["n"] for a in group) <= most for group in some)


@pytest.mark.parametrize("of_words", [False, True])
def test_a_frequent_phrase_in_different_texts_is_spread_over_shards(spark, of_words):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**6, n))
    phrase = say(33) if of_words else "a line of license text that a great many pages have"
    texts = [f"{say(30)} {phrase} {say(30)}" for _ in range(600)]
    texts += [texts[3], texts[9][20:400], f"{say(9)} {texts[7][100:]}"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    module, solver, whole = (fm_dedup, fm_dedup.repeated_windows, fm_dedup.remove_repeated_words) if of_words else (suffix_dedup, suffix_dedup.earliest_windows, suffix_dedup.remove_repeats)
    windows = repeats.Windows(35, 10, True, 1000) if of_words else repeats.Windows(50, 24, False, 1000)

    def guarded(shard, width):
        assert shard.lengths.sum() < 12_000
        return solver(shard, width)

    columns = f"{module._COLUMNS}, kept_sha256 string"
    assert told(repeats.repeated(table, windows, guarded, module._digested, columns, not of_words), "*") == told(whole(table, digest=True), "*")


def test_blocks_are_dealt_over_all_partitions_and_rounds_are_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "cut_lineage", lambda df: df)
    lists = spark.createDataFrame([(1, n, 1, n) for n in range(8)], "value long, node long, n long, component long")
    described = spark.createDataFrame([(n, [1], [1]) for n in range(8)], "node long, listed array<long>, sketch array<long>")
    sets = spark.createDataFrame([(n, bytes(8)) for n in range(8)], "node long, members binary")
    found = neardup._block_links(lists, described, sets, 32, 10, 75, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
    assert {x for r in found.collect() for x in r} == set(range(8))
    monkeypatch.undo()
    written = []
    monkeypatch.setattr(neardup, "cut_lineage", lambda df, f=neardup.cut_lineage: written.append(f(df)) or written[-1])
    before, key = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(neardup, "forget", lambda *tables: None)
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        chain = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
        assert {r["component"] for r in neardup.connected(chain).collect()} == {0}
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(len(table.inputFiles()) <= spark.sparkContext.defaultParallelism for table in written[1:])


def test_values_that_rows_of_a_block_share():
    rng = np.random.default_rng(5)
    rows = [rng.choice(300, 40, replace=False) if i % 3 else np.arange(30) for i in range(150)]
    rows[7] = np.zeros(0, np.int64)
    got = neardup._common(np.concatenate(rows), np.repeat(np.arange(150), [len(r) for r in rows]), 150)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in rows] for a in rows]


def test_arrow_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, most, left in (("64m", "4m", "4m"), ("4m", "16m", "16m"), ("16m", "4m", "4m"), ("3m", "4m", "3m")):
            spark.conf.set(key, given)
            textops.bounded_batches(spark, most)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)
    low, high = next(iter(textops.slices(np.arange(0, 1 << 22, 1 << 10))))
    assert (high - low) << 10 <= 1 << 18


def test_near_duplicates_equal_brute_force(docs, rows):
    sets = []
    for _, text, *_ in rows:
        w = SPACED.findall(lower(text or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    leader = {i: i for i, *_ in rows if i is not None}

    def find(x):
        return x if leader[x] == x else find(leader[x])

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                leader[q] = p
    expected = Counter((r[0], len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True))
    assert told(neardup.near_duplicates(docs, block=4), "*") == expected
    assert told(neardup.near_duplicates(docs), "*") == expected


def test_packing_is_gapless_and_tokens_are_the_tokenizers(docs, rows):
    from tokenizers import Tokenizer

    whole, expected = Tokenizer.from_file(TOKENIZER), Counter()
    for i, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            expected[(i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    packed = packing.pack_documents(docs, TOKENIZER, 512, items_per_task=20)
    out = packed.collect()
    assert Counter(tuple(r[:5]) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= math.ceil(sum(r["length"] for r in out) / 512 * 1.1) + 1


def test_decontamination_equals_brute_force(spark, docs, rows):
    rng = np.random.default_rng(2)
    long = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(long[i].split()[3 : 3 + n])) for i, n in enumerate((13, 20, 9, 8, 25, 12))] + [(90, None), (None, "x")]
    items += [(40 + n, " ".join(long[n].split()[5 : 5 + n])) for n in range(1, 9)]  # short ones, some found whole in many texts
    items += [(60, ""), (61, "..."), (62, "short whole text"), (63, "Five words, and no more."), (64, "five words and no more")]
    texts = ["Short: whole text!", "a short whole text", "so five words and no MORE of it", "five words and nothing more"]
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [*rows, *((9000 + i, t) for i, t in enumerate(texts))]
    for i in range(6, 12):  # with substitutions
        w = long[i].split()[2:22]
        for j in rng.integers(0, 20, i - 5):
            w[j] = "zzz"
        items.append((i, " ".join(w)))
    cut = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", lower(t or "").encode())
    expected = Counter()
    for doc, text, *_ in rows:
        w, found = cut(text), []
        for item, other in items:
            x = cut(other)
            size = min(13, len(x))
            needed = 11 if size == 13 else size
            if item is not None and (size >= 5 or 0 < size == len(w)) and any(
                sum(w[p + k] == x[q + k] for k in range(size)) >= needed for p in range(len(w) - size + 1) for q in range(len(x) - size + 1)
            ):
                found.append(item)
        expected[(doc, tuple(found))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_leaks(docs, bench, ["doc_id"])
    assert Counter((r[0], tuple(r[1])) for r in found.collect()) == Counter({(d, tuple(sorted(f))): n for (d, f), n in expected.items()})


def test_lm_base_scores_equal_brute_force_and_model_sums_to_one(docs, rows):
    texts = [SPACED.findall(lower(t or "")) + [None] for _, t, *_ in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter(x for w, h in zip(texts, held, strict=True) if not h for x in w)
    n, v = counts.total(), len(counts)
    expected = sorted(
        (str(r[0]), h, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
        for r, w, h in zip(rows, texts, held, strict=True)
    )
    out = brown.score_documents(docs, classes=8, least_share=1 / 200, rounds=3).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in out) == expected
    assert all(r["score"] < 0 for r in out)


def test_lm_score_equals_brute_force_and_sums_to_one(spark, monkeypatch):
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(60)] + ["fixed"]
    shares = 1 / np.arange(1, 61)
    texts = [" ".join(f"w{i}" for i in rng.choice(60, rng.integers(0, 30), p=shares / shares.sum())) for _ in range(120)] + [None, "only once", "fixed fixed"]
    # from here on held out: every word behind every other one, and unknown words
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held_ids = iter(i for i in range(10_000, 60_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    known = sorted({w for t in texts for w in SPACED.findall(t or "")})
    asked = [f"{a} {b}" for a in ("w0", "w17", "once", "fixed") for b in [*known, "unseen"]] + ["w0", "w17", "once", "fixed"]
    rows = list(zip(ids, texts)) + [(next(held_ids), t) for t in asked]
    kept = {}

    def remember(folds, fold, buckets, sent):
        kept.update(sent.value)
        return score(folds, fold, buckets, sent)

    score = brown._score
    monkeypatch.setattr(brown, "_score", remember)
    out = {r["doc_id"]: r["score"] for r in brown.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), classes=8, least_share=1 / 20, rounds=3, least_count=4).collect()}
    counts = Counter(w for t in texts for w in SPACED.findall(t or ""))
    frequent = {w for w in counts if counts[w] >= 4}
    total = sum(counts.values()) + len(texts)
    assert 0 < sum(counts[w] / total >= 1 / 20 for w in counts) < len(frequent) < len(counts)
    # what is conditional on the word before: P(a b) = P(a) P(b | a) P(end | b)
    single = {t: out[i] for i, t in rows if i >= 10_000}
    p = np.power(10.0, kept["transition"])
    assert p.sum(axis=1) == pytest.approx(1)
    seen, end = kept["in_class"], kept["end_class"]
    assert seen.sum() == total
    classes = [c for c in range(8) if c not in (end, kept["rare_class"]) and seen[c]]

    def fits(word, before, klass):
        chance = (counts[word] + 1) / kept["rare_total"] if word not in frequent else counts[word] / max(seen[klass], 1)
        return p[before, klass] * chance

    # the class of a word is the one that explains all its scores
    own = {}
    for w in ("w0", "w17", "once", "fixed"):
        options = [kept["rare_class"]] if w not in frequent else classes
        own[w] = next(c for c in options if math.log10(fits(w, end, c) * p[c, end]) == pytest.approx(single[w], abs=1e-9, rel=0))
    assert kept["rare_total"] == pytest.approx(sum(counts[w] + 1 for w in counts if w not in frequent) + 1)
    for a, ca in own.items():
        chances, of_class = [], Counter()
        for b in [*known, "unseen"]:
            first = fits(a, end, ca)
            options = [kept["rare_class"]] if b not in frequent else classes
            found = [c for c in options if math.log10(first * fits(b, ca, c) * p[c, end]) == pytest.approx(single[f"{a} {b}"], abs=1e-9, rel=0)]
            assert found, (a, b)
            chances.append(fits(b, ca, found[0]))
            of_class[found[0]] += counts[b]
        assert sum(chances) + p[ca, end] == pytest.approx(1)
        assert all(of_class[c] == seen[c] for c in classes)


def test_joining_class_lifts_the_likelihood_most():
    rng = np.random.default_rng(3)
    for _ in range(40):
        table = rng.poisson(4, (6, 6)) + 20 * (np.arange(6) == 5)
        before, after = rng.permutation(4)[:2], rng.integers(0, 4, 2)
        pairs = [(int(c), -1) for c in before] + [(-1, int(c)) for c in set(after.tolist()) - set(before.tolist())]  # -1: the word
        counts = rng.integers(1, 9, len(pairs))
        for (x, y), n in zip(pairs, counts, strict=True):  # the word is in the rare class so far
            table[x if x >= 0 else 5, y if y >= 0 else 5] += n
        found = []
        for c in range(4):
            moved = table.astype(float).copy()
            for (x, y), n in zip(pairs, counts, strict=True):  # from the rare class, the last one, to c
                moved[x if x >= 0 else 5, y if y >= 0 else 5] -= n
                moved[x if x >= 0 else c, y if y >= 0 else c] += n
            found.append(brown.likelihood(moved))
        codes = np.array([x if x >= 0 else 6 + y for x, y in pairs])
        got = brown.joining_class(codes, counts, table.astype(float), 4)
        assert found[got] == pytest.approx(max(found), abs=1e-6)


def test_exchange_never_lowers_the_likelihood_of_a_single_move():
    rng = np.random.default_rng(1)
    words, k = 30, 6
    pairs = rng.poisson(0.6, (words, words))
    classes = np.arange(words) % k

    def bigrams(c):
        out = np.zeros((k, k), int)
        np.add.at(out, (c[:, None].repeat(words, 1), c[None, :].repeat(words, 0)), pairs)
        return out

    for w in range(words):
        left = np.bincount(classes, weights=pairs[:, w], minlength=k)
        right = np.bincount(classes, weights=pairs[w, :], minlength=k)
        to = brown.best_class(int(classes[w]), left, right, int(pairs[w, w]), bigrams(classes), k)
        moved = [brown.likelihood(bigrams(np.where(np.arange(words) == w, c, classes))) for c in range(k)]
        assert moved[to] == pytest.approx(max(moved))


def test_language_of_awkward_and_held_out_texts(spark, docs):
    english = [(f"the cat and the dog number {i} went over the hill", "en") for i in range(30)]
    german = [(f"der Hund und die Katze Nummer {i} gingen über den Berg", "de") for i in range(30)]
    model = langid.train(spark.createDataFrame([*english, *german, (None, "en"), ("x", None)], "text string, lang string"))
    texts = spark.createDataFrame([("the house and the garden", "a"), ("die Straße und der Garten", "b"), ("12 ?!", "c"), (None, "d"), ("", "e")], "text string, k string")
    found = {r["k"]: (r["lang_pred"], r["score"] > 0.5) for r in langid.predict(texts, model, ["k"]).collect()}
    assert found == {"a": ("en", True), "b": ("de", True), "c": ("und", False), "d": ("und", False), "e": ("und", False)}
    assert langid.predict(docs, model, docs.columns).count() == docs.count()


def test_lines_equal_brute_force(spark, docs, rows):
    trim = lambda x: x.strip(" \t\n\r\x0b\f")
    copied = [(900 + i, f"{rows[9][1]}\nsame footer line\n{i}" if i % 2 else rows[9][1], "en", "s1", 0) for i in range(12)]
    every = [*rows, *copied]
    pages = {(source, text or "") for _, text, _, source, _ in every}
    carry = Counter((source, t) for source, text in pages for t in {trim(x) for x in text.split("\n")} if t)
    expected = Counter()
    for i, text, _, source, _ in every:
        all_lines = text.split("\n") if text is not None else []
        n = sum(s == source for s, _ in pages)
        common = [carry[(source, trim(x))] >= 5 and carry[(source, trim(x))] > 0.1 * n for x in all_lines]
        size = [len(trim(x)) for x in all_lines]
        whole = sum(c * k for c, k in zip(common, size, strict=True)) > 0.5 * sum(size)
        kept = [x for x, c in zip(all_lines, common, strict=True) if whole or not c]
        expected[(i, None if text is None else "\n".join(kept), len(all_lines), len(all_lines) - len(kept))] += 1
    assert sum(n for (*_, dropped), n in expected.items() if dropped)
    table = docs.unionByName(spark.createDataFrame([(*r, 1, "v", 2, 3) for r in copied], SCHEMA))
    assert told(lines.drop_boilerplate(table), "doc_id", "text", "_lines", "_dropped") == expected


def test_clashing_names_are_handed_through(spark, rows):
    clashing = ["score", "lang_pred", "items", "_items", "_text", "_lines", "_dropped", "host", "path", "rule", "Verdict", "unwanted", "site", "drop", "doc", "keys"]
    given = [(i, t, lang, source, n, *range(len(clashing))) for i, t, lang, source, n in rows]
    table = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clashing))
    own = tuple(range(len(clashing)))
    found = langid.predict(table, langid.train(table), table.columns)
    assert found.columns == [*table.columns, "lang_pred_", "score_"]
    assert {r[5:-2] for r in found.collect()} == {own}
    found = lines.drop_boilerplate(table)
    assert found.columns == [*table.columns, "_lines_", "_dropped_"]
    assert {r[5:-2] for r in found.collect()} == {own}
    bench = spark.createDataFrame([(1, rows[9][1])], "item_id long, text string")
    found = decontam.find_leaks(table, bench, table.columns)
    assert found.columns == [*table.columns, "items_"]
    assert {(r["doc_id"], tuple(r["items_"])) for r in found.where(F.size("items_") > 0).collect()} >= {(9, (1,))}
    pages = table.withColumn("url", F.lit("http://casino-win.example.org/x"))
    found = urls.judge_urls(pages, queries.URL_RULES, urls.train(urls.labelled_urls(spark)), pages.columns)
    assert found.columns == [*pages.columns, "host_", "path_", "rule_", "verdict_", "unwanted_"]
    assert {(r["host"], r["host_"], r["verdict_"]) for r in found.collect()} == {(7, "casino-win.example.org", "block")}


def test_pipeline_with_clashing_names_and_with_empty_tables(spark, rows, tmp_path):
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long, score int, lang_pred string, items int, _lines int, _dropped int"
    for given in ([(*r, 1, "x", 2, 3, 4) for r in rows], []):
        table = spark.createDataFrame(given, columns)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{len(given)}-{name}")
            table, before = spark.read.parquet(f"{tmp_path}/{len(given)}-{name}"), table
            if name != "packing":
                assert table.columns == before.columns
                assert {tuple(r)[5:] for r in table.collect()} == ({(1, "x", 2, 3, 4)} if given else set())
        assert (table.count() > 0) == bool(given)


def test_token_ids_of_random_words_with_punctuation():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(TOKENIZER), np.random.default_rng(11)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + list("漢字текстαβ\u0301\u0307½İıſßẞ")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 7))) + "".join(rng.choice(list(".,!?;:-'\")("), rng.integers(0, 3)))
    for text in ["DENİZLİ.", "İ!", "BİLGİ,", *(" ".join(word() for _ in range(4)) for _ in range(3000))]:
        assert np.frombuffer(packing.token_bytes(TOKENIZER, text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_url_rules_and_model(spark):
    urls_given = ["HTTPS://WWW.Example.com/en/a?x", "http://example.com/en/1", "http://sub.example.com", "ftp://a.net/es/#x", "no scheme", None, "://", "http://casino-win.example.org/x", "http://forest.example.org/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_given)], "page_id long, url string")
    model = urls.train(urls.labelled_urls(spark))
    out = {r["page_id"]: tuple(r[1:5]) for r in urls.judge_urls(pages, queries.URL_RULES, model, ["page_id"]).collect()}
    assert out[0] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert out[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert out[2][:3] == ("sub.example.com", "", None)
    assert out[3] == ("a.net", "/es/", "net/es/", "block")
    assert all(out[i][:3] == ("", "", None) for i in (4, 5, 6))
    assert (out[7][3], out[8][3]) == ("block", "allow")
    unseen = [("free-slots", 1), ("casino-win", 1), ("cheap-pills", 1), ("adult-x", 1), ("spam-farm", 1), ("bakery", 0), ("ththre", 0), ("village-hall", 0), ("lighthouse", 0), ("gardening", 0)]
    taught = {name for r in urls.labelled_urls(spark).collect() for name in r["url"].split("/")[2].split(".")}
    assert not taught & {name for name, _ in unseen}
    sites = spark.createDataFrame([(n, f"http://www.{n}.example.com/fr/{y}", y) for n, y in unseen], "name string, url string, y int")
    judged = urls.judge_urls(sites, [], model, ["name", "y"]).collect()
    assert all((r["verdict"] == "block") == bool(r["y"]) for r in judged), judged
    assert urls.train(spark.createDataFrame([], "url string, unwanted int"))[1] == 0.0
    assert urls.judge_urls(pages.where("false"), queries.URL_RULES, model, ["page_id"]).count() == 0


def test_neighbours_reach_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 8)).round(3)
    v[200:700] = v[200]  # a very common vector
    given = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for r in ann.nearest_neighbours(table, leaf=16).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    in_cells = ann.nearest_neighbours(table, leaf=16, cell=3).orderBy("query_id", "rank").collect()  # leaves cut on both sides
    assert [tuple(r) for r in in_cells] == [(q, i + 1, *x) for q in sorted(out) for i, x in enumerate(out[q])]
    hits = 0
    for q in range(0, 1500, 100):
        distance = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [int(i) for i in np.lexsort((np.arange(1500), distance)) if i != q][:10]
        hits += len({i for i, _ in out[q]} & set(order))
        assert all(s == pytest.approx(distance[i], abs=1e-12) for i, s in out[q]) and len(out[q]) == 10
    assert set(out) == set(range(0, 1500, 100)) and hits >= 0.9 * 150
    few = spark.createDataFrame(given[:4], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(few).count() == 3


def test_every_query_has_all_its_neighbours_where_leaves_are_small(spark):
    rng = np.random.default_rng(4)
    tight = np.repeat(rng.normal(size=(12, 8)) * 100, 60, axis=0) + rng.normal(size=(720, 8)) * 0.01
    v = np.concatenate([tight, rng.normal(size=(80, 8)) * 10_000])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = Counter(r["query_id"] for r in ann.nearest_neighbours(table, every=2, leaf=4, recall=0.5).collect())
    assert out == Counter({i: 10 for i in range(0, 800, 2)})


def test_empty_tables(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert fm_dedup.remove_repeated_words(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty, TOKENIZER).count() == 0
    assert brown.score_documents(empty).count() == 0
    assert lines.drop_boilerplate(empty).count() == 0
    assert langid.predict(empty, langid.train(empty), ["doc_id"]).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(empty, bench, ["doc_id"]).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages_equal_plain_versions(spark, docs, rows, tmp_path):
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given, left = docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language":
            assert told(out, "doc_id") == Counter((r[0],) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
        if name == "boilerplate":
            assert out.count() == given.count() and out.where(F.length("text") != F.col("n_chars")).isEmpty()
        if name == "near_duplicates":
            kept = {r[0] for r in neardup.near_duplicates(given).where("kept").collect()}
            assert {r[0] for r in out.select("doc_id").collect()} == kept
        if name == "decontamination":
            left = {r[0] for r in out.select("doc_id").collect()}
            assert 9 not in left and 13 in left
        given = out
    assert {r[0] for r in given.select("doc_id").collect()} == left


def test_pipeline_keeps_one_whole_document_of_copies(spark, tmp_path):
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    one, near = "\n".join(say(12) for _ in range(20)), "\n".join(say(12) for _ in range(20))
    texts = [one] * 40 + [near + f"\n{say(3)}" for _ in range(40)] + [say(60) + "\nall rights reserved" * (i % 3 == 0) for i in range(90)]
    given = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    # six near copies of a text among ten of a site
    given += [(1000 + i, f"{near}\n{say(3)}", "en", "small", 0) for i in range(6)] + [(1100 + i, say(80), "en", "small", 0) for i in range(4)]
    table = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.boilerplate(spark, table, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, out, str(tmp_path)).collect()}
    assert left[0] == one and left[40] == texts[40]
    assert sorted(i for i in left if i < 80) == [0, 40]
    assert all(left[80 + i] == texts[80 + i].split("\n")[0] for i in range(90))
    small = {i: t for i, t, _, source, _ in given if source == "small"}
    assert {i: t for i, t in left.items() if i >= 1000} == {i: small[i] for i in range(1100, 1104)}  # near copies of document 40
    apart = corpus_pipeline.boilerplate(spark, table.where("source = 'small'"), str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_duplicates(spark, apart, str(tmp_path)).collect()}
    assert left == {i: small[i] for i in (1000, *range(1100, 1104))}
