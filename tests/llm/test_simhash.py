"""Fingerprints and their links against brute force."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetloom.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    found = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) > 2 else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=3):
    """Rows (id, fingerprint) to the smallest id of each, over ids and links."""
    leader = {i: i for i, _ in rows if i is not None}

    def find(x):
        return x if leader[x] == x else find(leader[x])

    known = [r for r in rows if r[0] is not None]
    for (i, x), (j, y) in itertools.combinations(known, 2):
        if (x ^ y).bit_count() <= radius:
            p, q = sorted((find(i), find(j)))
            leader[q] = p
    return Counter((i, f"{x:016x}", None if i is None else find(i)) for i, x in rows)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 300, n))
    base = say(900)
    texts = [None, "", " \n\t", "One", "one", "a B", "a b c", "A b  c\n", "naïve 漢字 текст ½", base, base, base.upper(), "la " * 700, "x" * 5000]
    for i in range(40):
        edited = base.split()
        for j in rng.integers(0, len(edited), i % 6):
            edited[j] = f"new{i}"
        texts.append(" ".join(edited))
    texts += [say(int(n)) for n in rng.integers(1, 60, 30)]
    return [*enumerate(texts), (3, base), (None, base), (None, None), (9, base)]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, fp string, component int").repartition(3)
    expected = components([(i, plain(t)) for i, t in rows])
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == expected
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, direct=2).collect()) == expected


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    text = " \n".join(f"w{i}" for i in rng.integers(0, 99, 700))
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint("  lone  ") == plain("lone")
    assert simhash.fingerprint("two words    ") == plain("two words")


def test_hash_is_the_one_of_spark(spark):
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("bits", [64, 32, 9])
def test_every_pair_within_the_radius_collides_in_some_table(bits):
    places = list(range(0, 2 * bits, 2)) if bits < 33 else list(range(bits))
    masks = simhash.covering_masks(places, 3)
    assert len(masks) == 15
    for differing in itertools.combinations(places, 3):
        pattern = sum(1 << b for b in differing)
        assert any(not mask & pattern for mask in masks)
    assert bits < 32 or all(0.3 * bits <= mask.bit_count() <= 0.7 * bits for mask in masks)


def test_large_buckets_are_dealt_again_and_lose_no_link(spark):
    rng = np.random.default_rng(8)
    # thousands of fingerprints that differ in a few low bits only, and some far ones
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 11, 900), rng.integers(0, 1 << 14, 300) << 40, rng.integers(0, 1 << 62, 100)]))
    links = simhash.near_fingerprints(spark.createDataFrame([(int(x),) for x in fps], "fp long"), direct=16)
    leader = {int(x): int(x) for x in fps}

    def find(x):
        while leader[x] != x:
            leader[x] = x = leader[leader[x]]
        return x

    for a, b in links.collect():
        assert (a ^ b).bit_count() <= 3
        leader[find(a)] = find(b)
    got = {x: find(x) for x in leader}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert got[int(fps[i])] == got[int(fps[j])]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(docs).count() == 0
