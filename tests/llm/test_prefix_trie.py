"""The conversation trie against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetloom.llm import ordered, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"


def place(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def plain(rows, rebuild):
    convs = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=place):
        convs[row[0]].append((row[2] or "", row[3] or ""))
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in convs.items()}
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = Counter()
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in inside if len(convs[c]) == len(path))
        children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        parent = members[path[:-1]][0] if path else None
        leaves = sum(children(p) == 0 for p in below)
        out[(inside[0], len(path), parent, len(inside), children(path), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = ["hi", "hi there", "", None, "one two  three\n", "é"]
    found = []
    for c in [*range(0, 45), 100, 107, 119]:
        for turn in range(int(rng.integers(0, 9))):
            found.append((c, turn, "user" if turn % 2 == 0 else "assistant", texts[rng.integers(0, 3 if turn < 5 else 6)]))
    found += [(7, None, None, "x"), (7, 2, "user", "tie"), (7, 2, "user", "tie"), (7, 2, "tool", "other"), (None, 1, "user", "lost"), (None, None, None, None)]
    found += [(200, t, "user", f"long {t % 3}") for t in range(37)] + [(201, t, "user", f"long {t % 3}") for t in range(30)]
    return found


@pytest.mark.parametrize(("rebuild", "block"), [(True, 4), (False, 4), (True, 1), (False, 3)])
def test_equals_brute_force(spark, rows, rebuild, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    table = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA).repartition(5)
    made = prefix_trie.shared_prefix_trie if rebuild else prefix_trie.prefix_trie
    assert Counter(tuple(r) for r in made(table, block=block).collect()) == plain(rows, rebuild)


def test_empty_table_and_conversations_without_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.shared_prefix_trie(empty).count() == 0
    # h is 2 for conversation 25 or another: its leader is absent and its only turn is cut away
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    got = prefix_trie.shared_prefix_trie(spark.createDataFrame([(c, 0, "user", "gone", 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_digests_of_keys_over_several_ranges(spark):
    rows = [(k, v) for k in range(5) for v in range(0, 900 if k == 2 else 3 * k)]
    table = spark.createDataFrame(rows, "k long, v long").repartition(7)
    expected = {k: hashlib.sha256(",".join(str(v) for kk, v in rows if kk == k).encode()).hexdigest() for k in {k for k, _ in rows}}
    for limit in (10, 1 << 20):
        assert dict(ordered.joined_sha256(table, ["k"], "v", limit=limit).collect()) == expected


def test_positions_of_a_key_over_several_ranges(spark):
    rows = [(k, v, str(v)) for k in range(4) for v in range(0, 500 if k == 1 else 5)]
    got = ordered.with_position(spark.createDataFrame(rows, "k long, v long, s string").repartition(6), "k", ["v"]).collect()
    assert sorted((r["k"], r["v"], r["pos"]) for r in got) == sorted((k, v, v) for k, v, _ in rows)
