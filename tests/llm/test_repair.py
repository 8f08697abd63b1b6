"""Conversation repair against brute force over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from fleetloom.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, cost int, key string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(c, t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(turns):
    seen, found = set(), []
    for _, role, text in turns:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(turns, found):
    """Every choice of edits by dynamic programming over whole audit strings: (cost, audit, repaired turns)."""
    best = {"": (0, "", ())}  # initials so far, cut to what matters: "", "s", "u", "a"
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def widened(options):
        for _ in range(4):
            for state, (cost, audit, kept) in list(options.items()):
                for name in ("user", "assistant"):
                    if name[0] in follow[state]:
                        new = (cost + 5, audit + "I", (*kept, f"{name}:"))
                        options[name[0]] = min(options.get(name[0], new), new)
        return options

    best = widened(best)
    for (_, role, text), fault in zip(turns, found, strict=True):
        options = {}
        for state, (cost, audit, kept) in best.items():
            choices = [(2, "D", state, kept)]
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                for name, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if name[:1] in follow[state]:
                        choices.append((price + extra, letter, name[:1], (*kept, f"{name}:{text}")))
            for price, letter, to, now in choices:
                new = (cost + price, audit + letter, now)
                options[to] = min(options.get(to, new), new)
        best = widened(options)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows, damaging=True):
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in damage(rows) if damaging else rows:
        convs[c].append((t, role, text))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        found = faults(turns)
        cost, audit, kept = cheapest(turns, found)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[c] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "u", "", None]
    texts = ["Hello.", "What now?", "cut off", "Fine!  \n", "", None, " \t", "naïve ... 漢字", "Same."]
    found = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(0, 9))]
    found += [(c, rng.choice([None, 1, 2, 9]), rng.choice(roles), rng.choice(texts)) for c in range(50, 60) for _ in range(5)]
    found += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(100, 160) for t in range(2 + c % 5)]
    found += [(999, t, rng.choice(roles), rng.choice(texts) if t % 3 else f"Turn {t}.") for t in range(220)]
    found += [(None, 1, "user", "Who?"), (None, None, None, None), (None, 2, "assistant", "Me."), (5, 0, "user", "Hello."), (5, 0, "user", "Hello.")]
    return found


def told(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("segment", [256, 7, 1])
def test_equals_brute_force(spark, rows, segment, monkeypatch):
    table = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA).repartition(5)
    if segment != 256:
        # tasks import the module anew: the setting must travel with the function
        def short(batches):
            repair.SEGMENT = segment
            yield from solved(batches)

        solved = repair._solved
        monkeypatch.setattr(repair, "_solved", short)
    assert told(repair.repair_conversations(repair.damaged(table))) == plain(rows)


def test_parts_joined_in_order_are_the_whole():
    rng = random.Random(9)
    for _ in range(300):
        codes = "".join(rng.choice("suaSUAoOx") for _ in range(rng.randrange(0, 12)))
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x") for c in codes]
        fold, at = repair._Fold(), 0
        while at < len(codes) or at == 0:
            size = rng.randrange(0, 4) if at else rng.randrange(1, 4)
            ways = [dict(zip(("entry", "exit", "cost", "audit"), w, strict=True)) for w in repair.crossings(codes[at : at + size])]
            fold.add({"roles": roles[at : at + size], "texts": list(codes[at : at + size]), "crossings": ways})
            at += size or 0
            if not codes:
                break
        cost, audit = repair.cheapest(codes)
        text = "\n".join(f"{r}:{t}" for r, t in repair.repaired(audit, roles, list(codes)))
        got = fold.result(1)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_weights_become_final_in_order_and_roles_fit_the_grammar():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("suaSUAox") for _ in range(rng.randrange(0, 7)))
        weights = list(repair._final_weights(codes, 0, {repair._GOAL}).values())
        assert weights == sorted(weights)
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x") for c in codes]
        _, audit = repair.cheapest(codes)
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in repair.repaired(audit, roles, roles)))


def test_repaired_turns_are_what_the_digest_tells(spark, rows):
    table = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    kept = defaultdict(list)
    for r in repair.repaired_turns(table).collect():
        kept[r["conv_id"]].append((r["place"], f"{r['role']}:{r['text']}"))
    for c, expected in plain(rows).items():
        turns = sorted(kept[c])
        assert [p for p, _ in turns] == list(range(len(turns)))
        assert hashlib.sha256("\n".join(t for _, t in turns).encode()).hexdigest() == expected[-1]


def test_empty_table_and_a_conversation_without_rows(spark):
    assert repair.repair_conversations(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = told(repair.repair_conversations(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "k")], SCHEMA))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
