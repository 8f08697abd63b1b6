"""Conversation structure repair by Knuth's lightest-derivation algorithm.

The turns of a conversation are deleted, kept, given another role or inserted so that the roles read
``(s?(ua)+)?``, at the least cost. Items are prefixes (so many turns are repaired, the roles so far leave the grammar in
such a state) and turns (this stretch becomes one turn of such a role); a prefix and the turn behind it deduce the next
prefix. An agenda pops the lightest item until the goal is final.

Weights are (cost, turns covered, audit), added part by part. Adding never lowers a weight: where neither cost nor
covered turns rise, nothing was added. And it keeps the order of two derivations of the same item: they cover the same
turns, and audits of equal cost are never one the beginning of the other, as only insertions, which cost, could follow.
So every function is superior and monotone, and an item is final when it is popped, with the ASCII-least cheapest audit.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.columns import join_null_safe
from fleetloom.llm.textops import bounded_batches, frugal
from fleetloom.session import cut_lineage

#: Turns and characters of a segment, the part of a long conversation that is repaired in one go.
SEGMENT = 256
SEGMENT_CHARS = 1 << 20

#: The costs of edits, and of a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

_SPACES = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_GOAL = (2,)


def _turn_items(codes: str):
    """Weighted axioms ``(weight, (1, start, end, role))``; the role of a deletion is empty.

    A turn's code is the initial of its role (``o``: another one), a capital if it is truncated, ``x`` if it must go.
    """
    for i, code in enumerate(codes):
        yield (DELETE, 1, "D"), (1, i, i + 1, "")
        if code != "x":
            extra = TRUNCATED if code.isupper() else 0
            if code.lower() != "o":
                yield (extra, 1, "K"), (1, i, i + 1, code.lower())
            for role in "ua":
                yield (REROLE + extra, 1, "R"), (1, i, i + 1, role)
    for i in range(len(codes) + 1):
        for role in "ua":
            yield (INSERT, 0, "I"), (1, i, i, role)


def _added(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _final_weights(codes: str, entry: int, wanted: set) -> dict:
    """Weights of items in the order in which they become final, until all of ``wanted`` are, or nothing is left."""
    agenda = [((0, 0, ""), (0, 0, entry)), *_turn_items(codes)]
    heapq.heapify(agenda)
    final, ending, starting = {}, [[] for _ in range(len(codes) + 1)], [[] for _ in range(len(codes) + 1)]
    missing = set(wanted)

    def deduce(prefix: tuple, turn: tuple) -> None:
        state = _STEP.get((prefix[2], turn[3])) if turn[3] else prefix[2]
        if state is not None and (item := (0, turn[2], state)) not in final:
            heapq.heappush(agenda, (_added(final[prefix], final[turn]), item))

    while agenda and missing:  # where the goal alone is wanted, it ends the search
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        missing.discard(item)
        if item[0] == 0:
            ending[item[1]].append(item)
            if item[1] == len(codes) and item[2] in _ENDS:
                heapq.heappush(agenda, (weight, _GOAL))
            for turn in starting[item[1]]:
                deduce(item, turn)
        elif item[0] == 1:
            starting[item[1]].append(item)
            for prefix in ending[item[1]]:
                deduce(prefix, item)
    return final


@lru_cache(maxsize=1 << 16)
def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation."""
    cost, _, audit = _final_weights(codes, 0, {_GOAL})[_GOAL]
    return cost, audit


@lru_cache(maxsize=1 << 10)
def crossings(codes: str) -> tuple:
    """(state before, state after, cost, audit) of the lightest repairs of a part of a conversation."""
    found = []
    for entry in range(4):
        ends = {(0, len(codes), state) for state in range(4)}
        final = _final_weights(codes, entry, ends)
        found += [(entry, item[2], final[item][0], final[item][2]) for item in sorted(ends) if item in final]
    return tuple(found)


def repaired(audit: str, roles: list[str], texts: list[str], state: int = 0):
    """(role, text) of the turns that the edits of ``audit`` leave."""
    at = 0
    for edit in audit:
        role, text = "", ""
        if edit != "I":
            role, text = roles[at], texts[at]
            at += 1
        if edit == "D":
            continue
        if edit in "IR":
            role = "assistant" if state == 2 else "user"
        yield role, text
        state = _STEP[state, role[0]]


class _Part:
    """What is known of some neighbouring turns of a conversation; parts are joined in order."""

    COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal", "numbers")

    def __init__(self, row: dict | None = None):
        row = row or {}
        for name in self.COUNTS:
            setattr(self, name, row.get(name, 0))
        self.first_initial, self.last_initial = row.get("first_initial"), row.get("last_initial")
        self.first_turn, self.last_turn = row.get("first_turn"), row.get("last_turn")

    def append(self, other: _Part) -> None:
        for name in self.COUNTS:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last_initial is not None and other.first_initial is not None:
            self.illegal += self.last_initial + other.first_initial not in ("su", "ua", "au")
        if self.last_turn is not None and self.last_turn == other.first_turn:
            self.numbers -= 1
        self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
        self.last_initial = self.last_initial if other.last_initial is None else other.last_initial
        self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if other.last_turn is None else other.last_turn

    def described(self) -> dict:
        return {name: getattr(self, name) for name in (*self.COUNTS, "first_initial", "last_initial", "first_turn", "last_turn")}

    def result(self, conv_id, cost: int, audit: str, sha256: str) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.numbers
        told = {name: getattr(self, name) for name in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": conv_id, "gaps": gaps, **told, "cost": cost, "audit": audit, "repaired_sha256": sha256}


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = (
    "part int, segment long, turns long, numbers long, first_initial string, last_initial string, first_turn long, last_turn long, "
    "roles array<string>, texts array<string>, crossings array<struct<entry: int, exit: int, cost: long, audit: string>>"
)
_LONG, _TEXT = pa.int64(), pa.string()
_RESULT_ARROW = pa.schema([("conv_id", _LONG), *[(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _TEXT), ("repaired_sha256", _TEXT)])
_CROSSING = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", _LONG), ("audit", _TEXT)])
_SOLVED_ARROW = pa.schema([
    *_RESULT_ARROW, ("part", pa.int32()), ("segment", _LONG), ("turns", _LONG), ("numbers", _LONG), ("first_initial", _TEXT), ("last_initial", _TEXT),
    ("first_turn", _LONG), ("last_turn", _LONG), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT)), ("crossings", pa.list_(_CROSSING)),
])
_NOTHING = object()


class _Conversation:
    """The turns of one conversation in one range, as they pass; long ones leave in segments."""

    def __init__(self, conv_id, opens: bool):
        self.conv_id, self.opens, self.segments, self.mark, self.before = conv_id, opens, 0, _NOTHING, _NOTHING
        self.clear()

    def clear(self) -> None:
        self.part, self.codes, self.roles, self.texts, self.chars = _Part(), [], [], [], 0

    def take(self, turn, role: str, text: str, key: str) -> None:
        one = _Part({"turns": 1, "numbers": int(turn is not None), "first_initial": role[:1], "last_initial": role[:1], "first_turn": turn, "last_turn": turn})
        stripped, same = text.rstrip(_SPACES), (turn, role, key)
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not stripped:
            one.blank, code = 1, "x"
        elif same in (self.mark, self.before):
            one.duplicate, code = 1, "x"
        elif stripped[-1] not in ".!?":
            one.truncated, code = 1, code.upper()
        self.before = same
        self.part.append(one)
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.codes) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def segment(self, part: int) -> dict:
        ways = [dict(zip(("entry", "exit", "cost", "audit"), way, strict=True)) for way in crossings("".join(self.codes))]
        row = {"conv_id": self.conv_id, **self.part.described(), "part": part, "segment": self.segments, "roles": self.roles, "texts": self.texts, "crossings": ways}
        self.segments += 1
        self.clear()
        return row

    def end(self, part: int, closes: bool) -> dict:
        """The result, if the whole conversation was here, or its last segment."""
        if self.segments or self.opens or closes:
            return self.segment(part)
        cost, audit = cheapest("".join(self.codes))
        text = "\n".join(f"{role}:{text}" for role, text in repaired(audit, self.roles, self.texts))
        return self.part.result(self.conv_id, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def _solved(batches):
    """Results of the conversations that lie inside a range, segments of the first and last one and of long ones."""
    now, part, out, size = None, 0, [], 0

    def sent():
        return pa.RecordBatch.from_pylist(out, _SOLVED_ARROW)

    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for conv_id, turn, role, text, key, kind, part in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.end(part, False))
                now = _Conversation(conv_id, now is None)
            if kind == 0:
                now.mark = (turn, role, key)
            elif kind == 1:
                now.take(turn, role, text, key)
                size += len(text)
                if now.full():
                    out.append(now.segment(part))
            if len(out) >= 4096 or size >= 4 * SEGMENT_CHARS:
                yield sent()
                out.clear()
                size = 0
    if now is not None:
        out.append(now.end(part, True))
    yield sent()


class _Fold:
    """The segments of a conversation, one after the other.

    For each state of the grammar the lightest repair so far: its cost, its audit and the running digest of what it
    leaves. Audits are kept as a root and an ending. Roots are ordered and none begins another, so that repairs are
    compared by rank and ending; a root is a chain of pieces, so long audits are never copied.
    """

    def __init__(self):
        self.part, self.carry, self.chains = _Part(), {0: (0, 0, "", hashlib.sha256(), False)}, {0: None}

    def add(self, row: dict) -> None:
        self.part.append(_Part(row))
        best = {}
        for way in row["crossings"]:
            if way["entry"] in self.carry:
                cost, root, ending, _, _ = self.carry[way["entry"]]
                option = (cost + way["cost"], root, ending + way["audit"], way["entry"], way["audit"])
                best[way["exit"]] = min(best.get(way["exit"], option), option)
        carry, chains, root, above = {}, {}, -1, None
        for state, (cost, old, ending, entry, audit) in sorted(best.items(), key=lambda x: x[1][1:3]):
            if above is None or old != above[0] or not ending.startswith(above[1]):
                root, above = root + 1, (old, ending)
                chains[root] = (self.chains[old], ending)
            digest, begun = self.carry[entry][3].copy(), self.carry[entry][4]
            for role, text in repaired(audit, row["roles"], row["texts"], entry):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            carry[state] = (cost, root, ending[len(above[1]) :], digest, begun)
        self.carry, self.chains = carry, chains

    def result(self, conv_id) -> dict:
        cost, root, ending, digest, _ = min((self.carry[s] for s in _ENDS if s in self.carry), key=lambda x: x[:3])
        pieces, chain = [ending], self.chains[root]
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        return self.part.result(conv_id, cost, "".join(reversed(pieces)), digest.hexdigest())


def _folded(batches):
    conv_id, fold, out = _NOTHING, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if conv_id is _NOTHING or row["conv_id"] != conv_id:
                if fold is not None:
                    out.append(fold.result(conv_id))
                conv_id, fold = row["conv_id"], _Fold()
            fold.add(row)
        yield pa.RecordBatch.from_pylist(out, _RESULT_ARROW)
        out = []
    yield pa.RecordBatch.from_pylist([fold.result(conv_id)] if fold else [], _RESULT_ARROW)


def _typed(conversations: DataFrame) -> DataFrame:
    columns = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return conversations.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns.items()])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as a faulty export would give them, by CRC-32 of ``conv_id:turn`` modulo 20.

    0: the row is gone (role and text are null), 1: its text is empty, 2: it has lost ``.``, ``!`` and ``?``, 3: it is
    there twice, 4: its role is user. Nulls are one space, in the text that is hashed and as role and text.
    """
    rows = _typed(conversations)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    there = F.col("fault") != 0
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _key() -> F.Column:
    return F.md5(F.col("text").cast("binary"))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id``: its faults, and the cheapest repair.

    ``conversations`` are (conv_id, turn, role, text); other columns are not read. A row with null role and text stands
    for its conversation only; where just one of them is null, it is one space. A null conv_id is a conversation like any
    other. Turns are ordered by number (nulls first), role and a digest of the text; repeated rows are turns.

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (not ended by ``.``, ``!`` or ``?``). ``gaps`` are missing numbers between the least and the
    greatest, ``illegal`` the neighbours whose role initials are not su, ua or au. Keeping costs 0, another role 1,
    deletion 2 (a must for blank and duplicate turns), an inserted turn without text 5, a truncated turn that stays 5 more.
    ``audit`` has the edits in order (K, R, D, I), the ASCII-least of the cheapest ones; ``repaired_sha256`` is the digest
    of what they leave, as ``role:text`` joined by newlines. A role with an empty name has no initial and cannot be kept.
    An empty table gives no rows.

    Turns are dealt by ranges of their order, so a conversation with most of the rows is repaired in many tasks: in
    segments, from every state to every state of the grammar. Segments of conversations that no range holds whole are then
    joined in order; what passes there is text to be hashed, and nothing but the audit is held.
    """
    bounded_batches(conversations.sparkSession)
    rows = _typed(conversations)
    there = F.col("role").isNotNull() | F.col("text").isNotNull()
    turns = rows.where(there).na.fill(" ", ["role", "text"]).withColumn("key", _key())
    # where a role and text comes in turns of different numbers: all but the first are marked, without their texts
    light = turns.select("conv_id", "turn", "role", "key")
    first = light.groupBy("conv_id", "role", "key").agg(
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("unnumbered")
    )
    first = first.where((F.col("least") < F.col("most")) | (F.col("unnumbered") & F.col("least").isNotNull()))
    first = first.select("conv_id", "role", "key", F.when(~F.col("unnumbered"), F.col("least")).alias("first"))
    marked = join_null_safe(light, first, ["conv_id", "role", "key"], "inner").where(~F.col("turn").eqNullSafe(F.col("first")))
    order = ["conv_id", "turn", "role", "key"]
    marks = marked.select(*order).distinct().select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "key", F.lit(0).alias("kind"))
    names = rows.where(~there).select("conv_id").distinct()
    names = names.select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "string"))], F.lit(2).alias("kind"))
    every = turns.select("conv_id", "turn", "role", "text", "key", F.lit(1).alias("kind")).unionByName(marks).unionByName(names)
    dealt = every.repartitionByRange(*order).sortWithinPartitions(*order, "kind").withColumn("part", F.spark_partition_id())
    solved = cut_lineage(dealt.mapInArrow(frugal(_solved), f"{_RESULT}, {_OPEN}"))
    results = _RESULT_ARROW.names
    whole = solved.where("repaired_sha256 is not null").select(*results)
    parts = solved.where("repaired_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    return whole.unionByName(parts.mapInArrow(frugal(_folded), _RESULT))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that the cheapest repair leaves, ``place`` from 0.

    The letters of the audits are joined to the turns that they edit; inserted turns are joined to none.
    """
    audits = repair_conversations(conversations).select("conv_id", F.posexplode(F.split("audit", "")).alias("i", "edit")).where("edit <> ''")
    upto = Window.partitionBy("conv_id").orderBy("i")
    so_far = lambda letter: F.sum((F.col("edit") != letter).cast("long")).over(upto) - 1
    edits = cut_lineage(audits.select("conv_id", "edit", so_far("I").alias("row"), so_far("D").alias("place"))).where("edit <> 'D'")
    turns = _typed(conversations).where(F.col("role").isNotNull() | F.col("text").isNotNull()).na.fill(" ", ["role", "text"])
    row = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", _key())) - 1
    turns = turns.select("conv_id", row.cast("long").alias("row"), "role", "text")
    found = join_null_safe(edits.where("edit <> 'I'"), turns, ["conv_id", "row"], "inner").select("conv_id", "place", "edit", "role", "text")
    made = edits.where("edit = 'I'").select("conv_id", "place", "edit", F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    every = found.unionByName(made)
    # user and assistant take turns from the first of them on, at place 0 or, behind a system turn, at place 1
    system = F.col("edit").eqNullSafe("K") & (F.col("place") == 0) & F.col("role").startswith("s")
    begins = F.max(F.when(system, 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    taking = F.when((F.col("place") - begins) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return every.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(taking).alias("role"), "text")
