"""Redirect chains: every option has at most one outgoing redirect, inside its kind and option type.

The closure is computed once per option by pointer doubling: after round k every option knows the option reached
after 2**k redirects, so a chain of length n takes log2(n) rounds, each a join on unique keys. Chains are not
walked one step at a time and no list of visited options is carried. Every round is checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.columns import redirect_level
from fleetloom.session import cut_lineage

GROUP = ["kind", "option_type"]
NODE = [*GROUP, "id"]


@dataclass
class Closure:
    """``nodes``: per option its end, hops to it, and cycle facts; ``jumps[k]``: the option 2**k redirects on."""

    nodes: DataFrame
    jumps: list[DataFrame]


def _starts(options: DataFrame) -> DataFrame:
    """(kind, option_type, id, to, target_known) for every option."""
    nodes = options.select(*NODE, F.col("redirect.to").alias("to"))
    known = options.select(*GROUP, F.col("id").alias("to"), F.lit(True).alias("target_known"))
    return nodes.join(known, [*GROUP, "to"], "left").select(
        *NODE, "to", F.coalesce("target_known", F.lit(False)).alias("target_known")
    )


def _double(state: DataFrame) -> DataFrame:
    """Replace each unfinished pointer by the pointer of the option it points at."""
    step = state.select(
        *GROUP,
        F.col("id").alias("far"),
        F.col("far").alias("next_far"),
        F.col("hops").alias("next_hops"),
        F.col("low").alias("next_low"),
        F.col("done").alias("next_done"),
    )
    moved = state.filter(~F.col("done")).join(step, [*GROUP, "far"]).select(
        *NODE,
        F.col("next_far").alias("far"),
        (F.col("hops") + F.col("next_hops")).alias("hops"),
        F.least("low", "next_low").alias("low"),
        F.col("next_done").alias("done"),
    )
    return state.filter("done").unionByName(moved)


def _landings(state: DataFrame) -> tuple[int, int]:
    """Number of distinct options open pointers point at: in all, and the most in one kind."""
    per_group = state.filter(~F.col("done")).select(*GROUP, "far").distinct().groupBy(*GROUP).count()
    total, most = per_group.agg(F.sum("count"), F.max("count")).first()
    return total or 0, most or 0


def close(options: DataFrame) -> Closure:
    """Resolve every option: its final option, the number of redirects to it, or the cycle it runs into.

    ``nodes`` columns: end (null on a cycle), hops, missing_target (the target the end could not find),
    circular, on_cycle, cycle_id, cycle_length, entry (first option of the cycle) and hops to that entry.
    """
    starts = cut_lineage(_starts(options))
    follows = F.col("target_known")
    state = starts.select(
        *NODE,
        F.when(follows, F.col("to")).otherwise(F.col("id")).alias("far"),
        F.when(follows, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("hops"),
        F.when(follows, F.least("id", "to")).otherwise(F.col("id")).alias("low"),
        (~follows).alias("done"),
    )
    state = cut_lineage(state)
    jumps, reach, before = [], 1, -1
    landed, most = _landings(state)
    # The options open pointers land on can only become fewer. Once their number stays the same they are exactly
    # the options on cycles; the smallest id of a cycle is known when the reach covers the largest possible cycle.
    while landed and not (landed == before and reach >= most):
        jumps.append(state.select(*NODE, "far", "done"))
        state = cut_lineage(_double(state))
        reach, before = reach * 2, landed
        landed, most = _landings(state)
    jumps.append(state.select(*NODE, "far", "done"))

    ended = state.filter("done").select(*NODE, F.col("far").alias("end"), "hops")
    missing = starts.filter(F.col("to").isNotNull() & ~follows).select(
        *GROUP, F.col("id").alias("end"), F.col("to").alias("missing_target")
    )
    ended = ended.join(missing, [*GROUP, "end"], "left")
    nodes = ended.withColumns(
        {
            "circular": F.lit(False),
            "on_cycle": F.lit(False),
            "cycle_id": F.lit(None).cast("string"),
            "cycle_length": F.lit(None).cast("bigint"),
            "entry": F.lit(None).cast("string"),
        }
    )
    if landed:
        nodes = nodes.unionByName(_cyclic(starts, state, jumps))
    return Closure(cut_lineage(nodes), jumps)


def _cyclic(starts: DataFrame, state: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Options on a cycle (exactly those an open pointer lands on) and options leading into one."""
    looping = state.filter(~F.col("done"))
    cycle = looping.select(*GROUP, F.col("far").alias("id")).distinct().join(looping.select(*NODE, "low"), NODE)
    sizes = cycle.groupBy(*GROUP, "low").agg(F.count("*").alias("cycle_length"))
    cycle = cut_lineage(cycle.join(sizes, [*GROUP, "low"]))
    landing = cycle.select(*GROUP, F.col("id").alias("onward"), F.lit(True).alias("lands"))
    zero = F.lit(0).cast("bigint")
    # longest jumps first: take each one that stays off the cycle; one more redirect then enters it
    tails = looping.select(*NODE).join(cycle.select(*NODE), NODE, "left_anti")
    tails = tails.select(*NODE, F.col("id").alias("at"), zero.alias("hops"))
    for k, jump in reversed(list(enumerate(jumps))):
        hop = jump.select(*GROUP, F.col("id").alias("at"), F.col("far").alias("onward"))
        stays = F.col("lands").isNull()
        tails = (
            tails.join(hop, [*GROUP, "at"])
            .join(landing, [*GROUP, "onward"], "left")
            .select(
                *NODE,
                F.when(stays, F.col("onward")).otherwise(F.col("at")).alias("at"),
                F.when(stays, F.col("hops") + (1 << k)).otherwise(F.col("hops")).alias("hops"),
            )
        )
    last = starts.select(*GROUP, F.col("id").alias("at"), F.col("to").alias("entry"))
    tails = tails.join(last, [*GROUP, "at"]).select(*NODE, (F.col("hops") + 1).alias("hops"), "entry")
    every = tails.unionByName(cycle.select(*NODE, zero.alias("hops"), F.col("id").alias("entry")))
    info = cycle.select(*GROUP, F.col("id").alias("entry"), F.col("low").alias("cycle_id"), "cycle_length")
    return every.join(info, [*GROUP, "entry"]).select(
        *NODE,
        F.lit(None).cast("string").alias("end"),
        "hops",
        F.lit(None).cast("string").alias("missing_target"),
        F.lit(True).alias("circular"),
        (F.col("hops") == 0).alias("on_cycle"),
        "cycle_id",
        "cycle_length",
        "entry",
    )


def resolve_redirects(selected: DataFrame, options: DataFrame, closure: Closure) -> DataFrame:
    """Desired option of each selected (kind, option_type, id, ...) with the number of steps, or the error.

    Errors: the selected id is unknown, a target is unknown (names its source), or the redirects are circular
    (names the option that points back).
    """
    nodes = closure.nodes
    # the option of a cycle that points at its entry closes the circle
    closers = options.filter(F.col("redirect").isNotNull()).select(
        *GROUP, F.col("redirect.to").alias("entry"), F.col("id").alias("closer")
    )
    on_cycle = nodes.filter("on_cycle").select(*GROUP, F.col("id").alias("closer"))
    closers = closers.join(on_cycle, [*GROUP, "closer"])
    joined = selected.join(nodes, NODE, "left").join(closers, [*GROUP, "entry"], "left")
    what = F.concat(F.col("option_type"), F.lit('Config with id "'))
    known = F.col("circular").isNotNull()
    error = (
        F.when(~known, F.concat(what, F.col("id"), F.lit('" not found')))
        .when(F.col("circular"), F.concat(what, F.col("closer"), F.lit('" has a circular redirect')))
        .when(
            F.col("missing_target").isNotNull(),
            F.concat(
                what, F.col("missing_target"), F.lit('" not found, was redirected from "'), F.col("end"), F.lit('"')
            ),
        )
    )
    return (
        joined.withColumn("error", error)
        .withColumn("desired", F.when(F.col("error").isNull(), F.col("end")))
        .withColumn("steps", F.when(F.col("error").isNull(), F.col("hops")))
        .select(*selected.columns, "desired", "steps", "error")
    )


def _positions(chains: DataFrame, closure: Closure) -> DataFrame:
    """(start, pos, source) for pos 0 .. length-1 of each (kind, option_type, id, length).

    The option at a position is found by following the binary digits of the position through the jump tables, one join
    for each digit that the longest chain has. The rows are the chains themselves, which is the size of the answer.
    """
    rows = chains.filter(F.col("length") > 0).select(
        *GROUP,
        F.col("id").alias("start"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("pos"),
        F.col("id").alias("source"),
    )
    for k, jump in enumerate(closure.jumps):
        hop = jump.select(*GROUP, F.col("id").alias("source"), F.col("far").alias("onward"))
        moves = F.shiftright("pos", k) % 2 == 1
        rows = rows.join(hop, [*GROUP, "source"]).select(
            *GROUP, "start", "pos", F.when(moves, F.col("onward")).otherwise(F.col("source")).alias("source")
        )
    return rows


def _asked(nodes: DataFrame, asked: DataFrame | None) -> DataFrame:
    return nodes if asked is None else nodes.join(asked.select(*NODE).distinct(), NODE, "left_semi")


def chain_length(missing_counts: bool) -> Column:
    """Steps of a chain: up to its end, plus the step to a missing target if asked, or once around its cycle."""
    extra = F.when(F.col("missing_target").isNotNull() & F.lit(missing_counts), 1).otherwise(0)
    return F.when(F.col("circular"), F.col("hops") + F.col("cycle_length") - 1).otherwise(F.col("hops") + extra)


def redirect_steps(options: DataFrame, closure: Closure, asked: DataFrame | None = None) -> DataFrame:
    """(kind, option_type, start, pos, source, target) of every chain that resolves.

    ``asked`` (kind, option_type, id) names the starts that are wanted; the answer is as long as their chains together.
    """
    good = _asked(closure.nodes, asked).filter(~F.col("circular") & F.col("missing_target").isNull())
    steps = _positions(good.withColumn("length", chain_length(False)), closure)
    edges = options.select(*GROUP, F.col("id").alias("source"), F.col("redirect.to").alias("target"))
    return steps.join(edges, [*GROUP, "source"])


def redirect_preview(options: DataFrame, closure: Closure, asked: DataFrame | None = None) -> DataFrame:
    """Steps of every chain, or of those that begin at an ``asked`` option, never failing: cycles stop before the
    repeated option, a missing target is a last step shown as "(not found)". Messages are attached to each step."""
    steps = _positions(_asked(closure.nodes, asked).withColumn("length", chain_length(True)), closure)
    edges = options.select(
        *GROUP,
        F.col("id").alias("source"),
        F.col("display_name").alias("source_display"),
        F.col("redirect.to").alias("target"),
        F.when(F.col("redirect.text").isNotNull(), redirect_level(F.col("redirect.level"))).alias("message_level"),
        F.col("redirect.text").alias("message_text"),
    )
    targets = options.select(*GROUP, F.col("id").alias("target"), F.col("display_name").alias("target_display"))
    return (
        steps.join(edges, [*GROUP, "source"])
        .join(targets, [*GROUP, "target"], "left")
        .withColumn(
            "target_display", F.coalesce("target_display", F.concat(F.col("target"), F.lit(" (not found)")))
        )
    )


def preview_summary(closure: Closure) -> DataFrame:
    """Per option: number of previewed steps, final target and cycle flag."""
    final = F.when(
        ~F.col("circular") & F.col("missing_target").isNull() & (F.col("hops") > 0), F.col("end")
    )
    return closure.nodes.select(
        *NODE, chain_length(True).alias("steps"), final.alias("final_target"), F.col("circular").alias("cycle_detected")
    )


def redirect_cycles(closure: Closure) -> DataFrame:
    """Options on a cycle (self-redirects included) with a cycle id; options leading into one are not part of it."""
    return closure.nodes.filter("on_cycle").select(*NODE, "cycle_id", "cycle_length")


def resolve_workspaces(workspaces: DataFrame, options: DataFrame, closure: Closure) -> DataFrame:
    """Desired image and pod of each workspace, their errors, and whether a restart is pending.

    The per-option answers are joined twice, so the cost of the closure does not grow with the fleet.
    """
    every = options.select(*NODE)
    resolved = resolve_redirects(every, options, closure)
    for option_type in ("image", "pod"):
        part = resolved.filter(F.col("option_type") == option_type).select(
            "kind",
            F.col("id").alias(f"{option_type}_id"),
            F.col("desired").alias(f"desired_{option_type}"),
            F.col("steps").alias(f"{option_type}_steps"),
            F.col("error").alias(f"{option_type}_error"),
            F.lit(True).alias(f"{option_type}_found"),
        )
        unknown = F.concat(F.lit(f'{option_type}Config with id "'), F.col(f"{option_type}_id"), F.lit('" not found'))
        workspaces = workspaces.join(part, ["kind", f"{option_type}_id"], "left").withColumn(
            f"{option_type}_error",
            F.when(F.col(f"{option_type}_found").isNull(), unknown).otherwise(F.col(f"{option_type}_error")),
        ).drop(f"{option_type}_found")
    return workspaces


def pending_restart(resolved: DataFrame) -> DataFrame:
    """True when either option resolves to another one."""
    pending = F.coalesce(F.col("image_steps") > 0, F.lit(False)) | F.coalesce(F.col("pod_steps") > 0, F.lit(False))
    differs = F.coalesce(F.col("desired_image") != F.col("image_id"), F.lit(False)) | F.coalesce(
        F.col("desired_pod") != F.col("pod_id"), F.lit(False)
    )
    return resolved.withColumn("pending_restart", pending & differs)
