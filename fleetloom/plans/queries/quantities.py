"""Quantity normalisation as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import quantities as Q
from fleetloom.functions.labels import first_label
from fleetloom.operators.joins import with_current_option
from fleetloom.plans.bindings import Fleet
from fleetloom.plans.registry import query

# the display rule over doubles, written for the shapes the binding produces
_PARTS = """regexp_extract({c}, '^(\\d*\\.?\\d*)(.*)$', 1) as {c}_digits,
    regexp_extract({c}, '^(\\d*\\.?\\d*)(.*)$', 2) as {c}_suffix"""
_SAMPLE = f"""p as (select namespace, pod, container, ts_ms, seq, cpu, memory, {_PARTS.format(c="cpu")},
      {_PARTS.format(c="memory")} from usage_samples),
    q as (select *,
      case when cpu = '' then null else cast(cpu_digits as double) end as cpu_amount,
      case cpu_suffix when 'm' then 1000000.0 when 'n' then 1.0 else 1000000000.0 end as cpu_weight,
      case when memory = 'Mi' or memory_digits = '.' then null when memory_digits = '' then 1.0
        else cast(memory_digits as double) end as memory_amount,
      case when memory = 'Mi' then 'Mi' when memory_digits = '' then 'E' when memory_suffix in ('Gi', 'Mi', '')
        then memory_suffix else 'E' end as memory_unit from p),
    w as (select *, case memory_unit when 'E' then 1e18 when 'Gi' then 1073741824.0 when 'Mi' then 1048576.0
      else 1.0 end as memory_weight from q)"""


@query(
    "normalise_quantities",
    f"""with {_SAMPLE} select namespace, pod, container, ts_ms, seq, cpu, memory, cpu_amount, cpu_suffix as cpu_unit,
      cpu_amount * cpu_weight as cpu_base, memory_amount, memory_unit, memory_amount * memory_weight as memory_base,
      memory <> 'Mi' and memory_digits <> '' and memory_suffix not in ('Gi', 'Mi', '') as memory_unknown,
      false as cpu_beyond, false as memory_beyond from w""",
)
def _normalise(t: Fleet) -> DataFrame:
    rows = t.usage_samples.drop("ts")
    rows = Q.with_display_quantity(rows, "cpu", Q.CPU_UNITS, "cpu")
    rows = Q.with_display_quantity(rows, "memory", Q.MEMORY_UNITS, "memory").drop("cpu_unknown")
    numbers = ("cpu_amount", "cpu_base", "memory_amount", "memory_base")
    return rows.withColumns({name: F.col(name).cast("double") for name in numbers})


@query(
    "convert_units",
    f"""with {_SAMPLE} select namespace, pod, container, ts_ms, seq, memory,
      coalesce(memory_amount, 0) * memory_weight / 1048576.0 as mib, coalesce(memory_amount, 0) as unchanged,
      memory_unit as unchanged_unit,
      case when cpu_suffix = 'n' and cpu_amount >= 1e9 then cpu_amount / 1e9 when cpu_suffix = 'n'
        then cpu_amount / 1e6 else cpu_amount end as cpu_shown,
      case when cpu_suffix = 'n' and cpu_amount >= 1e9 then '' when cpu_suffix = 'n' then 'm' else cpu_suffix end
        as cpu_shown_unit from w""",
)
def _convert(t: Fleet) -> DataFrame:
    rows = t.usage_samples.drop("ts")
    rows = Q.with_converted(rows, "memory", Q.MEMORY_UNITS, "Mi", "mib")
    rows = Q.with_converted(rows, "memory", Q.MEMORY_UNITS, "bushel", "unchanged")
    rows = Q.with_display_cpu(rows, "cpu", "shown").drop("cpu", "mib_unit")
    rows = rows.drop("mib_beyond", "unchanged_beyond", "shown_beyond")
    return rows.withColumnsRenamed(
        {
            "mib_value": "mib",
            "unchanged_value": "unchanged",
            "shown_value": "cpu_shown",
            "shown_unit": "cpu_shown_unit",
        }
    )


@query(
    "wide_quantities",
    """with w as (select object, regexp_extract(request, '[0-9]+') as n from resource_entries
      where regexp_matches(request, '^[0-9]+'))
    select object, cast(cast(n as hugeint) * 1024 * cast('1000000000000000000000' as hugeint) as double) as wide_bytes,
      false as wide_beyond, true as far_beyond, cast(null as double) as far_gib, false as wide_at_limit,
      true as same_text from w""",
)
def _wide(t: Fleet) -> DataFrame:
    """Quantities of more digits than a long holds: exact while a decimal can hold them, else flagged."""
    digits = F.regexp_extract("request", "[0-9]+", 0)
    rows = t.view("resource_entries").filter(F.col("request").rlike("^[0-9]+")).select(
        "object",
        F.concat(digits, F.lit("0" * 21 + "Ki")).alias("wide"),
        F.concat(digits, F.lit("0" * 30 + "Gi")).alias("far"),
    )
    rows = Q.with_display_quantity(rows, "wide", Q.MEMORY_UNITS, "wide")
    rows = Q.with_converted(rows, "far", Q.MEMORY_UNITS, "Gi", "far")
    rows = Q.with_comparison(rows.withColumn("small", F.lit("1Ki")), "small", "wide", Q.MEMORY_UNITS, "cmp")
    rows = rows.withColumn("copy", F.col("far"))
    larger = Q.limit_larger("wide", "small", "cmp")
    rows = Q.with_comparison(rows.withColumn("wide_at_limit", larger), "far", "copy", Q.MEMORY_UNITS, "twin")
    return rows.select(
        "object",
        F.col("wide_base").cast("double").alias("wide_bytes"),
        "wide_beyond",
        "far_beyond",
        F.col("far_value").alias("far_gib"),
        "wide_at_limit",
        F.col("twin_equal").alias("same_text"),
    )


@query(
    "exact_quantities",
    """select object, request, case when request in ('', '1.2.3') then null
      when ends_with(request, 'm') then cast(cast(rtrim(request, 'm') as bigint) as double) / 1000
      when ends_with(request, 'e3') then cast(regexp_extract(request, '[0-9]+') as bigint) * 1000.0
      when ends_with(request, 'Mi') then cast(regexp_extract(request, '[0-9]+') as bigint) * 1048576.0
      else cast(request as double) end as amount, false as beyond from resource_entries""",
)
def _exact(t: Fleet) -> DataFrame:
    rows = Q.with_exact_quantity(t.view("resource_entries").select("object", "request"), "request", "q")
    return rows.select("object", "request", F.col("q_value").cast("double").alias("amount"), F.col("q_beyond").alias("beyond"))


@query(
    "compare_quantities",
    """with b as (select namespace, name, cpu_request, cpu_limit, memory_request, memory_limit,
      cast(rtrim(cpu_request, 'm') as bigint) as r, cast(cpu_limit as bigint) * 1000 as l,
      cast(replace(memory_request, 'Mi', '') as bigint) as mr, cast(replace(memory_limit, 'Gi', '') as bigint) * 1024 as ml
      from pods)
    select namespace, name, coalesce(r = l, false) as cpu_equal, coalesce(l > r, false) as cpu_limit_larger,
      coalesce(mr = ml, false) as memory_equal, coalesce(ml >= mr, false) as memory_limit_enough from b""",
)
def _compare(t: Fleet) -> DataFrame:
    rows = Q.with_comparison(t.view("pods"), "cpu_limit", "cpu_request", Q.CPU_UNITS, "cpu")
    rows = Q.with_comparison(rows, "memory_limit", "memory_request", Q.MEMORY_UNITS, "memory")
    return rows.select(
        "namespace",
        "name",
        "cpu_equal",
        Q.limit_larger("cpu_request", "cpu_limit", "cpu").alias("cpu_limit_larger"),
        "memory_equal",
        Q.limit_larger("memory_request", "memory_limit", "memory", True).alias("memory_limit_enough"),
    )


@query(
    "gpu_count",
    """select namespace, name, cast(case gpu_label when '2' then 2 when 'tesla' then 1 else 0 end as double) as gpus
    from ws_options""",
)
def _gpu_count(t: Fleet) -> DataFrame:
    joined = with_current_option(
        t.workspaces.select("namespace", "name", "kind", "image_id", "pod_id"),
        t.options.select("kind", "option_type", "id", "labels"),
    )
    return joined.select("namespace", "name", Q.gpu_count(first_label(F.col("pod_opt_labels"), "gpu")).alias("gpus"))
