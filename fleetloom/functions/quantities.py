"""Resource quantities ("500m", "2Gi", "1") as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (unit, weight) in lookup order; an unknown unit falls back to the first of its list.
CPU_UNITS = (("", 1000**3), ("m", 1000**2), ("n", 1))
MEMORY_UNITS = (
    ("E", 1000**6),
    ("Ei", 1024**6),
    ("P", 1000**5),
    ("Pi", 1024**5),
    ("T", 1000**4),
    ("Ti", 1024**4),
    ("G", 1000**3),
    ("Gi", 1024**3),
    ("M", 1000**2),
    ("Mi", 1024**2),
    ("K", 1000),
    ("Ki", 1024),
    ("", 1),
)
COUNT_UNITS = (("", 1),)

# Strict quantity syntax and its decimal exponents.
STRICT_PATTERN = r"^([+-]?)(\d+(?:\.\d*)?|\.\d+)([eE][+-]?\d+|[numkKMGTPE]|[KMGTPE]i)?$"
DECIMAL_EXPONENTS = {"": 0, "n": -9, "u": -6, "m": -3, "k": 3, "K": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18}
BINARY_POWERS = {"Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5, "Ei": 6}

AMOUNT = "decimal(38,9)"

# The jobs below add their columns in steps. A step that several later expressions read stays a projection of its
# own, so each regular expression runs once per row and the generated code stays small.


def _literal_map(pairs, kind: str) -> Column:
    return F.create_map(*[part for key, value in pairs for part in (F.lit(key), F.lit(value).cast(kind))])


def _fraction_digits(number: str) -> Column:
    """Significant digits after the point of digit text."""
    fraction = F.when(F.instr(number, ".") > 0, F.substring_index(number, ".", -1)).otherwise(F.lit(""))
    return F.length(F.rtrim(fraction, F.lit("0")))


def _with_product(df: DataFrame, number: str, weight: str, out: str) -> DataFrame:
    """Exact ``number * weight`` of digit text as decimal(38,9), null where that type cannot hold it.

    Short whole numbers are multiplied as longs. Otherwise the whole and the fractional part are multiplied apart,
    because one wide decimal product would lose digits. A fraction of more than nine digits is not exact here:
    the callers flag it with :func:`_fraction_digits`.
    """
    whole = F.ltrim(F.substring_index(number, ".", 1), F.lit("0"))
    fraction = F.when(F.instr(number, ".") > 0, F.substring_index(number, ".", -1)).otherwise(F.lit(""))
    short = (F.instr(number, ".") == 0) & F.length(number).between(1, 9) & (F.col(weight) <= 1024**3)
    factor = F.col(weight).cast("decimal(19,0)")
    big = F.try_multiply(F.when(whole == "", "0").otherwise(whole).try_cast("decimal(38,0)"), factor)
    small = F.concat(F.lit("0."), fraction, F.lit("0")).try_cast("decimal(10,9)") * factor
    wide = F.try_add(big.try_cast(AMOUNT), small.try_cast("decimal(28,9)")).try_cast(AMOUNT)
    return df.withColumn(
        out,
        F.when(F.col(weight) == 1, F.col(number).try_cast(AMOUNT))
        .when(short, (F.col(number).cast("bigint") * F.col(weight)).cast(AMOUNT))
        .otherwise(wide),
    )


def with_display_quantity(df: DataFrame, column: str, units, prefix: str) -> DataFrame:
    """The lenient display rule; adds ``{prefix}_amount``, ``_unit``, ``_base``, ``_unknown`` and ``_beyond``.

    Text that is only a unit has no amount; text without digits counts as one of the first unit; an unknown unit
    falls back to the first unit of the list and is flagged. ``_base`` is the amount in the lowest unit.
    ``_beyond`` marks an amount that decimal(38,9) cannot hold exactly, in its unit or in the lowest one.
    """
    known = [unit for unit, _ in units]
    value, first = F.col(column), F.lit(known[0])
    digits, suffix, number, weight = (f"_{prefix}_{part}" for part in ("digits", "suffix", "number", "weight"))
    is_unit = value.isin(known)
    df = df.withColumn(digits, F.regexp_extract(value, r"^(\d*\.?\d*)", 1))
    df = df.withColumn(suffix, value.substr(F.length(digits) + 1, F.length(value)))
    named = F.col(suffix).isin(known)
    bare = F.col(digits) == ""
    df = df.withColumns(
        {
            number: F.when(is_unit, F.lit(None)).when(bare, F.lit("1")).when(F.col(digits) != ".", F.col(digits)),
            f"{prefix}_unit": F.when(is_unit, value)
            .when(bare, first)
            .when(named, F.col(suffix))
            .when(value.isNotNull(), first),
            f"{prefix}_unknown": value.isNotNull() & ~is_unit & ~bare & ~named,
        }
    )
    df = df.withColumns(
        {
            f"{prefix}_amount": F.col(number).try_cast(AMOUNT),
            weight: F.try_element_at(_literal_map(units, "bigint"), F.col(f"{prefix}_unit")),
        }
    )
    df = _with_product(df, number, weight, f"{prefix}_base")
    lost = F.col(f"{prefix}_amount").isNull() | F.col(f"{prefix}_base").isNull() | (_fraction_digits(number) > 9)
    beyond = F.col(number).isNotNull() & lost
    return df.withColumn(f"{prefix}_beyond", beyond).drop(digits, suffix, number, weight)


_DISPLAY = ("amount", "unit", "base", "unknown", "beyond")


def with_converted(df: DataFrame, column: str, units, target: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_value`` (double), ``_unit`` and ``_beyond``: in the target unit, or unchanged when it is unknown.

    Text without an amount counts as zero; an amount beyond the exact range has no value and is flagged.
    """
    parsed = with_display_quantity(df, column, units, f"_{prefix}")
    weights, beyond = dict(units), F.col(f"_{prefix}_beyond")
    source = "base" if target in weights else "amount"
    value = F.when(~beyond, F.coalesce(F.col(f"_{prefix}_{source}").cast("double"), F.lit(0.0)))
    if target in weights:
        value, unit = value / F.lit(float(weights[target])), F.lit(target)
    else:
        unit = F.col(f"_{prefix}_unit")
    return parsed.withColumns({f"{prefix}_value": value, f"{prefix}_unit": unit, f"{prefix}_beyond": beyond}).drop(
        *[f"_{prefix}_{part}" for part in _DISPLAY]
    )


def with_display_cpu(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_value``, ``_unit`` and ``_beyond``: nanocores become cores from one core up, else millicores."""
    parsed = with_display_quantity(df, column, CPU_UNITS, f"_{prefix}")
    beyond, unit = F.col(f"_{prefix}_beyond"), F.col(f"_{prefix}_unit")
    amount = F.when(~beyond, F.col(f"_{prefix}_amount").cast("double"))
    base = F.col(f"_{prefix}_base")
    nano = amount.isNotNull() & (unit == "n")
    cores = base >= F.lit(1000**3)
    exact = base.cast("double")
    return parsed.withColumns(
        {
            f"{prefix}_value": F.when(nano & cores, exact / F.lit(1e9)).when(nano, exact / F.lit(1e6)).otherwise(amount),
            f"{prefix}_unit": F.when(nano & cores, F.lit("")).when(nano, F.lit("m")).otherwise(unit),
            f"{prefix}_beyond": beyond,
        }
    ).drop(*[f"_{prefix}_{part}" for part in _DISPLAY])


def with_exact_quantity(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The strict rule; adds ``{prefix}_value`` in base units, null when malformed, and ``{prefix}_beyond``.

    ``_beyond`` marks well-formed text that decimal(38,9) cannot hold exactly: it is reported, never guessed.
    """
    value = F.col(column)
    sign, number, suffix, exponent, weight, scaled = (
        f"_{prefix}_{part}" for part in ("sign", "number", "suffix", "exponent", "weight", "scaled")
    )
    # one match gives the number; sign and suffix are what surrounds it
    df = df.withColumns({number: F.regexp_extract(value, STRICT_PATTERN, 2), sign: F.left(value, F.lit(1))})
    signed_length = F.when(F.col(sign).isin("+", "-"), 1).otherwise(0) + F.length(number)
    df = df.withColumn(suffix, F.when(F.col(number) != "", F.substr(value, signed_length + 1)))
    binary = [(unit, 1024**power) for unit, power in BINARY_POWERS.items()]
    df = df.withColumns(
        {
            exponent: F.coalesce(
                F.try_element_at(_literal_map(DECIMAL_EXPONENTS.items(), "int"), F.col(suffix)),
                # cast only what is a number: a failing try_cast costs an exception per row
                F.when(F.col(suffix).rlike(r"^[eE][+-]?\d+$"), F.substr(F.col(suffix), F.lit(2)).try_cast("int")),
            ),
            weight: F.try_element_at(_literal_map(binary, "bigint"), F.col(suffix)),
        }
    )
    df = _with_product(df, number, weight, scaled)
    scientific = F.concat(F.col(number), F.lit("E"), F.col(exponent).cast("string")).try_cast(AMOUNT)
    magnitude = F.when(F.col(weight).isNotNull(), F.col(scaled)).otherwise(scientific)
    signed = F.when(F.col(sign) == "-", -magnitude).otherwise(magnitude)
    too_fine = (_fraction_digits(number) - F.coalesce(exponent, F.lit(0))) > 9
    well_formed = F.coalesce(F.col(number) != "", F.lit(False))
    df = df.withColumn(f"{prefix}_value", F.when(well_formed, signed))
    beyond = well_formed & (F.col(f"{prefix}_value").isNull() | F.coalesce(too_fine, F.lit(False)))
    return df.withColumn(f"{prefix}_beyond", beyond).drop(sign, number, suffix, exponent, weight, scaled)


def _missing(value: Column) -> Column:
    return value.isNull() | (value == "")


def with_comparison(df: DataFrame, left: str, right: str, units, prefix: str) -> DataFrame:
    """Adds ``{prefix}_equal`` (both missing are equal, one missing is not), ``_delta``: left - right, and ``_beyond``.

    Text without an amount counts as zero. Where a side is beyond the exact range, ``_beyond`` is true and there is
    no delta; such values are equal only as the same text.
    """
    both = with_display_quantity(df, left, units, "_left")
    both = with_display_quantity(both, right, units, "_right")
    zero, beyond = F.lit(0).cast(AMOUNT), F.col("_left_beyond") | F.col("_right_beyond")
    delta = F.try_subtract(F.coalesce("_left_base", zero), F.coalesce("_right_base", zero)).try_cast(AMOUNT)
    a, b = _missing(F.col(left)), _missing(F.col(right))
    compared = both.withColumns({f"{prefix}_delta": F.when(~beyond, delta), f"{prefix}_beyond": beyond})
    same = F.col(left) == F.col(right)
    equal = F.when(a & b, F.lit(True)).when(a | b, F.lit(False)).when(same, F.lit(True))
    compared = compared.withColumn(f"{prefix}_equal", equal.otherwise(F.col(f"{prefix}_delta") == 0))
    return compared.drop(*[f"_{side}_{part}" for side in ("left", "right") for part in _DISPLAY])


def limit_larger(request: str, limit: str, prefix: str, or_equal: bool = False) -> Column:
    """Is the limit larger, from :func:`with_comparison` of (limit, request)? False when either is missing.

    Null where a side is beyond the exact range, unless equality of the texts decides.
    """
    delta = F.col(f"{prefix}_delta")
    larger = delta >= 0 if or_equal else delta > 0
    same = F.col(request) == F.col(limit)
    larger = F.when(same, F.lit(or_equal)).otherwise(larger)
    return F.when(_missing(F.col(request)) | _missing(F.col(limit)), F.lit(False)).otherwise(larger)


def gpu_count(label: Column) -> Column:
    """GPU label as a number: missing is 0, text without digits is 1."""
    digits = F.regexp_extract(label, r"^(\d*\.?\d*)", 1)
    count = F.when(_missing(label), F.lit(0.0)).when(digits == "", F.lit(1.0)).otherwise(digits.try_cast("double"))
    return F.coalesce(count, F.lit(0.0))
