"""Column helpers: quantities, text filters, labels, small columns."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetloom.functions import columns as K
from fleetloom.functions import labels as L
from fleetloom.functions import quantities as Q
from fleetloom.functions import text as X
from fleetloom.functions.chunked import with_previous
from fleetloom.operators.audits import mount_path_audit, resource_audit, resource_class
from fleetloom.operators.views import merge_env


def one(spark, value, make):
    return make(spark.createDataFrame([(value,)], "v string")).first()


@pytest.mark.parametrize(
    "text, units, amount, unit, unknown",
    [
        ("", Q.CPU_UNITS, None, "", False),
        ("m", Q.CPU_UNITS, None, "m", False),
        ("100m", Q.CPU_UNITS, 100, "m", False),
        ("1.5", Q.CPU_UNITS, 1.5, "", False),
        ("abc", Q.CPU_UNITS, 1, "", False),
        ("1.5unit", Q.CPU_UNITS, 1.5, "", True),
        ("0.1.5", Q.CPU_UNITS, 0.1, "", True),
        (".", Q.CPU_UNITS, None, "", True),
        ("1k", Q.MEMORY_UNITS, 1, "E", True),
        ("2Gi", Q.MEMORY_UNITS, 2, "Gi", False),
    ],
)
def test_display_quantity(spark, text, units, amount, unit, unknown):
    row = one(spark, text, lambda df: Q.with_display_quantity(df, "v", units, "q"))
    assert (None if row.q_amount is None else float(row.q_amount)) == amount
    if text != ".":
        assert row.q_unit == unit and row.q_unknown is unknown


@pytest.mark.parametrize(
    "text, value, unit", [("2308487n", 2.308487, "m"), ("1499177218n", 1.499177218, ""), ("1000000000n", 1.0, ""), ("50m", 50.0, "m")]
)
def test_display_cpu(spark, text, value, unit):
    row = one(spark, text, lambda df: Q.with_display_cpu(df, "v", "c"))
    assert (row.c_value, row.c_unit) == (value, unit)


def test_convert(spark):
    row = one(spark, "1.5Gi", lambda df: Q.with_converted(df, "v", Q.MEMORY_UNITS, "Mi", "a"))
    assert (row.a_value, row.a_unit) == (1536.0, "Mi")
    row = one(spark, "1.5Gi", lambda df: Q.with_converted(df, "v", Q.MEMORY_UNITS, "bushel", "a"))
    assert (row.a_value, row.a_unit) == (1.5, "Gi")


@pytest.mark.parametrize(
    "text, value",
    [
        ("1", "1"),
        ("-2", "-2"),
        ("+1.50", "1.5"),
        (".5", "0.5"),
        ("1e3", "1000"),
        ("1E", "1000000000000000000"),
        ("5n", "0.000000005"),
        ("15.9Ei", "18331451923248866918.4"),
        ("1Ki", "1024"),
        ("1.5Mi", "1572864"),
        ("1ki", None),
        ("", None),
        ("1.2.3", None),
        ("e3", None),
    ],
)
def test_exact_quantity(spark, text, value):
    from decimal import Decimal

    row = one(spark, text, lambda df: Q.with_exact_quantity(df, "v", "q"))
    assert row.q_value == (None if value is None else Decimal(value)) and row.q_beyond is False


@pytest.mark.parametrize("text", ["0.5n", "1e40", "0.0000000001"])
def test_beyond_exact(spark, text):
    assert one(spark, text, lambda df: Q.with_exact_quantity(df, "v", "q")).q_beyond is True


def test_compare(spark):
    df = spark.createDataFrame(
        [(0, "1", "1000m"), (1, "2", "1000m"), (2, "", None), (3, "1", None), (4, "500m", "1")], "i int, a string, b string"
    )
    out = Q.with_comparison(df, "a", "b", Q.CPU_UNITS, "c").select(
        "i", "c_equal", Q.limit_larger("b", "a", "c"), Q.limit_larger("b", "a", "c", True)
    )
    assert rows(out) == [
        (0, True, False, True),
        (1, False, True, True),
        (2, True, False, False),
        (3, False, False, False),
        (4, False, False, False),
    ]


@pytest.mark.parametrize("text, count", [(None, 0.0), ("", 0.0), ("0", 0.0), ("2", 2.0), ("tesla", 1.0), (".", 0.0), ("3x", 3.0)])
def test_gpu_count(spark, text, count):
    assert one(spark, text, lambda df: df.select(Q.gpu_count(F.col("v"))))[0] == count


def test_text_filter(spark):
    df = spark.createDataFrame([("Alpha-1", "x"), ("beta 2", "y"), ("g(amma", "x")], "name string, kind string")
    found = lambda patterns: [row[0] for row in rows(X.text_filter(df, patterns), "name")]
    assert found({"name": "ALPHA"}) == ["Alpha-1"]
    assert found({"name": "^b.*\\d$"}) == ["beta 2"]
    assert found({"name": "(am"}) == ["g(amma"]
    assert found({"name": "a", "kind": "x"}) == ["Alpha-1", "g(amma"]
    # what is a regex tells the engine that searches, not another one
    assert found({"name": r"^\p{L}+-"}) == ["Alpha-1"]
    other = spark.createDataFrame([("x(?P<a>a)y",), ("a",), (r"end\E",)], "name string")
    assert rows(X.text_filter(other, {"name": "(?P<a>a)"})) == [("x(?P<a>a)y",)]
    assert rows(X.text_filter(other, {"name": "*d\\E"})) == rows(other.filter("false"))
    assert rows(X.text_filter(other, {"name": "d\\E("})) == []
    assert found({"name": ""}) == ["Alpha-1", "beta 2", "g(amma"]
    assert found({"name": " "}) == ["beta 2"]
    assert rows(X.multiselect(df, {"kind": ["X"], "name": ["ALPHA-1", "none"]}), "name") == [("Alpha-1",)]


def test_label_maps(spark):
    df = spark.createDataFrame(
        [([("a", "1"), ("b", "2"), ("a", "3")],), ([],), (None,)], "labels array<struct<key:string,value:string>>"
    )
    got = [row[0] for row in df.select(L.labels_map(F.col("labels"))).collect()]
    assert got == [{"a": "3", "b": "2"}, {}, {}]
    assert df.select(L.first_label(F.col("labels"), "a")).first()[0] == "1"


def test_merge_env_keeps_positions(spark):
    schema = "b array<struct<name:string,value:string>>, o array<struct<name:string,value:string>>"
    df = spark.createDataFrame(
        [([("A", "1"), ("B", "2"), ("A", "3")], [("N", "1"), ("A", "x"), ("N", "2"), ("B", "y")]), (None, None)], schema
    )
    got = [[tuple(e) for e in row[0]] for row in df.select(merge_env(F.col("b"), F.col("o"))).collect()]
    assert got == [[("A", "1"), ("B", "y"), ("A", "x"), ("N", "2")], []]


def test_stamps(spark):
    df = spark.createDataFrame([({"fleet/updated-at": "t", "x": "1"}, "ann"), (None, None)], "a map<string,string>, actor string")
    created = [row[0] for row in df.select(K.stamp_create(F.col("a"), F.col("actor"))).collect()]
    assert created == [{"fleet/updated-at": "t", "x": "1", "fleet/created-by": "ann", "fleet/updated-by": "ann"}, {}]
    updated = [row[0] for row in df.select(K.stamp_update(F.col("a"), F.col("actor"), F.lit("n"))).collect()]
    assert updated == [{"fleet/updated-at": "n", "x": "1", "fleet/updated-by": "ann"}, {"fleet/updated-at": "n"}]


def test_resource_audit(spark):
    entries = [
        ("ok", "cpu", "500m", "1"),
        ("over", "memory", "2Gi", "1Gi"),
        ("neg", "cpu", "-1", None),
        ("half", "example.com/gpu", "1.5", "1.5"),
        ("uneq", "example.com/gpu", "1", "2"),
        ("page", "hugepages-2Mi", "3Mi", "3Mi"),
        ("size", "hugepages-x", None, None),
        ("name", "gpu", "1", "1"),
        ("none", "", "x", "y"),
        ("void", None, "x", "y"),
        ("text", "cpu", "", "1.2.3"),
        ("long", "hugepages-" + "0" * 64 + "2Mi", "4Mi", "4Mi"),
        ("big", "memory", "9e30", "8e30"),
    ]
    df = spark.createDataFrame(entries, "object string, type string, request string, limit string")
    got = rows(resource_audit(df, ["object"]), "object", "field", "code")
    assert got == [
        ("big", "limit", "beyond"),
        ("big", "request", "beyond"),
        ("half", "limit", "fractional"),
        ("half", "request", "fractional"),
        ("name", "type", "unknown_type"),
        ("neg", "request", "negative"),
        ("over", "request", "above_limit"),
        ("page", "limit", "not_in_pages"),
        ("page", "request", "not_in_pages"),
        ("size", "type", "bad_page_size"),
        ("text", "limit", "malformed"),
        ("uneq", "request", "differs_from_limit"),
    ]
    names = spark.createDataFrame([("example.com/gpu",), ("a/b/c",), ("kubernetes.io/x",), ("Ex.com/x",), ("cpu",)], "t string")
    edges = {
        "x.kubernetes.io/a": False,
        "requests.x/a": False,
        "x/a\n": False,
        "x/": False,
        "/a": False,
        "a" * 244 + "/b": True,
        "a" * 245 + "/b": False,
        "x/" + "b" * 63: True,
        "x/" + "b" * 64: False,
        "x.y-z/B_c.d": True,
    }
    got = spark.createDataFrame([(t,) for t in edges], "t string").select("t", resource_class(F.col("t")))
    assert {t: kind == "extended" for t, kind in got.collect()} == edges
    classes = dict(rows(names.select("t", resource_class(F.col("t")))))
    assert [classes[t] for t in ("example.com/gpu", "a/b/c", "kubernetes.io/x", "Ex.com/x", "cpu")] == [
        "extended",
        "unsupported",
        "unsupported",
        "unsupported",
        "plain",
    ]


def test_mount_paths(spark):
    data = [("a", "/data"), ("a", " /data/ "), ("b", "/"), ("b", "rel"), ("c", "/ok"), ("d", ""), ("e", "/" + "x" * 4096)]
    df = spark.createDataFrame(
        [("n", w, "data", "t", p) for w, p in data],
        "namespace string, workspace string, source string, target string, mount_path string",
    )
    assert rows(mount_path_audit(df), "workspace", "code") == [
        ("a", "in_use"),
        ("a", "in_use"),
        ("b", "not_absolute"),
        ("b", "too_short"),
        ("d", "empty"),
        ("e", "too_long"),
    ]


def test_quantities_beyond_a_long_are_exact_or_flagged(spark):
    huge = "1" + "0" * 20 + "Ki"
    row = one(spark, huge, lambda df: Q.with_converted(df, "v", Q.MEMORY_UNITS, "Gi", "a"))
    assert (row.a_value, row.a_beyond) == (1e20 / 1024**2, False)
    row = one(spark, "9" * 30 + "Gi", lambda df: Q.with_converted(df, "v", Q.MEMORY_UNITS, "Gi", "a"))
    assert (row.a_value, row.a_beyond) == (None, True)
    row = one(spark, "0.0000000001", lambda df: Q.with_display_quantity(df, "v", Q.CPU_UNITS, "q"))
    assert row.q_beyond is True
    row = one(spark, "0" * 50 + "7Mi", lambda df: Q.with_display_quantity(df, "v", Q.MEMORY_UNITS, "q"))
    assert (int(row.q_base), row.q_beyond) == (7 * 1024**2, False)
    pairs = [(huge, "1Ki"), ("9" * 20 + "Gi", "8" * 20 + "Gi"), ("9" * 30 + "Gi", "8" * 30 + "Gi"), ("9" * 30, "9" * 30)]
    df = spark.createDataFrame(pairs, "l string, r string")
    got = Q.with_comparison(df, "l", "r", Q.MEMORY_UNITS, "c").select(
        "c_equal", "c_beyond", Q.limit_larger("r", "l", "c"), Q.limit_larger("r", "l", "c", True)
    )
    assert [tuple(r) for r in got.collect()] == [
        (False, False, True, True),
        (None, True, None, None),
        (None, True, None, None),
        (True, True, False, True),
    ]


def test_exact_quantity_reads_the_whole_suffix(spark):
    long_exponent = "1e" + "0" * 23 + "5"
    df = spark.createDataFrame([(long_exponent,), ("1e5",), ("2Mi",)], "q string")
    got = Q.with_exact_quantity(df, "q", "x").select("q", F.col("x_value").cast("long"), "x_beyond").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {long_exponent: (100000, False), "1e5": (100000, False), "2Mi": (2097152, False)}


def test_previous_row_keeps_null_keys_and_times(spark):
    data = [("a", 1), ("a", 2), (None, 3), (None, 5), ("b", None)]
    df = spark.createDataFrame(data, "k string, t long")
    got = with_previous(df, ["k"], ["t"], ["t"]).select("k", "t", F.col("prev.t"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1, None), ("a", 2, 1), (None, 3, None), (None, 5, 3), ("b", None, None)], key=repr)


def test_known_and_stored_label_syntax_agree(spark):
    keys = ["a", "bad key!", "x/y", "X/y", "a/b/c", "", "/a", "a/", "a" * 64, "p.q/r_s", "-a", "a-"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for row in df.select("k", L.valid_label_key(F.col("k")), L.valid_label_value(F.col("k"))).collect():
        assert (L.is_label_key(row[0]), L.is_label_value(row[0])) == (row[1], row[2]), row[0]
