"""Selection by histograms against sorting."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlab.operators import select as S
from flowlab.operators import split as SP


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_bins(monkeypatch):
    monkeypatch.setattr(S, "BINS", 16)
    monkeypatch.setattr(S, "EDGE_ROWS", 3)


def key(v):
    """Nulls first, NaN last."""
    return (0,) if v is None else (2,) if isinstance(v, float) and math.isnan(v) else (1, v)


DAY = dt.date(2024, 1, 1)
VALUES = {
    "long": [None, -2 ** 63, 2 ** 63 - 1, 0, 1, 2, -1, 2 ** 40, -2 ** 40, 7],
    "int": [None, -5, 3, 3, 2, 1, 0],
    "double": [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e308, -1e308, 5e-324, 1.5, -2.25],
    "string": [None, "", "a", "ab", "abcd", "abcde", "abcdf", "b", "é", "zz", "a\x00", "日本"],
    "binary": [None, b"", b"\x00", b"\x00\x00", b"\xff", b"ab"],
    "date": [None, DAY, DAY + dt.timedelta(9), dt.date(1960, 5, 5)],
    "timestamp": [None, dt.datetime(2024, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 1, 1, 0, 0, 1)],
    "boolean": [None, True, False],
    "decimal(12,2)": [None, *[__import__("decimal").Decimal(x) for x in ("1.10", "-1.10", "0.00", "99999.99")]],
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_first_rows_of_every_type(spark, small_bins, kind):
    rng = random.Random(kind)
    rows = [(rng.choice(VALUES[kind]), i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, f"k {kind}, v int").repartition(4)
    for n in (0, 13, 59, 60):
        got = S.first_rows(df, ["k"], n).collect()
        want = sorted((key(k if k is None or kind != "string" else k.encode()) for k, _ in rows))[:n]
        have = sorted(key(r["k"] if not isinstance(r["k"], (str, bytearray)) else r["k"].encode() if isinstance(
            r["k"], str) else bytes(r["k"])) for r in got)
        assert have == want


def test_several_columns_and_equal_rows(spark, small_bins):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["a", "b", None]), rng.choice([0.0, 1.0])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(5)
    order = sorted(((key(a), key(b)) for a, b, _ in rows))
    for n in (5, 133):
        got = S.first_rows(df, ["a", "b"], n).collect()
        assert sorted((key(r["a"]), key(r["b"])) for r in got) == order[:n]
        again = S.first_rows(df.repartition(2), ["a", "b"], n).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))            # ties by content, not by layout


def test_two_million_rows_with_nine_tenths_tied(spark):
    df = spark.range(2_000_000, numPartitions=16).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(77)).alias("k"), "id")
    found = S.first_rows(df, ["k"], 1_000_000)
    assert "Window" not in plan_of(found) and "Sort" not in plan_of(found)
    seen = found.agg(F.count("*"), F.sum((F.col("k") < 77).cast("int")), F.max("k"), F.countDistinct("id")).first()
    assert tuple(seen) == (1_000_000, 8, 77, 1_000_000)


def test_equal_rows_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    df = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.lit("x").alias("t"))
    found = S.first_rows(df, ["k"], 37_000)
    assert found.groupBy("k").count().orderBy("k").collect() == [(0, 25_000), (1, 12_000)]


def test_unsupported_type(spark):
    df = spark.createDataFrame([([1],), ([2],)], "k array<int>")
    with pytest.raises(TypeError):
        S.first_rows(df, ["k"], 1)


@pytest.mark.parametrize("tied", [0.0, 0.9, 1.0])
def test_groups(spark, small_bins, tied):
    rng = random.Random(9)
    rows = [(rng.choice(["g", "h", None]), 0.5 if rng.random() < tied else rng.random(), rng.choice([1, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, v int").repartition(3)
    need = spark.createDataFrame([("g", 40), ("h", 0), (None, 10 ** 6)], "g string, need long")
    got = S.mark_first(df, "x", ["g"], need, "hit").collect()
    assert sorted(map(str, ((r["g"], r["x"], r["v"]) for r in got))) == sorted(map(str, rows))
    for g, n in (("g", 40), ("h", 0), (None, 10 ** 6)):
        values = sorted(x for a, x, _ in rows if a == g)
        assert sorted(r["x"] for r in got if r["g"] == g and r["hit"]) == values[:n]


def test_split_has_no_window_over_rows(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    plan = plan_of(SP.stratified_split(df, ["id"], "s"))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_split_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 0)] * 700 + [(2, "a", 0)] * 300 + [(3, "b", i) for i in range(100)], "k int, s string, v int")
    got = SP.stratified_split(df, ["k"], "s").groupBy("s", "split").count().collect()
    assert {(r["s"], r["split"]): r["count"] for r in got} == {
        ("a", "test"): 200, ("a", "train"): 800, ("b", "test"): 20, ("b", "train"): 80}
