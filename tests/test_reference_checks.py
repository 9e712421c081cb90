"""The reference's own unit checks, restated on the Spark operators."""
from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import augment as AU
from flowlab.operators import features as FT
from flowlab.sources import flows as SRC


def test_augmentations_keep_shape(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(80)]) for i in range(4)], "id long, x array<double>")
    out = df.select(F.size(AU.weak(F.col("x"), F.col("id"))).alias("a"),
                    F.size(AU.strong(F.col("x"), F.col("id"))).alias("b"),
                    F.size(AU.feature_mask(F.col("x"), F.col("id"))).alias("c")).collect()
    assert all((r["a"], r["b"], r["c"]) == (80, 80, 80) for r in out)


def test_anomaly_scores_in_unit_interval(spark):
    df = spark.createDataFrame([(float(e),) for e in [0.0, 0.2, 1.7, 50.0]], "err double")
    s = [r[0] for r in df.select(A.anomaly_score(F.col("err"), 1.0)).collect()]
    assert s == [0.0, 0.2, 1.0, 1.0]


def test_preprocessor_100_by_20(spark):
    df = SRC.synthetic_flows(spark, 100, 20)
    st = FT.fit(FT.clean(df.drop("id")), "Label")
    out = FT.transform(df, st, "Label").collect()
    assert len(out) == 100 and all(len(r["features"]) == 20 for r in out)


def test_label_leak_pruning_two_features(spark):
    rows = [(0.1 * i, 1.0 - 0.1 * i, "normal" if i % 2 else "attack", "x", "y") for i in range(4)]
    df = spark.createDataFrame(rows, "feature_a double, feature_b double, Label string, AttackLabel string, "
                                     "AttackCategory string")
    st = FT.fit(FT.clean(df), "Label")
    out = FT.transform(df, st, "Label").collect()
    assert st.columns == ["feature_a", "feature_b"] and len(out) == 4 and all(len(r["features"]) == 2 for r in out)


def test_synthetic_benchmark_end_to_end(spark):
    from flowlab.plans.pipelines import synthetic_benchmark
    out = tempfile.mkdtemp(prefix="flowlab-bench-", dir="/tmp")
    res = synthetic_benchmark(spark, out, n_train=600, n_test=200, n_features=8)
    assert set(res["f1"]) == {"intrusion", "dos", "port_scan"} and res["elapsed"] > 0
    assert all(0.0 <= v <= 1.0 for v in res["f1"].values())
    # the persisted state scores new flows without refitting anything
    from flowlab.plans.pipelines import score_flow_table
    flows = SRC.synthetic_flows(spark, 50, 8, seed=7).select(F.col("id").cast("string").alias("flow_id"),
                                                              *[f"Feature_{i}" for i in range(8)])
    alerts = score_flow_table(spark, flows, out).collect()
    assert len(alerts) == 50
    assert {a["attack_type"] for a in alerts} <= {None, "intrusion", "dos", "port_scan", "zero-day / unknown"}
    assert all(0.0 <= a["anomaly_score"] <= 1.0 and a["ts"] is not None for a in alerts)
    # the tables behind the plots
    from flowlab.plans.pipelines import REPORT_TABLES, report_tables
    tables = report_tables(spark, out)
    assert set(tables) == {"history", "metrics", "bases", "forgetting", *REPORT_TABLES}
    tasks = {"intrusion", "dos", "port_scan"}
    assert all({r["task"] for r in tables[t].select("task").distinct().collect()} == tasks for t in REPORT_TABLES)
    assert tables["sweep"].groupBy("task").count().where("count <> 50").count() == 0
    assert {r["n"] for r in tables["confusion"].groupBy("task").agg(F.sum("n").alias("n")).collect()} == {200}
    f1 = {r["task"]: r for r in tables["forgetting"].collect()}
    assert f1["dos"]["0"] == 0.0 and all(abs(f1[t]["2"] - res["f1"][t]) < 1e-9 for t in tasks)
