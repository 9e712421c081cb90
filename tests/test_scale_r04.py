"""Whole runs store rows once, as they came, and what their views are drawn from."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import content_id as CI
from flowlab.operators import models as MO
from flowlab.operators import rounds as RO
from flowlab.operators import split as SP
from flowlab.plans import pipelines as PL
from flowlab.plans import q_pipeline as QP
from flowlab.session import shuffles_dropped
from flowlab.sources import flows as SRC


def test_a_run_stores_no_ids_embeddings_or_views(spark, tmp_path):
    """32 bytes of numbers a row; ids, embeddings and the views of three epochs took more than ten times that."""
    n = 6000
    df = SRC.synthetic_flows(spark, n, 4)
    df = df.select(*[F.col(f"Feature_{i}").cast("double").alias(f"Feature_{i}") for i in range(4)],
                   F.when(F.col("Label") == "Benign", "normal").otherwise("attack").alias("Label"),
                   F.when(F.col("Label") == "DoS", "dos").otherwise("normal").alias("AttackCategory"))
    PL.run_pipeline(df, df, str(tmp_path / "out"), ["intrusion", "dos"], ssl_epochs=1, task_epochs=3, embed_dim=4)
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "out") for f in names
               if f.endswith(".parquet") and d[len(str(tmp_path / "out")) + 1:].startswith(("features-", "embeddings-", "views-")))
    assert held / (2 * n) < 150


def test_ids_of_numbered_rows_are_the_content_ids(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.5), (1, "a", 0.5), (2, None, None), (2, None, None), (None, "", -0.0), (None, "", 0.0)]
    df = spark.createDataFrame(rows, "`k.x` int, s string, v double").withColumn("void", F.lit(None))
    want = sorted(tuple(r) for r in CI.content_ids(df, "id", "").select("id").collect())
    stored = CI.numbered_rows(df, "n").drop("void")
    got = sorted(tuple(r) for r in stored.select(CI.numbered_id(df, "n", "").alias("id")).collect())
    assert got == want and len(set(got)) == 7


def test_batch_numbers_are_those_of_batches(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("a.b"))
    want = {r["k"]: r["batch_id"] for r in SP.batches(df.select("k"), ["k"], 64).collect()}
    got = {r["k"]: r["n"] for r in SP.batch_numbers(df, F.col("k"), 64, "n").collect()}
    assert len(got) == 1000 and {k: n for k, n in got.items() if n is not None} == want
    assert sum(n is None for n in got.values()) == 1000 % 64
    assert SP.batch_numbers(df.limit(10), F.col("k"), 64, "n").where("n IS NULL").count() == 10


@pytest.mark.parametrize("dim", [1, 3])
def test_packed_features_step_like_views_of_embeddings(spark, dim):
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", v.tolist(), [0, 1, None, 2][i % 4]) for i, v in enumerate(rng.normal(size=(60, 5)))]
    df = spark.createDataFrame(rows, "id string, v array<double>, y int").repartition(3)
    enc = [{"W": rng.normal(size=(5, dim)), "b": rng.normal(size=dim), "act": None}]
    w, weights = rng.normal(size=dim).tolist(), {0: 0.5, 1: 2.0}
    z = MO.apply_nets(df, "v", {}, ["id", "y"], encoder=enc)
    views = RO.fixmatch_views(z, "embedding", "id", 1, 9).where("y IN (0, 1)").withColumn("weight", F.when(F.col("y") == 1, 2.0).otherwise(0.5))
    a = RO.fixmatch_step(views, w, 0.2, 1.0)
    b = RO.fixmatch_step(RO.packed_views(df, "v", "id", ["y"], 0, 9), w, 0.2, 1.0, weights, enc)
    assert np.allclose(a.pop("gradient"), b.pop("gradient")) and a == pytest.approx(b)


def test_epochs_are_asked_for_one_after_the_other(spark):
    rows = [(f"r{i}", [float(i % 5), float(i % 3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, z array<double>, y int").withColumn("weight", F.lit(1.0))
    whole, asked = RO.fixmatch_views(df, "z", "id", 3, 1).cache(), []
    want = RO.train_fixmatch(whole, 2, steps=2)
    got = RO.train_fixmatch(lambda e: asked.append(e) or RO.packed_views(df, "z", "id", ["y"], e, 1), 2, steps=2,
                            class_weights={0: 1.0, 1: 1.0}, epochs=3)
    assert asked == [0, 1, 2] and np.allclose(got[0], want[0]) and got[1] == pytest.approx(want[1])
    assert [h["epoch"] for h in got[2]] == [0, 1, 2]
    whole.unpersist()


def test_dropped_shuffles_leave_the_session_as_it_was(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        spark.range(100).groupBy(F.col("id") % 7).count().write.parquet(str(tmp_path / "t"))
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before and spark.read.parquet(str(tmp_path / "t")).count() == 7

def test_captures_of_a_pair_are_written_compressed(spark, tmp_path, monkeypatch):
    """text took more room than all the tables a run keeps of it."""
    rows = [(i, 1 + i % 2, float(i % 50), i * 1.25, 0.05, 0.02, "RAN"[i % 3], "FO"[i % 2]) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    given = []
    monkeypatch.setattr(PL, "run_csv_pair", lambda spark, *paths, **k: given.extend(paths[:2]))
    monkeypatch.setattr(QP, "_evaluated", lambda spark, out: None)
    QP.q_csv_pair_run(spark, str(tmp_path))
    for path, rest in zip(given, (1, 0)):
        files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
        assert files and all(f.endswith(".csv.gz") for f in files)
        got = PL.labelled_csv(spark, path)
        assert got.count() == 150 and got.select("l_linenumber").distinct().first()[0] % 2 == rest
        assert dict(got.dtypes)["l_extendedprice"] == "double" and got.where("l_discount <> 0.05").isEmpty()


def test_a_stored_capture_leaves_the_session_fit_for_models(spark, tmp_path):
    """An Observation of the session can't be serialized, and models take the session along."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/part.csv").write_text("a,label\n" + "".join(f"{i},{i % 2}\n" for i in range(20)))
    got = SRC.store_headered_csv(spark, str(tmp_path / "in"), str(tmp_path / "t"), "label")
    assert got.columns == ["a", "label"] and got.count() == 20
    df = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(60)], "id long, v array<double>, y int")
    _, history = RO.train_head_rounds(df.where("id < 20"), df.where("id >= 20"), "v", "y", "id", rounds=2)
    assert [h["round"] for h in history] == [0, 1]
