"""Content ids, sparse features, moments, forest, linear models, calibration, mixup."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import augment as AU
from flowlab.operators import calibrate as CA
from flowlab.operators import content_id as CI
from flowlab.operators import features as FT
from flowlab.operators import linear as LN
from flowlab.operators import models as MO
from flowlab.operators import rounds as RO
from flowlab.operators import select as S


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)


# ------------------------------------------------------------ content ids

ROWS = [("a", None, 1.5), ("a", None, 1.5), (None, "a", 1.5), (None, None, None), ("-", "-", 0.0), ("1:a", "|", float("nan")),
        ("a|", "1:-", 2.0), ("", "", None)]


def test_ids_are_unique_and_follow_content(spark, monkeypatch):
    df = spark.createDataFrame(ROWS * 3, "a string, b string, c double")
    ids = [CI.content_ids(df.repartition(n), "id").collect() for n in (1, 7)]
    assert sorted(map(str, ids[0])) == sorted(map(str, ids[1])) and len({r["id"] for r in ids[0]}) == len(ROWS) * 3
    assert len({r["id"].split("-")[0] for r in ids[0]}) == 7
    monkeypatch.setattr(S, "CHUNK", 50)                     # one row that fills the table
    hot = CI.content_ids(spark.range(1000).select(F.lit("x").alias("a")), "id")
    assert hot.select("id").distinct().count() == 1000
    assert hot.where(f"id = 'flow_{hashlib.sha256(b'1:x').hexdigest()}-999'").count() == 1


def test_alert_ids_without_a_key(spark):
    heads = F.array(F.struct(F.lit(0).alias("ord"), F.lit("dos").alias("head"), F.col("p").alias("p"), F.lit(0.5).alias("threshold")))
    df = spark.createDataFrame([(0.9, None), (0.9, None), (0.1, 3)], "p double, port int")
    out = AL.alerts(df, None, heads, F.lit(0.2)).collect()
    assert len({r["flow_id"] for r in out}) == 3 and sorted(r["attack_type"] or "" for r in out) == ["", "dos", "dos"]


# ---------------------------------------------------------- sparse features

def test_sparse_features_of_a_wide_column_with_a_hot_value(spark, monkeypatch):
    n = 150_000
    df = spark.range(n, numPartitions=8).select(
        F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("host"),
        (F.col("id") % 2).cast("string").alias("flag"))
    st = FT.fit_sparse(df, None, ["key"])
    assert st.sizes == {"host": 100_001, "flag": 2} and st.dim == 1 + 100_001 + 2
    order = sorted(["hot", *(f"v{i}" for i in range(n) if i % 3)])
    place = {v: i for i, v in enumerate(order)}
    import flowlab.session as session
    for limit in (session.BROADCAST_MAX_BYTES, 1000):       # broadcast, and joined by salted shuffle
        monkeypatch.setattr(FT, "broadcast_if_small", lambda t, known_rows=None: session.broadcast_if_small(t, limit, known_rows))
        got = FT.sparse_features(df, st, ["key"])
        sample = got.where("key % 9973 = 0").collect()
        assert got.count() == n and len(sample) == 16
        for r in sample:
            i = r["key"]
            host = place["hot" if i % 3 == 0 else f"v{i}"]
            assert r["size"] == st.dim and r["indices"] == [0, 1 + host, 1 + 100_001 + i % 2] and r["values"][1:] == [1.0, 1.0]
            assert r["values"][0] == pytest.approx((i % 7 - st.mean["x"]) / st.std["x"])


def test_sparse_state_unseen_values_and_empty_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", None)], "c string, x double")
    st = FT.fit_sparse(FT.clean(df), None)
    st.save(str(tmp_path / "st"))
    back = FT.SparseState.load(spark, str(tmp_path / "st"))
    new = FT.clean(spark.createDataFrame([("b", 2.0), ("zz", 0.0), (None, None)], "c string, x double")).withColumn("k", F.lit(1))
    rows = FT.sparse_features(new, back, ["c"]).collect()
    assert {r["c"]: r["indices"] for r in rows} == {"b": [0, 2], "zz": [0], "unknown": [0]} and {r["size"] for r in rows} == {3}
    hot = {r["c"]: (r["c_size"], r["c_indices"], r["c_values"]) for r in FT.sparse_one_hot(new, back, ["c"]).collect()}
    assert hot == {"b": (2, [1], [1.0]), "zz": (2, [], []), "unknown": (2, [], [])}
    only = FT.fit_sparse(df.select("x"), None)
    assert {tuple(r["indices"]) for r in FT.sparse_features(FT.clean(df.select("x")), only, ["x"]).collect()} == {(0,)}


# ------------------------------------------------- moments, linear models

def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    x[:, 1] += 1e8
    x[:, 2] = 1e8 + rng.normal(size=4000)
    n, mean, c = AN.centred_moments(frame(spark, x), "v")
    assert n == 4000 and np.allclose(c / (n - 1), np.cov(x.T), atol=1e-6)
    mu, inv = AN.fit_mahalanobis(frame(spark, x), "v")
    assert np.allclose(inv, np.linalg.inv(np.cov(x.T)), atol=1e-5) and np.allclose(mu, x.mean(axis=0))


def test_moments_in_blocks_and_of_nothing(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(300, 11))
    monkeypatch.setattr(AN, "MOMENT_BLOCK", 4)
    monkeypatch.setattr(AN, "MERGED", 2)
    n, mean, c = AN.centred_moments(frame(spark, x), "v")
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(c, (x - mean).T @ (x - mean))
    assert AN.centred_moments(frame(spark, x[:0]), "v")[0] == 0


def test_encoder_prefers_what_both_views_share(spark):
    rng = np.random.default_rng(3)
    signal = rng.normal(size=(2000, 2))
    rows = [(s @ [[1, 0, 1], [0, 1, 1]] + rng.normal(size=3) * [0.1, 0.1, 5.0],) * 1 for s in signal]
    v1 = np.array([r[0] for r in rows])
    v2 = np.array([s @ [[1, 0, 1], [0, 1, 1]] + rng.normal(size=3) * [0.1, 0.1, 5.0] for s in signal])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(v1, v2)], "a array<double>, b array<double>")
    net, loss = LN.contrastive_encoder(df, "a", "b", 2)
    z = MO.net_forward(v1, net)
    assert z.shape == (2000, 2) and np.allclose(np.cov(z.T, bias=True), np.eye(2), atol=1e-6) and max(loss) < 0.05
    assert len(LN.contrastive_encoder(df, "a", "b", 9)[1]) == 3


def test_autoencoder_is_the_best_projection(spark):
    x = np.random.default_rng(4).normal(size=(500, 6)) @ np.diag([5, 4, 1, 1, 0.5, 0.1]) + 3
    net = LN.linear_autoencoder(frame(spark, x), "v", 2)
    error = np.sum((x - MO.net_forward(x, net)) ** 2)
    assert error == pytest.approx(np.sum(np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[2:] ** 2))


def test_fixmatch_learns_and_keeps_out_of_earlier_spans(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 4)) + np.outer(2 * y - 1, [1.5, 0, 0, 0])
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), 1.0) for i in range(600)], "id long, z array<double>, y int, weight double")
    views = RO.fixmatch_views(df, "z", "id", 3, 1).cache()
    w, b, hist = RO.train_fixmatch(views, 4, steps=5)
    assert hist[-1]["loss_s"] < 0.6 * math.log(2) and np.mean((x @ w + b > 0) == y) > 0.9 and hist[-1]["mask_rate"] > 0
    basis = np.linalg.qr(rng.normal(size=(5, 2)))[0]
    w, b, _ = RO.train_fixmatch(views, 4, steps=5, bases=[basis])
    assert np.allclose(basis.T @ np.append(w, b), 0, atol=1e-9)
    views.unpersist()


# ---------------------------------------------------- forest, calibration, mixup

def test_forest_does_not_depend_on_the_layout(spark):
    x = np.random.default_rng(6).normal(size=(300, 3))
    a, b = (AN.fit_isolation_forest(frame(spark, x).repartition(n), "v", "id", 10, 32).orderBy("tree_id").collect() for n in (1, 6))
    assert a == b and all(len(r["feature"]) == 63 and r["n_samples"] <= 32 for r in a)
    for r in a:             # every inner node has both children, a leaf's path is not less than its level
        for i, f in enumerate(r["feature"][:31]):
            if f >= 0:
                assert r["path"][i] == 0.0 and (r["feature"][2 * i + 1] >= 0 or r["path"][2 * i + 1] > 0)


@pytest.mark.parametrize("x", [np.zeros((50, 2)), np.ones((1, 2)), np.arange(4.0).reshape(2, 2)])
def test_forest_of_equal_and_few_rows(spark, x):
    forest = AN.fit_isolation_forest(frame(spark, x), "v", "id", 5, 16)
    s = [r["if_score"] for r in AN.score_isolation_forest(frame(spark, x), "v", forest, ["id"]).collect()]
    assert len(s) == len(x) and all(0 <= v <= 1 for v in s)


def test_temperature_of_several_classes(spark):
    rng = np.random.default_rng(7)
    logits = rng.normal(size=(800, 4)) * 3
    p = np.exp(logits / 2.2)
    y = np.array([rng.choice(4, p=q / q.sum()) for q in p])
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(logits, y)], "logits array<double>, y int")

    def nll(t):
        z = logits / t
        return np.mean(np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(800), y])
    grid = np.exp(np.linspace(np.log(0.5), np.log(5), 4001))
    assert CA.fit_temperature(df, "logits", "y") == pytest.approx(grid[np.argmin([nll(t) for t in grid])], rel=1e-3)
    two = CA.margin_counts(df.unionByName(df), "logits", "y").agg(F.sum("n"), F.count("*")).first()
    assert tuple(two) == (1600, 800)


def test_temperature_at_the_ends(spark):
    def fit(rows):
        return CA.fit_temperature(spark.createDataFrame(rows, "logits array<double>, y int"), "logits", "y")
    assert fit([([0.0, 3.0], 1), ([2.0, 0.0], 0)]) == 1e-3          # separable: as cold as allowed
    assert fit([([0.0, 3.0], 0), ([2.0, 0.0], 1)]) == 10.0          # always wrong: as hot as allowed
    assert fit([]) == 1.0 and fit([([0.0, 900.0], 1), ([0.0, 900.0], 0), ([0.0, None], 1)]) > 1


def test_mixup_draws_and_partners(spark):
    lam = np.array([r[0] for r in spark.range(4000).select(AU.beta(0.75, F.lit(1), F.col("id"))).collect()])
    assert abs(lam.mean() - 0.5) < 0.02 and abs(lam.var() - 1 / (4 * 2.5)) < 0.01 and 0 < lam.min() and lam.max() < 1
    x = np.eye(12)
    df = spark.createDataFrame([(i, x[i].tolist(), i % 2, i // 4, i % 4) for i in range(12)],
                               "id long, v array<double>, y int, batch_id long, pos int")
    out = AU.mixup(df, "v", "y").collect()
    for b in range(3):
        rows = sorted((r for r in out if r["batch_id"] == b), key=lambda r: r["pos"])
        m = np.array([r["x_mix"] for r in rows])
        lam = rows[0]["lam"]
        assert {r["lam"] for r in rows} == {lam} and 0.5 <= lam <= 1 and np.allclose(m.sum(axis=1), 1)
        own = m[:, 4 * b:4 * b + 4]
        rest = own - lam * np.eye(4)
        assert np.allclose(sorted(rest.sum(axis=0)), 1 - lam)       # every row is a partner once
        assert np.allclose([sum(r["y_mix"]) for r in rows], 1)
