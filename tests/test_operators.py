from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import calibrate as CA
from flowlab.operators import features as FT
from flowlab.operators import linalg as LA
from flowlab.operators import metrics as M
from flowlab.operators import losses as LO
from flowlab.operators import split as SP


def test_severity_and_ensemble_scalars(spark):
    df = spark.createDataFrame([(0.95,), (0.75,), (0.55,), (0.3,), (0.9,), (0.7,), (0.5,)], "s double")
    got = [r[0] for r in df.select(A.severity(F.col("s"))).collect()]
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM", "LOW"]
    v = spark.range(1).select(A.ensemble(F.lit(0.8), F.lit(0.6))).first()[0]
    assert v == pytest.approx(0.72)


def test_feature_fit_apply_leak_and_unseen(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", True, "x", "n", "normal"), (2, 2.0, "b", False, "y", "n", "attack"),
         (3, 4.0, None, True, "z", "n", "normal"), (4, float("inf"), "", None, "w", "n", "attack")],
        "id long, f double, c string, b boolean, AttackLabel string, attack_cat string, Label string")
    c = FT.clean(df)
    st = FT.fit(c, "Label")
    assert st.numeric == ["f"] and st.categorical == ["c", "b"]
    # population std of 1, 2, 4, 0 (inf cleaned to 0)
    assert st.std["f"] == pytest.approx(float(np.std([1, 2, 4, 0])))
    assert st.vocab["c"] == ["a", "b", "unknown"] and st.vocab["b"] == ["False", "True", "unknown"]
    assert st.classes == ["attack", "normal"]
    new = spark.createDataFrame([(9, 3.0, "zzz", "normal")], "id long, f double, c string, Label string")
    out = FT.transform(new, st, "Label", keep=["id"]).first()
    assert out["features"][1:4] == [0.0, 0.0, 0.0]        # unseen category -> zeros
    assert out["features"][4:] == [0.0, 0.0, 1.0]         # missing column -> 'unknown'
    assert out["y"] == 1
    bad = spark.createDataFrame([(9, 3.0, "a", "weird")], "id long, f double, c string, Label string")
    with pytest.raises(Exception):
        FT.transform(bad, st, "Label").collect()


def test_zero_std_becomes_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "f double")
    r = FT.scaler_stats(df, ["f"]).first()
    assert r["std"] == 1.0


@pytest.mark.parametrize("parts", [1, 7, 31])
def test_split_exact_and_layout_invariant(spark, parts):
    rows = [(i, "big" if i % 3 else "small", f"file{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, f string").repartition(parts)
    out = SP.stratified_split(df, ["k"], "s", file_col="f", n_sub=8)
    test = sorted(r["k"] for r in out.where("split = 'test'").collect())
    ref = sorted(r["k"] for r in SP.stratified_split(
        spark.createDataFrame(rows, "k long, s string, f string"), ["k"], "s", file_col="f", n_sub=3)
        .where("split = 'test'").collect())
    assert test == ref
    assert len(test) == 2 * math.ceil(0.2 * 1500)
    d = SP.disjointness(out, ["k"]).first()
    assert d["overlap"] == 0 and d["n_train"] + d["n_test"] == 3000


def test_batches_drop_remainder(spark):
    df = spark.range(130).select(F.col("id").alias("k"))
    b = SP.batches(df, ["k"], 64).collect()
    assert len(b) == 128 and sorted({r["batch_id"] for r in b}) == [0, 1]
    assert SP.batches(spark.range(10).select(F.col("id").alias("k")), ["k"], 64).count() == 0


def test_balanced_batches_half_half(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") < 40).cast("int").alias("y"))
    b = SP.balanced_batches(df, ["k"], "y", 16)
    per = b.groupBy("batch_id").agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == 2 * 40 // 16 and all(r["ones"] == 8 and r["n"] == 16 for r in per)
    with pytest.raises(ValueError):
        SP.balanced_batches(df.where("y = 0"), ["k"], "y", 16)


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "g int, v double")
    got = {r["g"]: r["quantile"] for r in AN.exact_percentile(df, "v", 0.95, ["g"], n_parts=40).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.percentile(vals[g::3], 95), abs=1e-12)
    one = AN.exact_percentile(df, "v", 0.95).first()[0]
    assert one == pytest.approx(np.percentile(vals, 95), abs=1e-12)


def test_isolation_forest_scores_in_unit_interval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[:5] += 8
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "id long, v array<double>")
    forest = AN.fit_isolation_forest(df, "v", "id", n_trees=50, max_samples=64)
    s = {r["id"]: r["if_score"] for r in AN.score_isolation_forest(df, "v", forest, ["id"]).collect()}
    assert all(0.0 <= v <= 1.0 for v in s.values())
    assert np.mean([s[i] for i in range(5)]) > np.mean([s[i] for i in range(5, 400)])


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ np.diag([1, 2, 3, 4])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, v array<double>")
    mu, inv = AN.fit_mahalanobis(df, "v")
    d = {r["id"]: r["distance"] for r in AN.mahalanobis(df, "v", mu, inv, ["id"]).collect()}
    ci = np.linalg.inv(np.cov(x.T))
    ref = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), ci, x - x.mean(0)))
    assert np.allclose([d[i] for i in range(300)], ref)


def test_svd_basis_orthonormal_and_energy(spark):
    rng = np.random.default_rng(3)
    g = rng.normal(size=(10, 50))
    df = spark.createDataFrame([(i, g[i].tolist()) for i in range(10)], "row_id long, vec array<double>")
    basis, s = LA.svd_basis(df, "row_id", "vec", block=16)
    rows = basis.collect()
    k = max(r["component"] for r in rows) + 1
    u = np.zeros((50, k))
    for r in rows:
        u[r["block_id"] * 16: r["block_id"] * 16 + len(r["vec"]), r["component"]] = r["vec"]
    assert 1 <= k <= 10 and np.allclose(u.T @ u, np.eye(k), atol=1e-9)
    ref = np.linalg.svd(g.T, full_matrices=False)
    assert np.allclose(s, ref[1][:k])
    assert k == int(np.searchsorted(np.cumsum(ref[1] ** 2) / np.sum(ref[1] ** 2), 0.97)) + 1
    # same projector as the NumPy basis
    assert np.allclose(u @ u.T, ref[0][:, :k] @ ref[0][:, :k].T, atol=1e-8)


def test_svd_all_zero_gives_empty(spark):
    df = spark.createDataFrame([(i, [0.0] * 5) for i in range(3)], "row_id long, vec array<double>")
    basis, s = LA.svd_basis(df, "row_id", "vec", block=4)
    assert basis.count() == 0 and s.size == 0


def test_projection_joint_orthogonal_and_noop(spark):
    rng = np.random.default_rng(4)
    g = rng.normal(size=(5, 16))
    b1 = np.linalg.qr(rng.normal(size=(16, 2)))[0]
    b2 = np.linalg.qr(rng.normal(size=(16, 3)))[0]
    df = spark.createDataFrame([(i, g[i].tolist()) for i in range(5)], "id long, v array<double>")
    out = {r["id"]: np.array(r["projected"]) for r in LA.project_frame(df, "v", [b1, b2], mode="joint").collect()}
    for i in range(5):
        assert np.allclose(b1.T @ out[i], 0, atol=1e-10) and np.allclose(b2.T @ out[i], 0, atol=1e-10)
    same = {r["id"]: r["projected"] for r in LA.project_frame(df, "v", []).collect()}
    assert np.allclose(same[0], g[0])
    blocks = LA.to_blocks(df.withColumnRenamed("id", "row_id"), "row_id", "v", 4)
    bas = spark.createDataFrame([(c, b, b2[b * 4:(b + 1) * 4, c].tolist()) for c in range(3) for b in range(4)],
                                "component int, block_id int, vec array<double>")
    pb = LA.project_blocked(blocks, bas).collect()
    full = {i: np.zeros(16) for i in range(5)}
    for r in pb:
        full[r["row_id"]][r["block_id"] * 4:(r["block_id"] + 1) * 4] = r["sub"]
    assert np.allclose(full[2], g[2] - b2 @ (b2.T @ g[2]))


def test_nt_xent_positive_and_identical_views_small(spark):
    rng = np.random.default_rng(5)
    z1 = rng.normal(size=(8, 16))
    z2 = rng.normal(size=(8, 16))
    mk = lambda a, b: spark.createDataFrame([(0, i, a[i].tolist(), b[i].tolist()) for i in range(8)],
                                            "batch_id long, pos int, z1 array<double>, z2 array<double>")
    assert LO.nt_xent(mk(z1, z2)).first()["loss"] > 0
    assert LO.nt_xent(mk(z1, z1)).first()["loss"] < 5.0


def test_temperature_fit_close_to_bruteforce(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-x / 2.5))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "l double, y int").select(
        CA.binary_logits(F.col("l")).alias("logits"), "y")
    t = CA.fit_temperature(df, "logits", "y")
    grid = np.exp(np.linspace(np.log(1e-3), np.log(10), 20001))

    def nll(tt):
        p1 = 1 / (1 + np.exp(-x / tt))
        p = np.clip(np.where(y == 1, p1, 1 - p1), 1e-15, 1 - 1e-15)
        return -np.mean(np.log(p))

    best = grid[np.argmin([nll(g) for g in grid])]
    assert abs(t - best) / best < 1e-3


def test_routing_cases(spark):
    rows = [
        (1, [0.1, 0.2], 0.1),           # nothing qualifies, low anomaly -> benign
        (2, [0.9, 0.2], 0.1),           # one head
        (3, [0.7, 0.99], 0.1),          # larger margin wins
        (4, [0.75, 0.85], 0.1),         # equal margins (thr .6/.7): first head
        (5, [0.6, 0.1], 0.1),           # exactly at threshold qualifies
        (6, [0.1, 0.1], 0.65),          # anomaly exactly at cut -> zero-day
    ]
    df = spark.createDataFrame(rows, "id long, p array<double>, a double")
    heads = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("head"), F.col("p")[i].alias("p"),
                               F.lit(t).alias("threshold")) for i, (n, t) in enumerate([("dos", 0.6), ("scan", 0.7)])])
    out = {r["flow_id"]: r for r in AL.alerts(df, "id", heads, F.col("a"), with_timestamp=True).collect()}
    assert out["1"]["attack_type"] is None and out["1"]["confidence"] == pytest.approx(0.2)
    assert out["2"]["attack_type"] == "dos"
    assert out["3"]["attack_type"] == "scan"
    assert out["4"]["attack_type"] == "dos"
    assert out["5"]["attack_type"] == "dos"
    assert out["6"]["attack_type"] == AL.ZERO_DAY and out["6"]["severity"] == "MEDIUM"


def test_resolve_params_defaults(spark):
    p = AL.head_params(spark, [("dos", 0.6, 1.5)])
    r = AL.resolve_params(spark, ["dos", "scan"], p)
    assert r == [("dos", 0.6, 1.5), ("scan", 0.5, None)]
    assert AL.resolve_params(spark, ["dos"], None) == [("dos", 0.8, None)]


def test_pseudo_label_cuts(spark):
    df = spark.createDataFrame([([math.log(0.95), math.log(0.05)],), ([math.log(0.94), math.log(0.06)],),
                                ([math.log(0.3), math.log(0.7)],)], "l array<double>")
    lab, mask = LO.pseudo_label(F.col("l"))
    got = [(r[0], r[1]) for r in df.select(lab, mask).collect()]
    assert got[0] == (0, 1.0) and got[1] == (0, 0.0) and got[2][0] == 1 and got[2][1] == 1.0


def test_svd_basis_has_no_row_limit(spark, monkeypatch):
    """A narrow first range spans the same space."""
    rng = np.random.default_rng(5)
    g = rng.normal(size=(40, 5)) @ np.diag([9.0, 7.0, 5.0, 3.0, 1.0]) @ rng.normal(size=(5, 120))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(g)], "row_id long, vec array<double>")
    monkeypatch.setattr(LA, "RANGE_WIDTH", 2)
    basis, s = LA.svd_basis(df, "row_id", "vec", block=50)
    want_u, want_s, _ = np.linalg.svd(g.T, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(want_s ** 2) / np.sum(want_s ** 2), LA.ENERGY)) + 1
    assert np.allclose(s, want_s[:k], rtol=1e-6)
    got = {}
    for r in basis.collect():
        got.setdefault(r["component"], {})[r["block_id"]] = r["vec"]
    u = np.array([np.concatenate([got[c][b] for b in sorted(got[c])]) for c in sorted(got)])
    assert np.allclose(np.abs(u @ want_u[:, :k]), np.eye(k), atol=1e-5)
    zero = spark.createDataFrame([(i, [0.0] * 30) for i in range(10)], "row_id long, vec array<double>")
    assert LA.svd_basis(zero, "row_id", "vec")[0].count() == 0


def test_svd_basis_tall_matrix(spark):
    rng = np.random.default_rng(9)
    g = rng.normal(size=(40, 6)) @ np.diag([5, 4, 3, 0.1, 0.05, 0.01])
    df = spark.createDataFrame([(i, g[i].tolist()) for i in range(40)], "row_id long, vec array<double>")
    basis, s = LA.svd_basis(df, "row_id", "vec", block=4)
    ref = np.linalg.svd(g.T, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(ref[1] ** 2) / np.sum(ref[1] ** 2), 0.97)) + 1
    assert np.allclose(s, ref[1][:k])
    u = np.zeros((6, k))
    for r in basis.collect():
        u[r["block_id"] * 4: r["block_id"] * 4 + len(r["vec"]), r["component"]] = r["vec"]
    assert np.allclose(u @ u.T, ref[0][:, :k] @ ref[0][:, :k].T, atol=1e-8)


def test_rank_by_value_strings_any_layout(spark):
    from flowlab.operators.prefix import rank_by_value
    rows = [(g, f"v{i:04d}") for g in ("a", "b") for i in range(300)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "g string, v string").repartition(parts)
        out = rank_by_value(df, ["g"], "v", n_parts=7).collect()
        assert all(r["rank"] == int(r["v"][1:]) for r in out)


def test_roc_drop_intermediate_matches_bruteforce(spark):
    rng = np.random.default_rng(10)
    ys = rng.integers(0, 2, 300)
    ps = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(ys, ps)], "y int, p double")
    got = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_curve(df, drop_intermediate=True).collect()
                 if r["threshold"] is not None)
    thr = np.unique(ps)[::-1]
    tps = np.array([np.sum((ps >= t) & (ys == 1)) for t in thr])
    fps = np.array([np.sum((ps >= t) & (ys == 0)) for t in thr])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = sorted((float(thr[i]), fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep)
    assert len(got) == len(exp) and all(np.allclose(a, b) for a, b in zip(got, exp))


def test_batch_sessions_small_buckets_equal_large(spark):
    from flowlab.streaming import alerts as ST
    rng = np.random.default_rng(11)
    ts = np.sort(rng.integers(0, 3 * 86400, 400))
    users = rng.integers(0, 3, 400)
    df = spark.createDataFrame([(int(u), int(t)) for u, t in zip(users, ts)], "user_id long, t long").select(
        "user_id", F.timestamp_seconds("t").alias("ts"))
    a = sorted(tuple(r) for r in ST.batch_sessions(df, 1800, bucket_seconds=600).collect())
    b = sorted(tuple(r) for r in ST.batch_sessions(df, 1800, bucket_seconds=10 ** 7).collect())
    c = sorted(tuple(r) for r in ST.batch_sessions(df, 1800, n_parts=13).collect())
    hot = df.withColumn("user_id", F.lit(7))        # one key holding every row
    d = sorted(tuple(r)[1:] for r in ST.batch_sessions(hot, 1800, n_parts=13).collect())
    e = sorted(tuple(r)[1:] for r in ST.batch_sessions(hot, 1800, bucket_seconds=10 ** 7).collect())
    assert a == b == c and d == e


def test_reference_architecture_sizes_and_forward(spark):
    from flowlab.operators import models as MO
    assert MO.trainable_params(MO.classifier_head(256, 2)) == 58434
    enc = MO.flow_encoder(10, 32, 16, seed=1)
    head = MO.classifier_head(16, 2, seed=2)
    x = np.random.default_rng(0).normal(size=(5, 10))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "id long, v array<double>")
    out = {r["id"]: r for r in MO.apply_nets(df, "v", {"lg": head}, ["id"], encoder=enc).collect()}
    ref = MO.net_forward(MO.net_forward(x, enc), head)
    assert np.allclose([out[i]["lg"] for i in range(5)], ref)


def test_first_n_is_exact_on_a_large_wide_table(spark):
    n, cap = 2_000_000, 150_000
    df = spark.range(n, numPartitions=16).select(((F.col("id") * 7919) % n).alias("k"),
                                                 F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"))
    r = SP.first_n(df, ["k"], cap).agg(F.count("*"), F.countDistinct("k"), F.max("k"), F.min("k")).first()
    assert tuple(r) == (cap, cap, cap - 1, 0)


def test_first_n_several_keys_and_nulls(spark):
    rows = [(None if i % 10 == 0 else i % 7, f"s{i % 13}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b string, i long")
    got = SP.first_n(df, ["a", "b", "i"], 123).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[:123]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_percentile_of_a_dominant_value_and_of_many_groups(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 9, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("v"))
    vals = np.array([5.0 if i % 10 < 9 else float(i) for i in range(300_000)])
    for q in (0.0, 0.5, 0.93, 1.0):
        assert AN.exact_percentile(df, "v", q).first()["quantile"] == pytest.approx(np.quantile(vals, q), abs=1e-9)
    many = spark.range(600_000).select((F.col("id") % 200_000).alias("g"), (F.col("id") * 1.0).alias("v"))
    out = AN.exact_percentile(many, "v", 0.75, ["g"])
    assert out.where(F.col("quantile") != F.col("g") + 300_000.0).count() == 0 and out.count() == 200_000


def test_noise_on_long_vectors(spark):
    from flowlab.functions.rand import MINSTD_A, MINSTD_M, stream_uniforms
    got = spark.range(1).select(stream_uniforms(F.lit(12345), F.lit(10_000)).alias("u")).first()["u"]
    want, x = [], 12345
    for _ in range(10_000):
        x = MINSTD_A * x % MINSTD_M
        want.append(x / MINSTD_M)
    assert got == want


def test_split_needs_every_class_on_both_sides(spark):
    rows = [(i, "a" if i < 3 else ("b" if i < 6 else "c")) for i in range(9)]
    df = spark.createDataFrame(rows, "k long, s string")
    with pytest.raises(ValueError, match="number of classes"):
        SP.stratified_split(df, ["k"], "s", test_size=0.2)        # 2 test rows < 3 classes
    out = SP.stratified_split(df, ["k"], "s", test_size=0.34).where("split = 'test'").collect()
    # ceil(0.34 * 9) = 4 test rows: one per class, the extra one to the first of the tied remainders
    assert sorted(r["s"] for r in out) == ["a", "a", "b", "c"]
