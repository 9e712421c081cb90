from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import train as TR


def _loss_of(layers_like, x, y, kind):
    def f(w):
        z, _ = TR.forward(x, TR.unflatten(w, layers_like))
        if kind == "ce":
            return TR.ce_grad(z, y)[0]
        if kind == "focal":
            return TR.focal_grad(z, y)[0]
        return TR.mse_grad(z, x[:, :z.shape[1]])[0]
    return f


def test_gradient_checks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 5))
    y = rng.integers(0, 2, 7)
    for kind, sizes in (("ce", [5, 4, 2]), ("focal", [5, 4, 2]), ("mse", [5, 3, 5])):
        layers = TR.init(sizes, 1)
        z, acts = TR.forward(x, layers)
        if kind == "ce":
            _, d = TR.ce_grad(z, y)
        elif kind == "focal":
            _, d = TR.focal_grad(z, y)
        else:
            _, d = TR.mse_grad(z, x)
        g, _ = TR.backward(acts, layers, d)
        err = TR.numeric_gradient_check(_loss_of(layers, x, y, kind), TR.flatten(layers), TR.flatten(g))
        assert err < 1e-5, (kind, err)


def test_nt_xent_gradient():
    rng = np.random.default_rng(1)
    z1, z2 = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    _, d1, _ = TR.nt_xent_grad(z1, z2)

    def f(w):
        return TR.nt_xent_grad(w.reshape(4, 3), z2)[0]

    err = TR.numeric_gradient_check(f, z1.ravel(), d1.ravel())
    assert err < 1e-5


def test_head_training_loss_decreases_and_separates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(600)], "x array<double>, y int").repartition(4)
    layers, hist = TR.train_head(df, "x", "y", [6, 8, 2], epochs=60, lr=0.5, loss="ce", warmup=100, clip_norm=5.0)
    assert hist[-1]["loss_s"] < hist[0]["loss_s"]
    pred = TR.predict(df, "x", layers, ["y"])
    assert TR.f1_binary(pred, "y", "logits") > 0.9


def test_projected_training_stays_in_nullspace(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(200)], "x array<double>, y int")
    n = len(TR.flatten(TR.init([4, 2], 0)))
    basis = np.linalg.qr(rng.normal(size=(n, 3)))[0]
    w0 = TR.flatten(TR.init([4, 2], 0))
    layers, _ = TR.train_head(df, "x", "y", [4, 2], epochs=5, loss="ce", warmup=100, bases=[basis])
    assert np.allclose(basis.T @ (TR.flatten(layers) - w0), 0, atol=1e-10)


def test_capture_gradients_one_per_batch(spark):
    df = spark.range(96).select((F.col("id") / 32).cast("long").alias("batch_id"),
                                F.array(F.col("id").cast("double") / 96, F.lit(1.0)).alias("x"),
                                (F.col("id") % 2).cast("int").alias("y"))
    g = TR.capture_gradients(df, "x", "y", TR.init([2, 2], 0)).collect()
    assert sorted(r["batch_id"] for r in g) == [0, 1, 2] and all(len(r["vec"]) == 6 for r in g)


def test_softmax_mse_gradient():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(5, 3))
    q = TR.sharpen_np(TR.softmax(rng.normal(size=(5, 3))))
    _, d = TR.softmax_mse_grad(z, q)
    err = TR.numeric_gradient_check(lambda w: TR.softmax_mse_grad(w.reshape(5, 3), q)[0], z.ravel(), d.ravel())
    assert err < 1e-5


def test_mixmatch_loss_decreases(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0).astype(int)
    lab = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(100)], "x array<double>, y int")
    unl = spark.createDataFrame([(x[i].tolist(), (x[i] + 0.05).tolist()) for i in range(100, 300)],
                                "xw array<double>, xs array<double>")
    _, hist = TR.train_mixmatch(lab, "x", "y", [4, 8, 2], unl, "xw", "xs", epochs=30, lr=0.3)
    assert hist[-1]["loss_s"] < hist[0]["loss_s"]


def test_local_sgd_head_learns_and_respects_projection(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 6))
    y = (x[:, 0] - x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(800)], "x array<double>, y int").repartition(4)
    layers, hist = TR.train_head_local(df, "x", "y", [6, 8, 2], epochs=12, lr=0.1, batch_size=32, warmup=100)
    losses = [h["total_loss"] for h in hist]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    assert TR.f1_binary(TR.predict(df, "x", layers, ["y"]), "y", "logits") > 0.9
    n = len(TR.flatten(TR.init([6, 2], 0)))
    basis = np.linalg.qr(rng.normal(size=(n, 4)))[0]
    w0 = TR.flatten(TR.init([6, 2], 0))
    l2, _ = TR.train_head_local(df, "x", "y", [6, 2], epochs=2, batch_size=32, warmup=100, bases=[basis])
    assert np.allclose(basis.T @ (TR.flatten(l2) - w0), 0, atol=1e-9)


def test_contrastive_loss_decreases(spark):
    from flowlab.operators import models as MO
    rng = np.random.default_rng(13)
    base = rng.normal(size=(256, 8))
    rows = [(i // 32, i % 32, (base[i] + 0.05 * rng.normal(size=8)).tolist(), (base[i] + 0.05 * rng.normal(size=8)).tolist())
            for i in range(256)]
    pairs = spark.createDataFrame(rows, "batch_id long, pos int, v1 array<double>, v2 array<double>")
    _, _, hist = TR.train_contrastive_net_local(pairs, MO.flow_encoder(8, 16, 8, seed=1), MO.projection_head(8, 4, seed=2),
                                                epochs=6, lr=3e-3, enc_dropout=0.0)
    assert hist[-1] < hist[0]


def test_spec_net_backward_matches_numeric_with_bn_and_residual():
    from flowlab.operators import models as MO
    from flowlab.operators import netgrad as NG
    rng = np.random.default_rng(21)
    net = MO.classifier_head(6, 2, seed=3)
    for L in net:   # non-trivial BN parameters
        if "gamma" in L:
            L["gamma"] = rng.uniform(0.5, 1.5, L["gamma"].shape)
            L["beta"] = rng.normal(0, 0.1, L["beta"].shape)
    x = rng.normal(size=(9, 6))
    y = rng.integers(0, 2, 9)

    def loss_of(w):
        z, _ = NG.forward(x, NG.unflatten(w, net), training=True)
        return TR.ce_grad(z, y)[0]

    z, cache = NG.forward(x, net, training=True)
    _, d = TR.ce_grad(z, y)
    g, _ = NG.backward(cache, net, d)
    w = NG.flatten(net)
    err = TR.numeric_gradient_check(loss_of, w, NG.grad_vector(net, g), idx=range(0, len(w), 7))
    assert err < 1e-4


def test_reference_head_trains_with_bn_dropout(spark):
    from flowlab.operators import models as MO
    rng = np.random.default_rng(22)
    x = rng.normal(size=(1200, 8))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(1200)], "x array<double>, y int").repartition(4)
    net, hist = TR.train_head_net_local(df, "x", "y", MO.classifier_head(8, 2, seed=1), epochs=8, lr=0.05,
                                        batch_size=64, warmup=100)
    assert hist[-1]["total_loss"] < hist[0]["total_loss"]
    assert any(np.any(L["mean"] != 0) for L in net if "mean" in L)      # moving statistics were learned
    scored = MO.apply_nets(df, "x", {"logits": net}, ["y"])
    assert TR.f1_binary(scored, "y", "logits") > 0.85


def test_contrastive_reference_layout_learns(spark):
    from flowlab.operators import models as MO
    rng = np.random.default_rng(23)
    base = rng.normal(size=(512, 8))
    rows = [(i // 64, i % 64, (base[i] + 0.05 * rng.normal(size=8)).tolist(), (base[i] + 0.05 * rng.normal(size=8)).tolist())
            for i in range(512)]
    pairs = spark.createDataFrame(rows, "batch_id long, pos int, v1 array<double>, v2 array<double>")
    enc, proj, hist = TR.train_contrastive_net_local(pairs, MO.flow_encoder(8, 32, 16, seed=1),
                                                     MO.projection_head(16, 8, seed=2), epochs=5, lr=3e-3)
    assert hist[-1] < hist[0]
    assert any(np.any(L["var"] != 1) for L in enc if "var" in L)


def test_autoencoder_reference_layout_learns(spark):
    from flowlab.operators import models as MO
    rng = np.random.default_rng(24)
    x = rng.normal(size=(600, 3)) @ rng.normal(size=(3, 12))
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(600)], "x array<double>").repartition(3)
    net, hist = TR.train_autoencoder_net_local(df, "x", MO.autoencoder(12, 4, seed=1), epochs=8, lr=3e-3,
                                               batch_size=64)
    assert hist[-1] < 0.5 * hist[0]


def test_history_frame_from_local_rounds(spark):
    rng = np.random.default_rng(30)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] > 0).astype(int)
    lab = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(100)], "x array<double>, y int")
    unl = spark.createDataFrame([(x[i].tolist(), (x[i] * 1.1).tolist()) for i in range(100, 200)],
                                "xw array<double>, xs array<double>")
    _, hist = TR.train_head_local(lab, "x", "y", [4, 8, 2], unl, "xw", "xs", epochs=3, warmup=1, batch_size=32)
    h = TR.history_frame(spark, "t", hist).orderBy("epoch").collect()
    assert h[0]["loss_s"] > 0 and h[0]["loss_u"] is not None
    assert np.isnan(h[0]["loss_u"]) and not np.isnan(h[2]["loss_u"])   # no consistency loss during warm-up
    assert 0.0 <= h[2]["mask_rate"] <= 1.0


def test_head_rounds_and_steps(spark):
    from flowlab.operators import rounds as RO
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(i, (centre * (1 if i % 3 == 0 else -1) + rng.normal(size=8)).tolist(), int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    weights, bias, losses = RO.head_steps(df, "v", "y", 8, steps=6)
    assert losses[0] == pytest.approx(np.log(2)) and all(b < a for a, b in zip(losses, losses[1:]))
    # the same steps in NumPy
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    wt = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    w, b = np.zeros(8), 0.0
    for _ in range(6):
        d = wt * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 0.5 * (x.T @ d) / wt.sum(), b - 0.5 * d.sum() / wt.sum()
    assert np.allclose(weights, w) and bias == pytest.approx(b)
    model, history = RO.train_head_rounds(df.where("id < 60"), df.where("id >= 60"), "v", "y", "id")
    assert [h["round"] for h in history] == [0, 1, 2] and all(0 < h["mask_rate"] <= 1 for h in history)
    scored = RO.apply_head(df, model, "v").selectExpr("avg(cast((p_attack >= 0.5) = (y = 1) as int))").first()[0]
    assert scored >= 0.97
