"""Data-parallel training jobs (TR1-TR5).

One round = one Spark job: parameters are broadcast, every partition (or,
for batch losses, every bounded ``batch_id`` group) computes NumPy gradient
sums, the sums are reduced by Spark in fixed-size chunks, and the optimizer
step (Adam / Nesterov SGD, clip-norm, optional null-space projection) runs
on the driver over model-sized vectors only.  Dense + ReLU layers (batch-norm
in inference form, dropout off) with hand-written backward passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


# ------------------------------------------------------------------ model

def init(sizes: list[int], seed: int = 0) -> list[dict[str, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [{"W": rng.normal(0, math.sqrt(2.0 / a), (a, b)), "b": np.zeros(b)} for a, b in zip(sizes[:-1], sizes[1:])]


def flatten(layers) -> np.ndarray:
    return np.concatenate([np.concatenate([L["W"].ravel(), L["b"]]) for L in layers])


def unflatten(vec: np.ndarray, like) -> list[dict[str, np.ndarray]]:
    out, o = [], 0
    for L in like:
        w = vec[o:o + L["W"].size].reshape(L["W"].shape)
        o += L["W"].size
        b = vec[o:o + L["b"].size]
        o += L["b"].size
        out.append({"W": w, "b": b})
    return out


def forward(x: np.ndarray, layers):
    acts = [x]
    h = x
    for i, L in enumerate(layers):
        h = h @ L["W"] + L["b"]
        if i < len(layers) - 1:
            h = np.maximum(h, 0.0)
        acts.append(h)
    return h, acts


def backward(acts, layers, dout: np.ndarray):
    grads = [None] * len(layers)
    d = dout
    for i in range(len(layers) - 1, -1, -1):
        a_in = acts[i]
        grads[i] = {"W": a_in.T @ d, "b": d.sum(axis=0)}
        if i > 0:
            d = (d @ layers[i]["W"].T) * (acts[i] > 0)
    return grads, d


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# ------------------------------------------------------------------ losses (sum over rows, d/dlogits)

def ce_grad(z, y, w=None):
    p = softmax(z)
    n = len(y)
    ww = np.ones(n) if w is None else w
    loss = -np.log(np.clip(p[np.arange(n), y], 1e-15, None)) * ww
    d = p.copy()
    d[np.arange(n), y] -= 1.0
    return loss.sum(), d * ww[:, None]


def focal_grad(z, y, w=None, gamma=2.0):
    p = softmax(z)
    n = len(y)
    pt = np.clip(p[np.arange(n), y], 1e-12, 1.0)
    ww = np.ones(n) if w is None else w
    loss = -((1 - pt) ** gamma) * np.log(pt) * ww
    dpt = gamma * (1 - pt) ** (gamma - 1) * np.log(pt) - (1 - pt) ** gamma / pt
    onehot = np.zeros_like(p)
    onehot[np.arange(n), y] = 1.0
    d = (dpt * pt)[:, None] * (onehot - p)
    return loss.sum(), d * ww[:, None]


def mse_grad(out, target):
    diff = out - target
    d = diff.shape[1]
    return float((diff ** 2).sum() / d), 2.0 * diff / d


def nt_xent_grad(z1, z2, t=0.1):
    """Mean NT-Xent over 2B rows and its gradient w.r.t. the raw (pre-norm)
    projections."""
    z = np.concatenate([z1, z2])
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    norm = np.where(norm == 0, 1.0, norm)
    zn = z / norm
    n = len(z)
    b = n // 2
    sim = zn @ zn.T / t
    np.fill_diagonal(sim, -np.inf)
    tgt = np.concatenate([np.arange(b, n), np.arange(b)])
    p = softmax(sim)
    loss = float(np.mean(-np.log(np.clip(p[np.arange(n), tgt], 1e-300, None))))
    g = p.copy()
    g[np.arange(n), tgt] -= 1.0
    g /= n
    dzn = (g + g.T) @ zn / t
    dz = (dzn - zn * (zn * dzn).sum(axis=1, keepdims=True)) / norm
    return loss, dz[:b], dz[b:]


# ------------------------------------------------------------ reductions

def _reduce(parts: DataFrame, n_params: int) -> tuple[np.ndarray, float, float, float]:
    """Sum per-partition rows ``(chunk, g, loss, n, aux)`` in Spark: one row
    per number, added up by the map-side aggregation first, so what is shuffled
    and grouped has the size of the model whatever the number of tasks."""
    row = F.concat("g", F.array("loss", "n"), "aux")
    red = parts.select("chunk", F.posexplode(row).alias("i", "v")).groupBy("chunk", "i").agg(F.sum("v").alias("v"))
    sums: dict[int, dict[int, float]] = {}
    for r in red.collect():                  # n_params numbers and a few side sums
        sums.setdefault(r["chunk"], {})[r["i"]] = r["v"]
    grad = np.zeros(n_params)
    loss = n = 0.0
    aux = np.zeros(1)
    for c, by_index in sums.items():
        values = np.array([by_index[i] for i in range(len(by_index))], dtype=np.float64)
        size = min(CHUNK, n_params - c * CHUNK)
        grad[c * CHUNK: c * CHUNK + size] = values[:size]
        if c == 0:
            loss, n, aux = float(values[size]), float(values[size + 1]), values[size + 2:]
    return grad, loss, n, aux


SCHEMA = "chunk int, g array<double>, loss double, n double, aux array<double>"


def _emit(flat: np.ndarray, loss: float, n: float, aux=0.0) -> pd.DataFrame:
    """Chunk a flat vector into rows; ``aux`` is a small vector of side
    statistics (summed like the gradient)."""
    k = math.ceil(len(flat) / CHUNK)
    z = [0.0] * (k - 1)
    a = np.atleast_1d(np.asarray(aux, dtype=np.float64))
    return pd.DataFrame({"chunk": np.arange(k, dtype=np.int32),
                         "g": [flat[i * CHUNK:(i + 1) * CHUNK].tolist() for i in range(k)],
                         "loss": [loss] + z, "n": [n] + z, "aux": [a.tolist()] + [np.zeros_like(a).tolist()] * (k - 1)})


def gradient_pass(df: DataFrame, cols: list[str], params, step: Callable, group: str | None = None):
    """One data-parallel pass: ``step(pdf, params) -> (grads, loss_sum, n,
    aux)`` runs per partition (or per ``group`` value); results are summed."""
    bc = df.sparkSession.sparkContext.broadcast(params)
    n_params = len(flatten(params if isinstance(params, list) else params[0]))

    def run_part(it):
        total, loss, n, aux = None, 0.0, 0.0, 0.0
        for pdf in it:
            if len(pdf) == 0:
                continue
            g, l, k, a = step(pdf, bc.value)
            total = g if total is None else total + g
            loss, n, aux = loss + l, n + k, aux + a
        if total is not None:
            yield _emit(total, loss, n, aux)

    def run_group(pdf):
        return _emit(*step(pdf, bc.value))

    if group:
        parts = df.select(*cols).groupBy(group).applyInPandas(run_group, SCHEMA)
    else:
        parts = df.select(*cols).mapInPandas(run_part, SCHEMA)
    return _reduce(parts, n_params)


class Adam:
    def __init__(self, lr=1e-3, b1=0.9, b2=0.999, eps=1e-7):
        self.lr, self.b1, self.b2, self.eps, self.t, self.m, self.v = lr, b1, b2, eps, 0, None, None

    def step(self, w, g):
        if self.m is None:
            self.m, self.v = np.zeros_like(w), np.zeros_like(w)
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return w - self.lr * mh / (np.sqrt(vh) + self.eps)


class NesterovSGD:
    def __init__(self, lr=0.03, momentum=0.9):
        self.lr, self.mu, self.vel = lr, momentum, None

    def step(self, w, g):
        if self.vel is None:
            self.vel = np.zeros_like(w)
        self.vel = self.mu * self.vel - self.lr * g
        return w + self.mu * self.vel - self.lr * g


def project(g: np.ndarray, bases: list[np.ndarray] | None) -> np.ndarray:
    """LA2 on the driver-side gradient vector (sequential, skips bases of
    another dimension)."""
    for b in bases or []:
        if b.size == 0 or b.shape[0] != g.shape[0]:
            continue
        g = g - b @ (b.T @ g)
    return g


def clip(g: np.ndarray, max_norm: float | None) -> np.ndarray:
    if not max_norm:
        return g
    n = np.linalg.norm(g)
    return g * (max_norm / n) if n > max_norm else g


def _stack(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.stack(pdf[col].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())


# ------------------------------------------------------------------ jobs

def train_head(df: DataFrame, x: str, y: str, sizes: list[int], epochs: int = 10, lr: float = 0.03,
               loss: str = "focal", weight: str | None = None, unlabeled: DataFrame | None = None,
               weak: str | None = None, strong: str | None = None, lambda_u: float = 1.0, warmup: int = 3,
               confidence: float = 0.90, clip_norm: float = 1.0, bases: list[np.ndarray] | None = None,
               seed: int = 0) -> tuple[list[dict[str, np.ndarray]], list[dict[str, float]]]:
    """TR2 (FixMatch head): supervised focal loss with class weights on the
    labeled table plus, after ``warmup`` epochs, masked CE on the strong
    view against confident weak-view pseudo labels.  Nesterov SGD, clip-norm,
    NaN steps skipped, optional gradient projection.  Returns weights and the
    per-epoch history (AG22)."""
    layers = init(sizes, seed)
    opt = NesterovSGD(lr)
    hist = []
    lab_cols = [x, y] + ([weight] if weight else [])

    def sup_step(pdf, params):
        z, acts = forward(_stack(pdf, x), params)
        yy = pdf[y].to_numpy().astype(int)
        w = pdf[weight].to_numpy() if weight else None
        l, d = (focal_grad if loss == "focal" else ce_grad)(z, yy, w)
        g, _ = backward(acts, params, d)
        return flatten(g), l, len(pdf), 0.0

    def unsup_step(pdf, params):
        zw, _ = forward(_stack(pdf, weak), params)
        p = softmax(zw)
        lab = p.argmax(axis=1)
        cut = np.where(lab == 0, confidence + 0.05, confidence - 0.20)
        mask = (p.max(axis=1) >= cut).astype(float)
        zs, acts = forward(_stack(pdf, strong), params)
        l, d = ce_grad(zs, lab, mask)
        g, _ = backward(acts, params, d)
        return flatten(g), l, len(pdf), float(mask.sum())

    w = flatten(layers)
    for ep in range(epochs):
        gs, ls, ns, _ = gradient_pass(df, lab_cols, layers, sup_step)
        g = gs / max(ns, 1.0)
        loss_s, loss_u, mask_rate = ls / max(ns, 1.0), 0.0, 0.0
        lam = 0.0 if ep < warmup else lambda_u
        if unlabeled is not None and lam > 0:
            gu, lu, nu, masked = gradient_pass(unlabeled, [weak, strong], layers, unsup_step)
            mask_rate = float(masked[0]) / max(nu, 1.0)
            loss_u = lu / max(nu, 1.0)
            g = g + lam * gu / max(nu, 1.0)
        total = loss_s + lam * loss_u
        if not np.all(np.isfinite(g)) or not math.isfinite(total):
            hist.append({"epoch": ep, "loss_s": float("nan"), "loss_u": float("nan"), "total_loss": float("nan"),
                         "mask_rate": mask_rate})
            continue
        g = clip(project(g, bases), clip_norm)
        w = opt.step(w, g)
        layers = unflatten(w, layers)
        hist.append({"epoch": ep, "loss_s": loss_s, "loss_u": loss_u, "total_loss": total, "mask_rate": mask_rate})
    return layers, hist


def local_sgd_round(df: DataFrame, cols: list[str], w0: np.ndarray, like, batch_grad: Callable,
                    lr: float, batch_size: int, momentum: float = 0.9, bases: list[np.ndarray] | None = None,
                    clip_norm: float | None = 1.0) -> tuple[np.ndarray, float, float, float]:
    """One round of local SGD (parameter averaging): every partition starts
    from the broadcast weights, runs Nesterov mini-batch steps over its own
    rows (each step projected and clipped), and emits its weight change
    times its row count; Spark sums those and the new weights are the
    row-weighted average.  Projection is linear, so averaged deltas stay in
    the allowed subspace.  ``batch_grad(pdf, layers) -> (grad_mean, loss_sum,
    n_rows, aux_sum)``."""
    bc = df.sparkSession.sparkContext.broadcast((w0, like, bases))

    def run(it):
        start, shapes, bs = bc.value
        w = start.copy()
        vel = np.zeros_like(w)
        loss = n = 0.0
        aux = 0.0
        for pdf in it:
            for i in range(0, len(pdf), batch_size):
                b = pdf.iloc[i:i + batch_size]
                g, l, k, a = batch_grad(b, unflatten(w, shapes))
                if k == 0 or not np.all(np.isfinite(g)) or not np.isfinite(l):
                    continue  # a NaN step is skipped
                g = clip(project(g, bs), clip_norm)
                vel = momentum * vel - lr * g
                w = w + momentum * vel - lr * g
                loss, n, aux = loss + l, n + k, aux + a
        if n:
            yield _emit((w - start) * n, loss, n, aux)

    parts = df.select(*cols).mapInPandas(run, SCHEMA)
    dsum, loss, n, aux = _reduce(parts, len(w0))
    return (w0 + dsum / n if n else w0), loss, n, aux


def train_head_local(labeled: DataFrame, x: str, y: str, sizes: list[int], unlabeled: DataFrame | None = None,
                     weak: str | None = None, strong: str | None = None, weight: str | None = None,
                     epochs: int = 10, lr: float = 0.03, batch_size: int = 64, lambda_u: float = 1.0,
                     warmup: int = 3, confidence: float = 0.90, clip_norm: float = 1.0,
                     bases: list[np.ndarray] | None = None, seed: int = 0):
    """TR2 with local mini-batch SGD: labeled and unlabeled rows are mixed
    in one table; inside each mini-batch the focal loss is averaged over its
    labeled rows and the masked consistency CE over its unlabeled rows."""
    layers = init(sizes, seed)
    lab = labeled.select(F.lit(True).alias("_lab"), F.col(x).alias("_x"), F.col(y).cast("int").alias("_y"),
                         (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    mixed = lab
    if unlabeled is not None:
        unl = unlabeled.select(F.lit(False).alias("_lab"), F.col(weak).alias("_xw"), F.col(strong).alias("_xs"))
        mixed = lab.unionByName(unl, allowMissingColumns=True)
    # deterministic interleaving: hash order inside every partition
    mixed = mixed.withColumn("_o", F.rand(seed)).sortWithinPartitions("_o").drop("_o")
    cols = [c for c in ["_lab", "_x", "_y", "_w", "_xw", "_xs"] if c in mixed.columns]
    hist = []
    w = flatten(layers)
    for ep in range(epochs):
        lam = 0.0 if ep < warmup else lambda_u

        def batch_grad(pdf, params, lam=lam):
            lab_rows = pdf[pdf["_lab"]]
            total, loss = None, 0.0
            aux = np.zeros(6)   # masked, loss_s sum, loss_u sum, labeled batches, unlabeled batches, unlabeled rows
            if len(lab_rows):
                z, acts = forward(_stack(lab_rows, "_x"), params)
                l, d = focal_grad(z, lab_rows["_y"].to_numpy().astype(int), lab_rows["_w"].to_numpy())
                g, _ = backward(acts, params, d / len(lab_rows))
                total, loss = flatten(g), l / len(lab_rows)
                aux[1] += l / len(lab_rows)
                aux[3] += 1
            un = pdf[~pdf["_lab"]]
            if lam > 0 and len(un):
                p = softmax(forward(_stack(un, "_xw"), params)[0])
                pl = p.argmax(axis=1)
                mask = (p.max(axis=1) >= np.where(pl == 0, confidence + 0.05, confidence - 0.20)).astype(float)
                z, acts = forward(_stack(un, "_xs"), params)
                l, d = ce_grad(z, pl, mask)
                g, _ = backward(acts, params, lam * d / len(un))
                gu = flatten(g)
                total = gu if total is None else total + gu
                loss += lam * l / len(un)
                aux += [float(mask.sum()), 0.0, l / len(un), 0.0, 1.0, len(un)]
            if total is None:
                return np.zeros(len(flatten(params))), 0.0, 0, np.zeros(6)
            return total, loss * len(pdf), len(pdf), aux

        w, l, n, aux = local_sgd_round(mixed, cols, w, layers, batch_grad, lr, batch_size, bases=bases,
                                       clip_norm=clip_norm)
        layers = unflatten(w, layers)
        hist.append(_history(ep, l, n, aux))
    return layers, hist


def train_head_net_local(labeled: DataFrame, x: str, y: str, net: list[dict], unlabeled: DataFrame | None = None,
                         weak: str | None = None, strong: str | None = None, weight: str | None = None,
                         epochs: int = 10, lr: float = 0.03, batch_size: int = 64, lambda_u: float = 1.0,
                         warmup: int = 3, confidence: float = 0.90, clip_norm: float = 1.0,
                         dropout: list[float] | None = None, bases: list[np.ndarray] | None = None, seed: int = 0):
    """TR2 on a layer-spec network (e.g. ``models.classifier_head``): focal
    loss on labeled mini-batches and masked consistency CE on unlabeled ones
    (pseudo labels from the weak view in inference mode), batch-norm with
    batch statistics and dropout while training, Nesterov SGD with clip-norm
    and optional projection, run as local-SGD rounds.  Trainable weights and
    the moving statistics are both averaged across tasks by row count."""
    from flowlab.operators import netgrad as NG
    lab = labeled.select(F.lit(True).alias("_lab"), F.col(x).alias("_x"), F.col(y).cast("int").alias("_y"),
                         (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    mixed = lab
    if unlabeled is not None:
        unl = unlabeled.select(F.lit(False).alias("_lab"), F.col(weak).alias("_xw"), F.col(strong).alias("_xs"))
        mixed = lab.unionByName(unl, allowMissingColumns=True)
    mixed = mixed.withColumn("_o", F.rand(seed)).sortWithinPartitions("_o").drop("_o")
    cols = [c for c in ["_lab", "_x", "_y", "_w", "_xw", "_xs"] if c in mixed.columns]
    rates = dropout or [0.3 if i < len(net) - 2 else (0.2 if i == len(net) - 2 else 0.0) for i in range(len(net))]
    hist = []
    for ep in range(epochs):
        lam = 0.0 if ep < warmup else lambda_u
        w0, m0 = NG.flatten(net), NG.flatten(net, NG.MOVING)
        bc = mixed.sparkSession.sparkContext.broadcast((w0, m0, net, bases))

        def run(it, lam=lam, ep=ep):
            from pyspark import TaskContext
            start, mstart, like, bs = bc.value
            rng = np.random.default_rng([seed, ep, TaskContext.get().partitionId()])
            w, vel = start.copy(), np.zeros_like(start)
            cur = NG.unflatten(mstart, NG.unflatten(w, like), NG.MOVING)
            loss = n = 0.0
            aux = np.zeros(6)
            for pdf in it:
                for i in range(0, len(pdf), batch_size):
                    b = pdf.iloc[i:i + batch_size]
                    total = None
                    lsum = 0.0
                    lr_rows = b[b["_lab"]]
                    if len(lr_rows) > 1:
                        z, cache = NG.forward(_stack(lr_rows, "_x"), cur, True, rng, rates)
                        l, d = focal_grad(z, lr_rows["_y"].to_numpy().astype(int), lr_rows["_w"].to_numpy())
                        g, _ = NG.backward(cache, cur, d / len(lr_rows))
                        total, lsum = NG.grad_vector(cur, g), l / len(lr_rows)
                        cur = NG.update_moving(cur, cache)
                        aux[1] += l / len(lr_rows)
                        aux[3] += 1
                    un = b[~b["_lab"]]
                    if lam > 0 and len(un) > 1:
                        p = softmax(NG.forward(_stack(un, "_xw"), cur, False)[0])
                        pl = p.argmax(axis=1)
                        mask = (p.max(axis=1) >= np.where(pl == 0, confidence + 0.05, confidence - 0.20)).astype(float)
                        z, cache = NG.forward(_stack(un, "_xs"), cur, True, rng, rates)
                        l, d = ce_grad(z, pl, mask)
                        g, _ = NG.backward(cache, cur, lam * d / len(un))
                        gu = NG.grad_vector(cur, g)
                        total = gu if total is None else total + gu
                        lsum += lam * l / len(un)
                        aux += [float(mask.sum()), 0.0, l / len(un), 0.0, 1.0, len(un)]
                        cur = NG.update_moving(cur, cache)
                    if total is None or not np.all(np.isfinite(total)) or not np.isfinite(lsum):
                        continue   # a NaN step is skipped
                    g = clip(project(total, bs), clip_norm)
                    vel = 0.9 * vel - lr * g
                    w = w + 0.9 * vel - lr * g
                    cur = NG.unflatten(w, cur)
                    loss, n = loss + lsum * len(b), n + len(b)
            if n:
                delta = np.concatenate([w - start, NG.flatten(cur, NG.MOVING) - mstart])
                yield _emit(delta * n, loss, n, aux)

        parts = mixed.select(*cols).mapInPandas(run, SCHEMA)
        dsum, l, n, aux = _reduce(parts, len(w0) + len(m0))
        if n:
            net = NG.unflatten(w0 + dsum[:len(w0)] / n, net)
            net = NG.unflatten(m0 + dsum[len(w0):] / n, net, NG.MOVING)
        hist.append(_history(ep, l, n, aux))
    return net, hist


def train_autoencoder_net_local(df: DataFrame, x: str, net: list[dict], epochs: int = 20, lr: float = 1e-3,
                                batch_size: int = 256, seed: int = 0):
    """TR4 on the reference autoencoder layout: reconstruction MSE with
    mini-batch Adam steps inside each task (batch statistics), weights and
    moving statistics averaged by row count after every epoch."""
    from flowlab.operators import netgrad as NG
    data = df.select(F.col(x).alias("_x")).withColumn("_o", F.rand(seed)).sortWithinPartitions("_o").drop("_o")
    hist = []
    for ep in range(epochs):
        w0, m0 = NG.flatten(net), NG.flatten(net, NG.MOVING)
        bc = df.sparkSession.sparkContext.broadcast((w0, m0, net))

        def run(it):
            start, mstart, like = bc.value
            w = start.copy()
            cur = NG.unflatten(mstart, NG.unflatten(w, like), NG.MOVING)
            opt = Adam(lr)
            loss = n = 0.0
            for pdf in it:
                for i in range(0, len(pdf), batch_size):
                    v = _stack(pdf.iloc[i:i + batch_size], "_x")
                    if len(v) < 2:
                        continue
                    out, cache = NG.forward(v, cur, True)
                    l, d = mse_grad(out, v)
                    g, _ = NG.backward(cache, cur, d / len(v))
                    gv = NG.grad_vector(cur, g)
                    if not np.all(np.isfinite(gv)):
                        continue
                    cur = NG.update_moving(cur, cache)
                    w = opt.step(w, gv)
                    cur = NG.unflatten(w, cur)
                    loss, n = loss + l, n + len(v)
            if n:
                delta = np.concatenate([w - start, NG.flatten(cur, NG.MOVING) - mstart])
                yield _emit(delta * n, loss, n, 0.0)

        dsum, l, n, _ = _reduce(data.mapInPandas(run, SCHEMA), len(w0) + len(m0))
        if n:
            net = NG.unflatten(m0 + dsum[len(w0):] / n, NG.unflatten(w0 + dsum[:len(w0)] / n, net), NG.MOVING)
        hist.append(l / max(n, 1.0))
    return net, hist


def _history(epoch: int, loss_sum: float, n: float, aux: np.ndarray) -> dict[str, float]:
    """AG22 row from summed batch statistics: mean supervised and
    consistency losses over the batches that had them, mean total loss per
    row, mask rate over unlabeled rows."""
    a = np.zeros(6)
    a[:len(aux)] = aux[:6]
    nan = float("nan")
    return {"epoch": epoch, "loss_s": a[1] / a[3] if a[3] else nan, "loss_u": a[2] / a[4] if a[4] else nan,
            "total_loss": loss_sum / max(n, 1.0), "mask_rate": a[0] / a[5] if a[5] else 0.0}


def softmax_mse_grad(z, q):
    """sum over rows of mean_c (softmax(z) - q)^2 and its gradient."""
    p = softmax(z)
    c = p.shape[1]
    diff = p - q
    loss = float((diff ** 2).sum() / c)
    g = 2.0 * diff / c
    dz = p * (g - (p * g).sum(axis=1, keepdims=True))
    return loss, dz


def sharpen_np(p, t=0.5):
    e = p ** (1.0 / t)
    return e / e.sum(axis=1, keepdims=True)


def train_mixmatch(df: DataFrame, x: str, y: str, sizes: list[int], unlabeled: DataFrame, weak: str, strong: str,
                   epochs: int = 10, lr: float = 0.03, lambda_u: float = 1.0, temperature: float = 0.5,
                   n_classes: int = 2, seed: int = 0, bases: list[np.ndarray] | None = None):
    """TR3: CE on one-hot labeled rows + lambda * MSE between unlabeled
    probabilities and sharpened pseudo labels from the averaged two views
    (pseudo labels carry no gradient).  Returns weights and history."""
    layers = init(sizes, seed)
    opt = NesterovSGD(lr)

    def sup(pdf, params):
        z, acts = forward(_stack(pdf, x), params)
        l, d = ce_grad(z, pdf[y].to_numpy().astype(int))
        g, _ = backward(acts, params, d)
        return flatten(g), l, len(pdf), 0.0

    def unsup(pdf, params):
        xw, xs = _stack(pdf, weak), _stack(pdf, strong)
        za, _ = forward((xw + xs) / 2.0, params)
        q = sharpen_np(softmax(za), temperature)
        z, acts = forward(xw, params)
        l, d = softmax_mse_grad(z, q)
        g, _ = backward(acts, params, d)
        return flatten(g), l, len(pdf), 0.0

    w, hist = flatten(layers), []
    for ep in range(epochs):
        gs, ls, ns, _ = gradient_pass(df, [x, y], layers, sup)
        gu, lu, nu, _ = gradient_pass(unlabeled, [weak, strong], layers, unsup)
        g = gs / max(ns, 1.0) + lambda_u * gu / max(nu, 1.0)
        loss_s, loss_u = ls / max(ns, 1.0), lu / max(nu, 1.0)
        if np.all(np.isfinite(g)):
            w = opt.step(w, project(g, bases))
            layers = unflatten(w, layers)
        hist.append({"epoch": ep, "loss_s": loss_s, "loss_u": loss_u, "total_loss": loss_s + lambda_u * loss_u,
                     "mask_rate": 1.0})
    return layers, hist


def train_contrastive_net_local(pairs: DataFrame, encoder: list[dict], projection: list[dict], epochs: int = 10,
                                lr: float = 3e-4, temperature: float = 0.1, enc_dropout: float = 0.1, seed: int = 0):
    """TR1 on the reference layouts (encoder: [Dense relu, BN, Dropout] x 2 +
    linear; projection: Dense relu, BN, linear) with batch statistics:
    whole contrastive batches per task, one Adam step per batch, weight and
    moving-statistic changes averaged by batch count."""
    from flowlab.operators import netgrad as NG
    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    data = pairs.select("batch_id", "pos", "v1", "v2").repartition(parts, "batch_id").sortWithinPartitions(
        "batch_id", "pos")
    enc_rates = [enc_dropout if "gamma" in L else 0.0 for L in encoder]
    hist = []
    for ep in range(epochs):
        we, wp = NG.flatten(encoder), NG.flatten(projection)
        me, mp = NG.flatten(encoder, NG.MOVING), NG.flatten(projection, NG.MOVING)
        start = np.concatenate([we, wp, me, mp])
        bc = pairs.sparkSession.sparkContext.broadcast((start, encoder, projection))

        def run(it, ep=ep):
            from pyspark import TaskContext
            w0, e_like, p_like = bc.value
            rng = np.random.default_rng([seed, ep, TaskContext.get().partitionId()])
            ne, npj = len(NG.flatten(e_like)), len(NG.flatten(p_like))
            nme = len(NG.flatten(e_like, NG.MOVING))
            w = w0[:ne + npj].copy()
            enc = NG.unflatten(w0[ne + npj:ne + npj + nme], NG.unflatten(w[:ne], e_like), NG.MOVING)
            prj = NG.unflatten(w0[ne + npj + nme:], NG.unflatten(w[ne:], p_like), NG.MOVING)
            opt = Adam(lr)
            loss_sum, nb, buf = 0.0, 0, []

            def step(rows):
                nonlocal w, enc, prj, loss_sum, nb
                pdf = pd.concat(rows)
                if len(pdf) < 2:
                    return
                h1, c1 = NG.forward(_stack(pdf, "v1"), enc, True, rng, enc_rates)
                h2, c2 = NG.forward(_stack(pdf, "v2"), enc, True, rng, enc_rates)
                z1, q1 = NG.forward(h1, prj, True)
                z2, q2 = NG.forward(h2, prj, True)
                loss, d1, d2 = nt_xent_grad(z1, z2, temperature)
                gp1, dh1 = NG.backward(q1, prj, d1)
                gp2, dh2 = NG.backward(q2, prj, d2)
                ge1, _ = NG.backward(c1, enc, dh1)
                ge2, _ = NG.backward(c2, enc, dh2)
                g = np.concatenate([NG.grad_vector(enc, ge1) + NG.grad_vector(enc, ge2),
                                    NG.grad_vector(prj, gp1) + NG.grad_vector(prj, gp2)])
                if not np.all(np.isfinite(g)):
                    return
                for c in (c1, c2):
                    enc = NG.update_moving(enc, c)
                for q in (q1, q2):
                    prj = NG.update_moving(prj, q)
                w = opt.step(w, g)
                enc, prj = NG.unflatten(w[:ne], enc), NG.unflatten(w[ne:], prj)
                loss_sum, nb = loss_sum + loss, nb + 1

            for pdf in it:
                for bid, grp in pdf.groupby("batch_id", sort=False):
                    if buf and buf[0]["batch_id"].iloc[0] != bid:
                        step(buf)
                        buf = []
                    buf.append(grp)
            if buf:
                step(buf)
            if nb:
                now = np.concatenate([w, NG.flatten(enc, NG.MOVING), NG.flatten(prj, NG.MOVING)])
                yield _emit((now - w0) * nb, loss_sum, nb, 0.0)

        dsum, loss, nb, _ = _reduce(data.mapInPandas(run, SCHEMA), len(start))
        if nb:
            new = start + dsum / nb
            ne, npj, nme = len(we), len(wp), len(me)
            encoder = NG.unflatten(new[ne + npj:ne + npj + nme], NG.unflatten(new[:ne], encoder), NG.MOVING)
            projection = NG.unflatten(new[ne + npj + nme:], NG.unflatten(new[ne:ne + npj], projection), NG.MOVING)
        hist.append(loss / max(nb, 1.0))
    return encoder, projection, hist


def capture_gradients(df: DataFrame, x: str, y: str, layers, batch: str = "batch_id",
                      weight: str | None = None) -> DataFrame:
    """TR5: one flattened loss gradient per ``batch`` group (bounded by the
    batch size) -> ``grad(batch_id, vec)`` for LA0/LA1."""
    bc = df.sparkSession.sparkContext.broadcast(layers)
    cols = [batch, x, y] + ([weight] if weight else [])

    def per_batch(pdf):
        ls = bc.value
        z, acts = forward(_stack(pdf, x), ls)
        yy = pdf[y].to_numpy().astype(int)
        _, d = ce_grad(z, yy, pdf[weight].to_numpy() if weight else None)
        g, _ = backward(acts, ls, d / len(pdf))
        return pd.DataFrame({"batch_id": [int(pdf[batch].iloc[0])], "vec": [flatten(g).tolist()]})

    return df.select(*cols).groupBy(batch).applyInPandas(per_batch, "batch_id long, vec array<double>")


def capture_gradients_net(df: DataFrame, x: str, y: str, net: list[dict], batch: str = "batch_id",
                          weight: str | None = None) -> DataFrame:
    """TR5 for layer-spec networks: one flattened gradient of the trainable
    weights per ``batch`` group (batch-norm on the batch's statistics,
    dropout off)."""
    from flowlab.operators import netgrad as NG
    bc = df.sparkSession.sparkContext.broadcast(net)
    cols = [batch, x, y] + ([weight] if weight else [])

    def per_batch(pdf):
        nn = bc.value
        z, cache = NG.forward(_stack(pdf, x), nn, training=len(pdf) > 1)
        _, d = ce_grad(z, pdf[y].to_numpy().astype(int), pdf[weight].to_numpy() if weight else None)
        g, _ = NG.backward(cache, nn, d / len(pdf))
        return pd.DataFrame({"batch_id": [int(pdf[batch].iloc[0])], "vec": [NG.grad_vector(nn, g).tolist()]})

    return df.select(*cols).groupBy(batch).applyInPandas(per_batch, "batch_id long, vec array<double>")


def numeric_gradient_check(f: Callable[[np.ndarray], float], w: np.ndarray, g: np.ndarray, eps=1e-6,
                           idx=None) -> float:
    """Max relative error between analytic ``g`` and central differences."""
    idx = range(len(w)) if idx is None else idx
    err = 0.0
    for i in idx:
        e = np.zeros_like(w)
        e[i] = eps
        num = (f(w + e) - f(w - e)) / (2 * eps)
        err = max(err, abs(num - g[i]) / max(1e-8, abs(num) + abs(g[i])))
    return err


def history_frame(spark, task: str, hist: list[dict[str, float]]) -> DataFrame:
    f = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(task, int(h["epoch"]), f(h["loss_s"]), f(h["loss_u"]), f(h["total_loss"]),
                                   f(h["mask_rate"])) for h in hist], "task string, epoch int, loss_s double, loss_u double, "
                                                  "total_loss double, mask_rate double")


def predict(df: DataFrame, x: str, layers, keep: list[str], out: str = "logits") -> DataFrame:
    """Apply trained dense layers per Arrow batch."""
    bc = df.sparkSession.sparkContext.broadcast(layers)

    def run(it):
        ls = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            z, _ = forward(_stack(pdf, x), ls)
            o = pdf[keep].copy()
            o[out] = list(z)
            yield o

    schema = df.select(*keep).schema.simpleString()[len("struct<"):-1]
    cols = keep + ([x] if x not in keep else [])
    return df.select(*cols).mapInPandas(run, f"{schema},{out} array<double>")


def f1_binary(df: DataFrame, y: str, logits: str) -> float:
    p = df.select(F.col(y).alias("y"), (F.col(logits)[1] > F.col(logits)[0]).cast("int").alias("yp"))
    r = p.agg(F.sum(F.col("y") * F.col("yp")).alias("tp"), F.sum((1 - F.col("y")) * F.col("yp")).alias("fp"),
              F.sum(F.col("y") * (1 - F.col("yp"))).alias("fn")).first()
    den = 2 * (r["tp"] or 0) + (r["fp"] or 0) + (r["fn"] or 0)
    return 0.0 if den == 0 else 2 * (r["tp"] or 0) / den
