"""Training-mode forward / backward for the layer specs of
``operators.models`` (Dense, ReLU, batch-norm with batch statistics,
dropout, residual add), used inside executor tasks by the local-SGD jobs.

Trainable parameters are W, b, gamma, beta; the moving mean / variance are
updated from each mini-batch (momentum 0.99) and averaged across tasks
like the weights.
"""

from __future__ import annotations

import numpy as np

from flowlab.operators.models import BN_EPS

TRAINABLE = ("W", "b", "gamma", "beta")
MOVING = ("mean", "var")
BN_MOMENTUM = 0.99


def flatten(net: list[dict], keys=TRAINABLE) -> np.ndarray:
    parts = [np.asarray(L[k], dtype=np.float64).ravel() for L in net for k in keys if k in L]
    return np.concatenate(parts) if parts else np.zeros(0)


def unflatten(vec: np.ndarray, like: list[dict], keys=TRAINABLE) -> list[dict]:
    out, o = [], 0
    for L in like:
        new = dict(L)
        for k in keys:
            if k in L:
                n = np.asarray(L[k]).size
                new[k] = vec[o:o + n].reshape(np.asarray(L[k]).shape)
                o += n
        out.append(new)
    return out


def forward(x: np.ndarray, net: list[dict], training: bool, rng: np.random.Generator | None = None,
            dropout: list[float] | None = None):
    """Returns (output, cache).  ``dropout[i]`` is layer i's rate (training)."""
    cache = []
    h, saved = x, None
    for i, L in enumerate(net):
        c = {"in": h}
        z = h @ L["W"] + L["b"]
        c["pre"] = z
        a = np.maximum(z, 0.0) if L.get("act") == "relu" else z
        if "gamma" in L:
            if training:
                mu, var = a.mean(axis=0), a.var(axis=0)
                c["mu"], c["var"] = mu, var
            else:
                mu, var = L["mean"], L["var"]
            inv = 1.0 / np.sqrt(var + BN_EPS)
            hn = (a - mu) * inv
            c["hn"], c["inv"] = hn, inv
            a = hn * L["gamma"] + L["beta"]
        p = (dropout[i] if dropout else 0.0) if training else 0.0
        if p > 0:
            mask = (rng.random(a.shape) >= p) / (1.0 - p)
            c["mask"] = mask
            a = a * mask
        if L.get("add"):
            a = a + saved
        if L.get("save"):
            saved = a
        h = a
        cache.append(c)
    return h, cache


def backward(cache: list[dict], net: list[dict], dout: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """Gradients of W, b, gamma, beta for every layer and d/dinput."""
    grads: list[dict] = [dict() for _ in net]
    d = dout
    d_skip = None
    for i in range(len(net) - 1, -1, -1):
        L, c = net[i], cache[i]
        if L.get("save") and d_skip is not None:
            d = d + d_skip
            d_skip = None
        if L.get("add"):
            d_skip = d
        if "mask" in c:
            d = d * c["mask"]
        if "gamma" in L:
            hn, inv = c["hn"], c["inv"]
            grads[i]["gamma"] = (d * hn).sum(axis=0)
            grads[i]["beta"] = d.sum(axis=0)
            dhn = d * L["gamma"]
            if "mu" in c:   # batch statistics: gradient flows through mean and variance
                n = d.shape[0]
                d = inv / n * (n * dhn - dhn.sum(axis=0) - hn * (dhn * hn).sum(axis=0))
            else:
                d = dhn * inv
        if L.get("act") == "relu":
            d = d * (c["pre"] > 0)
        grads[i]["W"] = c["in"].T @ d
        grads[i]["b"] = d.sum(axis=0)
        d = d @ L["W"].T
    return grads, d


def update_moving(net: list[dict], cache: list[dict], momentum: float = BN_MOMENTUM) -> list[dict]:
    out = []
    for L, c in zip(net, cache):
        new = dict(L)
        if "gamma" in L and "mu" in c:
            new["mean"] = momentum * L["mean"] + (1 - momentum) * c["mu"]
            new["var"] = momentum * L["var"] + (1 - momentum) * c["var"]
        out.append(new)
    return out


def grad_vector(net: list[dict], grads: list[dict]) -> np.ndarray:
    """Flatten gradients in the same order as :func:`flatten`."""
    parts = [np.asarray(g[k], dtype=np.float64).ravel() for L, g in zip(net, grads) for k in TRAINABLE if k in L]
    return np.concatenate(parts)
