"""Model parameters and forward passes applied on executors (MO1-MO5, IO11).

Parameters live in a table ``model_params(model, name, shape, data)`` and
are broadcast once per job; forward passes run per Arrow batch in
``mapInPandas`` with NumPy matmuls (inference mode: batch-norm by moving
statistics, dropout off).  Fixed test heads take md5-generated weights so
DuckDB can reproduce their logits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions import arrays as A

# The named heads in routing order.
HEADS = ["dos", "port_scan", "exfiltration", "intrusion"]


def md5_uniform(*parts) -> float:
    h = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(h[:13], 16) / float(2 ** 52)


def md5_normal(*parts) -> float:
    u1 = (int(hashlib.md5("|".join(str(p) for p in (*parts, "a")).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
    u2 = md5_uniform(*parts, "b")
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)


def linear_head_weights(head: str, dim: int, n_classes: int = 2, scale: float = 1.0, seed: int = 7) -> np.ndarray:
    """(n_classes, dim) deterministic weights for a fixed linear head."""
    return np.array([[scale * md5_normal(seed, head, c, d) for d in range(dim)] for c in range(n_classes)])


def linear_logits(vec: Column, w: np.ndarray) -> Column:
    """Logits of a linear head with inlined weights (bounded: classes x dim)."""
    return F.array(*[A.dot(vec, F.array(*[F.lit(float(x)) for x in row])) for row in w])


def sql_linear_logits(vec_sql: str, w: np.ndarray) -> str:
    rows = []
    for row in w:
        lst = "[" + ", ".join(f"CAST('{float(x)!r}' AS DOUBLE)" for x in row) + "]"
        rows.append(f"list_reduce(list_transform({vec_sql}, lambda x, i: CAST(x AS DOUBLE) * ({lst})[i]), "
                    f"lambda a, b: a + b)")
    return "[" + ", ".join(rows) + "]"


# ------------------------------------------------------------ MLP forward





def params_table(spark: SparkSession, model: str, net: list[dict]) -> DataFrame:
    """IO11: one row per tensor of a layer-spec network:
    (model, ord, name, shape, data); layer flags travel as a 0/1 tensor."""
    rows = []
    for i, L in enumerate(net):
        for k in ("W", "b", "gamma", "beta", "mean", "var"):
            if k in L:
                a = np.asarray(L[k], dtype=np.float64)
                rows.append((model, i, k, list(a.shape), a.ravel().tolist()))
        flags = [1.0 if L.get("act") == "relu" else 0.0, 1.0 if L.get("save") else 0.0, 1.0 if L.get("add") else 0.0]
        rows.append((model, i, "flags", [3], flags))
    return spark.createDataFrame(rows, "model string, ord int, name string, shape array<int>, data array<double>")


def layers_from_table(df: DataFrame, model: str) -> list[dict]:
    """IO11 load: the network written by :func:`params_table` (bounded:
    one model's tensors)."""
    rows = df.where(F.col("model") == model).collect()
    n = max(r["ord"] for r in rows) + 1
    net: list[dict] = [{} for _ in range(n)]
    for r in rows:
        a = np.asarray(r["data"], dtype=np.float64).reshape(r["shape"])
        if r["name"] == "flags":
            net[r["ord"]].update({"act": "relu" if a[0] else None, "save": bool(a[1]), "add": bool(a[2])})
        else:
            net[r["ord"]][r["name"]] = a
    return net




# ------------------------------------------------ reference architectures
# Layer specs: dense (W, b), activation, optional batch-norm (inference
# statistics), ``save`` marks a residual source, ``add`` adds it back.

BN_EPS = 1e-3


def _dense(rng, a: int, b: int, act: str | None, bn: bool, save: bool = False, add: bool = False) -> dict:
    layer = {"W": rng.normal(0, math.sqrt(2.0 / a), (a, b)), "b": np.zeros(b), "act": act, "save": save, "add": add}
    if bn:
        layer.update({"gamma": np.ones(b), "beta": np.zeros(b), "mean": np.zeros(b), "var": np.ones(b)})
    return layer


def flow_encoder(input_dim: int, hidden: int = 512, embed: int = 256, seed: int = 0) -> list[dict]:
    """MO1: [Dense(hidden) relu, BN, Dropout] x 2, Dense(embed) linear."""
    rng = np.random.default_rng(seed)
    return [_dense(rng, input_dim, hidden, "relu", True), _dense(rng, hidden, hidden, "relu", True),
            _dense(rng, hidden, embed, None, False)]


def projection_head(in_dim: int = 256, out_dim: int = 128, seed: int = 0) -> list[dict]:
    """MO2: Dense(in_dim) relu, BN, Dense(out_dim) linear."""
    rng = np.random.default_rng(seed)
    return [_dense(rng, in_dim, in_dim, "relu", True), _dense(rng, in_dim, out_dim, None, False)]


def classifier_head(embed_dim: int = 256, n_classes: int = 2, seed: int = 0) -> list[dict]:
    """MO3: Dense128 relu+BN (+dropout) -> residual Dense128 relu+BN block
    -> Dense64 relu+BN -> logits."""
    rng = np.random.default_rng(seed)
    return [_dense(rng, embed_dim, 128, "relu", True, save=True), _dense(rng, 128, 128, "relu", True, add=True),
            _dense(rng, 128, 64, "relu", True), _dense(rng, 64, n_classes, None, False)]


def autoencoder(embed: int = 256, latent: int = 64, seed: int = 0) -> list[dict]:
    """MO5: 256 -> 128 (relu, BN) -> 64 (relu) -> 128 (relu, BN) -> 256."""
    rng = np.random.default_rng(seed)
    return [_dense(rng, embed, 128, "relu", True), _dense(rng, 128, latent, "relu", False),
            _dense(rng, latent, 128, "relu", True), _dense(rng, 128, embed, None, False)]


def trainable_params(net: list[dict]) -> int:
    return int(sum(L["W"].size + L["b"].size + (L["gamma"].size + L["beta"].size if "gamma" in L else 0)
                   for L in net))


def net_forward(x: np.ndarray, net: list[dict]) -> np.ndarray:
    """Inference forward pass (dropout off, BN with moving statistics)."""
    h, saved = x, None
    for L in net:
        h = h @ L["W"] + L["b"]
        if L.get("act") == "relu":
            h = np.maximum(h, 0.0)
        if "gamma" in L:
            h = (h - L["mean"]) / np.sqrt(L["var"] + BN_EPS) * L["gamma"] + L["beta"]
        if L.get("add"):
            h = h + saved
        if L.get("save"):
            saved = h
    return h


def arrow_matrix(col) -> np.ndarray:
    """A list<double> Arrow column of equal-length rows as an (n, d) matrix
    (no per-row Python objects)."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def arrow_lists(m: np.ndarray):
    """(n, d) matrix -> list<double> Arrow array."""
    import pyarrow as pa
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), type=pa.float64()))


def apply_nets(df: DataFrame, vec: str, nets: dict[str, list[dict]], keep: list[str],
               encoder: list[dict] | None = None) -> DataFrame:
    """Encoder (optional) then every named net on the embedding, one pass
    per Arrow batch with all parameters broadcast once; one output column
    per net (``<name>``) plus ``embedding`` when an encoder is given.
    Runs on Arrow record batches directly (``mapInArrow``): the feature
    column becomes one NumPy matrix per batch."""
    import pyarrow as pa
    bc = df.sparkSession.sparkContext.broadcast((encoder, nets))
    names = list(nets)

    def run(it):
        enc, ns = bc.value
        for rb in it:
            if rb.num_rows == 0:
                continue
            x = arrow_matrix(rb.column(rb.schema.get_field_index(vec)))
            z = net_forward(x, enc) if enc is not None else x
            arrays = [rb.column(rb.schema.get_field_index(k)) for k in keep]
            fields = list(keep)
            if enc is not None:
                arrays.append(arrow_lists(z))
                fields.append("embedding")
            for name in names:
                arrays.append(arrow_lists(net_forward(z, ns[name])))
                fields.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    fields = [df.select(*keep).schema.simpleString()[len("struct<"):-1]] if keep else []
    fields += (["embedding array<double>"] if encoder is not None else []) + [f"`{n}` array<double>" for n in names]
    cols = keep + ([vec] if vec not in keep else [])
    src = df.select(*cols).withColumn(vec, F.col(vec).cast("array<double>"))
    return src.mapInArrow(run, ",".join(fields))


def from_dense(layers: list[dict[str, np.ndarray]]) -> list[dict]:
    """Dense+ReLU layers (training format) -> layer specs for ``apply_nets``."""
    n = len(layers)
    return [{"W": L["W"], "b": L["b"], "act": "relu" if i < n - 1 else None} for i, L in enumerate(layers)]
