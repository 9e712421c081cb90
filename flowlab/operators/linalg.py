"""Gradient-memory linear algebra on tables (LA0-LA2, AG24-AG25).

Gradient rows are split into blocks of the parameter axis: the Gram matrix is
a sum of per-block partial Grams, the basis comes block by block from one
randomised pass over the rows, and projection joins rows to the basis on
``block_id``.  Only width x width and k x k matrices reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.session import cut

MAX_ROWS = 512        # fixed value: usual cap of a capture, for callers that want one
MIN_NORM = 1e-12      # fixed value: rows at or below this norm are dropped
ENERGY = 0.97         # fixed value: captured energy of the basis


def valid_gradient(vec: Column) -> Column:
    """LA0 predicate: finite everywhere and norm > 1e-12."""
    finite = ~F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return finite & (A.norm(vec) > F.lit(MIN_NORM))


def filter_gradients(df: DataFrame, vec: str, order: str, max_rows: int = 0) -> DataFrame:
    """LA0: drop invalid rows.  A caller may cap the capture to the first
    ``max_rows`` valid rows by ``order``; 0, the default, keeps all."""
    ok = df.where(valid_gradient(F.col(vec)))
    return ok.orderBy(order).limit(max_rows) if max_rows else ok


def to_blocks(df: DataFrame, row_id: str, vec: str, block: int) -> DataFrame:
    """(row_id, vec[D]) -> (row_id, block_id, sub[<= block])."""
    nb = F.ceil(F.size(vec) / F.lit(block)).cast("int")
    b = df.select(row_id, vec, F.explode(F.sequence(F.lit(0), nb - 1)).alias("block_id"))
    return b.select(row_id, "block_id", F.slice(vec, F.col("block_id") * block + 1, F.lit(block)).alias("sub"))


ROWS_TOGETHER = 256   # gradient rows of one part of a block


def gram(blocks: DataFrame, row_id: str = "row_id", n_rows: int | None = None) -> DataFrame:
    """G G^T as ``(i, j, value)``: partial Grams summed by Spark.  The rows of
    a block are dealt into parts of about ROWS_TOGETHER, and every two parts
    meet in one bounded group, so no group grows with the number of rows."""
    n_rows = n_rows if n_rows is not None else blocks.select(row_id).distinct().count()
    parts = max(1, math.ceil(n_rows / ROWS_TOGETHER))

    def partial(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["sub"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        ids, part = pdf[row_id].to_numpy(), pdf["_part"].to_numpy()
        left, right = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
        g = x[left] @ x[right].T
        i, j = (a.ravel() for a in np.meshgrid(ids[left], ids[right], indexing="ij"))
        if key[1] == key[2]:
            return pd.DataFrame({"i": i, "j": j, "value": g.ravel()})
        return pd.DataFrame({"i": np.concatenate([i, j]), "j": np.concatenate([j, i]), "value": np.tile(g.ravel(), 2)})

    dealt = blocks.withColumn("_part", F.pmod(F.xxhash64(row_id), F.lit(parts)))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    met = met.select("block_id", F.least("_part", "_other").alias("_x"), F.greatest("_part", "_other").alias("_y"), "_part",
                     row_id, "sub")
    p = met.groupBy("block_id", "_x", "_y").applyInPandas(partial, "i long, j long, value double")
    return p.groupBy("i", "j").agg(F.sum("value").alias("value"))


RANGE_WIDTH = 64            # width of the first random range; doubled until it holds the energy
FACTORS_KEPT = 1 << 24      # numbers of random factors, and of partial products, that a task keeps


def random_factor(block_id: int, size: int, width: int) -> np.ndarray:
    """Rows ``block_id`` of Omega: normal numbers from a counter, the same in every task."""
    seed = int.from_bytes(hashlib.md5(f"omega|{block_id}|{width}".encode()).digest()[:8], "little")
    return np.random.default_rng(seed).standard_normal((size, width))


def svd_basis(df: DataFrame, row_id: str, vec: str, threshold: float = ENERGY, block: int = 4096,
              width: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """LA1: energy-truncated orthonormal basis of the row space of G (N x D).

    Returns ``(basis(component, block_id, vec), singular values kept)``: the
    fewest components of the range found whose energy is ``threshold`` of all.

    Randomised range finder, one algorithm for any N and D: Y = G Omega spans
    a range of ``width`` directions (Omega from a counter), Y = Q R, and the
    decomposition of B = Q' G is that of G inside the range.  R needs only
    Y'Y and B only Y'G, so one scan adds up Z = Y'G, block by block of the
    parameters; Y'Y = Z Omega.  Width x width matrices reach the driver.  The
    range is doubled until what it misses is a tenth of what may be dropped
    (or it has min(N, D) directions and is exact).  Rows must be finite
    (``filter_gradients``); no energy gives an empty basis.  Raises when the
    energy isn't reached."""
    spark = df.sparkSession
    x = F.col(vec).cast("array<double>")
    stats = df.select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("e"),
                                        F.sum(A.dot(F.col("x"), F.col("x"))).alias("energy")).first()
    n_rows, dim, total = int(stats["n"] or 0), int(stats["d"] or 0), float(stats["energy"] or 0.0)
    empty = spark.createDataFrame([], "component int, block_id int, vec array<double>")
    if not math.isfinite(total):
        raise ValueError("rows with NaN or infinite numbers have no basis")
    if n_rows and stats["e"] != dim:
        raise ValueError(f"rows of {stats['e']} and of {dim} numbers")
    if total <= 0.0:
        return empty, np.zeros(0)
    most = min(n_rows, dim)
    l = min(width or RANGE_WIDTH, most)
    while True:
        z = cut(_range_product(df.select(x.alias("x")), dim, l, block))
        s, rotate = _decompose(*_range_grams(z, l, block))
        held = float(np.sum(s ** 2))
        if l == most or held >= (1 - (1 - threshold) / 10) * total:
            break
        l = min(2 * l, most)
    enough = threshold * total * (1 - 1e-9)
    if held < enough:
        raise ValueError(f"a range of {l} directions holds {held / total:.6f} of the energy, {threshold} is asked for")
    k = min(int(np.searchsorted(np.cumsum(s ** 2), enough)) + 1, len(s))
    turned = spark.sparkContext.broadcast(rotate[:, :k])

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        u = _stacked(pdf).T @ turned.value
        return pd.DataFrame({"component": np.arange(u.shape[1], dtype=np.int32), "block_id": int(pdf["block_id"].iloc[0]),
                             "vec": list(u.T)})

    ub = cut(z.groupBy("block_id").applyInPandas(components, "component int, block_id int, vec array<double>"))
    # rounding: components are made orthonormal once more (Cholesky-QR, k x k)
    inverse = spark.sparkContext.broadcast(np.linalg.inv(np.linalg.cholesky(_component_gram(ub)).T))

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        return pd.DataFrame({"component": pdf["component"].to_numpy(), "block_id": pdf["block_id"].to_numpy(),
                             "vec": list((_stacked(pdf).T @ inverse.value).T)})

    return ub.groupBy("block_id").applyInPandas(fix, "component int, block_id int, vec array<double>"), s[:k]


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    """The vectors of one block, by component."""
    return np.stack(pdf.sort_values("component")["vec"].map(np.asarray).to_numpy())


def _range_product(rows: DataFrame, dim: int, width: int, block: int) -> DataFrame:
    """Z = (G Omega)' G as ``(component, block_id, vec)``: products of Arrow
    batches, added up in the task and then by Spark.  A task keeps at most
    FACTORS_KEPT random factors and partial sums; beyond that it draws the
    factors again and passes the products on batch by batch."""
    spans = [(b, b * block, min((b + 1) * block, dim)) for b in range(math.ceil(dim / block))]
    keep = dim * width <= FACTORS_KEPT

    def run(batches):
        factors, sums = {}, {}

        def factor(b, lo, hi):
            if b in factors:
                return factors[b]
            out = random_factor(b, hi - lo, width)
            if keep:
                factors[b] = out
            return out

        def product(b, z):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, b, np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))],
                ["component", "block_id", "vec"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            y = sum(g[:, lo:hi] @ factor(b, lo, hi) for b, lo, hi in spans)
            for b, lo, hi in spans:
                z = y.T @ g[:, lo:hi]
                if keep:
                    sums[b] = sums[b] + z if b in sums else z
                else:
                    yield product(b, z)
        for b, z in sums.items():
            yield product(b, z)

    parts = rows.mapInArrow(run, "component int, block_id int, vec array<double>")
    added = parts.select("component", "block_id", F.posexplode("vec").alias("i", "v")).groupBy("component", "block_id", "i").agg(
        F.sum("v").alias("v"))
    return added.groupBy("component", "block_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(
        "component", "block_id", F.transform("s", lambda e: e["v"]).alias("vec"))


def _range_grams(z: DataFrame, width: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Z Omega and Z Z' (width x width): products of the blocks, summed by Spark."""
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _stacked(pdf)
        omega = random_factor(int(pdf["block_id"].iloc[0]), v.shape[1], width)
        return pd.DataFrame({"component": np.arange(width, dtype=np.int32), "yy": list(v @ omega), "zz": list(v @ v.T)})

    parts = z.groupBy("block_id").applyInPandas(partial, "component int, yy array<double>, zz array<double>")
    rows = parts.select("component", F.posexplode(F.arrays_zip("yy", "zz")).alias("i", "v")).groupBy("component", "i").agg(
        F.sum("v.yy").alias("yy"), F.sum("v.zz").alias("zz")).collect()
    yy, zz = np.zeros((width, width)), np.zeros((width, width))
    for r in rows:
        yy[r["component"], r["i"]], zz[r["component"], r["i"]] = r["yy"], r["zz"]
    return yy, zz


def _decompose(yy: np.ndarray, zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of B = Q'G, and what turns Z into its right singular
    vectors.  Q = Y C with C = W L^-1/2 of Y'Y = W L W', without directions
    that rounding can't tell from none."""
    w, v = np.linalg.eigh((yy + yy.T) / 2)
    told = w > 1e-11 * w[-1]
    c = v[:, told] / np.sqrt(w[told])
    e, u = np.linalg.eigh(c.T @ zz @ c)
    order = np.argsort(e)[::-1]
    e, u = e[order], u[:, order]
    some = e > 1e-24 * e[0]
    s = np.sqrt(e[some])
    return s, c @ u[:, some] / s


def _component_gram(basis: DataFrame) -> np.ndarray:
    """U^T U for a blocked basis: per-block k x k partials summed by Spark."""

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        u = np.stack(pdf["vec"].map(np.asarray).to_numpy())
        g = u @ u.T
        c = pdf["component"].to_numpy()
        ii, jj = np.meshgrid(c, c, indexing="ij")
        return pd.DataFrame({"a": ii.ravel(), "b": jj.ravel(), "value": g.ravel()})

    p = basis.groupBy("block_id").applyInPandas(partial, "a int, b int, value double")
    rows = p.groupBy("a", "b").agg(F.sum("value").alias("value")).collect()
    k = max(max(r["a"], r["b"]) for r in rows) + 1
    m = np.zeros((k, k))
    for r in rows:
        m[r["a"], r["b"]] = r["value"]
    return m


def spectrum(s: np.ndarray) -> list[tuple[int, float, float, float]]:
    """AG25 data: (component, sigma, sigma / max, cumulative energy)."""
    if s.size == 0:
        return []
    e = np.cumsum(s ** 2) / np.sum(s ** 2)
    return [(i, float(v), float(v / s.max()), float(e[i])) for i, v in enumerate(s)]


# ------------------------------------------------------------- projection

def walsh_basis(dim: int, rows: list[int]) -> np.ndarray:
    """Orthonormal columns b_k[d] = (-1)^popcount(k & d) / sqrt(dim)."""
    d = np.arange(dim)
    cols = [np.array([(-1) ** bin(k & int(x)).count("1") for x in d], dtype=np.float64) / math.sqrt(dim)
            for k in rows]
    return np.stack(cols, axis=1)


def project_frame(df: DataFrame, vec: str, bases: list[np.ndarray], out_col: str = "projected",
                  mode: str = "sequential") -> DataFrame:
    """LA2 for small D: g <- g - B (B^T g) with the bases inlined (bounded:
    D x k literals).  ``sequential`` applies the task bases in order (the
    reference behaviour: only orthogonal to the last one when bases
    overlap); ``joint`` projects once on an orthonormal basis of all.  Each
    step is its own projection so Catalyst does not re-inline earlier steps."""
    if mode == "joint" and bases:
        q, _ = np.linalg.qr(np.concatenate(bases, axis=1))
        bases = [q]
    keep = [c for c in df.columns if c != vec]
    cur = df.select(*keep, F.transform(vec, lambda x: x.cast("double")).alias("_g"))
    for b in bases:
        if b.size == 0:
            continue
        cols = [F.array(*[F.lit(float(v)) for v in b[:, c]]) for c in range(b.shape[1])]
        cur = cur.select(*keep, "_g", *[A.dot(F.col("_g"), col).alias(f"_c{i}") for i, col in enumerate(cols)])
        proj = None
        for i, col in enumerate(cols):
            term = _scaled(col, F.col(f"_c{i}"))
            proj = term if proj is None else F.zip_with(proj, term, lambda a, t: a + t)
        # a basis of another dimension (different head layout) is skipped
        same = F.size("_g") == F.lit(b.shape[0])
        cur = cur.select(*keep, F.when(same, F.zip_with("_g", proj, lambda a, p: a - p)).otherwise(F.col("_g"))
                         .alias("_g"))
    return cur.withColumnRenamed("_g", out_col)


def _scaled(v: Column, c: Column) -> Column:
    return F.transform(v, lambda x: x * c)


def project_blocked(grads: DataFrame, basis: DataFrame, row_id: str = "row_id") -> DataFrame:
    """LA2 for large D on blocked tables: coefficients by a join on
    ``block_id`` and a sum per (row, component), then the correction per
    (row, block).  ``grads(row_id, block_id, sub)``, ``basis(component,
    block_id, vec)``."""
    j = grads.join(basis, "block_id")
    coef = j.groupBy(row_id, "component").agg(F.sum(A.dot(F.col("sub"), F.col("vec"))).alias("c"))
    jb = basis.join(coef, "component").select(row_id, "block_id", F.transform("vec", lambda x: x * F.col("c")).alias("t"))
    corr = jb.groupBy(row_id, "block_id").agg(
        F.aggregate(F.collect_list("t"), F.array_repeat(F.lit(0.0), F.size(F.first("t"))),
                    lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b)).alias("corr"))
    out = grads.join(corr, [row_id, "block_id"], "left")
    return out.select(row_id, "block_id", F.when(F.col("corr").isNull(), F.col("sub")).otherwise(
        F.zip_with("sub", "corr", lambda a, b: a - b)).alias("sub"))


def basis_coverage(basis_sizes: DataFrame, dim: int) -> DataFrame:
    """AG24: components per task and cumulative coverage (% of D).  The
    input has one row per task (bounded)."""
    w = Window.orderBy("task_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return basis_sizes.select("task_ord", "task", "k", F.sum("k").over(w).alias("cum_k"),
                              (F.sum("k").over(w) * 100.0 / F.lit(dim)).alias("coverage_pct"))
