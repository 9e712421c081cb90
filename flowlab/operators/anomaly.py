"""Anomaly scoring in embedding space (AG18, PR19-PR23, MO6, TR6, DO1, DO3).

* exact quantiles without one task holding a whole group: (group, value)
  counts and running totals over value ranges;
* isolation forest: one sampling pass, all trees grown together level by level,
  rows walked through the broadcast forest in expressions;
* Mahalanobis: centred moments, merged pairwise block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.functions.rand import uniform
from flowlab.operators.models import arrow_matrix, net_forward
from flowlab.operators.prefix import value_ranges
from flowlab.operators.select import kth_value
from flowlab.session import cut

ANOMALY_CUT = 0.65  # fixed value: score at or above -> zero-day alert


def _schema(df: DataFrame, keep: list[str], extra: str) -> str:
    base = df.select(*keep).schema.simpleString()[len("struct<"):-1] if keep else ""
    return f"{base},{extra}" if base else extra


# ------------------------------------------------------------ exact quantile

def exact_percentile(df: DataFrame, value: str, q: float, group_cols: list[str] | None = None,
                     out_col: str = "quantile", n_parts: int | None = None, stored: bool = False) -> DataFrame:
    """numpy.percentile(linear) of ``value`` per group, exact; null values are
    left out, groups without a value give no row.

    Without groups no row is moved: histograms (``select``) find the value;
    the values are written first, unless ``df`` is a table (``stored``).
    With groups,
    rows collapse to (group, value, count) first, so a value that fills most of
    a group is one row.  Running counts come from value ranges: ranges are
    ordered on their own and the per-range totals give the offsets.  Nothing
    per group reaches the driver, and no task holds a whole group."""
    key = g = list(group_cols or [])
    base = df.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not g:
        return _whole_percentile(base if stored else cut(base), q, out_col)
    from flowlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)   # the session's reliable folder (set one only in local mode)
    counted = base.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    ranged = value_ranges(counted, ["_v"], "_p", n_parts)
    totals = ranged.groupBy("_p", *key).agg(F.sum("_c").alias("_t"))
    every = Window.partitionBy(*key)
    before = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *key, F.sum("_t").over(every).alias("_n"),
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"), "_t")
    # only the ranges that hold rank h or the next one are ordered
    h = (F.col("_n") - 1) * F.lit(q)
    k = F.floor(h)
    wanted = offsets.where((F.col("_off") <= k + 1) & (F.col("_off") + F.col("_t") > k)).drop("_t")
    near = ranged.alias("r").join(wanted.alias("o"), [F.col(f"r.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in ["_p", *key]])
    near = near.select(*[F.col(f"r.`{c}`").alias(c) for c in ["_p", *key]], "_v", "_c", "_n", "_off")
    local = Window.partitionBy("_p", *key).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = near.withColumn("_r", F.col("_off") + F.coalesce(F.sum("_c").over(local), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_r") <= rank) & (F.col("_r") + F.col("_c") > rank), F.col("_v")))

    pick = first.groupBy(*key).agg(F.first("_n").alias("_n"), at(k).alias("_a"), at(k + 1).alias("_b"))
    frac = h - k
    res = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + frac * (F.col("_b") - F.col("_a")))
    return pick.select(*g, res.alias(out_col))


def _whole_percentile(values: DataFrame, q: float, out_col: str) -> DataFrame:
    """``exact_percentile`` of the not-null numbers ``_v`` of a written table."""
    n, found = values.count(), []
    if n:
        h = (n - 1) * q
        k = math.floor(h)
        a, following = kth_value(values, "_v", k + 1)
        b = a if following is None else following
        found = [(a if k + 1 >= n else a + (h - k) * (b - a),)]
    return values.sparkSession.createDataFrame(found, f"`{out_col}` double")


# ------------------------------------------------- reconstruction scoring

def group_mean_vectors(df: DataFrame, vec: str, group: str, digits: int | None = 6) -> DataFrame:
    """Mean vector per group (a fixed 'reconstruction' model): posexplode,
    partial+final average per (group, element), reassembled in order."""
    e = df.select(group, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    if digits is not None:
        m = m.withColumn("m", F.round("m", digits))
    return m.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s")).select(
        group, F.transform("_s", lambda s: s["m"]).alias("recon"))


def reconstruction_errors(df: DataFrame, vec: str, recon: DataFrame, on: str) -> DataFrame:
    """PR19: per-row MSE against the joined reconstruction (one row per
    group; broadcast after its size is measured)."""
    from flowlab.session import broadcast_if_small
    return df.join(broadcast_if_small(recon), on).withColumn("err", A.mse(F.col(vec), F.col("recon"))).drop("recon")


def net_errors(df: DataFrame, vec: str, net: list[dict], out_col: str = "err") -> DataFrame:
    """PR19: mean squared difference of every vector and what ``net`` makes of
    it; only the error leaves the task."""
    def errors(batches):
        for batch in batches:
            if batch.num_rows:
                x = arrow_matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(((x - net_forward(x, net)) ** 2).mean(axis=1))], [out_col])

    return df.select(F.col(vec).cast("array<double>").alias("_fl_x")).mapInArrow(errors, f"`{out_col}` double")


def score_errors(err: Column, threshold: float) -> dict[str, Column]:
    """PR20-PR22 for a fitted threshold."""
    s = A.anomaly_score(err, threshold)
    return {"score": s, "is_anomaly": err > F.lit(threshold), "severity": A.severity(s)}


# ------------------------------------------------------- isolation forest

def _average_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search among n rows."""
    x = n.cast("double")
    return F.when(n <= 1, F.lit(0.0)).when(n == 2, F.lit(1.0)).otherwise(
        F.lit(2.0) * (F.ln(F.greatest(x - 1.0, F.lit(1.0))) + F.lit(EULER)) - F.lit(2.0) * (x - 1.0) / x)


EULER = 0.5772156649        # fixed value of the path-length formula


def forest_sample(df: DataFrame, vec: str, row_id: str, n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """(tree_id, rid, v): about n_trees * psi rows, each dealt to trees by a
    counter; a tree keeps its first ``psi`` rows in counter order."""
    want = 1.2 * n_trees * psi  # sampled rows in total: bounded by the forest size, not by n
    rate = min(1.0, want / max(n, 1))
    times = max(1, math.ceil(want / max(n, 1)))  # > 1 only when the table is smaller than the forest
    s = df.select(F.col(row_id).alias("rid"), F.col(vec).cast("array<double>").alias("v")).where(
        uniform(F.lit(seed), F.col("rid"), F.lit("if")) < F.lit(rate))
    s = s.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(times))))
    s = s.withColumn("tree_id", F.floor(uniform(F.lit(seed), F.col("rid"), F.col("_c"), F.lit("tree")) * n_trees).cast("int"))
    s = s.drop("_c").dropDuplicates(["tree_id", "rid"])
    # groups hold about 1.2 * psi rows (bounded), so a per-tree window is cheap
    w = Window.partitionBy("tree_id").orderBy(uniform(F.lit(seed), F.col("rid"), F.col("tree_id")), "rid")
    return s.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= psi).drop("_k")


def fit_isolation_forest(df: DataFrame, vec: str, row_id: str, n_trees: int = 200, max_samples: int = 256,
                         seed: int = 42) -> DataFrame:
    """TR6: the forest as a table, one row a tree: ``feature`` (-1 for a leaf),
    ``threshold`` and ``path`` (a leaf's path length) of its nodes in heap order
    (the children of i are 2 i + 1 and 2 i + 2), and ``n_samples``.

    All trees grow together, a level a job: bounds of every feature in every
    node, a split of a feature that varies at a point between its bounds, both
    drawn by a counter of (seed, tree, node).  The sample has at most n_trees *
    max_samples rows, the forest 2 * max_samples nodes a tree."""
    n = df.count()
    psi = max(min(max_samples, n), 2)
    depth = int(math.ceil(math.log2(psi)))
    rows = cut(forest_sample(df, vec, row_id, n_trees, psi, n, seed).withColumn("node", F.lit(0)))
    counts = rows.groupBy("tree_id").agg(F.count(F.lit(1)).cast("int").alias("n_samples"))
    nodes = None
    for level in range(depth + 1):
        sizes = rows.groupBy("tree_id", "node").agg(F.count(F.lit(1)).alias("size"))
        spans = rows.select("tree_id", "node", F.posexplode("v").alias("f", "x")).groupBy("tree_id", "node", "f").agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"))
        wide = spans.where("hi > lo").groupBy("tree_id", "node").agg(F.array_sort(F.collect_list(F.struct("f", "lo", "hi"))).alias("c"))
        pick = F.get("c", F.floor(uniform(F.lit(seed), F.col("tree_id"), F.col("node"), F.lit("f")) * F.size("c")).cast("int"))
        cuts = wide.select("tree_id", "node", pick.alias("c")).select(
            "tree_id", "node", F.col("c.f").alias("feature"),
            (F.col("c.lo") + uniform(F.lit(seed), F.col("tree_id"), F.col("node"), F.lit("t")) * (F.col("c.hi") - F.col("c.lo")))
            .alias("threshold"))
        split = (F.col("feature").isNotNull()) & (F.col("size") > 1) & F.lit(level < depth)
        found = cut(sizes.join(cuts, ["tree_id", "node"], "left").select(
            "tree_id", "node", F.when(split, F.col("feature")).otherwise(-1).alias("feature"),
            F.when(split, F.col("threshold")).otherwise(0.0).alias("threshold"),
            F.when(split, 0.0).otherwise(F.lit(float(level)) + _average_path(F.col("size"))).alias("path")))
        nodes = found if nodes is None else nodes.unionByName(found)
        if level < depth:
            moved = rows.join(found.where("feature >= 0").drop("path"), ["tree_id", "node"])
            right = (F.get("v", F.col("feature")) >= F.col("threshold")).cast("int")
            rows = cut(moved.select("tree_id", "rid", "v", (2 * F.col("node") + 1 + right).alias("node")))
    heap = nodes.groupBy("tree_id").agg(F.map_from_entries(F.collect_list(
        F.struct("node", F.struct("feature", "threshold", "path")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(2 ** (depth + 1) - 2))

    def in_order(name, default):
        return F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(default)))

    trees = heap.join(counts, "tree_id").select("tree_id", in_order("feature", -1).alias("feature"),
                                                in_order("threshold", 0.0).alias("threshold"), in_order("path", 0.0).alias("path"),
                                                "n_samples")
    return cut(trees)


def score_isolation_forest(df: DataFrame, vec: str, forest: DataFrame, keep: list[str]) -> DataFrame:
    """MO6: s = 2^(-E[h(x)] / c(psi)) in [0, 1].  The forest (n_trees x 2 *
    max_samples nodes) is one broadcast row; a tree is walked by as many steps
    as it has levels, in expressions."""
    whole = forest.agg(F.collect_list(F.struct("feature", "threshold", "path")).alias("_fl_trees"),
                       _average_path(F.greatest(F.max("n_samples"), F.lit(2))).alias("_fl_c")).withColumn("_fl_one", F.lit(1))
    levels = forest.select(F.max(F.size("path"))).first()[0]
    depth = int(math.log2((levels or 1) + 1)) - 1

    def leaf(tree):
        def step(node, _):
            feature = F.get(tree["feature"], node)
            right = F.when(F.get(F.col("_fl_x"), feature) >= F.get(tree["threshold"], node), 1).otherwise(0)
            return F.when(feature < 0, node).otherwise(2 * node + 1 + right)
        return F.get(tree["path"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)) if depth else F.get(
            tree["path"], F.lit(0))

    rows = df.select(*keep, F.col(vec).cast("array<double>").alias("_fl_x")).withColumn("_fl_one", F.lit(1))
    paths = F.aggregate(F.transform("_fl_trees", leaf), F.lit(0.0), lambda a, p: a + p) / F.size("_fl_trees")
    score = F.pow(F.lit(2.0), -paths / F.col("_fl_c"))
    return rows.join(F.broadcast(whole), "_fl_one").select(*keep, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("if_score"))


# ------------------------------------------------------------ Mahalanobis

MOMENT_BLOCK = 64       # side of a block of the co-moment matrix
MERGED = 64             # partial results that one task merges in the first step


def _merge(n1: float, m1: np.ndarray, n2: float, m2: np.ndarray):
    """Count and mean of two parts together, and the weight of their
    difference in the co-moments (Chan, Golub and LeVeque)."""
    n = n1 + n2
    return n, m1 + (m2 - m1) * (n2 / n), n1 * n2 / n


def centred_moments(df: DataFrame, vec: str | list[str] | None, matrix=None) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and sum of (x - mean)(x - mean)' of the vectors: of one column,
    or of what ``matrix`` makes of the matrices of several, batch by batch.
    Without ``vec``, ``matrix`` is given all columns as Arrow has them.

    Every Arrow batch is centred on its own mean; parts (count, mean,
    co-moments) are merged pairwise, so nothing cancels however far the mean
    is from zero.  The matrix is kept as the blocks of its upper triangle, and
    each block is merged on its own."""
    def partial(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [arrow_matrix(c) for c in batch.columns] if vec is not None else batch.columns
            x = matrix(*given) if matrix else given[0]
            n, mean = len(x), x.mean(axis=0)
            c = (x - mean).T @ (x - mean)
            if held is None:
                held = (n, mean, c)
            else:
                total, both, w = _merge(held[0], held[1], n, mean)
                gap = mean - held[1]
                held = (total, both, held[2] + c + w * np.outer(gap, gap))
        if held is not None:
            n, mean, c = held
            cuts = range(0, len(mean), MOMENT_BLOCK)
            rows = [(i // MOMENT_BLOCK, j // MOMENT_BLOCK, n, mean[i:i + MOMENT_BLOCK], mean[j:j + MOMENT_BLOCK],
                     c[i:i + MOMENT_BLOCK, j:j + MOMENT_BLOCK].ravel()) for i in cuts for j in cuts if i <= j]
            yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*rows)], ["bi", "bj", "n", "mi", "mj", "c"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(r.n, np.asarray(r.mi), np.asarray(r.mj), np.asarray(r.c)) for r in pdf.itertuples()]
        n, mi, mj, c = parts[0]
        for n2, mi2, mj2, c2 in parts[1:]:
            c = c + c2 + (n * n2 / (n + n2)) * np.outer(mi2 - mi, mj2 - mj).ravel()
            _, mi, _ = _merge(n, mi, n2, mi2)
            n, mj, _ = _merge(n, mj, n2, mj2)
        first = pdf.iloc[0]
        return pd.DataFrame({"bi": [first["bi"]], "bj": [first["bj"]], "n": [n], "mi": [mi], "mj": [mj], "c": [c]})

    schema = "bi long, bj long, n long, mi array<double>, mj array<double>, c array<double>"
    vecs = [vec] if isinstance(vec, str) else vec
    rows = df if vec is None else df.select(*[F.col(v).cast("array<double>").alias(f"x{i}") for i, v in enumerate(vecs)])
    parts = rows.mapInArrow(partial, schema)
    once = parts.withColumn("part", F.spark_partition_id() % MERGED).groupBy("bi", "bj", "part").applyInPandas(merged, schema)
    blocks = once.groupBy("bi", "bj").applyInPandas(merged, schema).collect()       # the matrix itself
    if not blocks:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = np.concatenate([b["mi"] for b in sorted((b for b in blocks if b["bi"] == b["bj"]), key=lambda b: b["bi"])])
    out = np.zeros((len(mean), len(mean)))
    for b in blocks:
        i, j = b["bi"] * MOMENT_BLOCK, b["bj"] * MOMENT_BLOCK
        c = np.asarray(b["c"]).reshape(len(b["mi"]), len(b["mj"]))
        out[i:i + c.shape[0], j:j + c.shape[1]] = c
        out[j:j + c.shape[1], i:i + c.shape[0]] = c.T
    return int(blocks[0]["n"]), mean, out


def fit_mahalanobis(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """DO1 fit: mean and pseudo-inverse of the sample covariance."""
    n, mean, c = centred_moments(df, vec)
    return mean, np.linalg.pinv(c / max(n - 1, 1))


def mahalanobis(df: DataFrame, vec: str, mu: np.ndarray, inv: np.ndarray, keep: list[str]) -> DataFrame:
    """DO1 apply: sqrt((x-mu)^T S^-1 (x-mu)); (mu, S^-1) broadcast once."""
    bc = df.sparkSession.sparkContext.broadcast((mu, inv))

    def apply(batches):
        m, vinv = bc.value
        for batch in batches:
            if batch.num_rows:
                x = arrow_matrix(batch.column(len(keep))) - m
                d = np.sqrt(np.maximum(((x @ vinv) * x).sum(axis=1), 0.0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(d)], [*keep, "distance"])

    rows = df.select(*keep, F.transform(vec, lambda v: v.cast("double")).alias("_fl_x"))
    return rows.mapInArrow(apply, _schema(df, keep, "distance double"))


def isolation_threshold(forest: DataFrame, train: DataFrame, vec: str, contamination: float = 0.05) -> float:
    """MO6 cut: the (1 - contamination) quantile of the training scores;
    a row is an outlier when its score is above it."""
    scored = score_isolation_forest(train, vec, forest, [])
    return float(exact_percentile(scored, "if_score", 1.0 - contamination).first()[0])
