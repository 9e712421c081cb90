"""Evaluation of scored binary flows (AG3-AG16, AG23, AG26).

Input is any DataFrame with a 0/1 target column and a score column (the
class-1 probability).  Everything first collapses to one row per distinct
score (map-side partial aggregation), so the work after the first shuffle
scales with the number of distinct scores, not with rows; cumulative counts
come from the bucketed running-total helper (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.prefix import running_totals

EPS_F1 = 1e-8




def _div0(num: Column, den: Column) -> Column:
    """num/den, 0 when den is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


# ---------------------------------------------------------------- counts

def class_counts(df: DataFrame, y: str = "y") -> DataFrame:
    """AG3: rows per class."""
    return df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, y: str = "y", cap: float | None = None) -> DataFrame:
    """AG4: n / (k * count_c), optionally capped (``least(w, cap)``)."""
    cc = class_counts(df, y)
    tot = cc.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = F.lit(float(tot["n"] or 0)) / (F.lit(float(tot["k"] or 1)) * F.col("n"))
    if cap is not None:
        w = F.least(w, F.lit(float(cap)))
    return cc.select("class", "n", w.alias("weight"))


def imbalance(df: DataFrame, y: str = "y", limit: float = 50.0) -> DataFrame:
    """AG5: max/min class count and the severe-imbalance flag."""
    cc = class_counts(df, y)
    return cc.agg(
        F.max("n").alias("max_count"), F.min("n").alias("min_count"),
        (F.max("n") / F.greatest(F.min("n"), F.lit(1))).alias("ratio"),
    ).withColumn("severe", F.col("ratio") > F.lit(limit))


# ------------------------------------------------------------- confusion

def _times(n: str | None) -> Column:
    """How often a row counts: a column of a table whose equal rows were
    collapsed, else once."""
    return F.col(n).cast("long") if n else F.lit(1).cast("long")


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", n: str | None = None) -> DataFrame:
    """AG6: counts per (true, predicted) completed over the class grid.

    The grid is built from the (bounded) set of classes seen in either
    column; the counts themselves are a partial+final aggregate."""
    counts = df.groupBy(F.col(y).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.sum(_times(n)).alias("n"))
    classes = sorted({r[0] for r in counts.select("y_true").union(counts.select("y_pred")).distinct().collect()
                      if r[0] is not None})
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "y_true int, y_pred int")
    return (grid.join(F.broadcast(counts.withColumn("y_true", F.col("y_true").cast("int"))
                                  .withColumn("y_pred", F.col("y_pred").cast("int"))),
                      ["y_true", "y_pred"], "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _per_class(cm: DataFrame) -> DataFrame:
    """(class, tp, true_n, pred_n) from a completed confusion table: every
    cell counts once for its true class and once for its predicted class
    (one aggregate over the k x k cells, no join)."""
    n = F.col("n")
    zero = F.lit(0).cast("long")
    cell = F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), n.alias("true_n"),
                 F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero).alias("tp"), zero.alias("pred_n")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("true_n"), zero.alias("tp"), n.alias("pred_n"))))
    e = cm.select(cell.alias("c")).select("c.*")
    return e.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("true_n").alias("true_n"),
                                  F.sum("pred_n").alias("pred_n"))


def per_class_prf(cm: DataFrame) -> DataFrame:
    pc = _per_class(cm)
    return pc.select(
        "class", "tp", "true_n", "pred_n",
        _div0(F.col("tp"), F.col("pred_n")).alias("precision"),
        _div0(F.col("tp"), F.col("true_n")).alias("recall"),
        _div0(2 * F.col("tp"), F.col("true_n") + F.col("pred_n")).alias("f1"),
    )


def prf_table(cm: DataFrame) -> DataFrame:
    """AG7: accuracy, weighted and per-class P/R/F1 as a long table
    ``(metric, class, value)``; zero division gives 0."""
    pc = per_class_prf(cm)
    long_pc = pc.select("class", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")]
    )).alias("kv")).select(F.col("kv.metric").alias("metric"), F.col("class").cast("int").alias("class"),
                           F.col("kv.value").alias("value"))
    agg = pc.agg(
        (F.sum("tp") / F.sum("true_n")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("true_n")) / F.sum("true_n")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("true_n")) / F.sum("true_n")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("true_n")) / F.sum("true_n")).alias("f1_weighted"),
    )
    names = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]
    long_agg = agg.select(F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("kv")).select(
        F.col("kv.metric").alias("metric"), F.lit(None).cast("int").alias("class"), F.col("kv.value").alias("value"))
    return long_agg.unionByName(long_pc)


def classification_report(cm: DataFrame) -> DataFrame:
    """AG8: per class, macro avg, weighted avg (precision, recall, f1, support)."""
    pc = per_class_prf(cm)
    rows = pc.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1",
                     F.col("true_n").cast("long").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("true_n").cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("true_n")) / F.sum("true_n")).alias("precision"),
                      (F.sum(F.col("recall") * F.col("true_n")) / F.sum("true_n")).alias("recall"),
                      (F.sum(F.col("f1") * F.col("true_n")) / F.sum("true_n")).alias("f1"),
                      F.sum("true_n").cast("long").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def binary_weighted(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Support-weighted P/R/F1 of a binary confusion (zero division -> 0)."""
    n1 = tp + fn
    n0 = tn + fp
    n = n0 + n1
    p1, r1, f1_1 = _div0(tp, tp + fp), _div0(tp, n1), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f1_0 = _div0(tn, tn + fn), _div0(tn, n0), _div0(2 * tn, 2 * tn + fn + fp)
    w = lambda a, b: (a * n0 + b * n1) / n
    return {"precision_weighted": w(p0, p1), "recall_weighted": w(r0, r1), "f1_weighted": w(f1_0, f1_1),
            "accuracy": (tp + tn) / n, "recall_0": r0, "recall_1": r1, "precision_0": p0, "precision_1": p1}


# ------------------------------------------------------- threshold curves

def score_table(df: DataFrame, y: str = "y", p: str = "p", n: str | None = None) -> DataFrame:
    """One row per distinct score with positive / negative counts."""
    return df.groupBy(F.col(p).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long") * _times(n)).alias("pos"),
        F.sum((1 - F.col(y)).cast("long") * _times(n)).alias("neg"))


def curve_points(df: DataFrame, y: str = "y", p: str = "p", n_buckets: int | None = None) -> DataFrame:
    """Per distinct score s: pos/neg at s, tps/fps = counts with score >= s,
    total positives P and negatives N (as columns), precision, recall, fpr,
    and the pos/neg of the next lower score (null at the lowest)."""
    return points_of(score_table(df, y, p), n_buckets)


def points_of(st: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``curve_points`` of a table of distinct scores."""
    tot: dict = {}
    cum = running_totals(st, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets, grand_totals=tot,
                         next_cols=["pos", "neg"])
    P, N = int(tot.get("pos") or 0), int(tot.get("neg") or 0)
    tps, fps = F.col("cum_pos"), F.col("cum_neg")
    return cum.select(
        "score", "pos", "neg", "next_pos", "next_neg", tps.alias("tps"), fps.alias("fps"),
        F.lit(P).cast("long").alias("n_pos"), F.lit(N).cast("long").alias("n_neg"),
        (tps / (tps + fps)).alias("precision"),
        (F.lit(1.0) if P == 0 else tps / F.lit(float(P))).alias("recall"),
        (F.lit(None).cast("double") if N == 0 else fps / F.lit(float(N))).alias("fpr"),
    )


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AG9: Mann-Whitney AUC, ties count one half; null for one class."""
    return roc_auc_of(curve_points(df, y, p))


def roc_auc_of(cp: DataFrame) -> DataFrame:
    num = F.sum(F.col("pos") * (F.col("n_neg") - F.col("fps") + 0.5 * F.col("neg")))
    den = F.first("n_pos") * F.first("n_neg")
    return cp.agg(F.when(den > 0, num / den).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AG10: sum over thresholds of (recall step) x precision."""
    return average_precision_of(curve_points(df, y, p))


def average_precision_of(cp: DataFrame) -> DataFrame:
    return cp.agg(F.when(F.first("n_pos") > 0, F.sum(F.col("pos") * F.col("precision")) / F.first("n_pos"))
                  .alias("avg_precision"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", drop_intermediate: bool = False) -> DataFrame:
    """AG11: (threshold, fpr, tpr) at every distinct score plus the (0, 0)
    anchor (threshold null).  ``drop_intermediate`` keeps only the first,
    the last and the corner points (non-zero second difference of fps or
    tps), as the reference's default.  The step into a point is its own
    pos/neg, the step out of it is the next score's."""
    return roc_curve_of(curve_points(df, y, p), drop_intermediate)


def roc_curve_of(cp: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    if drop_intermediate:
        first = F.col("tps") + F.col("fps") == F.col("pos") + F.col("neg")
        cp = cp.where(first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos"))
                      | (F.col("next_neg") != F.col("neg")))
    pts = cp.select(F.col("score").alias("threshold"), F.col("fpr"),
                    F.when(F.col("n_pos") > 0, F.col("tps") / F.col("n_pos")).alias("tpr"))
    anchor = cp.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(anchor)


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AG12: (threshold, precision, recall) at every distinct score plus the
    final (precision 1, recall 0) point (threshold null)."""
    return pr_curve_of(curve_points(df, y, p))


def pr_curve_of(cp: DataFrame) -> DataFrame:
    pts = cp.select(F.col("score").alias("threshold"), "precision", "recall")
    anchor = cp.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(anchor)


def _first_max(df: DataFrame, value: str, cols: list[str]) -> DataFrame:
    """Row with the largest ``value``; ties go to the lowest threshold."""
    best = df.agg(F.max_by(F.struct(*[F.col(c) for c in cols]),
                           F.struct(F.col(value), -F.col("threshold"))).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in cols])


def best_f1_threshold(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AG13: threshold maximising 2PR/(P+R+1e-8) over all distinct scores
    (predict positive when score >= threshold)."""
    return best_f1_of(curve_points(df, y, p))


def best_f1_of(cp: DataFrame) -> DataFrame:
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS_F1))
    pts = cp.select(F.col("score").alias("threshold"), "precision", "recall", f1.alias("f1"),
                    "tps", "fps", "n_pos", "n_neg")
    return _first_max(pts, "f1", ["threshold", "precision", "recall", "f1", "tps", "fps", "n_pos", "n_neg"])


def recall90_threshold(df: DataFrame, y: str = "y", p: str = "p", target: float = 0.90) -> DataFrame:
    """AG14: among points with recall >= target the best precision, lowest
    threshold on ties."""
    cp = curve_points(df, y, p).where(F.col("recall") >= F.lit(target))
    pts = cp.select(F.col("score").alias("threshold"), "precision", "recall")
    return _first_max(pts, "precision", ["threshold", "precision", "recall"])


def eval_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """P0 slice: F1-optimal threshold and the operating point there
    (precision, recall, f1, accuracy, weighted recall / F1, per-class recall)."""
    return eval_report_of(curve_points(df, y, p))


def eval_report_of(cp: DataFrame) -> DataFrame:
    b = best_f1_of(cp)
    tp, fp = F.col("tps"), F.col("fps")
    fn, tn = F.col("n_pos") - F.col("tps"), F.col("n_neg") - F.col("fps")
    m = binary_weighted(tp, fp, fn, tn)
    return b.select(
        "threshold", "precision", "recall", "f1",
        m["accuracy"].alias("accuracy"), m["recall_weighted"].alias("recall_weighted"),
        m["f1_weighted"].alias("f1_weighted"), m["recall_0"].alias("recall_0"), m["recall_1"].alias("recall_1"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))


# ---------------------------------------------------------- fixed grids

def linspace_expr(i: Column, lo: float, hi: float, num: int) -> Column:
    """numpy.linspace(lo, hi, num)[i]: i*step + lo, last point exactly hi."""
    step = (hi - lo) / (num - 1)
    return F.when(i == num - 1, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))


def grid_index(score: Column, lo: float, hi: float, num: int) -> Column:
    """Largest grid index i with linspace[i] <= score (-1 if none), exact
    w.r.t. the same comparison a brute-force range join would make."""
    step = (hi - lo) / (num - 1)
    g = F.least(F.greatest(F.floor((score - F.lit(lo)) / F.lit(step)), F.lit(-1)), F.lit(num - 1)).cast("int")
    t = lambda j: linspace_expr(j, lo, hi, num)
    up = (g + 1 <= num - 1) & (t(g + 1) <= score)
    down = (g >= 0) & (t(g) > score)
    return F.when(up, g + 1).when(down, g - 1).otherwise(g)


def grid_counts(df: DataFrame, y: str, p: str, lo: float, hi: float, num: int, n: str | None = None) -> DataFrame:
    """Per grid threshold t_i: tp/fp = rows with score >= t_i, plus totals.
    Rows -> at most num+1 bucket counts (partial aggregation) -> suffix sums
    over that bounded table."""
    spark = df.sparkSession
    b = df.select(grid_index(F.col(p).cast("double"), lo, hi, num).alias("gi"), F.col(y).cast("long").alias("_y"),
                  _times(n).alias("_n"))
    per = b.groupBy("gi").agg(F.sum(F.col("_y") * F.col("_n")).alias("pos"), F.sum((1 - F.col("_y")) * F.col("_n")).alias("neg"))
    grid = spark.range(num).select(F.col("id").cast("int").alias("gi"))
    g = grid.join(per, "gi", "full").fillna(0, ["pos", "neg"])
    # bounded (num + 1 rows): a global window is fine here
    w = Window.orderBy(F.col("gi").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(F.lit(0))
    g = g.select("gi", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                 F.sum("pos").over(wall).alias("n_pos"), F.sum("neg").over(wall).alias("n_neg"))
    return g.where(F.col("gi") >= 0).select(
        "gi", linspace_expr(F.col("gi"), lo, hi, num).alias("threshold"), "tp", "fp",
        (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn"))


def anomaly_grid_threshold(df: DataFrame, y: str = "y", p: str = "p",
                           lo: float = 0.01, hi: float = 0.99, num: int = 200) -> DataFrame:
    """AG15: grid search; strict improvement from (0.5, 0.0)."""
    g = grid_counts(df, y, p, lo, hi, num)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = tp / F.greatest(tp + fp, F.lit(1))
    rec = tp / F.greatest(tp + fn, F.lit(1))
    f1 = 2 * prec * rec / F.greatest(prec + rec, F.lit(1e-8))
    pts = g.select("threshold", f1.alias("f1"))
    best = _first_max(pts, "f1", ["threshold", "f1"])
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.when(F.col("f1") > 0, F.col("f1")).otherwise(F.lit(0.0)).alias("f1"))


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p",
                    lo: float = 0.05, hi: float = 0.95, num: int = 50, n: str | None = None) -> DataFrame:
    """AG16: weighted P/R/F1 for predictions score >= t over a fixed grid."""
    g = grid_counts(df, y, p, lo, hi, num, n)
    m = binary_weighted(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return g.select("threshold", m["f1_weighted"].alias("f1"), m["recall_weighted"].alias("recall"),
                    m["precision_weighted"].alias("precision"))


def best_sweep(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AG26: best-F1 point of the sweep (first max)."""
    return _first_max(threshold_sweep(df, y, p), "f1", ["threshold", "f1", "precision", "recall"])


# ------------------------------------------------------- report tables

def forgetting_matrix(results: DataFrame) -> DataFrame:
    """AG23: ``results(task, task_ord, stage, f1)`` -> task x stage matrix,
    zero filled; one column per stage ordinal."""
    stages = sorted(r[0] for r in results.select("stage").distinct().collect())
    piv = results.groupBy("task", "task_ord").pivot("stage", stages).agg(F.first("f1"))
    return piv.fillna(0.0)
