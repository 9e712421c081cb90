"""Evaluation queries (AG3-AG16, AG26) over scored documents and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.operators import metrics as M
from flowlab.plans.bindings import scored_documents, scored_flows
from flowlab.plans.catalog import register, rounded
from flowlab.sources.tables import table


def dlit(x: float) -> str:
    """Exact double literal for DuckDB (string parse, correctly rounded)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


# ----------------------------------------------------------------- SQL bits

SCORED_DOCS = """scored AS (
  SELECT d.doc_id AS id, CAST(l.quality AS INTEGER) AS y,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + CAST(2000 AS DOUBLE)) AS p,
         ln(CAST(d.n_chars AS DOUBLE) / CAST(2000 AS DOUBLE)) AS logit,
         CAST(l.toxic AS INTEGER) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED_FLOWS = f"""scored AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS id,
         CAST(l_returnflag = 'R' AS INTEGER) AS y,
         (l_discount + l_tax) / {dlit(0.18)} AS p
  FROM lineitem)"""

CURVE = """,
st AS (SELECT p AS score, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg FROM scored GROUP BY p),
tot AS (SELECT CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg FROM st),
cp AS (
  SELECT score, pos, neg, n_pos, n_neg,
         CAST(SUM(pos) OVER w AS BIGINT) AS tps, CAST(SUM(neg) OVER w AS BIGINT) AS fps
  FROM st CROSS JOIN tot
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (
  SELECT *, CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE) AS precision,
         CASE WHEN n_pos = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(tps AS DOUBLE) / CAST(n_pos AS DOUBLE) END AS recall,
         CASE WHEN n_neg = 0 THEN NULL ELSE CAST(fps AS DOUBLE) / CAST(n_neg AS DOUBLE) END AS fpr
  FROM cp)"""


def _with(scored: str) -> str:
    return "WITH " + scored + CURVE


def _wsum(a0: str, a1: str) -> str:
    """support-weighted average of a class-0 and a class-1 metric."""
    return (f"(({a0}) * CAST(n0 AS DOUBLE) + ({a1}) * CAST(n1 AS DOUBLE)) / CAST(n0 + n1 AS DOUBLE)")


def _div0(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _binary_metric_cols(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    p1, r1 = _div0(tp, f"{tp} + {fp}"), _div0(tp, f"{tp} + {fn}")
    f1_1 = _div0(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    p0, r0 = _div0(tn, f"{tn} + {fn}"), _div0(tn, f"{tn} + {fp}")
    f1_0 = _div0(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
    return {"precision_weighted": _wsum(p0, p1), "recall_weighted": _wsum(r0, r1),
            "f1_weighted": _wsum(f1_0, f1_1), "recall_0": r0, "recall_1": r1,
            "accuracy": f"CAST({tp} + {tn} AS DOUBLE) / CAST(n0 + n1 AS DOUBLE)"}


BEST_F1 = """,
f1s AS (SELECT *, 2 * precision * recall / (precision + recall + CAST('1e-08' AS DOUBLE)) AS f1 FROM pts),
best AS (SELECT * FROM f1s ORDER BY f1 DESC, score ASC LIMIT 1)"""


def _eval_report_sql(scored: str) -> str:
    m = _binary_metric_cols()
    return _with(scored) + BEST_F1 + f""",
op AS (SELECT score, precision, recall, f1, tps AS tp, fps AS fp, n_pos - tps AS fn, n_neg - fps AS tn,
              n_pos AS n1, n_neg AS n0 FROM best)
SELECT round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round({m['accuracy']}, 6) AS accuracy,
       round({m['recall_weighted']}, 6) AS recall_weighted, round({m['f1_weighted']}, 6) AS f1_weighted,
       round({m['recall_0']}, 6) AS recall_0, round({m['recall_1']}, 6) AS recall_1,
       tp, fp, fn, tn
FROM op"""


@register("eval_report", _eval_report_sql(SCORED_DOCS))
def q_eval_report(spark, sf_dir):
    return rounded(M.eval_report(scored_documents(spark, sf_dir)))


@register("flow_eval_report", _eval_report_sql(SCORED_FLOWS))
def q_flow_eval_report(spark, sf_dir):
    return rounded(M.eval_report(scored_flows(spark, sf_dir)))


CONFUSION_SQL = "WITH " + SCORED_DOCS + """,
pred AS (SELECT y, CAST(p > CAST(0.5 AS DOUBLE) AS INTEGER) AS yp FROM scored),
cls AS (SELECT y AS c FROM pred UNION SELECT yp FROM pred),
grid AS (SELECT a.c AS y_true, b.c AS y_pred FROM cls a CROSS JOIN cls b),
cnt AS (SELECT y AS y_true, yp AS y_pred, COUNT(*) AS n FROM pred GROUP BY y, yp)
SELECT g.y_true, g.y_pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON g.y_true = c.y_true AND g.y_pred = c.y_pred"""


def _doc_pred(spark, sf_dir):
    s = scored_documents(spark, sf_dir)
    # argmax of the two-class probabilities: class 1 only when p1 > p0
    return s.withColumn("pred", (F.col("p") > F.lit(0.5)).cast("int"))


@register("confusion", CONFUSION_SQL)
def q_confusion(spark, sf_dir):
    return M.confusion(_doc_pred(spark, sf_dir), "y", "pred")


PERCLASS_SQL = CONFUSION_SQL.replace("SELECT g.y_true, g.y_pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n\nFROM grid g LEFT JOIN cnt c ON g.y_true = c.y_true AND g.y_pred = c.y_pred", """,
cm AS (SELECT g.y_true, g.y_pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c ON g.y_true = c.y_true AND g.y_pred = c.y_pred),
pc AS (SELECT t.c AS class, t.tp, t.true_n, p.pred_n FROM
        (SELECT y_true AS c, SUM(n) AS true_n, SUM(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY y_true) t
        JOIN (SELECT y_pred AS c, SUM(n) AS pred_n FROM cm GROUP BY y_pred) p ON t.c = p.c),
prf AS (SELECT class, tp, true_n, pred_n,
        CASE WHEN pred_n = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(pred_n AS DOUBLE) END AS precision,
        CASE WHEN true_n = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(true_n AS DOUBLE) END AS recall,
        CASE WHEN true_n + pred_n = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / CAST(true_n + pred_n AS DOUBLE) END AS f1
        FROM pc)""")

PRF_SQL = PERCLASS_SQL + """
SELECT 'accuracy' AS metric, CAST(NULL AS INTEGER) AS class, round(CAST(SUM(tp) AS DOUBLE) / CAST(SUM(true_n) AS DOUBLE), 6) AS value FROM prf
UNION ALL SELECT 'precision_weighted', NULL, round(SUM(precision * true_n) / SUM(true_n), 6) FROM prf
UNION ALL SELECT 'recall_weighted', NULL, round(SUM(recall * true_n) / SUM(true_n), 6) FROM prf
UNION ALL SELECT 'f1_weighted', NULL, round(SUM(f1 * true_n) / SUM(true_n), 6) FROM prf
UNION ALL SELECT 'precision', class, round(precision, 6) FROM prf
UNION ALL SELECT 'recall', class, round(recall, 6) FROM prf
UNION ALL SELECT 'f1', class, round(f1, 6) FROM prf"""


@register("prf", PRF_SQL)
def q_prf(spark, sf_dir):
    return rounded(M.prf_table(M.confusion(_doc_pred(spark, sf_dir), "y", "pred")))


REPORT_SQL = PERCLASS_SQL + """
SELECT CAST(class AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(true_n AS BIGINT) AS support FROM prf
UNION ALL SELECT 'macro avg', round(AVG(precision), 6), round(AVG(recall), 6), round(AVG(f1), 6), CAST(SUM(true_n) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(SUM(precision * true_n) / SUM(true_n), 6), round(SUM(recall * true_n) / SUM(true_n), 6),
       round(SUM(f1 * true_n) / SUM(true_n), 6), CAST(SUM(true_n) AS BIGINT) FROM prf"""


@register("report", REPORT_SQL)
def q_report(spark, sf_dir):
    return rounded(M.classification_report(M.confusion(_doc_pred(spark, sf_dir), "y", "pred")))


ROC_AUC_SQL = _with(SCORED_DOCS) + """
SELECT round(CASE WHEN MAX(n_pos) * MAX(n_neg) > 0 THEN
   SUM(CAST(pos AS DOUBLE) * (CAST(n_neg - fps AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(neg AS DOUBLE)))
   / (CAST(MAX(n_pos) AS DOUBLE) * CAST(MAX(n_neg) AS DOUBLE)) END, 6) AS roc_auc FROM pts"""


@register("roc_auc", ROC_AUC_SQL)
def q_roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(scored_documents(spark, sf_dir)))


@register("flow_roc_auc", ROC_AUC_SQL.replace(SCORED_DOCS, SCORED_FLOWS))
def q_flow_roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(scored_flows(spark, sf_dir)))


AP_SQL = _with(SCORED_DOCS) + """
SELECT round(CASE WHEN MAX(n_pos) > 0 THEN SUM(CAST(pos AS DOUBLE) * precision) / CAST(MAX(n_pos) AS DOUBLE) END, 6)
       AS avg_precision FROM pts"""


@register("avg_precision", AP_SQL)
def q_avg_precision(spark, sf_dir):
    return rounded(M.average_precision(scored_documents(spark, sf_dir)))


ROC_CURVE_SQL = _with(SCORED_DOCS) + """
SELECT round(score, 6) AS threshold, round(fpr, 6) AS fpr,
       round(CASE WHEN n_pos > 0 THEN CAST(tps AS DOUBLE) / CAST(n_pos AS DOUBLE) END, 6) AS tpr FROM pts
UNION ALL SELECT NULL, 0.0, 0.0"""


@register("roc_curve", ROC_CURVE_SQL)
def q_roc_curve(spark, sf_dir):
    return rounded(M.roc_curve(scored_documents(spark, sf_dir)))


ROC_DROP_SQL = _with(SCORED_DOCS) + """,
nb AS (SELECT *, lag(tps) OVER w AS tp0, lag(fps) OVER w AS fp0, lead(tps) OVER w AS tp2, lead(fps) OVER w AS fp2
       FROM pts WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 6) AS threshold, round(fpr, 6) AS fpr,
       round(CASE WHEN n_pos > 0 THEN CAST(tps AS DOUBLE) / CAST(n_pos AS DOUBLE) END, 6) AS tpr FROM nb
WHERE tp0 IS NULL OR tp2 IS NULL OR fp0 - 2 * fps + fp2 <> 0 OR tp0 - 2 * tps + tp2 <> 0
UNION ALL SELECT NULL, 0.0, 0.0"""


@register("roc_curve_dropped", ROC_DROP_SQL)
def q_roc_curve_dropped(spark, sf_dir):
    return rounded(M.roc_curve(scored_documents(spark, sf_dir), drop_intermediate=True))


@register("flow_roc_curve_dropped", ROC_DROP_SQL.replace(SCORED_DOCS, SCORED_FLOWS))
def q_flow_roc_curve_dropped(spark, sf_dir):
    return rounded(M.roc_curve(scored_flows(spark, sf_dir), drop_intermediate=True))


PR_CURVE_SQL = _with(SCORED_DOCS) + """
SELECT round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pts
UNION ALL SELECT NULL, 1.0, 0.0"""


@register("pr_curve", PR_CURVE_SQL)
def q_pr_curve(spark, sf_dir):
    return rounded(M.pr_curve(scored_documents(spark, sf_dir)))


BEST_F1_SQL = _with(SCORED_DOCS) + BEST_F1 + """
SELECT round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM best"""


@register("best_f1", BEST_F1_SQL)
def q_best_f1(spark, sf_dir):
    return rounded(M.best_f1_threshold(scored_documents(spark, sf_dir)).select(
        "threshold", "precision", "recall", "f1"))


RECALL90_SQL = _with(SCORED_DOCS) + """
SELECT round(score, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM pts WHERE recall >= CAST(0.9 AS DOUBLE) ORDER BY precision DESC, score ASC LIMIT 1"""


@register("recall90", RECALL90_SQL)
def q_recall90(spark, sf_dir):
    return rounded(M.recall90_threshold(scored_documents(spark, sf_dir)))


def _grid_sql(scored: str, lo: float, hi: float, num: int) -> str:
    step = (hi - lo) / (num - 1)
    return f"""WITH {scored},
grid AS (SELECT CAST(i AS INTEGER) AS gi,
           CASE WHEN i = {num - 1} THEN {dlit(hi)} ELSE CAST(i AS DOUBLE) * {dlit(step)} + {dlit(lo)} END AS t
         FROM range({num}) r(i)),
gc AS (SELECT g.t AS threshold,
         CAST(COUNT(*) FILTER (WHERE s.p >= g.t AND s.y = 1) AS BIGINT) AS tp,
         CAST(COUNT(*) FILTER (WHERE s.p >= g.t AND s.y = 0) AS BIGINT) AS fp,
         CAST(COUNT(*) FILTER (WHERE s.p < g.t AND s.y = 1) AS BIGINT) AS fn,
         CAST(COUNT(*) FILTER (WHERE s.p < g.t AND s.y = 0) AS BIGINT) AS tn
       FROM grid g CROSS JOIN scored s GROUP BY g.gi, g.t)"""


GRID_SQL = _grid_sql(SCORED_DOCS, 0.01, 0.99, 200) + """,
m AS (SELECT threshold, CAST(tp AS DOUBLE) / CAST(greatest(tp + fp, 1) AS DOUBLE) AS pr,
             CAST(tp AS DOUBLE) / CAST(greatest(tp + fn, 1) AS DOUBLE) AS rc FROM gc),
f AS (SELECT threshold, 2 * pr * rc / greatest(pr + rc, CAST('1e-08' AS DOUBLE)) AS f1 FROM m),
b AS (SELECT * FROM f ORDER BY f1 DESC, threshold ASC LIMIT 1)
SELECT round(CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END, 6) AS threshold,
       round(CASE WHEN f1 > 0 THEN f1 ELSE 0.0 END, 6) AS f1 FROM b"""


@register("grid_threshold", GRID_SQL)
def q_grid_threshold(spark, sf_dir):
    return rounded(M.anomaly_grid_threshold(scored_documents(spark, sf_dir)))


def _sweep_sql() -> str:
    m = _binary_metric_cols()
    return _grid_sql(SCORED_DOCS, 0.05, 0.95, 50) + f""",
sw AS (SELECT threshold, tp, fp, fn, tn, tp + fn AS n1, tn + fp AS n0 FROM gc),
res AS (SELECT threshold, {m['f1_weighted']} AS f1, {m['recall_weighted']} AS recall,
               {m['precision_weighted']} AS precision FROM sw)"""


SWEEP_SQL = _sweep_sql() + """
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(recall, 6) AS recall,
       round(precision, 6) AS precision FROM res"""


@register("sweep", SWEEP_SQL)
def q_sweep(spark, sf_dir):
    return rounded(M.threshold_sweep(scored_documents(spark, sf_dir)))


BEST_SWEEP_SQL = _sweep_sql() + """
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision,
       round(recall, 6) AS recall FROM res ORDER BY f1 DESC, threshold ASC LIMIT 1"""


@register("best_sweep", BEST_SWEEP_SQL)
def q_best_sweep(spark, sf_dir):
    return rounded(M.best_sweep(scored_documents(spark, sf_dir)))


# ------------------------------------------------------ class statistics

EVENTS_Y = "CAST(event_type = 'error' AS INTEGER)"


def _events_y(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select((F.col("event_type") == "error").cast("int").alias("y"))


@register("class_weights", f"""
WITH cc AS (SELECT {EVENTS_Y} AS class, COUNT(*) AS n FROM events GROUP BY 1),
t AS (SELECT SUM(n) AS tn, COUNT(*) AS k FROM cc)
SELECT CAST(class AS INTEGER) AS class, CAST(n AS BIGINT) AS n,
       round(least(CAST(tn AS DOUBLE) / (CAST(k AS DOUBLE) * CAST(n AS DOUBLE)), CAST(10 AS DOUBLE)), 6) AS weight
FROM cc CROSS JOIN t""")
def q_class_weights(spark, sf_dir):
    return rounded(M.class_weights(_events_y(spark, sf_dir), "y", cap=10.0))


@register("imbalance", f"""
WITH cc AS (SELECT {EVENTS_Y} AS class, COUNT(*) AS n FROM events GROUP BY 1)
SELECT CAST(MAX(n) AS BIGINT) AS max_count, CAST(MIN(n) AS BIGINT) AS min_count,
       round(CAST(MAX(n) AS DOUBLE) / CAST(greatest(MIN(n), 1) AS DOUBLE), 6) AS ratio,
       CAST(MAX(n) AS DOUBLE) / CAST(greatest(MIN(n), 1) AS DOUBLE) > 50 AS severe
FROM cc""")
def q_imbalance(spark, sf_dir):
    return rounded(M.imbalance(_events_y(spark, sf_dir), "y"))


@register("class_counts", f"""
SELECT CAST({EVENTS_Y} AS INTEGER) AS class, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def q_class_counts(spark, sf_dir):
    return M.class_counts(_events_y(spark, sf_dir), "y")
