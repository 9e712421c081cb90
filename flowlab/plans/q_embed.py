"""Embedding-space queries: augmentation (AU*), calibration (AG17, PR13-14),
losses (AG19-22, PR15-18, PR25), anomaly (AG18, PR19-23, DO1-3, MO6),
gradient memory (LA0-2, AG23-25) and alert routing (AL1-4, IO13)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.functions.rand import sql_row_seed, sql_stream_normal, sql_stream_uniform, sql_uniform, uniform
from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import augment as AU
from flowlab.operators import calibrate as CA
from flowlab.operators import linalg as LA
from flowlab.operators import losses as LO
from flowlab.operators import models as MO
from flowlab.plans.bindings import scored_documents
from flowlab.plans.catalog import register, rounded
from flowlab.plans.q_eval import BEST_F1, CURVE, SCORED_DOCS, _binary_metric_cols, _div0, dlit
from flowlab.session import cut
from flowlab.sources.tables import table

DIM = 64


def emb(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", A.as_double(F.col("embedding")).alias("embedding"), "label")


def _r6_list(x: str) -> str:
    return f"list_transform({x}, lambda v: round(v, 6))"


# ------------------------------------------------------------ augmentation

def _sql_noise(vec: str, sigma: float, view: str, rid: str = "vec_id") -> str:
    s1, s2 = sql_row_seed(0, "42", rid, f"'{view}'"), sql_row_seed(1, "42", rid, f"'{view}'")
    n = sql_stream_normal(s1, s2, "i")
    return f"list_transform({vec}, lambda x, i: CAST(x AS DOUBLE) + {dlit(sigma)} * {n})"


def _sql_mask(vec: str, p: float, view: str, rid: str = "vec_id") -> str:
    u = sql_stream_uniform(sql_row_seed(2, "42", rid, f"'{view}'"), "i")
    return f"list_transform({vec}, lambda x, i: CASE WHEN {u} > {dlit(p)} THEN CAST(x AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def _sql_strong(vec: str, view: str, rid: str = "vec_id") -> str:
    return _sql_mask(_sql_noise(vec, 0.1, view, rid), 0.2, view + "m", rid)


@register("noise_weak", f"SELECT vec_id, {_r6_list(_sql_noise('embedding', 0.02, 'w'))} AS view FROM embeddings")
def q_noise_weak(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(e.select("vec_id", AU.weak(F.col("embedding"), F.col("vec_id"), "w").alias("view")))


@register("noise_strong", f"SELECT vec_id, {_r6_list(_sql_strong('embedding', 's'))} AS view FROM embeddings")
def q_noise_strong(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(e.select("vec_id", AU.strong(F.col("embedding"), F.col("vec_id"), "s").alias("view")))


@register("mask", f"SELECT vec_id, {_r6_list(_sql_mask('embedding', 0.1, 'm'))} AS view FROM embeddings")
def q_mask(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(e.select("vec_id", AU.feature_mask(F.col("embedding"), F.col("vec_id"), 0.1, "m").alias("view")))


@register("simclr_pairs", f"SELECT vec_id, {_r6_list(_sql_strong('embedding', 's1'))} AS view1, "
                          f"{_r6_list(_sql_strong('embedding', 's2'))} AS view2 FROM embeddings")
def q_simclr_pairs(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(AU.simclr_views(e, "embedding", "vec_id").select("vec_id", "view1", "view2"))


@register("fixmatch_views", f"SELECT vec_id, {_r6_list(_sql_noise('embedding', 0.02, 'w'))} AS view_weak, "
                            f"{_r6_list(_sql_strong('embedding', 's'))} AS view_strong FROM embeddings")
def q_fixmatch_views(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(AU.fixmatch_views(e, "embedding", "vec_id").select("vec_id", "view_weak", "view_strong"))


@register("l2_normalize", """SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN norm = 0 THEN 0.0 ELSE x / norm END, 6)) AS unit
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
      FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def q_l2_normalize(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(e.select("vec_id", A.l2_normalize(F.col("embedding")).alias("unit")))


def _mixup_sql() -> str:
    u, v = (f"pow({sql_uniform('42', 'batch_id', 'k', chr(39) + x + chr(39))}, {dlit(1 / 0.75)})" for x in ("u", "v"))
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, CAST(label >= 5 AS INTEGER) AS y, CAST(vec_id // 32 AS BIGINT) AS batch_id,
  CAST(vec_id % 32 AS INTEGER) AS pos FROM embeddings),
draws AS (SELECT batch_id, k, {u} AS a, {v} AS b FROM (SELECT DISTINCT batch_id FROM e), range({AU.DRAWS}) r(k)),
lam AS (SELECT batch_id, greatest(arg_min(a / (a + b), k), 1 - arg_min(a / (a + b), k)) AS lam FROM draws
        WHERE a + b <= 1 AND a + b > 0 GROUP BY batch_id),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS place,
      row_number() OVER (PARTITION BY batch_id ORDER BY {sql_uniform('42', 'batch_id', 'pos', chr(39) + 'perm' + chr(39))}, pos) AS shuffled FROM e)
SELECT r.vec_id, r.batch_id, r.pos, round(lam, 6) AS lam,
  list_transform(r.x, lambda a, i: round(lam * a + (1 - lam) * q.x[i], 6)) AS x_mix,
  [round(lam * CAST(r.y = 0 AS INTEGER) + (1 - lam) * CAST(q.y = 0 AS INTEGER), 6),
   round(lam * CAST(r.y = 1 AS INTEGER) + (1 - lam) * CAST(q.y = 1 AS INTEGER), 6)] AS y_mix
FROM r JOIN r q ON q.batch_id = r.batch_id AND q.shuffled = r.place JOIN lam ON lam.batch_id = r.batch_id"""


@register("mixup", _mixup_sql())
def q_mixup(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"),
                                  F.floor(F.col("vec_id") / 32).cast("long").alias("batch_id"),
                                  (F.col("vec_id") % 32).cast("int").alias("pos"))
    return rounded(AU.mixup(e, "embedding", "y"))


# ------------------------------------------------------------- calibration

TEMPS = CA.log_grid(1e-3, 10.0, 64)


def _sql_softmax2(l1: str, t: str) -> tuple[str, str]:
    """(p0, p1) for logits [0, l1] / t, max-shifted like the Spark side."""
    a, b = f"(CAST(0 AS DOUBLE) / {t})", f"({l1} / {t})"
    m = f"greatest({a}, {b})"
    e0, e1 = f"exp({a} - {m})", f"exp({b} - {m})"
    s = f"((CAST(0 AS DOUBLE) + {e0}) + {e1})"
    return f"({e0} / {s})", f"({e1} / {s})"


def _temp_grid_sql() -> str:
    vals = ", ".join(f"({dlit(t)})" for t in TEMPS)
    p0, p1 = _sql_softmax2("logit", "t.T")
    py = f"CASE WHEN y = 1 THEN {p1} ELSE {p0} END"
    clip = f"least(greatest({py}, CAST('1e-15' AS DOUBLE)), CAST(1 AS DOUBLE) - CAST('1e-15' AS DOUBLE))"
    return (f"WITH {SCORED_DOCS},\nt(T) AS (VALUES {vals})\n"
            f"SELECT round(T, 6) AS T, round(avg(-ln({clip})), 6) AS nll FROM scored CROSS JOIN t GROUP BY T")


def _doc_logits(spark, sf_dir) -> DataFrame:
    s = scored_documents(spark, sf_dir)
    return s.select("id", "y", CA.binary_logits(F.col("logit")).alias("logits"))


@register("temperature_grid", _temp_grid_sql())
def q_temperature_grid(spark, sf_dir):
    return rounded(CA.nll_grid(_doc_logits(spark, sf_dir), "logits", "y", TEMPS, n_classes=2))


def _temp_fit_ctes() -> str:
    """The slope of the loss in 1 / T changes sign once: bisection of the
    logarithm, over the margins of the rows (other logit minus true one)."""
    return f"""WITH RECURSIVE {SCORED_DOCS},
mg AS (SELECT CASE WHEN y = 1 THEN -logit ELSE logit END AS d, COUNT(*) AS n FROM scored GROUP BY ALL),
bi(i, lo, hi) AS (
  SELECT 0, ln({dlit(0.1)}), ln({dlit(1000.0)})
  UNION ALL
  SELECT i + 1, CASE WHEN g > 0 THEN lo ELSE mid END, CASE WHEN g > 0 THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, sum(n * d / (1 + exp(-exp((lo + hi) / 2) * d))) AS g
    FROM bi, mg WHERE i < 100 GROUP BY i, lo, hi)),
fitted AS (SELECT exp(-(lo + hi) / 2) AS T FROM bi WHERE i = 100)"""


@register("temperature_fit", _temp_fit_ctes() + "\nSELECT round(T, 6) AS temperature FROM fitted")
def q_temperature_fit(spark, sf_dir):
    d = _doc_logits(spark, sf_dir)
    t = CA.fit_temperature(d, "logits", "y", n_classes=2)
    return rounded(spark.createDataFrame([(t,)], "temperature double"))


def _evaluation_ctes() -> str:
    """Argmax and calibrated predictions of the scored documents, up to the
    curve points and the F1-optimal row."""
    _, p1 = _sql_softmax2("logit", "T")
    return (_temp_fit_ctes() + f""",
cal AS (SELECT y, CAST(logit > 0 AS INTEGER) AS yp, {p1} AS p FROM scored CROSS JOIN fitted)"""
            + CURVE.replace("FROM scored", "FROM cal") + BEST_F1)


def _metric_rows_sql() -> str:
    m = _binary_metric_cols()
    rows = [("temperature", "T", "fitted"), ("roc_auc", "auc", "area"), ("pr_auc", "ap", "area")]
    rows += [(f"optimal_{k}", v, "op") for k, v in (
        ("threshold", "score"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1"),
        ("accuracy", m["accuracy"]), ("recall_weighted", m["recall_weighted"]), ("f1_weighted", m["f1_weighted"]))]
    argmax = [("accuracy", "accuracy", "NULL"), ("precision_weighted", "precision_weighted", "NULL"),
              ("recall_weighted", "recall_weighted", "NULL"), ("f1_weighted", "f1_weighted", "NULL")]
    argmax += [(k, f"{k}_{c}", str(c)) for k in ("precision", "recall", "f1") for c in (0, 1)]
    return _evaluation_ctes() + f""",
area AS (SELECT SUM(CAST(pos AS DOUBLE) * (CAST(n_neg - fps AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(neg AS DOUBLE)))
           / (CAST(MAX(n_pos) AS DOUBLE) * CAST(MAX(n_neg) AS DOUBLE)) AS auc,
         SUM(CAST(pos AS DOUBLE) * precision) / CAST(MAX(n_pos) AS DOUBLE) AS ap FROM pts),
op AS (SELECT score, precision, recall, f1, tps AS tp, fps AS fp, n_pos - tps AS fn, n_neg - fps AS tn,
              n_pos AS n1, n_neg AS n0 FROM best),
am AS (SELECT *, tp + fn AS n1, tn + fp AS n0 FROM (
         SELECT CAST(SUM(y * yp) AS BIGINT) AS tp, CAST(SUM((1 - y) * yp) AS BIGINT) AS fp,
                CAST(SUM(y * (1 - yp)) AS BIGINT) AS fn, CAST(SUM((1 - y) * (1 - yp)) AS BIGINT) AS tn FROM cal)),
bm AS (SELECT {", ".join(f"{v} AS {k}" for k, v in m.items())},
         {_div0("2 * tp", "2 * tp + fp + fn")} AS f1_1, {_div0("2 * tn", "2 * tn + fn + fp")} AS f1_0,
         {_div0("tp", "tp + fp")} AS precision_1, {_div0("tn", "tn + fn")} AS precision_0 FROM am)
""" + "\nUNION ALL ".join(
        [f"SELECT '{k}' AS metric, CAST({c} AS INTEGER) AS class, round({v}, 6) AS value FROM bm" for k, v, c in argmax]
        + [f"SELECT '{k}', CAST(NULL AS INTEGER), round({v}, 6) FROM {frm}" for k, v, frm in rows])


@register("evaluate_head", _metric_rows_sql())
def q_evaluate_head(spark, sf_dir):
    """MO7: argmax metrics, temperature, areas and operating point, from rows scored once."""
    from flowlab.plans.pipelines import evaluate_head
    return rounded(evaluate_head(_doc_logits(spark, sf_dir)))


@register("evaluation_curve", _evaluation_ctes() + """,
nb AS (SELECT *, lag(tps) OVER w AS tp0, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2 FROM pts
       WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 6) AS threshold, round(fpr, 6) AS fpr, round(CAST(tps AS DOUBLE) / CAST(n_pos AS DOUBLE), 6) AS tpr
FROM nb WHERE tp0 IS NULL OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
UNION ALL SELECT NULL, 0.0, 0.0""")
def q_evaluation_curve(spark, sf_dir):
    """PL4: the ROC table that an evaluation writes, read back from the report folder."""
    from flowlab.plans.pipelines import evaluation_tables
    from flowlab.session import ensure_checkpoint_dir
    from flowlab.sources.state import write_report
    path = f"{ensure_checkpoint_dir(spark)}/roc-{uuid.uuid4()}"
    curve = evaluation_tables(_doc_logits(spark, sf_dir))["roc_curve"]
    write_report(curve, path)
    return rounded(spark.read.schema(curve.schema).json(path))


_P0, _P1 = _sql_softmax2("logit", dlit(1.5))


@register("calibrated_probs", f"WITH {SCORED_DOCS}\nSELECT id, round({_P0}, 6) AS p0, round({_P1}, 6) AS p1 FROM scored")
def q_calibrated_probs(spark, sf_dir):
    d = _doc_logits(spark, sf_dir)
    p = CA.calibrated_probs(F.col("logits"), 1.5)
    return rounded(d.select("id", p[0].alias("p0"), p[1].alias("p1")))


# ------------------------------------------------------------ fixed heads

HEAD_W = {h: MO.linear_head_weights(h, DIM, 2, scale=1.0) for h in MO.HEADS}
# head parameters as stored by calibration: exfiltration has no row (default
# threshold), intrusion's non-positive temperature is ignored.
HEAD_PARAMS = [("dos", 0.6, 1.5), ("port_scan", 0.7, None), ("intrusion", 0.55, -1.0)]




def _with_heads(spark, df: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """Stage per-head logits as columns, then the heads array (each array
    expression is evaluated once per row, not re-inlined)."""
    lg = df.select(*keep, *[MO.linear_logits(F.col(vec), HEAD_W[h]).alias(f"lg_{h}") for h in MO.HEADS])
    heads = AL.head_probs({h: F.col(f"lg_{h}") for h in MO.HEADS}, _resolved(spark))
    return lg.select(*keep, heads.alias("heads"))


def _sql_logits(vec: str, head: str) -> str:
    return MO.sql_linear_logits(vec, HEAD_W[head])


def _resolved(spark):
    return AL.resolve_params(spark, MO.HEADS, AL.head_params(spark, HEAD_PARAMS))


def _sql_head_p(head: str, thr_temp: tuple[float, float | None], vec: str = "embedding") -> str:
    _, temp = thr_temp
    lg = _sql_logits(vec, head)
    t = dlit(temp) if (temp is not None and temp > 0) else None
    a, b = (f"({lg})[1]", f"({lg})[2]")
    if t:
        a, b = f"({a} / {t})", f"({b} / {t})"
    m = f"greatest({a}, {b})"
    e0, e1 = f"exp({a} - {m})", f"exp({b} - {m})"
    return f"({e1} / ((CAST(0 AS DOUBLE) + {e0}) + {e1}))"


def _sql_head_table() -> str:
    params = {h: (0.5, None) for h in MO.HEADS}
    for h, thr, temp in HEAD_PARAMS:
        params[h] = (thr, temp)
    cols = ", ".join(f"{_sql_head_p(h, params[h])} AS p_{h}" for h in MO.HEADS)
    return f"hp AS (SELECT vec_id, label, embedding, {cols} FROM embeddings)", params


HP_SQL, HP_PARAMS = _sql_head_table()


@register("head_probs", f"WITH {HP_SQL}\nSELECT vec_id, " + ", ".join(f"round(p_{h}, 6) AS p_{h}" for h in MO.HEADS)
          + " FROM hp")
def q_head_probs(spark, sf_dir):
    h = _with_heads(spark, emb(spark, sf_dir), "embedding", ["vec_id"])
    return rounded(h.select("vec_id", *[F.col("heads")[i]["p"].alias(f"p_{n}") for i, n in enumerate(MO.HEADS)]))


def _chain_sum(terms: list[str]) -> str:
    """((((0 + t1) + t2) + ...): the left-to-right order of Spark's aggregate."""
    return "(" * len(terms) + "CAST(0 AS DOUBLE)" + "".join(f" + {t})" for t in terms)


@register("head_scores", "SELECT vec_id, " + ", ".join(
    f"{_r6_list(_sql_logits('embedding', h))} AS logits_{h}" for h in MO.HEADS) + " FROM embeddings")
def q_head_scores(spark, sf_dir):
    """MO3/MO4 raw logits of every named head (before temperature)."""
    e = emb(spark, sf_dir)
    return rounded(e.select("vec_id", *[MO.linear_logits(F.col("embedding"), HEAD_W[h]).alias(f"logits_{h}")
                                        for h in MO.HEADS]))


@register("head_ensemble", f"WITH {HP_SQL}\nSELECT vec_id, round(CASE WHEN s > 0 THEN ss / s ELSE 0.0 END, 6) "
          f"AS ensemble FROM (SELECT vec_id, {_chain_sum([f'p_{h}' for h in MO.HEADS])} AS s, "
          f"{_chain_sum([f'p_{h} * p_{h}' for h in MO.HEADS])} AS ss FROM hp)")
def q_head_ensemble(spark, sf_dir):
    h = _with_heads(spark, emb(spark, sf_dir), "embedding", ["vec_id"])
    return rounded(h.select("vec_id", AL.head_ensemble(F.col("heads")).alias("ensemble")))


# ---------------------------------------------------------------- anomaly

BENIGN_MAX_LABEL = 7   # embeddings with label <= 7 play the benign training rows

RECON_SQL = """recon AS (
  SELECT label, list(m ORDER BY i) AS recon FROM (
    SELECT label, i, round(avg(x), 6) AS m FROM (
      SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
err AS (
  SELECT e.vec_id, e.label, list_reduce(list_transform(e.embedding, lambda x, i:
           (CAST(x AS DOUBLE) - r.recon[i]) * (CAST(x AS DOUBLE) - r.recon[i])), lambda a, b: a + b)
           / CAST(len(e.embedding) AS DOUBLE) AS err
  FROM embeddings e JOIN recon r ON e.label = r.label),
thr AS (SELECT quantile_cont(err, 0.95) AS t FROM err WHERE label <= 7)"""


def _errors(spark, sf_dir) -> tuple[DataFrame, float]:
    e = emb(spark, sf_dir)
    recon = AN.group_mean_vectors(e, "embedding", "label")
    err = AN.reconstruction_errors(e, "embedding", recon, "label")
    thr = AN.exact_percentile(err.where(F.col("label") <= BENIGN_MAX_LABEL), "err", 0.95).first()[0]
    return err, float(thr)


@register("ae_p95", f"WITH {RECON_SQL}\nSELECT round(t, 6) AS threshold FROM thr")
def q_ae_p95(spark, sf_dir):
    _, thr = _errors(spark, sf_dir)
    return rounded(spark.createDataFrame([(thr,)], "threshold double"))


SCORE_SQL = """scored_err AS (SELECT vec_id, err, least(greatest(err / greatest(t, CAST('1e-08' AS DOUBLE)), 0.0), 1.0) AS score,
  err > t AS is_anomaly FROM err CROSS JOIN thr)"""
SEV_SQL = ("CASE WHEN score > 0.9 THEN 'CRITICAL' WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.5 THEN 'MEDIUM' "
           "ELSE 'LOW' END")


@register("anomaly_score", f"WITH {RECON_SQL},\n{SCORE_SQL}\nSELECT vec_id, round(err, 6) AS err, round(score, 6) AS score, "
          f"is_anomaly, {SEV_SQL} AS severity FROM scored_err")
def q_anomaly_score(spark, sf_dir):
    err, thr = _errors(spark, sf_dir)
    s = AN.score_errors(F.col("err"), thr)
    return rounded(err.select("vec_id", "err", s["score"].alias("score"), s["is_anomaly"].alias("is_anomaly"),
                              s["severity"].alias("severity")))


@register("outlier_flag", f"WITH {RECON_SQL},\n{SCORE_SQL}\nSELECT vec_id, is_anomaly FROM scored_err")
def q_outlier_flag(spark, sf_dir):
    """PR21: err > fitted p95 (strict)."""
    err, thr = _errors(spark, sf_dir)
    return err.select("vec_id", AN.score_errors(F.col("err"), thr)["is_anomaly"].alias("is_anomaly"))


@register("severity", f"WITH {RECON_SQL},\n{SCORE_SQL}\nSELECT vec_id, {SEV_SQL} AS severity FROM scored_err")
def q_severity(spark, sf_dir):
    """PR22: strict bands on the anomaly score."""
    err, thr = _errors(spark, sf_dir)
    return err.select("vec_id", AN.score_errors(F.col("err"), thr)["severity"].alias("severity"))


@register("severity_counts", f"WITH {RECON_SQL},\n{SCORE_SQL}\nSELECT {SEV_SQL} AS severity, "
          f"CAST(COUNT(*) AS BIGINT) AS n FROM scored_err GROUP BY 1")
def q_severity_counts(spark, sf_dir):
    err, thr = _errors(spark, sf_dir)
    s = AN.score_errors(F.col("err"), thr)
    return err.select(s["severity"].alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


GLOBAL_RECON_SQL = """grecon AS (
  SELECT list(m ORDER BY i) AS recon FROM (
    SELECT i, round(avg(x), 6) AS m FROM (
      SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY i)),
err2 AS (
  SELECT e.vec_id, e.label, list_reduce(list_transform(e.embedding, lambda x, i:
           (CAST(x AS DOUBLE) - r.recon[i]) * (CAST(x AS DOUBLE) - r.recon[i])), lambda a, b: a + b)
           / CAST(len(e.embedding) AS DOUBLE) AS err
  FROM embeddings e CROSS JOIN grecon r),
thr2 AS (SELECT quantile_cont(err, 0.95) AS t FROM err2 WHERE label <= 7)"""


@register("ensemble", f"WITH {RECON_SQL},\n{SCORE_SQL},\n{GLOBAL_RECON_SQL}\n"
          "SELECT s.vec_id, round(0.6::DOUBLE * s.score + 0.4::DOUBLE * least(greatest(e2.err / "
          "greatest(thr2.t, CAST('1e-08' AS DOUBLE)), 0.0), 1.0), 6) AS ensemble "
          "FROM scored_err s JOIN err2 e2 ON s.vec_id = e2.vec_id CROSS JOIN thr2")
def q_ensemble(spark, sf_dir):
    err, thr = _errors(spark, sf_dir)
    e = emb(spark, sf_dir)
    g = AN.group_mean_vectors(e.withColumn("_g", F.lit(0)), "embedding", "_g")
    err2 = AN.reconstruction_errors(e.withColumn("_g", F.lit(0)), "embedding", g, "_g")
    thr2 = float(AN.exact_percentile(err2.where(F.col("label") <= BENIGN_MAX_LABEL), "err", 0.95).first()[0])
    j = err.select("vec_id", A.anomaly_score(F.col("err"), thr).alias("s1")).join(
        err2.select("vec_id", A.anomaly_score(F.col("err"), thr2).alias("s2")), "vec_id")
    return rounded(j.select("vec_id", A.ensemble(F.col("s1"), F.col("s2")).alias("ensemble")))


@register("env_thresholds", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS threshold FROM events "
                            "GROUP BY event_type")
def q_env_thresholds(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(AN.exact_percentile(ev, "value", 0.95, ["event_type"], out_col="threshold"))


def _mahalanobis_sql() -> str:
    """Mean and covariance of the benign rows, the inverse by Gauss-Jordan
    steps over (row, column, value)."""
    return f"""WITH RECURSIVE x AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mu AS (SELECT i, avg(x) AS m FROM x WHERE label <= {BENIGN_MAX_LABEL} GROUP BY i),
d AS (SELECT vec_id, label, x.i, x.x - mu.m AS d FROM x JOIN mu ON x.i = mu.i),
cov AS (SELECT p.i, q.i AS j, sum(p.d * q.d) / (COUNT(*) - 1) AS v FROM d p JOIN d q ON p.vec_id = q.vec_id
        WHERE p.label <= {BENIGN_MAX_LABEL} GROUP BY p.i, q.i),
gj AS (
  SELECT 1 AS k, i, j, v FROM cov
  UNION ALL SELECT 1, i, i + {DIM}, 1.0::DOUBLE FROM mu
  UNION ALL SELECT 1, a.i, b.i + {DIM}, 0.0::DOUBLE FROM mu a JOIN mu b ON a.i <> b.i),
steps AS (
  SELECT k, i, j, v FROM gj
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k THEN prow / piv ELSE v - pcol * (prow / piv) END FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS prow,
           max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS pcol,
           max(CASE WHEN i = k AND j = k THEN v END) OVER () AS piv
    FROM steps WHERE k <= {DIM})),
inv AS (SELECT i, j - {DIM} AS j, v FROM steps WHERE k = {DIM} + 1 AND j > {DIM})
SELECT p.vec_id, round(sqrt(greatest(sum(p.d * inv.v * q.d), 0.0)), 6) AS distance
FROM d p JOIN inv ON p.i = inv.i JOIN d q ON q.vec_id = p.vec_id AND q.i = inv.j GROUP BY p.vec_id"""


@register("mahalanobis", _mahalanobis_sql())
def q_mahalanobis(spark, sf_dir):
    e = emb(spark, sf_dir)
    benign = e.where(F.col("label") <= BENIGN_MAX_LABEL)
    mu, inv = AN.fit_mahalanobis(benign, "embedding")
    return rounded(AN.mahalanobis(e, "embedding", mu, inv, ["vec_id"]))


TREES, PSI = 200, 256


def _forest_sql(levels: int = 8) -> str:
    """The forest level by level, and every row's walk through it.  ``levels``
    is the depth for PSI rows; a smaller table makes shallower trees."""
    u = sql_uniform
    ctes = [f"b AS (SELECT vec_id AS rid, embedding::DOUBLE[] AS v FROM embeddings WHERE label <= {BENIGN_MAX_LABEL})",
            f"""size AS (SELECT *, ceil(log2(psi)) AS depth, least(1.0::DOUBLE, {dlit(1.2)} * {TREES} * psi / n) AS rate,
      greatest(1, ceil({dlit(1.2)} * {TREES} * psi / n))::BIGINT AS times
      FROM (SELECT COUNT(*) AS n, greatest(least({PSI}, COUNT(*)), 2) AS psi FROM b))""",
            f"""dealt AS (SELECT DISTINCT rid, CAST(floor({u('42', 'rid', 'c', "'tree'")} * {TREES}) AS INTEGER) AS t
      FROM b, size, range(1, times + 1) r(c) WHERE {u('42', 'rid', "'if'")} < rate)""",
            f"""s0 AS (SELECT t, dealt.rid, v, 0 AS node FROM (
      SELECT t, rid, row_number() OVER (PARTITION BY t ORDER BY {u('42', 'rid', 't')}, rid) AS k FROM dealt) dealt
      JOIN b ON b.rid = dealt.rid, size WHERE k <= psi)""",
            "w0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, t, 0 AS node FROM embeddings, (SELECT DISTINCT t FROM s0))"]
    for d in range(levels + 1):
        ctes += [f"f{d} AS (SELECT t, node, i, min(x) AS lo, max(x) AS hi FROM (SELECT t, node, unnest(v) AS x, "
                 f"generate_subscripts(v, 1) AS i FROM s{d}) GROUP BY t, node, i)",
                 f"c{d} AS (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY i) - 1 AS k, COUNT(*) OVER (PARTITION BY t, node) AS m "
                 f"FROM f{d} WHERE hi > lo)",
                 f"p{d} AS MATERIALIZED (SELECT t, node, i, lo + {u('42', 't', 'node', chr(39) + 't' + chr(39))} * (hi - lo) AS thr FROM c{d}, size "
                 f"WHERE {d} < depth AND k = CAST(floor({u('42', 't', 'node', chr(39) + 'f' + chr(39))} * m) AS BIGINT))",
                 f"l{d} AS (SELECT t, node, {d} + {_sql_path('COUNT(*)')} AS path FROM s{d} ANTI JOIN p{d} USING (t, node) GROUP BY t, node)",
                 f"s{d + 1} AS MATERIALIZED (SELECT t, rid, v, 2 * node + 1 + CAST(v[i] >= thr AS INTEGER) AS node FROM s{d} JOIN p{d} USING (t, node))",
                 f"w{d + 1} AS MATERIALIZED (SELECT vec_id, label, v, t, 2 * node + 1 + CAST(v[i] >= thr AS INTEGER) AS node FROM w{d} JOIN p{d} USING (t, node))"]
    paths = "\n  UNION ALL ".join(f"SELECT vec_id, label, path FROM w{d} JOIN l{d} USING (t, node)" for d in range(levels + 1))
    ctes += [f"paths AS ({paths})", "psi AS (SELECT max(n) AS n FROM (SELECT COUNT(*) AS n FROM s0 GROUP BY t))",
             f"""scored AS (SELECT vec_id, label, least(greatest(pow(2.0::DOUBLE, -avg(path) / (SELECT {_sql_path('greatest(n, 2)')} FROM psi)), 0.0), 1.0)
      AS s FROM paths GROUP BY vec_id, label)""",
             f"cut AS (SELECT quantile_cont(s, 0.95) AS c FROM scored WHERE label <= {BENIGN_MAX_LABEL})"]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, label, round(s, 6) AS if_score, s > c AS is_anomaly FROM scored, cut"


def _sql_path(n: str) -> str:
    return (f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln(greatest({n} - 1, 1)::DOUBLE) + {dlit(AN.EULER)}) "
            f"- 2.0::DOUBLE * ({n} - 1) / ({n})::DOUBLE END")


@register("iforest", _forest_sql())
def q_iforest(spark, sf_dir):
    e = emb(spark, sf_dir)
    benign = e.where(F.col("label") <= BENIGN_MAX_LABEL)
    forest = AN.fit_isolation_forest(benign, "embedding", "vec_id", TREES, PSI)
    s = cut(AN.score_isolation_forest(e, "embedding", forest, ["vec_id", "label"]))
    at = AN.exact_percentile(s.where(F.col("label") <= BENIGN_MAX_LABEL), "if_score", 0.95).first()[0]
    return rounded(s.withColumn("is_anomaly", F.col("if_score") > F.lit(at)))


# ------------------------------------------------------------------ alerts

def _alert_frame(spark, sf_dir) -> DataFrame:
    err, thr = _errors(spark, sf_dir)
    e = emb(spark, sf_dir).join(err.select("vec_id", "err"), "vec_id")
    h = _with_heads(spark, e, "embedding", ["vec_id", "err"])
    x = h.select(F.concat(F.lit("flow_"), F.col("vec_id").cast("string")).alias("flow_id"),
                 "heads", A.anomaly_score(F.col("err"), thr).alias("anomaly"))
    return AL.alerts(x, "flow_id", F.col("heads"), F.col("anomaly"), with_timestamp=False)


def _route_sql() -> str:
    heads = MO.HEADS
    thr = {h: HP_PARAMS[h][0] for h in heads}
    qual = " OR ".join(f"p_{h} >= {dlit(thr[h])}" for h in heads)
    # margin ranking: a struct ordered by (margin desc, head order asc)
    cands = " UNION ALL ".join(
        f"SELECT vec_id, {i} AS ord, '{h}' AS head, p_{h} AS p, p_{h} - {dlit(thr[h])} AS margin FROM hp "
        f"WHERE p_{h} >= {dlit(thr[h])}" for i, h in enumerate(heads))
    maxraw = "greatest(0.0::DOUBLE, " + ", ".join(f"p_{h}" for h in heads) + ")"
    return f"""WITH {RECON_SQL},\n{SCORE_SQL},\n{HP_SQL},
cand AS ({cands}),
best AS (SELECT vec_id, arg_max(head, (margin, -ord)) AS head, arg_max(p, (margin, -ord)) AS p FROM cand GROUP BY vec_id),
al AS (SELECT 'flow_' || CAST(hp.vec_id AS VARCHAR) AS flow_id,
  CASE WHEN b.head IS NOT NULL THEN b.head WHEN s.score >= {dlit(0.65)} THEN 'zero-day / unknown' ELSE NULL END AS attack_type,
  CASE WHEN b.head IS NOT NULL THEN b.p ELSE {maxraw} END AS confidence,
  s.score AS anomaly_score, {SEV_SQL.replace('score', 's.score')} AS severity
  FROM hp JOIN scored_err s ON hp.vec_id = s.vec_id LEFT JOIN best b ON hp.vec_id = b.vec_id)"""


@register("route_alerts", _route_sql() + "\nSELECT flow_id, attack_type, round(confidence, 6) AS confidence, "
          "round(anomaly_score, 6) AS anomaly_score, severity FROM al")
def q_route_alerts(spark, sf_dir):
    return rounded(_alert_frame(spark, sf_dir))


@register("alert_severity_counts", _route_sql() + "\nSELECT severity, attack_type, CAST(COUNT(*) AS BIGINT) AS n "
          "FROM al GROUP BY severity, attack_type")
def q_alert_severity_counts(spark, sf_dir):
    return _alert_frame(spark, sf_dir).groupBy("severity", "attack_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ losses

def _pairs(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).cast("long").alias("k"),
                                  (F.col("vec_id") % 2).alias("view"), "embedding")
    # vectors 2k and 2k+1 are the two views of pair k; an unpaired last vector is left out
    g = e.groupBy("k").agg(F.max_by("embedding", -F.col("view")).alias("z1"),
                           F.max_by("embedding", F.col("view")).alias("z2"), F.count(F.lit(1)).alias("n"))
    p = g.where(F.col("n") == 2)
    return p.select(F.floor(F.col("k") / 32).cast("long").alias("batch_id"), (F.col("k") % 32).cast("int").alias("pos"),
                    "z1", "z2")


NTX_SQL = """WITH z AS (
  SELECT vec_id // 2 AS k, vec_id % 2 AS view, (vec_id // 2) // 32 AS batch_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
zn AS (SELECT k, view, batch_id, list_transform(v, lambda x: x / sqrt(list_reduce(list_transform(v, lambda y: y * y),
         lambda a, b: a + b))) AS v FROM z),
full_pairs AS (SELECT k FROM zn GROUP BY k HAVING COUNT(*) = 2),
r AS (SELECT zn.* FROM zn JOIN full_pairs USING (k)),
sims AS (SELECT a.batch_id, a.k, a.view, b.k AS k2, b.view AS view2,
         list_reduce(list_transform(a.v, lambda x, i: x * b.v[i]), lambda p, q: p + q) / 0.1::DOUBLE AS s
         FROM r a JOIN r b ON a.batch_id = b.batch_id AND NOT (a.k = b.k AND a.view = b.view)),
per AS (SELECT batch_id, k, view, ln(SUM(exp(s))) - MAX(CASE WHEN k2 = k THEN s END) AS loss FROM sims
        GROUP BY batch_id, k, view)
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(avg(loss), 6) AS loss, CAST(COUNT(*) AS BIGINT) AS n_rows
FROM per GROUP BY batch_id"""


@register("nt_xent", NTX_SQL)
def q_nt_xent(spark, sf_dir):
    return rounded(LO.nt_xent(_pairs(spark, sf_dir)))


DOS_Y = "CAST(label IN (1, 2) AS INTEGER)"


def _dos_y() -> Column:
    return F.col("label").isin(1, 2).cast("int")


CW_SQL = f"""cw AS (SELECT y, least(CAST(t.n AS DOUBLE) / (CAST(t.k AS DOUBLE) * CAST(c.n AS DOUBLE)), 10.0::DOUBLE) AS w
  FROM (SELECT {DOS_Y} AS y, COUNT(*) AS n FROM embeddings GROUP BY 1) c
  CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT {DOS_Y}) AS k FROM embeddings) t)"""


def _sql_ce(lg: str, y: str) -> str:
    m = f"greatest(({lg})[1], ({lg})[2])"
    lse = f"({m} + ln((CAST(0 AS DOUBLE) + exp(({lg})[1] - {m})) + exp(({lg})[2] - {m})))"
    return f"({lse} - ({lg})[{y} + 1])"


def _sql_p(lg: str, idx: str) -> str:
    m = f"greatest(({lg})[1], ({lg})[2])"
    e0, e1 = f"exp(({lg})[1] - {m})", f"exp(({lg})[2] - {m})"
    return f"(CASE WHEN {idx} = 0 THEN {e0} ELSE {e1} END / ((CAST(0 AS DOUBLE) + {e0}) + {e1}))"


_DOS_LG = _sql_logits("embedding", "dos")


@register("focal_loss", f"WITH {CW_SQL}\nSELECT vec_id, round(pow(1.0::DOUBLE - {_sql_p(_DOS_LG, 'e.y')}, 2.0::DOUBLE) * "
          f"{_sql_ce(_DOS_LG, 'e.y')} * cw.w, 6) AS focal FROM (SELECT *, {DOS_Y} AS y FROM embeddings) e "
          f"JOIN cw ON e.y = cw.y")
def q_focal_loss(spark, sf_dir):
    from flowlab.operators.metrics import class_weights
    e = emb(spark, sf_dir).withColumn("y", _dos_y())
    cw = class_weights(e, "y", cap=10.0).select(F.col("class").alias("y"), F.col("weight"))
    j = e.join(F.broadcast(cw), "y")
    lg = MO.linear_logits(F.col("embedding"), HEAD_W["dos"])
    return rounded(j.select("vec_id", LO.focal_loss(lg, F.col("y"), F.col("weight")).alias("focal")))


_WEAK_LG = _sql_logits(_sql_noise("embedding", 0.02, "w"), "dos")


def _sql_pseudo(lg: str) -> tuple[str, str]:
    p0, p1 = _sql_p(lg, "0"), _sql_p(lg, "1")
    lab = f"(CASE WHEN {p1} > {p0} THEN 1 ELSE 0 END)"
    cut = f"(CASE WHEN {lab} = 0 THEN {dlit(0.9 + 0.05)} ELSE {dlit(0.9 - 0.2)} END)"
    mask = f"CAST(greatest({p0}, {p1}) >= {cut} AS DOUBLE)"
    return lab, mask


_PL, _PM = _sql_pseudo(_WEAK_LG)


@register("pseudo_labels", f"SELECT vec_id, CAST({_PL} AS INTEGER) AS pseudo, {_PM} AS mask FROM embeddings")
def q_pseudo_labels(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", AU.weak(F.col("embedding"), F.col("vec_id"), "w").alias("weak"))
    lg = e.select("vec_id", MO.linear_logits(F.col("weak"), HEAD_W["dos"]).alias("lg"))
    p = lg.select("vec_id", A.softmax(F.col("lg")).alias("p"))
    lab, mask = LO.pseudo_label_from_probs(F.col("p"))
    return p.select("vec_id", lab.alias("pseudo"), mask.alias("mask"))


def _sql_sharpen(lg: str) -> tuple[str, str]:
    p0, p1 = _sql_p(lg, "0"), _sql_p(lg, "1")
    a, b = f"pow({p0}, 2.0::DOUBLE)", f"pow({p1}, 2.0::DOUBLE)"
    s = f"((CAST(0 AS DOUBLE) + {a}) + {b})"
    return f"({a} / {s})", f"({b} / {s})"


_S0, _S1 = _sql_sharpen(_DOS_LG)


@register("sharpen", f"SELECT vec_id, round({_S0}, 6) AS s0, round({_S1}, 6) AS s1 FROM embeddings")
def q_sharpen(spark, sf_dir):
    e = emb(spark, sf_dir)
    s = A.sharpen(A.softmax(MO.linear_logits(F.col("embedding"), HEAD_W["dos"])), 0.5)
    return rounded(e.select("vec_id", s[0].alias("s0"), s[1].alias("s1")))


EPOCHS, WARMUP = 3, 1


def _labeled(row_id: Column) -> Column:
    """A quarter of the rows carry labels (hash split; every row is used)."""
    return uniform(F.lit(42), row_id, F.lit("lab")) < F.lit(0.25)


def _fixmatch_frame(spark, sf_dir) -> DataFrame:
    from flowlab.operators.metrics import class_weights
    e = emb(spark, sf_dir).withColumn("y", _dos_y()).withColumn("labeled", _labeled(F.col("vec_id")))
    cw = class_weights(e.where(F.col("labeled")), "y", cap=10.0).select(F.col("class").alias("y"), "weight")
    e = e.join(F.broadcast(cw), "y", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    e = e.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    vid = F.col("vec_id")
    w = HEAD_W["dos"]
    ep = F.col("epoch").cast("string")
    rid = F.concat(vid.cast("string"), F.lit(":"), ep)
    v = e.select("epoch", F.floor(vid / 64).cast("long").alias("batch_id"), "labeled", "y", "weight",
                 AU.weak(F.col("embedding"), rid, "w").alias("v_l"), AU.weak(F.col("embedding"), rid, "uw").alias("v_w"),
                 AU.strong(F.col("embedding"), rid, "us").alias("v_s"))
    x = v.select("epoch", "batch_id", "labeled", "y", "weight", MO.linear_logits(F.col("v_l"), w).alias("lg_l"),
                 MO.linear_logits(F.col("v_w"), w).alias("lg_w"), MO.linear_logits(F.col("v_s"), w).alias("lg_s"))
    lam = F.when(F.col("epoch") < WARMUP, F.lit(0.0)).otherwise(F.lit(1.0))
    return LO.fixmatch_batch_losses(x, "labeled", "lg_l", "y", "weight", "lg_w", "lg_s", lam)


def _fixmatch_sql() -> str:
    rid = "(CAST(vec_id AS VARCHAR) || ':' || CAST(epoch AS VARCHAR))"

    def noise(view, sigma):
        return _sql_noise("embedding", sigma, view, rid)

    def strong(view):
        return _sql_strong("embedding", view, rid)

    lab = f"({sql_uniform('42', 'vec_id', chr(39) + 'lab' + chr(39))} < {dlit(0.25)})"
    lg_l, lg_w, lg_s = _sql_logits(noise("w", 0.02), "dos"), _sql_logits(noise("uw", 0.02), "dos"), \
        _sql_logits(strong("us"), "dos")
    pl, pm = _sql_pseudo("lg_w")
    return f"""WITH base AS (SELECT vec_id, embedding, {DOS_Y} AS y, {lab} AS labeled FROM embeddings),
cwt AS (SELECT y, least(CAST(t.n AS DOUBLE) / (CAST(t.k AS DOUBLE) * CAST(c.n AS DOUBLE)), 10.0::DOUBLE) AS w
  FROM (SELECT y, COUNT(*) AS n FROM base WHERE labeled GROUP BY y) c
  CROSS JOIN (SELECT COUNT(*) AS n, COUNT(DISTINCT y) AS k FROM base WHERE labeled) t),
ep AS (SELECT b.*, coalesce(cwt.w, 1.0::DOUBLE) AS weight, e.epoch FROM base b LEFT JOIN cwt ON b.y = cwt.y
       CROSS JOIN range({EPOCHS}) e(epoch)),
lg AS (SELECT epoch, vec_id // 64 AS batch_id, labeled, y, weight, {lg_l} AS lg_l, {lg_w} AS lg_w, {lg_s} AS lg_s FROM ep),
rows AS (SELECT epoch, batch_id, labeled,
  CASE WHEN labeled THEN pow(1.0::DOUBLE - {_sql_p('lg_l', 'y')}, 2.0::DOUBLE) * {_sql_ce('lg_l', 'y')} * weight END AS ls,
  CASE WHEN NOT labeled THEN {_sql_ce('lg_s', pl)} * {pm} END AS lu,
  CASE WHEN NOT labeled THEN {pm} END AS m,
  CASE WHEN epoch < {WARMUP} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS lam FROM lg),
fm AS (SELECT CAST(epoch AS INTEGER) AS epoch, CAST(batch_id AS BIGINT) AS batch_id, avg(ls) AS loss_s, avg(lu) AS loss_u,
  avg(ls) + MAX(lam) * avg(lu) AS total_loss, avg(m) AS mask_rate FROM rows GROUP BY epoch, batch_id)"""


FM_SQL = _fixmatch_sql()


@register("fixmatch_loss", FM_SQL + "\nSELECT epoch, batch_id, round(loss_s, 6) AS loss_s, round(loss_u, 6) AS loss_u, "
          "round(total_loss, 6) AS total_loss, round(mask_rate, 6) AS mask_rate FROM fm")
def q_fixmatch_loss(spark, sf_dir):
    return rounded(_fixmatch_frame(spark, sf_dir))


@register("epoch_history", FM_SQL + "\nSELECT epoch, round(avg(loss_s), 6) AS loss_s, round(avg(loss_u), 6) AS loss_u, "
          "round(avg(total_loss), 6) AS total_loss, round(avg(mask_rate), 6) AS mask_rate FROM fm "
          "WHERE total_loss IS NOT NULL AND NOT isnan(total_loss) GROUP BY epoch")
def q_epoch_history(spark, sf_dir):
    return rounded(LO.epoch_history(_fixmatch_frame(spark, sf_dir)))


def _mixmatch_sql() -> str:
    weak = _sql_noise("embedding", 0.02, "w")
    strong = _sql_strong("embedding", "s")
    avg = f"list_transform({weak}, lambda x, i: (x + ({strong})[i]) / 2.0::DOUBLE)"
    lg_avg, lg_u = _sql_logits(avg, "dos"), _sql_logits(weak, "dos")
    s0, s1 = _sql_sharpen("lg_avg")
    q0, q1 = _sql_p("lg_u", "0"), _sql_p("lg_u", "1")
    lab = f"({sql_uniform('42', 'vec_id', chr(39) + 'lab' + chr(39))} < {dlit(0.25)})"
    return f"""WITH base AS (SELECT vec_id, vec_id // 64 AS batch_id, {DOS_Y} AS y, {lab} AS labeled,
  {_DOS_LG} AS lg_x, {lg_avg} AS lg_avg, {lg_u} AS lg_u FROM embeddings),
rows AS (SELECT batch_id, CASE WHEN labeled THEN {_sql_ce('lg_x', 'y')} END AS ls,
  CASE WHEN NOT labeled THEN ((CAST(0 AS DOUBLE) + ({q0} - {s0}) * ({q0} - {s0})) + ({q1} - {s1}) * ({q1} - {s1}))
       / 2.0::DOUBLE END AS lu FROM base)
SELECT CAST(batch_id AS BIGINT) AS batch_id, round(avg(ls), 6) AS loss_s, round(avg(lu), 6) AS loss_u,
       round(avg(ls) + 1.0::DOUBLE * avg(lu), 6) AS total_loss FROM rows GROUP BY batch_id"""


@register("mixmatch_loss", _mixmatch_sql())
def q_mixmatch_loss(spark, sf_dir):
    e = emb(spark, sf_dir)
    vid = F.col("vec_id")
    w = HEAD_W["dos"]
    v = e.select("vec_id", "embedding", "label", AU.weak(F.col("embedding"), vid, "w").alias("weak"),
                 AU.strong(F.col("embedding"), vid, "s").alias("strong"))
    lg = v.select("vec_id", "label", MO.linear_logits(F.col("embedding"), w).alias("lg_x"),
                  MO.linear_logits(A.average(F.col("weak"), F.col("strong")), w).alias("lg_avg"),
                  MO.linear_logits(F.col("weak"), w).alias("lg_u"))
    pr = lg.select("vec_id", "label", "lg_x", A.softmax(F.col("lg_avg")).alias("p_avg"),
                   A.softmax(F.col("lg_u")).alias("probs_u"))
    pr = pr.select("vec_id", "label", "lg_x", "probs_u", A.sharpen(F.col("p_avg"), 0.5).alias("pseudo"))
    x = pr.select(F.floor(vid / 64).cast("long").alias("batch_id"), _labeled(vid).alias("labeled"),
                  LO.cross_entropy(F.col("lg_x"), _dos_y()).alias("ce"),
                  LO.mixmatch_terms(F.col("probs_u"), F.col("pseudo")).alias("mse"))
    g = x.groupBy("batch_id").agg(F.avg(F.when(F.col("labeled"), F.col("ce"))).alias("loss_s"),
                                  F.avg(F.when(~F.col("labeled"), F.col("mse"))).alias("loss_u"))
    return rounded(g.select("batch_id", "loss_s", "loss_u", (F.col("loss_s") + F.lit(1.0) * F.col("loss_u"))
                            .alias("total_loss")))


# ----------------------------------------------------- evaluation history

TASK_Y = {"dos": "label IN (1, 2)", "port_scan": "label IN (3, 4)", "intrusion": "label >= 1"}
TASKS = ["dos", "port_scan", "intrusion"]


def _task_f1_sql() -> str:
    parts = []
    for i, t in enumerate(TASKS):
        p = _sql_head_p(t, (0.5, None))
        parts.append(f"SELECT '{t}' AS task, {i} AS task_ord, CAST({TASK_Y[t]} AS INTEGER) AS y, "
                     f"CAST({p} >= 0.5::DOUBLE AS INTEGER) AS yp FROM embeddings")
    return "preds AS (" + " UNION ALL ".join(parts) + """),
f1 AS (SELECT task, task_ord, CASE WHEN 2 * SUM(y * yp) + SUM((1 - y) * yp) + SUM(y * (1 - yp)) = 0 THEN 0.0::DOUBLE
   ELSE CAST(2 * SUM(y * yp) AS DOUBLE) / CAST(2 * SUM(y * yp) + SUM((1 - y) * yp) + SUM(y * (1 - yp)) AS DOUBLE) END AS f1
   FROM preds GROUP BY task, task_ord)"""


@register("forgetting_matrix", "WITH " + _task_f1_sql() + "\nSELECT task, CAST(task_ord AS INTEGER) AS task_ord, "
          + ", ".join(f"round(CASE WHEN task_ord <= {j} THEN f1 ELSE 0.0 END, 6) AS \"{j}\"" for j in range(3))
          + " FROM f1")
def q_forgetting_matrix(spark, sf_dir):
    from flowlab.operators.metrics import forgetting_matrix
    e = emb(spark, sf_dir)
    rows = None
    for i, t in enumerate(TASKS):
        p = A.attack_probability(A.softmax(MO.linear_logits(F.col("embedding"), HEAD_W[t])))
        x = e.select(F.lit(t).alias("task"), F.lit(i).alias("task_ord"), F.expr(TASK_Y[t]).cast("int").alias("y"),
                     (p >= F.lit(0.5)).cast("int").alias("yp"))
        rows = x if rows is None else rows.unionByName(x)
    f1 = rows.groupBy("task", "task_ord").agg(
        F.sum(F.col("y") * F.col("yp")).alias("tp"), F.sum((1 - F.col("y")) * F.col("yp")).alias("fp"),
        F.sum(F.col("y") * (1 - F.col("yp"))).alias("fn"))
    f1 = f1.select("task", "task_ord", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(0.0)).otherwise(
        (2 * F.col("tp")).cast("double") / (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")).alias("f1"))
    # after training stage j every task trained so far (ord <= j) is re-evaluated
    res = f1.withColumn("stage", F.explode(F.sequence(F.col("task_ord"), F.lit(len(TASKS) - 1))))
    return rounded(forgetting_matrix(res.select("task", "task_ord", F.col("stage").cast("string").alias("stage"),
                                                "f1")))


# ------------------------------------------------------- gradient memory

def _batch_means(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 32).cast("long"))
    m = AN.group_mean_vectors(e, "embedding", "batch_id")
    return m.select(F.col("batch_id").alias("row_id"), F.col("recon").alias("vec"))


BM_SQL = """bm AS (
  SELECT batch_id AS row_id, list(m ORDER BY i) AS vec FROM (
    SELECT batch_id, i, round(avg(x), 6) AS m FROM (
      SELECT vec_id // 32 AS batch_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
      FROM embeddings) GROUP BY batch_id, i) GROUP BY batch_id)"""


@register("gram_matrix", f"WITH {BM_SQL}\nSELECT CAST(a.row_id AS BIGINT) AS i, CAST(b.row_id AS BIGINT) AS j, "
          "round(list_reduce(list_transform(a.vec, lambda x, k: x * b.vec[k]), lambda p, q: p + q), 6) AS value "
          "FROM bm a CROSS JOIN bm b")
def q_gram_matrix(spark, sf_dir):
    b = LA.to_blocks(_batch_means(spark, sf_dir), "row_id", "vec", 16)
    return rounded(LA.gram(b, "row_id"))


def _dirty_means(spark, sf_dir) -> DataFrame:
    m = _batch_means(spark, sf_dir)
    return m.select("row_id", F.when(F.col("row_id") % 5 == 1, F.concat(F.array(F.lit(float("nan"))), F.slice("vec", 2, DIM)))
                    .when(F.col("row_id") % 7 == 2, F.array_repeat(F.lit(0.0), DIM)).otherwise(F.col("vec")).alias("vec"))


@register("grad_filter", f"WITH {BM_SQL},\nd AS (SELECT row_id, CASE WHEN row_id % 5 = 1 THEN "
          "list_concat([CAST('nan' AS DOUBLE)], vec[2:]) WHEN row_id % 7 = 2 THEN list_transform(vec, lambda x: 0.0::DOUBLE) "
          "ELSE vec END AS vec FROM bm),\nn AS (SELECT row_id, sqrt(list_reduce(list_transform(vec, lambda x: x * x), "
          "lambda a, b: a + b)) AS norm, list_bool_or(list_transform(vec, lambda x: isnan(x) OR isinf(x))) AS bad FROM d)\n"
          "SELECT CAST(row_id AS BIGINT) AS row_id, round(norm, 6) AS norm FROM n WHERE NOT bad AND norm > "
          "CAST('1e-12' AS DOUBLE)")
def q_grad_filter(spark, sf_dir):
    f = LA.filter_gradients(_dirty_means(spark, sf_dir), "vec", "row_id")
    return rounded(f.select(F.col("row_id").cast("long").alias("row_id"), A.norm(F.col("vec")).alias("norm")))


BASES = [LA.walsh_basis(DIM, [1, 2]), LA.walsh_basis(DIM, [3, 6])]


def _sql_project(vec: str, basis: np.ndarray) -> str:
    cols = []
    for c in range(basis.shape[1]):
        lst = "[" + ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" for v in basis[:, c]) + "]"
        cols.append(lst)
    coefs = [f"list_reduce(list_transform({vec}, lambda x, i: x * ({b})[i]), lambda p, q: p + q)" for b in cols]
    proj = " + ".join(f"({b})[i] * ({c})" for b, c in zip(cols, coefs))
    # Spark builds proj as ((t1 + t2)); same order
    return f"list_transform({vec}, lambda x, i: x - ({proj}))"


def _project_sql() -> str:
    g0 = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    return (f"WITH s1 AS (SELECT vec_id, {_sql_project(g0, BASES[0])} AS g FROM embeddings),\n"
            f"s2 AS (SELECT vec_id, {_sql_project('g', BASES[1])} AS g FROM s1)\n"
            f"SELECT vec_id, {_r6_list('g')} AS projected FROM s2")


@register("project_nullspace", _project_sql())
def q_project_nullspace(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(LA.project_frame(e.select("vec_id", "embedding"), "embedding", BASES, "projected", "sequential"))


@register("project_blocked", f"SELECT vec_id, {_r6_list(_sql_project('list_transform(embedding, lambda x: CAST(x AS DOUBLE))', BASES[0]))} "
          "AS projected FROM embeddings")
def q_project_blocked(spark, sf_dir):
    """LA2 on blocked tables, for parameter axes of any length."""
    rows = [(c, b, BASES[0][16 * b:16 * b + 16, c].tolist()) for c in range(BASES[0].shape[1]) for b in range(DIM // 16)]
    basis = spark.createDataFrame(rows, "component int, block_id int, vec array<double>")
    out = LA.project_blocked(LA.to_blocks(emb(spark, sf_dir), "vec_id", "embedding", 16), basis, "vec_id")
    whole = out.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "sub"))).alias("s"))
    return rounded(whole.select("vec_id", F.flatten(F.transform("s", lambda b: b["sub"])).alias("projected")))


@register("svd_basis", f"WITH {BM_SQL},\ne AS (SELECT CAST(row_id AS BIGINT) AS row_id, list_sum(list_transform(vec, "
          "lambda x: x * x)) AS e FROM bm)\nSELECT row_id, round(e, 6) AS energy, round(e, 6) AS projected_energy FROM e")
def q_svd_basis(spark, sf_dir):
    """The whole basis (threshold 1) and the energy of every row on it: an
    orthonormal basis of the row space keeps each row's energy."""
    m = _batch_means(spark, sf_dir)
    basis, _ = LA.svd_basis(m, "row_id", "vec", threshold=1.0, block=16)
    on = LA.to_blocks(m, "row_id", "vec", 16).join(basis, "block_id").groupBy("row_id", "component").agg(
        F.sum(A.dot(F.col("sub"), F.col("vec"))).alias("c")).groupBy("row_id").agg(F.sum(F.col("c") * F.col("c")).alias("p"))
    own = m.select("row_id", A.dot(F.col("vec"), F.col("vec")).alias("energy"))
    return rounded(own.join(on, "row_id").select(F.col("row_id").cast("long").alias("row_id"), "energy",
                                                 F.col("p").alias("projected_energy")))


@register("spectrum", f"""WITH {BM_SQL},
x AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i, row_id FROM bm),
a AS (SELECT p.i, q.i AS j, sum(p.x * q.x) AS v FROM x p JOIN x q ON p.row_id = q.row_id GROUP BY p.i, q.i),
b AS (SELECT p.i, q.j, sum(p.v * q.v) AS v FROM a p JOIN a q ON p.j = q.i GROUP BY p.i, q.j)
SELECT round((SELECT sum(v) FROM a WHERE i = j), 6) AS energy, round((SELECT sum(v * v) FROM a), 6) AS energy_2,
       round((SELECT sum(a.v * b.v) FROM a JOIN b ON a.i = b.i AND a.j = b.j), 6) AS energy_3,
       round(1.0::DOUBLE, 6) AS last_cumulative""")
def q_spectrum(spark, sf_dir):
    """AG25: power sums of the squared singular values against the traces of
    (G'G), (G'G)^2 and (G'G)^3."""
    _, s = LA.svd_basis(_batch_means(spark, sf_dir), "row_id", "vec", threshold=1.0, block=16)
    table_of = spark.createDataFrame(LA.spectrum(s), "component int, sigma double, sigma_norm double, energy double")
    e = F.pow("sigma", F.lit(2.0))
    return rounded(table_of.agg(F.sum(e).alias("energy"), F.sum(e * e).alias("energy_2"), F.sum(e * e * e).alias("energy_3"),
                                F.max("energy").alias("last_cumulative")))


@register("basis_coverage")
def q_basis_coverage(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 32).cast("long"))
    sizes = []
    for i, t in enumerate(TASKS):
        rows = e.where(F.expr(TASK_Y[t]))
        m = AN.group_mean_vectors(rows, "embedding", "batch_id").select(
            F.col("batch_id").alias("row_id"), F.col("recon").alias("vec"))
        _, s = LA.svd_basis(m, "row_id", "vec", block=16)
        sizes.append((i, t, int(s.size)))
    return LA.basis_coverage(spark.createDataFrame(sizes, "task_ord int, task string, k int"), DIM)


# ---------------------------------------------------------- model forward

@register("embed")
def q_embed(spark, sf_dir):
    """MO1-MO5 forward: the reference-sized encoder (64 -> 512 -> 512 ->
    256), the four named classifier heads (58,434 weights each at 256 -> 2)
    and the autoencoder, in one Arrow pass with broadcast parameters."""
    e = emb(spark, sf_dir)
    enc = MO.flow_encoder(DIM, 512, 256, seed=1)
    nets = {f"logits_{h}": MO.classifier_head(256, 2, seed=10 + i) for i, h in enumerate(MO.HEADS)}
    nets["recon"] = MO.autoencoder(256, 64, seed=20)
    out = MO.apply_nets(e, "embedding", nets, ["vec_id"], encoder=enc)
    return out.select("vec_id", *[A.softmax(F.col(f"logits_{h}")).alias(f"p_{h}") for h in MO.HEADS],
                      A.mse(F.col("embedding"), F.col("recon")).alias("recon_err"))

