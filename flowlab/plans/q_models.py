"""Forward passes and scoring with fixed weights, so that SQL can follow them
number by number (MO1-MO3, MO5, AL5), and full-rank coverage (AG24)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import features as FT
from flowlab.operators import linalg as LA
from flowlab.operators import models as MO
from flowlab.plans import q_embed as QE
from flowlab.plans import q_flows as QF
from flowlab.plans.bindings import flows
from flowlab.plans.catalog import register, rounded
from flowlab.plans.q_eval import dlit
from flowlab.session import cut


def short(net: list[dict], seed: int) -> list[dict]:
    """The layers with weights of four decimals and batch-norm statistics that do something."""
    rng = np.random.default_rng(seed)
    for layer in net:
        layer["W"], layer["b"] = layer["W"].round(4), rng.normal(0, 0.1, len(layer["b"])).round(4)
        if "gamma" in layer:
            n = len(layer["gamma"])
            layer |= {"gamma": rng.uniform(0.5, 1.5, n).round(4), "beta": rng.normal(0, 0.1, n).round(4),
                      "mean": rng.normal(0, 0.1, n).round(4), "var": rng.uniform(0.5, 1.5, n).round(4)}
    return net


def _sql_list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def sql_net(name: str, source: str, column: str, keep: list[str], net: list[dict]) -> str:
    """CTEs that end in ``name`` (keep, out): the forward pass of a network."""
    ctes, kept = [], ", ".join(keep)
    at, h, saved = source, column, "NULL"
    for i, layer in enumerate(net):
        rows = "[" + ", ".join(_sql_list(w) for w in layer["W"].T) + "]"
        names = ["b", *(k for k in ("gamma", "beta", "mean", "var") if k in layer)]
        ctes.append(f"{name}_w{i} AS MATERIALIZED (SELECT {rows} AS w, " + ", ".join(f"{_sql_list(layer[k])} AS {k}_" for k in names) + ")")
        out = "list_dot_product(w, h) + b_[i]"
        if layer.get("act") == "relu":
            out = f"greatest({out}, 0.0::DOUBLE)"
        if "gamma" in layer:
            out = f"({out} - mean_[i]) / sqrt(var_[i] + {dlit(MO.BN_EPS)}) * gamma_[i] + beta_[i]"
        if layer.get("add"):
            out = f"{out} + saved[i]"
        ctes.append(f"{name}_h{i} AS MATERIALIZED (SELECT {kept}, saved, list_transform(w, lambda w, i: {out}) AS h "
                    f"FROM (SELECT {kept}, {saved} AS saved, {h} AS h FROM {at}) x, {name}_w{i})")
        at, h, saved = f"{name}_h{i}", "h", "h" if layer.get("save") else "saved"
    return ",\n".join(ctes) + f",\n{name} AS (SELECT {kept}, h AS out FROM {at})"


def _nets():
    return (short(MO.flow_encoder(QE.DIM, 24, 8, seed=1), 1), short(MO.projection_head(8, 4, seed=2), 2),
            short(MO.classifier_head(8, 2, seed=3), 3), short(MO.autoencoder(8, 4, seed=4), 4))


def _embed_sql() -> str:
    enc, proj, head, ae = _nets()
    parts = [sql_net("enc", "embeddings", "embedding::DOUBLE[]", ["vec_id"], enc)]
    parts += [sql_net(n, "enc", "out", ["vec_id"], net) for n, net in (("proj", proj), ("head", head), ("ae", ae))]
    return "WITH " + ",\n".join(parts) + """
SELECT enc.vec_id, list_transform(proj.out, lambda x: round(x, 6)) AS projection,
       round(1 / (1 + exp(head.out[1] - head.out[2])), 6) AS p_attack,
       round(list_sum(list_transform(ae.out, lambda x, i: (x - enc.out[i]) * (x - enc.out[i]))) / 8, 6) AS recon_err
FROM enc JOIN proj USING (vec_id) JOIN head USING (vec_id) JOIN ae USING (vec_id)"""


@register("embed_small", _embed_sql())
def q_embed_small(spark, sf_dir):
    """MO1, MO2, MO3, MO5: encoder, projection head, residual classifier head
    and autoencoder in their layouts, in one pass."""
    enc, proj, head, ae = _nets()
    z = MO.apply_nets(QE.emb(spark, sf_dir), "embedding", {"proj": proj, "head": head, "ae": ae}, ["vec_id"], encoder=enc)
    return rounded(z.select("vec_id", F.col("proj").alias("projection"), A.softmax(F.col("head"))[1].alias("p_attack"),
                            A.mse(F.col("embedding"), F.col("ae")).alias("recon_err")))


HEADS = ["dos", "port_scan", "intrusion"]
FLOW_DIM = 9            # four numbers, three return flags, two line states


def _linear(a: int, b: int, name: str) -> dict:
    w = np.array([[MO.md5_normal(11, name, i, j) for j in range(b)] for i in range(a)]).round(4)
    return {"W": w, "b": np.zeros(b), "act": None}


def _flow_nets():
    return ([_linear(FLOW_DIM, 4, "enc")], {h: [_linear(4, 2, h)] for h in HEADS}, [_linear(4, 2, "in"), _linear(2, 4, "out")])


def _score_sql() -> str:
    enc, heads, ae = _flow_nets()
    hot = ", ".join(f"list_transform(v_{c}, lambda v: CASE WHEN v = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in QF.CAT)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c}" for c in QF.NUM)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in QF.NUM)
    vocab = ", ".join(f"list(DISTINCT {c} ORDER BY {c}) AS v_{c}" for c in QF.CAT)
    nets = [sql_net("enc", "x", "f", ["rid", "flow_id"], enc)] + [sql_net(h, "enc", "out", ["rid", "flow_id"], heads[h]) for h in HEADS]
    nets.append(sql_net("ae", "enc", "out", ["rid", "flow_id"], ae))
    probs = {"dos": "1 / (1 + exp((dos.out[1] - dos.out[2]) / 1.5::DOUBLE))"}
    p = ", ".join(f"{probs.get(h, f'1 / (1 + exp({h}.out[1] - {h}.out[2]))')} AS p_{h}" for h in HEADS)
    cuts = {"dos": 0.6, "port_scan": 0.5, "intrusion": 0.5}
    cand = " UNION ALL ".join(f"SELECT rid, {i} AS ord, '{h}' AS head, p_{h} AS p, p_{h} - {dlit(cuts[h])} AS margin FROM s WHERE p_{h} >= {dlit(cuts[h])}"
                              for i, h in enumerate(HEADS))
    return f"""WITH st AS (SELECT {stats}, {vocab} FROM lineitem),
x AS (SELECT {QF.FLOW_ID_SQL} AS flow_id, row_number() OVER () AS rid, list_concat(list_concat([{scaled}], {hot.split(', list_transform(')[0]}), list_transform({hot.split(', list_transform(')[1]}) AS f
      FROM lineitem, st),
{(","+chr(10)).join(nets)},
e AS (SELECT enc.rid, enc.flow_id, {p}, list_sum(list_transform(ae.out, lambda v, i: (v - enc.out[i]) * (v - enc.out[i]))) / 4 AS err
      FROM enc {" ".join(f"JOIN {h} USING (rid)" for h in HEADS)} JOIN ae USING (rid)),
thr AS (SELECT quantile_cont(err, 0.95) AS t FROM e),
s AS (SELECT *, least(greatest(err / greatest(t, CAST('1e-08' AS DOUBLE)), 0.0), 1.0) AS score FROM e, thr),
cand AS ({cand}),
best AS (SELECT rid, arg_max(head, (margin, -ord)) AS head, arg_max(p, (margin, -ord)) AS p FROM cand GROUP BY rid)
SELECT s.flow_id, CASE WHEN b.head IS NOT NULL THEN b.head WHEN score >= {dlit(0.65)} THEN 'zero-day / unknown' END AS attack_type,
  round(CASE WHEN b.head IS NOT NULL THEN b.p ELSE greatest(0.0::DOUBLE, {", ".join(f"p_{h}" for h in HEADS)}) END, 6) AS confidence,
  round(score, 6) AS anomaly_score, {QE.SEV_SQL} AS severity
FROM s LEFT JOIN best b USING (rid)"""


@register("score_flows_fixed", _score_sql())
def q_score_flows_fixed(spark, sf_dir):
    """AL5 end to end with fixed linear networks: feature state, encoder, every
    head, reconstruction error with its 95 % cut, temperature, routing."""
    from flowlab.streaming.alerts import model_scores, route_scores
    f = flows(spark, sf_dir).select("flow_id", *QF.NUM, *QF.CAT, "Label")
    st = FT.fit(FT.clean(f.drop("flow_id")), "Label")
    enc, heads, ae = _flow_nets()
    z = cut(model_scores(f, st, enc, heads, ae, "flow_id"))
    at = AN.exact_percentile(z, "err", 0.95).first()[0]
    params = AL.resolve_params(spark, HEADS, AL.head_params(spark, [("dos", 0.6, 1.5)]))
    return rounded(route_scores(z, HEADS, params, float(at), "flow_id", with_timestamp=False))


@register("basis_coverage_full", "WITH k AS (" + " UNION ALL ".join(
    f"SELECT {i} AS task_ord, '{t}' AS task, least(COUNT(DISTINCT vec_id // 32), {QE.DIM}) AS k FROM embeddings WHERE {QE.TASK_Y[t]}"
    for i, t in enumerate(QE.TASKS)) + f""")
SELECT task_ord::INT AS task_ord, task, k::INT AS k, CAST(sum(k) OVER (ORDER BY task_ord) AS BIGINT) AS cum_k,
       round(sum(k) OVER (ORDER BY task_ord) * 100.0::DOUBLE / {QE.DIM}, 6) AS coverage_pct FROM k""")
def q_basis_coverage_full(spark, sf_dir):
    """AG24 for whole bases: a task's components are as many as its gradients
    are independent (threshold 1)."""
    e = QE.emb(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 32).cast("long"))
    sizes = []
    for i, t in enumerate(QE.TASKS):
        m = AN.group_mean_vectors(e.where(F.expr(QE.TASK_Y[t])), "embedding", "batch_id", digits=None)
        _, s = LA.svd_basis(m.select(F.col("batch_id").alias("row_id"), F.col("recon").alias("vec")), "row_id", "vec", 1.0, 16)
        sizes.append((i, t, int(s.size)))
    return rounded(LA.basis_coverage(spark.createDataFrame(sizes, "task_ord int, task string, k int"), QE.DIM))
