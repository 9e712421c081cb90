"""Training and end-to-end scoring queries (TR1-TR5, LA3, AL5).  Results
depend on iterative optimisation, so they carry no SQL oracle; pytest checks
gradients and loss decrease."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import augment as AU
from flowlab.operators import features as FT
from flowlab.operators import linalg as LA
from flowlab.operators import train as TR
from flowlab.operators.metrics import class_weights
from flowlab.plans.bindings import flows
from flowlab.plans.catalog import register, rounded
from flowlab.session import cut, ensure_checkpoint_dir
from flowlab.sources.tables import table
from flowlab.plans.q_embed import BENIGN_MAX_LABEL, TASK_Y, TASKS, _labeled, _sql_noise, _sql_strong, emb


def _task_frame(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir).withColumn("y", F.col("label").isin(1, 2).cast("int"))
    e = e.withColumn("labeled", _labeled(F.col("vec_id")))
    cw = class_weights(e.where("labeled"), "y", cap=10.0).select(F.col("class").alias("y"), "weight")
    return e.join(F.broadcast(cw), "y", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


@register("train_head")
def q_train_head(spark, sf_dir):
    """TR2: FixMatch head on the dos task; returns the epoch history."""
    e = _task_frame(spark, sf_dir)
    lab = e.where("labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "w").alias("x"), "y", "weight")
    unl = e.where("NOT labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "uw").alias("xw"),
                                        AU.strong(F.col("embedding"), F.col("vec_id"), "us").alias("xs"))
    _, hist = TR.train_head(lab, "x", "y", [64, 32, 2], epochs=5, warmup=1, weight="weight", unlabeled=unl,
                            weak="xw", strong="xs")
    return TR.history_frame(spark, "dos", hist)


@register("train_head_local")
def q_train_head_local(spark, sf_dir):
    """TR2 by local mini-batch SGD rounds (parameter averaging)."""
    e = _task_frame(spark, sf_dir)
    lab = e.where("labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "w").alias("x"), "y", "weight")
    unl = e.where("NOT labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "uw").alias("xw"),
                                        AU.strong(F.col("embedding"), F.col("vec_id"), "us").alias("xs"))
    _, hist = TR.train_head_local(lab, "x", "y", [64, 32, 2], unl, "xw", "xs", weight="weight", epochs=5, warmup=1)
    return TR.history_frame(spark, "dos", hist)


@register("train_reference_head")
def q_train_reference_head(spark, sf_dir):
    """TR2 on the reference classifier-head layout (Dense128-BN-Dropout,
    residual Dense128 block, Dense64-BN-Dropout, logits) by local SGD."""
    from flowlab.operators import models as MO
    e = _task_frame(spark, sf_dir)
    lab = e.where("labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "w").alias("x"), "y", "weight")
    unl = e.where("NOT labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "uw").alias("xw"),
                                        AU.strong(F.col("embedding"), F.col("vec_id"), "us").alias("xs"))
    _, hist = TR.train_head_net_local(lab, "x", "y", MO.classifier_head(64, 2, seed=5), unl, "xw", "xs",
                                      weight="weight", epochs=5, warmup=1)
    return TR.history_frame(spark, "dos", hist)


@register("train_mixmatch")
def q_train_mixmatch(spark, sf_dir):
    """TR3: MixMatch head on the dos task; returns the epoch history."""
    e = _task_frame(spark, sf_dir)
    lab = e.where("labeled").select(F.col("embedding").alias("x"), "y")
    unl = e.where("NOT labeled").select(AU.weak(F.col("embedding"), F.col("vec_id"), "uw").alias("xw"),
                                        AU.strong(F.col("embedding"), F.col("vec_id"), "us").alias("xs"))
    _, hist = TR.train_mixmatch(lab, "x", "y", [64, 32, 2], unl, "xw", "xs", epochs=5)
    return TR.history_frame(spark, "dos", hist)


@register("train_autoencoder")
def q_train_autoencoder(spark, sf_dir):
    """TR4 + AG18: autoencoder on benign rows, then the p95 error cut."""
    e = emb(spark, sf_dir)
    benign = e.where(F.col("label") <= BENIGN_MAX_LABEL)
    from flowlab.operators import models as MO
    net, hist = TR.train_autoencoder_net_local(benign, "embedding", MO.autoencoder(64, 16, seed=3), epochs=10)
    rec = MO.apply_nets(benign, "embedding", {"recon": net}, ["vec_id", "embedding"])
    err = rec.select(A.mse(F.col("embedding"), F.col("recon")).alias("err"))
    thr = AN.exact_percentile(err, "err", 0.95).first()[0]
    return spark.createDataFrame([(i, float(v), float(thr)) for i, v in enumerate(hist)],
                                 "epoch int, loss double, threshold double")


@register("train_contrastive")
def q_train_contrastive(spark, sf_dir):
    """TR1: NT-Xent pretraining on two strong views per row, batches of 32."""
    e = emb(spark, sf_dir)
    pairs = e.select(F.floor(F.col("vec_id") / 32).cast("long").alias("batch_id"),
                     (F.col("vec_id") % 32).cast("int").alias("pos"),
                     AU.strong(F.col("embedding"), F.col("vec_id"), "s1").alias("v1"),
                     AU.strong(F.col("embedding"), F.col("vec_id"), "s2").alias("v2"))
    from flowlab.operators import models as MO
    _, _, hist = TR.train_contrastive_net_local(pairs, MO.flow_encoder(64, 128, 32, seed=1),
                                                MO.projection_head(32, 16, seed=2), epochs=3, lr=1e-3)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "epoch int, loss double")


def _captured(spark, sf_dir):
    e = _task_frame(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 32).cast("long"))
    layers = TR.init([64, 16, 2], seed=3)
    g = TR.capture_gradients(e, "embedding", "y", layers, "batch_id", weight="weight")
    return LA.filter_gradients(g, "vec", "batch_id")


@register("gradient_capture")
def q_gradient_capture(spark, sf_dir):
    """TR5 + LA0: one gradient per batch, invalid rows dropped."""
    return _captured(spark, sf_dir).select("batch_id", A.norm(F.col("vec")).alias("norm"), F.size("vec").alias("dim"))


@register("recapture_basis")
def q_recapture_basis(spark, sf_dir):
    """LA3: captured gradients -> energy-truncated basis (1,106 parameters)."""
    g = _captured(spark, sf_dir).withColumnRenamed("batch_id", "row_id")
    basis, _ = LA.svd_basis(g, "row_id", "vec", block=512)
    return basis


def flow_models(dim: int, embed: int = 16):
    """Small fixed networks for the end-to-end scoring query."""
    from flowlab.operators import models as MO
    enc = MO.from_dense(TR.init([dim, 32, embed], seed=1))
    heads = {h: MO.from_dense(TR.init([embed, 8, 2], seed=10 + i))
             for i, h in enumerate(["dos", "port_scan", "intrusion"])}
    ae = MO.from_dense(TR.init([embed, 8, embed], seed=20))
    return enc, heads, ae


@register("score_flows")
def q_score_flows(spark, sf_dir):
    """AL5 end to end on lineitem flows: fit feature state, encode, every
    head, reconstruction anomaly (p95 cut fitted on the same flows),
    routing -> one alert per flow."""
    from flowlab.streaming.alerts import model_scores, route_scores
    f = flows(spark, sf_dir).select("flow_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_linestatus", "Label")
    st = FT.fit(FT.clean(f.drop("flow_id")), "Label")
    enc, heads, ae = flow_models(st.dim)
    # one forward pass feeds both the p95 cut and the routing: write it to the
    # session's checkpoint folder (reliable, no executor memory held)
    ensure_checkpoint_dir(spark)
    z = model_scores(f, st, enc, heads, ae, "flow_id").checkpoint(eager=True)
    thr = AN.exact_percentile(z, "err", 0.95).first()[0]
    params = AL.resolve_params(spark, list(heads), AL.head_params(spark, [("dos", 0.6, 1.5)]))
    return route_scores(z, list(heads), params, float(thr), "flow_id", with_timestamp=False)


@register("flow_train_evaluate")
def q_flow_train_evaluate(spark, sf_dir):
    """PL1 on lineitem flows: split -> features -> contrastive encoder ->
    intrusion / dos / port-scan heads with gradient projection -> metrics.
    State tables go under the session's checkpoint folder."""
    import uuid

    from flowlab.plans import pipelines as PL
    from flowlab.session import ensure_checkpoint_dir
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flow_train_evaluate/{uuid.uuid4().hex}"
    train, test = PL.flow_tables(spark, sf_dir)
    return PL.run_pipeline(train, test, out, ssl_epochs=2, task_epochs=3)


STEP = 0.5
DIMS = 64


def _recapture_sql() -> str:
    """Energy of the batch gradients of each task's stored head: all weights
    zero, but for task 1, whose head has taken one gradient step since."""
    parts = []
    for i, (task, y) in enumerate(TASK_Y.items()):
        parts.append(f"""SELECT {i} AS task_ord, '{task}' AS task, COUNT(*) AS n_gradients, sum(e) AS energy FROM (
  SELECT b, list_sum(list_transform(list_concat(list(gv ORDER BY j), [max(gb)]), lambda g: g * g)) AS e FROM (
    SELECT b, j, sum(d * v[j + 1]) / sum(wt) AS gv, sum(d) / sum(wt) AS gb FROM (
      SELECT b, v, wt, wt * (1 / (1 + exp(-z)) - y) AS d FROM (
        SELECT b, v, y, wt, CASE WHEN {i} = 1 THEN list_dot_product(v, ws) + bias ELSE 0.0::DOUBLE END AS z
        FROM r{i}, l{i})), range({DIMS}) s(j) GROUP BY b, j) GROUP BY b) WHERE sqrt(e) > 1e-12""")
    ctes = []
    for i, y in enumerate(TASK_Y.values()):
        ctes.append(f"""e{i} AS (SELECT vec_id // 32 AS b, embedding::DOUBLE[] AS v, CASE WHEN {y} THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM embeddings),
c{i} AS (SELECT COUNT(*)::DOUBLE AS n, sum(y) AS ones FROM e{i}),
r{i} AS (SELECT b, v, y, CASE WHEN y = 1 THEN n / (2 * ones) ELSE n / (2 * (n - ones)) END AS wt FROM e{i}, c{i}),
l{i} AS (SELECT list(w ORDER BY j) AS ws, (SELECT -{STEP}::DOUBLE * sum(wt * (0.5::DOUBLE - y)) / sum(wt) FROM r{i}) AS bias FROM (
  SELECT j, -{STEP}::DOUBLE * sum(wt * (0.5::DOUBLE - y) * v[j + 1]) / sum(wt) AS w FROM r{i}, range({DIMS}) s(j) GROUP BY j))""")
    return ("WITH " + ",\n".join(ctes) + ",\nfound AS (" + "\nUNION ALL ".join(parts) + f""")
SELECT task_ord, task, CASE WHEN task_ord = 1 THEN 4 ELSE 2 END::BIGINT AS since, n_gradients::BIGINT AS n_gradients,
       {DIMS + 1}::INT AS dim, round(energy, 6) AS energy, true AS orthonormal, true AS holds FROM found""")


@register("recapture_bank", _recapture_sql())
def q_recapture_bank(spark, sf_dir):
    """LA3: heads of three tasks are stored, their bases captured and
    appended; task 1's head is trained on and stored again, its gradients are
    captured from the stored weights over all batches and replace its basis.
    Read back: since which version every basis stands, the gradients' number
    and energy, and whether it is orthonormal and holds ENERGY of them."""
    import uuid

    from flowlab.operators import models as MO
    from flowlab.operators import rounds as RO
    from flowlab.plans import pipelines as PL
    from flowlab.sources import bank as BK
    from flowlab.sources import state as STATE
    bank = f"{ensure_checkpoint_dir(spark)}/bank-{uuid.uuid4()}"
    e = emb(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / 32).cast("long"))
    rows = [e.withColumn("y", F.expr(y).cast("int")) for y in TASK_Y.values()]
    rows = [r.withColumn("wt", RO.class_weight(r, "y")) for r in rows]

    def head(i, steps):
        w, b, _ = RO.head_steps(rows[i], "embedding", "y", DIMS, steps, STEP)
        return ("head", i, TASKS[i], MO.params_table(spark, f"head_{TASKS[i]}", RO.linear_head(w, b)))

    BK.put_all(spark, bank, [head(i, 0) for i in range(len(TASKS))])
    captured, first = {}, []
    for i in range(len(TASKS)):
        net = MO.layers_from_table(BK.get(spark, bank, "head", i), f"head_{TASKS[i]}")
        captured[i], basis = PL.capture_basis(rows[i], "embedding", "y", "batch_id", net, "wt")
        first.append(("basis", i, TASKS[i], basis.select(F.lit(i).alias("task_ord"), F.lit(TASKS[i]).alias("task"), "component",
                                                         "block_id", "vec")))
    BK.put_all(spark, bank, first)
    BK.put_all(spark, bank, [head(1, 1)])
    _, captured[1] = PL.recapture(spark, bank, rows[1], "embedding", "y", "batch_id", 1, replace_index=1, weight="wt")
    out = []
    for entry in BK.entries(spark, bank):
        if entry["kind"] == "basis":
            i = entry["ord"]
            q, = STATE.basis_matrices(BK.get(spark, bank, "basis", i))
            kept = captured[i].select(A.dot(F.col("vec"), F.col("vec")).alias("e"), F.transform(
                F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in q.T]), lambda c: A.dot(F.col("vec"), c)).alias("c"))
            n, energy, held = kept.agg(F.count(F.lit(1)), F.sum("e"), F.sum(A.dot(F.col("c"), F.col("c")))).first()
            out.append((i, entry["name"], entry["since"], n, q.shape[0], energy,
                        bool(np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-8)), held >= LA.ENERGY * energy * (1 - 1e-9)))
    return rounded(spark.createDataFrame(out, "task_ord int, task string, since long, n_gradients long, dim int, energy double, "
                                              "orthonormal boolean, holds boolean"))


@register("head_gradient_steps", f"""
WITH e AS (SELECT embedding::DOUBLE[] AS v, CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM embeddings),
c AS (SELECT COUNT(*)::DOUBLE AS n, sum(y) AS ones FROM e),
r AS (SELECT v, y, CASE WHEN y = 1 THEN n / (2 * ones) ELSE n / (2 * (n - ones)) END AS wt FROM e, c),
g1 AS (SELECT j, -{STEP}::DOUBLE * sum(wt * (0.5::DOUBLE - y) * v[j + 1]) / sum(wt) AS w FROM r, range({DIMS}) d(j) GROUP BY j),
b1 AS (SELECT -{STEP}::DOUBLE * sum(wt * (0.5::DOUBLE - y)) / sum(wt) AS b FROM r),
l1 AS (SELECT list(w ORDER BY j) AS ws FROM g1),
z AS (SELECT v, y, wt, wt * (1 / (1 + exp(-(list_dot_product(v, ws) + b))) - y) AS d FROM r, l1, b1),
g2 AS (SELECT j, sum(d * v[j + 1]) / sum(wt) AS g FROM z, range({DIMS}) d(j) GROUP BY j)
SELECT j::INT AS element, round(w - {STEP}::DOUBLE * g, 6) AS weight FROM g1 JOIN g2 USING (j)""")
def q_head_gradient_steps(spark, sf_dir):
    """Two class-weighted gradient steps of the linear head over all rows."""
    from flowlab.operators import rounds as RO
    e = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") >= 5).cast("int").alias("y"))
    weights, _, _ = RO.head_steps(e, "embedding", "y", DIMS, steps=2, lr=STEP)
    return rounded(spark.createDataFrame(list(enumerate(weights)), "element int, weight double"))


@register("train_head_rounds")
def q_train_head_rounds(spark, sf_dir):
    """Pseudo-label rounds with a ``pyspark.ml`` head: every tenth row is
    labelled; the scores of all rows."""
    from flowlab.operators import rounds as RO
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))
    model, _ = RO.train_head_rounds(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "embedding", "y", "vec_id")
    return rounded(RO.apply_head(e, model, "embedding").select("vec_id", "y", "p_attack"))


# ----------------------------------------------- trainers as aggregates

def _gauss_jordan(matrix: str, n: int, out: str) -> str:
    """CTEs from ``matrix`` (i, j, v; n x n) to its inverse ``out`` (i, j, v)."""
    return f"""{out}_a AS (
  SELECT 1 AS k, i, j, v FROM {matrix}
  UNION ALL SELECT 1, a.i, b.j + {n}, CASE WHEN a.i = b.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM (SELECT DISTINCT i FROM {matrix}) a, (SELECT DISTINCT j FROM {matrix}) b),
{out}_s AS (
  SELECT k, i, j, v FROM {out}_a
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k THEN prow / piv ELSE v - pcol * (prow / piv) END FROM (
    SELECT *, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS prow,
           max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS pcol,
           max(CASE WHEN i = k AND j = k THEN v END) OVER () AS piv
    FROM {out}_s WHERE k <= {n})),
{out} AS (SELECT i, j - {n} AS j, v FROM {out}_s WHERE k = {n} + 1 AND j > {n})"""


@register("contrastive_encoder", f"""WITH RECURSIVE w AS (SELECT vec_id, {_sql_strong('embedding', 's1')} AS a, {_sql_strong('embedding', 's2')} AS b FROM embeddings),
x AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS i FROM w),
c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x, (x - y) / sqrt(2.0::DOUBLE) - avg((x - y) / sqrt(2.0::DOUBLE)) OVER (PARTITION BY i) AS d FROM x),
m AS (SELECT p.i, q.i AS j, sum(p.x * q.x) AS v, sum(p.d * q.d) AS d FROM c p JOIN c q ON p.vec_id = q.vec_id GROUP BY p.i, q.i),
{_gauss_jordan('m', DIMS, 'inv')}
SELECT {DIMS}::INT AS directions, round(sum(inv.v * m.d), 6) AS total_loss, true AS ascending, true AS unit_covariance
FROM inv JOIN m ON inv.j = m.i AND inv.i = m.j""")
def q_contrastive_encoder(spark, sf_dir):
    """TR1: the closed-form encoder over two strong views of every row, all
    directions: their losses add up to the trace of C^-1 D."""
    from flowlab.operators import linear as LN
    from flowlab.operators import models as MO
    views = cut(emb(spark, sf_dir).select(AU.strong(F.col("embedding"), F.col("vec_id"), "s1").alias("v1"),
                                          AU.strong(F.col("embedding"), F.col("vec_id"), "s2").alias("v2")))
    net, loss = LN.contrastive_encoder(views, "v1", "v2", DIMS)
    n, _, c = AN.centred_moments(MO.apply_nets(views, "v1", {}, [], encoder=net), "embedding")
    return rounded(spark.createDataFrame(
        [(len(loss), float(sum(loss)), bool(np.all(np.diff(loss) >= -1e-9)), bool(np.allclose(c / n, np.eye(len(loss)), atol=1e-6)))],
        "directions int, total_loss double, ascending boolean, unit_covariance boolean"))


def _mixmatch_sql() -> str:
    weak, strong = _sql_noise("embedding", 0.02, "uw"), _sql_strong("embedding", "us")
    return f"""WITH e AS (SELECT embedding::DOUBLE[] AS x, {weak} AS w, {strong} AS s, CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS y,
  vec_id % 4 = 0 AS lab FROM embeddings),
n AS (SELECT sum(lab::INT)::DOUBLE AS nl, sum((NOT lab)::INT)::DOUBLE AS nu FROM e),
g1 AS (SELECT j, -{STEP}::DOUBLE * sum((0.5::DOUBLE - y) * x[j + 1]) / max(nl) AS w FROM e, n, range({DIMS}) d(j) WHERE lab GROUP BY j),
b1 AS (SELECT -{STEP}::DOUBLE * sum(0.5::DOUBLE - y) / max(nl) AS b FROM e, n WHERE lab),
l1 AS (SELECT list(w ORDER BY j) AS ws FROM g1),
z AS (SELECT x, w, y, lab, 1 / (1 + exp(-(list_dot_product(x, ws) + b))) AS px, 1 / (1 + exp(-(list_dot_product(w, ws) + b))) AS pw,
      1 / (1 + exp(-(list_dot_product(s, ws) + b))) AS ps FROM e, l1, b1),
q AS (SELECT *, pow((pw + ps) / 2, 2.0::DOUBLE) / (pow((pw + ps) / 2, 2.0::DOUBLE) + pow(1 - (pw + ps) / 2, 2.0::DOUBLE)) AS q FROM z),
g2 AS (SELECT j, sum(CASE WHEN lab THEN (px - y) * x[j + 1] ELSE 0 END) / max(nl)
         + sum(CASE WHEN lab THEN 0 ELSE 2 * (pw - q) * pw * (1 - pw) * w[j + 1] END) / max(nu) AS g FROM q, n, range({DIMS}) d(j) GROUP BY j)
SELECT j::INT AS element, round(g1.w - {STEP}::DOUBLE * g, 6) AS weight FROM g1 JOIN g2 USING (j)"""


@register("mixmatch_gradient_steps", _mixmatch_sql())
def q_mixmatch_gradient_steps(spark, sf_dir):
    """TR3: two MixMatch steps of the linear head; a quarter of the rows is labelled."""
    from flowlab.operators import rounds as RO
    e = emb(spark, sf_dir)
    rows = cut(e.select(F.col("embedding").alias("x"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 4 == 0).alias("labelled"),
                        AU.weak(F.col("embedding"), F.col("vec_id"), "uw").alias("weak"),
                        AU.strong(F.col("embedding"), F.col("vec_id"), "us").alias("strong")))
    weights, _, _ = RO.train_mixmatch(rows, DIMS, 2, STEP)
    return rounded(spark.createDataFrame(list(enumerate(weights)), "element int, weight double"))


SQUARINGS = 14          # C to the power 2**14: the leading direction alone is left


def _autoencoder_sql() -> str:
    """The leading principal direction by squaring the covariance again and again."""
    steps = [f"m0 AS (SELECT i, j, v / (SELECT max(abs(v)) FROM cov) AS v FROM cov)"]
    for k in range(SQUARINGS):
        steps.append(f"q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY a.i, b.j)")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM q{k}) AS v FROM q{k})")
    return f"""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mu AS (SELECT i, avg(x) AS m FROM x WHERE label <= {BENIGN_MAX_LABEL} GROUP BY i),
d AS (SELECT vec_id, label, x.i, x - m AS d FROM x JOIN mu USING (i)),
cov AS (SELECT p.i, q.i AS j, sum(p.d * q.d) AS v FROM d p JOIN d q ON p.vec_id = q.vec_id WHERE p.label <= {BENIGN_MAX_LABEL} GROUP BY p.i, q.i),
{", ".join(steps)},
p AS (SELECT i, j, v / (SELECT sum(v) FROM m{SQUARINGS} WHERE i = j) AS v FROM m{SQUARINGS}),
on_it AS (SELECT a.vec_id, sum(a.d * p.v * b.d) AS e FROM d a JOIN p ON a.i = p.i JOIN d b ON b.vec_id = a.vec_id AND b.i = p.j GROUP BY a.vec_id),
err AS (SELECT d.vec_id, any_value(label) AS label, (sum(d * d) - any_value(e)) / {DIMS} AS err FROM d JOIN on_it USING (vec_id) GROUP BY d.vec_id),
cut AS (SELECT quantile_cont(err, 0.95) AS c FROM err WHERE label <= {BENIGN_MAX_LABEL})
SELECT vec_id, round(err, 6) AS err, round(c, 6) AS threshold FROM err, cut"""


@register("linear_autoencoder", _autoencoder_sql())
def q_linear_autoencoder(spark, sf_dir):
    """TR4, AG18: a linear autoencoder of the benign rows (one latent number),
    every row's reconstruction error and the 95 % cut."""
    from flowlab.operators import linear as LN
    from flowlab.operators import models as MO
    e = emb(spark, sf_dir)
    benign = F.col("label") <= BENIGN_MAX_LABEL
    net = LN.linear_autoencoder(e.where(benign), "embedding", 1)
    rec = MO.apply_nets(e, "embedding", {"recon": net}, ["vec_id", "label", "embedding"])
    errors = cut(rec.select("vec_id", "label", A.mse(F.col("embedding"), F.col("recon")).alias("err")))
    at = AN.exact_percentile(errors.where(benign), "err", 0.95).first()[0]
    return rounded(errors.select("vec_id", "err", F.lit(float(at)).alias("threshold")))


@register("batch_gradients", f"""
WITH e AS (SELECT CAST(vec_id // 32 AS BIGINT) AS batch_id, embedding::DOUBLE[] AS v, CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM embeddings),
g1 AS (SELECT j, -{STEP}::DOUBLE * avg((0.5::DOUBLE - y) * v[j + 1]) AS w FROM e, range({DIMS}) d(j) GROUP BY j),
b1 AS (SELECT -{STEP}::DOUBLE * avg(0.5::DOUBLE - y) AS b FROM e),
l1 AS (SELECT list(w ORDER BY j) AS ws FROM g1),
z AS (SELECT batch_id, v, 1 / (1 + exp(-(list_dot_product(v, ws) + b))) - y AS d FROM e, l1, b1),
g AS (SELECT batch_id, j, avg(d * v[j + 1]) AS g, avg(d) AS gb FROM z, range({DIMS}) r(j) GROUP BY batch_id, j)
SELECT batch_id, list_transform(list_concat(list(g ORDER BY j), [max(gb)]), lambda x: round(x, 6)) AS vec FROM g GROUP BY batch_id""")
def q_batch_gradients(spark, sf_dir):
    """TR5, LA0: the gradient of every batch of 32 for a head after one step."""
    from flowlab.operators import rounds as RO
    e = emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).cast("long").alias("batch_id"), "embedding",
                                  (F.col("label") >= 5).cast("int").alias("y"))
    half = e.agg(F.avg(F.lit(0.5) - F.col("y"))).first()[0]
    means = e.select(F.posexplode("embedding").alias("j", "x"), "y").groupBy("j").agg(
        F.avg((F.lit(0.5) - F.col("y")) * F.col("x")).alias("g")).collect()           # one number a dimension
    weights = [-STEP * r["g"] for r in sorted(means, key=lambda r: r["j"])]
    found = RO.capture_gradients(e, "embedding", "y", "batch_id", weights, -STEP * half)
    return rounded(LA.filter_gradients(found, "vec", "batch_id").select("batch_id", "vec"))
