"""End-to-end pipelines (PL1-PL5), recapture (LA3) and evaluation of a trained head (MO7).

One Spark application: DataFrames are handed from stage to stage, every stage
writes its tables under ``out_dir`` (a shared folder on a cluster) and is
recorded, and every heavy step is a Spark job.  What a later stage reads is a
table, so a lost executor recomputes from there, and a lost driver starts
again after the last finished stage.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions import arrays as A
from flowlab.functions import labels as L
from flowlab.operators import alerts as AL
from flowlab.operators import anomaly as AN
from flowlab.operators import augment as AU
from flowlab.operators import calibrate as CA
from flowlab.operators import features as FT
from flowlab.operators import linalg as LA
from flowlab.operators import linear as LN
from flowlab.operators import metrics as M
from flowlab.operators import models as MO
from flowlab.operators import rounds as RO
from flowlab.operators import split as SP
from flowlab.operators.content_id import numbered_id, numbered_rows
from flowlab.session import cut, ensure_checkpoint_dir, shuffles_dropped
from flowlab.sources import bank as BK
from flowlab.sources import flows as SRC
from flowlab.sources import state as STATE
from flowlab.sources.bank import Stages, fingerprint

TASKS = ["intrusion", "dos", "port_scan"]


def evaluation_tables(scored: DataFrame, y: str = "y", logits: str = "logits",
                      calib: DataFrame | None = None, n_classes: int | None = None) -> dict[str, DataFrame]:
    """MO7 and the tables behind its plots: ``metrics`` (metric, class, value)
    with default (argmax) metrics, the temperature (fitted on ``calib``, the
    evaluation rows themselves when not given), AUCs and the F1-optimal
    operating point; ``confusion``, ``roc_curve``, ``pr_curve`` and ``sweep``.

    The rows are scored once and collapse to distinct labels and logits with
    their number, in a checkpoint; all curve tables come from one checkpointed
    table of distinct scores.  ``n_classes`` 2, where it is known, groups and
    calibrates by numbers in place of arrays.  A table of one class has no
    AUC, operating point or curves beyond their anchors."""
    spark = scored.sparkSession
    ensure_checkpoint_dir(spark)
    rows = scored.select(F.col(y).cast("int").alias("y"), F.col(logits).alias("logits"))
    if n_classes == 2:
        pairs = rows.select("y", *[F.get("logits", F.lit(i)).cast("double").alias(f"l{i}") for i in (0, 1)])
        s = pairs.groupBy("y", "l0", "l1").agg(F.count(F.lit(1)).alias("n")).checkpoint().withColumn("logits", F.array("l0", "l1"))
    else:
        s = rows.groupBy("y", "logits").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    # the softmax of two numbers spelled out: generated code, no lambdas
    guess = (A.argmax(A.softmax(F.col("logits"))) if n_classes != 2 else
             F.when(F.array_max("logits").isNotNull(), F.when(CA.two_probs("l0", "l1", 1.0)[1] > CA.two_probs("l0", "l1", 1.0)[0], 1).otherwise(0)))
    pred = s.select("y", guess.alias("pred"), "n")
    confusion = M.confusion(pred, "y", "pred", "n").checkpoint()
    if calib is not None:
        t = CA.fit_temperature(calib.select(F.col(y).cast("int").alias("y"), F.col(logits).alias("logits")), "logits", "y",
                               n_classes=n_classes)
    else:
        t = CA.fit_temperature(s, "logits", "y", n_classes=n_classes, n="n")
    p = CA.two_probs("l0", "l1", t)[1] if n_classes == 2 else CA.calibrated_probs(F.col("logits"), t)[1]
    cal = s.select("y", p.alias("p"), "n")
    points = M.points_of(M.score_table(cal, n="n").checkpoint()).checkpoint()
    seen = points.select("n_pos", "n_neg").first()
    extra = [("temperature", None, float(t))]
    if seen and seen["n_pos"] and seen["n_neg"]:
        extra.append(("roc_auc", None, float(M.roc_auc_of(points).first()[0])))
        extra.append(("pr_auc", None, float(M.average_precision_of(points).first()[0])))
        op = M.eval_report_of(points).first()
        for k in ("threshold", "precision", "recall", "f1", "accuracy", "recall_weighted", "f1_weighted"):
            extra.append((f"optimal_{k}", None, float(op[k])))
    ext = spark.createDataFrame(extra, "metric string, class int, value double")
    return {"metrics": M.prf_table(confusion).unionByName(ext), "confusion": confusion,
            "roc_curve": M.roc_curve_of(points, drop_intermediate=True), "pr_curve": M.pr_curve_of(points),
            "sweep": M.threshold_sweep(cal, n="n")}


def evaluate_head(scored: DataFrame, y: str = "y", logits: str = "logits", calib: DataFrame | None = None) -> DataFrame:
    """MO7: the metric rows of :func:`evaluation_tables`."""
    return evaluation_tables(scored, y, logits, calib)["metrics"]


REPORT_TABLES = ["confusion", "roc_curve", "pr_curve", "sweep"]


def label_column(task: str) -> str:
    return "Label" if task == "intrusion" else "AttackCategory"


def _written(df: DataFrame, path: str) -> DataFrame:
    """The rows, computed once: a table that the stages read again and again."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return cut(df)              # no table format stores such a column
    return _store(df, path)


def _store(df: DataFrame, path: str) -> DataFrame:
    """A table between stages, in place of the one there was."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


COPY, BATCH = "_fl_copy", "_fl_batch"       # columns of stored rows: the number among equal ones, the batch
STEPS = 4               # gradient steps of a head in an epoch


def run_pipeline(train: DataFrame, test: DataFrame, out_dir: str, tasks: list[str] = TASKS,
                 ssl_epochs: int = 3, task_epochs: int = 5, embed_dim: int = 16, use_gpm: bool = True,
                 batch_size: int = 64, ae_epochs: int = 5, seed: int = 42, stored: bool = False) -> DataFrame:
    """PL1/PL2 core: features -> contrastive encoder -> autoencoder on
    benign embeddings (p95 cut) -> per task FixMatch head (projected against
    earlier tasks' bases) -> gradient capture -> basis -> evaluation.
    Writes the state a scoring job needs (feature state, model parameters,
    head thresholds / temperatures, anomaly cut) and returns the metrics.

    A chain of stages (``bank.Stages``): each writes its tables once and is
    recorded; a rerun over the same inputs with the same parameters goes on
    after the last recorded one.  The encoder and the autoencoder are linear
    and solved in closed form, so ``ssl_epochs`` counts the view pairs a row
    contributes and ``ae_epochs`` is ignored.

    The inputs, whatever it takes to compute their rows, are computed once and
    written (``stored``: they are tables already).  Rows are stored as they came,
    with their number among equal ones and, for training, their batch and their
    labels: ids, features and embeddings are functions of a row that take more
    room than it does, so they are computed where they are read.  Of the views,
    one epoch at a time is stored, as the seeds they are drawn from; a head's
    step is one scan that draws them."""
    spark = train.sparkSession
    if not stored:
        train, test = _written(train, f"{out_dir}/input/train"), _written(test, f"{out_dir}/input/test")
    stages = Stages(spark, out_dir, train=fingerprint(train), test=fingerprint(test))
    keep = ["_rid", "Label", "AttackCategory"]
    labels = [f"_fl_y_{t}" for t in tasks]

    def features(folder: str) -> None:
        st = FT.fit(FT.clean(train.drop("AttackLabel", "AttackCategory")), "Label")
        st.save(spark, f"{folder}/state")
        for name, df in (("train", train), ("test", test)):
            void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]     # no table format stores such a column
            with shuffles_dropped(spark):
                _store(numbered_rows(df, COPY).drop(*void), f"{folder}/{name}")

    at = stages.run("features", features)
    st = FT.FeatureState.load(spark, f"{at}/state")

    def featured(rows: DataFrame, like: DataFrame, as_is: list[str] | None = None) -> DataFrame:
        """Id, cleaned labels and feature vector of stored rows of ``like``."""
        return FT.transform(rows.withColumn("_rid", numbered_id(like, COPY, "")), st, None, keep, as_is)

    def marked(rows: DataFrame) -> DataFrame:
        """Stored rows with every task's label."""
        return rows.select("*", *[L.task_label(FT.clean_text(rows, label_column(t)), t).alias(y) for t, y in zip(tasks, labels)])

    tr_rows, te_rows = (spark.read.parquet(f"{at}/{name}") for name in ("train", "test"))
    tr, te = featured(tr_rows, train), featured(marked(te_rows), test, labels)

    def encoder(folder: str) -> None:
        pairs = tr.select("features", "_rid", F.explode(F.sequence(F.lit(0), F.lit(max(ssl_epochs, 1) - 1))).alias("e"))
        rid = F.concat_ws(":", "_rid", "e")
        rows, draw = AU.to_draw(pairs, "features", {"v1": ("strong", rid, "s1"), "v2": ("strong", rid, "s2")}, seed)
        enc, _ = LN.contrastive_encoder(rows, "v1", "v2", embed_dim, draw=draw)       # read once
        MO.params_table(spark, "encoder", enc).write.mode("overwrite").parquet(folder)

    enc_at = stages.run("encoder", encoder, ssl_epochs=ssl_epochs, embed_dim=embed_dim, seed=seed)
    enc = MO.layers_from_table(spark.read.parquet(enc_at), "encoder")
    dim = enc[-1]["W"].shape[1]

    def embedded(df: DataFrame, keep: list[str]) -> DataFrame:
        return MO.apply_nets(df, "features", {}, keep, encoder=enc).withColumnRenamed("embedding", "z")

    benign = embedded(tr.where(F.col("Label") == "normal"), []).select("z")
    unknown = marked(tr_rows).agg(*[F.count(F.when(F.col(y).isNull(), 1)).alias(y) for y in labels]).first().asDict() if tasks else {}

    def numbered(rows: DataFrame) -> DataFrame:
        """The rows with the number of their batch."""
        return SP.batch_numbers(rows, numbered_id(train, COPY, ""), batch_size, BATCH, seed=seed)

    def embeddings(folder: str) -> None:
        rows = marked(tr_rows)
        if use_gpm and not all(unknown.values()):       # all rows have this label, so all such labels share the batches
            rows = numbered(rows)
        with shuffles_dropped(spark):
            _store(rows, folder)

    z_at = stages.run("embeddings", embeddings, tasks=tasks, seed=seed, batch=batch_size, gpm=use_gpm)
    z_rows = spark.read.parquet(z_at)

    def anomaly(folder: str) -> None:
        ae = LN.linear_autoencoder(benign, "z", min(max(embed_dim // 4, 2), dim))
        MO.params_table(spark, "autoencoder", ae).write.mode("overwrite").parquet(f"{folder}/params")
        errors = _store(AN.net_errors(benign, "z", ae), f"{folder}/errors")
        at95 = AN.exact_percentile(errors, "err", 0.95, stored=True).first()
        STATE.save_anomaly_params(spark, f"{folder}/cut", "autoencoder", float(at95[0] if at95 else 0.0))

    ae_at = stages.run("anomaly", anomaly)
    drawn: dict[str, int] = {}      # the epoch whose seeds are stored

    def draw(epoch: int, folder: str) -> None:
        _store(RO.packed_views(featured(z_rows, train, labels), "features", "_rid", labels, epoch, seed), f"{folder}/seeds")
        drawn["epoch"] = epoch

    def views(folder: str) -> None:
        if task_epochs:
            draw(0, folder)

    view_at = stages.run("views", views, epochs=task_epochs, seed=seed)

    def epoch_views(epoch: int) -> DataFrame:
        if drawn.get("epoch") != epoch:
            draw(epoch, view_at)
        return spark.read.parquet(f"{view_at}/seeds")

    def batched(y: str) -> DataFrame:
        """Embeddings of the rows that have a label, in batches."""
        rows = numbered(z_rows.where(F.col(y).isNotNull()).drop(BATCH)) if unknown[y] else z_rows
        return embedded(featured(rows.where(F.col(BATCH).isNotNull()), train, [BATCH, y]), [BATCH, y])

    bases: list[DataFrame] = []
    head_at = {}
    for i, (task, y) in enumerate(zip(tasks, labels)):
        L.check_task_classes(tr, label_column(task), task)
        spans = STATE.basis_matrices(bases[0] if len(bases) == 1 else SP.append_frames(bases)) if bases else []

        def head(folder: str) -> None:
            cw = M.class_weights(z_rows, y, cap=10.0).select(F.col("class").alias("y"), "weight")
            classes = {r["y"]: r["weight"] for r in cw.collect() if r["y"] is not None}      # one row a class
            w, bias, hist = RO.train_fixmatch(lambda e: epoch_views(e).withColumnRenamed(y, "y"), dim, STEPS, bases=spans,
                                              class_weights=classes, epochs=task_epochs, encoder=enc)
            MO.params_table(spark, f"head_{task}", RO.linear_head(w, bias)).write.mode("overwrite").parquet(f"{folder}/params")
            STATE.history_table(spark, task, hist).write.mode("overwrite").parquet(f"{folder}/history")
            if use_gpm:
                rows = batched(y).withColumnRenamed(y, "y").join(F.broadcast(cw), "y")
                _, basis = capture_basis(rows, "z", "y", BATCH, RO.linear_head(w, bias), "weight")
                basis.select(F.lit(i).alias("task_ord"), F.lit(task).alias("task"), "component", "block_id", "vec").write.mode(
                    "overwrite").parquet(f"{folder}/basis")

        head_at[task] = stages.run(f"head_{task}", head, order=i, epochs=task_epochs, gpm=use_gpm, batch=batch_size)
        if use_gpm:
            bases.append(spark.read.parquet(f"{head_at[task]}/basis"))

        def report(folder: str) -> None:
            net = MO.layers_from_table(spark.read.parquet(f"{head_at[task]}/params"), f"head_{task}")
            L.check_task_classes(te, label_column(task), task)
            ev = MO.apply_nets(te.select(F.col(y).alias("y"), "features"), "features", {"logits": net}, ["y"], encoder=enc)
            for name, df in evaluation_tables(ev, n_classes=2).items():
                df.write.mode("overwrite").parquet(f"{folder}/{name}")

        head_at[f"report_{task}"] = stages.run(f"report_{task}", report)

    def publish(folder: str) -> None:
        st.save(spark, f"{out_dir}/feature_state")
        params, metrics, head_rows = [spark.read.parquet(enc_at), spark.read.parquet(f"{ae_at}/params")], [], []
        stored: list[tuple[str, int, str, DataFrame]] = []
        for i, task in enumerate(tasks):
            params.append(spark.read.parquet(f"{head_at[task]}/params"))
            spark.read.parquet(f"{head_at[task]}/history").write.mode("overwrite").parquet(f"{out_dir}/history/task={task}")
            found = {name: spark.read.parquet(f"{head_at[f'report_{task}']}/{name}") for name in ["metrics", *REPORT_TABLES]}
            for name in REPORT_TABLES:
                STATE.write_report(found[name], f"{out_dir}/{name}/task={task}")
            metrics.append(found["metrics"].withColumn("task", F.lit(task)))
            got = {r["metric"]: r["value"] for r in found["metrics"].where("class IS NULL").select("metric", "value").collect()}
            head_rows.append((task, got.get("optimal_threshold"), got.get("temperature")))
            if use_gpm:
                STATE.save_basis(spark, f"{out_dir}/bases", i, task, bases[i])
                stored.append(("basis", i, task, bases[i]))
            stored.append(("head", i, task, params[-1]))
        BK.put_all(spark, f"{out_dir}/bank", stored)
        STATE.write_report(SP.append_frames(metrics), f"{out_dir}/metrics", ["task"])
        # a trained head and its encoder are not touched again: its F1 holds at every later stage
        held = spark.createDataFrame([(t, i, s) for i, t in enumerate(tasks) for s in range(i, len(tasks))],
                                     "task string, task_ord int, stage int")
        f1 = SP.append_frames(metrics).where("metric = 'f1_weighted'").select("task", F.col("value").alias("f1"))
        STATE.write_report(M.forgetting_matrix(held.join(F.broadcast(f1), "task")), f"{out_dir}/forgetting")
        STATE.save_params(SP.append_frames(params), f"{out_dir}/model_params")
        spark.read.parquet(f"{ae_at}/cut").write.mode("overwrite").parquet(f"{out_dir}/anomaly_params")
        AL.head_params(spark, head_rows).write.mode("overwrite").parquet(f"{out_dir}/head_params")

    stages.run("publish", publish, tasks=tasks)
    return spark.read.json(f"{out_dir}/metrics")


# ------------------------------------------------------------- recapture

def capture_basis(rows: DataFrame, x: str, y: str, batch: str, net: list[dict],
                  weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """TR5, LA0, LA1: (valid gradients, basis) of a linear head over all batches."""
    w, bias = RO.head_weights(net)
    found = cut(LA.filter_gradients(RO.capture_gradients(rows, x, y, batch, w, bias, weight), "vec", "batch_id"))
    return found, LA.svd_basis(found, "batch_id", "vec")[0]


def recapture(spark: SparkSession, bank: str, rows: DataFrame, x: str, y: str, batch: str, task_ord: int,
              replace_index: int | None = None, weight: str | None = None) -> tuple[int, DataFrame]:
    """LA3: the saved head ``task_ord`` of the bank, its gradients over all
    batches of ``rows``, and their basis as a new entry of the bank: after the
    last one, or in place of ``replace_index`` (IndexError where there is
    none).  Returns the published version and the gradients."""
    stored = {r["ord"]: r["name"] for r in BK.entries(spark, bank) if r["kind"] == "basis"}
    names = {r["ord"]: r["name"] for r in BK.entries(spark, bank) if r["kind"] == "head"}
    if task_ord not in names:
        raise KeyError(f"the bank has no head {task_ord}")
    if replace_index is not None and replace_index not in stored:
        raise IndexError(f"replace_index must be one of {sorted(stored)}, not {replace_index}")
    net = MO.layers_from_table(BK.get(spark, bank, "head", task_ord), f"head_{names[task_ord]}")
    found, basis = capture_basis(rows, x, y, batch, net, weight)
    at = replace_index if replace_index is not None else max(stored, default=-1) + 1
    out = basis.select(F.lit(at).alias("task_ord"), F.lit(names[task_ord]).alias("task"), "component", "block_id", "vec")
    return BK.put(spark, bank, "basis", at, names[task_ord], out), found


def score_flow_table(spark: SparkSession, flows: DataFrame, state_dir: str, id_col: str = "flow_id",
                     with_timestamp: bool = True) -> DataFrame:
    """Inference entry point (AL5 with persisted state): feature state,
    encoder / head / autoencoder parameters, per-head threshold and
    temperature (missing -> defaults) and the anomaly cut are read from
    ``state_dir``; nothing is refit.  Works on a batch table or a stream."""
    from flowlab.streaming.alerts import model_alerts
    st = FT.FeatureState.load(spark, f"{state_dir}/feature_state")
    ptab = spark.read.parquet(f"{state_dir}/model_params")
    hp = STATE.read_head_params(spark, f"{state_dir}/head_params")
    tasks = [r["head"] for r in hp.select("head").collect()]
    heads = {t: MO.layers_from_table(ptab, f"head_{t}") for t in tasks}
    enc = MO.layers_from_table(ptab, "encoder")
    ae = MO.layers_from_table(ptab, "autoencoder")
    cut = spark.read.parquet(f"{state_dir}/anomaly_params").first()["threshold"]
    params = AL.resolve_params(spark, tasks, hp)
    return model_alerts(flows, st, enc, heads, ae, params, float(cut), id_col, with_timestamp)


def run_named_dataset(spark: SparkSession, dataset: str, base: str, out_dir: str, **kw) -> DataFrame:
    """PL1: a named dataset (KDD Cup 99 / CICIDS2017) end to end."""
    train, test = SRC.load_pair(spark, dataset, base)
    return run_pipeline(train, test, out_dir, **kw)


def run_csv_pair(spark: SparkSession, train_csv: str, test_csv: str, out_dir: str, label_col: str = "label",
                 category_col: str = "attack_cat", **kw) -> DataFrame:
    """PL2: a headered CSV pair (UNSW-style ``label`` 0/1 + ``attack_cat``)."""
    train, test = (SRC.store_headered_csv(spark, path, f"{out_dir}/input/{name}", label_col,
                                          lambda df: _labelled(df, label_col, category_col, "id"))
                   for name, path in (("train", train_csv), ("test", test_csv)))
    return run_pipeline(train, test, out_dir, stored=True, **kw)


def labelled_csv(spark: SparkSession, path: str, label_col: str = "label", category_col: str = "attack_cat",
                 id_col: str | None = "id") -> DataFrame:
    """A headered capture with a 0/1 target and a family column as the
    standard label columns (the id column is dropped as a feature later)."""
    return _labelled(SRC.read_headered_csv(spark, path, label_col), label_col, category_col, id_col)


def _labelled(df: DataFrame, label_col: str, category_col: str, id_col: str | None) -> DataFrame:
    # exact-name selection: Spark resolves names case-insensitively, so a
    # ``label`` column and a derived ``Label`` must never coexist
    keep = [c for c in df.columns if c not in (label_col, category_col, id_col)]
    out = df.select(*[F.col(f"`{c}`") for c in keep],
                    F.when(F.col(f"`{label_col}`").cast("int") == 1, "attack").otherwise("normal").alias("_fl_label"),
                    F.lower(F.trim(F.col(f"`{category_col}`").cast("string"))).alias("_fl_cat"))
    return out.withColumnRenamed("_fl_label", "Label").withColumnRenamed("_fl_cat", "AttackCategory")


def run_sequence(spark: SparkSession, jobs: list[tuple[str, str]], out_dir: str, **kw) -> DataFrame:
    """PL3: the three-task sequence over several datasets."""
    res = None
    for name, base in jobs:
        m = run_named_dataset(spark, name, base, f"{out_dir}/{SRC.normalise_dataset_name(name)}", **kw)
        m = m.withColumn("dataset", F.lit(name))
        res = m if res is None else res.unionByName(m)
    return res


def report_tables(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """PL4: the tables behind the plots (history, metrics, bases, and per task
    the curves, the threshold sweep and the confusion matrix; task x stage F1),
    or those of ``names``: a report is read once for its types alone."""
    readers = {"history": spark.read.parquet, "bases": spark.read.parquet} | {
        name: spark.read.json for name in ["metrics", "forgetting", *REPORT_TABLES]}
    return {name: read(f"{out_dir}/{name}") for name, read in readers.items() if names is None or name in names}


def synthetic_benchmark(spark: SparkSession, out_dir: str, n_train: int = 20000, n_test: int = 10000,
                        n_features: int = 80) -> dict:
    """PL5: synthetic flows end to end; per-task F1 and elapsed seconds."""
    t0 = time.time()
    df = SRC.synthetic_flows(spark, n_train + n_test, n_features)
    fam = {"Benign": "normal", "DoS": "dos", "PortScan": "probe", "Exfiltration": "exfiltration"}
    mapping = F.create_map(*[F.lit(x) for kv in fam.items() for x in kv])
    df = df.select("*", F.when(F.col("Label") == "Benign", "normal").otherwise("attack").alias("_lab"),
                   mapping[F.col("Label")].alias("AttackCategory")).drop("Label").withColumnRenamed("_lab", "Label")
    train, test = df.where(F.col("id") < n_train).drop("id"), df.where(F.col("id") >= n_train).drop("id")
    m = run_pipeline(train, test, out_dir, ssl_epochs=2, task_epochs=3)
    f1 = {r["task"]: r["value"] for r in m.where("metric = 'f1_weighted'").collect()}
    return {"f1": f1, "elapsed": time.time() - t0}


def flow_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """lineitem as a labelled capture: R-flag = attack; families by
    (returnflag, linestatus); split per file (linenumber) and stratum."""
    from flowlab.plans.bindings import flows
    f = flows(spark, sf_dir)
    fam = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "dos")
           .when(F.col("l_returnflag") == "R", "probe").otherwise("normal"))
    f = f.withColumn("AttackCategory", fam).withColumn("AttackLabel", F.concat("l_returnflag", "l_linestatus"))
    s = SP.stratified_split(f, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "AttackLabel",
                            file_col="l_linenumber")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "Label", "AttackLabel", "AttackCategory"]
    return s.where("split = 'train'").select(*cols), s.where("split = 'test'").select(*cols)
