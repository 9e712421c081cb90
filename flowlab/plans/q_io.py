"""Source and sink queries (IO1-IO3, IO5-IO7, IO9-IO12, IO14, ST3): the driver
tables are written in the capture's format to the shared checkpoint folder
and read back by the reader under test."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.operators import alerts as AL
from flowlab.operators import content_id as CI
from flowlab.operators import features as FT
from flowlab.operators import metrics as M
from flowlab.operators import models as MO
from flowlab.plans import q_embed as QE
from flowlab.plans import q_eval as QV
from flowlab.plans import q_flows as QF
from flowlab.plans.catalog import REGISTRY, register, rounded
from flowlab.plans.q_stream import ALERTS_SQL
from flowlab.session import ensure_checkpoint_dir
from flowlab.sources import flows as SRC
from flowlab.sources import state as STATE
from flowlab.sources.tables import table
from flowlab.streaming import alerts as ST


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


# --------------------------------------------------------------- captures

@register("headered_csv", """
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       round(l_quantity, 6) AS l_quantity, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_discount, 6) END AS l_discount,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS l_linestatus, l_returnflag AS label FROM lineitem""")
def q_headered_csv(spark, sf_dir):
    """IO1, IO4, IO7: padded header names, missing-value spellings, typed columns."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" l_orderkey "), F.col("l_linenumber").alias("l_linenumber "),
        F.col("l_quantity").alias(" l_quantity"),
        F.when(F.col("l_discount") == 0, F.lit("#N/A")).otherwise(F.col("l_discount").cast("string")).alias("l_discount"),
        F.when(F.col("l_linestatus") == "O", F.lit("NaN")).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.col("l_returnflag").alias(" label"))
    path = scratch(spark, "headered")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return rounded(SRC.read_headered_csv(spark, path, "label"))


def _kdd_capture(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The events as a headerless capture: event id as ``src_bytes``."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    raw = QF.kdd_raw(ev).join(ev, "event_id")
    given = {"src_bytes": F.col("event_id"), "duration": F.col("user_id"), "protocol_type": F.col("event_type")}
    raw.select(*[given.get(n, F.lit("x") if t == "string" else F.lit(0)).alias(n) for n, t in SRC.KDD_FEATURES],
               F.col("raw_label").alias("AttackLabel")).write.option("header", False).csv(path)


@register("kdd_csv", QF.KDD_SQL + """
SELECT CAST(fam.event_id AS BIGINT) AS event_id, CAST(e.user_id AS INTEGER) AS duration, e.event_type AS protocol_type,
       attack_label, label, attack_category FROM fam JOIN events e ON fam.event_id = e.event_id""")
def q_kdd_csv(spark, sf_dir):
    """IO2, IO3, IO6: dataset name -> first existing candidate -> 41 typed columns and standard labels."""
    base = scratch(spark, "kdd")
    _kdd_capture(spark, sf_dir, f"{base}/kddcup.data_10_percent")
    d = SRC.load_dataset(spark, "KDD-Cup_99", "train", base)
    return d.select(F.col("src_bytes").alias("event_id"), "duration", "protocol_type",
                    F.col("AttackLabel").alias("attack_label"), F.col("Label").alias("label"),
                    F.col("AttackCategory").alias("attack_category"))


@register("cic_folder", QF.CIC_SQL + """
SELECT e.event_id, e.user_id, CASE WHEN e.event_id % 2 = 0 THEN round(e.value, 6) END AS value,
       attack_label, label, attack_category FROM fam JOIN events e ON fam.event_id = e.event_id""")
def q_cic_folder(spark, sf_dir):
    """IO5, UN1: a folder of capture files with two different headers, appended by name."""
    base = scratch(spark, "cic")
    ev = table(spark, sf_dir, "events").withColumn("raw", QF._pick(QF.CIC_RAW, 17))
    for rest, cols in ((0, ["event_id", "user_id", "value"]), (1, ["event_id", "user_id"])):
        ev.where(F.pmod("event_id", F.lit(2)) == rest).select(*cols, F.col("raw").alias("Label")).write.option(
            "header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{base}/day{rest}")
    d = SRC.read_cic(spark, base)
    return rounded(d.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"),
                            "value", F.col("AttackLabel").alias("attack_label"), F.col("Label").alias("label"),
                            F.col("AttackCategory").alias("attack_category")))


# ------------------------------------------------------------------ state

@register("stored_features", REGISTRY["feature_vectors"][1])
def q_stored_features(spark, sf_dir):
    """IO9: the feature state, its vocabularies as tables, is saved, loaded and applied."""
    path = scratch(spark, "features")
    QF._sparse_state(spark, sf_dir).save(path)
    st = FT.SparseState.load(spark, path)
    d = FT.clean(QF.dirty_flows(spark, sf_dir).select("flow_id", *QF.NUM, *QF.CAT, "Label"), numeric=QF.NUM)
    x = FT.sparse_features(d, st, ["flow_id", "Label"])
    return rounded(x.select("flow_id", "size", "indices", "values",
                            FT.encode_label(F.col("Label"), QF._classes(spark, sf_dir)).alias("y")))


@register("stored_heads", REGISTRY["head_scores"][1])
def q_stored_heads(spark, sf_dir):
    """IO11: head parameters are saved as tables, loaded and applied in one forward pass."""
    path = scratch(spark, "heads")
    tables = None
    for h, w in QE.HEAD_W.items():
        t = MO.params_table(spark, h, [{"W": w.T, "b": np.zeros(len(w)), "act": None}])
        tables = t if tables is None else tables.unionByName(t)
    STATE.save_params(tables, path)
    held = spark.read.parquet(path)
    nets = {f"logits_{h}": MO.layers_from_table(held, h) for h in MO.HEADS}
    return rounded(MO.apply_nets(QE.emb(spark, sf_dir), "embedding", nets, ["vec_id"]).select("vec_id", *nets))


def _centroids(spark: SparkSession, sf_dir: str, low: int, high: int) -> DataFrame:
    e = QE.emb(spark, sf_dir).where(F.col("label").between(low, high))
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return e.groupBy(F.col("label").cast("int").alias("component")).agg(vector_to_array(mean).alias("vec")).withColumn(
        "block_id", F.lit(0))


@register("stored_bases", """
WITH e AS (SELECT CAST(label AS INTEGER) AS component, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT component, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY component, i),
v AS (SELECT component, list(round(m, 6) ORDER BY i) AS vec FROM c GROUP BY component)
SELECT CASE WHEN component <= 4 THEN 0 ELSE 1 END AS task_ord, CASE WHEN component <= 4 THEN 'dos' ELSE 'port_scan' END AS task,
       component, 0 AS block_id, vec FROM v WHERE component <= 2 OR component >= 5""")
def q_stored_bases(spark, sf_dir):
    """IO10: two tasks appended, the first one replaced, then listed."""
    path = scratch(spark, "bases")
    STATE.save_basis(spark, path, 0, "dos", _centroids(spark, sf_dir, 0, 4))
    STATE.save_basis(spark, path, 1, "port_scan", _centroids(spark, sf_dir, 5, 9))
    STATE.save_basis(spark, path, 0, "dos", _centroids(spark, sf_dir, 0, 2))
    return rounded(STATE.load_bases(spark, path).select("task_ord", "task", "component", "block_id", "vec"))


@register("stored_report", QV.PRF_SQL)
def q_stored_report(spark, sf_dir):
    """IO12: metric rows written as JSON by metric and read back."""
    path = scratch(spark, "report")
    STATE.write_report(M.prf_table(M.confusion(QV._doc_pred(spark, sf_dir), "y", "pred")), path, ["metric"])
    return rounded(spark.read.schema("class int, value double, metric string").json(path).select("metric", "class", "value"))


# ------------------------------------------------------------------ sinks

@register("alert_sink", REGISTRY["stream_alerts"][1])
def q_alert_sink(spark, sf_dir):
    """IO14: a run of alerts that is written twice is in the sink once."""
    path = scratch(spark, "alerts")
    a = ST.event_alerts(table(spark, sf_dir, "events")).select("flow_id", "attack_type", "anomaly_score", "severity")
    for _ in range(2):
        AL.commit_alerts(a, path, "run-1")
    return rounded(AL.committed_alerts(spark, path).select(*a.columns))


def _sql_part(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE len({text}) || ':' || {text} END"


@register("content_ids", f"""
WITH r AS (SELECT event_type, user_id % 5 AS host, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 7 END AS port FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, host, port) - 1 AS k FROM r)
SELECT event_type, host, port, 'flow_' || sha256(concat_ws('|', {_sql_part('event_type')}, {_sql_part('host')}, {_sql_part('port')}))
       || '-' || CAST(k AS VARCHAR) AS flow_id FROM k""")
def q_content_ids(spark, sf_dir):
    """PR24: ids of rows with nulls and many repeats."""
    r = table(spark, sf_dir, "events").select(
        "event_type", (F.col("user_id") % 5).alias("host"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 7).alias("port"))
    return CI.content_ids(r, "flow_id")


@register("stream_dedup", f"""WITH {ALERTS_SQL}
SELECT DISTINCT user_id, attack_type, time_bucket(INTERVAL 1 hour, ts) AS hour FROM alerts WHERE attack_type IS NOT NULL""")
def q_stream_dedup(spark, sf_dir):
    """ST3 as a stream: one alert per user, type and hour reaches the sink.
    The hour is part of the key and shorter than the two hours of the
    watermark, so state that has expired can't let a repeat through."""
    path = scratch(spark, "dedup")
    # the pattern lets the file source read one file as well as a folder
    a = ST.event_alerts(ST.events_stream(spark, f"{sf_dir.rstrip('/')}/event[s].parquet")).where(
        F.col("attack_type").isNotNull()).withColumn("hour", F.date_trunc("hour", "ts"))
    once = ST.dedup_alerts(a, ["user_id", "attack_type", "hour"]).select("user_id", "attack_type", "hour")
    ST.run_available(once, f"{path}/out", f"{path}/state")
    return spark.read.schema(once.schema).parquet(f"{path}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# ------------------------------------------------- streams run twice

# The first half of the events in time arrives first; the rest arrives after a
# restart, together with a tenth of the rows of a day and more before it.
ARRIVAL_SQL = f"""{ALERTS_SQL},
half AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS mid FROM events),
told AS (SELECT s.*, CAST(flow_id AS BIGINT) % 10 = 3 AND epoch_us(ts) < mid - 86400000000 AS late, epoch_us(ts) < mid AS early
         FROM sev s, half)"""


def _in_two_parts(spark: SparkSession, sf_dir: str, path: str, query) -> None:
    """Run ``query(stream of events)`` to its end over the first part of the
    events, then again, from the same checkpoint, after the second came in."""
    ev = table(spark, sf_dir, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    lo, hi = ev.agg(F.min("_us"), F.max("_us")).first()
    at = lo + (hi - lo) // 2
    late = (F.col("event_id") % 10 == 3) & (F.col("_us") < at - 86_400_000_000)
    first = (F.col("_us") < at) & ~late
    for part in (first, ~first):
        ev.where(part).drop("_us").coalesce(1).write.mode("append").parquet(f"{path}/in")
        query(ST.event_alerts(ST.events_stream(spark, f"{path}/in")))


@register("stream_windows", f"""WITH {ARRIVAL_SQL},
mark AS (SELECT (SELECT max(ts) FROM told WHERE early AND NOT late) - INTERVAL 2 hours AS one, (SELECT max(ts) FROM told) - INTERVAL 2 hours AS two),
w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, severity, early AND NOT late AS first_part FROM told)
SELECT window_start, window_start + INTERVAL 1 hour AS window_end, severity, CAST(COUNT(*) AS BIGINT) AS n FROM w, mark
WHERE (first_part OR window_start + INTERVAL 1 hour > one) AND window_start + INTERVAL 1 hour <= two GROUP BY ALL""")
def q_stream_windows(spark, sf_dir):
    """ST2 as a stream with state: hourly counts, stopped and started again;
    rows behind the watermark are left out, open windows aren't written."""
    path = scratch(spark, "windows")
    _in_two_parts(spark, sf_dir, path, lambda a: ST.run_available(
        ST.alert_counts(a, "1 hour", watermark="2 hours"), f"{path}/out", f"{path}/state"))
    return spark.read.parquet(f"{path}/out")


@register("stream_sessions", f"""WITH {ARRIVAL_SQL},
a AS (SELECT user_id, time_bucket(INTERVAL 10 minutes, ts) AS ts, early AND NOT late AS first_part FROM told WHERE attack_type IS NOT NULL),
mark AS (SELECT (SELECT max(ts) FROM a WHERE first_part) - INTERVAL 2 hours AS one, (SELECT max(ts) FROM a) - INTERVAL 2 hours AS two),
kept AS (SELECT user_id, ts FROM a, mark WHERE first_part OR ts + INTERVAL 30 minutes > one),
g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 minutes THEN 1 ELSE 0 END AS nw
      FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
f AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, CAST(COUNT(*) AS BIGINT) AS n
      FROM s GROUP BY user_id, sid)
SELECT f.* FROM f, mark WHERE session_end <= two""")
def q_stream_sessions(spark, sf_dir):
    """ST4 as a stream with state: bursts of attacks per user on a grid of ten
    minutes, so gaps of exactly half an hour occur; stopped and started again."""
    path = scratch(spark, "sessions")

    def run(alerts):
        grid = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600) * 600)
        attacks = alerts.where(F.col("attack_type").isNotNull()).withColumn("ts", grid)
        ST.run_available(ST.alert_sessions(attacks, "30 minutes", watermark="2 hours"), f"{path}/out", f"{path}/state")

    _in_two_parts(spark, sf_dir, path, run)
    return spark.read.parquet(f"{path}/out")
