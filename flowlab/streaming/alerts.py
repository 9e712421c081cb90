"""Structured Streaming alert jobs (ST1-ST4).

The scoring and aggregation functions take any DataFrame, so the same code
runs on a batch table and on a stream; streaming adds watermarks (late rows
dropped, state bounded) and checkpointed sinks (a query restarts where it
stopped after a failure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import alerts as AL
from flowlab.operators import features as FT
from flowlab.operators import models as MO
from flowlab.operators.prefix import value_ranges
from flowlab.session import ensure_parallelism

EVENT_SCALE = 500.0   # events: anomaly score = clip(value / 500, 0, 1)


def event_alerts(events: DataFrame) -> DataFrame:
    """ST1 scorer for the events feed: ``error`` events are attacks, the
    anomaly score is the scaled value, severity from the score only.
    ``ts`` (timestamp_ntz on disk) becomes a timestamp for watermarks."""
    score = F.least(F.greatest(F.col("value") / F.lit(EVENT_SCALE), F.lit(0.0)), F.lit(1.0))
    return events.select(
        F.col("event_id").cast("string").alias("flow_id"), "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("error")).when(score >= F.lit(0.65), F.lit("zero-day / unknown"))
        .otherwise(F.lit(None).cast("string")).alias("attack_type"),
        score.alias("anomaly_score"), A.severity(score).alias("severity"))


def score_stream(stream: DataFrame, scorer=event_alerts) -> DataFrame:
    """ST1: stateless scoring of a flow stream (batch code reused)."""
    return scorer(stream)


def alert_counts(alerts: DataFrame, window: str = "1 hour", slide: str | None = None,
                 watermark: str | None = "2 hours") -> DataFrame:
    """ST2: alert counts per event-time window and severity."""
    a = alerts.withWatermark("ts", watermark) if watermark else alerts
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = a.groupBy(w.alias("w"), "severity").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "severity", "n")


def dedup_alerts(alerts: DataFrame, keys: list[str], watermark: str = "2 hours") -> DataFrame:
    """ST3: drop repeats of the same key within the watermark delay."""
    return alerts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def alert_sessions(alerts: DataFrame, gap: str = "30 minutes", key: str = "user_id",
                   watermark: str | None = "2 hours") -> DataFrame:
    """ST4 (streaming form): alert bursts per key closed by ``gap``."""
    a = alerts.withWatermark("ts", watermark) if watermark else alerts
    g = a.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


def batch_sessions(alerts: DataFrame, gap_seconds: int = 1800, key: str = "user_id",
                   bucket_seconds: int | None = None, n_parts: int | None = None) -> DataFrame:
    """ST4 (batch form), exact and skew-proof.  Rows are cut into ranges of
    (key, ts) at literal split points, so a key holding a third of all rows is
    spread over many tasks; each task orders only its own slice.  What crosses
    a range edge -- the previous event time and the sessions opened earlier --
    comes from a per-(range, key) summary, i.e. a two-level prefix sum.  An
    event exactly ``gap_seconds`` after the last one still belongs to its
    session, as in ``session_window``.
    ``bucket_seconds`` selects the time-bucket variant instead."""
    if bucket_seconds:
        return _bucket_sessions(alerts, gap_seconds, key, bucket_seconds)
    gap_us = gap_seconds * 1_000_000
    n = n_parts or max(8, int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    a = alerts.select(key, F.unix_micros(F.col("ts")).alias("_t"))
    a = value_ranges(a, [key, "_t"], "_p", n)
    summ = a.groupBy("_p", key).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    wk = Window.partitionBy(key).orderBy("_p")
    summ = summ.withColumn("_prev_last", F.lag("_last").over(wk))
    summ = summ.withColumn("_first_new", F.when(F.col("_prev_last").isNull()
                                                | (F.col("_first") - F.col("_prev_last") > gap_us), 1).otherwise(0))
    w = Window.partitionBy("_p", key).orderBy("_t")
    j = a.join(summ.select("_p", key, "_first_new"), ["_p", key])
    prev = F.lag("_t").over(w)
    j = j.withColumn("_new", F.when(prev.isNull(), F.col("_first_new"))
                     .when(F.col("_t") - prev > gap_us, 1).otherwise(0))
    j = j.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = j.groupBy("_p", key).agg(F.sum("_new").alias("_k"))
    offs = opened.select("_p", key, F.coalesce(F.sum("_k").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_off"))
    g = j.join(offs, ["_p", key]).withColumn("_sid", F.col("_off") + F.col("_local"))
    s = g.groupBy(key, "_sid").agg(F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.timestamp_micros("_s").cast("timestamp_ntz").alias("session_start"),
                    F.timestamp_micros(F.col("_e") + gap_us).cast("timestamp_ntz").alias("session_end"),
                    F.col("n").cast("long").alias("n"))


def _bucket_sessions(alerts: DataFrame, gap_seconds: int, key: str, bucket_seconds: int) -> DataFrame:
    """Time-bucket variant: rows ordered inside (key, time bucket)
    partitions, cross-bucket state from a per-(key, bucket) summary."""
    t = F.unix_micros(F.col("ts"))
    gap_us, bucket_us = gap_seconds * 1_000_000, bucket_seconds * 1_000_000
    a = alerts.select(key, t.alias("_t"), F.floor(t / bucket_us).alias("_b"))
    # per (key, bucket): first / last event time (one row per bucket)
    summ = a.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    wk = Window.partitionBy(key).orderBy("_b")
    summ = summ.withColumn("_prev_last", F.lag("_last").over(wk))
    summ = summ.withColumn("_first_new", F.when(F.col("_prev_last").isNull()
                                                | (F.col("_first") - F.col("_prev_last") > gap_us), 1).otherwise(0))
    w = Window.partitionBy(key, "_b").orderBy("_t")
    j = a.join(summ.select(key, "_b", "_first_new"), [key, "_b"])
    prev = F.lag("_t").over(w)
    j = j.withColumn("_new", F.when(prev.isNull(), F.col("_first_new"))
                     .when(F.col("_t") - prev > gap_us, 1).otherwise(0))
    j = j.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # sessions opened in earlier buckets of the same key
    opened = j.groupBy(key, "_b").agg(F.sum("_new").alias("_k"))
    offs = opened.select(key, "_b", F.coalesce(F.sum("_k").over(wk.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_off"))
    g = j.join(offs, [key, "_b"]).withColumn("_sid", F.col("_off") + F.col("_local"))
    s = g.groupBy(key, "_sid").agg(F.min("_t").alias("_s"), F.max("_t").alias("_e"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.timestamp_micros("_s").cast("timestamp_ntz").alias("session_start"),
                    F.timestamp_micros(F.col("_e") + gap_us).cast("timestamp_ntz").alias("session_end"),
                    F.col("n").cast("long").alias("n"))


def events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over an events folder (schema from a batch read)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Process everything available now into a checkpointed sink, then stop."""
    q = (df.writeStream.outputMode(mode).format(fmt).option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def foreach_batch_alerts(df: DataFrame, out_path: str, checkpoint: str):
    """IO14 streaming sink: each micro-batch is written to its own
    ``batch_id`` partition, by severity.  A batch that is replayed after a
    failure replaces that partition, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("severity").parquet(f"{out_path}/batch_id={batch_id}")

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q




def model_alerts(flows: DataFrame, state: FT.FeatureState, encoder: list[dict], heads: dict[str, list[dict]],
                 autoencoder: list[dict], head_params: list[tuple[str, float, float | None]], ae_threshold: float,
                 id_col: str = "flow_id", with_timestamp: bool = True) -> DataFrame:
    """ST1 / AL5: fitted feature state -> encoder -> every head and the
    autoencoder in one Arrow pass (parameters broadcast) -> routing.  Purely
    row-wise (no shuffle, no state), so it runs unchanged on a stream."""
    z = model_scores(flows, state, encoder, heads, autoencoder, id_col)
    return route_scores(z, list(heads), head_params, ae_threshold, id_col, with_timestamp)


def model_scores(flows: DataFrame, state: FT.FeatureState, encoder: list[dict], heads: dict[str, list[dict]],
                 autoencoder: list[dict], id_col: str = "flow_id") -> DataFrame:
    """Per flow: every head's logits (``lg_<head>``) and the reconstruction
    error, from one forward pass over Arrow batches."""
    x = FT.transform(ensure_parallelism(flows), state, label_col=None, keep=[id_col])
    nets = {f"lg_{h}": net for h, net in heads.items()}
    nets["recon"] = autoencoder
    z = MO.apply_nets(x, "features", nets, [id_col], encoder=encoder)
    return z.select(id_col, *[F.col(f"lg_{h}") for h in heads],
                    A.mse(F.col("embedding"), F.col("recon")).alias("err"))


def route_scores(z: DataFrame, heads: list[str], head_params: list[tuple[str, float, float | None]],
                 ae_threshold: float, id_col: str = "flow_id", with_timestamp: bool = True) -> DataFrame:
    """AL1-AL3 on scored flows."""
    hp = AL.head_probs({h: F.col(f"lg_{h}") for h in heads}, head_params)
    s = z.select(id_col, hp.alias("heads"), A.anomaly_score(F.col("err"), ae_threshold).alias("anomaly"))
    return AL.alerts(s, id_col, F.col("heads"), F.col("anomaly"), with_timestamp=with_timestamp)
