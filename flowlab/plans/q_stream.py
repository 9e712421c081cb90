"""Batch forms of the streaming alert jobs (ST1-ST4): the same functions the
streaming queries use, run over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.plans.catalog import register, rounded
from flowlab.sources.tables import table
from flowlab.streaming import alerts as ST

ALERTS_SQL = """alerts AS (
  SELECT CAST(event_id AS VARCHAR) AS flow_id, user_id, ts,
    CASE WHEN event_type = 'error' THEN 'error'
         WHEN least(greatest(value / CAST(500 AS DOUBLE), 0.0), 1.0) >= CAST('0.65' AS DOUBLE) THEN 'zero-day / unknown'
         ELSE NULL END AS attack_type,
    least(greatest(value / CAST(500 AS DOUBLE), 0.0), 1.0) AS anomaly_score
  FROM events),
sev AS (SELECT *, CASE WHEN anomaly_score > 0.9 THEN 'CRITICAL' WHEN anomaly_score > 0.7 THEN 'HIGH'
   WHEN anomaly_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM alerts)"""


def _alerts(spark, sf_dir):
    return ST.event_alerts(table(spark, sf_dir, "events"))


@register("stream_alerts", f"WITH {ALERTS_SQL}\nSELECT flow_id, attack_type, round(anomaly_score, 6) AS anomaly_score, "
          "severity FROM sev")
def q_stream_alerts(spark, sf_dir):
    return rounded(_alerts(spark, sf_dir).select("flow_id", "attack_type", "anomaly_score", "severity"))


@register("alert_windows", f"WITH {ALERTS_SQL}\nSELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, "
          "time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, severity, CAST(COUNT(*) AS BIGINT) AS n "
          "FROM sev GROUP BY ALL")
def q_alert_windows(spark, sf_dir):
    return ST.alert_counts(_alerts(spark, sf_dir), "1 hour", watermark=None)


@register("alert_windows_sliding", f"""WITH {ALERTS_SQL},
w AS (SELECT time_bucket(INTERVAL 30 minutes, ts) AS window_start, severity FROM sev
      UNION ALL SELECT time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes, severity FROM sev)
SELECT window_start, window_start + INTERVAL 1 hour AS window_end, severity, CAST(COUNT(*) AS BIGINT) AS n
FROM w GROUP BY ALL""")
def q_alert_windows_sliding(spark, sf_dir):
    return ST.alert_counts(_alerts(spark, sf_dir), "1 hour", "30 minutes", watermark=None)


@register("alert_dedup", f"""WITH {ALERTS_SQL}
SELECT user_id, attack_type, time_bucket(INTERVAL 1 hour, ts) AS window_start, min(ts) AS first_ts,
       CAST(COUNT(*) AS BIGINT) AS n FROM alerts WHERE attack_type IS NOT NULL GROUP BY ALL""")
def q_alert_dedup(spark, sf_dir):
    a = _alerts(spark, sf_dir).where(F.col("attack_type").isNotNull())
    g = a.groupBy("user_id", "attack_type", F.window("ts", "1 hour").alias("w")).agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "attack_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


@register("alert_sessions", f"""WITH {ALERTS_SQL},
a AS (SELECT user_id, ts FROM alerts WHERE attack_type IS NOT NULL),
g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 minutes THEN 1 ELSE 0 END AS nw FROM a),
s AS (SELECT user_id, ts, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS sid FROM g)
SELECT user_id, min(ts) AS session_start,
       max(ts) + INTERVAL 30 minutes AS session_end, CAST(COUNT(*) AS BIGINT) AS n
FROM s GROUP BY user_id, sid""")
def q_alert_sessions(spark, sf_dir):
    a = _alerts(spark, sf_dir).where(F.col("attack_type").isNotNull())
    return ST.batch_sessions(a, 1800, "user_id")
