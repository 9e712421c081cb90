"""Whole runs over captures written from the driver tables (PL2, PL3): small
models, all rows; the confusion tables a run leaves are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.plans import pipelines as PL
from flowlab.plans import q_flows as QF
from flowlab.plans.catalog import register
from flowlab.plans.q_io import _kdd_capture, scratch
from flowlab.sources.tables import table

SMALL = {"ssl_epochs": 1, "task_epochs": 1, "embed_dim": 8}


def _evaluated(spark: SparkSession, out_dir: str) -> DataFrame:
    """Test rows by task and true class, from the confusion tables."""
    return PL.report_tables(spark, out_dir, ["confusion"])["confusion"].groupBy("task", F.col("y_true").cast("int").alias("y_true")).agg(
        F.sum("n").cast("long").alias("n"))


@register("csv_pair_run", """
WITH t AS (SELECT l_returnflag = 'R' AS attack, l_linestatus = 'F' AS f FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT 'intrusion' AS task, CAST(attack AS INTEGER) AS y_true, CAST(COUNT(*) AS BIGINT) AS n FROM t GROUP BY attack
UNION ALL SELECT 'dos', CAST(attack AND f AS INTEGER), CAST(COUNT(*) AS BIGINT) FROM t GROUP BY attack AND f""")
def q_csv_pair_run(spark, sf_dir):
    """PL2: a headered CSV pair (odd lines train, even lines test) from the
    files to the report tables."""
    path = scratch(spark, "pair")
    attack = F.col("l_returnflag") == "R"
    li = table(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
        attack.cast("int").alias("label"),
        F.when(~attack, "Normal").when(F.col("l_linestatus") == "F", "DoS").otherwise(" Probe ").alias("attack_cat"))
    for name, rest in (("train", 1), ("test", 0)):
        li.where(F.col("l_linenumber") % 2 == rest).write.option("header", True).option("compression", "gzip").csv(f"{path}/{name}.csv")
    PL.run_csv_pair(spark, f"{path}/train.csv", f"{path}/test.csv", f"{path}/out", tasks=["intrusion", "dos"], **SMALL)
    return _evaluated(spark, f"{path}/out")


@register("sequence_run", """
SELECT 'kddcup99' AS dataset, 'intrusion' AS task, CAST(COUNT(*) AS BIGINT) AS n FROM events
UNION ALL SELECT 'cicids2017', 'intrusion', CAST(SUM(CAST(ceil(CAST('0.2' AS DOUBLE) * n) AS BIGINT)) AS BIGINT)
FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM events GROUP BY event_id % 2)""")
def q_sequence_run(spark, sf_dir):
    """PL3: two named datasets one after the other, each with its own state."""
    path = scratch(spark, "sequence")
    for part in ("kddcup.data_10_percent", "corrected"):
        _kdd_capture(spark, sf_dir, f"{path}/kdd/{part}")
    ev = table(spark, sf_dir, "events").withColumn("raw", QF._pick(QF.CIC_RAW, 17))
    for rest in (0, 1):
        ev.where(F.pmod("event_id", F.lit(2)) == rest).select("user_id", "value", F.col("raw").alias("Label")).coalesce(1).write.option(
            "header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/cic/day{rest}")
    PL.run_sequence(spark, [("kddcup99", f"{path}/kdd"), ("cicids2017", f"{path}/cic")], f"{path}/out", tasks=["intrusion"], **SMALL)
    out = None
    for name in ("kddcup99", "cicids2017"):
        found = _evaluated(spark, f"{path}/out/{name}").groupBy("task").agg(F.sum("n").alias("n")).select(
            F.lit(name).alias("dataset"), "task", "n")
        out = found if out is None else out.unionByName(found)
    return out
