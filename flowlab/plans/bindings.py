"""Binding the driver's tables to the flow / score data model.

No IDS capture is available offline, so the tables stand in (SURVEY §7.3):

* ``documents`` joined to ``labels``: scored binary rows.  Target = quality,
  class-1 probability = n_chars / (n_chars + 2000), logit = ln(n_chars / 2000).
* ``lineitem``: the flow table (numeric and categorical features, attack
  label R-flag), key (l_orderkey, l_linenumber, l_partkey, l_suppkey).
* ``events``: timed flows (``error`` = attack), the streaming input.
* ``embeddings``: 64-d unit vectors with a 0-9 label (embedding space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.sources.tables import table

DOC_SCALE = 2000.0


def doc_prob(n_chars: Column) -> Column:
    n = n_chars.cast("double")
    return n / (n + F.lit(DOC_SCALE))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, logit, toxic) for every labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"),
        doc_prob(F.col("n_chars")).alias("p"),
        F.ln(F.col("n_chars").cast("double") / F.lit(DOC_SCALE)).alias("logit"),
        F.col("toxic").cast("int").alias("toxic"))


def flow_key(prefix: str = "") -> Column:
    return F.concat_ws("-", *[F.col(f"{prefix}{c}").cast("string")
                              for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a flow table with a string flow id and standard labels."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        flow_key().alias("flow_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(F.col("l_returnflag") == "R", "attack").otherwise("normal").alias("Label"))


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem scored by a fixed linear rule: y = returnflag R,
    p = (discount + tax) / 0.18 (inside [0, 1] for TPC-H ranges)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        flow_key().alias("id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_discount") + F.col("l_tax")) / F.lit(0.18)).alias("p"))
