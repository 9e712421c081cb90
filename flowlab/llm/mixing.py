"""Mixing sources to target weights (DataFrame operators only).

Tokens are counted per source, the budget is shared over the sources by
weight (a source that reaches its ceiling hands its excess on), and every
document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy
whose probability is the fraction of ``rate = target / source_size`` (nearly:
of SEEDS draws that have exactly this probability the best one is taken).

The Bernoulli draws come from one md5 per document.  ``seeds`` candidate
draws are tried in the same aggregation and every source takes the seed whose
total comes closest to its target, so small sources with a few very long
documents land near their target as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import cut, n_words, unused

WEIGHTS = (5, 2, 1)
SEEDS = 32
DRAW = 1 << 30           # draws are integers below this
BROADCAST_SOURCES = 50_000


def shares(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5,
           ceiling: int = 2) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Sources take the weights in turn, in code point order with null last.
    A source whose ceiling lies below its share of the rest stops there; the
    level ``(budget - ceilings) / open weights`` is found by comparing the
    sources in the order of ceiling / weight.  One row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sources.withColumn("weight", w.cast("long")).withColumn("top", F.lit(ceiling) * F.col("source_size"))
    before = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    left = total - F.coalesce(F.sum("top").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level if every source before this one stops at its ceiling; the
    # first source that lies at or above that level sets it for all after it
    level = F.when(F.col("top") / F.col("weight") >= left / open_weight, left / open_weight)
    t = t.withColumn("at", level)
    t = t.withColumn("level", F.max("at").over(every))
    return t.select("source", "source_size", "weight",
                    F.least(F.col("top").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def draw_pair(key: Column, seed: str) -> tuple[Column, Column]:
    """Two integers from one md5 of (seed, key); draw k is (a + k * b) mod DRAW."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long"))


def id_key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))


def beside(rows: DataFrame, lists: DataFrame, source_col: str) -> DataFrame:
    """Join the per-source list to rows.  The list is broadcast when it is
    counted and small; longer lists are joined by a shuffle (AQE splits the
    partitions of a hot source)."""
    name = unused(rows, "_s")
    side = lists.withColumnRenamed("source", name)
    side = F.broadcast(side) if lists.count() <= BROADCAST_SOURCES else side
    return rows.join(side, F.col(f"`{source_col}`").eqNullSafe(F.col(name))).drop(name)


def source_plan(rows: DataFrame, seed: str, seeds: int) -> DataFrame:
    """Per source of ``rows`` (id, source, size): source_size, target, the
    whole part of its rate, the threshold of the draw and the seed number."""
    table = cut(shares(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = table.withColumn("whole", F.floor(rate).cast("long")).withColumn(
        "draw_below", F.floor((rate - F.floor(rate)) * DRAW).cast("long"))
    a, b = draw_pair(id_key("id"), seed)
    rated = beside(rows.select("id", "source", "size", a.alias("a"), b.alias("b")),
                   table.select("source", "draw_below"), "source")
    hit = [F.sum(F.when((F.col("a") + k * F.col("b")) % DRAW < F.col("draw_below"), F.col("size")).otherwise(0))
           .alias(f"t{k}") for k in range(seeds)]
    tried = rated.groupBy("source").agg(*hit).withColumnRenamed("source", "_t")
    both = table.join(tried, F.col("source").eqNullSafe(F.col("_t")))
    miss = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"t{k}") - F.col("target")).alias("miss"),
                     F.lit(k).alias("k")) for k in range(seeds)]
    return cut(both.select("source", "source_size", "target", "whole", "draw_below",
                           F.array_min(F.array(*miss))["k"].cast("long").alias("k")))


def _copies(id_col: str, seed: str) -> Column:
    a, b = draw_pair(id_key(id_col), seed)
    return (F.col("whole") + F.when((a + F.col("k") * b) % DRAW < F.col("draw_below"), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = "mix", seeds: int = SEEDS) -> DataFrame:
    """Per document of ``docs``: id, source, size, source_size, target, copies.

    ``copies`` is floor(rate) plus the Bernoulli copy.  Null text has size 0;
    a source of size 0 has target 0 and no copies; null is a source of its
    own.  Documents with equal ids share their draw, so repeated rows are
    taken alike.  An empty table gives no rows; reruns agree."""
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                           n_words(F.col(f"`{text_col}`")).alias("size")))
    planned = beside(rows, source_plan(rows, seed, seeds), "source")
    return planned.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size",
                          "target", _copies("id", seed).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix", seeds: int = SEEDS) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, repeated
    ``copies`` times (not at all for 0)."""
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                           n_words(F.col(f"`{text_col}`")).alias("size")))
    whole, below, k, copy = (unused(docs, name) for name in ("_whole", "_draw_below", "_k", "_copy"))
    lists = source_plan(rows, seed, seeds).select("source", "whole", "draw_below", "k").toDF("source", whole, below, k)
    joined = beside(docs, lists, source_col)
    a, b = draw_pair(id_key(id_col), seed)
    copies = F.col(whole) + F.when((a + F.col(k) * b) % DRAW < F.col(below), 1).otherwise(0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
