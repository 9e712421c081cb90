"""Exact de-duplication by skew-safe combining (DataFrame operators only).

Texts are equal when they are identical after lower-casing A-Z.  Three
levels, each grouping on the digest *and* the full normalised text:

1. local: Spark's map-side aggregation keeps one row per text and task;
2. salted: the local winners of a digest are spread over ``salts`` groups;
3. global: at most ``salts`` winners per text meet on their digest.

So a text that fills a third of the table never reaches one task as more
than ``salts`` rows.  Rows then look their class up by digest, those of hot
texts (a thousandth of all rows or more) in a broadcast of at most a thousand
classes; a digest that holds several different texts (only a weak digest
does) is resolved by the full text, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import ascii_lower, cut, look_up, stay, unused


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def classes(docs: DataFrame, id_col: str, text_col: str, salts: int,
            digest: Callable[[Column], Column]) -> DataFrame:
    """One row per digest: ``digest``, ``n_texts`` and ``members``, an array of
    (text, keep_id, group_size); the text is left out where the digest has
    one text only."""
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), norm.alias("text")).select(
        "id", "text", digest(F.col("text")).alias("digest"))
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    final = (salted.repartition("digest").groupBy("digest", "text")
             .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")))
    per_digest = final.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"),
                                             F.collect_list(F.struct("text", "keep_id", "group_size")).alias("m"))
    lone = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col("m")[0]["keep_id"].alias("keep_id"),
                            F.col("m")[0]["group_size"].alias("group_size")))
    return per_digest.select("digest", "n_texts", F.when(F.col("n_texts") == 1, lone).otherwise(F.col("m")).alias("members"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Return ``id_col``, keep_id, group_size, kept, text_digest per row of ``docs``.

    The row with the largest id of its class stays; null ids lose to any
    other, null text counts as empty.  Of repeated rows (same id and text)
    one stays.  Extra columns are ignored; an empty table gives no rows.
    """
    found = cut(classes(docs, id_col, text_col, salts, digest))
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), norm.alias("text")).select(
        "id", "text", digest(F.col("text")).alias("digest"))
    nth = Window.partitionBy("digest", "id").orderBy("id")
    member = F.col("members")[0]
    if found.where("n_texts > 1").isEmpty():
        ranked = rows.select("id", "digest", F.row_number().over(nth).alias("nth"))
        lone = found.select("digest", member["keep_id"].alias("keep_id"), member["group_size"].alias("group_size"))
        total = lone.agg(F.sum("group_size")).first()[0] or 0
        joined = look_up(ranked, lone, ["digest"], ["keep_id", "group_size"], "group_size", total)
    else:
        # several texts under one digest: the text decides
        by_text = found.select("digest", F.explode("members").alias("m")).select(
            "digest", F.col("m.text").alias("t"), F.col("m.keep_id").alias("keep_id"),
            F.col("m.group_size").alias("group_size"))
        both = rows.alias("r").join(by_text.alias("c"), (F.col("r.digest") == F.col("c.digest"))
                                    & (F.col("c.t").isNull() | (F.col("c.t") == F.col("r.text"))))
        nth = Window.partitionBy("digest", "id", "text").orderBy("id")
        joined = both.select("r.id", "r.digest", "r.text", "keep_id", "group_size").withColumn(
            "nth", F.row_number().over(nth))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                         F.col("digest").alias("text_digest"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one a class."""
    found = cut(exact_dedup(docs, id_col, text_col, salts))
    repeated = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return stay(docs, found, id_col)
    # rows share an id: match them by id and text, and keep one of equal rows
    own_digest, key_id, key_digest = (unused(docs, name) for name in ("_digest", "_id", "_d"))
    keep = found.where("kept").select(F.col(id_col).alias(key_id), F.col("text_digest").alias(key_digest))
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key_id)) & (F.col(own_digest) == F.col(key_digest))
    held = docs.withColumn(own_digest, sha256(norm)).join(keep, same, "left_semi")
    return held.dropDuplicates([id_col, own_digest]).drop(own_digest)
