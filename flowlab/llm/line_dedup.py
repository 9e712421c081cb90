"""Line de-duplication by overlapping windows of three lines (DataFrame
operators only).

Lines are hashed (128 bits, white space at their ends ignored, lines of
nothing else passed over) and every three consecutive ones form a window.  A window found
more than once in the whole table keeps its first occurrence, in the order of
(id, text, line); the lines that later occurrences cover are merged and
removed.  A removed line equals an earlier line of the table, and so a kept
one: nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import SPACES, cut, look_up

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (hash of the text), w1, w2 (window hash) and lines (the line
    numbers that it covers)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda l, i: F.struct(i.alias("i"), F.trim(l, F.lit(SPACES)).alias("l")))
    hashed = F.transform(F.filter(lines, lambda x: x["l"] != ""), lambda x: F.struct(
        x["i"].alias("i"), F.xxhash64(x["l"]).alias("a"), F.xxhash64(x["l"], F.lit(1)).alias("b")))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), hashed.alias("h"))
    rows = rows.where(F.size("h") >= WINDOW)
    shifted = [F.slice("h", k + 1, F.size("h")).alias(f"s{k}") for k in range(WINDOW)]
    three = rows.select("id", "mark", F.explode(F.arrays_zip(*shifted)).alias("w")).where(
        F.col(f"w.s{WINDOW - 1}").isNotNull())
    part = [F.col(f"w.s{k}") for k in range(WINDOW)]
    return three.select("id", "mark", F.xxhash64(*[p["a"] for p in part]).alias("w1"),
                        F.xxhash64(*[p["b"] for p in part]).alias("w2"), F.array(*[p["i"] for p in part]).alias("lines"))


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark and ``removed``: the numbers (from 0) of the lines that later
    occurrences cover, for the rows that have any."""
    w = windows(docs, id_col, text_col)
    place = F.struct("id", "mark", F.col("lines")[0].alias("at"))
    counted = w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    repeated = cut(counted.where("n > 1"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    # only a window of a hot line is hot among the repeated ones
    found = look_up(w, repeated, ["w1", "w2"], ["first"], "n", total)
    later = found.where(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    return later.select("id", "mark", F.explode("lines").alias("line")).groupBy("id", "mark").agg(
        F.array_sort(F.collect_set("line")).alias("removed"))        # at most the lines of one text


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, text (without the removed lines), n_lines, n_removed per row.

    Null text counts as empty: one line, nothing removed.  Texts of fewer than
    three lines with content have no window and stay.  Equal texts keep the
    one with the smallest id (null first); repeated rows (same id and text)
    are one occurrence and lose the same lines.  Extra columns are ignored."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    gone = covered(docs, id_col, text_col).toDF("gid", "gmark", "removed")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("mark") == F.col("gmark")), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda l, i: ~F.array_contains(F.col("removed"), i)), "\n")
    return both.select(F.col("id").alias(id_col),
                       F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
                       F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
