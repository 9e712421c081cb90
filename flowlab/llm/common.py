"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"                 # the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
CONTINUATION = bytes(range(0x80, 0xC0))    # UTF-8 bytes that start no code point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    """The vocabulary of the packing queries: byte-level BPE of 50,257 ids."""
    import public_tokenizers as P
    return {"vocab": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def piece_files() -> dict[str, str]:
    """The second vocabulary of the alignment query: pieces with byte fallback, 32,000 ids."""
    import public_tokenizers as P
    return {"pieces": P.path("piece_bpe_32k.model")}


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


BATCH_ROWS = 1000        # whole texts that a Python worker holds at once


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside, so
    the memory of texts in flight stays small on both sides; the session's own
    setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_texts(df: DataFrame) -> DataFrame:
    """``cut`` for a frame that sends whole texts, or sets of that size, through Python."""
    with small_batches(df.sparkSession):
        return cut(df)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts (bytes = characters) take the
    byte-wise ``lower``; others go through ``translate``, which leaves
    letters such as É alone."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, UPPER.lower())))


def n_words(c: Column) -> Column:
    """Number of white-space separated words (long); null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of every row of an Arrow string column (null: None)."""
    return column.cast(pa.large_binary()).to_pylist() if len(column) else []


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row boundaries) of an Arrow string column without copying;
    null rows are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


BROADCAST_ROWS = 200_000
HOT_SHARE = 1000          # a key with at least 1/HOT_SHARE of all rows is hot: there are at most that many


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``values`` of ``table`` (one row a key, not
    null; ``weight`` rows of ``rows`` have it, of ``total``).  Hot keys, at
    most HOT_SHARE, come from a broadcast; in the shuffle join of the others
    their rows are spread by a hash of their own, so no task gets them all."""
    hot = F.broadcast(table.where(F.col(weight) * HOT_SHARE >= total).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot")))
    both = rows.join(hot, [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    own = F.xxhash64(*[F.col(c) for c in rows.columns])
    both = both.withColumn("_spread", F.when(F.col("_hot"), own).otherwise(F.lit(0)))
    cold = table.where(F.col(weight) * HOT_SHARE < total).select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys], *[F.col(v).alias(f"_cold_{v}") for v in values],
        F.lit(0).cast("long").alias("_cold_spread"))
    # a hot row's spread is its own hash and meets no row; the others have 0
    found = both.join(cold, [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_spread") == F.col("_cold_spread")], "left")
    return found.select(*[F.col(c) for c in rows.columns],
                        *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])


def stay(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that ``found`` (id, kept; one row per row of
    ``docs``) keeps.  Where ids are unique the dropped ids are taken out, from
    a broadcast list when that is counted and small, else by a shuffle; where
    ids repeat, one row stays for every kept id."""
    name = unused(docs, "_id")
    found = cut(found.select(F.col(id_col).alias(name), "kept"))
    own = F.col(f"`{id_col}`").eqNullSafe(F.col(name))
    if found.groupBy(name).count().where("count > 1").isEmpty():
        gone = found.where(~F.col("kept")).select(name)
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return docs.join(gone, own, "left_anti")
    return docs.join(found.where("kept").select(name).distinct(), own, "left_semi").dropDuplicates([id_col])
