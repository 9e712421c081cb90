"""Exact global running totals and ranks without a single-partition window.

``Window.orderBy(x)`` with no partition key moves every row into one task.
Here the order column is cut into value ranges at approximate quantiles
(a bounded list of split points), every range gets its own window, and
the per-range totals -- at most ``n_buckets`` rows -- are turned into
offsets and broadcast back.  The result is exact; only the split points are
approximate, and they only affect how evenly work is spread.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BKT = "_fl_bkt"


def _default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(64, 4 * parts)


def with_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None,
                 totals: list[str] | None = None, _out: dict | None = None) -> DataFrame:
    """Add ``_fl_bkt``: a value-range id, increasing with ``order_col``.
    ``totals`` columns are summed in the same pass (into ``_out``)."""
    n = n_buckets or _default_buckets(df)
    probs = [i / n for i in range(1, n)]
    extra = [F.sum(c).alias(f"_sum_{c}") for c in (totals or [])]
    row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000).alias("q"), *extra).first()
    if _out is not None:
        _out.update({c: row[f"_sum_{c}"] for c in (totals or [])})
    qs = sorted({float(v) for v in (row["q"] or []) if v is not None})
    splits = [float("-inf")] + qs + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(_BKT, F.lit(0.0))
    src = f"_fl_ord_{_BKT}"
    tmp = df.withColumn(src, F.col(order_col).cast("double"))
    out = Bucketizer(splits=splits, inputCol=src, outputCol=_BKT, handleInvalid="keep").transform(tmp)
    return out.drop(src)


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], *,
                   descending: bool = False, inclusive: bool = True,
                   prefix: str = "cum_", n_buckets: int | None = None,
                   tiebreak: list[str] | None = None, grand_totals: dict | None = None,
                   next_cols: list[str] | None = None) -> DataFrame:
    """Append ``{prefix}{c}`` = sum of ``c`` over all rows ordered before the
    current row (and including it when ``inclusive``) by ``order_col``
    (then ``tiebreak``).  Exact; the only globally ordered data is the
    bucket-total table of at most ``n_buckets`` rows.  A ``grand_totals``
    dict receives the column totals from the bucketing pass.  ``next_cols``
    (not-null columns, ``order_col`` unique) also adds ``next_{c}``, the value
    in the row that follows: its own range holds it, or, for the last row of
    a range, the table of ranges."""
    tiebreak = tiebreak or []
    next_cols = next_cols or []
    b = with_buckets(df, order_col, n_buckets, totals=sum_cols if grand_totals is not None else None,
                     _out=grand_totals)
    bucket_order = F.col(_BKT).desc() if descending else F.col(_BKT).asc()
    first = F.max_by if descending else F.min_by
    totals = b.groupBy(_BKT).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols],
                                 *[first(F.col(c), F.col(order_col)).alias(f"_f_{c}") for c in next_cols])
    # at most n_buckets rows: a global window here is bounded work
    w_off = Window.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _BKT, *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.lead(f"_f_{c}").over(Window.orderBy(bucket_order)).alias(f"_e_{c}") for c in next_cols]
    )
    keys: list[Column] = [F.col(order_col).desc() if descending else F.col(order_col).asc()]
    keys += [F.col(t).desc() if descending else F.col(t).asc() for t in tiebreak]
    w_in = Window.partitionBy(_BKT).orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    joined = b.join(F.broadcast(offsets), _BKT, "inner")
    cols = [F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)) for c in sum_cols]
    following = Window.partitionBy(_BKT).orderBy(*keys)
    out = joined.select(*[F.col(c) for c in df.columns],
                        *[v.alias(f"{prefix}{c}") for v, c in zip(cols, sum_cols)],
                        *[F.coalesce(F.lead(c).over(following), F.col(f"_e_{c}")).alias(f"next_{c}") for c in next_cols])
    return out


def global_rank(df: DataFrame, order_col: str, *, tiebreak: list[str] | None = None,
                out_col: str = "rank", n_buckets: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order_col`` (+ ``tiebreak``)
    order; rows must be uniquely ordered by the keys."""
    one = "_fl_one"
    r = running_totals(df.withColumn(one, F.lit(1)), order_col, [one], inclusive=False,
                       prefix="_r", n_buckets=n_buckets, tiebreak=tiebreak)
    return r.withColumnRenamed(f"_r{one}", out_col).drop(one)


SAMPLE_PER_SPLIT = 64
FANOUT = 256            # split points that one search in the plan tells apart


def value_ranges(df: DataFrame, cols: list[str], out_col: str, n_parts: int | None = None) -> DataFrame:
    """Add ``out_col``: a range number that does not decrease with the order of
    ``cols`` (any sortable types, nulls first).  The split points come from a
    bounded random sample and enter the plan as literals, so every scan of
    the result gives a row the same range.  Up to FANOUT ranges are one search
    tree; beyond that the tree finds a bundle of ranges and a broadcast table
    of one row a bundle holds the split points inside, so the number of ranges
    follows ``n_parts`` and not the length of an expression."""
    n = n_parts or _default_buckets(df)
    per_split = SAMPLE_PER_SPLIT if n <= FANOUT else SAMPLE_PER_SPLIT // 4
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    sample = df.select(row.alias("r")).orderBy(F.rand(11)).limit(n * per_split)
    # n * per_split rows of the order columns; sorted by Spark, so its order of values holds
    points = [r[0] for r in sample.distinct().orderBy("r").collect()]
    step = max(1, len(points) // n)
    splits = points[step::step]
    types = [df.schema[c].dataType for c in cols]

    def literal(point):
        return F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(point, types))])

    def search(bounds: list, lo: int, hi: int):
        """Number of bounds at or below the row, between lo and hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(row < literal(bounds[mid]), search(bounds, lo, mid)).otherwise(search(bounds, mid + 1, hi))

    if len(splits) <= FANOUT:
        return df.withColumn(out_col, search(splits, 0, len(splits)))
    size = -(-len(splits) // FANOUT)
    heads = splits[::size]                  # the first split point of every bundle
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    inner = [(k, k * size - size if k else 0, splits[(k - 1) * size:k * size] if k else []) for k in range(len(heads) + 1)]
    bundles = df.sparkSession.createDataFrame(inner, T.StructType([
        T.StructField("_fl_bundle", T.IntegerType()), T.StructField("_fl_first", T.IntegerType()),
        T.StructField("_fl_inner", T.ArrayType(schema))]))
    found = df.withColumn("_fl_bundle", search(heads, 0, len(heads))).join(F.broadcast(bundles), "_fl_bundle")
    below = F.size(F.filter("_fl_inner", lambda s: s <= row))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_fl_first") + below).alias(out_col))


def rank_by_value(df: DataFrame, group_cols: list[str], order_col: str | list[str], out_col: str = "rank",
                  n_parts: int | None = None) -> DataFrame:
    """0-based rank of ``order_col`` (one or more columns) inside each group
    for any sortable type.  Rows are cut into ranges of (group, value) at
    literal split points, each range of a group is ranked on its own, and the
    per-range counts give the offsets.  No task sorts a whole group."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    pid = "_fl_pid"
    r = value_ranges(df, [*group_cols, *order], pid, n_parts)
    counts = r.groupBy(pid, *group_cols).agg(F.count(F.lit(1)).alias("_c"))
    w_off = Window.partitionBy(*group_cols).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(pid, *group_cols, F.coalesce(F.sum("_c").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy(pid, *group_cols).orderBy(*order)
    local = r.withColumn("_loc", F.row_number().over(w) - 1)
    out = local.alias("l").join(offs.alias("o"), [F.col(f"l.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in [pid, *group_cols]])
    return out.select(*[F.col(f"l.`{c}`").alias(c) for c in df.columns],
                      (F.col("_off") + F.col("_loc")).cast("long").alias(out_col))
