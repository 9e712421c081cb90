"""Selection of the first rows of a table, or of every group, without ranking.

The k-th smallest value is found by histograms: one aggregate counts the rows
of BINS value ranges (and keeps each range's own least and greatest value), the
range that holds the k-th row is cut into BINS again, until it has few rows or
one value.  Bins only have to be monotone, so any numeric type will do.  The
threshold then is an ordinary filter; rows that tie at it are told apart by
their content, and equal rows by their number.

What a round gathers is bounded by BINS numbers (a group), whatever the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.session import broadcast_if_small, cut

BINS = 2048
EDGE_ROWS = 2048        # a range of at most so many rows is counted value by value
CHUNK = 100_000         # copies of a row that one task writes

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_INF = float("inf")


# ---------------------------------------------------------------- numbers that sort like a column

def sort_keys(df: DataFrame, name: str, longest: int = 0) -> list[Column]:
    """Numeric columns whose order, one after the other, is that of the column
    (nulls first; NaN is the greatest number).  ``longest``: bytes of the
    longest value of a string or binary column."""
    c, t = F.col(f"`{name}`"), df.schema[name].dataType
    there = F.when(c.isNull(), 0).otherwise(1)
    if isinstance(t, _INTEGRAL):
        # two halves, so that differences can't overflow
        x = c.cast("long")
        keys = [F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        x = c.cast("double") + F.lit(0.0)
        kind = F.when(F.isnan(x), 4).when(x == _INF, 3).when(x == -_INF, 1).otherwise(2)
        keys = [kind, F.when(kind == 2, x).otherwise(F.lit(0.0))]
    elif isinstance(t, T.DecimalType):
        keys = [c.cast("double")] if t.precision <= 15 else None      # beyond that a double would merge neighbours
    elif isinstance(t, T.BooleanType):
        keys = [c.cast("int")]
    elif isinstance(t, T.DateType):
        keys = [F.unix_date(c)]
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(c.cast("timestamp"))
        keys = [F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]
    elif isinstance(t, (T.StringType, T.BinaryType)):
        b = c.cast("binary")
        keys = [F.conv(F.rpad(F.hex(F.substring(b, 4 * i + 1, 4)), 8, "0"), 16, 10).cast("long")
                for i in range(-(-longest // 4))] + [F.octet_length(c)]
    else:
        keys = None
    if keys is None:
        raise TypeError(f"no selection by a column of type {t.simpleString()}: {name}")
    return [there, *[F.coalesce(k, F.lit(0)) for k in keys]]


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0 .. bins - 1, not decreasing with x; lo and hi differ, so their bins do."""
    half = F.lit(0.5)       # the difference of two finite numbers may not be finite
    share = F.when(hi - lo < _INF, (x - lo) / (hi - lo)).otherwise((x * half - lo * half) / (hi * half - lo * half))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


# ---------------------------------------------------------------- the first rows of a table

def first_rows(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """The ``n`` first rows by ``order_cols`` (ascending, nulls first); ties by
    content.  A few aggregates find the threshold, the result is a filter."""
    if n <= 0 or not df.columns:
        return df.limit(0)
    texts = [c for c in order_cols if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    longest = {}
    if texts:               # the number of keys of a column without fixed length
        row = df.agg(*[F.max(F.octet_length(f"`{c}`")).alias(f"l{i}") for i, c in enumerate(texts)]).first()
        longest = {c: int(row[f"l{i}"] or 0) for i, c in enumerate(texts)}
    keys = [k for c in order_cols for k in sort_keys(df, c, longest.get(c, 0))]
    spans = [F.struct(F.min(f"k{i}").alias("lo"), F.max(f"k{i}").alias("hi")).alias(f"s{i}") for i in range(len(keys))]
    row = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), *spans).first()
    if row["n"] <= n:
        return df
    edge, need, size = _narrow(df, keys, [row[f"s{i}"] for i in range(len(keys))], n, int(row["n"]))
    order = [F.col(f"`{c}`") for c in order_cols]
    point, need, equal = _point(edge, order, order_cols, need)
    types = [df.schema[c].dataType for c in order_cols]
    at = F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(point, types))])
    own = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    # implied by the struct comparison, and pushed down to the scan
    scan = order[0].isNull() if point[0] is None else order[0].isNull() | (order[0] <= F.lit(point[0]).cast(types[0]))
    if need == equal:
        return df.where(scan & (own <= at))
    below, tied = df.where(scan & (own < at)), df.where(own == at)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    halves = [F.shiftright(content, 32), content.bitwiseAND(F.lit(0xFFFFFFFF))]
    edge, need, _ = _narrow(tied, halves, [(-2 ** 31, 2 ** 31), (0, 2 ** 32)], need, equal)
    (h,), need, equal = _point(edge, [content], ["content"], need)
    if need == equal:
        return below.unionByName(tied.where(content <= h))
    same = tied.where(content == h).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_fl_m"))
    # rows of one content hash: equal ones, but for a collision
    before = F.sum("_fl_m").over(Window.orderBy(*[F.col(f"`{c}`") for c in df.columns]).rowsBetween(
        Window.unboundedPreceding, -1))
    take = F.least(F.col("_fl_m"), F.greatest(F.lit(need) - F.coalesce(before, F.lit(0)), F.lit(0)))
    some = copies(same.withColumn("_fl_m", take), "_fl_m", "_fl_i").drop("_fl_i")
    return below.unionByName(tied.where(content < h)).unionByName(some)


def kth_value(df: DataFrame, name: str, k: int) -> tuple:
    """The ``k``-th smallest value of a not-null numeric column, and the value
    of the row after it (None where there is no such row)."""
    keys = sort_keys(df, name)
    spans = [F.struct(F.min(f"k{i}").alias("lo"), F.max(f"k{i}").alias("hi")).alias(f"s{i}") for i in range(len(keys))]
    row = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), *spans).first()
    edge, need, _ = _narrow(df, keys, [row[f"s{i}"] for i in range(len(keys))], k, int(row["n"]))
    (value,), need, equal = _point(edge, [F.col(f"`{name}`")], [name], need)
    if need < equal:
        return value, value
    return value, df.where(F.col(f"`{name}`") > F.lit(value)).agg(F.min(f"`{name}`")).first()[0]


def _narrow(df: DataFrame, keys: list[Column], spans: list, need: int, size: int) -> tuple[DataFrame, int, int]:
    """The rows that tie with the ``need``-th by ``keys`` as far as it takes to
    have at most EDGE_ROWS (or all keys); how many of them are needed; how many
    they are.  ``spans``: (least, greatest) of every key, or bounds of them."""
    rows = df
    for key, (lo, hi) in zip(keys, spans):
        while size > EDGE_ROWS and lo != hi:
            share = _bin(F.col("x").cast("double"), F.lit(float(lo)), F.lit(float(hi)), BINS)
            bins = rows.select(key.alias("x")).groupBy(share.alias("b")).agg(
                F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()   # BINS rows
            for r in sorted(bins, key=lambda r: r["b"]):
                if need <= r["n"]:
                    break
                need -= r["n"]
            if r["n"] < size:
                rows = rows.where((key >= F.lit(r["lo"])) & (key <= F.lit(r["hi"])))
            lo, hi, size = r["lo"], r["hi"], r["n"]
    return rows, need, size


def _point(rows: DataFrame, order: list[Column], names: list[str], need: int) -> tuple[tuple, int, int]:
    """The value of the ``need``-th row, how many rows with it are needed, how
    many there are.  At most EDGE_ROWS rows, or rows of one value."""
    counted = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(order)]).groupBy(
        *[f"c{i}" for i in range(len(order))]).agg(F.count(F.lit(1)).alias("n"))
    for r in counted.orderBy(*[f"c{i}" for i in range(len(order))]).collect():
        if need <= r["n"]:
            return tuple(r)[:len(names)], need, r["n"]
        need -= r["n"]
    raise ValueError("fewer rows than asked for")


def copies(df: DataFrame, times: str, number: str) -> DataFrame:
    """Every row ``times`` times, numbered from 0.  A row with more than CHUNK
    copies is dealt out in chunks first, so many tasks write them."""
    def numbered(rows: DataFrame) -> DataFrame:
        last = F.least(F.col(times), (F.col("_fl_chunk") + 1) * CHUNK) - 1
        return rows.withColumn(number, F.explode(F.sequence(F.col("_fl_chunk") * CHUNK, last))).drop("_fl_chunk", times)

    few = df.where((F.col(times) > 0) & (F.col(times) <= CHUNK)).withColumn("_fl_chunk", F.lit(0).cast("long"))
    many = df.where(F.col(times) > CHUNK).withColumn(
        "_fl_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
    return numbered(few).unionByName(numbered(many.repartition("_fl_chunk")))


# ---------------------------------------------------------------- the first rows of every group

def on_groups(df: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    """``df`` with the columns of a table that has one row a group (null groups
    match); the table is broadcast when it is measured and small."""
    other = table.select(*[F.col(f"`{g}`").alias(f"_fl_g{i}") for i, g in enumerate(groups)],
                         *[c for c in table.columns if c not in groups])
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_fl_g{i}")) for i, g in enumerate(groups)]
    return df.join(broadcast_if_small(other), same).drop(*[f"_fl_g{i}" for i in range(len(groups))])


def unit_histogram(df: DataFrame, x: str, groups: list[str], bins: int | None = None) -> DataFrame:
    """A first histogram of a number in [0, 1) that ``group_thresholds`` can
    start from: groups, ``b``, ``size``, ``lo``, ``hi``.  Written, because group
    sizes come from it as well."""
    bins = bins or BINS
    rows = df.select(*[F.col(f"`{g}`") for g in groups], F.col(x).cast("double").alias("_fl_v"))
    return cut(rows.groupBy(*groups, F.floor(F.col("_fl_v") * bins).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("size"), F.min("_fl_v").alias("lo"), F.max("_fl_v").alias("hi")))


def _holding(hist: DataFrame, groups: list[str], order: str, size: str) -> DataFrame:
    """The line of every group's histogram that holds its ``need``-th row; the
    rows needed of it as ``need``.  At most a histogram a group."""
    before = F.sum(size).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    found = hist.withColumn("_fl_before", F.coalesce(before, F.lit(0))).where(
        F.col("_fl_before").between(0, F.col("need") - 1) & (F.col("need") <= F.col("_fl_before") + F.col(size)))
    return found.withColumn("need", F.col("need") - F.col("_fl_before")).drop("_fl_before")


def group_thresholds(df: DataFrame, x: str, groups: list[str], need: DataFrame, bins: int | None = None,
                     first: DataFrame | None = None) -> DataFrame:
    """Where the first ``need`` rows of every group end by the not-null number
    ``x``: one row a group with ``at`` (the value of the last of them), ``take``
    (rows at that value that are needed) and ``equal`` (rows there).  ``need``
    has the groups and a column ``need``; groups that need no row are left
    out, groups that need more than they have take all.  ``bins``: value ranges
    of a round (BINS); ``first``: a ``unit_histogram`` to start from."""
    bins = bins or BINS
    rows = df.select(*[F.col(f"`{g}`") for g in groups], F.col(x).cast("double").alias("_fl_v"))
    if first is None:
        first = rows.groupBy(*groups).agg(F.lit(0).alias("b"), F.count(F.lit(1)).alias("size"), F.min("_fl_v").alias("lo"),
                                          F.max("_fl_v").alias("hi"))
    wanted = on_groups(first, need.select(*groups, "need"), groups).where("need > 0")
    wanted = wanted.withColumn("need", F.least("need", F.sum("size").over(Window.partitionBy(*groups))))
    state = cut(_holding(wanted, groups, "b", "size").select(*groups, "size", "lo", "hi", "need"))
    wide = f"size > {EDGE_ROWS} AND lo < hi"
    while not state.where(wide).isEmpty():
        near = on_groups(rows, state.where(wide).select(*groups, "lo", "hi", "need"), groups).where("_fl_v BETWEEN lo AND hi")
        hist = near.groupBy(*groups, _bin(F.col("_fl_v"), F.col("lo"), F.col("hi"), bins).alias("b")).agg(
            F.count(F.lit(1)).alias("size"), F.min("_fl_v").alias("lo"), F.max("_fl_v").alias("hi"), F.first("need").alias("need"))
        found = _holding(hist, groups, "b", "size").select(*groups, "size", "lo", "hi", "need")
        state = cut(state.where(f"NOT ({wide})").unionByName(found))
    flat = state.where("lo = hi").select(*groups, F.col("lo").alias("at"), F.col("need").alias("take"), F.col("size").alias("equal"))
    edge = on_groups(rows, state.where("lo < hi").select(*groups, "lo", "hi", "need"), groups).where("_fl_v BETWEEN lo AND hi")
    # at most EDGE_ROWS values a group
    values = edge.groupBy(*groups, F.col("_fl_v").alias("at")).agg(F.count(F.lit(1)).alias("equal"), F.first("need").alias("need"))
    held = _holding(values, groups, "at", "equal")
    return cut(flat.unionByName(held.select(*groups, "at", F.col("need").alias("take"), "equal")))


def mark_first(df: DataFrame, x: str, groups: list[str], need: DataFrame, flag: str,
               bins: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """``df`` with ``flag``: whether the row is among the first ``need`` of its
    group by the not-null number ``x``, ties by content; ``need`` has every
    group of ``df`` once.  The big side is only filtered against a table of one row a group."""
    at = group_thresholds(df, x, groups, need, bins, first)
    none = F.lit(None)
    points = at.unionByName(need.where("need <= 0").select(
        *groups, none.cast("double").alias("at"), none.cast("long").alias("take"), none.cast("long").alias("equal")))
    rows = on_groups(df, points, groups)
    own = F.col(x).cast("double")
    if at.where("take < equal").isEmpty():
        return rows.withColumn(flag, F.coalesce(own <= F.col("at"), F.lit(False))).drop("at", "take", "equal")
    partly = F.coalesce((own == F.col("at")) & (F.col("take") < F.col("equal")), F.lit(False))
    clear = rows.where(~partly).withColumn(flag, F.coalesce(own <= F.col("at"), F.lit(False))).drop("at", "take", "equal")
    columns = [F.col(f"`{c}`") for c in df.columns]
    tied = rows.where(partly).select(*columns, F.xxhash64(*columns).cast("double").alias("_fl_h"))
    ends = group_thresholds(tied, "_fl_h", groups, at.where("take < equal").select(*groups, F.col("take").alias("need")), bins)
    near = on_groups(tied, ends, groups)
    sure = near.where("_fl_h <> at OR take = equal").withColumn(flag, F.col("_fl_h") <= F.col("at")).select(*columns, flag)
    same = near.where("_fl_h = at AND take < equal").groupBy(*columns, "take").agg(F.count(F.lit(1)).alias("_fl_m"))
    # rows of one group and content hash: equal ones, but for a collision
    before = F.sum("_fl_m").over(Window.partitionBy(*groups).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1))
    same = copies(same.withColumn("_fl_b", F.coalesce(before, F.lit(0))), "_fl_m", "_fl_i")
    same = same.withColumn(flag, F.col("_fl_b") + F.col("_fl_i") < F.col("take")).select(*columns, flag)
    return clear.unionByName(sure).unionByName(same)

