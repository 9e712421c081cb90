"""Flow feature preparation (IO4, PR6-PR12, AG1-AG2, IO9).

fit: one aggregate for the scaler statistics of every numeric column, one
``groupBy(column, value)`` for the category vocabularies; the fitted state is
a small table ``feature_state(col, kind, position, mean, std, vocab)`` that is
written as parquet and applied as column expressions (no Python per row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.prefix import rank_by_value
from flowlab.session import broadcast_if_small, cut

# Label / leakage columns never used as features.
KNOWN_LABEL_COLUMNS = ["Label", "label", "attack_cat", "AttackLabel", "AttackCategory"]
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


# ------------------------------------------------------------------ typing

def infer_column_kinds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """IO4: for string-typed input, a column is numeric iff every non-null
    value parses as a double.  One aggregate over all columns, then unpivot
    to ``(column, kind)``."""
    cols = columns or df.columns
    aggs = [F.sum(F.when(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull(), 1)
                  .otherwise(0)).alias(f"b{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bad")) for i, c in enumerate(cols)])
    return row.select(F.explode(pairs).alias("kv")).select(
        F.col("kv.column").alias("column"),
        F.when(F.coalesce(F.col("kv.bad"), F.lit(0)) == 0, "numeric").otherwise("categorical").alias("kind"))


def cast_by_kinds(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Apply IO4's decision: numeric columns become double."""
    return df.select(*[(F.expr(f"try_cast(`{c}` AS DOUBLE)") if kinds.get(c) == "numeric" else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


# ------------------------------------------------------------- projection

def split_features(df: DataFrame, label_col: str | None = "Label", drop_cols: list[str] | None = None) -> DataFrame:
    """PR6: drop ids, the target and every known label column (names are
    matched case-sensitively: ``Label`` and ``label`` are different)."""
    drop = set(drop_cols if drop_cols is not None else ["id"])
    if label_col:
        drop.add(label_col)
    drop.update(KNOWN_LABEL_COLUMNS)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop])


def clean_text(df: DataFrame, name: str) -> Column:
    """PR7 of a categorical column: null or empty -> 'unknown'; booleans keep
    Python's spelling."""
    c = F.col(f"`{name}`")
    s = F.initcap(c.cast("string")) if isinstance(df.schema[name].dataType, T.BooleanType) else c.cast("string")
    return F.when(s.isNull() | (s == ""), F.lit("unknown")).otherwise(s)


def clean(df: DataFrame, numeric: list[str] | None = None, as_is: list[str] | None = None) -> DataFrame:
    """PR7: +-inf and NaN -> null -> 0 for numeric columns; null or empty
    categorical values -> 'unknown'.  Booleans keep Python's spelling, the
    columns ``as_is`` everything."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in (as_is or []):
            out.append(c)
        elif (numeric is not None and f.name in numeric) or (numeric is None and is_numeric(f.dataType)):
            d = c.cast("double")
            bad = F.isnan(d) | (d == F.lit(float("inf"))) | (d == F.lit(float("-inf")))
            out.append(F.when(bad | d.isNull(), F.lit(0.0)).otherwise(d).alias(f.name)
                       if not isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
                       else F.coalesce(c, F.lit(0)).alias(f.name))
        else:
            out.append(clean_text(df, f.name).alias(f.name))
    return df.select(*out)


# ------------------------------------------------------------------ state

@dataclass
class FeatureState:
    """Fitted feature state: numeric block then one-hot blocks."""
    numeric: list[str]
    categorical: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    vocab: dict[str, list[str]] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    @property
    def dim(self) -> int:
        return len(self.numeric) + sum(len(self.vocab.get(c, [])) for c in self.categorical)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "numeric", i, self.mean[c], self.std[c], None) for i, c in enumerate(self.numeric)]
        rows += [(c, "categorical", len(self.numeric) + i, None, None, self.vocab.get(c, []))
                 for i, c in enumerate(self.categorical)]
        rows += [("__label__", "label", -1, None, None, self.classes)]
        return spark.createDataFrame(rows, "col string, kind string, position int, mean double, std double, "
                                           "vocab array<string>")

    @staticmethod
    def from_df(df: DataFrame) -> "FeatureState":
        rows = sorted(df.collect(), key=lambda r: r["position"])
        st = FeatureState([], [])
        for r in rows:
            if r["kind"] == "numeric":
                st.numeric.append(r["col"])
                st.mean[r["col"]], st.std[r["col"]] = r["mean"], r["std"]
            elif r["kind"] == "categorical":
                st.categorical.append(r["col"])
                st.vocab[r["col"]] = list(r["vocab"] or [])
            else:
                st.classes = list(r["vocab"] or [])
        return st

    def save(self, spark: SparkSession, path: str) -> None:
        """IO9: persist as parquet."""
        self.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureState":
        return FeatureState.from_df(spark.read.parquet(path))


def scaler_stats(df: DataFrame, numeric: list[str]) -> DataFrame:
    """AG1: mean and population std of every numeric column in one
    aggregate; a zero std is replaced by 1.  Rows ``(column, mean, std)``."""
    aggs = []
    for i, c in enumerate(numeric):
        aggs += [F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}")]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                      for i, c in enumerate(numeric)])
    return row.select(F.explode(pairs).alias("kv")).select(
        F.col("kv.column").alias("column"), F.col("kv.mean").alias("mean"),
        F.when(F.col("kv.std") == 0, F.lit(1.0)).otherwise(F.col("kv.std")).alias("std"))


def vocabularies(df: DataFrame, categorical: list[str]) -> DataFrame:
    """AG2: sorted distinct values per categorical column as rows
    ``(column, position, value)``.  A ``groupBy(column, value)`` (not one
    collected set) so high-cardinality columns stay distributed."""
    if not categorical:
        return df.sparkSession.createDataFrame([], "column string, position int, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in categorical])
    kv = df.select(F.explode(pairs).alias("kv")).select("kv.column", "kv.value")
    d = kv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select("column", "value")
    r = rank_by_value(cut(d), ["column"], "value", "position")     # the rows are read once
    return r.select("column", F.col("position").cast("int").alias("position"), "value")


def fit(df: DataFrame, label_col: str | None = "Label", drop_cols: list[str] | None = None) -> FeatureState:
    """Fit on a cleaned frame: column kinds from the schema, scaler stats,
    vocabularies and sorted label classes."""
    x = split_features(df, label_col, drop_cols)
    numeric = [f.name for f in x.schema.fields if is_numeric(f.dataType)]
    categorical = [c for c in x.columns if c not in numeric]
    st = FeatureState(numeric, categorical)
    for r in scaler_stats(x, numeric).collect() if numeric else []:
        st.mean[r["column"]], st.std[r["column"]] = r["mean"], r["std"]
    voc: dict[str, list[tuple[int, str]]] = {c: [] for c in categorical}
    for r in vocabularies(x, categorical).collect():
        voc[r["column"]].append((r["position"], r["value"]))
    st.vocab = {c: [v for _, v in sorted(vs)] for c, vs in voc.items()}
    if label_col and label_col in df.columns:
        st.classes = sorted(r[0] for r in df.select(F.col(label_col).cast("string")).distinct().collect() if r[0] is not None)
    return st


# ----------------------------------------------------------------- sparse

SALTS = 16              # parts of the rows that share a value, where a vocabulary has to be joined by a shuffle


@dataclass
class SparseState:
    """Fitted state whose vocabularies stay tables: ``vocab`` (column,
    position, value); only one number a column reaches the driver."""
    numeric: list[str]
    categorical: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    sizes: dict[str, int]
    vocab: DataFrame

    @property
    def dim(self) -> int:
        return len(self.numeric) + sum(self.sizes[c] for c in self.categorical)

    def offset(self, column: str) -> int:
        """Place of a column's first value in the feature vector."""
        before = self.categorical[:self.categorical.index(column)]
        return len(self.numeric) + sum(self.sizes[c] for c in before)

    def save(self, path: str) -> None:
        """IO9: two tables; the vocabulary is written by the executors."""
        rows = [("numeric", i, c, self.mean[c], self.std[c], None) for i, c in enumerate(self.numeric)]
        rows += [("categorical", i, c, None, None, self.sizes[c]) for i, c in enumerate(self.categorical)]
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.vocab.sparkSession.createDataFrame(
            rows, "kind string, ord int, column string, mean double, std double, size long").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SparseState":
        rows = sorted(spark.read.parquet(f"{path}/columns").collect(), key=lambda r: r["ord"])      # one row a column
        numeric, categorical = ([r for r in rows if r["kind"] == k] for k in ("numeric", "categorical"))
        return SparseState([r["column"] for r in numeric], [r["column"] for r in categorical],
                           {r["column"]: r["mean"] for r in numeric}, {r["column"]: r["std"] for r in numeric},
                           {r["column"]: r["size"] for r in categorical}, spark.read.parquet(f"{path}/vocab"))


def fit_sparse(df: DataFrame, label_col: str | None = "Label", drop_cols: list[str] | None = None) -> SparseState:
    """``fit`` for columns of any cardinality, on a cleaned frame."""
    x = split_features(df, label_col, drop_cols)
    numeric = [f.name for f in x.schema.fields if is_numeric(f.dataType)]
    categorical = [c for c in x.columns if c not in numeric]
    stats = scaler_stats(x, numeric).collect() if numeric else []
    vocab = cut(vocabularies(x, categorical))
    sizes = {r["column"]: r["n"] for r in vocab.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SparseState(numeric, categorical, {r["column"]: r["mean"] for r in stats}, {r["column"]: r["std"] for r in stats},
                       {c: sizes.get(c, 0) for c in categorical}, vocab)


def positions(df: DataFrame, st: SparseState) -> DataFrame:
    """``df`` with ``_pos_<column>``: the value's place in its vocabulary, null
    where it is unseen.  A vocabulary that is measured and small is broadcast;
    a larger one is joined by (value, salt), so a value that fills a third of
    the rows is spread over SALTS tasks."""
    out = df
    for c in st.categorical:
        table = st.vocab.where(F.col("column") == c).select(F.col("value").alias("_voc"), F.col("position").alias(f"_pos_{c}"))
        small = broadcast_if_small(table, known_rows=st.sizes[c]) if st.sizes[c] < SMALL_VOCABULARY else broadcast_if_small(table)
        value = F.col(f"`{c}`").cast("string")
        if small is not table:
            out = out.join(small, value == F.col("_voc"), "left").drop("_voc")
            continue
        rows = out.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(SALTS)))
        salted = table.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = rows.join(salted, (value == F.col("_voc")) & (F.col("_salt") == F.col("_s")), "left").drop("_voc", "_s", "_salt")
    return out


SMALL_VOCABULARY = 1000     # values whose bytes needn't be measured


def sparse_one_hot(df: DataFrame, st: SparseState, keep: list[str]) -> DataFrame:
    """PR10: per categorical column ``<column>_size``, ``_indices`` and
    ``_values``; an unseen value has no entry."""
    cols = [F.col(f"`{k}`") for k in keep]
    for c in st.categorical:
        at = F.col(f"_pos_{c}")
        cols += [F.lit(st.sizes[c]).cast("int").alias(f"{c}_size"),
                 F.when(at.isNotNull(), F.array(at)).otherwise(F.array().cast("array<int>")).alias(f"{c}_indices"),
                 F.when(at.isNotNull(), F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias(f"{c}_values")]
    return positions(df, st).select(*cols)


def sparse_features(df: DataFrame, st: SparseState, keep: list[str]) -> DataFrame:
    """PR11: ``size``, ``indices`` and ``values`` of the feature vector: the
    scaled numbers, then one entry for every categorical value that is known."""
    found = F.filter(F.array(*[F.col(f"_pos_{c}") + F.lit(st.offset(c)) for c in st.categorical]).cast("array<int>"),
                     lambda i: i.isNotNull())
    scaled = F.array(*[(F.col(f"`{c}`").cast("double") - F.lit(st.mean[c])) / F.lit(st.std[c]) for c in st.numeric]).cast(
        "array<double>")
    places = F.array(*[F.lit(i) for i in range(len(st.numeric))]).cast("array<int>")
    return positions(df, st).select(
        *[F.col(f"`{k}`") for k in keep], F.lit(st.dim).cast("int").alias("size"), F.concat(places, found).alias("indices"),
        F.concat(scaled, F.transform(found, lambda _: F.lit(1.0))).alias("values"))


# ------------------------------------------------------------------ apply

def align(df: DataFrame, st: FeatureState, keep: list[str] | None = None) -> DataFrame:
    """PR8: fitted columns in fitted order; missing numeric -> 0, missing
    categorical -> 'unknown'; extra columns dropped (``keep`` passes ids)."""
    have = set(df.columns)
    cols = [F.col(f"`{k}`") for k in (keep or [])]
    for c in st.numeric:
        cols.append((F.col(f"`{c}`") if c in have else F.lit(0.0)).alias(c))
    for c in st.categorical:
        cols.append((F.col(f"`{c}`").cast("string") if c in have else F.lit("unknown")).alias(c))
    return df.select(*cols)


def zscore(c: str, st: FeatureState) -> Column:
    """PR9: (x - mean) / std with the fitted state (std 0 already 1)."""
    return (F.col(f"`{c}`").cast("double") - F.lit(st.mean[c])) / F.lit(st.std[c])


def one_hot(c: str, st: FeatureState) -> Column:
    """PR10: sorted-vocabulary one-hot; an unseen value gives all zeros."""
    voc = st.vocab.get(c, [])
    if not voc:
        return F.array().cast("array<double>")
    v = F.col(f"`{c}`").cast("string")
    return F.transform(F.array(*[F.lit(x) for x in voc]), lambda t: F.when(t == v, 1.0).otherwise(0.0))


def assemble(st: FeatureState) -> Column:
    """PR11: numeric block then one-hot blocks as array<double>."""
    parts = [F.array(*[zscore(c, st) for c in st.numeric])] if st.numeric else []
    parts += [one_hot(c, st) for c in st.categorical]
    if not parts:
        return F.array().cast("array<double>")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def encode_label(label: Column, st: FeatureState) -> Column:
    """PR12: index in the sorted classes; an unseen label is an error."""
    classes = F.array(*[F.lit(c) for c in st.classes])
    pos = F.array_position(classes, label.cast("string"))
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unseen label: "), label.cast("string"))).cast("int"))


def transform(df: DataFrame, st: FeatureState, label_col: str | None = "Label",
              keep: list[str] | None = None, as_is: list[str] | None = None) -> DataFrame:
    """Clean -> align -> (features array, optional encoded label).  ``keep``:
    columns that stay, cleaned; ``as_is``: untouched."""
    has_label = bool(label_col) and label_col in df.columns
    cleaned = clean(df, numeric=[c for c in st.numeric if c in df.columns], as_is=as_is)
    stay = [*(keep or []), *(as_is or [])]
    aligned = align(cleaned, st, keep=stay + ([label_col] if has_label else []))
    cols = [F.col(f"`{k}`") for k in stay] + [assemble(st).alias("features")]
    if has_label:
        cols.append(encode_label(F.col(f"`{label_col}`"), st).alias("y"))
    return aligned.select(*cols)
