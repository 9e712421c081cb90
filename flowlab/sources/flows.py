"""Flow-capture sources (IO1-IO8): headered CSV, headerless KDD-style CSV,
CSV directories with per-file provenance, dataset dispatch, synthetic flows.

Every reader returns a DataFrame with the standard label columns
``Label`` (normal / attack), ``AttackLabel`` and ``AttackCategory``.
"""

from __future__ import annotations

import csv
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.functions import labels as L
from flowlab.functions.rand import normal, uniform
from flowlab.operators import features as FT
from flowlab.operators import split as SP
from flowlab.session import cut

# The 41 KDD Cup 99 feature columns in file order.
KDD_FEATURES = [
    ("duration", "int"), ("protocol_type", "string"), ("service", "string"), ("flag", "string"),
    ("src_bytes", "long"), ("dst_bytes", "long"), ("land", "int"), ("wrong_fragment", "int"), ("urgent", "int"),
    ("hot", "int"), ("num_failed_logins", "int"), ("logged_in", "int"), ("num_compromised", "int"),
    ("root_shell", "int"), ("su_attempted", "int"), ("num_root", "int"), ("num_file_creations", "int"),
    ("num_shells", "int"), ("num_access_files", "int"), ("num_outbound_cmds", "int"), ("is_host_login", "int"),
    ("is_guest_login", "int"), ("count", "int"), ("srv_count", "int"), ("serror_rate", "double"),
    ("srv_serror_rate", "double"), ("rerror_rate", "double"), ("srv_rerror_rate", "double"),
    ("same_srv_rate", "double"), ("diff_srv_rate", "double"), ("srv_diff_host_rate", "double"),
    ("dst_host_count", "int"), ("dst_host_srv_count", "int"), ("dst_host_same_srv_rate", "double"),
    ("dst_host_diff_srv_rate", "double"), ("dst_host_same_src_port_rate", "double"),
    ("dst_host_srv_diff_host_rate", "double"), ("dst_host_serror_rate", "double"),
    ("dst_host_srv_serror_rate", "double"), ("dst_host_rerror_rate", "double"), ("dst_host_srv_rerror_rate", "double"),
]

# Candidate KDD files per split, in lookup order.
KDD_CANDIDATES = {
    "train": ["kddcup.data_10_percent/kddcup.data_10_percent", "kddcup.data_10_percent_corrected",
              "kddcup.data_10_percent", "kddcup.data_10_percent.gz", "kddcup.data/kddcup.data", "kddcup.data",
              "kddcup.data.gz"],
    "test": ["corrected/corrected", "corrected", "corrected.gz", "kddcup.data.corrected"],
}

# Cell spellings pandas reads as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def kdd_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), True) for n, t in KDD_FEATURES]
                        + [T.StructField("AttackLabel", T.StringType(), True)])


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str, file_only: bool = True) -> bool:
    p, fs = _hadoop_fs(spark, path)
    return bool(fs.exists(p) and (fs.getFileStatus(p).isFile() or not file_only))


def validate_label_column(df: DataFrame, label_col: str | None) -> None:
    """IO7: schema-only check, the error lists the columns."""
    if label_col is not None and label_col not in df.columns:
        raise ValueError(f"label column {label_col!r} not found among {df.columns}")


def clean_header(names: list[str]) -> list[str]:
    """Trim names; duplicates get pandas' ``.1``, ``.2`` suffixes."""
    seen: dict[str, int] = {}
    out = []
    for n in (c.strip() for c in names):
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def _raw_header(spark: SparkSession, path: str) -> list[str]:
    """Cells of the first line, read through the file system (any store that
    Spark reads, compressed or not) without a Spark job per file."""
    p, fs = _hadoop_fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else None
    else:
        jvm = spark._jvm
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(fs.getConf()).getCodec(p)
        stream = codec.createInputStream(fs.open(p)) if codec else fs.open(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
    return next(iter(csv.reader([line]))) if line else []


def _headered_cells(spark: SparkSession, path: str, label_col: str | None) -> DataFrame:
    """The cells as strings: names trimmed, NA spellings -> null."""
    names = clean_header(_raw_header(spark, path))
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", True).schema(
        T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(names))])).csv(path)
    df = raw.toDF(*names)
    df = df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                     for c in names])
    validate_label_column(df, label_col)
    return df


def read_headered_csv(spark: SparkSession, path: str, label_col: str | None = None, typed: bool = True) -> DataFrame:
    """IO1: header row, names trimmed, NA spellings -> null, numeric columns
    typed by IO4 (every non-null value parses as a double)."""
    df = _headered_cells(spark, path, label_col)
    if typed:
        kinds = {r["column"]: r["kind"] for r in FT.infer_column_kinds(df).collect()}
        if label_col:
            kinds[label_col] = "categorical"
        df = FT.cast_by_kinds(df, kinds)
    return df


SHOWN = 1000            # rows that a first guess of the column kinds is made from


def store_headered_csv(spark: SparkSession, path: str, folder: str, label_col: str | None = None,
                       shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``shape`` of the rows of :func:`read_headered_csv`, as a table in
    ``folder``.  One value that is no number makes a column categorical, so
    what the first rows show stands; the columns that look numeric are tried
    whole while they are written, and only where a later value is no number
    is the file read once more.  A flag for each of these columns is stored
    with the row (``shape`` leaves columns it doesn't know) and not returned; an
    Observation would stay with the session, whose models then can't be sent to
    tasks."""
    cells = _headered_cells(spark, path, label_col)
    kinds = {r["column"]: r["kind"] for r in FT.infer_column_kinds(cells.limit(SHOWN)).collect()}
    numeric = [c for c in cells.columns if c != label_col and kinds[c] == "numeric"]
    while True:
        number, flag = ({c: f"_fl_{k}{i}" for i, c in enumerate(numeric)} for k in "nb")
        tried = cells.select("*", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(n) for c, n in number.items()])
        df = tried.select(*[F.col(number[c] if c in number else f"`{c}`").alias(c) for c in cells.columns],
                          *[(F.col(f"`{c}`").isNotNull() & F.col(n).isNull()).alias(flag[c]) for c, n in number.items()])
        (shape(df) if shape else df).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        stored = spark.read.parquet(folder)
        bad = stored.agg(*[F.max(f).alias(f) for f in flag.values()]).first().asDict() if numeric else {}
        if not any(bad.values()):
            return stored.drop(*flag.values())
        numeric = [c for c in numeric if not bad[flag[c]]]


def resolve_kdd_path(spark: SparkSession, base: str, split: str) -> str:
    """IO3: a given file is used as is; else the first existing candidate."""
    if path_exists(spark, base):
        return base
    cands = [f"{base.rstrip('/')}/{c}" for c in KDD_CANDIDATES[split]]
    for c in cands:
        # a file, or a folder of part files that a Spark job finished writing
        if path_exists(spark, c) or path_exists(spark, f"{c}/_SUCCESS"):
            return c
    expected = "\n  - ".join(cands)
    raise FileNotFoundError(f"no KDD Cup 99 {split} capture; looked at:\n  - {expected}")


def read_kdd(spark: SparkSession, path: str, null_label: str = "reject") -> DataFrame:
    """IO2 + PR1-PR3: headerless 41 features + label (``.gz`` read
    transparently by extension); standard label columns added.  Rows
    without a label are rejected by default (``null_label='attack'`` keeps
    the single-machine behaviour)."""
    df = spark.read.schema(kdd_schema()).option("header", False).csv(path)
    df = L.handle_null_labels(df, "AttackLabel", null_label)
    name = L.kdd_attack_name(F.col("AttackLabel"))
    df = df.withColumn("AttackLabel", name).withColumn("Label", L.kdd_binary(F.col("AttackLabel")))
    return L.with_kdd_family(df, "AttackLabel", "AttackCategory")


def find_csv_files(spark: SparkSession, base: str) -> list[str]:
    """IO5: a single .csv file, else every *.csv below ``base`` (sorted)."""
    p, fs = _hadoop_fs(spark, base)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such capture folder or file: {base}")
    st = fs.getFileStatus(p)
    if st.isFile():
        return [str(st.getPath().toUri().getPath())] if base.lower().endswith(".csv") else []
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        f = it.next()
        name = str(f.getPath().toUri().getPath())
        if f.isFile() and name.lower().endswith(".csv"):
            out.append(name)
    if not out:
        raise FileNotFoundError(f"the capture folder holds no .csv file: {base}")
    return sorted(out)


def read_cic(spark: SparkSession, base: str, split: str | None = None, test_size: float = 0.2,
             seed: int = 42, key_cols: list[str] | None = None, null_label: str = "reject") -> DataFrame:
    """IO5 + PR2/PR4 + SP1: every CSV (grouped by identical headers, one
    reader per group, appended by name), per-file provenance, standard
    labels, per-file stratified split on AttackLabel."""
    if split not in (None, "train", "test"):
        raise ValueError("split is one of 'train', 'test'")
    df = _cic_rows(spark, base, null_label)
    return df if split is None else _cic_split(df, test_size, seed, key_cols)[split]


def _cic_rows(spark: SparkSession, base: str, null_label: str = "reject") -> DataFrame:
    files = find_csv_files(spark, base)
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        groups.setdefault(tuple(clean_header(_raw_header(spark, f))), []).append(f)
    frames = []
    for header, paths in groups.items():
        if "Label" not in header:
            raise ValueError(f"capture without a Label column: {paths[0]}")
        frames.append(_read_group(spark, paths, list(header)))
    df = L.handle_null_labels(SP.append_frames(frames), "Label", null_label)
    kinds = {r["column"]: r["kind"] for r in FT.infer_column_kinds(df.drop("Label", "source_file")).collect()}
    df = FT.cast_by_kinds(df, kinds)
    raw = F.col("Label")
    df = df.withColumn("AttackLabel", L.strip(raw)).withColumn("AttackCategory", L.cic_family(raw)) \
        .withColumn("Label", L.cic_binary(raw))
    return df


def _cic_split(df: DataFrame, test_size: float, seed: int, key_cols: list[str] | None = None) -> dict[str, DataFrame]:
    """Train and test rows from one split.  The captures are read and the keys
    hashed once, into a checkpoint; what the split adds to it is a comparison."""
    keys = key_cols or ["_row_key"]
    if not key_cols:
        # content key: identical rows are interchangeable for the split
        df = df.withColumn("_row_key", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256))
    s = SP.stratified_split(cut(df), keys, "AttackLabel", file_col="source_file", test_size=test_size, seed=seed)
    s = s if key_cols else s.drop("_row_key")
    return {name: s.where(F.col("split") == name).drop("split") for name in ("train", "test")}


def _read_group(spark: SparkSession, paths: list[str], header: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).schema(
        T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(header))])).csv(paths)
    df = raw.select(*[F.col(f"_c{i}").alias(h) for i, h in enumerate(header)],
                    F.col("_metadata.file_path").alias("source_file"))
    return df.select(*[F.when(F.col(f"`{c}`").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                       for c in header], "source_file")


def normalise_dataset_name(name: str) -> str:
    return re.sub(r"[-_]", "", name.strip().lower())


def load_dataset(spark: SparkSession, dataset: str, split: str, base: str, label_col: str = "Label",
                 test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """IO6: name dispatch (aliases kddcup99/kdd99, cicids2017/cic2017)."""
    key = normalise_dataset_name(dataset)
    if split not in {"train", "test"}:
        raise ValueError("split is one of 'train', 'test'")
    if key in {"kddcup99", "kdd99"}:
        df = read_kdd(spark, resolve_kdd_path(spark, base, split))
    elif key in {"cicids2017", "cic2017"}:
        df = read_cic(spark, base, split, test_size, seed)
    else:
        raise ValueError(f"unknown dataset {dataset!r}; known are cicids2017 and kddcup99")
    validate_label_column(df, label_col)
    return df


def load_pair(spark: SparkSession, dataset: str, base: str, label_col: str = "Label", test_size: float = 0.2,
              seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """IO6: the (train, test) rows of a named dataset; captures that are split
    here are read and split once for both."""
    if normalise_dataset_name(dataset) not in {"cicids2017", "cic2017"}:
        return tuple(load_dataset(spark, dataset, split, base, label_col, test_size, seed) for split in ("train", "test"))
    found = _cic_split(_cic_rows(spark, base), test_size, seed)
    for df in found.values():
        validate_label_column(df, label_col)
    return found["train"], found["test"]


# Synthetic class mix.
SYNTHETIC_CLASSES = [("Benign", 0.70), ("DoS", 0.15), ("PortScan", 0.10), ("Exfiltration", 0.05)]


def synthetic_flows(spark: SparkSession, n: int = 10000, n_features: int = 78, seed: int = 42,
                    partitions: int | None = None) -> DataFrame:
    """IO8: N(0,1) features ``Feature_i`` and labels in the fixed mix; every
    value is a function of (seed, row id), so any layout gives the same rows."""
    ids = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(n)
    u = uniform(F.lit(seed), F.col("id"), F.lit("label"))
    lab, acc = None, 0.0
    for name, p in SYNTHETIC_CLASSES:
        acc += p
        cond = u < F.lit(acc) if not math.isclose(acc, 1.0) else F.lit(True)
        lab = F.when(cond, F.lit(name)) if lab is None else lab.when(cond, F.lit(name))
    feats = [normal(F.lit(seed), F.col("id"), F.lit(i)).cast("float").alias(f"Feature_{i}") for i in range(n_features)]
    return ids.select("id", *feats, lab.alias("Label"))
