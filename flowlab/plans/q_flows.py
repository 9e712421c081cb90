"""Flow-table queries: labels (PR1-PR5), features (IO4, PR6-PR12, AG1-AG2),
splits and batches (SP1-SP7), append (UN1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions import labels as L
from flowlab.functions.rand import sql_uniform
from flowlab.operators import features as FT
from flowlab.operators import split as SP
from flowlab.plans.bindings import flow_key, flows
from flowlab.plans.catalog import register, rounded
from flowlab.sources.tables import table

# ------------------------------------------------------------------ labels
# Raw label strings are derived from each event row (a fixed list indexed by
# the row's ids, decorated by event type) so the label operators see the
# messy spellings of real captures: spaces, upper case, trailing dots.

KDD_RAW = ["normal"] + [n for names in L.KDD_FAMILIES.values() for n in names] + ["unknownattack"]
# Fixed test values: CIC-style raw labels (spacing kept on purpose).
CIC_RAW = ["BENIGN", " PortScan", "DDoS", "DoS Hulk", "DoS slowloris", "Heartbleed", "FTP-Patator",
           "SSH-Patator", "Web Attack - Brute Force", "Web Attack - XSS", "Infiltration", "Bot", "Something "]


def _pick(names: list[str], mult: int) -> Column:
    idx = F.pmod(F.col("event_id") * F.lit(mult) + F.col("user_id"), F.lit(len(names))) + 1
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx.cast("int"))


def _sql_pick(names: list[str], mult: int) -> str:
    lst = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"
    return f"({lst})[CAST((((event_id * {mult} + user_id) % {len(names)}) + {len(names)}) % {len(names)} + 1 AS INTEGER)]"


def kdd_raw(ev: DataFrame) -> DataFrame:
    name = _pick(KDD_RAW, 31)
    raw = (F.when(F.col("event_type") == "click", F.concat(name, F.lit(".")))
           .when(F.col("event_type") == "error", F.concat(F.lit(" "), F.upper(name), F.lit(". ")))
           .when(F.col("event_type") == "purchase", F.concat(name, F.lit("...")))
           .when(F.col("event_type") == "signup", F.upper(name))
           .otherwise(name))
    return ev.select("event_id", raw.alias("raw_label"))


KDD_RAW_SQL = f"""raw AS (SELECT event_id, CASE
   WHEN event_type = 'click' THEN {_sql_pick(KDD_RAW, 31)} || '.'
   WHEN event_type = 'error' THEN ' ' || upper({_sql_pick(KDD_RAW, 31)}) || '. '
   WHEN event_type = 'purchase' THEN {_sql_pick(KDD_RAW, 31)} || '...'
   WHEN event_type = 'signup' THEN upper({_sql_pick(KDD_RAW, 31)})
   ELSE {_sql_pick(KDD_RAW, 31)} END AS raw_label FROM events)"""

SQL_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_strip(x: str) -> str:
    return SQL_STRIP.format(x=x)


KDD_FAMILY_VALUES = ", ".join(f"('{n}', '{fam}')" for fam, names in L.KDD_FAMILIES.items() for n in names)

KDD_SQL = f"""WITH {KDD_RAW_SQL},
lk(attack_name, family) AS (VALUES {KDD_FAMILY_VALUES}),
nm AS (SELECT event_id, lower(regexp_replace({_sql_strip('raw_label')}, '\\.+$', '')) AS attack_label FROM raw),
fam AS (SELECT nm.event_id, nm.attack_label,
          CASE WHEN nm.attack_label = 'normal' THEN 'normal' ELSE 'attack' END AS label,
          CASE WHEN nm.attack_label = 'normal' THEN 'normal' ELSE coalesce(lk.family, 'other') END AS attack_category
        FROM nm LEFT JOIN lk ON nm.attack_label = lk.attack_name)"""


def _kdd_labelled(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    nm = kdd_raw(ev).select("event_id", L.kdd_attack_name(F.col("raw_label")).alias("attack_label"))
    nm = nm.withColumn("label", L.kdd_binary(F.col("attack_label")))
    return L.with_kdd_family(nm, "attack_label", "attack_category")


@register("kdd_label_family", KDD_SQL + "\nSELECT event_id, attack_label, label, attack_category FROM fam")
def q_kdd_label_family(spark, sf_dir):
    return _kdd_labelled(spark, sf_dir).select("event_id", "attack_label", "label", "attack_category")


@register("kdd_family_counts", KDD_SQL + """
SELECT label, attack_category, CAST(COUNT(*) AS BIGINT) AS n FROM fam GROUP BY label, attack_category""")
def q_kdd_family_counts(spark, sf_dir):
    return _kdd_labelled(spark, sf_dir).groupBy("label", "attack_category").agg(F.count(F.lit(1)).alias("n"))


def _cic_sql_family(x: str) -> str:
    s = f"lower({_sql_strip(x)})"
    return f"""CASE WHEN {s} = 'benign' THEN 'normal'
      WHEN contains({s}, 'portscan') THEN 'probe'
      WHEN contains({s}, 'ddos') OR starts_with({s}, 'dos ') OR contains({s}, 'heartbleed') THEN 'dos'
      WHEN contains({s}, 'patator') THEN 'brute_force'
      WHEN contains({s}, 'web attack') THEN 'web_attack'
      WHEN contains({s}, 'infiltration') THEN 'infiltration'
      WHEN contains({s}, 'bot') THEN 'botnet'
      ELSE 'other' END"""


CIC_SQL = f"""WITH raw AS (SELECT event_id, {_sql_pick(CIC_RAW, 17)} AS raw_label FROM events),
fam AS (SELECT event_id, {_sql_strip('raw_label')} AS attack_label,
          CASE WHEN lower({_sql_strip('raw_label')}) = 'benign' THEN 'normal' ELSE 'attack' END AS label,
          {_cic_sql_family('raw_label')} AS attack_category FROM raw)"""


def _cic_labelled(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    raw = ev.select("event_id", _pick(CIC_RAW, 17).alias("raw_label"))
    return raw.select("event_id", L.strip(F.col("raw_label")).alias("attack_label"),
                      L.cic_binary(F.col("raw_label")).alias("label"),
                      L.cic_family(F.col("raw_label")).alias("attack_category"))


@register("cic_label_family", CIC_SQL + "\nSELECT event_id, attack_label, label, attack_category FROM fam")
def q_cic_label_family(spark, sf_dir):
    return _cic_labelled(spark, sf_dir)


PORT_SCAN_NAMES = ", ".join(f"'{n}'" for n in L.TASK_TARGETS["port_scan"])


@register("task_labels", CIC_SQL + f"""
SELECT event_id, CAST(lower(label) = 'attack' AS INTEGER) AS y_intrusion,
       CAST(lower(attack_category) IN ('dos') AS INTEGER) AS y_dos,
       CAST(lower(attack_category) IN ({PORT_SCAN_NAMES}) AS INTEGER) AS y_port_scan FROM fam""")
def q_task_labels(spark, sf_dir):
    df = _cic_labelled(spark, sf_dir)
    L.check_task_classes(df, "label", "intrusion")
    for t in ("dos", "port_scan"):
        L.check_task_classes(df, "attack_category", t)
    return df.select("event_id", L.task_label(F.col("label"), "intrusion").alias("y_intrusion"),
                     L.task_label(F.col("attack_category"), "dos").alias("y_dos"),
                     L.task_label(F.col("attack_category"), "port_scan").alias("y_port_scan"))


# ---------------------------------------------------------------- features

LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("typed_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN COUNT(*) FILTER (WHERE {c} IS NOT NULL AND "
    f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL) = 0 THEN 'numeric' ELSE 'categorical' END AS kind "
    f"FROM lineitem" for c in LI_COLS))
def q_typed_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    as_text = li.select(*[F.col(c).cast("string").alias(c) for c in LI_COLS])  # a CSV read as strings
    return FT.infer_column_kinds(as_text)


def dirty_flows(spark, sf_dir) -> DataFrame:
    """lineitem flows with the capture defects the cleaner must handle:
    +-inf, NaN, null numerics, empty and null categories."""
    f = flows(spark, sf_dir)
    inf = F.lit(float("inf"))
    return f.select(
        "flow_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_orderkey") % 97 == 0, inf).when(F.col("l_orderkey") % 89 == 0, -inf)
        .otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_partkey") % 83 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_suppkey") % 79 == 0, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_orderkey") % 73 == 0, F.lit("")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_partkey") % 71 == 0, F.lit(None).cast("string")).otherwise(F.col("l_linestatus"))
        .alias("l_linestatus"),
        "Label")


FLOW_ID_SQL = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
               "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")

DIRTY_SQL = f"""dirty AS (SELECT {FLOW_ID_SQL} AS flow_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 89 = 0 THEN CAST('-inf' AS DOUBLE)
       ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_partkey % 83 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_discount END AS l_discount,
  CASE WHEN l_suppkey % 79 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 73 = 0 THEN '' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_partkey % 71 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_returnflag = 'R' THEN 'attack' ELSE 'normal' END AS Label
  FROM lineitem)"""


def _sql_clean_num(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN CAST(0 AS DOUBLE) ELSE {c} END"


def _sql_clean_cat(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'unknown' ELSE {c} END"


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]

CLEAN_SQL = f"""WITH {DIRTY_SQL},
clean AS (SELECT flow_id, {', '.join(f'{_sql_clean_num(c)} AS {c}' for c in NUM)},
          {', '.join(f'{_sql_clean_cat(c)} AS {c}' for c in CAT)}, Label FROM dirty)"""


@register("clean_flows", CLEAN_SQL + f"\nSELECT flow_id, {', '.join(f'round({c}, 6) AS {c}' for c in NUM)}, "
          f"{', '.join(CAT)} FROM clean")
def q_clean_flows(spark, sf_dir):
    d = dirty_flows(spark, sf_dir)
    return rounded(FT.clean(d.select(*NUM, *CAT, "flow_id"), numeric=NUM).select("flow_id", *NUM, *CAT))


def _fitted_state(spark, sf_dir) -> FT.FeatureState:
    d = dirty_flows(spark, sf_dir).select(*NUM, *CAT, "Label")
    return FT.fit(FT.clean(d, numeric=NUM), label_col="Label")


@register("fit_scaler", CLEAN_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM clean" for c in NUM))
def q_fit_scaler(spark, sf_dir):
    d = FT.clean(dirty_flows(spark, sf_dir).select(*NUM), numeric=NUM)
    return rounded(FT.scaler_stats(d, NUM))


STATS_SQL = ",\nstats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in NUM
) + " FROM clean)"


@register("apply_scaler", CLEAN_SQL + STATS_SQL + "\nSELECT flow_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in NUM) + " FROM clean CROSS JOIN stats")
def q_apply_scaler(spark, sf_dir):
    st = _fitted_state(spark, sf_dir)
    d = FT.clean(dirty_flows(spark, sf_dir).select("flow_id", *NUM, *CAT), numeric=NUM)
    return rounded(d.select("flow_id", *[FT.zscore(c, st).alias(f"z_{c}") for c in NUM]))


@register("fit_vocab", CLEAN_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS position, v AS value "
    f"FROM (SELECT DISTINCT {c} AS v FROM clean)" for c in CAT))
def q_fit_vocab(spark, sf_dir):
    d = FT.clean(dirty_flows(spark, sf_dir).select(*CAT), numeric=[])
    return FT.vocabularies(d, CAT)


VOCAB_SQL = ",\n" + ",\n".join(f"voc_{c} AS (SELECT list(DISTINCT {c} ORDER BY {c}) AS vocab FROM clean)" for c in CAT)


def _sql_place(c: str) -> str:
    """0-based place of a row's value in the vocabulary."""
    return f"CAST(list_position(voc_{c}.vocab, clean.{c}) - 1 AS INTEGER)"


VOCABS = " ".join(f"CROSS JOIN voc_{c}" for c in CAT)


def _sparse_state(spark, sf_dir) -> FT.SparseState:
    d = dirty_flows(spark, sf_dir).select(*NUM, *CAT, "Label")
    return FT.fit_sparse(FT.clean(d, numeric=NUM), label_col="Label")


@register("one_hot", CLEAN_SQL + VOCAB_SQL + "\nSELECT flow_id, " + ", ".join(
    f"CAST(len(voc_{c}.vocab) AS INTEGER) AS {c}_size, [{_sql_place(c)}] AS {c}_indices, [CAST(1 AS DOUBLE)] AS {c}_values"
    for c in CAT) + f" FROM clean {VOCABS}")
def q_one_hot(spark, sf_dir):
    d = FT.clean(dirty_flows(spark, sf_dir).select("flow_id", *NUM, *CAT), numeric=NUM)
    return FT.sparse_one_hot(d, _sparse_state(spark, sf_dir), ["flow_id"])


@register("encode_labels", CLEAN_SQL + """,
cls AS (SELECT list(DISTINCT Label ORDER BY Label) AS classes FROM clean)
SELECT flow_id, Label, CAST(list_position(classes, Label) - 1 AS INTEGER) AS label_id FROM clean CROSS JOIN cls""")
def q_encode_labels(spark, sf_dir):
    st = _fitted_state(spark, sf_dir)
    d = dirty_flows(spark, sf_dir).select("flow_id", "Label")
    return d.select("flow_id", "Label", FT.encode_label(F.col("Label"), st).alias("label_id"))


def _sql_offset(c: str) -> str:
    return " + ".join([str(len(NUM)), *[f"len(voc_{x}.vocab)" for x in CAT[:CAT.index(c)]]])


@register("feature_vectors", CLEAN_SQL + STATS_SQL + VOCAB_SQL + f""",
cls AS (SELECT list(DISTINCT Label ORDER BY Label) AS classes FROM clean)
SELECT flow_id, CAST({len(NUM)} + {" + ".join(f"len(voc_{c}.vocab)" for c in CAT)} AS INTEGER) AS size,
  [{", ".join(f"{i}::INTEGER" for i in range(len(NUM)))}, {", ".join(f"CAST({_sql_place(c)} + {_sql_offset(c)} AS INTEGER)" for c in CAT)}] AS indices,
  list_transform([{", ".join(f"({c} - m_{c}) / s_{c}" for c in NUM)}, {", ".join("CAST(1 AS DOUBLE)" for _ in CAT)}], lambda x: round(x, 6)) AS "values",
  CAST(list_position(classes, Label) - 1 AS INTEGER) AS y
FROM clean CROSS JOIN stats CROSS JOIN cls {VOCABS}""")
def q_feature_vectors(spark, sf_dir):
    st, labels = _sparse_state(spark, sf_dir), _classes(spark, sf_dir)
    d = FT.clean(dirty_flows(spark, sf_dir).select("flow_id", *NUM, *CAT, "Label"), numeric=NUM)
    x = FT.sparse_features(d, st, ["flow_id", "Label"])
    return rounded(x.select("flow_id", "size", "indices", "values", FT.encode_label(F.col("Label"), labels).alias("y")))


def _classes(spark, sf_dir) -> FT.FeatureState:
    """The label classes alone (two)."""
    found = dirty_flows(spark, sf_dir).select("Label").distinct().collect()
    return FT.FeatureState([], [], classes=sorted(r[0] for r in found))


@register("align_schema", f"""
SELECT {FLOW_ID_SQL} AS flow_id, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, CAST(0 AS DOUBLE) AS l_tax, l_returnflag, 'unknown' AS l_linestatus
FROM lineitem""")
def q_align_schema(spark, sf_dir):
    st = FT.FeatureState(NUM, CAT)
    li = table(spark, sf_dir, "lineitem")
    # an apply-time frame with two fitted columns missing and an extra one present
    inp = li.select(flow_key().alias("flow_id"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                    "l_shipdate")
    return rounded(FT.align(inp, st, keep=["flow_id"]))


@register("leak_pruning", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem")
def q_leak_pruning(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_orderkey").alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  F.col("l_returnflag").alias("Label"), F.col("l_linestatus").alias("attack_cat"), "l_shipdate")
    return FT.split_features(x, "Label")


# ------------------------------------------------------------------ splits

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
U_SQL = sql_uniform("42", *KEYS)

SPLIT_SQL = f"""WITH base AS (SELECT {FLOW_ID_SQL} AS flow_id, CAST(l_linenumber AS VARCHAR) AS file,
        l_returnflag || l_linestatus AS stratum, {U_SQL} AS u, {', '.join(KEYS)} FROM lineitem),
cnt AS (SELECT file, stratum, COUNT(*) AS n FROM base GROUP BY file, stratum),
q1 AS (SELECT *, SUM(n) OVER (PARTITION BY file) AS nf FROM cnt),
q2 AS (SELECT *, CAST(ceil(CAST('0.2' AS DOUBLE) * CAST(nf AS DOUBLE)) AS BIGINT) AS ntest FROM q1),
q3 AS (SELECT *, CAST(ntest * n AS DOUBLE) / CAST(nf AS DOUBLE) AS ex FROM q2),
q4 AS (SELECT *, CAST(floor(ex) AS BIGINT) AS fl, ex - CAST(floor(ex) AS BIGINT) AS rem FROM q3),
q5 AS (SELECT *, ntest - SUM(fl) OVER (PARTITION BY file) AS lft,
          row_number() OVER (PARTITION BY file ORDER BY rem DESC, stratum ASC) AS rr FROM q4),
quota AS (SELECT file, stratum, fl + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS quota FROM q5),
rk AS (SELECT *, row_number() OVER (PARTITION BY file, stratum ORDER BY u, {', '.join(KEYS)}) - 1 AS r FROM base),
split AS (SELECT rk.flow_id, rk.file, rk.stratum, CASE WHEN rk.r < q.quota THEN 'test' ELSE 'train' END AS split
          FROM rk JOIN quota q ON rk.file = q.file AND rk.stratum = q.stratum)"""


def _split(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        *KEYS, flow_key().alias("flow_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("stratum"),
        F.col("l_linenumber").cast("string").alias("file"))
    return SP.stratified_split(li, KEYS, "stratum", file_col="file", test_size=0.2, seed=42)


@register("stratified_split", SPLIT_SQL + "\nSELECT flow_id, file, stratum, split FROM split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("flow_id", "file", "stratum", "split")


@register("split_counts", SPLIT_SQL + """
SELECT file, stratum, split, CAST(COUNT(*) AS BIGINT) AS n FROM split GROUP BY file, stratum, split""")
def q_split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("file", "stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@register("split_disjoint", SPLIT_SQL + """
SELECT CAST((SELECT COUNT(*) FROM (SELECT flow_id FROM split WHERE split = 'train'
        INTERSECT SELECT flow_id FROM split WHERE split = 'test')) AS BIGINT) AS overlap,
       CAST(SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(SUM(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM split""")
def q_split_disjoint(spark, sf_dir):
    return SP.disjointness(_split(spark, sf_dir), KEYS)


def _batch_sql(where: str, size: int, seed: int = 42, epoch: int = 0) -> str:
    u = sql_uniform(str(seed), str(epoch), "event_id")
    return f"""WITH b AS (SELECT event_id, {u} AS u FROM events {where}),
rk AS (SELECT event_id, row_number() OVER (ORDER BY u, event_id) - 1 AS r, COUNT(*) OVER () AS n FROM b),
bt AS (SELECT event_id, CAST(floor(r / {size}) AS BIGINT) AS batch_id, CAST(r % {size} AS INTEGER) AS pos
       FROM rk WHERE r < (n // {size}) * {size})"""


def _events_batches(spark, sf_dir, size: int, where: Column | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    if where is not None:
        ev = ev.where(where)
    return SP.batches(ev.select("event_id"), ["event_id"], size, epoch=0, seed=42)


@register("batches", _batch_sql("", 64) + "\nSELECT event_id, batch_id, pos FROM bt")
def q_batches(spark, sf_dir):
    return _events_batches(spark, sf_dir, 64)


@register("capped_steps", _batch_sql("", 4) + "\nSELECT event_id, batch_id, pos FROM bt WHERE batch_id < 2000")
def q_capped_steps(spark, sf_dir):
    return SP.cap_steps(_events_batches(spark, sf_dir, 4), 2000)


@register("paired_batches", f"""
WITH l AS ({_batch_sql("WHERE event_type <> 'view'", 64)} SELECT batch_id, COUNT(*) AS n FROM bt GROUP BY batch_id),
u AS ({_batch_sql("WHERE event_type = 'view'", 128)} SELECT batch_id, COUNT(*) AS n FROM bt GROUP BY batch_id),
nu AS (SELECT COUNT(*) AS k FROM u)
SELECT l.batch_id AS l_batch_id, u.batch_id AS u_batch_id, CAST(l.n AS BIGINT) AS n_labeled,
       CAST(u.n AS BIGINT) AS n_unlabeled
FROM l CROSS JOIN nu JOIN u ON u.batch_id = l.batch_id % nu.k""")
def q_paired_batches(spark, sf_dir):
    lab = _events_batches(spark, sf_dir, 64, F.col("event_type") != "view")
    unl = _events_batches(spark, sf_dir, 128, F.col("event_type") == "view")
    return SP.pair_batches(lab, unl)


BAL_U = sql_uniform("42", "y", "event_id")


@register("balanced_batches", f"""
WITH b AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events),
r AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY {BAL_U}, event_id) - 1 AS rk FROM b),
c AS (SELECT y, COUNT(*) AS n FROM b GROUP BY y),
steps AS (SELECT least((2 * MIN(n)) // 64, 2000) AS s FROM c),
slots AS (SELECT s.i AS slot, c.y, s.i % c.n AS rk FROM steps CROSS JOIN range(steps.s * 32) s(i) CROSS JOIN c)
SELECT r.event_id, r.y, CAST(slots.slot // 32 AS BIGINT) AS batch_id, CAST(slots.slot % 32 + r.y * 32 AS INTEGER) AS pos
FROM slots JOIN r ON slots.y = r.y AND slots.rk = r.rk""")
def q_balanced_batches(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y"))
    return SP.balanced_batches(ev, ["event_id"], "y", 64)


@register("first_n", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 1000")
def q_first_n(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return SP.first_n(ev, ["event_id"], 1000)


@register("first_n_large", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth,
         COUNT(*) OVER () AS n FROM lineitem) WHERE nth <= n // 4""")
def q_first_n_large(spark, sf_dir):
    """The cap grows with the table: a quarter of all flows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return SP.first_n(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], li.count() // 4)


@register("append_frames", "SELECT * FROM orders UNION ALL BY NAME SELECT * FROM lineitem")
def q_append_frames(spark, sf_dir):
    return SP.append_frames([table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")])
