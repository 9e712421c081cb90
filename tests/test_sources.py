from __future__ import annotations

import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowlab.sources import flows as S


def _tmp():
    return tempfile.mkdtemp(prefix="flowlab-src-", dir="/tmp")


KDD_ROW = "0,tcp,http,SF,181,5450," + ",".join(["0"] * 16) + ",8,8," + ",".join(["0.00"] * 7) + ",9,9," \
          + ",".join(["1.00"] * 8)


def _kdd_line(label):
    return f"{KDD_ROW},{label}"


@pytest.fixture(scope="module")
def kdd_dir():
    d = _tmp()
    os.makedirs(f"{d}/kddcup.data_10_percent")
    with open(f"{d}/kddcup.data_10_percent/kddcup.data_10_percent", "w") as f:
        f.write("\n".join(_kdd_line(x) for x in ["normal.", "smurf.", " Neptune. ", "back...", "unknownattack.", ""]) + "\n")
    with open(f"{d}/corrected", "w") as f:
        f.write(_kdd_line("ipsweep.") + "\n")
    with gzip.open(f"{d}/copy.gz", "wt") as f:
        f.write(_kdd_line("smurf.") + "\n")
    return d


def test_kdd_columns_and_labels(spark, kdd_dir):
    df = S.load_dataset(spark, "KDD-Cup99", "train", kdd_dir)
    assert len([c for c in df.columns if c not in ("Label", "AttackLabel", "AttackCategory")]) == 41
    rows = {r["AttackLabel"]: (r["Label"], r["AttackCategory"]) for r in df.collect()}
    assert rows["normal"] == ("normal", "normal")
    assert rows["smurf"] == ("attack", "dos")
    assert rows["neptune"] == ("attack", "dos")
    assert rows["back"] == ("attack", "dos")
    assert rows["unknownattack"] == ("attack", "other")
    assert None not in rows
    parity = {r["AttackLabel"]: (r["Label"], r["AttackCategory"])
              for r in S.read_kdd(spark, f"{kdd_dir}/kddcup.data_10_percent/kddcup.data_10_percent", "attack").collect()}
    assert parity["nan"] == ("attack", "other")
    from flowlab.functions.labels import quarantine
    raw = spark.read.schema(S.kdd_schema()).csv(f"{kdd_dir}/kddcup.data_10_percent/kddcup.data_10_percent")
    assert quarantine(raw, "AttackLabel").count() == 1
    test = S.load_dataset(spark, "kdd99", "test", kdd_dir)
    assert [r["AttackCategory"] for r in test.collect()] == ["probe"]


def test_kdd_gz_and_missing(spark, kdd_dir):
    assert S.read_kdd(spark, f"{kdd_dir}/copy.gz").first()["AttackCategory"] == "dos"
    with pytest.raises(FileNotFoundError, match="looked at"):
        S.resolve_kdd_path(spark, _tmp(), "train")
    with pytest.raises(ValueError, match="unknown dataset"):
        S.load_dataset(spark, "unsw", "train", kdd_dir)


def _cic_dir(single_row_stratum=False):
    d = _tmp()
    os.makedirs(f"{d}/sub")
    lines = [" Flow ID, Fwd Header Length, Fwd Header Length, Flow Bytes/s, Label"]
    for i in range(40):
        lab = "BENIGN" if i % 2 == 0 else "DoS Hulk"
        val = {3: "Infinity", 5: "-Infinity", 7: "NaN", 9: ""}.get(i, str(i * 1.5))
        lines.append(f"f{i},{i},{i + 1},{val},{lab}")
    if single_row_stratum:
        lines.append("f99,1,2,3,Heartbleed")
    with open(f"{d}/day1.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_cic_split_counts_disjoint_repeatable(spark):
    d = _cic_dir()
    tr = S.load_dataset(spark, "CICIDS-2017", "train", d)
    te = S.load_dataset(spark, "cic_2017", "test", d)
    assert tr.count() == 32 and te.count() == 8
    ids_te = {r["Flow ID"] for r in te.collect()}
    assert ids_te == {r["Flow ID"] for r in S.load_dataset(spark, "cicids2017", "test", d).collect()}
    assert not ids_te & {r["Flow ID"] for r in tr.collect()}
    assert {r["Label"] for r in te.collect()} == {"normal", "attack"}
    assert {r["AttackCategory"] for r in te.collect()} == {"normal", "dos"}
    assert "Fwd Header Length.1" in tr.columns
    assert dict(tr.dtypes)["Flow Bytes/s"] == "double"


def test_cic_single_member_stratum_errors(spark):
    with pytest.raises(ValueError, match="least populated"):
        S.read_cic(spark, _cic_dir(True), "train").count()


def test_cic_family_rules(spark):
    from flowlab.functions.labels import cic_family
    cases = {"PortScan": "probe", "DoS Hulk": "dos", "DDoS": "dos", "Heartbleed": "dos", "FTP-Patator": "brute_force",
             "Web Attack - XSS": "web_attack", "Infiltration": "infiltration", "Bot": "botnet", "Something": "other",
             " benign ": "normal"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r["l"]: r["f"] for r in df.select("l", cic_family(F.col("l")).alias("f")).collect()}
    assert got == cases


def test_headered_csv_typing_and_label_check(spark):
    d = _tmp()
    with open(f"{d}/u.csv", "w") as f:
        f.write(" id, dur ,proto,label\n1,0.5,tcp,0\n2,NA,udp,1\n3,7,,1\n")
    df = S.read_headered_csv(spark, f"{d}/u.csv", label_col="label")
    assert df.columns == ["id", "dur", "proto", "label"]
    t = dict(df.dtypes)
    assert t["dur"] == "double" and t["proto"] == "string"
    with pytest.raises(ValueError, match="not found"):
        S.read_headered_csv(spark, f"{d}/u.csv", label_col="Label")


def test_synthetic_layout_invariant(spark):
    a = S.synthetic_flows(spark, 2000, 5, partitions=1).orderBy("id").collect()
    b = S.synthetic_flows(spark, 2000, 5, partitions=7).orderBy("id").collect()
    assert a == b
    mix = {r["Label"]: r["count"] for r in S.synthetic_flows(spark, 20000, 2).groupBy("Label").count().collect()}
    assert abs(mix["Benign"] / 20000 - 0.70) < 0.02 and abs(mix["Exfiltration"] / 20000 - 0.05) < 0.01


def test_unsw_style_pair_labels(spark):
    from flowlab.functions.labels import task_label
    from flowlab.plans.pipelines import labelled_csv
    d = _tmp()
    with open(f"{d}/train.csv", "w") as f:
        f.write("id,dur,proto,attack_cat,label\n1,0.1,tcp,Normal,0\n2,0.5,udp,DoS,1\n3,0.2,tcp,Reconnaissance,1\n")
    df = labelled_csv(spark, f"{d}/train.csv")
    assert "id" not in df.columns and "label" not in df.columns
    rows = df.select("Label", task_label(F.col("AttackCategory"), "dos").alias("dos"),
                     task_label(F.col("AttackCategory"), "port_scan").alias("scan")).collect()
    assert [(r["Label"], r["dos"], r["scan"]) for r in rows] == [("normal", 0, 0), ("attack", 1, 0), ("attack", 0, 1)]


def test_capture_written_by_spark_is_found(spark, tmp_path):
    """A folder of part files counts once the job that wrote it has finished."""
    base = str(tmp_path)
    spark.range(3).selectExpr("cast(id as string) as c").write.csv(f"{base}/kddcup.data")
    assert S.resolve_kdd_path(spark, base, "train") == f"{base}/kddcup.data"
    (tmp_path / "corrected").mkdir()
    with pytest.raises(FileNotFoundError):
        S.resolve_kdd_path(spark, base, "test")
