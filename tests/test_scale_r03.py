"""Whole runs read their inputs once and take their views in batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.functions import arrays as A
from flowlab.operators import anomaly as AN
from flowlab.operators import augment as AU
from flowlab.operators import linear as LN
from flowlab.operators import models as MO
from flowlab.operators import rounds as RO
from flowlab.plans import pipelines as PL
from flowlab.sources import flows as SRC


def vectors(spark, n, dim, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(f"r{i}", v.tolist(), i % 2 if i % 7 else None) for i, v in enumerate(x)],
                                 "id string, v array<double>, y int").repartition(3)


@pytest.mark.parametrize("dim", [1, 5, 4100])
def test_drawn_views_are_the_row_wise_ones(spark, monkeypatch, dim):
    monkeypatch.setattr(AU, "CELLS", 7 * dim)
    df, rid = vectors(spark, 12, dim), F.col("id")
    got = AU.drawn(df, "v", {"w": ("weak", rid, "w"), "s": ("strong", rid, "s")}, ["id"], 9)
    want = df.select("id", AU.weak(F.col("v"), rid, "w", 9).alias("w"), AU.strong(F.col("v"), rid, "s", 9).alias("s"))
    a, b = ({r["id"]: r for r in x.collect()} for x in (got, want))
    assert len(a) == 12 and a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k]["w"], b[k]["w"], atol=1e-12) and np.allclose(a[k]["s"], b[k]["s"], atol=1e-12)
        assert [x == 0 for x in a[k]["s"]] == [x == 0 for x in b[k]["s"]]


def test_packed_views_give_the_same_step(spark):
    df = vectors(spark, 60, 4)
    weights = {0: 0.5, 1: 2.0}
    rows = RO.fixmatch_views(df, "v", "id", 1, 3).where("y IS NOT NULL").withColumn("weight", F.when(F.col("y") == 1, 2.0).otherwise(0.5))
    a = RO.fixmatch_step(rows, [1.0, -2.0, 0.5, 3.0], 0.1, 1.0)
    b = RO.fixmatch_step(RO.packed_views(df, "v", "id", ["y"], 0, 3), [1.0, -2.0, 0.5, 3.0], 0.1, 1.0, weights)
    assert np.allclose(a.pop("gradient"), b.pop("gradient")) and a == pytest.approx(b) and a["mask_rate"] > 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile_of_a_whole_table(spark, q):
    x = np.random.default_rng(2).normal(size=6000).round(3)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    assert AN.exact_percentile(df, "v", q).first()["quantile"] == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert AN.exact_percentile(df.where("v IS NULL"), "v", q).count() == 0


def test_evaluation_of_two_known_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), [0.0, float(b)]) for a, b in zip(rng.integers(0, 2, 200), rng.normal(size=200).round(1))]
    df = spark.createDataFrame(rows, "y int, logits array<double>")
    one, two = (PL.evaluation_tables(df, n_classes=n) for n in (None, 2))
    for name in one:
        a, b = (sorted((tuple(r) for r in t[name].collect()), key=str) for t in (one, two))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y, nan_ok=True) if all(isinstance(v, (int, float)) for v in x) else x[:2] == y[:2]


def test_a_run_computes_its_inputs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = SRC.synthetic_flows(spark, 300, 4)
    df = df.select(*[F.col(f"Feature_{i}").cast("double").alias(f"Feature_{i}") for i in range(4)],
                   F.when(F.col("Label") == "Benign", "normal").otherwise("attack").alias("Label"),
                   F.when(F.col("Label") == "DoS", "dos").otherwise("normal").alias("AttackCategory"))
    df = df.mapInArrow(count, df.schema)
    PL.run_pipeline(df, df, str(tmp_path / "out"), ["intrusion", "dos"], ssl_epochs=1, task_epochs=1, embed_dim=4)
    assert seen.value == 600


def test_a_split_capture_is_read_once_for_both_sides(spark, tmp_path, monkeypatch):
    rows = [(i, i % 5 / 10, "BENIGN" if i % 3 else "DDoS") for i in range(60)]
    spark.createDataFrame(rows, "id int, value double, Label string").coalesce(1).write.option("header", True).csv(str(tmp_path / "cic/day0"))
    want = [sorted(tuple(r) for r in SRC.load_dataset(spark, "cic2017", s, str(tmp_path / "cic")).collect()) for s in ("train", "test")]
    reads, real = [], SRC.find_csv_files
    monkeypatch.setattr(SRC, "find_csv_files", lambda *a: reads.append(1) or real(*a))
    given = {}
    monkeypatch.setattr(PL, "run_pipeline", lambda train, test, out, **k: given.update(train=train, test=test))
    PL.run_named_dataset(spark, "CICIDS-2017", str(tmp_path / "cic"), str(tmp_path / "out"))
    assert [sorted(tuple(r) for r in given[s].collect()) for s in ("train", "test")] == want
    assert len(reads) == 1 and [len(w) for w in want] == [48, 12]


def test_a_stored_capture_is_the_one_that_is_read(spark, tmp_path, monkeypatch):
    """a kind that shows late, blanks, a column without values, no rows at all."""
    monkeypatch.setattr(SRC, "SHOWN", 5)
    head = "id, late ,num,none,never,label,attack_cat\n"
    body = "".join(f"{i},{'x' if i == 37 else i},{'NaN' if i % 4 else i / 8},,{'t' if i else ''},{i % 2}, Probe \n" for i in range(40))
    for name, text in (("a", head + body), ("b", head)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
        want = SRC.read_headered_csv(spark, str(tmp_path / name), "label")
        got = SRC.store_headered_csv(spark, str(tmp_path / name), str(tmp_path / f"{name}.parquet"), "label")
        assert got.dtypes == want.dtypes
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.count() == 0


def test_a_csv_pair_is_parsed_once(spark, tmp_path, monkeypatch):
    """the kinds come from the pass that stores the rows, not from one of their own."""
    rng = np.random.default_rng(5)
    for name in ("train", "test"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text("id,a,b,label,attack_cat\n" + "".join(
            f"{i},{rng.normal()},{rng.normal()},{i % 2},{'DoS' if i % 2 else 'Normal'}\n" for i in range(1500)))
    sizes, real = [], SRC.FT.infer_column_kinds
    monkeypatch.setattr(SRC.FT, "infer_column_kinds", lambda df, *a: sizes.append(df.count()) or real(df, *a))
    given = {}
    monkeypatch.setattr(PL, "run_pipeline", lambda train, test, out, **k: given.update(train=train, test=test))
    PL.run_csv_pair(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "out"))
    assert sizes and max(sizes) <= 1000
    for name in ("train", "test"):
        want = PL.labelled_csv(spark, str(tmp_path / name))
        assert given[name].dtypes == want.dtypes
        assert sorted(given[name].collect()) == sorted(want.collect())


def test_views_drawn_where_they_are_summed_up(spark):
    df, rid = vectors(spark, 80, 3), F.col("id")
    views = {"a": ("strong", rid, "s1"), "b": ("strong", rid, "s2")}
    rows, draw = AU.to_draw(df, "v", views, 7)
    one, two = LN.contrastive_encoder(AU.drawn(df, "v", views, [], 7), "a", "b", 2), LN.contrastive_encoder(rows, "a", "b", 2, draw=draw)
    assert np.allclose(one[1], two[1]) and np.allclose(np.abs(one[0][0]["W"]), np.abs(two[0][0]["W"]))


def test_net_errors_are_the_row_wise_ones(spark):
    df = vectors(spark, 30, 4)
    net = LN.linear_autoencoder(df, "v", 2)
    rec = MO.apply_nets(df, "v", {"recon": net}, ["v"]).select(A.mse(F.col("v"), F.col("recon")).alias("err"))
    got, want = (sorted(r["err"] for r in x.collect()) for x in (AN.net_errors(df, "v", net), rec))
    assert len(got) == 30 and np.allclose(got, want)


def test_one_report_is_opened_alone(spark, tmp_path):
    (tmp_path / "confusion/task=t").mkdir(parents=True)
    (tmp_path / "confusion/task=t/part.json").write_text('{"y_true": 0, "y_pred": 1, "n": 3}\n')
    found = PL.report_tables(spark, str(tmp_path), ["confusion"])
    assert [tuple(r) for r in found["confusion"].select("task", "n").collect()] == [("t", 3)] and list(found) == ["confusion"]
