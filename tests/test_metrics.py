from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import metrics as M
from flowlab.operators.prefix import global_rank, running_totals


def _df(spark, ys, ps):
    return spark.createDataFrame([(int(y), float(p)) for y, p in zip(ys, ps)], "y int, p double")


def _auc_brute(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_running_totals_exact_under_repartition(spark):
    rng = np.random.default_rng(3)
    vals = rng.random(500)
    df = spark.createDataFrame([(float(v), 1) for v in vals], "k double, one int")
    for n in (1, 7, 31):
        out = running_totals(df.repartition(n), "k", ["one"], n_buckets=16).collect()
        got = sorted((r["k"], r["cum_one"]) for r in out)
        assert [c for _, c in got] == list(range(1, 501))


def test_global_rank(spark):
    df = spark.createDataFrame([(float(i % 97), i) for i in range(300)], "k double, id int")
    out = global_rank(df, "k", tiebreak=["id"], n_buckets=8).collect()
    ranks = sorted(r["rank"] for r in out)
    assert ranks == list(range(300))
    by = {r["id"]: r["rank"] for r in out}
    order = sorted(range(300), key=lambda i: (i % 97, i))
    assert [by[i] for i in order] == list(range(300))


def test_auc_ties_half(spark):
    ys = [0, 0, 1, 1, 1, 0, 1, 0]
    ps = [0.1, 0.4, 0.4, 0.8, 0.8, 0.8, 0.3, 0.2]
    got = M.roc_auc(_df(spark, ys, ps)).first()[0]
    assert got == pytest.approx(_auc_brute(ys, ps))


def test_auc_random_matches_bruteforce(spark):
    rng = np.random.default_rng(7)
    ys = rng.integers(0, 2, 400)
    ps = np.round(rng.random(400) * 0.5 + ys * 0.2, 2)
    assert M.roc_auc(_df(spark, ys, ps)).first()[0] == pytest.approx(_auc_brute(list(ys), list(ps)))


def test_auc_single_class_null(spark):
    assert M.roc_auc(_df(spark, [1, 1], [0.2, 0.3])).first()[0] is None


def test_average_precision_step_sum(spark):
    ys = [1, 0, 1, 1, 0]
    ps = [0.9, 0.8, 0.7, 0.7, 0.1]
    # thresholds desc: .9 (P=1,R=1/3), .8 (P=.5), .7 (P=3/4,R=1), .1
    exp = (1 / 3) * 1.0 + 0 * 0.5 + (2 / 3) * 0.75
    assert M.average_precision(_df(spark, ys, ps)).first()[0] == pytest.approx(exp)


def test_best_f1_lowest_threshold_on_tie(spark):
    ys = [1, 0, 1, 0]
    ps = [0.9, 0.6, 0.4, 0.2]
    b = M.best_f1_threshold(_df(spark, ys, ps)).first()
    # f1 at .9: P=1,R=.5 -> .667; at .4: P=2/3,R=1 -> .8; at .2: P=.5,R=1 -> .667
    assert b["threshold"] == 0.4
    assert b["f1"] == pytest.approx(0.8, abs=1e-6)


def test_recall90_picks_best_precision(spark):
    ys = [1] * 9 + [0, 1, 0]
    ps = [0.9] * 9 + [0.85, 0.3, 0.1]
    r = M.recall90_threshold(_df(spark, ys, ps)).first()
    assert r["threshold"] == 0.9 and r["recall"] == pytest.approx(0.9)


def test_grid_threshold_default_when_no_positive_f1(spark):
    r = M.anomaly_grid_threshold(_df(spark, [0, 0, 0], [0.9, 0.5, 0.2])).first()
    assert (r["threshold"], r["f1"]) == (0.5, 0.0)


def test_grid_index_matches_bruteforce(spark):
    grid = np.linspace(0.01, 0.99, 200)
    vals = list(grid) + [0.0, 0.005, 0.995, 1.0] + list(np.random.default_rng(1).random(200))
    df = spark.createDataFrame([(float(v),) for v in vals], "s double")
    out = df.select("s", M.grid_index(F.col("s"), 0.01, 0.99, 200).alias("gi")).collect()
    for r in out:
        exp = int(np.sum(grid <= r["s"])) - 1
        assert r["gi"] == exp, r


# Golden confusion matrices (row = true, col = predicted) with the printed
# accuracy / weighted F1 (percent, two decimals).
GOLDEN = [
    ([[55227, 773], [31870, 87471]], 81.38, 82.01),
    ([[157888, 5189], [9788, 2476]], 91.46, 90.53),
    ([[160512, 4338], [3040, 7451]], 95.79, 95.91),
    ([[227155, 23281], [997, 59596]], 92.19, 92.62),
    ([[80013, 1163], [5563, 224290]], 97.84, 97.86),
    ([[264258, 42605], [759, 3407]], 86.06, 91.36),
    ([[44462, 67067], [51, 454572]], 88.14, 86.01),
    ([[489103, 909], [30318, 45822]], 94.48, 93.90),
    ([[534366, 0], [31786, 0]], 94.39, 91.66),
]


@pytest.mark.parametrize("cm,acc,f1w", GOLDEN)
def test_golden_confusion_matrices(spark, cm, acc, f1w):
    cells = [(t, p, cm[t][p]) for t in (0, 1) for p in (0, 1)]
    df = spark.createDataFrame(cells, "y int, pred int, n long").select(
        "y", "pred", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("i"),
        "n").where(F.col("n") > 0)
    got_cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion(df, "y", "pred").collect()}
    assert got_cm == {(t, p): cm[t][p] for t in (0, 1) for p in (0, 1)}
    prf = {(r["metric"], r["class"]): r["value"]
           for r in M.prf_table(M.confusion(df, "y", "pred")).collect()}
    assert round(100 * prf[("accuracy", None)], 2) == acc
    assert round(100 * prf[("f1_weighted", None)], 2) == f1w


@pytest.mark.parametrize("descending", [False, True])
def test_next_values_cross_the_ranges(spark, descending):
    rng = np.random.default_rng(8)
    keys = rng.permutation(200).astype(float)
    df = spark.createDataFrame([(float(k), int(k) % 7) for k in keys], "k double, v int")
    out = running_totals(df.repartition(5), "k", ["v"], n_buckets=16, descending=descending, next_cols=["v"]).collect()
    line = sorted(out, key=lambda r: -r["k"] if descending else r["k"])
    assert [r["next_v"] for r in line] == [r["v"] for r in line[1:]] + [None]


def test_dropped_points_are_the_corners(spark):
    rng = np.random.default_rng(4)
    ys, ps = rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 60
    got = {r["threshold"] for r in M.roc_curve(_df(spark, ys, ps), drop_intermediate=True).collect()}
    scores = sorted(set(ps), reverse=True)
    step = [(sum((ps == s) & (ys == 1)), sum((ps == s) & (ys == 0))) for s in scores]
    corner = {s for i, s in enumerate(scores) if i in (0, len(scores) - 1) or step[i] != step[i + 1]}
    assert got == corner | {None}


def test_evaluation_of_one_class_and_of_two(spark):
    from flowlab.plans.pipelines import evaluation_tables
    rng = np.random.default_rng(6)
    ys, x = rng.integers(0, 2, 300), rng.normal(size=300).round(1)
    rows = [(int(y), [0.0, float(v)]) for y, v in zip(ys, x)]
    both = evaluation_tables(spark.createDataFrame(rows, "y int, logits array<double>"))
    got = {(r["metric"], r["class"]): r["value"] for r in both["metrics"].collect()}
    assert got["roc_auc", None] == pytest.approx(_auc_brute(ys, x))
    assert got["accuracy", None] == pytest.approx(np.mean(ys == (x > 0)))
    assert both["pr_curve"].count() == len(set(x)) + 1 and both["sweep"].count() == 50
    one = evaluation_tables(spark.createDataFrame([(1, v) for _, v in rows], "y int, logits array<double>"))
    assert "roc_auc" not in {r["metric"] for r in one["metrics"].collect()}


@pytest.mark.parametrize("fanout", [3, 4, 256])
def test_ranges_beyond_one_search_tree(spark, monkeypatch, fanout):
    from flowlab.operators import prefix as P
    monkeypatch.setattr(P, "FANOUT", fanout)
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(50)])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(3)
    got = P.value_ranges(df, ["g", "v"], "p", 40).collect()
    order = sorted(got, key=lambda r: (r["g"] is not None, r["g"] or "", r["v"] is not None, r["v"] or 0))
    assert len(got) == 800 and all(a["p"] <= b["p"] for a, b in zip(order, order[1:])) and len({r["p"] for r in got}) > 20
    same = {}
    assert all(same.setdefault((r["g"], r["v"]), r["p"]) == r["p"] for r in got)
    ranked = P.rank_by_value(df.distinct(), ["g"], "v", "r", 40).collect()
    for g in (None, "a", "b", "c"):
        mine = sorted((r for r in ranked if r["g"] == g), key=lambda r: (r["v"] is not None, r["v"] or 0))
        assert [r["r"] for r in mine] == list(range(len(mine)))
