"""Operators over the whole table and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlab.llm import components, exact_dedup, language_id, mixing, near_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(texts):
    """Smallest index reachable by links, per text."""
    sets = [sets_of(t) for t in texts]
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_copies(seed, n):
    """Groups of texts at all similarities around the limit, exact copies among them."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = [f"z{rng.randint(0, 9**6)}" if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else w for w in words]
            out.append((" " if rng.random() < 0.9 else "\n\t").join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    return out[:n]


@pytest.mark.parametrize("block", [8, 512])
def test_near_dedup_matches_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_copies(11, 400) + [None, "", " \n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect()}
    component, size = plain_components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == component
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(component)]


@pytest.mark.parametrize("n", [20, 500, 5000])
def test_signatures_of_unrelated_texts_differ(n):
    shingler = near_dedup.Shingler()

    def sig(word):
        text = np.frombuffer(" ".join(f"{word}{i}" for i in range(n)).encode(), np.uint8)
        return near_dedup.signature(near_dedup.minima(shingler.shingles(text)[0]))

    assert (sig("a") == sig("A")).all() and (sig("a") == sig("b")).mean() < 0.1


def test_near_dedup_odd_rows(odd, rows, empty):
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == len(rows) and near_dedup.near_dedup(empty).count() == 0
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[10] == 9 and by_id[13] == 12 and by_id[14] == 14 and by_id[7] == 6 and by_id[None] == 6
    kept = near_dedup.kept_rows(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({r["doc_id"] for r in got if r["kept"]})


def test_kept_rows_where_ids_repeat(spark):
    """Unrelated texts under one id, null ids among them, all stay; near copies under one id leave one."""
    words = [[f"{c}{i}" for i in range(40)] for c in "abcdefgh"]
    a, b, c, d, e, f, g, h = map(" ".join, words)
    near = {x[0][0]: " ".join(x[:39] + ["z"]) for x in words}
    rows = [(None, a), (None, b), (None, a.upper()), (7, c), (7, d), (1, e), (5, near["e"]), (5, f),
            (9, g), (9, near["g"]), (None, h), (None, near["h"]), (2, near["b"]), (3, ""), (3, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    got = near_dedup.kept_rows(docs)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], (r["text"] or "").lower()) for r in got.collect())
    assert kept[(5, f)] == 1 and kept[(5, near["e"])] == 0 and kept[(1, e)] == 1          # 5 also has a dropped near copy
    assert kept[(None, a)] == 1 and kept[(None, b)] == 0 and kept[(2, near["b"])] == 1   # a near copy has a real id
    assert kept[(7, c)] == kept[(7, d)] == 1
    assert kept[(9, g)] + kept[(9, near["g"])] == 1 and kept[(None, h)] + kept[(None, near["h"])] == 1
    assert sum(n for (i, _), n in kept.items() if i == 3) == 1 and kept[(4, " ")] == 1 and sum(kept.values()) == 10


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 3)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in at} and len(got) == len(at)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd, rows, empty, weak):
    """A weak digest puts different texts under one digest: the text decides."""
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    norm = [(r[1] or "").translate(LOW) for r in rows]
    want = Counter()
    seen = set()
    for r, t in zip(rows, norm):
        same = [x[0] for x, y in zip(rows, norm) if y == t]
        keep = max((x for x in same if x is not None), default=None)
        want[(r[0], keep, len(same), r[0] == keep and (r[0], t) not in seen)] += 1
        seen.add((r[0], t))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert exact_dedup.exact_dedup(empty, digest=digest).count() == 0
    if not weak:
        assert Counter(r["text_digest"] for r in got) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in norm)
        kept = exact_dedup.kept_rows(odd)
        assert kept.columns == odd.columns
        assert Counter((r["text"] or "").translate(LOW) for r in kept.collect()) == Counter(set(norm))


def test_unique_ids_take_the_short_way(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(((r[0], r[1]) for r in exact_dedup.kept_rows(docs).collect()), key=str) == [(2, "A"), (3, "b"), (None, "c")]


def test_mixing_shares(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 400, "e": 0, None: 300}
    got = {r["source"]: r for r in mixing.shares(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        w = sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / w >= 2 * sizes[n]}
        if not over:
            target |= {n: left * weight[n] / w for n in open_}
            break
        target |= {n: 2.0 * sizes[n] for n in over}
        left -= sum(2 * sizes[n] for n in over)
        open_ -= over
    assert {n: r["weight"] for n, r in got.items()} == weight
    assert all(abs(got[n]["target"] - target[n]) < 1e-6 for n in names)


def test_mixing_rows(spark, odd, rows, empty):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(rows) and mixing.mix_plan(empty).count() == 0
    assert all(0 <= r["copies"] <= 2 for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(odd.repartition(5)).collect()))
    copies = {r["doc_id"]: r["copies"] for r in plan}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r[0]] += copies[r[0]]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_mixing_totals_are_near_the_targets(spark):
    plan = mixing.mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.max("target").alias("want"),
                                        F.max("size").alias("largest")).collect():
        assert abs(r["got"] - r["want"]) <= max(0.05 * r["want"], 0.5 * r["largest"])


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Stage by stage on a small table: what each keeps is worked out in plain Python."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in source.collect()]
    texts = near_copies(4, 60)
    top = max(r[0] for r in rows)
    rows += [(top + 1 + i, t, "en", "src0", len(t)) for i, t in enumerate(texts)] + [(top + 100, None, "en", "src1", 0),
                                                                                    (top + 101, "123 456", "en", "src1", 7)]
    spark.createDataFrame(rows, source.schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language_id.fit(docs)
    known = {r["doc_id"] for r in language_id.predict(docs, model).collect() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert {top + 100, top + 101}.isdisjoint(known) and len(known) >= len(rows) - 5
    kept = [r for r in rows if r[0] in known]
    last = {}
    for r in sorted(kept):
        last[(r[1] or "").translate(LOW)] = r
    kept = sorted(last.values())
    component, _ = plain_components([r[1] for r in kept])
    kept = {kept[i][0] for i in range(len(kept)) if component[i] == i}
    steps = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = steps[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert now.columns == docs.columns
    assert {r["doc_id"] for r in steps["near_dedup"].collect()} == kept and steps["near_dedup"].count() == len(kept)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(steps["near_dedup"]).collect()}
    assert Counter(r["doc_id"] for r in steps["mixing"].collect()) == +Counter(plan)
    first = steps["packing"].where("piece = 0").groupBy("doc_id").count()
    assert {r["doc_id"]: r["count"] for r in first.collect()} == {d: c for d, c in plan.items() if c}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps["packing"].count()


def test_rejected_languages(spark, odd, rows):
    """Rows are judged one by one where ids repeat; a rejected id goes where they don't."""
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(r["doc_id"] for r in kept.collect()) <= Counter(r[0] for r in letters)
    unique = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(
        ["der die das und nicht " * 9, "the and of to in that " * 9] * 20 + ["123", None])], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"] for r in language_id.accepted(unique).collect()} == set(range(40))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


CLASHING = ["_id", "_k", "_whole", "_s", "kept", "_digest", "_d", "_word_key", "_key", "_copy", "_draw_below", "_ID2", "p", "__id"]


@pytest.mark.parametrize("repeated", [False, True])
def test_pipeline_stages_with_clashing_columns(spark, repeated):
    """Every stage with columns of the names that the code itself would add."""
    import corpus_pipeline
    rows = [(i, f"text number {i} of the table with some words of its own {i * 7919}", "en", f"s{i % 3}", *[f"c{i}"] * len(CLASHING))
            for i in range(30)]
    rows += [(30, rows[0][1], "en", "s0", *["x"] * len(CLASHING))] + ([rows[3]] * 2 if repeated else [])
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
        assert got
    assert len(exact_dedup.kept_rows(docs).collect()) == 30


def test_look_up_of_hot_keys(spark, monkeypatch):
    from flowlab.llm import common
    rows = spark.range(3000).select((F.col("id") % 1000 * (F.col("id") % 3)).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k <> 5")
    for share in (1000, 5, 1):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = {r["id"]: (r["k"], r["m"]) for r in common.look_up(rows, table, ["k"], ["m"], "n", 3000).collect()}
        want = {r["k"]: r["m"] for r in table.collect()}
        assert len(got) == 3000 and all(m == want.get(k) for k, m in got.values())


def test_mixing_inclusion_frequencies(spark):
    """Over many seeds a document gets its extra copy about as often as the
    fraction of its source's rate says, although each source takes the best draw."""
    rows = [(i, "w " * (1 + i * 7919 % 9), f"s{i % 3}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra, runs = Counter(), 12
    for seed in range(runs):
        for r in mixing.mix_plan(docs, seed=f"seed{seed}").collect():
            rate = r["target"] / r["source_size"]
            extra[r["doc_id"]] += r["copies"] - int(rate)
            assert r["copies"] - int(rate) in (0, 1)
    rates = {r["source"]: r["target"] / r["source_size"] % 1 for r in mixing.mix_plan(docs).collect()}
    for source, fraction in rates.items():
        mine = [extra[i] / runs for i, _, s in rows if s == source]
        assert abs(sum(mine) / len(mine) - fraction) < 0.04
        # as spread as independent draws are: no document is always or never chosen for its size
        assert abs(np.var(mine) - fraction * (1 - fraction) / runs) < 0.012
        by_size = [np.mean([extra[i] / runs for i, t, s in rows if s == source and (len(t) > 10) == big]) for big in (False, True)]
        assert abs(by_size[0] - by_size[1]) < 0.1
