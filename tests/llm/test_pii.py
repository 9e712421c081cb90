"""Personal data: base rules against regular expressions, the field against
all segmentations, added spans on held-out forms."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time

import pytest

from flowlab.llm import pii
from flowlab.llm.semi_markov import ADJACENT, SemiMarkov, train


def plain_base(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def check(number):
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(number[::-1])]
        return sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 16 <= len(digits(m.group())) <= 19 and check(digits(m.group()))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                    if 8 <= len(digits(m.group())) <= 15]


def test_base_rules_are_the_regular_expressions():
    rng = random.Random(5)
    kinds = ["a@.b-", "0123456789", "+ ().-", "1.2", "@", "é%_", "00255", "٣²"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 300_000 + "@b", "a@" * 100_000, "+1" * 100_000, "." * 300_000,
                                  "+1 " + "( " * 100_000, "1.1.1.1 " * 3000, "1 " * 50_000,
                                  "1." * 150_000, "12-34 " * 20_000])
def test_long_runs_take_linear_time(text):
    start = time.monotonic()
    spans = pii.base_spans(text)
    pii.added_spans(text, SemiMarkov({"email:any": -1.0}), spans)
    assert time.monotonic() - start < 15


# ---------------------------------------------------------------- the field

def random_region(rng):
    tokens = rng.randint(1, 6)
    spans = {(a, b, k) for a in range(tokens) for b in range(a + 1, tokens + 1) for k in "xy" if rng.random() < 0.4}
    found = [(a, b, k, (f"{k}:{b - a}", f"{k}:from{a % 2}")) for a, b, k in sorted(spans)]
    model = SemiMarkov({f: rng.uniform(-2, 2) for f in {f for c in found for f in c[3]} | {ADJACENT}})
    return tokens, found, model


def segmentations(tokens, found):
    """Every set of candidates without overlap."""
    for size in range(tokens + 1):
        for chosen in itertools.combinations(found, size):
            ordered = sorted(chosen)
            if all(p[1] <= q[0] for p, q in zip(ordered, ordered[1:])):
                yield ordered


def total(model, chosen):
    touching = sum(p[1] == q[0] for p, q in zip(chosen, chosen[1:]))
    return sum(model.score(c[3]) for c in chosen) + touching * model.weights[ADJACENT]


def test_best_and_likelihood_against_all_segmentations():
    rng = random.Random(8)
    for _ in range(150):
        tokens, found, model = random_region(rng)
        every = list(segmentations(tokens, found))
        scores = [total(model, c) for c in every]
        best = model.best(tokens, found)
        chosen = [next(c for c in found if c[:3] == e) for e in best]
        assert math.isclose(total(model, chosen), max(scores), abs_tol=1e-9)
        gold = rng.choice(every)
        value, gradient = model.log_likelihood(tokens, found, frozenset(c[:3] for c in gold))
        whole = math.log(sum(map(math.exp, scores)))
        assert math.isclose(value, total(model, gold) - whole, abs_tol=1e-9)
        for f in list(model.weights)[:4]:
            expected = sum(math.exp(s - whole) * count(f, c) for s, c in zip(scores, every))
            assert math.isclose(gradient.get(f, 0.0), count(f, gold) - expected, abs_tol=1e-9)


def count(feature, chosen):
    if feature == ADJACENT:
        return sum(p[1] == q[0] for p, q in zip(chosen, chosen[1:]))
    return sum(c[3].count(feature) for c in chosen)


def test_training_learns_whole_span_features():
    examples = [(3, [(0, 2, "x", ("x:long",)), (0, 1, "x", ("x:short",))], frozenset([(0, 2, "x")])),
                (1, [(0, 1, "x", ("x:short",))], frozenset())]
    model = train(examples)
    assert model.best(3, examples[0][1]) == [(0, 2, "x")] and model.best(1, examples[1][1]) == []


# ---------------------------------------------------------------- scan

@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("text,found", [
    ("call (311) 555-1977 now", "(311) 555-1977"), ("at 211-555-1407.", "211-555-1407"),
    ("write to bob.smith (at) mail7.example.com today", "bob.smith (at) mail7.example.com"),
    ("write to ann.lee[at]host.example.org", "ann.lee[at]host.example.org"),
    ("on 2024-05-17 at noon", None), ("in 1990-1995 and 2001", None), ("order 48213 7", None), ("up to 12.500.000 of", None),
    ("address 10.0.0.300 is wrong", None), ("number 1234567812345678 fails", None), ("bob@localhost", None), ("no digits", None)])
def test_added_spans(model, text, found):
    spans = pii.added_spans(text, model, pii.base_spans(text))
    assert [text[s:e] for _, s, e in spans] == ([found] if found else [])


def test_held_out_forms(model, spark):
    """Base spans of other documents, rewritten: told from the counterexamples."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3 AND doc_id >= 1000")
    examples = pii.examples(pii.sampled_regions(docs, sample=200))
    right = sum(frozenset(model.best(n, found)) == gold for n, found, gold in examples)
    assert len(examples) > 300 and right >= 0.97 * len(examples)


def test_rows(odd, rows, empty, model):
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.scan(odd, model).collect()]
    assert sorted(str(g[0]) for g in got) == sorted(str(r[0]) for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for doc_id, spans in got:
        base = sorted(plain_base(texts[doc_id] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert [s[:3] for s in spans if s[3]] == base
    assert pii.scan(empty, model).count() == 0 and not pii.fit(empty).weights


def test_sample_does_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert pii.sampled_regions(docs, sample=50) == pii.sampled_regions(docs.repartition(7), sample=50)


def test_query(spark):
    from flowlab.llm.queries import op12_pii
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op12_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(plain_base(texts[r["doc_id"]] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        written = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(written) <= set(r["spans"].split(","))
