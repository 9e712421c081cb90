"""Conversation repair against a plain search over audits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowlab.llm import conversation_repair as cr

INK = re.compile(r"[^\x20\x09-\x0D]")
NEXT, DUE, ROLE = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "u", 1: "u", 2: "a", 3: "u"}, {2: "user", 3: "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_turn = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(conv_turn.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """One conversation's (turn, role, text) in order: its whole result row."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else
                      "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {s: min([(0, "")] if s in (0, 3) else [(10 ** 9, "")]) for s in range(4)}
    best = insert(best)
    for (_, role, _), fault in zip(rows[::-1], faults[::-1]):
        now = {}
        for s in range(4):
            ways = [(best[s][0] + 3, "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                ways.append((best[NEXT[s]][0] + more + 2, "R" + best[NEXT[s]][1]))
                if role[:1] == DUE[s]:
                    ways.append((best[NEXT[s]][0] + more, "K" + best[NEXT[s]][1]))
                if role[:1] == "s" and s == 0:
                    ways.append((best[1][0] + more, "K" + best[1][1]))
            now[s] = min(ways)
        best = insert(now)
    cost, audit = best[0]
    out, s, i = [], 0, 0
    for edit in audit:
        if edit in "KRI":
            s = 1 if edit == "K" and rows[i][1][:1] == "s" else NEXT[s]
            out.append((rows[i][1] if edit == "K" else ROLE[s]) + ":" + ("" if edit == "I" else rows[i][2]))
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (
        "blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def insert(best):
    best = dict(best)
    for _ in range(5):
        for s in range(4):
            best[s] = min(best[s], (best[NEXT[s]][0] + 2, "I" + best[NEXT[s]][1]))
    return best


def plain_report(rows, everything):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(row)
    out = {}
    for conv in everything:
        rows = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        out[conv] = plain_repair(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query_matches_plain_python(spark):
    from flowlab.llm.queries import op13_conversation_repair
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"])
            for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert result(op13_conversation_repair(spark, "/root/testdata/sf0.01")) == plain_report(
        plain_damage(rows), {r[0] for r in rows})


SCHEMA = "conv_id long, turn long, role string, text string, block long, rank int, digest string, n string, copy int"
TEXTS = ["a.", "b!", "c", "", " \t", None, "d?", "e.", "f. ", "g.\x0b", "é", "h\x00."]


def odd_rows(seed, n, convs):
    rng = random.Random(seed)
    return [(rng.choice(convs), rng.choice([None, *range(-2, 12)]), rng.choice(
        ["user", "assistant", "system", "", None, "bot", "u", "sys"]), rng.choice(TEXTS)) for _ in range(n)]


@pytest.mark.parametrize("block,n,convs", [(4096, 250, [None, 1, 2, *range(9, 60)]), (3, 250, [None, 1, 2, *range(9, 60)]),
                                           (7, 400, [5])])
def test_odd_rows_in_blocks_of_any_size(spark, block, n, convs, monkeypatch):
    """Nulls, ties, repeated rows, empty and other roles, a hot conversation
    in many blocks and clashing extra columns."""
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = odd_rows(n + block, n, convs)
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA).repartition(3)
    damaged = plain_damage(rows)
    assert result(cr.repair_report(cr.damage(df), df)) == plain_report(damaged, {r[0] for r in rows})
    plain = [(c, t, *(" " if x is None else x for x in r)) for c, t, *r in rows]
    assert result(cr.repair_report(df, df)) == plain_report(plain, {r[0] for r in rows})


def test_rows_of_the_repair(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "more."), (1, 2, "assistant", "ok."), (2, 0, "user", " ")],
                               "conv_id long, turn long, role string, text string")
    report, rows = cr.repair(df)
    assert [r["audit"] for r in report.orderBy("conv").collect()] == ["KIKK", "D"]
    assert [(r["role"], r["text"], r["edit"]) for r in rows.orderBy("block", "place").collect()] == [
        ("user", "hi.", "K"), ("assistant", "", "I"), ("user", "more.", "K"), ("assistant", "ok.", "K")]


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert result(cr.repair_report(cr.damage(none), none)) == {}
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 200_000 + f"{i}.") for i in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(cr.repair_report(df, df)) == plain_report(rows, {1})


def test_many_equal_rows_are_one_run(spark):
    """Copies of a row are counted before anything is ordered."""
    rows = [(1, 0, "user", "hello.")] * 5000 + [(1, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(cr.repair_report(df, df))[1]
    assert got[2] == 4999 and got[5] == 3 * 4999 and got[6] == "K" + "D" * 4999 + "K"


def test_least_paths_of_blocks_agree_with_one_block():
    rng = np.random.default_rng(3)
    for _ in range(50):
        k = int(rng.integers(2, 30))
        role, fault, n = rng.integers(0, 4, k), rng.integers(0, 4, k), rng.integers(1, 3, k)
        whole = cr.least_paths(role, fault, n, np.array([0, k]), cr.END[None], np.array([True]))
        cut = int(rng.integers(1, k))
        second = cr.costs_to_go(role[cut:], fault[cut:], n[cut:], np.array([0, k - cut]), cr.END[None, :, None])[0, :, 0]
        parts = cr.least_paths(role, fault, n, np.array([0, cut, k]), np.stack([second, cr.END]), np.array([False, True]))
        for s in range(4):
            assert whole.edits[0][s] == parts.edits[0][s] + parts.edits[1][parts.exits[0][s]]
