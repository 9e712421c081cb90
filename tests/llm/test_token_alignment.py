"""Tokenizer alignment against a plain intersection of token ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowlab.llm import token_alignment as ta
from flowlab.llm.common import piece_files, tokenizer_files

FILES = tokenizer_files() | piece_files()


@pytest.fixture(scope="module")
def tables():
    return ta.Tables(FILES["vocab"], FILES["pieces"])


@pytest.fixture(scope="module")
def plain(tables):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    one = Tokenizer.from_file(FILES["vocab"])
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=FILES["pieces"])

    def groups(text):
        """(A ids, B ids, groups) of a text, by a set of common ends."""
        if not text:
            return [], [], []
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        whole = b" " + text.encode()
        if b"".join(tables.a[i] for i in a) != whole or b"".join(tables.b[i] for i in b) != whole:
            return [], [], []
        ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(t[i]) for i in ids]).tolist())}
                          for t, ids in ((tables.a, a), (tables.b, b)))
        out, i, j = [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            out.append((a[i:ends_a[e] + 1], b[j:ends_b[e] + 1]))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        return a, b, out
    return groups


def expected(texts, plain):
    """Every text's result row, the counts over all of them."""
    found = [plain(t) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def result(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
            for r in df.collect()]


def test_shared_ends_are_the_intersection():
    rng = random.Random(1)
    for _ in range(300):
        a, b, a_rows, b_rows, base = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 5)):
            size = rng.randint(1, 60)
            for ends, rows in ((a, a_rows), (b, b_rows)):
                ends += sorted({base + size, *(base + rng.randint(1, size) for _ in range(rng.choice([0, 3, size])))})
                rows.append(len(ends))
            base += size
        i, j = ta.shared_ends(*(np.array(x, np.int64) for x in (a, b, a_rows, b_rows)))
        assert [a[k] for k in i] == sorted(set(a) & set(b)) == [b[k] for k in j]


def test_long_stretches_without_a_common_end():
    a, b = np.append(np.arange(1, 20_001, 2), 20_002), np.append(np.arange(2, 20_001, 2), 20_002)
    i, j = ta.shared_ends(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert i.tolist() == [len(a) - 1] and j.tolist() == [len(b) - 1]


def test_query_matches_plain_python(spark, plain):
    from flowlab.llm.queries import op11_token_alignment
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = op11_token_alignment(spark, "/root/testdata/sf0.001")
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    want = dict(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows], plain)))
    assert result(got) == [want[i] for i in ids] and len(ids) == len(rows)


def test_odd_rows(odd, rows, empty, plain, monkeypatch):
    more = ["<s> a</s> <unk> <|endoftext|>", "▁▁ odd ▁", "tabs\t\tand\r\nends ", "漢字 and 🙂 and é́", "  two  blanks"]
    spark = odd.sparkSession
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(extra)
    want = expected([r[1] for r in rows] + more, plain)
    assert sorted(result(ta.scored_alignment(both, **FILES))) == sorted(want)
    assert sorted(result(ta.scored_alignment(both, **{k: FILES[k] for k in ("vocab", "pieces")}))) == sorted(want)
    assert result(ta.scored_alignment(odd, **FILES))                       # extra columns with clashing names
    assert result(ta.scored_alignment(empty, **FILES)) == []
    monkeypatch.setattr(ta, "PART", 64)
    assert sorted(result(ta.scored_alignment(both, **FILES))) == sorted(want)


def test_pieces_with_an_escaped_blank_have_no_tokens(plain):
    assert plain("▁▁ odd ▁") == ([], [], [])         # the piece model gives a blank back


def test_tokens_of_the_groups(odd, plain):
    found = ta.align(odd, **FILES, tokens=True).collect()
    for r in found:
        a, b, groups = plain(odd.sparkSession.createDataFrame([(r["doc_id"],)], "doc_id long").join(
            odd.select("doc_id", "text"), "doc_id").first()["text"]) if r["doc_id"] in (6, 9) else (None, None, None)
        if a is not None:
            assert (r["a_ids"], r["b_ids"]) == (a, b)
            assert r["a_sizes"] == [len(g[0]) for g in groups] and r["b_sizes"] == [len(g[1]) for g in groups]


def test_linked_pairs_are_suffixes(tables):
    width = len(tables.b)
    rng = random.Random(2)
    for key in rng.sample(tables.pairs.tolist(), 2000):
        a, b = tables.a[key // width], tables.b[key % width]
        assert a.endswith(b) or b.endswith(a)
    known = set(tables.pairs.tolist())
    for _ in range(2000):
        i, j = rng.randrange(len(tables.a)), rng.randrange(width)
        a, b = tables.a[i], tables.b[j]
        assert (a.endswith(b) or b.endswith(a)) == (i * width + j in known)
