"""Alignment of two tokenizers over the same text by divide and conquer.

A (byte-level BPE) reads a blank and the text, B (a piece model that adds the
blank itself) reads the text; both give the same bytes, so every token has an
end in the same byte coordinate.  An interval of tokens is divided at a common
end near its middle: the end of the middle A token is looked up among B's ends
by bisection, B's next end among A's and so on, first to the right, then to
the left.  Both halves are divided further; an interval without a common end
inside is a leaf: one group of tokens that can't be cut.  All intervals of a
level are divided together, over every text of an Arrow batch.

The tokens that end together at a cut are linked.  One of the two is then a
suffix of the other, so the id pairs that can be linked at all follow from the
vocabularies (``Tables.pairs``, 324,302 for the two public ones); corpus
counts are a vector of that size, whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import small_batches, utf8
from flowlab.session import ensure_checkpoint_dir

PART = 1 << 20          # bytes of text aligned together (a longer text by itself)
ROWS = 256              # rows of an Arrow batch

# letters, digits and signs up to U+024F: both byte-level libraries cut them alike
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the other
    bytes, in order, as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tables:
    """Token bytes of both vocabularies and the pairs that can be linked."""

    def __init__(self, vocab: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        letters = byte_alphabet()
        a = Tokenizer.from_file(vocab)
        special = set(a.get_added_tokens_decoder())
        self.a = [b""] * (max(a.get_vocab().values()) + 1)
        for token, i in a.get_vocab().items():
            # a special token never comes out of a text, so it needs no bytes
            self.a[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        b = SentencePieceProcessor(model_file=pieces)
        self.b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        if not all(self.a) or not all(self.b):
            raise ValueError("a token without bytes has no place in the text")

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted keys (A id * len(b) + B id) of the pairs whose bytes can end
        together: one is a suffix of the other."""
        a, b = self._ids(self.a), self._ids(self.b)
        keys = {i * len(self.b) + j for x, ids in a.items() for k in range(len(x)) for j in b.get(x[k:], ()) for i in ids}
        keys |= {i * len(self.b) + j for x, ids in b.items() for k in range(len(x)) for i in a.get(x[k:], ()) for j in ids}
        return np.array(sorted(keys), np.int64)

    @staticmethod
    def _ids(tokens: list[bytes]) -> dict[bytes, list[int]]:
        """Ids by bytes: two ids of a vocabulary may have the same."""
        out: dict[bytes, list[int]] = {}
        for i, x in enumerate(tokens):
            out.setdefault(x, []).append(i)
        return out


class Encoders:
    """Ids of a text under A and B.  Plain texts go through ``ranks``, A's
    vocabulary for a faster library; the others through A's own."""

    def __init__(self, vocab: str, pieces: str, ranks: str | None = None, pattern: str | None = None):
        from sentencepiece import SentencePieceProcessor
        self.vocab, self.quick = vocab, None
        self.b = SentencePieceProcessor(model_file=pieces)
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def full(self):
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(self.vocab)
        t.encode_special_tokens = True          # their strings in a text are plain text
        return t

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        quick = self.quick is not None and _PLAIN.fullmatch(text)
        a = self.quick.encode_ordinary(" " + text) if quick else self.full.encode(" " + text, add_special_tokens=False).ids
        return a, self.b.encode(text)


def shared_ends(a: np.ndarray, b: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes (i, j), ascending, of every common end ``a[i] == b[j]``.
    ``a`` and ``b`` ascend; row r has the tokens ``a_rows[r]:a_rows[r + 1]``
    and ``b_rows[r]:b_rows[r + 1]``, at least one of each, and ends together."""
    # an interval: A tokens lo..hi and B tokens from..to, both ends inclusive, last tokens ending together
    lo, hi, at, to = a_rows[:-1], a_rows[1:] - 1, b_rows[:-1], b_rows[1:] - 1
    cuts_a, cuts_b = [hi], [to]
    while len(lo):
        inner = (lo < hi) & (at < to)
        lo, hi, at, to = lo[inner], hi[inner], at[inner], to[inner]
        middle = (lo + hi - 1) // 2
        i, j = _leap(a, b, middle, hi, 1)
        right = i < hi
        rest = np.flatnonzero(~right)           # nothing from the middle on
        if len(rest):
            i[rest], j[rest] = _leap(a, b, middle[rest] - 1, lo[rest] - 1, -1)
        found = i >= lo
        lo, hi, at, to, i, j, right = (x[found] for x in (lo, hi, at, to, i, j, right))
        cuts_a.append(i)
        cuts_b.append(j)
        # left halves, and right halves unless they are known to have no cut
        halves = [np.stack([lo, i + 1], 1), np.stack([i, hi], 1), np.stack([at, j + 1], 1), np.stack([j, to], 1)]
        more = np.stack([np.ones(len(i), bool), right], 1).ravel()
        lo, hi, at, to = (x.ravel()[more] for x in halves)
    i, j = np.concatenate(cuts_a), np.concatenate(cuts_b)
    return np.sort(i), np.sort(j)


def _leap(a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The first common end from ``a[start]`` on in direction ``step``, as
    (i, j); i is at or past ``stop`` where there is none before it."""
    i, j = start.copy(), np.zeros(len(start), np.int64)
    live = np.flatnonzero((stop - i) * step > 0)
    side, back = ("left", 0) if step > 0 else ("right", 1)
    while len(live):
        ends = a[i[live]]
        k = np.searchsorted(b, ends, side) - back
        ok = k >= 0                             # leftwards there may be no end of B any more
        j[live] = k
        met = ok & (b[k] == ends)
        nxt = np.where(ok, np.searchsorted(a, b[k], side) - back, -1)
        i[live] = np.where(met, i[live], nxt)
        live = live[~met & ((stop[live] - nxt) * step > 0)]
    return i, j


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass PART bytes."""
    for batch in batches:
        _, at = utf8(batch.column(1))
        part = (at[:-1] - at[0]) // PART if batch.num_rows else at[:0]
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:]))


def _bounds(counts: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def align(docs: DataFrame, vocab: str, pieces: str, ranks: str | None = None, pattern: str | None = None,
          id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, tables: Tables | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, groups_sha256, and
    its links as ``pairs`` (places in ``Tables.pairs``) with ``times``; with
    ``tokens`` also a_ids, b_ids and, per group, the number of its tokens
    (a_sizes, b_sizes).

    Null and empty texts have no tokens, nor have texts that a tokenizer
    doesn't give back byte for byte: zeros, '' and empty arrays.  Texts of any
    length are read whole; repeated rows are aligned alike, extra columns are
    ignored, an empty table gives no rows."""
    known = tables or Tables(vocab, pieces)
    width = len(known.b)
    names = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
    kinds = ["", "bigint", "bigint", "bigint", "string", "array<int>", "array<int>"]
    if tokens:
        names += ["a_ids", "b_ids", "a_sizes", "b_sizes"]
        kinds += ["array<int>"] * 4
    token_bytes = docs.sparkSession.sparkContext.broadcast((known.a, known.b, known.pairs))      # vocabulary-sized

    def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_bytes, b_bytes, pairs = token_bytes.value
        encoders = Encoders(vocab, pieces, ranks, pattern)
        a_len, b_len = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
        # written forms of every id with what can follow it: inside a list, end of A's, end of B's, end of the text
        forms = [f"{i}{end}".encode() for i in range(max(len(a_bytes), width)) for end in (",", "|", ";", "")]
        for batch in _parts(batches):
            a_rows, b_rows = [], []
            for text in batch.column(1).to_pylist():
                a, b = encoders.ids(text) if text else ([], [])
                if text:
                    whole = b" " + text.encode()
                    if b"".join([a_bytes[i] for i in a]) != whole or b"".join([b_bytes[i] for i in b]) != whole:
                        a, b = [], []
                a_rows.append(np.array(a, np.int64))
                b_rows.append(np.array(b, np.int64))
            rows = batch.num_rows
            a_at, b_at = _bounds([len(x) for x in a_rows]), _bounds([len(x) for x in b_rows])
            a, b = (np.concatenate([np.zeros(0, np.int64), *r]) for r in (a_rows, b_rows))
            del a_rows, b_rows
            full = np.flatnonzero(np.diff(a_at))
            # rows without tokens take no place; the others have as many bytes under A as under B
            i, j = shared_ends(np.cumsum(a_len[a]), np.cumsum(b_len[b]), np.append(a_at[full], a_at[-1]),
                               np.append(b_at[full], b_at[-1]))
            g_at = np.concatenate([[0], np.searchsorted(i, a_at[1:])])
            # A's tokens of a group come before B's: every token moves by the other side's tokens before it
            ends = np.zeros(len(a) + len(b), np.int64)
            ids = np.empty(len(a) + len(b), np.int64)
            a_sizes, b_sizes = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
            ids[np.arange(len(a)) + np.repeat(j + 1 - b_sizes, a_sizes)] = a
            ids[np.arange(len(b)) + np.repeat(i + 1, b_sizes)] = b
            ends[i + j + 1 - b_sizes] = 1
            ends[i + j + 1] = 2
            ends[(a_at + b_at)[full + 1] - 1] = 3
            codes = ids * 4 + ends
            digests = []
            for r in range(rows):
                part = codes[a_at[r] + b_at[r]:a_at[r + 1] + b_at[r + 1]].tolist()
                digests.append(hashlib.sha256(b"".join([forms[c] for c in part])).hexdigest() if part else "")
            # links of a row by pair
            row = np.repeat(np.arange(rows), np.diff(g_at))
            linked, times = np.unique(row * (len(a_bytes) * width) + a[i] * width + b[j], return_counts=True)
            row, key = np.divmod(linked, len(a_bytes) * width)
            place = np.searchsorted(pairs, key)
            if len(key) and not (pairs[np.minimum(place, len(pairs) - 1)] == key).all():
                raise ValueError("linked tokens whose bytes can't end together")
            p_at = np.concatenate([[0], np.searchsorted(row, np.arange(rows), "right")])
            columns = [batch.column(0), pa.array(np.diff(a_at)), pa.array(np.diff(b_at)), pa.array(np.diff(g_at)),
                       pa.array(digests, pa.string()), lists(place, p_at), lists(times, p_at)]
            if tokens:
                columns += [lists(a, a_at), lists(b, b_at), lists(a_sizes, g_at), lists(b_sizes, g_at)]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds[0] = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, tables: Tables) -> np.ndarray:
    """How many links of the whole corpus hold each pair of ``Tables.pairs``;
    what reaches the driver is at most one number a pair."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    found = links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")).toPandas()
    counts = np.zeros(len(tables.pairs), np.int64)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def link_scores(aligned: DataFrame, tables: Tables) -> DataFrame:
    """``aligned`` without its links, plus n_links, n_best (links whose pair has
    the highest count of its B id) and count_sum (their counts, added up).
    ``aligned`` is read twice, so it should be a stored table."""
    counts = pair_counts(aligned, tables)
    piece = tables.pairs % len(tables.b)
    top = np.zeros(len(tables.b), np.int64)
    np.maximum.at(top, piece, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == top[piece]))         # vocabulary-sized
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            pairs, times = batch.column(len(kept)), batch.column(len(kept) + 1)
            at = pairs.offsets.to_numpy().astype(np.int64)
            pair = pairs.values.to_numpy()[at[0]:at[-1]]
            n = times.flatten().to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)])[at - at[0]] for x in (n, n * best[pair], n * counts[pair])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *[pa.array(np.diff(s)) for s in sums]],
                                             [*kept, "n_links", "n_best", "count_sum"])

    head = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    rows = aligned.select(*kept, "pairs", "times")
    return rows.mapInArrow(run, f"{head}, n_links bigint, n_best bigint, count_sum bigint")


def scored_alignment(docs: DataFrame, vocab: str, pieces: str, ranks: str | None = None, pattern: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with ``link_scores``.  The alignment is tokenised once and
    written to the shared checkpoint folder, because the counts need the whole
    corpus before any row can be scored."""
    spark = docs.sparkSession
    tables = Tables(vocab, pieces)
    path = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4()}"
    with small_batches(spark, ROWS):
        align(docs, vocab, pieces, ranks, pattern, id_col, text_col, tables=tables).write.option(
            "compression", "zstd").parquet(path)
    return link_scores(spark.read.parquet(path), tables)
