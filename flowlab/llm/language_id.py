"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit predicts that
bit from hashed byte trigrams.  A classifier is linear: the smoothed
log-odds of a trigram between the languages whose bit is 1 and those whose
bit is 0, averaged over the text.  Decoding sums a logistic loss over the
bits, weighted by how well each classifier does on the training rows of each
language, and takes the nearest codeword; a small gap to the second flags the
text as ambiguous.

Counts come from all training rows; what reaches the driver is bounded by
BUCKETS numbers a language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import cut_texts, small_batches, stay, utf8

BUCKETS = 1 << 14
CHUNK = 1 << 20            # bytes of one text that are looked at together
SHARP = 4.0                # slope of the logistic loss, per unit of mean log-odds
AMBIGUOUS = 0.02           # gap of the mean loss between the two nearest codewords
UNDETERMINED = "und"

# lower-case A-Z; digits, punctuation and white space become one separator
_FOLD = np.array([b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256)],
                 np.uint32)


def trigrams(part: np.ndarray) -> np.ndarray:
    """Bucket of every byte trigram of ``part`` (bytes), padded by separators."""
    x = np.empty(len(part) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = _FOLD[part]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)


def has_letter(part: np.ndarray) -> bool:
    low = part | 32
    if ((low >= 97) & (low <= 122) & (part < 128)).any():
        return True
    return bool((part >= 128).any()) and any(ch.isalpha() for ch in part.tobytes().decode("utf-8", "replace"))


def code_matrix(n: int) -> np.ndarray:
    """Codewords (-1/+1), one row a language: all distinct splits for up to
    seven languages, hashed bits (15 a doubling, no constant bit) beyond."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (n - 1) - 1)]
                         for i in range(n)], np.int8)
    bits, column = [], 0
    while len(bits) < 15 * int(np.ceil(np.log2(n))):
        word = [1 if hashlib.md5(f"{column}:{i}".encode()).digest()[0] & 1 else -1 for i in range(n)]
        column += 1
        if abs(sum(word)) < n:
            bits.append(word)
    return np.array(bits, np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray         # languages x bits
    weights: np.ndarray      # buckets x bits
    trust: np.ndarray        # languages x bits, rows sum to 1

    def margins(self, text: np.ndarray) -> np.ndarray:
        """Mean log-odds of every bit over the trigrams of the whole text."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, max(len(text), 1), CHUNK):
            # a chunk starts two bytes early, so no trigram is lost at its border
            ids = trigrams(text[max(0, at - 2):at + CHUNK])
            if len(ids) > BUCKETS // 4:
                total += np.bincount(ids, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights[ids].sum(axis=0)
            n += len(ids)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, gap) of each row of margins."""
        z = -SHARP * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, z) * self.trust[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        p = np.exp(-SHARP * (loss - loss.min(axis=1, keepdims=True)))
        score = p[np.arange(len(p)), best] / p.sum(axis=1)
        near = np.sort(loss, axis=1)
        gap = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, gap


def in_training(id_col: str, lang_col: str) -> Column:
    return held_out(id_col).eqNullSafe(False) & F.col(f"`{lang_col}`").isNotNull()


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (null id: null)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(in_training(id_col, lang_col) & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))


def _rows(batch: pa.RecordBatch):
    data, bounds = utf8(batch.column(batch.schema.get_field_index("text")))
    return [data[bounds[i]:bounds[i + 1]] for i in range(batch.num_rows)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the text and lang of all training rows (two passes: trigram
    counts, then the hits of every classifier by language)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _rows(batch)):
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for at in range(0, max(len(text), 1), CHUNK):
                    ids = trigrams(text[max(0, at - 2):at + CHUNK])
                    if len(ids) > BUCKETS // 4:
                        total += np.bincount(ids, minlength=BUCKETS)
                    else:
                        np.add.at(total, ids, 1)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(total[at])], ["lang", "bucket", "n"])

    rows = _training_rows(docs, id_col, text_col, lang_col)
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    # at most BUCKETS rows a language
    with small_batches(docs.sparkSession):
        table = counts.toPandas()
    languages = sorted(table["lang"].unique())
    freq = np.zeros((max(len(languages), 1), BUCKETS))
    index = {x: i for i, x in enumerate(languages)}
    freq[table["lang"].map(index).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    share = (freq + 0.5) / (freq + 0.5).sum(axis=1, keepdims=True)      # every language weighs the same
    code = code_matrix(len(languages)) if languages else np.ones((1, 1), np.int8)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            weights[:, b] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(code.shape, np.int64)
        seen = np.zeros(len(languages), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _rows(batch)):
                i = index[lang]
                hits[i] += model.margins(text) * code[i] > 0
                seen[i] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()), pa.array(seen), pa.array(hits.tolist(), pa.list_(pa.int64()))],
            ["lang", "seen", "hits"])

    if languages:
        sums = [F.sum(F.col("hits")[b]).alias(f"h{b}") for b in range(code.shape[1])]
        right = rows.mapInArrow(check, "lang string, seen bigint, hits array<bigint>").groupBy("lang").agg(
            F.sum("seen").alias("seen"), *sums)
        with small_batches(docs.sparkSession):
            right = right.toPandas()                                    # one row a language
        trust = np.full(code.shape, 1.0)
        for _, r in right.iterrows():
            trust[index[r["lang"]]] = [(r[f"h{b}"] + 1) / (r["seen"] + 2) for b in range(code.shape[1])]
        model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """id (or the columns ``keep``), lang_pred, score (0 to 1) and ambiguous of
    every row.  Null texts and texts without a letter get ``und`` and score 0;
    so does every text where no language was learned."""
    keep = [id_col] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model            # BUCKETS x bits numbers, sent with the task
        for batch in batches:
            null = np.asarray(batch.column(batch.num_columns - 1).is_null())
            rows = _rows(batch)
            live = [i for i, t in enumerate(rows) if m.languages and not null[i] and has_letter(t)]
            lang, score, vague = [UNDETERMINED] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), bool)
            if live:
                best, p, gap = m.decode(np.array([m.margins(rows[i]) for i in live]))
                score[live], vague[live] = p, gap < AMBIGUOUS
                for i, k in zip(live, best):
                    lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(vague)], [*batch.schema.names[:-1], "p", "s", "a"])

    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner)],
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner)
    out = rows.mapInArrow(run, f"{kept}, p string, s double, a boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, inner)], F.col("p").alias("lang_pred"),
                      F.col("s").alias("score"), F.col("a").alias("ambiguous"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told: neither ``und`` nor
    ambiguous.  Where ids are unique the few rejected ids are taken out, so
    texts need not come back from Python; where they repeat, every row is
    judged and passed on by itself."""
    model = fit(docs, id_col, text_col, lang_col)
    told = (F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")
    found = cut_texts(predict(docs, model, id_col, text_col).select(id_col, told.alias("kept")))
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return stay(docs, found, id_col)
    found = predict(docs, model, id_col, text_col, keep=docs.columns)
    return found.where(told).select(*[F.col(f"`{c}`") for c in docs.columns])
