"""Quality rules as a bitmask ledger.

Every text is measured once and every rule evaluated once: the ledger holds
the measurements and ``fail_bits`` (bit i set: rule i fails).  Policies are
versioned masks over those bits, so a new policy, or the ablation of a rule,
reads only the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import CONTINUATION, utf8

WINDOW = 5
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _UPPER + bytes(range(97, 123))
# letters and non-ASCII bytes become 'a', white space a blank; the rest is deleted
_SHAPE = bytes(97 if (b >= 128 or chr(b).isalpha()) else 32 if b in _SPACE else b for b in range(256))
_REST = bytes(b for b in range(128) if not chr(b).isalpha() and b not in _SPACE)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
            "n_letter_words", "n_marks"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int32)
    steps[:n] += twice
    steps[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()                     # bytes.split: the six ASCII white-space characters
    bare = text.translate(None, _SPACE)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), len(bare.translate(None, CONTINUATION)), len(bare) - len(bare.translate(None, _SYMBOLS)), dup,
            repeated_words(words), lines, len(bare) - len(bare.translate(None, _ASCII_LETTERS)),
            len(bare) - len(bare.translate(None, _UPPER)), len(text.translate(_SHAPE, _REST).split()),
            bare.count(b"!") + bare.count(b"?"))


@dataclass(frozen=True)
class QualityRule:
    """Fails where ``fails`` (SQL over the measurements) is true."""
    name: str
    fails: str


RULES = [
    QualityRule("few_words", "n_words < 10"),
    QualityRule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    QualityRule("symbols", "100 * n_symbols > 30 * n_words"),
    QualityRule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    QualityRule("shouting", "100 * n_upper > 40 * n_letters"),
    QualityRule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    QualityRule("few_letter_words", "100 * n_letter_words < 50 * n_words"),
    QualityRule("marks", "100 * n_marks > 30 * n_words"),
]
BASE = ("few_words", "repeated_windows")
# version -> rules that it applies
POLICIES = {
    "base": BASE,
    "v1": BASE + ("symbols", "repeated_lines", "shouting"),
    "v2": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...] | list[str]) -> int:
    number = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << number[n] for n in set(names))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements (long) and ``fail_bits`` (long) of every row.

    Null and empty texts have zero words and fail ``few_words``; ratios are
    written as products, so nothing divides by zero.  Repeated rows are kept;
    extra columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            found = [measure(data[bounds[i]:bounds[i + 1]].tobytes()) for i in range(batch.num_rows)]
            columns = np.array(found, np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], ["id", *MEASURES])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total.cast("long")).withColumnRenamed("id", id_col)


def passes(policy: str, fail_bits: Column | str = "fail_bits") -> Column:
    """True where no rule of the policy fails."""
    c = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return c.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(found: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects and
    rows kept without it.  Works on (fail_bits, count), at most 2**rules rows."""
    m = mask(POLICIES[policy])
    groups = found.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit"))
                      for n in POLICIES[policy]])
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"))
