from __future__ import annotations

import pytest
from pyspark.sql import types as T

# doc_id, text, lang, source, and columns whose names clash with the operators' own
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("id", T.StringType()), T.StructField("key", T.LongType()),
    T.StructField("digest", T.StringType()), T.StructField("n", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("node", T.LongType()), T.StructField("label", T.StringType()), T.StructField("length", T.LongType()),
])

EN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from above the old barn"
LONG = "\n".join(f"line {i} of a long text with words {i * 7919 % 1000} and {i * 104729 % 997} in it" for i in range(3000))
TEXTS = [
    None, "", " ", "\n\n\n", "a", "Zwölf Boxkämpfer", EN, EN.upper(), EN + " again", LONG, LONG, "x" * 50_000,
    "a b c d e", "A B C D E", "a b c d", "one two\nthree four\nfive six\nseven", "one two\nthree four\nfive six\neight",
    "password = hunter2hunter2 and token: abc", "Released under the MIT License.", "no\x00control\x1fchars\x85here é　ü",
    "<|endoftext|> and  two  spaces \n and a tab\t", "12345 67890",
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], "x", 1, "d", 2, 3, 4, "l", 5)
           for i, t in enumerate(TEXTS)]
    out.append(out[6])                                     # a repeated row
    out.append((None, EN, None, None, "x", 1, "d", 2, 3, 4, "l", 5))
    return out


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
