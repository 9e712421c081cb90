"""Licence scan by a positional rare-token index (DataFrame operators only).

The templates below form an inverted index: word -> (template, position), with
common words left out.  One pass over the texts keeps the places of index
words only.  Their document frequencies give the IDF.  Each file looks up the
postings of its own highest-IDF words: of a template, as many of the words it
has as leave too little IDF behind for a match without any of them, and none if
all it has is too little or lacks a mandatory word.  The starts found (file
position minus template position) are verified: IDF share and mandatory phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.llm.common import ascii_lower, cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.6              # IDF share of a template that a place must match


@dataclass(frozen=True)
class Template:
    """``keys`` are the mandatory phrases; none named: the whole text."""
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


# fixed values: names and opening words of common licences
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("bsd", "bsd license"),
    Template("cc-by", "licensed under cc by", ("licensed", "cc")),
    Template("cc-by-nc", "licensed under cc by nc", ("licensed", "cc", "nc")),
    Template("cc-by-sa", "licensed under cc by sa", ("licensed", "cc", "sa")),
    Template("cc", "creative commons attribution", ("creative commons",)),
    Template("all-rights-reserved", "all rights reserved", ("rights reserved",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission", "hereby granted", "charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution", "binary forms")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission", "modify", "distribute")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
]
# fixed values: words of the templates that are too common for the index
COMMON = ["a", "all", "and", "any", "are", "by", "for", "free", "in", "into", "is", "of", "or", "person", "the", "this", "to",
          "under", "use", "with", "without"]


def postings(templates: list[Template]) -> list[tuple[int, str, int, bool]]:
    """(template, word, position, mandatory) of the index words."""
    out = []
    for t, template in enumerate(templates):
        words = template.text.split()
        needed: set[int] = set()
        for key in template.keys or (template.text,):
            k = key.split()
            at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
            needed.update(range(at, at + len(k)))
        out += [(t, w, i, i in needed) for i, w in enumerate(words) if w not in COMMON]
    return out


def places(docs: DataFrame, templates: list[Template], id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_words and ``hits``, the (position, word) of its index words."""
    vocabulary = sorted({w for _, w, _, _ in postings(templates)})
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS), "")
    found = F.array_compact(F.transform(words, lambda w, i: F.when(
        w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).select(
        "id", F.size(words).cast("long").alias("n_words"), found.alias("hits"),
        F.monotonically_increasing_id().alias("row"))


def index(spark: SparkSession, rows: DataFrame, templates: list[Template]) -> DataFrame:
    """The postings with their IDF, and all_idf and all_keys of their template."""
    table = postings(templates)
    n = rows.count()
    # one row a vocabulary word: the document frequencies of the index words
    df = dict(rows.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count().collect())
    scale = 1.0 + n
    idf = {w: scale / (1.0 + df.get(w, 0)) for _, w, _, _ in table}
    rows_ = [(t, templates[t].label, templates[t].base, w, i, m, idf[w]) for t, w, i, m in table]
    listed = spark.createDataFrame(rows_, "template int, label string, base boolean, word string, at int, "
                                          "mandatory boolean, idf double").withColumn("idf", F.log("idf"))
    whole = listed.groupBy("template").agg(F.sum("idf").alias("all_idf"),
                                           F.sum(F.col("mandatory").cast("int")).alias("all_keys"))
    return listed.join(whole, "template")


def probes(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(row, template, word, at): the postings a file starts its lookup from.
    The file's postings of a template are ranked by IDF; a place that matches
    SHARE of the template holds one of those from which on SHARE is left."""
    own = rows.select("row", F.explode(F.array_distinct(F.col("hits.word"))).alias("word"))
    ranked = Window.partitionBy("row", "template").orderBy(F.desc("idf"), "at")
    file = Window.partitionBy("row", "template")
    return own.join(F.broadcast(listed), "word").select(
        "row", "template", "word", "at", "all_idf", "all_keys",
        F.sum(F.col("mandatory").cast("int")).over(file).alias("keys"),
        F.sum("idf").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest")).where(
        (F.col("keys") == F.col("all_keys")) & (F.col("rest") >= F.col("all_idf") * (SHARE - 1e-9))).select(
        "row", "template", "word", "at")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[Template] | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_base, first_word, last_word,
    base_labels, labels (distinct, sorted, comma-joined) and score, the largest
    IDF share of a template found.  Null and empty texts have no words, labels
    "" and score 0.  Repeated rows are kept, each with its own result; extra
    columns are ignored; an empty table gives no rows."""
    templates = TEMPLATES if templates is None else templates
    rows = cut(places(docs, templates, id_col, text_col))
    listed = index(docs.sparkSession, rows, templates)
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    starts = hits.join(probes(rows, listed), ["row", "word"]).select(
        "row", "template", (F.col("pos") - F.col("at")).alias("start")).distinct()
    # the index has one row per template word, so its size is that of the list above
    met = starts.join(F.broadcast(listed), "template").withColumn("pos", F.col("start") + F.col("at")).join(
        hits, ["row", "pos", "word"]).groupBy("row", "template", "label", "base", "start").agg(
        F.sum("idf").alias("idf"), F.sum(F.col("mandatory").cast("int")).alias("keys"),
        F.first("all_idf").alias("all_idf"), F.first("all_keys").alias("all_keys"))
    share = F.when(F.col("all_idf") > 0, F.least(F.col("idf") / F.col("all_idf"), F.lit(1.0))).otherwise(F.lit(1.0))
    good = met.withColumn("share", share).where((F.col("keys") == F.col("all_keys")) & (F.col("share") >= SHARE))
    base = F.col("base")

    def names(only=None):
        c = F.col("label") if only is None else F.when(only, F.col("label"))
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    per_row = good.groupBy("row").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), names(base).alias("base_labels"),
        names().alias("labels"), F.max("share").alias("score"))
    return rows.select("row", "id", "n_words").join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word",
        "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
