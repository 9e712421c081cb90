"""MinHash near-duplicates: universal hash minima, banding, signature
verification, exact verification on full sets, and connected components.

A text's set is its distinct shingles of five words.  Texts of the same words
form a class, and classes are what is compared.  The bands of a class's
minima put it into buckets.  Inside a bucket, classes that look alike by
signature are compared on their full sets, all at once by a product of
membership matrices, in blocks of bounded size that let out no more links than
they join components.  Two rounds: the first few bands join most groups; then
every bucket that still holds several components is compared in whole.  So a
pair of classes that shares a bucket is left undecided only if a path joins it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.llm.common import cut, cut_texts, stay, unused, utf8
from flowlab.llm.components import connected_components

SHINGLE = 5
PERCENT = 75              # similarity of a link, in hundredths
BANDS, ROWS = 32, 4       # a pair at 0.75 shares no band with probability 5e-6
NEAR = 0.58               # share of equal minima below which a pair can't be a link (4.5 standard deviations)
FIRST = 4                 # bands of the first round
BLOCK = 512               # classes of a bucket that are compared together
CELLS = 1 << 24           # entries of a membership matrix held at once
SMALL = 200_000           # classes whose (id, key) list may be broadcast

_RNG = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLIERS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]                               # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word and shingle hashes of a text's bytes, without a Python object per word."""

    def __init__(self):
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << int(n - 1).bit_length()
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inv, np.uint64)]), dtype=np.uint64)

    def words(self, text: np.ndarray) -> np.ndarray:
        """64-bit hash of every word: a polynomial over random byte values."""
        space = _IS_SPACE[text]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        start, end = edge[::2], edge[1::2]
        self._grow(len(text) + 1)
        total = np.empty(len(text) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[text] * self.powers[:len(text)], out=total[1:])
        return mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    @staticmethod
    def key(words: np.ndarray) -> bytes:
        """128-bit key of a word sequence; b"" without words."""
        return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else b""

    def shingles(self, text: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(sorted distinct shingle hashes, 128-bit key of the word sequence)."""
        w = self.words(text)
        if not len(w):
            return np.zeros(0, np.uint64), b""
        key = self.key(w)
        if len(w) < SHINGLE:
            return np.frombuffer(key[:8], np.uint64), key
        s = np.zeros(len(w) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            s += w[k:k + len(s)] * _STEP[k]
        return np.unique(mix(s)), key


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        v = np.multiply.outer(_MULTIPLIERS, shingles[at:at + 512])
        v += _ADDENDS[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * _BASE + low[r::ROWS])
    return key.view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    """A byte of every minimum, from its low end: unequal ones agree with
    probability 1/256, however small the minima of a large set are."""
    return (low & np.uint64(0xFF)).astype(np.uint8)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), key (16 bytes, null for an empty set), bands, sig per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            n, key, bands, sig = [], [], [], []
            for i in range(batch.num_rows):
                s, k = shingler.shingles(data[bounds[i]:bounds[i + 1]])
                n.append(len(s))
                key.append(k or None)
                low = minima(s) if len(s) else None
                bands.append(None if low is None else band_keys(low))
                sig.append(None if low is None else signature(low).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["id", "n", "key", "bands", "sig"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, n bigint, key binary, bands array<bigint>, sig binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, words) of the classes in ``wanted`` (node, id, key): their full
    shingle sets as bytes, from the text of the row with that id."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    side = wanted.select("node", F.col("id").alias("rep"), "key")
    side = F.broadcast(side) if wanted.count() <= SMALL else side
    held = rows.join(side, F.col("id").eqNullSafe(F.col("rep"))).select("node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            node, words = [], []
            for i in range(batch.num_rows):
                s, k = shingler.shingles(data[bounds[i]:bounds[i + 1]])
                if k == batch.column(1)[i].as_py():          # rows may share an id
                    node.append(batch.column(0)[i].as_py())
                    words.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(words, pa.binary())], ["node", "words"])

    return held.mapInArrow(run, "node bigint, words binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by their first ``keys`` columns, many at a
    time, with the borders of the groups."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        k = np.column_stack([rows.column(c).to_numpy() for c in range(keys)])
        ends = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(ends):
            yield rows.slice(0, int(ends[-1])), np.concatenate([[0], ends])
            rows = rows.slice(int(ends[-1]))
        held = rows
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def by_group(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run(batches)`` over rows whose groups are whole and sorted in each task."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def blocks_of(members: DataFrame) -> DataFrame:
    """Rows (key, x, y, node, label) of the buckets of ``members`` that hold
    several labels: a bucket is cut into blocks of about BLOCK classes, and
    every two blocks x <= y of it meet in one group.  Bands often hold the same
    classes; one bucket of them is taken."""
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                       F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"),
                                       F.min("node").alias("first")).where("lo < hi")
    once = mixed.groupBy("n", "who", "first").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.join(once.select("key", "n"), "key").select(
        "key", "node", "label", blocks.alias("k"), F.pmod(F.xxhash64("node"), blocks).alias("i"))
    met = dealt.select("key", "node", "label", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("j"))
    return met.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "node", "label")


def plausible(met: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows of ``met`` whose signature is near one of another label in the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches, 3):
            label = rows.column(4).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(len(label), -1)
            keep = np.zeros(len(label), bool)
            for a, b in zip(borders[:-1], borders[1:]):
                s, own = sig[a:b], label[a:b]
                for i in range(b - a):
                    near = ((s[i + 1:] == s[i]).mean(axis=1) >= NEAR) & (own[i + 1:] != own[i])
                    keep[a + i] |= near.any()
                    keep[a + i + 1:b] |= near
            yield from rows.filter(pa.array(keep)).drop_columns("sig").to_batches()

    return by_group(met.join(sigs.select("node", "sig"), "node").select("key", "x", "y", "node", "label", "sig"),
                    ["key", "x", "y"], run, "key bigint, x bigint, y bigint, node bigint, label bigint")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count >= 2                                   # the others are in no intersection
    column = np.cumsum(shared) - 1
    row, column = row[shared[where]], column[where][shared[where]]
    total, width = np.zeros((len(sets), len(sets))), max(1, CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        total += m @ m.T
    return total


def joins(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links between different labels, as many as join components."""
    size = np.array([len(s) for s in sets], float)
    both = common(sets)
    link = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    names, own = np.unique(label, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(link & (own[:, None] != own[None, :]), 1))):
        a, b = find(int(own[i])), find(int(own[j]))
        if a != b:
            parent[a] = b
            out.append((int(i), int(j)))
    return out


def links(members: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b), confirmed on the full sets, between classes of different
    labels that share a bucket of ``members`` (key, node, label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, borders in grouped(batches, 3):
            node, label, words = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5)
            a, b = [], []
            for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist()):
                if hi - lo > 1:
                    own = [np.frombuffer(w.as_buffer(), np.uint64) for w in words.slice(lo, hi - lo)]
                    for i, j in joins(own, label[lo:hi]):
                        a.append(node[lo + i])
                        b.append(node[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    near = plausible(blocks_of(members), sigs)
    return by_group(near.join(sets, "node").select("key", "x", "y", "node", "label", "words"), ["key", "x", "y"],
                    run, "a bigint, b bigint").distinct()


def relabel(label: DataFrame, new: DataFrame) -> DataFrame:
    """Merge the labels (node, label) along the links ``new``."""
    ends = new.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b")
    found = connected_components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("old", "component")
    return cut(label.join(found, F.col("label") == F.col("old"), "left").select(
        "node", F.coalesce("component", "label").alias("label")))


def linked(docs: DataFrame, id_col: str, text_col: str, trace: dict | None = None) -> DataFrame:
    """Per row of ``docs``: id, n, key (null without words), label (equal in a
    component, null without words), component_id and kept as in ``near_dedup``."""
    rows = cut_texts(signatures(docs, id_col, text_col))
    classes = cut(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"),
                                                         F.first("sig").alias("sig"))
                  .withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(shared.select("key"), "key"))
    label = cut(members.select("node").distinct().withColumn("label", F.col("node")))
    sets = cut_texts(shingle_sets(docs, classes.select("node", "id", "key").join(label.select("node"), "node"),
                            id_col, text_col).dropDuplicates(["node"]))
    sigs = classes.select("node", "sig")
    for part in (members.where(F.col("band") < FIRST), members):
        found = cut_texts(links(part.select("key", "node").join(label, "node"), sigs, sets))
        if trace is not None:
            trace[f"links{len(trace)}"] = found.count()
        if not found.isEmpty():
            label = relabel(label, found)
    owned = classes.select("node", "id", "key").join(label, "node", "left").select(
        "key", "id", F.coalesce("label", "node").alias("label"))
    component = owned.groupBy("label").agg(F.min("id").alias("component_id"))
    by_key = owned.join(component, "label").select(F.col("key").alias("k"), "label", "component_id")
    out = rows.select("id", "n", "key").join(by_key, F.col("key") == F.col("k"), "left")
    owner = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n", "key", "label", owner.alias("component_id"), F.col("id").eqNullSafe(owner).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trace: dict | None = None) -> DataFrame:
    """Return id, n_shingles, component_id, kept per row of ``docs``.

    ``component_id`` is the smallest id that links reach (null ids count only
    where there is no other); rows without words are linked with nothing and
    are their own component.  Of repeated rows (same id) every row is
    returned, ``kept`` marks those whose id is the component's.  ``trace``
    receives the sizes of the steps (each count is one more job)."""
    return linked(docs, id_col, text_col, trace).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keyed(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the key of the word sequence of every row (null without words) as column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            data, bounds = utf8(batch.column(batch.num_columns - 1))
            keys = [shingler.key(shingler.words(data[a:b])) or None for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())],
                                             [*batch.schema.names[:-1], name])

    rows = docs.withColumn(name, F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one a component.
    Where ids repeat, rows are told apart by id and word sequence; of the rows
    without words one stays for every id."""
    found = cut(linked(docs, id_col, text_col).select("id", "key", "label", "kept"))
    if found.groupBy("id").count().where("count > 1").isEmpty():
        return stay(docs, found.withColumnRenamed("id", id_col), id_col)
    # a component keeps one word sequence of its id, whatever else has that id
    words = found.where("kept AND key IS NOT NULL").groupBy("label").agg(F.min(F.struct("key", "id")).alias("one"))
    none = found.where("key IS NULL").select("id", "key").distinct()
    word_key, key_id, key = (unused(docs, name) for name in ("_word_key", "_id", "_key"))
    one = words.select("one.id", "one.key").unionByName(none).toDF(key_id, key)
    rows = cut_texts(keyed(docs, text_col, word_key))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key_id)) & F.col(word_key).eqNullSafe(F.col(key))
    return rows.join(one, same, "left_semi").dropDuplicates([id_col, word_key]).drop(word_key)
