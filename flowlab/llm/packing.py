"""Best-fit packing of tokenised documents by bin completion.

Documents become token pieces of at most ``capacity`` ids.  Only the number of
pieces of each length matters for the packing, so the search runs on a
histogram of ``capacity`` counts: take the largest length that is left,
enumerate the undominated fillings of the space beside it, apply one, as often
as the counts allow or less often, and go on.  Branch and bound over fillings
and multiplicities prunes by waste and by the lower bound of what is left;
best-fit decreasing gives the first incumbent and the lower bounds end the
search.  The result is a list of patterns with multiplicities; every piece
then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import cut_texts

CAPACITY = 1024
EOS = 2
NODES = 400              # patterns the search applies besides two a length, dives included
STEPS = 1_000_000        # pieces the search lays while it enumerates fillings

Pattern = tuple[tuple[int, ...], int]      # lengths of one sequence, how many of them


# ---------------------------------------------------------------- tokens

# letters, digits and signs up to U+024F: both tokenizer libraries cut them alike
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")


class Encoder:
    """Ids of the byte-level BPE in ``vocab`` (tokenizers JSON).  Plain texts go
    through ``ranks``, the same vocabulary for a faster encoder; texts with
    other characters or a special token's string go through tokenizers."""

    def __init__(self, vocab: str, special: list[str], ranks: str | None, pattern: str | None):
        self.vocab, self.special = vocab, special
        self._full = self.quick = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @staticmethod
    def special_tokens(vocab: str) -> list[str]:
        from tokenizers import Tokenizer
        return [t.content for t in Tokenizer.from_file(vocab).get_added_tokens_decoder().values()]

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer
            self._full = Tokenizer.from_file(self.vocab)
        return self._full

    def ids(self, text: str) -> np.ndarray:
        if self.quick is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(docs: DataFrame, vocab: str, ranks: str | None = None, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 eos: int = EOS) -> DataFrame:
    """id, piece, start, length and ids (binary, little-endian unsigned 32-bit)
    of the pieces of every row: the ids of its text and then ``eos``.  A
    document longer than ``capacity`` is cut from its end, so only the first
    piece may be shorter.  Null text counts as empty (one piece, ``eos``)."""
    special = Encoder.special_tokens(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab, special, ranks, pattern)
        for batch in batches:
            at, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encoder.ids(text.as_py() or ""), np.array([eos], "<u4"))
                first = (len(tokens) - 1) % capacity + 1
                borders = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(tokens[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, piece int, start bigint, length bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- search

def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2 bound on the number of sequences."""
    c = len(counts) - 1
    n, s = np.cumsum(counts), np.cumsum(counts * np.arange(c + 1))
    k = np.arange(1, c // 2 + 1)
    large, middle = n[c] - n[c - k], n[c - k] - n[c // 2]
    free = middle * c - (s[c - k] - s[c // 2])
    small = s[c // 2] - s[k - 1]
    more = large + middle + np.maximum(0, -(-(small - free) // c))
    return max(-(-int(s[c]) // c), int(more.max(initial=0)))


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing on the histogram: beside the largest length left
    goes, again and again, the largest one that fits."""
    left, out = counts.copy(), []
    for top in range(len(counts) - 1, 0, -1):
        while left[top]:
            fill = greedy(left, top)
            out.append(apply(left, fill))
    return out


def greedy(left: np.ndarray, top: int) -> tuple[int, ...]:
    fill, space, used = [top], len(left) - 1 - top, {top: 1}
    k = min(space, top)
    while k > 0:
        if left[k] - used.get(k, 0) > 0:
            fill.append(k)
            used[k] = used.get(k, 0) + 1
            space -= k
            k = min(space, k)
        else:
            k -= 1
    return tuple(fill)


def apply(left: np.ndarray, fill: tuple[int, ...]) -> Pattern:
    """Take the filling as often as the counts allow."""
    need = {k: fill.count(k) for k in set(fill)}
    times = min(int(left[k]) // m for k, m in need.items())
    for k, m in need.items():
        left[k] -= m * times
    return fill, times


def bits(there: np.ndarray) -> int:
    """The true places of ``there`` as bits of one integer."""
    return int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")


def dominated(beside: tuple[int, ...], waste: int, others: int) -> bool:
    """True if a length of ``others`` (bits) can stand in for some of the lengths
    ``beside``: their sum fits into it, and it fits into their room and the waste."""
    one, more = 0, 0                       # sums of one piece, and of several
    for x in beside:
        more |= (one | more) << x
        one |= 1 << x
    # an equal single piece is no change, every other sum up to ``waste`` below a length is one
    larger = shifted(one | more | 1, waste) if waste else 0
    return bool(others & (more | larger))


def shifted(sums: int, waste: int) -> int:
    """The sums plus 1 .. ``waste``."""
    out, width = sums << 1, 1
    while width < waste:
        step = min(width, waste - width)
        out |= out << step
        width += step
    return out


class Spent(Exception):
    """The search has used up its steps."""


def fillings(left: np.ndarray, top: int, after: tuple | None = None, steps: list[int] | None = None
             ) -> Iterator[tuple[int, ...]]:
    """All undominated fillings beside one piece of length ``top``, found one by
    one: least waste first, then the fewest pieces, then the largest.  Those up
    to ``after`` in this order are left out.  ``steps`` holds the number of
    steps that may still be taken; Spent is raised when it runs out."""
    space = len(left) - 1 - top
    have = left.copy()
    have[top] -= 1
    have[0] = 0
    there = np.flatnonzero(have[:space + 1] > 0).tolist()
    all_bits = bits(have[:space + 1] > 0)
    steps = [1 << 62] if steps is None else steps
    reach = [1]                            # sums of k pieces, however often each is there
    full = (1 << (space + 1)) - 1
    low = there[0] if there else space + 1
    used: dict[int, int] = {}

    def take(n: int) -> None:
        steps[0] -= n
        if steps[0] < 0:
            raise Spent

    def parts(total: int, k: int, largest: int) -> Iterator[tuple[int, ...]]:
        take(1)
        if k == 0:
            yield ()
            return
        hi = bisect.bisect_right(there, min(largest, total - (k - 1) * low))
        for x in reversed(there[bisect.bisect_left(there, -(-total // k)):hi]):
            for n in range(min(k, total // x, int(have[x])), 0, -1):
                if reach[k - n] >> (total - n * x) & 1:
                    used[x] = n
                    for rest in parts(total - n * x, k - n, x - 1):
                        yield (x,) * n + rest
                    used[x] = 0

    for total in range(space, -1, -1):
        take(1 + total // low // 64)
        if after is not None and total < after_total(after):
            after = None
        if after is not None and total > after_total(after):
            continue
        for k in range(0 if total == 0 else 1, (total // low if total else 0) + 1):
            while len(reach) <= k:
                take(1 + len(there) // 64)
                sums = 0
                for x in there:
                    sums |= reach[-1] << x
                reach.append(sums & full)
            if not reach[k] >> total & 1 or after is not None and k < len(after) - 1:
                continue
            for beside in parts(total, k, space):
                if after is not None and (k, tuple(-x for x in beside)) <= (len(after) - 1, tuple(-x for x in after[1:])):
                    continue
                others = all_bits
                for x, n in used.items():
                    if n >= have[x]:
                        others &= ~(1 << x)
                if not dominated(beside, space - total, others):
                    yield (top, *beside)


def after_total(filling: tuple[int, ...]) -> int:
    return sum(filling[1:])


def multiplicities(most: int) -> Iterator[int]:
    """``most``, its halves, and then every other number down to 1."""
    halves = []
    n = most
    while n:
        halves.append(n)
        n //= 2
    yield from halves
    yield from (n for n in range(most - 1, 0, -1) if n not in halves)


def choices(left: np.ndarray, top: int, after: tuple | None, steps: list[int]) -> Iterator[Pattern]:
    for fill in fillings(left, top, after, steps):
        most = min(int(left[k]) // fill.count(k) for k in set(fill))
        for times in multiplicities(most):
            yield fill, times


def solve(counts: np.ndarray) -> list[Pattern]:
    """Patterns with multiplicities that hold exactly the pieces of ``counts``
    (index: length).  Depth first over filling and multiplicity; the fillings
    beside equal lengths are taken in one order only.  Ends at the lower bound,
    when nothing is left to try, or after NODES patterns or STEPS steps."""
    counts = np.asarray(counts, np.int64)
    c, bound = len(counts) - 1, lower_bound(counts)
    lengths = np.arange(c + 1)
    total = int((counts * lengths).sum())
    best = best_fit(counts)
    size = sum(t for _, t in best)
    nodes, steps = NODES + len(counts) * 2, [STEPS]
    # a frame is (counts, free room of the sequences so far, sequences, patterns, what can follow)
    stack = []

    def enter(left: np.ndarray, waste: int, used: int, made: int, after: tuple | None) -> None:
        top = int(np.flatnonzero(left)[-1])
        after = after if after is not None and after[0] == top else None
        stack.append((left, waste, used, made, choices(left, top, after, steps)))

    made: list[Pattern] = []
    if size > bound:
        enter(counts.copy(), 0, 0, 0, None)
    try:
        while stack and size > bound and nodes > 0:
            left, waste, used, depth, options = stack[-1]
            slack = (size - 1) * c - total
            fill, times = next(options, (None, 0))
            if fill is None or waste + c - sum(fill) > slack:      # the later ones waste as much at least
                stack.pop()
                continue
            now, spent = used + times, waste + times * (c - sum(fill))
            if spent > slack:
                continue
            nodes -= 1
            del made[depth:]
            made.append((fill, times))
            rest = left.copy()
            for k in set(fill):
                rest[k] -= times * fill.count(k)
            if not rest.any():
                if now < size:
                    best, size = list(made), now
            elif now + lower_bound(rest) < size:
                enter(rest, spent, now, depth + 1, fill)
    except Spent:
        pass
    return best


# ---------------------------------------------------------------- assignment

def slots(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Per length, consecutive ranges of ranks: (key of first rank, first
    sequence number, offset), keyed by length * 2**40 + rank."""
    taken = [0] * (capacity + 1)
    keys, first, offset = [], [], []
    sequence = 0
    for lengths, times in patterns:
        at = 0
        for length in lengths:
            keys.append((length << 40) + taken[length])
            first.append(sequence - taken[length])
            offset.append(at)
            taken[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    return {"key": np.array(keys, np.int64)[order], "first": np.array(first, np.int64)[order],
            "offset": np.array(offset, np.int64)[order]}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` (0, 1, ...) and ``offset`` to every row of
    ``pieces``, whose lengths lie in 1..capacity; rows of equal content are
    interchangeable.  ``pieces`` is read several times: pass a table that is
    written or checkpointed.  An empty table gives no rows."""
    spark = pieces.sparkSession
    hist = pieces.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()    # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in hist:
        counts[r[0]] = r[1]
    table = slots(solve(counts), capacity)
    # rank among the pieces of a length, in two levels so that a frequent length is spread
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    spread = pieces.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(parts)))
    local = spread.withColumn("_nth", F.row_number().over(
        Window.partitionBy(length_col, "_part").orderBy(*columns)) - 1)
    sizes = spread.groupBy(length_col, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length_col, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = local.join(sizes, [length_col, "_part"]).select(
        *columns, (F.col(length_col) * (1 << 40) + F.col("_before") + F.col("_nth")).alias("_key"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(table["key"], key, "right") - 1
            rank = key & ((1 << 40) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(table["first"][at] + rank), pa.array(table["offset"][at])],
                [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of every packed sequence; ``packed`` has the ``ids`` of its pieces."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))       # at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(joined.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, vocab: str, ranks: str | None = None, pattern: str | None = None,
                     id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS,
                     with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: id, piece, start, length, ids_crc32, sequence_id,
    offset, and the ids themselves if asked for.  The tokens are counted and
    their checksums taken in one pass over the texts; the piece table is
    checkpointed."""
    pieces = token_pieces(docs, vocab, ranks, pattern, id_col, text_col, capacity, eos)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut_texts(pieces if with_ids else pieces.drop("ids")), capacity)
