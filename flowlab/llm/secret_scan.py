"""Secret scan: one deterministic automaton for all rules (``automaton``),
one pass over the bytes of every text, then an exact check of each span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.automaton import Rule, compiled
from flowlab.llm.common import CONTINUATION, utf8

BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ignore_case=True, min_length=8, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=16),
    # a run below 8 can't pass; counting on to 32 in the automaton would only multiply its states
    Rule("hex", r"[0-9a-f]{8,}", min_length=32),
]
EXTRA_RULES = [
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_length=20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_length=40),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]
BASE = [r.name for r in BASE_RULES]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: list[Rule] | None = None) -> DataFrame:
    """Return id and ``spans``: array of (kind, start, end), in code points, end
    exclusive, ordered by start, then kind as listed; every row once.

    Null and empty texts have no spans.  Whole texts of any length are read, in
    time in proportion to it.  Repeated rows are scanned alike and kept.  Extra columns are ignored; an empty table gives no rows."""
    rules = BASE_RULES + EXTRA_RULES if rules is None else rules
    machine = compiled(tuple(rules))         # some 2 MB, sent with the task
    names = [r.name for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if batch.num_rows and bounds[-1] > bounds[0]:
                pos, mask = machine.scan(data, bounds)
                row = np.searchsorted(bounds, pos, "right") - 1
                cuts = np.flatnonzero(np.diff(row)) + 1
                for at, ends, bits in zip(np.split(row, cuts), np.split(pos, cuts), np.split(mask, cuts)):
                    if not len(at):
                        continue
                    i = int(at[0])
                    lo = int(bounds[i])
                    text = data[lo:int(bounds[i + 1])].tobytes()
                    ascii_only = text.isascii()
                    points = (lambda b: b) if ascii_only else (lambda b, t=text: len(t[:b].translate(None, CONTINUATION)))
                    found[i] = [{"kind": names[k], "start": points(s), "end": points(e)}
                                for s, k, e in machine.spans(text, ends - lo, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)
