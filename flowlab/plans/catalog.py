"""Registered queries: one Spark job per operator, each with (where SQL can
express it) an equivalent DuckDB statement used as the correctness oracle.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables.  Double outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double (and array<double>) column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: no_negative_zero(v[1]) for k, v in REGISTRY.items() if v[1] is not None}


def no_negative_zero(sql: str) -> str:
    """DuckDB's round() keeps the sign of a tiny negative value (-0.0) while
    Spark's decimal rounding gives 0.0: wrap every ``round(...)`` as
    ``(round(...) + 0.0)`` so both engines emit the same bits."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = no_negative_zero(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + CAST(0 AS DOUBLE))")
        i = k + 1


def _load_all() -> None:
    # importing the modules registers their queries
    from flowlab.plans import q_embed, q_eval, q_flows, q_io, q_models, q_pipeline, q_stream, q_train  # noqa: F401
