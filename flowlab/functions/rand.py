"""Counter-based random draws (AU0): the same row gets the same value on any
partitioning, and DuckDB can reproduce it from the same md5."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2 ** 52)


def _parts(parts) -> list[Column]:
    return [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]


def uniform(*parts) -> Column:
    """u in [0, 1): leading 52 bits of md5(concat_ws('|', parts))."""
    h = F.md5(F.concat_ws("|", *_parts(parts)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO52)


def uniform_open(*parts) -> Column:
    """u in (0, 1): uniform shifted by half a step (safe for log)."""
    h = F.md5(F.concat_ws("|", *_parts(parts)))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO52)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two independent md5 streams."""
    u1 = uniform_open(*parts, "a")
    u2 = uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# DuckDB spellings of the same draws (for oracle SQL)
def sql_uniform(*parts: str) -> str:
    args = ", ".join(parts)
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {args})), 1, 13)) AS BIGINT) "
            f"/ CAST(4503599627370496 AS DOUBLE))")




# ---------------------------------------------------------------- streams
# One md5 per row seeds three MINSTD (Park-Miller) streams; element i of a
# stream is x_i = a^(i+1) * x_0 mod (2^31 - 1).  The jump-ahead multipliers
# a^(i+1) mod m come from a table for the first LOW elements and from products
# of two or three table entries beyond, so a vector may have any length; every
# step is a multiply and a modulo on 62-bit integers (no overflow, so ANSI mode
# and DuckDB agree).

MINSTD_M = 2 ** 31 - 1
MINSTD_A = 16807
LOW = 4096
_JUMPS = [pow(MINSTD_A, i + 1, MINSTD_M) for i in range(LOW)]
_HIGH = [pow(MINSTD_A, i * LOW, MINSTD_M) for i in range(LOW)]            # a^(LOW * i)
_TOP = [pow(MINSTD_A, i * LOW * LOW, MINSTD_M) for i in range(128)]       # up to 2^31 elements


def row_seeds(*parts) -> list[Column]:
    """Three stream seeds in [1, m - 1] from md5(concat_ws('|', parts))."""
    h = F.md5(F.concat_ws("|", *_parts(parts)))
    return [(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") % F.lit(MINSTD_M - 1) + F.lit(1))
            for k in range(3)]


def _literal(table: list[int]) -> Column:
    """A multiplier table as one array literal: a string that is split and cast
    when constants are folded, so the plan holds three nodes and not one for
    every element."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _jumps(n: Column) -> Column:
    """a^(i+1) mod m for i in 0 .. n-1."""
    m = F.lit(MINSTD_M)

    def block(b: Column) -> Column:
        """LOW multipliers from element LOW * b on."""
        high = (F.get(_literal(_HIGH), (b % LOW).cast("int")) * F.get(_literal(_TOP), F.floor(b / LOW).cast("int"))) % m
        return F.transform(_literal(_JUMPS), lambda low: (low * high) % m)

    blocks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / LOW))
    return F.when(n <= LOW, F.slice(_literal(_JUMPS), 1, n)).otherwise(
        F.slice(F.flatten(F.transform(blocks, block)), 1, n))


def stream_uniforms(seed: Column, n: Column) -> Column:
    """The first ``n`` draws u_i in (0, 1) of the stream started at
    ``seed``.  The seed enters through ``array_repeat`` so it is computed
    once per row, not once per element."""
    return F.zip_with(_jumps(n), F.array_repeat(seed, n),
                      lambda a, s: ((a * s) % F.lit(MINSTD_M)).cast("double") / F.lit(float(MINSTD_M)))


def stream_normals(s1: Column, s2: Column, n: Column) -> Column:
    """Box-Muller on two independent streams, ``n`` draws."""
    return F.zip_with(stream_uniforms(s1, n), stream_uniforms(s2, n),
                      lambda a, b: F.sqrt(F.lit(-2.0) * F.ln(a)) * F.cos(F.lit(2.0 * math.pi) * b))


def digest(*parts) -> Column:
    """The 16 bytes that ``row_seeds`` takes its seeds from, for ``batch_uniforms``."""
    return F.unhex(F.md5(F.concat_ws("|", *_parts(parts))))


def batch_seeds(digests) -> np.ndarray:
    """``row_seeds`` of an Arrow column of digests: one row of three a digest."""
    fixed = digests.cast(pa.binary(16))
    raw = np.frombuffer(fixed.buffers()[1], dtype=">u4").reshape(-1, 4)[fixed.offset:fixed.offset + len(fixed), :3]
    return raw.astype(np.int64) % (MINSTD_M - 1) + 1


def jump_table(n: int) -> np.ndarray:
    """a^(i+1) mod m for i in 0 .. n-1."""
    low = np.array(_JUMPS[:n], dtype=np.int64)
    return np.concatenate([low, *[low * _HIGH[b] % MINSTD_M for b in range(1, -(-n // LOW))]])[:n]


def batch_uniforms(seeds: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """``stream_uniforms`` of many rows, the same numbers: a row of draws a
    seed.  Modulo 2^31 - 1 by adding up the two halves, twice."""
    x = seeds[:, None] * jumps
    for _ in range(2):
        x = (x & MINSTD_M) + (x >> 31)
    return x / float(MINSTD_M)


def batch_normals(s1: np.ndarray, s2: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """``stream_normals`` of many rows."""
    return np.sqrt(-2.0 * np.log(batch_uniforms(s1, jumps))) * np.cos(2.0 * math.pi * batch_uniforms(s2, jumps))


def sql_row_seed(k: int, *parts: str) -> str:
    args = ", ".join(parts)
    return (f"((CAST(('0x' || substr(md5(concat_ws('|', {args})), {1 + 8 * k}, 8)) AS BIGINT) % {MINSTD_M - 1}) + 1)")


def sql_jumps(dim: int) -> str:
    return "[" + ", ".join(str(j) for j in _JUMPS[:dim]) + "]"


def sql_stream_uniform(seed: str, i1: str, dim: int = 128) -> str:
    """``i1`` is the 1-based element index (DuckDB lambdas); vectors up to
    ``dim`` elements."""
    return f"(CAST(((({sql_jumps(dim)})[{i1}]) * ({seed})) % {MINSTD_M} AS DOUBLE) / CAST({MINSTD_M} AS DOUBLE))"


def sql_stream_normal(s1: str, s2: str, i1: str, dim: int = 128) -> str:
    return (f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({sql_stream_uniform(s1, i1, dim)})) * "
            f"cos(CAST('{2.0 * math.pi!r}' AS DOUBLE) * {sql_stream_uniform(s2, i1, dim)}))")
