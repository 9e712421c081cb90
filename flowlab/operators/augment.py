"""Row-wise augmentation (AU1-AU6) with counter-based draws: a row's noise
depends only on (seed, row id, element, view), never on partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.rand import (batch_normals, batch_seeds, batch_uniforms, digest, jump_table, row_seeds, stream_normals,
                                    stream_uniforms, uniform)
from flowlab.operators.models import arrow_lists, arrow_matrix


def noise(v: Column, row_id: Column, stddev: float = 0.05, view: str = "n", seed: int = 42,
          n: Column | None = None) -> Column:
    """AU1: x + N(0, stddev) per element (one md5 per row, integer streams
    per element).  ``n`` is the vector length when already known."""
    n = n if n is not None else F.size(v)
    s1, s2, _ = row_seeds(F.lit(seed), row_id, F.lit(view))
    return F.zip_with(v, stream_normals(s1, s2, n), lambda x, e: x.cast("double") + F.lit(stddev) * e)


def feature_mask(v: Column, row_id: Column, mask_prob: float = 0.1, view: str = "m", seed: int = 42,
                 n: Column | None = None) -> Column:
    """AU2: keep an element where u > mask_prob, else 0.  ``v`` is read
    once (its length can be passed as ``n``), so masking an expression does
    not evaluate that expression again."""
    n = n if n is not None else F.size(v)
    _, _, s3 = row_seeds(F.lit(seed), row_id, F.lit(view))
    return F.zip_with(v, stream_uniforms(s3, n), lambda x, w: F.when(w > F.lit(mask_prob), x.cast("double"))
                      .otherwise(F.lit(0.0)))


def weak(v: Column, row_id: Column, view: str = "w", seed: int = 42) -> Column:
    """AU3: sigma 0.02 noise."""
    return noise(v, row_id, 0.02, view, seed)


def strong(v: Column, row_id: Column, view: str = "s", seed: int = 42) -> Column:
    """AU4: sigma 0.1 noise, then masking with p = 0.2."""
    n = F.size(v)
    return feature_mask(noise(v, row_id, 0.1, view, seed, n), row_id, 0.2, view + "m", seed, n)


CELLS = 1 << 20     # numbers that a task draws at a time


def _requests(vec: str, views: dict[str, tuple[str, Column, str]], seed: int) -> list[Column]:
    """The vector and the digests that ``batch_views`` takes."""
    rows = [F.col(vec).cast("array<double>").alias("_fl_x")]
    for i, (kind, row_id, view) in enumerate(views.values()):
        rows.append(digest(F.lit(seed), row_id, F.lit(view)).alias(f"_fl_n{i}"))
        if kind == "strong":
            rows.append(digest(F.lit(seed), row_id, F.lit(view + "m")).alias(f"_fl_m{i}"))
    return rows


def view_seeds(kinds: list[str], *digests) -> np.ndarray:
    """All that is drawn for a row: the seeds of its views' streams, two for
    the noise and, for a strong view, a third for the mask."""
    at, out = iter(digests), []
    for kind in kinds:
        out.append(batch_seeds(next(at))[:, :2])
        if kind == "strong":
            out.append(batch_seeds(next(at))[:, 2:])
    return np.hstack(out)


def seeded_views(kinds: list[str], x: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """A matrix a view of the rows of ``x``, from ``view_seeds``."""
    jumps, step, at, out = jump_table(x.shape[1]), max(1, CELLS // max(x.shape[1], 1)), 0, []
    for kind in kinds:
        found = np.empty(x.shape)
        for lo in range(0, len(x), step):
            part = slice(lo, lo + step)
            v = x[part] + (0.1 if kind == "strong" else 0.02) * batch_normals(seeds[part, at], seeds[part, at + 1], jumps)
            found[part] = v if kind != "strong" else np.where(batch_uniforms(seeds[part, at + 2], jumps) > 0.2, v, 0.0)
        at += 3 if kind == "strong" else 2
        out.append(found)
    return out


def batch_views(kinds: list[str], vectors, *digests) -> list[np.ndarray]:
    """A matrix a view, of Arrow columns as ``_requests`` names them."""
    return seeded_views(kinds, arrow_matrix(vectors), view_seeds(kinds, *digests))


def to_draw(df: DataFrame, vec: str, views: dict[str, tuple[str, Column, str]], seed: int = 42):
    """(rows, draw): what ``drawn`` would draw, for a caller that needs the
    matrices inside its own task: ``draw(*columns of an Arrow batch)``."""
    kinds = [kind for kind, _, _ in views.values()]
    return df.select(*_requests(vec, views, seed)), lambda *columns: batch_views(kinds, *columns)


def drawn(df: DataFrame, vec: str, views: dict[str, tuple[str, Column, str]], keep: list[str], seed: int = 42) -> DataFrame:
    """``keep`` and a column a view, given as (``weak`` or ``strong``, row id,
    view name): the numbers of :func:`weak` and :func:`strong`, drawn for an
    Arrow batch at a time.  Vectors are of one length, without nulls."""
    rows = [F.col(f"`{k}`") for k in keep] + _requests(vec, views, seed)
    kinds = [kind for kind, _, _ in views.values()]
    names = [*keep, *views]

    def draw(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch_views(kinds, *batch.columns[len(keep):])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *map(arrow_lists, found)], names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{k}`") for k in keep]).schema]
    return df.select(*rows).mapInArrow(draw, ", ".join(schema + [f"`{v}` array<double>" for v in views]))


def packed(df: DataFrame, vec: str, views: dict[str, tuple[str, Column, str]], keep: list[str], seed: int = 42) -> DataFrame:
    """What ``drawn`` starts from, for a table that is scanned over and over as
    matrices: a row holds many, ``keep`` (numbers, NaN for null), the vector
    (``x``) and the ``view_seeds`` (``seeds``) as bytes, column by column.  A
    view takes two or three integers a row, however long the vector, and what
    compresses in the vector's columns does so here."""
    rows = [F.col(f"`{k}`") for k in keep] + _requests(vec, views, seed)
    kinds = [kind for kind, _, _ in views.values()]
    names, n = [*keep, "x", "seeds"], len(keep)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[:n]]
            found += [arrow_matrix(batch.column(n)), view_seeds(kinds, *batch.columns[n + 1:]).astype(np.int32)]
            step = max(1, CELLS // max(found[n].shape[1], 1))
            yield pa.RecordBatch.from_arrays([pa.array([c[lo:lo + step].tobytes("F") for lo in range(0, batch.num_rows, step)], pa.binary())
                                              for c in found], names)

    return df.select(*rows).mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names))


def unpacked(n: int, x, seeds) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, ``view_seeds``) of ``n`` rows from the buffers of a packed row."""
    return np.frombuffer(x).reshape(-1, n).T, np.frombuffer(seeds, np.int32).reshape(-1, n).T


def simclr_views(df: DataFrame, vec: str, row_id: str, seed: int = 42) -> DataFrame:
    """AU5: two independent strong views."""
    return df.select("*", strong(F.col(vec), F.col(row_id), "s1", seed).alias("view1"),
                     strong(F.col(vec), F.col(row_id), "s2", seed).alias("view2"))


def fixmatch_views(df: DataFrame, vec: str, row_id: str, seed: int = 42) -> DataFrame:
    """AU5: (weak, strong) views."""
    return df.select("*", weak(F.col(vec), F.col(row_id), "w", seed).alias("view_weak"),
                     strong(F.col(vec), F.col(row_id), "s", seed).alias("view_strong"))


DRAWS = 64      # tries of the rejection sampler in one expression; all fail with probability below 1e-27 at alpha 0.75


def beta(alpha: float, *parts) -> Column:
    """A Beta(alpha, alpha) number from a counter (Johnk): the first pair
    u^(1/alpha), v^(1/alpha) with sum up to 1, as its first share; 1/2 where
    none of DRAWS pairs is accepted."""
    def share(k):
        a = F.pow(uniform(*parts, k, "u"), F.lit(1.0 / alpha))
        b = F.pow(uniform(*parts, k, "v"), F.lit(1.0 / alpha))
        return F.struct((a + b).alias("s"), a.alias("a"))

    tries = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), share)
    first = F.get(F.filter(tries, lambda t: (t["s"] <= 1) & (t["s"] > 0)), 0)
    return F.coalesce(first["a"] / first["s"], F.lit(0.5))


def mixup(batched: DataFrame, vec: str, y: str, n_classes: int = 2, alpha: float = 0.75,
          seed: int = 42) -> DataFrame:
    """AU6: per batch one lambda ~ Beta(alpha, alpha), lambda = max(l, 1-l);
    each row mixes with a permuted partner of its own batch, for x and the
    one-hot target.  The partner of the n-th row is the n-th in hash order;
    windows span one batch (bounded by the batch size)."""
    keep = [c for c in batched.columns if c not in (vec, y)]
    own = Window.partitionBy("batch_id")
    rows = batched.withColumn("_place", F.row_number().over(own.orderBy("pos"))).withColumn(
        "_turn", F.row_number().over(own.orderBy(uniform(F.lit(seed), F.col("batch_id"), F.col("pos"), F.lit("perm")), "pos")))
    partner = rows.select("batch_id", F.col("_turn").alias("_place"), F.col(vec).alias("_x2"), F.col(y).alias("_y2"))
    pairs = rows.join(partner, ["batch_id", "_place"]).withColumn("_l", beta(alpha, F.lit(seed), F.col("batch_id")))
    pairs = pairs.withColumn("lam", F.greatest(F.col("_l"), F.lit(1.0) - F.col("_l")))
    lam, rest = F.col("lam"), F.lit(1.0) - F.col("lam")
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    return pairs.select(
        *keep, "lam",
        F.zip_with(vec, "_x2", lambda a, b: lam * a.cast("double") + rest * b.cast("double")).alias("x_mix"),
        F.transform(classes, lambda c: lam * (F.col(y) == c).cast("double") + rest * (F.col("_y2") == c).cast("double")).alias("y_mix"))
