"""Array-valued column expressions (PR13-PR20, PR25) built from Spark's
higher-order functions, so they stay inside whole-stage code generation.
Sums run left to right (``aggregate``), the same order DuckDB's
``list_reduce`` uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(vsum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def _per_row(v: Column, value: Column) -> Column:
    """``value`` repeated to the length of ``v``: a row-level scalar is
    computed once per row and zipped in, instead of being re-evaluated
    inside an element lambda (which would make the work O(D^2))."""
    return F.array_repeat(value, F.size(v))


def l2_normalize(v: Column) -> Column:
    """PR15: v / ||v||; a zero vector stays zero."""
    return F.zip_with(v, _per_row(v, norm(v)),
                      lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def softmax(logits: Column) -> Column:
    """PR13: max-shifted softmax in double."""
    e = F.zip_with(logits, _per_row(logits, F.array_max(logits)), lambda x, m: F.exp(x.cast("double") - m))
    return F.zip_with(e, _per_row(e, vsum(e)), lambda x, s: x / s)


def scale(v: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.transform(v, lambda x: x.cast("double") / t)


def temperature_probs(logits: Column, temperature: Column) -> Column:
    """PR14: softmax(logits / T); T ignored unless > 0."""
    scaled = F.when(temperature.isNotNull() & (temperature > 0), scale(logits, temperature)).otherwise(
        as_double(logits))
    return softmax(scaled)


def sharpen(p: Column, t: float = 0.5) -> Column:
    """PR16: p^(1/T) / sum."""
    e = F.transform(p, lambda x: F.pow(x.cast("double"), F.lit(1.0 / t)))
    return F.zip_with(e, _per_row(e, vsum(e)), lambda x, s: x / s)


def argmax(v: Column) -> Column:
    """0-based index of the first maximum (numpy.argmax)."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def mse(a: Column, b: Column) -> Column:
    """PR19: mean squared difference."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return vsum(d) / F.size(a)


def average(a: Column, b: Column) -> Column:
    """PR25: element-wise mean of two views."""
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)




def attack_probability(p: Column) -> Column:
    """AL4: class-1 probability for a binary head, else the max class."""
    return F.when(F.size(p) == 2, p[1]).otherwise(F.array_max(p))


def severity(score: Column) -> Column:
    """PR22: strict bands on the anomaly score."""
    return (F.when(score > 0.9, "CRITICAL").when(score > 0.7, "HIGH").when(score > 0.5, "MEDIUM")
            .otherwise("LOW"))


def ensemble(ae: Column, iso: Column, w_ae: float = 0.6, w_if: float = 0.4) -> Column:
    """PR23: weighted sum of two anomaly scores."""
    return F.lit(w_ae) * ae + F.lit(w_if) * iso


def anomaly_score(err: Column, threshold: Column | float) -> Column:
    """PR20: clip(err / max(threshold, 1e-8), 0, 1)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.least(F.greatest(err / F.greatest(t, F.lit(1e-8)), F.lit(0.0)), F.lit(1.0))
