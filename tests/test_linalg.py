"""Randomised basis against known decompositions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from flowlab.operators import linalg as LA


def matrix(rows, dim, block):
    out = {}
    for r in rows:
        out.setdefault(r["component"], {})[r["block_id"]] = r["vec"]
    return np.stack([np.concatenate([np.asarray(out[c][b]) for b in sorted(out[c])]) for c in sorted(out)], 1)


def frame(spark, g):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(g)], "row_id long, vec array<double>").repartition(4)


def mirrored(s, n, d, seed):
    """U diag(s) V' with full orthogonal U and V (mirrors), and V's first rows."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=n), rng.normal(size=d)
    u, v = u / np.linalg.norm(u), v / np.linalg.norm(v)
    g = np.zeros((n, d))
    g[np.arange(len(s)), np.arange(len(s))] = s
    g -= 2 * np.outer(g @ v, v)
    g -= 2 * np.outer(u, u @ g)
    return g, np.eye(d)[:len(s)] - 2 * np.outer(v[:len(s)], v)


def test_full_rank_5000_by_6000(spark, tmp_path):
    s = 1 / (1.0 + np.arange(5000))
    g, vt = mirrored(s, 5000, 6000, 3)
    for part in range(10):
        rows = g[part * 500:(part + 1) * 500]
        pq.write_table(pa.table({"row_id": np.arange(part * 500, part * 500 + 500), "vec": pa.ListArray.from_arrays(
            pa.array(np.arange(501, dtype=np.int32) * 6000), pa.array(rows.ravel()))}), tmp_path / f"{part}.parquet", row_group_size=100)
    basis, kept = LA.svd_basis(spark.read.parquet(str(tmp_path)), "row_id", "vec", 0.97)
    q = matrix(basis.collect(), 6000, 4096)
    energy = np.cumsum(s ** 2) / np.sum(s ** 2)
    best = int(np.searchsorted(energy, 0.97)) + 1
    assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-9)
    assert np.sum((g @ q) ** 2) >= 0.97 * np.sum(g ** 2)
    assert best <= q.shape[1] <= best + 2 and len(kept) == q.shape[1]
    assert np.allclose(kept[:5], s[:5], rtol=1e-3)
    # the leading directions are the true ones
    assert np.all(np.linalg.norm(vt[:3] @ q, axis=1) > 0.999)


@pytest.mark.parametrize("n,d", [(30, 200), (200, 30), (50, 50)])
def test_exact_where_the_range_is_whole(spark, n, d):
    g = np.random.default_rng(n).normal(size=(n, d))
    _, want, vt = np.linalg.svd(g, full_matrices=False)
    basis, kept = LA.svd_basis(frame(spark, g), "row_id", "vec", 0.9, block=16)
    k = int(np.searchsorted(np.cumsum(want ** 2) / np.sum(want ** 2), 0.9)) + 1
    q = matrix(basis.collect(), d, 16)
    assert np.allclose(kept, want[:k], rtol=1e-8) and np.allclose(q @ q.T, vt[:k].T @ vt[:k], atol=1e-7)


def test_narrow_range_grows_and_products_may_pass_by_batch(spark, monkeypatch):
    g = np.random.default_rng(1).normal(size=(60, 40))
    monkeypatch.setattr(LA, "FACTORS_KEPT", 0)
    basis, kept = LA.svd_basis(frame(spark, g), "row_id", "vec", 0.97, block=7, width=3)
    q = matrix(basis.collect(), 40, 7)
    assert np.sum((g @ q) ** 2) >= 0.97 * np.sum(g ** 2) and np.allclose(q.T @ q, np.eye(len(kept)), atol=1e-9)


def test_rank_deficient_repeated_and_odd_rows(spark):
    g = np.repeat(np.random.default_rng(2).normal(size=(3, 20)), 10, axis=0)
    basis, kept = LA.svd_basis(frame(spark, g), "row_id", "vec", 1.0, block=8)
    assert len(kept) == 3
    assert LA.svd_basis(frame(spark, g[:0]), "row_id", "vec")[0].count() == 0
    with pytest.raises(ValueError):
        LA.svd_basis(frame(spark, np.full((2, 3), np.nan)), "row_id", "vec")
    uneven = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row_id long, vec array<double>")
    with pytest.raises(ValueError):
        LA.svd_basis(uneven, "row_id", "vec")


def test_the_same_factors_everywhere():
    assert np.array_equal(LA.random_factor(3, 10, 4), LA.random_factor(3, 10, 4))
    assert not np.array_equal(LA.random_factor(3, 10, 4), LA.random_factor(4, 10, 4))
