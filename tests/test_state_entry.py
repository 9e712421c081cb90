from __future__ import annotations

import tempfile

import numpy as np

import __spark_entry__ as E
from flowlab.operators import features as FT
from flowlab.sources import state as STATE


def _tmp():
    return tempfile.mkdtemp(prefix="flowlab-state-", dir="/tmp")


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"threshold", "precision", "recall", "f1"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_feature_state_roundtrip(spark):
    st = FT.FeatureState(["a"], ["c"], {"a": 1.5}, {"a": 2.0}, {"c": ["x", "y"]}, ["attack", "normal"])
    d = _tmp()
    st.save(spark, f"{d}/fs")
    back = FT.FeatureState.load(spark, f"{d}/fs")
    assert back == st and back.dim == 3


def test_basis_bank_append_and_replace(spark):
    d = _tmp()

    def basis(k, v):
        return spark.createDataFrame([(c, 0, [float(v)] * 4) for c in range(k)],
                                     "component int, block_id int, vec array<double>")

    STATE.save_basis(spark, f"{d}/bank", 0, "dos", basis(2, 1))
    STATE.save_basis(spark, f"{d}/bank", 1, "port_scan", basis(1, 2))
    mats = STATE.basis_matrices(STATE.load_bases(spark, f"{d}/bank"))
    assert [m.shape for m in mats] == [(4, 2), (4, 1)]
    STATE.save_basis(spark, f"{d}/bank", 0, "dos", basis(3, 5))      # replace task 0 only
    mats = STATE.basis_matrices(STATE.load_bases(spark, f"{d}/bank"))
    assert [m.shape for m in mats] == [(4, 3), (4, 1)] and np.all(mats[1] == 2.0)


def test_model_params_roundtrip(spark):
    from flowlab.operators import models as MO
    net = MO.classifier_head(8, 2, seed=4)
    d = _tmp()
    STATE.save_params(MO.params_table(spark, "dos", net), f"{d}/params")
    back = MO.layers_from_table(spark.read.parquet(f"{d}/params"), "dos")
    x = np.random.default_rng(1).normal(size=(3, 8))
    assert np.allclose(MO.net_forward(x, back), MO.net_forward(x, net))
    assert [L.get("save", False) for L in back] == [True, False, False, False]


def test_saving_a_basis_leaves_other_writers_alone(spark, tmp_path):
    from flowlab.sources import state as S
    basis = spark.createDataFrame([(0, 0, [1.0])], "component int, block_id int, vec array<double>")
    S.save_basis(spark, str(tmp_path / "bases"), 0, "a", basis)
    S.save_basis(spark, str(tmp_path / "bases"), 1, "b", basis)
    S.save_basis(spark, str(tmp_path / "bases"), 1, "c", basis)
    assert [(r["task_ord"], r["task"]) for r in S.load_bases(spark, str(tmp_path / "bases")).collect()] == [(0, "a"), (1, "c")]
    for models in (["m1", "m2"], ["m1"]):
        S.save_params(spark.createDataFrame([(m, 1.0) for m in models], "model string, w double"), str(tmp_path / "params"))
    assert [r["model"] for r in spark.read.parquet(str(tmp_path / "params")).collect()] == ["m1"]
