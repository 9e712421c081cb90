"""Library calls must not leave cached data behind (a long-lived session
runs many of them) and must keep row-wise Python stages parallel."""
from __future__ import annotations

import __spark_entry__ as E
from flowlab.session import ensure_parallelism

SF = "/root/testdata/sf0.001"


def _persisted(spark) -> int:
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_queries_leave_no_cached_data(spark):
    before = _persisted(spark)
    q = E.queries()
    for name in ["eval_report", "roc_curve_dropped", "prf", "fit_vocab", "stratified_split", "ae_p95",
                 "env_thresholds", "temperature_fit", "iforest", "svd_basis", "score_flows", "route_alerts"]:
        q[name](spark, SF).collect()
    assert _persisted(spark) == before


def test_parallelism_floor(spark):
    one = spark.range(100).coalesce(1)
    assert ensure_parallelism(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(spark.sparkContext.defaultParallelism * 2)
    assert ensure_parallelism(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 2
