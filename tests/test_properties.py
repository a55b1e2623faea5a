"""Hypothesis properties (few examples each: every example runs Spark jobs)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from embercast.operators import curves
from embercast.operators.quantiles import exact_quantiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

labelled = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=60).filter(
    lambda xs: len({y for y, _ in xs}) == 2)


@SETTINGS
@given(xs=labelled, partitions=st.integers(1, 6))
def test_auc_equals_pair_counting(spark, xs, partitions):
    df = spark.createDataFrame([(y, s / 20.0) for y, s in xs], "y int, prob double")
    pos = [s for y, s in xs if y == 1]
    neg = [s for y, s in xs if y == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    got = curves.roc_auc(df, "y", "prob", partitions=partitions).first()[0]
    assert got == pytest.approx(want, rel=1e-12)


@SETTINGS
@given(vals=st.lists(st.integers(-50, 50), min_size=1, max_size=80), p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_equals_numpy_linear(spark, vals, p):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [p], finish=0).first().q
    assert got == exact_quantiles(df, ["x"], [p]).first().q  # direct path gives the same value
    assert got == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-12)


def test_forest_training_keeps_no_node_ids_by_row(spark):
    from embercast.operators import train

    df = train.fixed_layout(spark.range(400).selectExpr("id", "cast(id % 17 as double) a", "cast(id % 29 as double) b", "int(id % 17 + id % 29 > 22) y"), "id")
    pipe = train.forest_pipeline(["a", "b"], "y", num_trees=5, max_depth=12, seed=3)
    assert not pipe.getStages()[-1].getCacheNodeIds()  # rows x trees numbers, written anew at every level
    cached = pipe.copy()
    cached.getStages()[-1].setCacheNodeIds(True)
    trees = lambda p: [t.toDebugString.split("\n", 1)[1] for t in p.fit(df).stages[-1].trees]
    plain = trees(train.forest_pipeline(["a", "b"], "y", num_trees=5, max_depth=12, seed=3))
    assert plain == trees(cached)
