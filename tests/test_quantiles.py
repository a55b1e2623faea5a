"""Distributed exact quantiles equal Spark's exact percentile (ties, hot group)."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from embercast.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("finish", [0, 10, 1 << 20])
def test_matches_percentile(spark, finish):
    rng = random.Random(finish)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 6), round(rng.gauss(10, 4), 1) if i % 17 else None,
             float(rng.randint(0, 3))) for i in range(3000)]  # group 0 holds a third of the rows; ties
    df = spark.createDataFrame(rows, "g int, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r.g, r.column_name, r.p): r.q for r in exact_quantiles(df, ["x", "y"], probs, by=("g",), finish=finish)
           .collect()}
    want = df.groupBy("g").agg(F.percentile("x", probs).alias("x"), F.percentile("y", probs).alias("y")).collect()
    for r in want:
        for c in ("x", "y"):
            for p, q in zip(probs, r[c]):
                assert got[(r.g, c, p)] == pytest.approx(q, rel=1e-12, abs=1e-12)
    glob = {(r.column_name, r.p): r.q for r in exact_quantiles(df, ["x"], [0.5], finish=finish).collect()}
    assert glob[("x", 0.5)] == pytest.approx(df.agg(F.median("x")).first()[0], rel=1e-12)


def test_awkward_values_at_every_depth(spark):
    """Zeros of both signs, infinities, the smallest and largest doubles, neighbours that differ in one bit."""
    rng = random.Random(9)
    ends = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 2.2250738585072014e-308]
    near = [math.nextafter(1.0, 2.0), 1.0, math.nextafter(1.0, 0.0), -1.0, math.nextafter(-1.0, 0.0)]
    vals = ends + near * 3 + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [1 + i * 2.0 ** -52 for i in range(200)]
    vals = [v for v in vals if v == v and abs(v) != math.inf]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(4)
    probs = [i / (len(vals) - 1) for i in range(0, len(vals), 31)]
    want = sorted(vals)
    for finish in (0, 3):
        got = {r.p: r.q for r in exact_quantiles(df, ["x"], probs, finish=finish).collect()}
        assert [got[p] for p in probs] == [pytest.approx(want[round(p * (len(vals) - 1))], rel=1e-12) for p in probs]
    inf = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, 1.0, 2.0, 3.0)], "x double")
    got = {r.p: r.q for r in exact_quantiles(inf, ["x"], [0.0, 0.25, 0.5, 1.0], finish=0).collect()}
    assert got == {0.0: -math.inf, 0.25: 1.0, 0.5: 2.0, 1.0: math.inf}
