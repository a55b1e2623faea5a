"""Split / folds exactness and invariance; statistics against brute force."""

import math
import random
import statistics

import pytest

from embercast.operators import split, stats


def _frame(spark, n=3000, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i % 37, i, int(rng.random() < 0.15), rng.gauss(20, 5)) for i in range(n)],
                                 "site_id int, date int, incendio int, x double")


def test_exact_stratified_counts(spark):
    df = _frame(spark)
    out = split.stratified_split(df, "incendio", ("site_id", "date"), 0.2, 42)
    n = {r.incendio: r["count"] for r in df.groupBy("incendio").count().collect()}
    t = {r.incendio: r["count"] for r in out.filter("is_test").groupBy("incendio").count().collect()}
    assert all(t[c] == round(0.2 * n[c]) for c in n)


def test_split_invariant_to_partitioning(spark):
    df = _frame(spark)
    base = sorted(r.date for r in split.stratified_split(df, "incendio", ("site_id", "date")).filter("is_test")
                  .collect())
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(r.date for r in split.stratified_split(df.repartition(parts), "incendio",
                                                            ("site_id", "date")).filter("is_test").collect())
        assert got == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_folds_balanced(spark):
    out = split.stratified_folds(_frame(spark), "incendio", ("site_id", "date"), 4, 42)
    per = out.groupBy("incendio", "fold").count().collect()
    for c in (0, 1):
        counts = [r["count"] for r in per if r.incendio == c]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1


def test_class_weights_balanced(spark):
    df = _frame(spark)
    w = {r.incendio: r.weight for r in split.class_weights(df, "incendio").select("incendio", "weight")
         .distinct().collect()}
    n = {r.incendio: r["count"] for r in df.groupBy("incendio").count().collect()}
    total = sum(n.values())
    assert all(math.isclose(w[c], total / (2 * n[c])) for c in n)


def test_describe_matches_python(spark):
    vals = [float(v) for v in range(1, 12)] + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = stats.describe(df, ["x"], digits=None).first()
    q = statistics.quantiles(vals, n=4, method="inclusive")
    assert (r["count"], r["min"], r["max"]) == (12, 1.0, 100.0)
    assert math.isclose(r.p25, q[0]) and math.isclose(r.p50, q[1]) and math.isclose(r.p75, q[2])
    assert math.isclose(r.std, statistics.stdev(vals))


def test_corr_constant_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    m = {(r.col_a, r.col_b): r.corr for r in stats.corr_matrix(df).collect()}
    assert m[("a", "c")] is None and m[("a", "b")] == pytest.approx(m[("b", "a")])
    assert m[("a", "a")] == pytest.approx(1.0)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(11)], "g int, x double")
    h = stats.hist_density(df, "x", "g", bins=5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]  # the max lands in the last bin
    assert sum(r.density * (r.bin_hi - r.bin_lo) for r in h) == pytest.approx(1.0)
