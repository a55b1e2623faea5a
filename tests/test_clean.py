"""FX1: the four-row frame with NULLs (fill, outliers, scaling, model-ready job)."""

import math

import pytest
from pyspark.sql import functions as F

from embercast.operators import clean, scale
from embercast.plans import jobs

FX1 = [(1, 20.0, 60.0, 10.0, 0), (2, 25.0, None, 12.0, 1), (3, None, 55.0, 14.0, 0), (4, 30.0, 50.0, 16.0, 1)]
SCHEMA = "seq int, temp_2m_mean double, relative_humidity_mean double, wind_speed_mean double, Incendio int"
COLS = ["temp_2m_mean", "relative_humidity_mean", "wind_speed_mean"]


@pytest.fixture
def fx1(spark):
    return spark.createDataFrame(FX1, SCHEMA)


def rows(df, order="seq"):
    return [r.asDict() for r in df.orderBy(order).collect()]


def test_fill_mean(fx1):
    out = rows(clean.fill_simple(fx1, "mean", COLS + ["Incendio"]))
    assert out[2]["temp_2m_mean"] == 25.0 and out[1]["relative_humidity_mean"] == 55.0
    assert all(v is not None for r in out for v in r.values())


def test_fill_median(fx1):
    out = rows(clean.fill_simple(fx1, "median", COLS))
    assert out[2]["temp_2m_mean"] == 25.0 and out[1]["relative_humidity_mean"] == 55.0


def test_drop(fx1):
    assert [r["seq"] for r in rows(clean.fill_simple(fx1, "drop"))] == [1, 4]


def test_three_stage_fill_row_order(fx1):
    df = fx1.withColumn("site_id", F.lit(1))
    out = rows(clean.fill_three_stage(df, COLS, ("site_id",), "seq", "Incendio"))
    assert out[2]["temp_2m_mean"] == 25.0      # forward fill from row 2
    assert out[1]["relative_humidity_mean"] == 60.0
    assert [r["Incendio"] for r in out] == [0, 1, 0, 1]  # target untouched


def test_three_stage_backward_and_median(spark):
    df = spark.createDataFrame([(1, 1, None, None), (1, 2, 5.0, None), (2, 1, None, 7.0), (2, 2, None, 9.0)],
                               "site_id int, seq int, a double, b double")
    out = {(r.site_id, r.seq): (r.a, r.b) for r in clean.fill_three_stage(df, ["a", "b"], ("site_id",), "seq",
                                                                        "none").collect()}
    assert out[(1, 1)] == (5.0, 8.0)   # bfill for a; site 1 has no b at all -> global median 8
    assert out[(2, 1)] == (5.0, 7.0)   # site 2 has no a at all -> global median 5


def test_outlier_remove_reason(fx1):
    """Rows 2 and 3 go because of their NULLs, not because 100 is an outlier:
    with n = 4 the largest population z is sqrt(3) = 1.73 < 2.5."""
    df = fx1.withColumn("wind_speed_mean", F.when(F.col("seq") == 4, 100.0).otherwise(F.col("wind_speed_mean")))
    out = clean.outlier_remove(df, 2.5, COLS, "Incendio")
    assert [r["seq"] for r in rows(out)] == [1, 4]
    no_nulls = df.filter(F.col("seq").isin(1, 4))
    assert clean.outlier_remove(no_nulls, 2.5, COLS, "Incendio").count() == 2


def test_outlier_remove_constant_column_drops_all(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert clean.outlier_remove(df, 3.0, ["a", "b"], "t").count() == 0
    assert clean.outlier_remove(df, 3.0, ["a", "b"], "t", skip_constant=True).count() == 2


def test_outlier_flags_fixed_and_sparse(spark):
    data = [(float(i),) for i in range(20)] + [(1000.0,)]
    df = spark.createDataFrame(data, "x double").withColumn("y", F.lit(1.0))
    full = clean.outlier_flags(df, 3.0, ["x", "y"], "t")
    assert "y_is_outlier" in full.columns and full.filter("x_is_outlier").count() == 1
    sparse = clean.outlier_flags(df, 3.0, ["x", "y"], "t", sparse=True)
    assert "y_is_outlier" not in sparse.columns


def test_standard_scale_population(fx1):
    filled = clean.fill_simple(fx1, "mean", COLS)
    out = scale.standard_scale(filled, COLS)
    st = out.agg(*[F.avg(c).alias(f"m_{c}") for c in COLS], *[F.stddev_pop(c).alias(f"s_{c}") for c in COLS]).first()
    for c in COLS:
        assert abs(st[f"m_{c}"]) < 1e-12 and math.isclose(st[f"s_{c}"], 1.0, rel_tol=1e-12)


def test_model_ready_half_split(spark, fx1):
    df = fx1.withColumn("site_id", F.lit(1)).withColumn("date", F.expr("date_add(date'2023-01-01', seq)")) \
            .withColumnRenamed("Incendio", "incendio")
    out = jobs.model_ready(df, "incendio", COLS, test_size=0.5)
    got = out.groupBy("is_test", "incendio").count().collect()
    assert sum(r["count"] for r in got) == 4
    assert sorted((r["is_test"], r["incendio"], r["count"]) for r in got) == [
        (False, 0, 1), (False, 1, 1), (True, 0, 1), (True, 1, 1)]


def test_target_validation(spark):
    ok = spark.createDataFrame([(0,), (1,), (1,)], "incendio int")
    assert clean.validate_target(ok) is ok
    with pytest.raises(ValueError):
        clean.validate_target(spark.createDataFrame([(0,), (2,)], "incendio int"))
    with pytest.raises(ValueError):
        clean.validate_target(spark.createDataFrame([(0,), (None,)], "incendio int"))


def test_dedup_keeps_first_in_file_order(spark):
    df = spark.createDataFrame([(1, "2023-01-01", 2, 9.0), (1, "2023-01-01", 0, 1.0), (1, "2023-01-02", 5, 3.0)],
                               "site_id int, date string, ingest_seq int, v double")
    out = {r.date: r.v for r in clean.dedup_first(df).collect()}
    assert out == {"2023-01-01": 1.0, "2023-01-02": 3.0}
