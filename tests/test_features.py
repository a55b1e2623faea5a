"""FX5 hand row and calendar cases; rolling windows; calendar completion."""

import datetime as dt
import math

from pyspark.sql import functions as F

from embercast.operators import features, hotspots


def test_meteo_and_interactions_hand_row(spark):
    df = spark.createDataFrame([(30.0, 50.0, 20.0, 1.0)], "temperatura double, humedad double, "
                                                          "velocidad_viento double, precipitacion double")
    r = features.interactions(features.meteo_features(df)).first()
    assert r.indice_sequia == 0.5 and r.indice_calor == 15.0
    es = 0.6108 * math.exp(17.27 * 30 / (30 + 237.3))
    assert math.isclose(es, 4.2431, abs_tol=1e-4) and math.isclose(r.vpd, 2.1215, abs_tol=1e-4)
    assert math.isclose(r.ratio_viento_humedad, 0.392157, abs_tol=1e-6)
    assert (r.temp_x_viento, r.temp_x_humedad, r.viento_x_precip, r.temp_x_precip) == (600.0, 1500.0, 10.0, 15.0)
    assert "amplitud_termica" not in df.columns  # only when inputs exist


def test_calendar_cases(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2020, 12, 31),)], "date date")
    r = {x.date: x for x in features.temporal_features(df, "date", "feature").collect()}
    a = r[dt.date(2021, 1, 1)]
    assert (a["semana_año"], a.trimestre, a["dia_año"], a.estacion) == (53, 1, 1, "verano")
    assert r[dt.date(2020, 12, 31)]["dia_año"] == 366
    c = features.temporal_features(df, "date", "clean").filter(F.col("date") == "2021-01-01").first()
    assert c.is_dry_season == 0 and c.quarter == 1


def test_rolling_min_periods_and_nulls(spark):
    data = [(1, i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, None, None, None, None, None, None])]
    df = spark.createDataFrame(data, "site_id int, day int, precipitacion double")
    out = features.rolling_features(df, ["precipitacion"], ("site_id",), "day", (2,), "precipitacion") \
                  .orderBy("day").collect()
    assert out[0]["precipitacion_ma2"] == 1.0          # min_periods 1
    assert out[1]["precipitacion_ma2"] == 1.0          # NULL skipped
    assert out[3]["precip_acum_2d"] == 8.0
    assert out[6]["precip_acum_2d"] is None            # all-NULL frame -> NULL


def test_calendar_completion(spark):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 1), 1.0), (1, dt.date(2023, 1, 4), 2.0)],
                               "site_id int, date date, t double")
    out = hotspots.complete_calendar(df).orderBy("date").collect()
    assert [r.is_missing_day for r in out] == [False, True, True, False]


def test_weekday_and_elapsed_minutes(spark):
    from embercast.functions import calendar as cal
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 1, 30))], "a timestamp, b timestamp")
    r = df.select(cal.weekday_mon0("a").alias("w"), cal.elapsed_minutes("b", "a").alias("m")).first()
    assert (r.w, r.m) == (0, 90.0)  # 2024-01-01 is a Monday


def test_rename_vocabulary_and_bounded_replies(spark):
    import pytest
    from embercast.operators.scoring import rename_vocabulary
    from embercast.sources import testdata as td
    from .conftest import SF
    df = spark.createDataFrame([(1.0, 2.0)], "temperatura double, humedad double")
    assert rename_vocabulary(df, {"temperatura": "temp_2m_mean"}).columns == ["temp_2m_mean", "humedad"]
    with pytest.raises(ValueError, match="viento"):
        rename_vocabulary(df, {"viento": "wind_speed_mean"})
    # each landed hourly reply carries at most 24 values per variable (a bounded group)
    sizes = td.hourly_json(spark, SF).select(
        F.expr("max(size(from_json(body, 'hourly struct<variables: array<struct<name: string, "
               "values: array<double>>>>').hourly.variables[0]['values']))").alias("m")).first().m
    assert 1 <= sizes <= 24
