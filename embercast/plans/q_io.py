"""Sources, sinks and small presentation operators: S1, S5-S10, P11, P12, O1,
O2, F3, F13, F14, Q2, Q3 and the D5 parity switch of C4.

Round-trip queries write under the shared checkpoint folder (a fresh sub-folder
per call) and read the written table back with a declared schema."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..operators import clean, scoring, train
from ..session import checkpoint_path
from ..sources import files, sinks
from ..sources import testdata as td
from . import q_models
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

VALUES = ["temperatura", "humedad", "velocidad_viento", "precipitacion", "temp_max", "temp_min"]
OBS_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("site_id", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in VALUES]
                          + [T.StructField("incendio", T.IntegerType())])


def _scratch(spark, name):
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


# --------------------------------------------------------------------------- S6 + S1 (partitioned CSV)
def _csv_roundtrip(spark, d):
    path = _scratch(spark, "obs_csv")
    sinks.write_table(td.obs_daily(spark, d), path, partition_by=("site_id",), fmt="csv")
    # declared schema; the partition column comes back from the folder names
    return rounded(files.read_csv(spark, path, OBS_SCHEMA).select("date", "site_id", *VALUES, "incendio"))


register("table_roundtrip_csv", wrap(with_views("obs_daily") + "select * from obs_daily", VALUES))(_csv_roundtrip)


# --------------------------------------------------------------------------- S6 idempotent daily load (parquet)
def _idempotent(spark, d):
    path = _scratch(spark, "obs_parquet")
    o = td.obs_daily(spark, d)
    sinks.write_table(o, path, partition_by=("date",))
    sinks.write_table(o.filter(F.col("date") >= F.lit("2000-01-01").cast("date")), path, partition_by=("date",))
    return rounded(spark.read.parquet(path).select("date", "site_id", *VALUES, "incendio"))


register("table_reload_idempotent", wrap(with_views("obs_daily") + "select * from obs_daily", VALUES))(_idempotent)


# --------------------------------------------------------------------------- S5
def _hot_csv(spark, d):
    path = _scratch(spark, "hot_csv")
    h = td.hotspots(spark, d).select("latitude", "longitude", "acq_date", "confidence", "brightness", "frp")
    h.write.option("header", True).csv(path)
    return rounded(files.read_hotspots_csv(spark, path))


register("hotspot_csv_scan", wrap(with_views("hotspots") + """
select latitude, longitude, acq_date, confidence, brightness, frp from hotspots""",
                                  ["latitude", "longitude", "brightness", "frp"]))(_hot_csv)

# --------------------------------------------------------------------------- P11, O1
register("preview", with_views("obs_daily") + """
select date, site_id, incendio from obs_daily order by date, site_id limit 10""")(
    lambda spark, d: clean.sort_chronological(td.obs_daily(spark, d).select("date", "site_id", "incendio"))
    .limit(10))

register("sorted_days", wrap(with_views("obs_dups") + """
select * from obs_dups order by date, site_id, ingest_seq""", VALUES))(
    lambda spark, d: rounded(clean.sort_chronological(td.obs_dups(spark, d), "date", ("site_id", "ingest_seq"))))

# --------------------------------------------------------------------------- D5 parity: target z-scored in C4
_keep = " and ".join(f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) < 3.0, false)" for c in VALUES + ["incendio"])
_rst = ", ".join([f"avg({c}) as m_{c}" for c in VALUES + ["incendio"]]
                 + [f"stddev_pop({c}) as s_{c}" for c in VALUES + ["incendio"]])
register("outlier_remove_parity", wrap(with_views("obs_daily") + f"""
select obs_daily.* from obs_daily cross join (select {_rst} from obs_daily) s where {_keep}""", VALUES))(
    lambda spark, d: rounded(clean.outlier_remove(td.obs_daily(spark, d), 3.0, VALUES + ["incendio"],
                                                  exclude_target=False)))

# --------------------------------------------------------------------------- P12
_P12 = """select site_id, date, incendio, temperatura as temp_2m_mean, temp_max as temp_2m_max,
  temp_min as temp_2m_min, humedad as relative_humidity_mean, humedad - 10 as relative_humidity_min,
  humedad + 10 as relative_humidity_max, humedad / 400 as soil_moisture_7_28cm,
  humedad / 350 as soil_moisture_28_100cm, temperatura - 5 as soil_temp_100_255cm,
  temperatura * 150 as direct_shortwave_radiation, velocidad_viento / 8 as evapotranspiration,
  (100 - humedad) / 25 as vapor_pressure_deficit, precipitacion * 4 as cloud_cover_high,
  precipitacion as precipitation_sum, velocidad_viento as wind_speed_mean, velocidad_viento * 2 as wind_speed_max,
  cast(910 as double) as surface_pressure, temperatura - 12 as dew_point, temperatura * 5 as radiation_diffuse,
  temp_max - temp_min as temperature_range, cast(20 as double) as humidity_range,
  cast(dayofyear(date) as double) as day_of_year, cast(month(date) as double) as month,
  cast(month(date) in (5, 6, 7, 8, 9, 10) as double) as is_dry_season from obs_daily"""
register("vocabulary_rename", wrap(with_views("obs_daily") + _P12, [
    "temp_2m_mean", "temp_2m_max", "temp_2m_min", "relative_humidity_mean", "relative_humidity_min",
    "relative_humidity_max", "soil_moisture_7_28cm", "soil_moisture_28_100cm", "soil_temp_100_255cm",
    "direct_shortwave_radiation", "evapotranspiration", "vapor_pressure_deficit", "cloud_cover_high",
    "precipitation_sum", "wind_speed_mean", "wind_speed_max", "surface_pressure", "dew_point", "radiation_diffuse",
    "temperature_range", "humidity_range", "day_of_year", "month", "is_dry_season"]))(
    lambda spark, d: rounded(td.scoring_rows(spark, d)))

# --------------------------------------------------------------------------- F3, F13, F14
_PROB = "cast(cast(json_extract_string(props, '$.k') as int) as double) / 100"
register("sensor_calendar", wrap(with_views("scored", extra="""
r as (select user_id as station_id, event_id, cast(ts as timestamp) as ts from events),
f as (select station_id, min(ts) as first_ts from r group by 1)""") + """
select r.station_id, r.event_id, cast(isodow(r.ts) - 1 as int) as dia_semana, cast(month(r.ts) as int) as mes,
  epoch_us(r.ts) - epoch_us(f.first_ts) as micros_since_first,
  r.ts >= cast(current_date - 1 as timestamp) as after_yesterday
from r join f on r.station_id = f.station_id""", []))(
    lambda spark, d: rounded(_sensor_calendar(spark, d)))


def _sensor_calendar(spark, d):
    from ..session import table
    r = table(spark, d, "events").select(F.col("user_id").alias("station_id"), "event_id",
                                         F.col("ts").cast("timestamp").alias("ts"))
    first = r.groupBy("station_id").agg(F.min("ts").alias("first_ts"))  # one row per station
    j = r.join(first, ["station_id"])
    return j.select("station_id", "event_id", cal.weekday_mon0("ts").alias("dia_semana"),
                    F.month("ts").alias("mes"), cal.elapsed_micros("ts", "first_ts").alias("micros_since_first"),
                    (F.col("ts") >= cal.yesterday().cast("timestamp")).alias("after_yesterday"))


# --------------------------------------------------------------------------- O2, S10, Q2 + S8, Q3, S7, S9
register("importance_top5")(lambda spark, d: train.feature_importance(q_models._saved_forest(spark, d)[0], top=5))


def _model_roundtrip(spark, d):
    model, te = q_models._saved_forest(spark, d)
    path = _scratch(spark, "model")
    sinks.save_model(model, path)
    loaded = sinks.load_model(path)
    return scoring.batch_score(loaded, te, keep=("site_id", "date"))


register("model_roundtrip")(_model_roundtrip)


def _history(spark, d):
    model, te = q_models._saved_forest(spark, d)
    path = _scratch(spark, "history")
    sinks.append_predictions(scoring.score_with_details(model, te, keep=("site_id", "date")), path)
    sinks.append_predictions(scoring.score_with_details(model, te, keep=("site_id", "date")), path)  # 2nd call
    h = spark.read.parquet(path)
    return scoring.prediction_stats(h, "prediction")


register("prediction_history")(_history)
def _proba(spark, d):
    model, te = q_models._saved_forest(spark, d)
    return scoring.predict_proba(model, te, keep=("site_id", "date"))


register("predict_proba")(_proba)


def _report_sinks(spark, d):
    model, te = q_models._saved_forest(spark, d)
    scored = scoring.batch_score(model, te, keep=("incendio",)).select(
        F.col("incendio").alias("y"), F.col("prediction").alias("pred"), F.col("probability_fire").alias("prob"))
    from ..operators import curves
    base = _scratch(spark, "eval")
    sinks.write_metrics_json(curves.metrics(scored, "y", "pred", "prob"), base + "/metrics")
    sinks.write_report(curves.report(scored, "y", "pred"), base + "/report")
    return spark.read.schema("metric string, value double").json(base + "/metrics")


register("metrics_sink")(_report_sinks)


# --------------------------------------------------------------------------- P5, F14
register("class_rows", wrap(with_views("obs_daily") + "select * from obs_daily where incendio = 1", VALUES))(
    lambda spark, d: rounded(clean.of_class(td.obs_daily(spark, d), 1, "incendio")))


def _elapsed(spark, d):
    from ..session import table
    r = table(spark, d, "events").select(F.col("user_id").alias("station_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first = r.groupBy("station_id").agg(F.min("ts").alias("first_ts"))
    return r.join(first, ["station_id"]).select("station_id", "event_id", cal.elapsed_minutes("ts", "first_ts").alias("minutes"))


register("elapsed_minutes", """
with r as (select user_id as station_id, event_id, cast(ts as timestamp) as ts from events),
f as (select station_id, min(ts) as first_ts from r group by 1)
select r.station_id, r.event_id, (epoch_us(r.ts) - epoch_us(f.first_ts)) / 60000000.0::double as minutes
from r join f on r.station_id = f.station_id""")(_elapsed)
