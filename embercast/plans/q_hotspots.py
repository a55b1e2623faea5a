"""Ingest and hot-spot queries: P1, A1, J5, J1, S2, S3, O4 and the daily ETL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hotspots as hs
from ..sources import files
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

HOT_COLS = ["event_id", "acq_date", "confidence", "brightness", "frp", "latitude", "longitude"]
_P1 = ("latitude between cast(-17.6 as double) and cast(-17.1 as double) "
       "and longitude between cast(-66.5 as double) and cast(-65.8 as double) and confidence >= 80")
_A1 = ("count(*) as fire_count, 1 as Incendio, avg(brightness) as avg_brightness, avg(frp) as avg_frp, "
       "max(confidence) as max_confidence")
_A1_D = ["avg_brightness", "avg_frp"]
HV = td.HOURLY_VARIABLES
_HOURLY_D = [f"{v}_{s}" for v in HV for s in ("mean", "max", "min", "std")]


# --------------------------------------------------------------------------- P1
register("hotspot_filter", wrap(with_views("hotspots") + f"select * from hotspots where {_P1}",
                                ["brightness", "frp", "latitude", "longitude"]))(
    lambda spark, d: rounded(hs.filter_bbox(td.hotspots(spark, d))))

# --------------------------------------------------------------------------- A1 (one box, per day)
register("hotspot_daily", wrap(with_views("hotspots") + f"""
select acq_date as date, {_A1} from hotspots where {_P1} group by 1""", _A1_D))(
    lambda spark, d: rounded(hs.daily_hotspots(hs.filter_bbox(td.hotspots(spark, d)), keys=("acq_date",))))


# --------------------------------------------------------------------------- J5 (+ A1 per site)
def _site_fires(spark, d):
    pts = td.hotspots(spark, d).filter(F.col("confidence") >= 80)
    return hs.daily_hotspots(hs.assign_sites(pts, td.sites(spark, d)), keys=("site_id", "acq_date"))


_SITE_FIRES = """
site_fires as (
  select s.site_id, h.acq_date as date, count(*) as fire_count, 1 as Incendio,
    avg(h.brightness) as avg_brightness, avg(h.frp) as avg_frp, max(h.confidence) as max_confidence
  from hotspots h join sites s
    on h.latitude between s.south and s.north and h.longitude between s.west and s.east
  where h.confidence >= 80 group by 1, 2)"""

register("hotspot_sites", wrap(with_views("hotspots", "sites", extra=_SITE_FIRES) + "select * from site_fires",
                               _A1_D))(lambda spark, d: rounded(_site_fires(spark, d)))


# --------------------------------------------------------------------------- S2
def _hourly_stats(spark, d):
    return files.flatten_hourly(td.hourly_json(spark, d), "body", ("site_id", "date"), HV)


_HOURLY_STATS = "hourly_stats as (select site_id, date, " + ", ".join(
    f"avg({v}) as {v}_mean, max({v}) as {v}_max, min({v}) as {v}_min, stddev_samp({v}) as {v}_std" for v in HV
) + " from hourly group by 1, 2)"

register("hourly_stats", wrap(with_views("hourly", extra=_HOURLY_STATS) + "select * from hourly_stats", _HOURLY_D))(
    lambda spark, d: rounded(_hourly_stats(spark, d)))

# --------------------------------------------------------------------------- S3
_DAILY_D = ["Temperature", "Temperature_Max", "Temperature_Min", "Relative_Humidity", "Precipitation",
            "Solar_Radiation", "Evapotranspiration", "Vapor_Pressure_Deficit"]
register("daily_flatten", wrap(with_views("obs_daily") + """
select site_id, date, temperatura as Temperature, temp_max as Temperature_Max, temp_min as Temperature_Min,
  humedad as Relative_Humidity, precipitacion as Precipitation, temperatura * 10 as Solar_Radiation,
  velocidad_viento / 10 as Evapotranspiration, (100 - humedad) / 25 as Vapor_Pressure_Deficit
from obs_daily""", _DAILY_D))(
    lambda spark, d: rounded(files.flatten_daily(td.daily_json(spark, d), "body", ("site_id",))))


# --------------------------------------------------------------------------- J1
def _weather_fire(spark, d, weather):
    ingested = td.hotspots(spark, d).select(F.col("acq_date").alias("date")).distinct()
    return hs.join_weather_fires(weather, _site_fires(spark, d), ("site_id", "date"), ingested)


_J1 = """
select w.*, coalesce(f.fire_count, case when i.date is not null then 0 end) as fire_count,
  coalesce(f.Incendio, case when i.date is not null then 0 end) as Incendio,
  f.avg_brightness, f.avg_frp, f.max_confidence
from {weather} w left join site_fires f on w.site_id = f.site_id and w.date = f.date
left join (select distinct acq_date as date from hotspots) i on w.date = i.date"""

register("weather_fire_join", wrap(with_views("hotspots", "sites", "hourly", extra=_SITE_FIRES + """,
weather as (select site_id, date, avg(temperature_2m) as temperature_2m_mean from hourly group by 1, 2)""")
    + _J1.format(weather="weather"), ["temperature_2m_mean"] + _A1_D))(
    lambda spark, d: rounded(_weather_fire(spark, d, td.hourly_readings(spark, d).groupBy("site_id", "date").agg(
        F.avg("temperature_2m").alias("temperature_2m_mean")))))

# --------------------------------------------------------------------------- X1 (S2 + J5/P1 + A1 + J1)
register("etl_daily", wrap(with_views("hotspots", "sites", "hourly", extra=_SITE_FIRES + ",\n" + _HOURLY_STATS)
                           + _J1.format(weather="hourly_stats"), _HOURLY_D + _A1_D))(
    lambda spark, d: rounded(_weather_fire(spark, d, _hourly_stats(spark, d))))


# --------------------------------------------------------------------------- O4
def _append(spark, d):
    daily = hs.daily_hotspots(hs.filter_bbox(td.hotspots(spark, d)), keys=("acq_date",))
    first = daily.filter(F.col("date") < F.lit("2024-01-16").cast("date"))
    later = daily.filter(F.col("date") >= F.lit("2024-01-16").cast("date")).drop("max_confidence")
    return hs.append_days(first, later)


register("append_days", wrap(with_views("hotspots") + f"""
select date, fire_count, Incendio, avg_brightness, avg_frp,
  case when date < date '2024-01-16' then max_confidence end as max_confidence
from (select acq_date as date, {_A1} from hotspots where {_P1} group by 1) t""", _A1_D))(
    lambda spark, d: rounded(_append(spark, d)))
