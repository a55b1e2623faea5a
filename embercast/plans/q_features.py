"""Feature queries: C11, C12, F12, E4, E5, S4 (calendar gaps), V9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import hotspots as hs
from ..operators import stats
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import ORACLE, register, rounded, wrap

VALUES = ["temperatura", "humedad", "velocidad_viento", "precipitacion", "temp_max", "temp_min"]
OBS_COLS = ["date", "site_id", *VALUES, "incendio"]
MA_COLS = ["temperatura", "humedad", "velocidad_viento", "precipitacion"]

# --------------------------------------------------------------------------- C11
_CYC = ["month_sin", "month_cos", "day_sin", "day_cos"]
register("temporal_features", wrap(with_views("obs_daily") + """
select *, sin(2*pi()*month/12.0) as month_sin, cos(2*pi()*month/12.0) as month_cos,
  sin(2*pi()*day_of_year/365.0) as day_sin, cos(2*pi()*day_of_year/365.0) as day_cos
from (select *, cast(year(date) as int) as year, cast(month(date) as int) as month,
        cast(dayofyear(date) as int) as day_of_year, cast(quarter(date) as int) as quarter,
        cast(month(date) in (5, 6, 7, 8, 9, 10) as int) as is_dry_season from obs_daily) t""", VALUES + _CYC))(
    lambda spark, d: rounded(fe.temporal_features(td.obs_daily(spark, d), "date", "clean")))

_FCYC = ["mes_sin", "mes_cos", "dia_año_sin", "dia_año_cos"]
register("temporal_features_es", wrap(with_views("obs_daily") + """
select *, sin(2*pi()*mes/12.0) as mes_sin, cos(2*pi()*mes/12.0) as mes_cos,
  sin(2*pi()*"dia_año"/365.0) as "dia_año_sin", cos(2*pi()*"dia_año"/365.0) as "dia_año_cos",
  case when mes in (12, 1, 2) then 'verano' when mes in (3, 4, 5) then 'otoño'
       when mes in (6, 7, 8) then 'invierno' when mes in (9, 10, 11) then 'primavera' end as estacion
from (select *, cast(year(date) as int) as "año", cast(month(date) as int) as mes,
        cast(day(date) as int) as dia, cast(dayofyear(date) as int) as "dia_año",
        cast(weekofyear(date) as int) as "semana_año", cast(quarter(date) as int) as trimestre
      from obs_daily) t""", VALUES + _FCYC))(
    lambda spark, d: rounded(fe.temporal_features(td.obs_daily(spark, d), "date", "feature")))

# --------------------------------------------------------------------------- C12
_MET = ["indice_sequia", "indice_calor", "vpd", "amplitud_termica", "ratio_viento_humedad"]
register("meteo_features", wrap(with_views("obs_daily") + """
select *, 1.0/(precipitacion + 1) as indice_sequia,
  temperatura * (1 - humedad/100) as indice_calor,
  0.6108*exp(17.27*temperatura/(temperatura + 237.3))
    - 0.6108*exp(17.27*temperatura/(temperatura + 237.3)) * (humedad/100) as vpd,
  temp_max - temp_min as amplitud_termica,
  velocidad_viento/(humedad + 1) as ratio_viento_humedad
from obs_daily""", VALUES + _MET))(
    lambda spark, d: rounded(fe.meteo_features(td.obs_daily(spark, d))))

# --------------------------------------------------------------------------- F12
_INT = ["temp_x_viento", "temp_x_humedad", "viento_x_precip", "temp_x_precip"]
register("interactions", wrap(with_views("obs_daily") + """
select *, temperatura*velocidad_viento as temp_x_viento, temperatura*(100 - humedad) as temp_x_humedad,
  velocidad_viento/(precipitacion + 1) as viento_x_precip, temperatura/(precipitacion + 1) as temp_x_precip
from obs_daily""", VALUES + _INT))(
    lambda spark, d: rounded(fe.interactions(td.obs_daily(spark, d))))

# --------------------------------------------------------------------------- E4, E5
_MA = [f"{c}_ma{n}" for c in MA_COLS for n in (7, 30)]
_ma_sql = ",\n".join(
    f"avg({c}) over (partition by site_id order by date rows between {n - 1} preceding and current row) as {c}_ma{n}"
    for c in MA_COLS for n in (7, 30))
register("rolling_ma", wrap(with_views("obs_daily") + f"""
select site_id, date, {_ma_sql} from obs_daily""", _MA))(
    lambda spark, d: rounded(fe.rolling_features(td.obs_daily(spark, d), MA_COLS, precip=None)
                             .select("site_id", "date", *_MA)))

register("rain_accum", wrap(with_views("obs_daily") + """
select site_id, date,
  sum(precipitacion) over (partition by site_id order by date rows between 6 preceding and current row) as precip_acum_7d,
  sum(precipitacion) over (partition by site_id order by date rows between 29 preceding and current row) as precip_acum_30d
from obs_daily""", ["precip_acum_7d", "precip_acum_30d"]))(
    lambda spark, d: rounded(fe.rolling_features(td.obs_daily(spark, d), [], precip="precipitacion")
                             .select("site_id", "date", "precip_acum_7d", "precip_acum_30d")))

# --------------------------------------------------------------------------- S4
register("calendar_gaps", wrap(with_views("obs_daily", extra="""
span as (select site_id, min(date) as lo, max(date) as hi from obs_daily group by 1),
cal as (select site_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from span)""") + """
select c.site_id, c.date, o.temperatura, o.incendio, o.date is null as is_missing_day
from cal c left join obs_daily o on c.site_id = o.site_id and c.date = o.date""", ["temperatura"]))(
    lambda spark, d: rounded(hs.complete_calendar(
        td.obs_daily(spark, d).select("site_id", "date", "temperatura", "incendio"), ("site_id",), "date")))

# rolling means over calendar days (gaps filled first): 7 rows = 7 days
register("rolling_ma_calendar", wrap(with_views("obs_daily", extra="""
span as (select site_id, min(date) as lo, max(date) as hi from obs_daily group by 1),
cal as (select site_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from span),
full_cal as (select c.site_id, c.date, o.temperatura from cal c left join obs_daily o
             on c.site_id = o.site_id and c.date = o.date)""") + """
select site_id, date, temperatura,
  avg(temperatura) over (partition by site_id order by date rows between 6 preceding and current row) as temperatura_ma7
from full_cal""", ["temperatura", "temperatura_ma7"]))(
    lambda spark, d: rounded(fe.rolling_features(
        hs.complete_calendar(td.obs_daily(spark, d).select("site_id", "date", "temperatura"), ("site_id",), "date"),
        ["temperatura"], windows=(7,), precip=None).select("site_id", "date", "temperatura", "temperatura_ma7")))

# --------------------------------------------------------------------------- V9
register("series_long", wrap(with_views("obs_daily") + """
select site_id, date, variable, value, incendio = 1 as is_fire from (
  unpivot (select site_id, date, incendio, temperatura, humedad, velocidad_viento, precipitacion from obs_daily)
  on temperatura, humedad, velocidad_viento, precipitacion into name variable value value) u""", ["value"]))(
    lambda spark, d: rounded(stats.series_long(td.obs_daily(spark, d), MA_COLS, "date", "incendio", ("site_id",))))

# --------------------------------------------------------------------------- E6 (batch twin of the stream)
register("last100", wrap(with_views("obs_daily") + """
select site_id, date,
  avg(temperatura) over w as avg_temperatura_last100,
  avg(humedad) over w as avg_humedad_last100,
  count(*) over w as readings_last100
from obs_daily window w as (partition by site_id order by date rows between 99 preceding and current row)""",
    ["avg_temperatura_last100", "avg_humedad_last100"]))(
    lambda spark, d: rounded(fe.last_n_stats(td.obs_daily(spark, d), ["temperatura", "humedad"],
                                             ("site_id",), "date", 100)
                             .select("site_id", "date", "avg_temperatura_last100", "avg_humedad_last100",
                                     "readings_last100")))



# --------------------------------------------------------------------------- E6 on readings (hot stations, equal times)
def _last_readings(spark, d):
    from ..session import table
    from ..streaming.monitor import to_readings
    r = to_readings(table(spark, d, "events")).withColumn("ts", F.date_trunc("hour", "ts"))  # many readings of equal time
    out = fe.last_n_stats(r, ["temperatura", "humedad"], ("station_id",), "ts", 100, tie=("event_id",))
    return rounded(out.select("station_id", "event_id", "avg_temperatura_last100", "avg_humedad_last100", "readings_last100"))


register("last100_readings", wrap("""
with r as (select user_id as station_id, event_id, date_trunc('hour', cast(ts as timestamp)) as ts,
    cast(10 + cast(trunc(value) as int) % 25 as double) as temperatura, cast(30 + event_id % 60 as double) as humedad from events)
select station_id, event_id, avg(temperatura) over w as avg_temperatura_last100, avg(humedad) over w as avg_humedad_last100,
  count(*) over w as readings_last100
from r window w as (partition by station_id order by ts, event_id rows between 99 preceding and current row)""",
    ["avg_temperatura_last100", "avg_humedad_last100"]))(_last_readings)

register("rolling_ma_blocks", ORACLE["rolling_ma"])(
    lambda spark, d: rounded(fe.rolling_features(td.obs_daily(spark, d), MA_COLS, precip=None, block=100).select("site_id", "date", *_MA)))
