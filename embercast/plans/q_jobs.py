"""Composite-job queries: X2 (clean_job), X4 (feature_job, the flagship), X3
(model_ready). The SQL texts are generated from the same column lists."""

from __future__ import annotations

from ..operators import clean
from ..sources import testdata as td
from . import jobs
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

VALUES = jobs.VALUES
MA = jobs.MA_COLS
_WIN = """window wb as (partition by site_id order by date rows between unbounded preceding and current row),
       wa as (partition by site_id order by date rows between current row and unbounded following)"""


def _fill(src: str, extra_cols: str) -> str:
    f = ",\n  ".join(
        f"coalesce({c}, last_value({c} ignore nulls) over wb, first_value({c} ignore nulls) over wa, "
        f"median({c}) over ()) as {c}" for c in VALUES)
    return f"select date, site_id, {f}, {extra_cols} from {src}\n{_WIN}"


# --------------------------------------------------------------------------- X2
_FLAGS = ", ".join(f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3.0, false) as {c}_is_outlier" for c in VALUES)
_FST = ", ".join([f"avg({c}) as m_{c}" for c in VALUES] + [f"stddev_samp({c}) as s_{c}" for c in VALUES])
_TEMPORAL = """cast(year(date) as int) as year, cast(month(date) as int) as month,
  cast(dayofyear(date) as int) as day_of_year, cast(quarter(date) as int) as quarter,
  cast(month(date) in (5, 6, 7, 8, 9, 10) as int) as is_dry_season,
  sin(2*pi()*month(date)/12.0) as month_sin, cos(2*pi()*month(date)/12.0) as month_cos,
  sin(2*pi()*dayofyear(date)/365.0) as day_sin, cos(2*pi()*dayofyear(date)/365.0) as day_cos"""

register("clean_job", wrap(with_views("obs_raw", extra=f"""
dd as (select * exclude (rn) from (
         select *, row_number() over (partition by site_id, date order by ingest_seq) as rn from obs_raw) t
       where rn = 1),
filled as ({_fill("dd", "incendio, ingest_seq")}),
flagged as (select filled.*, {_FLAGS} from filled cross join (select {_FST} from filled) s)""") + f"""
select *, {_TEMPORAL} from flagged""", VALUES + ["month_sin", "month_cos", "day_sin", "day_cos"]))(
    lambda spark, d: rounded(jobs.clean_job(td.obs_raw(spark, d), VALUES)))

# --------------------------------------------------------------------------- X4 (flagship)
_MET = ["indice_sequia", "indice_calor", "vpd", "amplitud_termica", "ratio_viento_humedad"]
_INT = ["temp_x_viento", "temp_x_humedad", "viento_x_precip", "temp_x_precip"]
_ROLL = [f"{c}_ma{n}" for c in MA for n in (7, 30)] + ["precip_acum_7d", "precip_acum_30d"]
_TEMP_NUM = ['"dia_año"', '"semana_año"', "trimestre", "mes_sin", "mes_cos", '"dia_año_sin"', '"dia_año_cos"']
SCALED = VALUES + [c.strip('"') for c in _TEMP_NUM] + _MET + _ROLL + _INT
_roll_sql = ",\n  ".join(
    [f"avg({c}) over (partition by site_id order by date rows between {n - 1} preceding and current row) "
     f"as {c}_ma{n}" for c in MA for n in (7, 30)]
    + [f"sum(precipitacion) over (partition by site_id order by date rows between {n - 1} preceding and current row) "
       f"as precip_acum_{n}d" for n in (7, 30)])
_scale_sql = ",\n  ".join(
    f'("{c}" - avg("{c}") over ()) / case when stddev_pop("{c}") over () = 0 then 1 '
    f'else stddev_pop("{c}") over () end as "{c}"' for c in SCALED)

FEATURE_SQL = with_views("obs_nulls", extra=f"""
filled as ({_fill("obs_nulls", "incendio")}),
t1 as (select *, cast(year(date) as int) as "año", cast(month(date) as int) as mes, cast(day(date) as int) as dia,
         cast(dayofyear(date) as int) as "dia_año", cast(weekofyear(date) as int) as "semana_año",
         cast(quarter(date) as int) as trimestre,
         sin(2*pi()*month(date)/12.0) as mes_sin, cos(2*pi()*month(date)/12.0) as mes_cos,
         sin(2*pi()*dayofyear(date)/365.0) as "dia_año_sin", cos(2*pi()*dayofyear(date)/365.0) as "dia_año_cos",
         case when month(date) in (12, 1, 2) then 'verano' when month(date) in (3, 4, 5) then 'otoño'
              when month(date) in (6, 7, 8) then 'invierno' else 'primavera' end as estacion
       from filled),
t2 as (select *, 1.0/(precipitacion + 1) as indice_sequia, temperatura * (1 - humedad/100) as indice_calor,
         0.6108*exp(17.27*temperatura/(temperatura + 237.3))
           - 0.6108*exp(17.27*temperatura/(temperatura + 237.3)) * (humedad/100) as vpd,
         temp_max - temp_min as amplitud_termica, velocidad_viento/(humedad + 1) as ratio_viento_humedad
       from t1),
t3 as (select *, {_roll_sql} from t2),
t4 as (select *, temperatura*velocidad_viento as temp_x_viento, temperatura*(100 - humedad) as temp_x_humedad,
         velocidad_viento/(precipitacion + 1) as viento_x_precip, temperatura/(precipitacion + 1) as temp_x_precip
       from t3)""") + f"""
select date, site_id, "año", mes, dia, estacion, cast(incendio as int) as incendio,
  {_scale_sql}
from t4"""


def _feature_job(spark, d):
    filled = clean.fill_three_stage(td.obs_nulls(spark, d), VALUES, ("site_id",), "date")
    return rounded(jobs.feature_job(filled))


register("feature_job", wrap(FEATURE_SQL, SCALED))(_feature_job)

# --------------------------------------------------------------------------- X3
_FILL_COLS = VALUES + ["incendio"]
_mean_sel = ", ".join(f"coalesce(cast({c} as double), f_{c}) as {c}" for c in _FILL_COLS)
_mean_st = ", ".join(f"avg({c}) as f_{c}" for c in _FILL_COLS)
_keep = " and ".join(f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) < 3.5, false)" for c in VALUES)
_rst = ", ".join([f"avg({c}) as m_{c}" for c in VALUES] + [f"stddev_pop({c}) as s_{c}" for c in VALUES])
_tst = ", ".join([f"avg({c}) as tm_{c}" for c in VALUES] + [f"stddev_pop({c}) as ts_{c}" for c in VALUES])
_tsc = ", ".join(f"({c} - tm_{c}) / case when ts_{c} = 0 then 1 else ts_{c} end as {c}" for c in VALUES)
_H = "md5(concat_ws('|', site_id, date, '42'))"
register("model_ready", wrap(with_views("obs_nulls", extra=f"""
mf as (select date, site_id, {_mean_sel} from obs_nulls cross join (select {_mean_st} from obs_nulls) s),
kept as (select date, site_id, {", ".join(VALUES)}, cast(incendio as int) as incendio
         from mf cross join (select {_rst} from mf) s where {_keep}),
split as (select *, row_number() over (partition by incendio order by {_H})
                    <= round(0.2 * count(*) over (partition by incendio)) as is_test from kept)""") + f"""
select date, site_id, {_tsc}, incendio, is_test
from split cross join (select {_tst} from split where not is_test) st""", VALUES))(
    lambda spark, d: rounded(jobs.model_ready(td.obs_nulls(spark, d), "incendio", VALUES)))
