"""Statistics queries: A2, A4, A6, A7, A8, A9, A10, A16, A17."""

from __future__ import annotations

from ..operators import stats
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

VALUES = ["temperatura", "humedad", "velocidad_viento", "precipitacion", "temp_max", "temp_min"]

# --------------------------------------------------------------------------- A2
_desc = "\nunion all\n".join(
    f"select '{c}' as column_name, count({c}) as count, round(avg({c}), 2) as mean, "
    f"round(stddev_samp({c}), 2) as std, round(min({c}), 2) as min, round(quantile_cont({c}, 0.25), 2) as p25, "
    f"round(quantile_cont({c}, 0.5), 2) as p50, round(quantile_cont({c}, 0.75), 2) as p75, "
    f"round(max({c}), 2) as max from obs_daily" for c in VALUES)
register("describe", with_views("obs_daily") + _desc)(
    lambda spark, d: stats.describe(td.obs_daily(spark, d), VALUES, digits=2))

# --------------------------------------------------------------------------- A16
_cs = "\nunion all\n".join(
    f"select '{c}' as column_name, avg({c}) as mean, median({c}) as median, "
    f"stddev_samp({c}) as std_samp, stddev_pop({c}) as std_pop from obs_daily" for c in VALUES)
register("column_stats", wrap(with_views("obs_daily") + _cs, ["mean", "median", "std_samp", "std_pop"]))(
    lambda spark, d: rounded(stats.column_stats(td.obs_daily(spark, d), VALUES)))

# --------------------------------------------------------------------------- A17
register("date_extent", with_views("obs_daily") + """
select site_id, min(date) as first_date, max(date) as last_date, count(*) as n_rows from obs_daily group by 1""")(
    lambda spark, d: stats.date_extent(td.obs_daily(spark, d), "date", by=("site_id",)))

# --------------------------------------------------------------------------- A4
register("class_balance", wrap(with_views("obs_daily") + """
select incendio, count(*) as n, cast(count(*) as double) / sum(count(*)) over () as share
from obs_daily group by 1""", ["share"]))(
    lambda spark, d: rounded(stats.class_balance(td.obs_daily(spark, d), "incendio")))

# --------------------------------------------------------------------------- A6
register("seasonal", wrap(with_views("obs_daily") + """
select cast(month(date) as int) as month, cast(sum(incendio) as bigint) as fires, count(incendio) as days,
  cast(100 as double) * sum(incendio) / count(incendio) as rate
from obs_daily group by 1""", ["rate"]))(
    lambda spark, d: rounded(stats.seasonal(td.obs_daily(spark, d), "date", "incendio")))

# --------------------------------------------------------------------------- A7, A8
_CORR_COLS = VALUES + ["incendio"]


def _corr_sql(a: str, b: str) -> str:
    return (f"covar_samp({a}, {b}) / nullif(stddev_samp(case when {b} is not null then {a} end) * "
            f"stddev_samp(case when {a} is not null then {b} end), 0)")


_pairs = [(a, b) for a in _CORR_COLS for b in _CORR_COLS]
_cm = "\nunion all\n".join(
    f"select '{a}' as col_a, '{b}' as col_b, {_corr_sql(a, b)} as corr from obs_daily" for a, b in _pairs)
register("corr_matrix", wrap(with_views("obs_daily") + _cm, ["corr"]))(
    lambda spark, d: rounded(stats.corr_matrix(td.obs_daily(spark, d), _CORR_COLS)))

_ct = "\nunion all\n".join(
    f"select '{c}' as column_name, {_corr_sql(c, 'incendio')} as corr from obs_daily" for c in VALUES)
register("corr_target", wrap(with_views("obs_daily") + _ct, ["corr"]))(
    lambda spark, d: rounded(stats.corr_target(td.obs_daily(spark, d), "incendio", VALUES)))

# --------------------------------------------------------------------------- A9
register("hist_density", wrap(with_views("obs_daily", extra="""
st0 as (select incendio, min(temperatura) as mn, max(temperatura) as mx, count(temperatura) as n
        from obs_daily where temperatura is not null group by 1),
st as (select incendio, n,
         cast(case when mx > mn then mn else mn - 0.5 end as double) as lo,
         cast(case when mx > mn then mx else mx + 0.5 end as double) as hi from st0),
stw as (select *, (hi - lo) / 30 as w from st),
binned as (select o.incendio, cast(least(floor((o.temperatura - s.lo) / s.w), 29) as int) as bin
           from obs_daily o join stw s on o.incendio = s.incendio where o.temperatura is not null),
counts as (select incendio, bin, count(*) as cnt from binned group by 1, 2),
grid as (select incendio, lo, w, n, cast(unnest(generate_series(0, 29)) as int) as bin from stw)""") + """
select g.incendio, g.bin, g.lo + g.bin * g.w as bin_lo, g.lo + (g.bin + 1) * g.w as bin_hi,
  coalesce(c.cnt, 0) as count, coalesce(c.cnt, 0) / (g.n * g.w) as density
from grid g left join counts c on g.incendio = c.incendio and g.bin = c.bin""", ["bin_lo", "bin_hi", "density"]))(
    lambda spark, d: rounded(stats.hist_density(td.obs_daily(spark, d), "temperatura", "incendio", 30)))

# --------------------------------------------------------------------------- A10
register("box_stats", wrap(with_views("obs_daily", extra="""
q as (select incendio, quantile_cont(humedad, 0.25) as q1, quantile_cont(humedad, 0.5) as median,
        quantile_cont(humedad, 0.75) as q3 from obs_daily where humedad is not null group by 1),
qi as (select *, q3 - q1 as iqr from q)""") + """
select qi.incendio, q1, median, q3, iqr, count(*) as n,
  min(case when o.humedad between q1 - 1.5*iqr and q3 + 1.5*iqr then o.humedad end) as whisker_low,
  max(case when o.humedad between q1 - 1.5*iqr and q3 + 1.5*iqr then o.humedad end) as whisker_high,
  cast(count_if(not (o.humedad between q1 - 1.5*iqr and q3 + 1.5*iqr)) as bigint) as n_outliers
from obs_daily o join qi on o.incendio = qi.incendio where o.humedad is not null
group by qi.incendio, q1, median, q3, iqr""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]))(
    lambda spark, d: rounded(stats.box_stats(td.obs_daily(spark, d), "humedad", "incendio")))
