"""Cleaning queries: E1, C1, C2, C3, C4, O3, A3, A5, O1."""

from __future__ import annotations

from ..operators import clean
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

VALUES = ["temperatura", "humedad", "velocidad_viento", "precipitacion", "temp_max", "temp_min"]
OBS_COLS = ["date", "site_id", *VALUES, "incendio"]


def _cols(cols):
    return ", ".join(cols)


# --------------------------------------------------------------------------- E1
register("dedup_first", wrap(with_views("obs_dups") + """
select * exclude (rn) from (
  select *, row_number() over (partition by site_id, date order by ingest_seq) as rn from obs_dups) t
where rn = 1""", VALUES))(
    lambda spark, d: rounded(clean.dedup_first(td.obs_dups(spark, d), ("site_id", "date"), "ingest_seq")))

# --------------------------------------------------------------------------- C1
_fill3 = ",\n".join(
    f"coalesce({c}, last_value({c} ignore nulls) over wb, first_value({c} ignore nulls) over wa, "
    f"median({c}) over ()) as {c}" for c in VALUES)
register("fill_three_stage", wrap(with_views("obs_nulls") + f"""
select date, site_id, {_fill3}, incendio from obs_nulls
window wb as (partition by site_id order by date rows between unbounded preceding and current row),
       wa as (partition by site_id order by date rows between current row and unbounded following)""", VALUES))(
    lambda spark, d: rounded(clean.fill_three_stage(td.obs_nulls(spark, d), VALUES, ("site_id",), "date")))

# --------------------------------------------------------------------------- C2
_FILL_COLS = [*VALUES, "incendio"]
for _name, _agg in (("fill_mean", "avg"), ("fill_median", "median")):
    _sel = ", ".join(f"coalesce(cast({c} as double), s_{c}) as {c}" for c in _FILL_COLS)
    _st = ", ".join(f"{_agg}({c}) as s_{c}" for c in _FILL_COLS)
    register(_name, wrap(with_views("obs_nulls") + f"""
select date, site_id, {_sel} from obs_nulls cross join (select {_st} from obs_nulls) s""", _FILL_COLS))(
        (lambda strategy: lambda spark, d: rounded(
            clean.fill_simple(td.obs_nulls(spark, d), strategy, _FILL_COLS)))(_name.split("_")[1]))

register("drop_nulls", wrap(with_views("obs_nulls") + """
select * from obs_nulls where """ + " and ".join(f"{c} is not null" for c in OBS_COLS), VALUES))(
    lambda spark, d: rounded(clean.fill_simple(td.obs_nulls(spark, d), "drop")))

# --------------------------------------------------------------------------- C3
_flags = ",\n".join(
    f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3.0, false) as {c}_is_outlier" for c in VALUES)
_fst = ", ".join([f"avg({c}) as m_{c}" for c in VALUES] + [f"stddev_samp({c}) as s_{c}" for c in VALUES])
register("outlier_flags", wrap(with_views("obs_daily") + f"""
select {_cols(OBS_COLS)}, {_flags} from obs_daily cross join (select {_fst} from obs_daily) s""", VALUES))(
    lambda spark, d: rounded(clean.outlier_flags(td.obs_daily(spark, d), 3.0, VALUES)))

# --------------------------------------------------------------------------- C4
_keep = " and ".join(f"coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) < 3.0, false)" for c in VALUES)
_rst = ", ".join([f"avg({c}) as m_{c}" for c in VALUES] + [f"stddev_pop({c}) as s_{c}" for c in VALUES])
register("outlier_remove", wrap(with_views("obs_nulls") + f"""
select {_cols(OBS_COLS)} from obs_nulls cross join (select {_rst} from obs_nulls) s where {_keep}""", VALUES))(
    lambda spark, d: rounded(clean.outlier_remove(td.obs_nulls(spark, d), 3.0, VALUES)))

# --------------------------------------------------------------------------- O3
HOT_VALUES = ["confidence", "brightness", "frp"]
_hst = ", ".join([f"avg({c}) as m_{c}" for c in HOT_VALUES] + [f"stddev_samp({c}) as s_{c}" for c in HOT_VALUES])
_cnt = ", ".join(
    f"cast(count_if(coalesce(abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3.0, false)) as bigint) as {c}"
    for c in HOT_VALUES)
register("outlier_top", with_views("hotspots") + f"""
select column_name, outliers from (
  unpivot (select {_cnt} from hotspots cross join (select {_hst} from hotspots) s)
  on {_cols(HOT_VALUES)} into name column_name value outliers) u
where outliers > 0 order by outliers desc, column_name limit 5""")(
    lambda spark, d: clean.outlier_top(td.hotspots(spark, d), 3.0, HOT_VALUES, n=5))

# --------------------------------------------------------------------------- A3
_nc = ", ".join(f"cast(count_if({c} is null) as bigint) as {c}" for c in OBS_COLS)
register("null_counts", with_views("obs_nulls") + f"""
select column_name, null_count from (
  unpivot (select {_nc} from obs_nulls) on {_cols(OBS_COLS)} into name column_name value null_count) u""")(
    lambda spark, d: clean.null_counts(td.obs_nulls(spark, d), OBS_COLS))

# --------------------------------------------------------------------------- A5
register("target_check", with_views("obs_daily") + """
select n_rows, n_invalid, n_null, n_class0, n_class1,
  round(cast(100 as double) * n_class0 / n_rows, 4) as pct_class0,
  round(cast(100 as double) * n_class1 / n_rows, 4) as pct_class1
from (select count(*) as n_rows,
        cast(count_if(incendio is not null and incendio not in (0, 1)) as bigint) as n_invalid,
        cast(count_if(incendio is null) as bigint) as n_null,
        cast(count_if(incendio = 0) as bigint) as n_class0,
        cast(count_if(incendio = 1) as bigint) as n_class1 from obs_daily) t""")(
    lambda spark, d: clean.target_summary(td.obs_daily(spark, d), "incendio"))
