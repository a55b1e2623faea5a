"""Feature blocks: calendar (C11), meteorological (C12), interactions (F12),
rolling windows (C13 = E4 + E5) and last-N statistics (E6).

All expressions of a block go into one projection; all rolling expressions
share one window specification, so Spark sorts each site's series once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import meteo
from .scan import parts_for, running_sums


def temporal_features(df: DataFrame, date_col: str = "date", style: str = "clean") -> DataFrame:
    """C11. ``style="clean"``: year, month, day_of_year, quarter, is_dry_season and
    month/day sin-cos. ``style="feature"``: the Spanish block with day, ISO week
    and season text."""
    d = F.col(date_col).cast("date")
    if style == "clean":
        month, doy = F.month(d), F.dayofyear(d)
        ms, mc = cal.cyclic(month, 12)
        ds, dc = cal.cyclic(doy, 365)
        return df.withColumns({
            "year": F.year(d), "month": month, "day_of_year": doy, "quarter": F.quarter(d),
            "is_dry_season": cal.is_dry_season(month),
            "month_sin": ms, "month_cos": mc, "day_sin": ds, "day_cos": dc,
        })
    if style == "feature":
        month, doy = F.month(d), F.dayofyear(d)
        ms, mc = cal.cyclic(month, 12)
        ds, dc = cal.cyclic(doy, 365)
        return df.withColumns({
            "año": F.year(d), "mes": month, "dia": F.dayofmonth(d), "dia_año": doy,
            "semana_año": F.weekofyear(d), "trimestre": F.quarter(d),
            "mes_sin": ms, "mes_cos": mc, "dia_año_sin": ds, "dia_año_cos": dc,
            "estacion": cal.season(month),
        })
    raise ValueError("style must be 'clean' or 'feature'")


def meteo_features(df: DataFrame, temp="temperatura", humidity="humedad", wind="velocidad_viento",
                   precip="precipitacion", tmax="temp_max", tmin="temp_min") -> DataFrame:
    """Each feature only when its inputs exist."""
    have = set(df.columns)
    new = {}
    if precip in have:
        new["indice_sequia"] = meteo.drought_index(precip)
    if temp in have and humidity in have:
        new["indice_calor"] = meteo.heat_index(temp, humidity)
        new["vpd"] = meteo.vapour_pressure_deficit(temp, humidity)
    if tmax in have and tmin in have:
        new["amplitud_termica"] = meteo.thermal_amplitude(tmax, tmin)
    if wind in have and humidity in have:
        new["ratio_viento_humedad"] = meteo.wind_humidity_ratio(wind, humidity)
    return df.withColumns(new) if new else df


def interactions(df: DataFrame, temp="temperatura", humidity="humedad", wind="velocidad_viento",
                 precip="precipitacion") -> DataFrame:
    """t*v, t*(100-h), v/(p+1), t/(p+1); each only when its inputs exist."""
    have = set(df.columns)
    t, h, v, p = F.col(temp), F.col(humidity), F.col(wind), F.col(precip)
    new = {}
    if temp in have and wind in have:
        new["temp_x_viento"] = t * v
    if temp in have and humidity in have:
        new["temp_x_humedad"] = t * (100 - h)
    if wind in have and precip in have:
        new["viento_x_precip"] = F.try_divide(v, p + 1)
    if temp in have and precip in have:
        new["temp_x_precip"] = F.try_divide(t, p + 1)
    return df.withColumns(new) if new else df


def rolling_features(df: DataFrame, value_cols, partition=("site_id",), order: str = "date",
                     windows=(7, 30), precip: str | None = "precipitacion", block: int | None = None) -> DataFrame:
    """``<col>_ma<n>`` = mean of the last n rows (min_periods 1, NULLs
    skipped) and ``precip_acum_<n>d`` = sum of the last n rows (all-NULL -> NULL).

    Frames count rows, not days; run ``complete_calendar`` first to make them
    days. Columns are explicit: never the target (no label leak). One series is
    one window task, and tasks are as many as the rows (counted) ask for; with ``block`` (rows) a series of any length is cut into
    blocks that carry the longest window's rows along."""
    r, w = df, Window.partitionBy(*[F.col(p) for p in partition]).orderBy(F.col(order))
    if block:
        r = _in_blocks(df, partition, [order], max(windows), block)
        w = Window.partitionBy(*partition, "_block").orderBy("_rn")
    else:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n_tasks = parts_for(df.count(), least)
        r = df.repartition(n_tasks, *partition) if n_tasks > least else df
    new = {}
    for c in value_cols:
        for n in windows:
            new[f"{c}_ma{n}"] = F.avg(c).over(w.rowsBetween(-(n - 1), 0))
    if precip and precip in df.columns:
        for n in windows:
            new[f"precip_acum_{n}d"] = F.sum(precip).over(w.rowsBetween(-(n - 1), 0))
    out = r.withColumns(new)
    return out.filter("_ahead = 0").drop("_rn", "_block", "_ahead") if block else out


def _in_blocks(df: DataFrame, partition, order, n: int, block: int, partitions: int | None = None) -> DataFrame:
    """Rows with their place in the series (``_rn``) and a ``_block`` of it; the last n - 1 rows of a block stand in the
    next one too, as context (``_ahead`` = 1)."""
    block = max(block, n)
    r = running_sums(df, {"_rn": F.lit(1)}, partition, order, partitions=partitions).withColumn("_rn", F.col("_rn") - 1)
    r = r.withColumn("_block", F.floor(F.col("_rn") / block))
    carried = F.when(F.col("_rn") % block > block - n, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return r.withColumn("_ahead", F.explode(carried)).withColumn("_block", F.col("_block") + F.col("_ahead"))


def last_n_stats(df: DataFrame, cols, partition=("station_id",), order: str = "ts", n: int = 100,
                 block: int = 10_000, tie=(), partitions: int | None = None) -> DataFrame:
    """Per reading, the mean of each column over the station's last n readings by ``order``; readings of equal
    time stand in the order of the ``tie`` columns, which should name a reading.

    A station may hold any share of all rows: its series is cut into blocks of
    ``block`` rows (n at least) by row number, the last n - 1 rows of a block
    are copied to the next one as context, and each window task sees one block."""
    r = _in_blocks(df, list(partition), [order, *tie], n, block, partitions)
    w = Window.partitionBy(*partition, "_block").orderBy("_rn").rowsBetween(-(n - 1), 0)
    out = r.withColumns({f"avg_{c}_last{n}": F.avg(c).over(w) for c in cols}) \
           .withColumn(f"readings_last{n}", F.count(F.lit(1)).over(w))
    return out.filter("_ahead = 0").drop("_rn", "_block", "_ahead")
