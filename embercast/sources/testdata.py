"""Adapters: domain-shaped DataFrames derived from the driver's TPC-H-ish tables.

Multipliers are binary fractions (0.25, 0.5, 0.75): sums of such values are exact
in any order, so averages agree bit for bit across engines and partitionings.

The testdata holds no weather or satellite tables, so these views give the domain
shapes with integer arithmetic only (scale-free label rate, no float-order
effects). Every adapter is lazy and reads whole tables; its work grows with them.

* ``obs_daily``  one row per (site_id, date): site = supplier, day = ship date.
* ``hotspots``   one satellite detection per event (lat/lon/confidence/frp).
* ``sites``      one study box per nation (25 rows at every scale: a bounded dimension).
* ``obs_nulls``  obs_daily with gaps in three variables (for the fill operators).
* ``obs_dups``   obs_daily plus a re-delivered copy, with ``ingest_seq`` = file order.
* ``obs_raw``    obs_dups with the gaps of obs_nulls (input of the cleaning job).
* ``scored``     labelled scores (100 distinct values, heavy ties) for the curves.
* ``hourly_json`` hourly weather replies per (site, day), JSON text (<= 24 values).
* ``daily_json`` daily weather replies per (site, month), JSON text (<= 31 days).
* ``scoring_rows`` / ``score_request_bodies`` the 24-feature scoring vocabulary and
  landed bulk-scoring requests per (site, month) (<= 31 rows each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..session import table


def _d(x: float) -> Column:
    return F.lit(x).cast("double")


def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = li.groupBy(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("int").alias("site_id"),
    ).agg(
        (F.sum("l_orderkey") % 101).cast("int").alias("ti"),
        (F.sum("l_partkey") % 101).cast("int").alias("hi"),
        ((F.sum(F.col("l_orderkey") * 7 + F.col("l_partkey") * 5) % 61).cast("int") - 30).alias("ni"),
        (F.sum(F.col("l_partkey") * 3 + F.col("l_linenumber") * 11) % 101).cast("int").alias("vi"),
        (F.sum(F.col("l_orderkey") * 3 + F.col("l_linenumber") * 13) % 101).cast("int").alias("pi"),
    )
    t = 15 + F.col("ti") * _d(0.25)
    return k.select(
        "date", "site_id",
        t.alias("temperatura"),
        (20 + F.col("hi") * _d(0.75)).alias("humedad"),
        (F.col("vi") * _d(0.5)).alias("velocidad_viento"),
        (F.greatest(F.col("pi") - 60, F.lit(0)) * _d(0.5)).alias("precipitacion"),
        (t + 1 + (F.col("vi") % 9) * _d(0.5)).alias("temp_max"),
        (t - 1 - (F.col("pi") % 7) * _d(0.5)).alias("temp_min"),
        F.when(F.col("ti") - F.col("hi") + F.col("ni") > 50, 1).otherwise(0).alias("incendio"),
    )


def obs_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps: temperatura where day-of-year % 11 < 3, humedad where % 13 < 2,
    velocidad_viento on the first two days of every year (leading gaps)."""
    o = obs_daily(spark, sf_dir)
    doy = F.dayofyear("date")
    return o.withColumns({
        "temperatura": F.when(doy % 11 >= 3, F.col("temperatura")),
        "humedad": F.when(doy % 13 >= 2, F.col("humedad")),
        "velocidad_viento": F.when(doy > 2, F.col("velocidad_viento")),
    })


def obs_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original rows have ingest_seq 1; a re-delivered copy (temperatura + 1) comes
    first (seq 0) on days where (site_id + day-of-year) is even, last (seq 2) else."""
    o = obs_daily(spark, sf_dir)
    copy_seq = F.when((F.col("site_id") + F.dayofyear("date")) % 2 == 0, 0).otherwise(2)
    return o.withColumn("ingest_seq", F.lit(1)).unionByName(
        o.withColumn("temperatura", F.col("temperatura") + 1)
         .withColumn("ingest_seq", copy_seq)
    )


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed daily rows as a cleaning job sees them: re-deliveries (obs_dups)
    and the gaps of obs_nulls."""
    o = obs_dups(spark, sf_dir)
    doy = F.dayofyear("date")
    return o.withColumns({
        "temperatura": F.when(doy % 11 >= 3, F.col("temperatura")),
        "humedad": F.when(doy % 13 >= 2, F.col("humedad")),
        "velocidad_viento": F.when(doy > 2, F.col("velocidad_viento")),
    })


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.to_date("ts").alias("acq_date"),
        F.get_json_object("props", "$.k").cast("int").alias("confidence"),
        (300 + F.col("value")).alias("brightness"),
        F.col("value").alias("frp"),
        (_d(-17.8) + (F.col("user_id") % 100).cast("double") / 100 + 0.005).alias("latitude"),
        (_d(-66.7) + (F.col("event_id") % 120).cast("double") / 100 + 0.005).alias("longitude"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 x 5 boxes of 0.2 x 0.24 degrees tiling the detection area, one per nation."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("int")
    south = _d(-17.8) + (k % 5).cast("double") * 0.2
    west = _d(-66.7) + F.floor(k / 5).cast("double") * 0.24
    return n.select(
        k.alias("site_id"),
        south.alias("south"), (south + 0.2).alias("north"),
        west.alias("west"), (west + 0.24).alias("east"),
    )


def scored_readings(events: DataFrame) -> DataFrame:
    """T9 sensor readings from events (batch or streaming): one station per
    user, event time as TIMESTAMP, and the probability landed with each event
    (k / 100) with its class (>= .5)."""
    prob = F.get_json_object("props", "$.k").cast("int").cast("double") / 100
    v = F.col("value").cast("int")
    return events.select(
        F.col("user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (10 + v % 25).cast("double").alias("temperatura"),
        (30 + F.col("event_id") % 60).cast("double").alias("humedad"),
        ((v * 7) % 40).cast("double").alias("velocidad_viento"),
        prob.alias("probability_fire"), (prob >= 0.5).cast("int").alias("prediction"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    prob = F.get_json_object("props", "$.k").cast("int").cast("double") / 100
    return ev.select(
        F.col("event_id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        prob.alias("prob"),
        (prob >= 0.5).cast("int").alias("pred"),
    )


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly station readings per site: events located in a site's box, averaged
    per (site, day, hour). At most 24 rows per (site, day)."""
    from ..operators.hotspots import assign_sites

    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "value",
        (_d(-17.8) + (F.col("user_id") % 100).cast("double") / 100 + 0.005).alias("latitude"),
        (_d(-66.7) + (F.col("event_id") % 120).cast("double") / 100 + 0.005).alias("longitude"),
    )
    located = assign_sites(ev, sites(spark, sf_dir))
    v = F.col("value").cast("int")
    return located.groupBy(
        "site_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour")
    ).agg(
        F.avg(10 + v % 25).alias("temperature_2m"),
        F.avg(30 + (F.col("event_id") % 60)).alias("relative_humidity_2m"),
        F.avg((v * 7) % 40).alias("wind_speed_10m"),
    )


HOURLY_VARIABLES = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"]


def hourly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed hourly reply per (site_id, date): ``{"hourly": {"variables":
    [{"name": ..., "values": [...]}, ...]}}`` with values in hour order."""
    h = hourly_readings(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("hour", *HOURLY_VARIABLES)))
    g = h.groupBy("site_id", "date").agg(ordered.alias("hrs"))
    variables = F.array(*[
        F.struct(F.lit(v).alias("name"), F.col("hrs")[v].alias("values"))
        for v in HOURLY_VARIABLES
    ])
    return g.select(
        "site_id", "date",
        F.to_json(F.struct(F.struct(variables.alias("variables")).alias("hourly"))).alias("body"),
    )


# Daily reply arrays built from obs_daily columns (source name -> expression).
def _daily_values() -> dict[str, Column]:
    return {
        "temperature_2m_mean": F.col("temperatura"),
        "temperature_2m_max": F.col("temp_max"),
        "temperature_2m_min": F.col("temp_min"),
        "relative_humidity_2m": F.col("humedad"),
        "precipitation_sum": F.col("precipitacion"),
        "shortwave_radiation_sum": F.col("temperatura") * 10,
        "et0_fao_evapotranspiration": F.col("velocidad_viento") / 10,
        "vapor_pressure_deficit_mean": (100 - F.col("humedad")) / 25,
    }


def daily_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed daily reply per (site_id, month): ``{"daily": {"time": [...],
    "<variable>": [...]}}``, parallel arrays in date order (<= 31 entries)."""
    o = obs_daily(spark, sf_dir)
    vals = _daily_values()
    rows = F.array_sort(F.collect_list(F.struct(
        F.col("date").cast("string").alias("time"),
        *[e.alias(n) for n, e in vals.items()])))
    g = o.groupBy("site_id", F.trunc("date", "month").alias("month")).agg(rows.alias("r"))
    daily = F.struct(
        F.col("r")["time"].alias("time"),
        *[F.col("r")[n].alias(n) for n in vals])
    return g.select("site_id", "month", F.to_json(F.struct(daily.alias("daily"))).alias("body"))


def scoring_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily observations in the 24-feature scoring vocabulary: direct
    renames, plus derived stand-ins for the variables the testdata lacks."""
    from ..operators.scoring import rename_vocabulary

    o = rename_vocabulary(obs_daily(spark, sf_dir), {
        "temperatura": "temp_2m_mean", "temp_max": "temp_2m_max", "temp_min": "temp_2m_min",
        "humedad": "relative_humidity_mean", "precipitacion": "precipitation_sum",
        "velocidad_viento": "wind_speed_mean"})
    dt = F.col("date")
    t, h, w, p = (F.col(c) for c in ("temp_2m_mean", "relative_humidity_mean", "wind_speed_mean",
                                    "precipitation_sum"))
    return o.select(
        "site_id", "date", "incendio", "temp_2m_mean", "temp_2m_max", "temp_2m_min", "relative_humidity_mean",
        (h - 10).alias("relative_humidity_min"), (h + 10).alias("relative_humidity_max"),
        (h / 400).alias("soil_moisture_7_28cm"), (h / 350).alias("soil_moisture_28_100cm"),
        (t - 5).alias("soil_temp_100_255cm"), (t * 150).alias("direct_shortwave_radiation"),
        (w / 8).alias("evapotranspiration"), ((100 - h) / 25).alias("vapor_pressure_deficit"),
        (p * 4).alias("cloud_cover_high"), "precipitation_sum", "wind_speed_mean", (w * 2).alias("wind_speed_max"),
        F.lit(910.0).alias("surface_pressure"), (t - 12).alias("dew_point"), (t * 5).alias("radiation_diffuse"),
        (F.col("temp_2m_max") - F.col("temp_2m_min")).alias("temperature_range"), F.lit(20.0).alias("humidity_range"),
        F.dayofyear(dt).cast("double").alias("day_of_year"), F.month(dt).cast("double").alias("month"),
        F.month(dt).isin(fixed.DRY_SEASON_MONTHS).cast("double").alias("is_dry_season"))


def score_request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed request bodies, one per (site, month) (<= 31 rows each); every
    7th site sends 23 numbers in its rows (must be quarantined, not scored). As many
    parts as the shuffle setting says: what reads a body takes far longer than its bytes."""
    r = scoring_rows(spark, sf_dir).withColumn("_month", F.trunc("date", "month"))
    r = r.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "site_id", "_month")
    vec = F.array(*[F.col(c) for c in fixed.SCORING_FEATURES])
    vec = F.when(F.col("site_id") % 7 == 0, F.slice(vec, 1, 23)).otherwise(vec)
    g = r.groupBy("site_id", "_month").agg(
        F.array_sort(F.collect_list(F.struct("date", vec.alias("v")))).alias("rows"))
    return g.select(F.concat_ws(":", "site_id", "_month").alias("request_id"),
                    F.to_json(F.struct(F.col("rows")["v"].alias("data"))).alias("body"))
