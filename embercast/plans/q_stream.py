"""Streaming queries (R1-R5): each drains the landed events file with
``availableNow`` into a sink under the checkpoint folder and reads the sink
back. Batch = stream: the oracles are the batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed
from ..operators import train
from ..session import checkpoint_path, table
from ..sources import testdata as td
from ..streaming import monitor as m
from .catalog import register, rounded, wrap

_PROB = "cast(cast(json_extract_string(props, '$.k') as int) as double) / 100"
READINGS = f"""
readings as (
  select user_id as station_id, cast(ts as timestamp) as ts, event_id,
    cast(10 + cast(trunc(value) as int) % 25 as double) as temperatura,
    cast(30 + event_id % 60 as double) as humedad,
    cast((cast(trunc(value) as int) * 7) % 40 as double) as velocidad_viento,
    {_PROB} as probability_fire, cast({_PROB} >= 0.5 as int) as prediction
  from events)"""


def _events_stream(spark, d: str):
    """Landed event files: the testdata folder, filtered to the events file."""
    return m.landed_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def _scored_stream(spark, d):
    return td.scored_readings(_events_stream(spark, d))


# --------------------------------------------------------------------------- R1 (forest on the stream)
def _stream_scores(spark, d):
    batch = m.to_readings(table(spark, d, "events"))
    model = train.train_forest(train.fixed_layout(batch, ("station_id", "event_id")),
                               ["temperatura", "humedad", "velocidad_viento"], "y",
                               num_trees=100, max_depth=10, seed=42)
    ev = _events_stream(spark, d)
    out = m.run_available_now(m.score_stream(model, m.to_readings(ev)), "stream_scores")
    return spark.read.parquet(out)


register("stream_scores")(_stream_scores)

# --------------------------------------------------------------------------- R2
register("stream_alerts", wrap("with " + READINGS.strip() + """
select station_id, event_id, probability_fire, prediction from readings
where probability_fire > 0.7 and prediction = 1""", ["probability_fire"]))(
    lambda spark, d: rounded(spark.read.parquet(m.run_available_now(
        m.alert_stream(_scored_stream(spark, d), fixed.ALERT_THRESHOLD), "stream_alerts"))
        .select("station_id", "event_id", "probability_fire", "prediction")))


# --------------------------------------------------------------------------- R3
LAST_N = 20
#: Files in one micro-batch.
LANDED_FILES = 32


def _landed_late(spark, d):
    """The readings as files landed by the scan's own tasks: the later half of the events first, late rows second.

    Files are taken in order of arrival, at most LANDED_FILES and at most the first half's number at a time."""
    ev = table(spark, d, "events")
    folder = checkpoint_path(spark, f"late-{uuid.uuid4().hex}")
    middle = ev.agg(F.percentile_approx(F.col("ts").cast("timestamp"), 0.5)).first()[0]
    most = 1
    for late in (False, True):
        half = (F.col("ts").cast("timestamp") < F.lit(middle)) if late else (F.col("ts").cast("timestamp") >= F.lit(middle))
        ev.filter(half).write.mode("append").parquet(folder)
        if not late:
            most = min(LANDED_FILES, max(1, len(spark.read.schema(ev.schema).parquet(folder).inputFiles())))
    return m.landed_stream(spark, folder, ev.schema, max_files=most)


def _gaps(r):
    """Every 7th reading without a temperature."""
    return r.withColumn("temperatura", F.when(F.col("event_id") % 7 != 0, F.col("temperatura")))


def _stream_last100(spark, d):
    readings = _gaps(td.scored_readings(_landed_late(spark, d)))
    rows = spark.read.parquet(m.run_available_now(m.last_n_stream(readings, LAST_N), "stream_last100"))
    # one row per station and micro-batch: the one with the most readings is the newest
    return rows.groupBy("station_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("station_id", "last_ts")]),
                                                   "total_readings").alias("r")).select("station_id", "r.*")


register("stream_last100", wrap("with " + READINGS.strip() + """,
tot as (select station_id, count(*) as total_readings,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as uptime_seconds from readings group by 1),
rec as (select station_id, count(*) as retained,
          avg(case when event_id % 7 <> 0 then temperatura end) as avg_temperatura, avg(humedad) as avg_humedad,
          avg(velocidad_viento) as avg_velocidad_viento
        from (select *, row_number() over (partition by station_id order by ts desc, event_id desc) as rk
              from readings) r where rk <= 20 group by 1)
select tot.station_id, total_readings, retained, avg_temperatura, avg_humedad, avg_velocidad_viento, uptime_seconds
from tot join rec on tot.station_id = rec.station_id""",
    ["avg_temperatura", "avg_humedad", "avg_velocidad_viento", "uptime_seconds"]))(
    lambda spark, d: rounded(_stream_last100(spark, d)))

# --------------------------------------------------------------------------- R4
register("stream_alert_rate", wrap("with " + READINGS.strip() + """,
a as (select *, coalesce(probability_fire > 0.7 and prediction = 1, false) as alert,
        date_trunc('day', ts) as window_start from readings)
select window_start, window_start + interval 1 day as window_end, count(*) as readings,
  cast(count_if(alert) as bigint) as alerts, cast(count_if(alert) as double) / count(*) as alert_rate
from a group by 1
having window_start + interval 1 day <= (select max(ts) from readings) - interval 1 hour""", ["alert_rate"]))(
    lambda spark, d: rounded(spark.read.parquet(m.run_available_now(
        m.alert_rate_stream(_scored_stream(spark, d), "1 day", "1 hour"), "stream_alert_rate"))
        .withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"),
                      "window_end": F.col("window_end").cast("timestamp_ntz")})))


# --------------------------------------------------------------------------- R5
def _stream_dedup(spark, d):
    s = _scored_stream(spark, d)
    redelivered = s.unionByName(_scored_stream(spark, d))  # every record arrives twice
    out = m.run_available_now(m.dedup_stream(redelivered, ("station_id", "event_id"), "ts", "1 hour")
                              .select("station_id", "event_id", "ts"), "stream_dedup")
    return spark.read.parquet(out).select("station_id", "event_id")


register("stream_dedup", "with " + READINGS.strip() + " select distinct station_id, event_id from readings")(
    _stream_dedup)
