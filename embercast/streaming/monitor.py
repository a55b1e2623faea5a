"""Structured Streaming jobs (R1-R5): continuous scoring, alerts, last-100
statistics per station, alert rate per event-time window, re-delivery dedup.

Every job takes a streaming DataFrame (``readStream`` over landed files),
writes to a sink with a checkpoint in the shared checkpoint folder
(``spark.checkpoint.dir``), and survives restarts: the checkpoint holds the
source offsets and the operator state (RocksDB when configured).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import fixed
from ..functions import risk
from ..session import checkpoint_path


def run_available_now(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                      run_id: str | None = None) -> str:
    """Drain every landed file once (``trigger(availableNow=True)``) into
    ``<checkpoint dir>/<name>-<id>/out``; returns the output path. The same
    call with the same ``run_id`` resumes from the checkpoint."""
    spark = df.sparkSession
    base = checkpoint_path(spark, f"{name}-{run_id or uuid.uuid4().hex}")
    out = f"{base}/out"
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", f"{base}/ckpt")
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def run_continuous(df: DataFrame, name: str, every: str = "5 seconds", mode: str = "append",
                   fmt: str = "parquet"):
    """R1 cadence: a long-running query with a processing-time trigger (the
    monitor's 5 s loop) and its checkpoint under ``<checkpoint dir>/<name>``,
    so a restart resumes where it stopped. Returns the StreamingQuery."""
    base = checkpoint_path(df.sparkSession, name)
    return (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", f"{base}/ckpt")
            .option("path", f"{base}/out").trigger(processingTime=every).start())


def landed_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                  max_files: int | None = None) -> DataFrame:
    """Parquet files landing in ``folder`` (declared schema, no inference);
    ``max_files`` bounds each micro-batch."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def readings_stream(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """T9 readings from landed event files (one station per user), event time
    as TIMESTAMP (watermarks reject TIMESTAMP_NTZ)."""
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    return to_readings(landed_stream(spark, folder, schema, glob))


def to_readings(ev: DataFrame) -> DataFrame:
    v = F.col("value").cast("int")
    return ev.select(
        F.col("user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (10 + v % 25).cast("double").alias("temperatura"),
        (30 + F.col("event_id") % 60).cast("double").alias("humedad"),
        ((v * 7) % 40).cast("double").alias("velocidad_viento"),
        (F.col("event_type") == "error").cast("int").alias("y"))


# --------------------------------------------------------------------------- R1, R2

def score_stream(model, readings: DataFrame) -> DataFrame:
    """The batch scorer (Q1) applied to a stream; a map stage, no state."""
    from ..operators.scoring import batch_score
    return batch_score(model, readings, keep=("station_id", "ts", "event_id", "temperatura", "humedad",
                                              "velocidad_viento"))


def alert_stream(scored: DataFrame, threshold: float = fixed.ALERT_THRESHOLD) -> DataFrame:
    """R2: only the alerting readings (P13, fixed form) - append sink."""
    return scored.filter(risk.is_alert("probability_fire", "prediction", threshold))


# --------------------------------------------------------------------------- R3

_KEPT = ["ts", "event_id", "temperatura", "humedad", "velocidad_viento"]
_STATE = T.StructType([
    T.StructField("ts", T.ArrayType(T.TimestampType())),
    T.StructField("event_id", T.ArrayType(T.LongType())),
    T.StructField("temperatura", T.ArrayType(T.DoubleType())),
    T.StructField("humedad", T.ArrayType(T.DoubleType())),
    T.StructField("velocidad_viento", T.ArrayType(T.DoubleType())),
    T.StructField("total", T.LongType()),
    T.StructField("first_ts", T.TimestampType()),
    T.StructField("last_ts", T.TimestampType()),
])
LAST_N_OUT = ("station_id long, total_readings long, retained long, avg_temperatura double, "
              "avg_humedad double, avg_velocidad_viento double, last_ts timestamp, uptime_seconds double")


def _last_n_fn(n: int):
    """A call costs little beside its rows: numpy columns, not frames, as there are as many calls as stations."""
    def columns_of(ts, event_id, *values):
        """Times, ids and values as numpy columns; a time that is missing is NaT and comes first in the order."""
        ids = np.asarray(event_id)
        ids = ids if ids.dtype.kind == "i" else np.array([np.nan if x is None else x for x in event_id], np.float64)
        return [np.asarray(ts, "datetime64[us]"), ids, *[np.asarray(v, np.float64) for v in values]]

    def fn(key, pdfs, state):
        held, total, first, last = None, 0, None, None
        if state.exists:
            *columns, total, first, last = state.get
            held = columns_of(*columns)
        for pdf in pdfs:  # Arrow chunks in any order: state and chunk are merged, the latest n by event time stay
            part = columns_of(*[pdf[c].to_numpy() for c in _KEPT])
            times = part[0][~np.isnat(part[0])]
            if len(times):
                first, last = (f(times.tolist() + ([] if x is None else [x])) for f, x in ((min, first), (max, last)))
            total += len(pdf)
            part = part if held is None else [np.concatenate(x) for x in zip(held, part)]
            order = np.lexsort((np.where(np.isnan(part[1]), -np.inf, part[1]) if part[1].dtype.kind == "f" else part[1], part[0].view(np.int64)))[-n:]
            held = [x[order] for x in part]

        def listed(x):
            return [None if v != v else v for v in x.tolist()]

        state.update((held[0].tolist(), [None if v is None else int(v) for v in listed(held[1])], *map(listed, held[2:]), total, first, last))
        span = None if first is None else (last - first).total_seconds()
        there = [x[~np.isnan(x)] for x in held[2:]]
        means = {f"avg_{c}": [float(x.mean()) if len(x) else None] for c, x in zip(_KEPT[2:], there)}  # NULLs skipped
        yield pd.DataFrame({"station_id": [key[0]], "total_readings": [total], "retained": [len(held[0])], **means,
                            "last_ts": [last], "uptime_seconds": [span]})
    return fn


def last_n_stream(readings: DataFrame, n: int = fixed.MONITOR_HISTORY) -> DataFrame:
    """Per station, the last ``n`` readings by (event time, event_id) kept in
    state (bounded: n per station) with their means (NULL readings skipped),
    plus totals, first and last time. One row per station and micro-batch; the
    row with the most readings is the station's current state. Late rows land
    where their event time says. A micro-batch brings a station's own rows to
    one task, so bound it with ``landed_stream(max_files=...)``."""
    return readings.groupBy("station_id").applyInPandasWithState(
        _last_n_fn(n), outputStructType=LAST_N_OUT, stateStructType=_STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------- R4, R5

def alert_rate_stream(scored: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                      threshold: float = fixed.ALERT_THRESHOLD) -> DataFrame:
    """Readings, alerts and alert rate per tumbling event-time window;
    late data bounded by the watermark, append mode emits closed windows only."""
    a = scored.withColumn("alert", risk.is_alert("probability_fire", "prediction", threshold))
    return a.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if("alert").alias("alerts"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "readings", "alerts",
             (F.col("alerts") / F.col("readings")).alias("alert_rate"))


def dedup_stream(df: DataFrame, keys=("station_id", "event_id"), ts: str = "ts",
                 watermark: str = "1 hour") -> DataFrame:
    """Drop re-delivered records (same keys) arriving within the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
