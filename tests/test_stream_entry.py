"""Batch = stream for the last-100 state and the windowed alert rate; the driver
contract (entry, queries, oracle_sql)."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from embercast.session import checkpoint_path
from embercast.streaming import monitor as m

from .conftest import SF


def _events(spark, n=600):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "error" if i % 4 == 0 else "view", float(i % 50),
             '{"k": %d}' % (i % 100)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                       "value double, props string")


def test_late_readings_land_as_several_files_after_the_early_ones(spark, monkeypatch, tmp_path):
    from embercast.plans import q_stream

    ev = _events(spark).repartition(4)
    monkeypatch.setattr(q_stream, "table", lambda spark, d, name: ev)
    monkeypatch.setattr(q_stream, "checkpoint_path", lambda spark, name: str(tmp_path / "landed"))
    stream = q_stream._landed_late(spark, "")
    landed = sorted((os.path.getmtime(f), f) for f in (str(x) for x in (tmp_path / "landed").glob("*.parquet")))
    assert len(landed) == 8
    lo = [spark.read.parquet(f).agg(F.min("event_id")).first()[0] for _, f in landed]
    assert all(x >= 290 for x in lo[:4]) and all(x < 290 for x in lo[4:])
    out = spark.read.parquet(m.run_available_now(m.last_n_stream(m.to_readings(stream), 20), "t_late"))
    rows = out.collect()
    for st in (0, 1, 2):
        own = [r for r in rows if r.station_id == st]
        want = m.to_readings(ev).filter(F.col("station_id") == st).orderBy(F.desc("ts")).limit(20).agg(F.avg("temperatura")).first()[0]
        last = max(own, key=lambda r: r.total_readings)
        assert len(own) == 2 and last.total_readings == 200 and last.avg_temperatura == pytest.approx(want)


def test_last100_stream_equals_batch(spark):
    folder = checkpoint_path(spark, "landed-" + uuid.uuid4().hex)
    ev = _events(spark)
    ev.filter("event_id < 300").write.parquet(os.path.join(folder, "part1"))
    ev.filter("event_id >= 300").write.parquet(os.path.join(folder, "part2"))
    schema = ev.schema
    stream = m.to_readings(spark.readStream.schema(schema).option("recursiveFileLookup", "true")
                           .option("maxFilesPerTrigger", 1).parquet(folder))
    out = spark.read.parquet(m.run_available_now(m.last_n_stream(stream, 100), "t_last100"))
    last = {r.station_id: r for r in out.collect() if r.total_readings == 200}
    batch = m.to_readings(ev)
    for st in (0, 1, 2):
        recent = batch.filter(F.col("station_id") == st).orderBy(F.desc("ts")).limit(100)
        want = recent.agg(F.avg("temperatura")).first()[0]
        assert last[st].retained == 100 and last[st].avg_temperatura == pytest.approx(want)


def test_alert_rate_stream_closed_windows(spark):
    ev = _events(spark, 600)  # 600 * 7 min ~ 2.9 days
    folder = checkpoint_path(spark, "landed-" + uuid.uuid4().hex)
    ev.write.parquet(folder)
    s = spark.readStream.schema(ev.schema).parquet(folder)
    prob = F.get_json_object("props", "$.k").cast("int").cast("double") / 100
    scored = s.select(F.col("ts").cast("timestamp").alias("ts"), prob.alias("probability_fire"),
                      (prob >= 0.5).cast("int").alias("prediction"))
    out = spark.read.parquet(m.run_available_now(m.alert_rate_stream(scored, "1 day", "1 hour"), "t_rate"))
    assert out.count() == 2  # the third (last) day is still open
    b = ev.withColumn("d", F.to_date("ts")).groupBy("d").count().orderBy("d").collect()
    assert sorted(r.readings for r in out.collect()) == sorted(r["count"] for r in b[:2])


def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "incendio" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    assert SF.endswith("sf0.001")
