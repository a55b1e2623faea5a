"""Masked Gram correlations, size-balanced writes, the repeatable history, and missing columns by row."""

import glob
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from embercast.operators import stats
from embercast.session import checkpoint_path
from embercast.sources import files, sinks


def test_correlations_with_gaps_constants_and_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (300, 200))
    x[:, 1] = x[:, 0] * 2 + rng.normal(0, 1, 300)
    x[:, 2] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    x[:150, 4], x[150:, 5] = np.nan, np.nan  # never set together
    x[:, 6] = np.where(np.isnan(x[:, 7]), 5.0, 0.3)  # constant wherever column 7 is set
    pdf = pd.DataFrame(x, columns=[f"v{i}" for i in range(200)])
    df = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"v{i} double" for i in range(200))).repartition(3)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.corr_matrix(df).collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 200 * 200
    for a in pdf.columns[:40]:
        for b in pdf.columns:
            if {a, b} & {"v2", "v3", "v6"} or {a, b} == {"v4", "v5"}:
                continue
            assert math.isclose(got[a, b], want[a][b], rel_tol=1e-6, abs_tol=1e-6), (a, b)
    assert got["v2", "v0"] is None and got["v3", "v0"] is None and got["v4", "v5"] is None and got["v6", "v7"] is None and got["v6", "v8"] is not None
    assert stats.corr_matrix(df.select("v0", "v1").filter("false")).filter("corr is not null").count() == 0


def test_a_hot_day_is_spread_and_small_days_are_one_file(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 2 else f"d{i % 10}", i, rng.random()) for i in range(40_000)]
    df = spark.createDataFrame(rows, "day string, id int, x double").repartition(6)
    path = checkpoint_path(spark, f"balanced-{random.random()}")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sinks.write_table(df, path, partition_by=("day",))
        sinks.write_table(df.filter("day = 'd2'"), path, partition_by=("day",))  # replaces its own folder only
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{path}/day=hot/*.parquet")) > 2 and len(glob.glob(f"{path}/day=d2/*.parquet")) == 1
    assert spark.read.parquet(path).count() == len(rows)


def test_a_batch_that_is_written_again_replaces_its_own_rows(spark):
    path = checkpoint_path(spark, f"recorded-{random.random()}")
    one, two = (spark.range(a, b).withColumnRenamed("id", "event_id") for a, b in ((0, 10), (10, 15)))
    for batch, rows in ((0, one), (1, two), (0, one), (1, two.limit(3))):
        sinks.record_predictions(rows, path, batch)
    h = spark.read.parquet(path)
    assert h.count() == 13 and h.select("event_id").distinct().count() == 13 and h.filter("timestamp is null").count() == 0


def test_a_stream_killed_before_its_commit_leaves_no_doubled_row(spark):
    base = checkpoint_path(spark, f"killed-{random.random()}")
    spark.range(20).withColumn("p", F.rand(1)).repartition(2).write.parquet(base + "/in")
    calls = []

    def failing(rows, batch):  # writes, then dies before the stream commits the batch
        sinks.record_predictions(rows, base + "/out", batch * 1000)
        calls.append(batch)
        raise RuntimeError("killed")

    stream = spark.readStream.schema("id long, p double").parquet(base + "/in")
    try:
        stream.writeStream.option("checkpointLocation", base + "/c").trigger(availableNow=True).foreachBatch(failing).start().awaitTermination()
    except Exception:
        pass
    sinks.recorded_stream(stream, base + "/out", base + "/c").awaitTermination()
    h = spark.read.parquet(base + "/out")
    assert calls == [0] and h.count() == 20 and h.select("id").distinct().count() == 20


def test_missing_columns_by_row(spark):
    bodies = [(1, '{"data": [{"a": 1, "z": 2}, [1, 2], {"b": 1, "a": null}, {}]}'), (2, '{"data": "x"}'), (3, "broken"), (4, None)]
    df = spark.createDataFrame(bodies, "request_id int, body string")
    got = [tuple(r) for r in files.missing_columns(df, features=["b", "a"]).orderBy("request_id", "row_idx").collect()]
    assert got == [(1, 0, ["b"], ["z"]), (1, 2, [], []), (1, 3, ["a", "b"], [])]
