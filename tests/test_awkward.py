"""Cases that the driver's tables never hold: NULL orders and classes, malformed
fields and requests, late and unordered readings, two file layouts."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from embercast.operators import clean, quantiles, scale, stats, train
from embercast.session import checkpoint_path, ensure_checkpoint_dir
from embercast.sources import files, sinks
from embercast.streaming import monitor

from .conftest import SF


def test_first_record_with_null_orders(spark):
    df = spark.createDataFrame([(1, None, 5.0, "a"), (2, None, 7.0, "b"), (2, 4, 8.0, "c"), (2, 3, 9.0, "d"), (3, 1, 2.0, "z"), (3, 1, 1.0, "y")],
                               "site_id int, ingest_seq int, v double, w string")
    got = sorted(map(tuple, clean.dedup_first(df, ("site_id",), "ingest_seq").collect()))
    assert got == [(1, None, 5.0, "a"), (2, 3, 9.0, "d"), (3, 1, 1.0, "y")]


def test_histogram_and_box_with_a_null_class(spark):
    df = spark.createDataFrame([(None, float(x)) for x in range(11)] + [(1, float(x)) for x in range(5)], "incendio int, v double")
    hist = stats.hist_density(df, "v", bins=5).collect()
    assert sum(r["count"] for r in hist if r["incendio"] is None) == 11 and sum(r["count"] for r in hist if r["incendio"] == 1) == 5
    box = {r["incendio"]: (r["q1"], r["median"], r["q3"], r["n"]) for r in stats.box_stats(df, "v").collect()}
    assert box == {None: (2.5, 5.0, 7.5, 11), 1: (1.0, 2.0, 3.0, 5)}


def test_quantile_plan_is_the_same_at_every_size(spark):
    def shape(rows):
        df = spark.range(rows).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
        plan = quantiles.exact_quantiles(df, ["x"], [0.5], ["g"])._jdf.queryExecution().analyzed().toString()
        return [line.strip(" +-:").split(" ")[0] for line in plan.split("\n")]

    assert shape(10) == shape(200_000)


def test_pca_refuses_a_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0)], "a double, b double")
    with pytest.raises(Exception):
        scale.pca_project(df, ["a", "b"]).collect()


def test_malformed_csv_lines_are_rejected_whole(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("latitude,longitude,acq_date,confidence,brightness,frp\n-17.1,-66.2,2024-01-02,80,301.5,2.5\n"
                    "oops,-66.2,2024-01-02,80,301.5,2.5\n-17.1,,2024-01-02,80,,2.5\n-17.1,-66.2\n")
    rows, rejects = files.read_csv_checked(spark, str(path), files.HOTSPOT)
    assert sorted(r["frp"] for r in rows.collect()) == [2.5, 2.5]
    assert sorted(r["line"] for r in rejects.collect()) == ["-17.1,-66.2", "oops,-66.2,2024-01-02,80,301.5,2.5"]
    with pytest.raises(Exception):
        files.read_hotspots_csv(spark, str(path)).collect()


BODIES = {
    '{"data": [[1, 2], [3.5, 4]]}': [None, None],
    '{"data": [{"a": 1, "b": 2, "c": 9}]}': [None],
    '{"data": [[1, 2], {"b": 4, "a": 3}]}': [None, None],
    '{"data": [{"a": 1, "b": 2}, [5, 6]]}': [None, None],
    '{"data": "hello"}': ["data is not a list"],
    '{"data": {"a": 1}}': ["data is not a list"],
    '{"data": [1, 2]}': ["row is not a list or an object"] * 2,
    '{"data": [["a", "b"]]}': ["value is not a number"],
    '{"data": [{"a": "x", "b": 1}]}': ["value is not a number"],
    '{"data": [null, [1, 2]]}': ["row is null", None],
    '{"data": [[1, null]]}': ["null value"],
    '{"data": [[1], [1, 2, 3]]}': ["expected 2 values, got 1", "expected 2 values, got 3"],
    '{"data": [{"a": 1}]}': ["missing columns"],
    '{"data": []}': ["empty data"],
    '{"other": 1}': ["missing data"],
    "not json": ["missing data"],
}


def test_no_request_row_is_lost(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "request_id long, body string")
    got = {}
    for r in files.route_requests(df, features=["a", "b"]).orderBy("request_id", "row_idx").collect():
        got.setdefault(r["request_id"], []).append(r["reason"])
        assert (r["values"] is None) == (r["reason"] is not None)
    assert got == dict(enumerate(BODIES.values()))
    rows, rejects = files.parse_score_requests(df, features=["a", "b"])
    assert rows.count() + rejects.count() == sum(map(len, BODIES.values()))
    assert {(r["request_id"], r["a"], r["b"]) for r in rows.collect()} >= {(0, 3.5, 4.0), (2, 3.0, 4.0), (3, 5.0, 6.0)}
    assert files.route_requests(spark.createDataFrame([(1, None)], "request_id long, body string"), features=["a"]).first()["reason"] == "missing data"


class State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def chunk(rows):
    return pd.DataFrame([(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), i, t, 1.0, 2.0) for s, i, t in rows],
                        columns=["ts", "event_id", "temperatura", "humedad", "velocidad_viento"])


def test_last_n_keeps_the_latest_by_event_time():
    late, early = [(s, s, float(s)) for s in range(100, 110)], [(s, s, float(s)) for s in range(10)]
    for chunks in ([early, late], [late, early]):
        state = State()
        out = list(monitor._last_n_fn(5)((1,), iter(map(chunk, chunks)), state))[0].iloc[0]
        assert (out.total_readings, out.retained, out.avg_temperatura, out.uptime_seconds) == (20, 5, 107.0, 109.0)
    again = list(monitor._last_n_fn(5)((1,), iter([chunk([(50, 1, 9.0), (109, 200, None), (200, 3, None)])]), state))[0].iloc[0]
    assert (again.total_readings, again.retained, again.avg_temperatura, again.uptime_seconds) == (23, 5, 108.0, 200.0)


def test_forest_does_not_depend_on_the_file_layout(spark):
    df = spark.range(600).select((F.col("id") % 5).alias("site_id"), F.col("id").alias("day"), (F.xxhash64("id") % 100).cast("double").alias("x"),
                                 (F.xxhash64("id") % 3 == 0).cast("int").alias("y"))
    orders = []
    for parts, by in ((2, "x"), (7, "day")):
        path = checkpoint_path(spark, f"layout-{uuid.uuid4().hex}")
        df.repartition(parts, by).sortWithinPartitions(by).write.parquet(path)
        laid = train.fixed_layout(spark.read.parquet(path), ("site_id", "day"), 4)
        orders.append([tuple(r) for r in laid.collect()])
    assert orders[0] == orders[1]


def test_table_sink_leaves_the_session_alone_and_writes_few_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = spark.range(4000).repartition(8).select((F.col("id") % 10).alias("date"), "id")
    sinks.write_table(df, str(tmp_path / "t"), ("date",))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    assert len(list((tmp_path / "t").rglob("part-*.parquet"))) == 10
    sinks.write_table(df.filter("date = 3").limit(5), str(tmp_path / "t"), ("date",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3605


def test_checkpoint_folder_of_a_cluster_must_be_named(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_readings_of_equal_time_have_an_order(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "station_id int, event_id long, temperatura double").withColumns({
        "ts": F.lit("2024-01-01 00:00:00").cast("timestamp"), "alert": F.lit(True), "humedad": F.lit(1.0), "velocidad_viento": F.lit(1.0)})
    assert stats.monitor_stats(df.repartition(3), history=2).first()["avg_temperatura"] == 8.5
    assert SF.endswith("sf0.001")


@pytest.mark.parametrize("block,partitions", [(10, 4), (7, 16), (10_000, 1)])
def test_last_n_of_a_hot_station_in_blocks(spark, block, partitions):
    from embercast.operators import features

    rows = [(1, i, float(i * i % 17)) for i in range(200)] + [(k, i, float(i)) for k in (2, None) for i in range(5)]
    df = spark.createDataFrame(rows, "station_id int, sec int, v double").select(
        "station_id", F.timestamp_seconds(F.col("sec") * 60).alias("ts"), "v", "sec").repartition(5)
    got = {(r["station_id"], r["sec"]): (r["avg_v_last7"], r["readings_last7"])
           for r in features.last_n_stats(df, ["v"], n=7, block=block, partitions=partitions).collect()}
    assert len(got) == len(rows)
    for k in (1, 2, None):
        own = [v for s, _, v in rows if s == k]
        for i in range(len(own)):
            last = own[max(0, i - 6):i + 1]
            assert got[k, i] == (pytest.approx(sum(last) / len(last)), len(last))


def test_boxes_of_any_size(spark):
    from embercast.operators.hotspots import assign_sites

    boxes = [(1, -17.6, -17.1, -66.5, -65.8), (2, -90.0, 90.0, -180.0, 180.0), (3, -20.0, -10.0, -70.0, -60.0), (4, 0.0, 0.0, 0.0, 0.0)]
    points = [(i, -17.6 + 0.1 * i, -66.5 + 0.1 * i) for i in range(12)] + [(50, 0.0, 0.0), (51, 89.9, 179.9), (52, -15.0, -65.0)]
    b = spark.createDataFrame(boxes, "site_id int, south double, north double, west double, east double")
    p = spark.createDataFrame(points, "event_id int, latitude double, longitude double")
    got = sorted((r["event_id"], r["site_id"]) for r in assign_sites(p, b).collect())
    want = sorted((i, s) for i, y, x in points for s, lo, hi, w, e in boxes if lo <= y <= hi and w <= x <= e)
    assert got == want
    assert assign_sites(p, b.limit(0)).count() == 0


def test_continuous_stream_resumes_where_it_stopped(spark):
    folder = checkpoint_path(spark, f"landing-{uuid.uuid4().hex}")
    df = spark.range(20).selectExpr("id AS event_id")
    df.write.parquet(folder)
    name = f"continuous-{uuid.uuid4().hex}"
    for extra in (0, 5):
        if extra:
            spark.range(100, 100 + extra).selectExpr("id AS event_id").write.mode("append").parquet(folder)
        q = monitor.run_continuous(monitor.landed_stream(spark, folder, df.schema), name, every="0 seconds")
        q.processAllAvailable()
        q.stop()
        got = sorted(r["event_id"] for r in spark.read.parquet(checkpoint_path(spark, name) + "/out").collect())
        assert got == [*range(20), *range(100, 100 + extra)]
