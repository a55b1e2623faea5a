"""What one task holds, and what is shuffled, must not grow with a class, a group or the table."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from embercast.operators import clean, features, scan, split, stats
from embercast.session import cut_lineage
from embercast.sources import files


def test_split_ranks_only_rows_at_the_edge(spark, monkeypatch):
    ranked, whole = [], split.running_sums

    def counted(df, *a, **k):
        ranked.append(df.count())
        return whole(df, *a, **k)

    monkeypatch.setattr(split, "running_sums", counted)
    df = spark.range(20_000).selectExpr("id", "case when id % 10 = 0 then null when id % 10 < 8 then 0 else 1 end y")
    out = split.stratified_split(df, "y", ["id"], 0.3).cache()
    assert sum(ranked) < 100
    hashed = out.withColumn("h", split.row_hash(["id"], 42)).collect()
    for y, n in ((0, 14_000), (1, 4_000)):
        own = sorted((r for r in hashed if r["y"] == y), key=lambda r: (r["h"], r["id"]))
        assert len(own) == n and [r["is_test"] for r in own] == [i < round(0.3 * n) for i in range(n)]
    assert len(hashed) == 20_000 and all(r["is_test"] is None for r in hashed if r["y"] is None)


@pytest.mark.parametrize(("size", "wanted"), [(0.0, 0), (1.0, 600), (0.5, 300)])
def test_split_of_repeated_keys_is_exact(spark, size, wanted):
    df = spark.range(600).selectExpr("id % 2 as k", "1 as y")
    assert split.stratified_split(df, "y", ["k"], size).filter("is_test").count() == wanted
    assert split.stratified_split(df.filter("false"), "y", ["k"], size).count() == 0


def test_box_stats_does_not_shuffle_the_rows_by_group(spark):
    df = cut_lineage(spark.range(1000).selectExpr("cast(id as double) v", "if(id % 9 = 0, null, cast(id % 3 as int)) cls"))
    out = stats.box_stats(df, "v", "cls")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["cls"], r["n"]) for r in out.collect()} == {(None, 112), (0, 222), (1, 333), (2, 333)}


def test_windows_get_more_tasks_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(scan, "PART_ROWS", 50)
    df = spark.range(1200).selectExpr("id % 40 as site_id", "date_add(date'2020-01-01', cast(id / 40 as int)) as date",
                                      "if(id % 5 = 0, null, cast(id as double)) as v", "1 as incendio")
    rolled = features.rolling_features(df, ["v"], precip=None)
    filled = clean.fill_three_stage(df, ["v"])
    for out in (rolled, filled):
        sizes = re.findall(r"hashpartitioning\([^)]*site_id[^)]*, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
        assert "24" in sizes
    own = {(r["site_id"], r["date"]): r["v"] for r in df.collect()}
    for r in rolled.collect():
        last = [x for i in range(7) if (x := own.get((r["site_id"], r["date"] - timedelta(days=i)))) is not None]
        assert r["v_ma7"] == (pytest.approx(sum(last) / len(last)) if last else None)
    assert filled.filter("v is null").count() == 0


def test_last_n_of_a_station_with_missing_times_ids_and_values():
    import pandas as pd

    from embercast.streaming.monitor import _last_n_fn

    class State:
        exists, held = False, None

        def update(self, x):
            self.exists, self.held = True, x

        @property
        def get(self):
            return self.held

    t0, state, fn = datetime(2024, 1, 1), State(), _last_n_fn(3)
    frame = lambda rows: pd.DataFrame(rows, columns=["ts", "event_id", "temperatura", "humedad", "velocidad_viento"]).astype({"ts": "datetime64[ns]"})
    one = frame([(t0 + timedelta(hours=2), 5, 1.0, None, 2.0), (None, 6, 9.0, 9.0, 9.0), (t0 + timedelta(hours=1), 7, 3.0, None, 4.0)])
    two = frame([(t0 + timedelta(hours=2), 4, 5.0, 8.0, None), (t0, 8, 7.0, 7.0, 7.0)])
    list(fn((1,), iter([one]), state))
    out = next(fn((1,), iter([two]), state)).iloc[0]
    assert (out["total_readings"], out["retained"], out["uptime_seconds"]) == (5, 3, 7200.0)
    assert (out["avg_temperatura"], out["avg_humedad"], out["avg_velocidad_viento"]) == (3.0, 8.0, 3.0)
    assert state.held[1] == [7, 4, 5] and state.held[0] == [t0 + timedelta(hours=1), t0 + timedelta(hours=2), t0 + timedelta(hours=2)]


def test_training_rows_are_laid_out_once(spark):
    import __spark_entry__  # noqa: F401  (registers the queries in their order)
    from embercast.plans import q_models

    df = spark.range(300).selectExpr("cast(id % 30 as int) site_id", "date_add(date'2020-01-01', cast(id / 30 as int)) date", "id v")
    out = q_models._laid_out(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 300
    for part in out.select("site_id", "date").rdd.glom().collect():
        assert part == sorted(part)


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"site_id={i}").mkdir()
        (tmp_path / f"site_id={i}" / "part.csv").write_text(f"v\n{i}\n")
    sc, before = spark.sparkContext, spark.conf.get(files.LISTING)
    sc.setJobGroup("listing", "")
    try:
        rows = files.read_csv(spark, str(tmp_path), T.StructType([T.StructField("v", T.IntegerType()), T.StructField("site_id", T.IntegerType())]))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    at = sc.statusTracker()
    tasks = sum(at.getStageInfo(s).numTasks for j in at.getJobIdsForGroup("listing") for s in at.getJobInfo(j).stageIds)
    assert 0 < tasks <= 4 * sc.defaultParallelism
    assert spark.conf.get(files.LISTING) == before
    assert sorted((r["v"], r["site_id"]) for r in rows.collect()) == [(i, i) for i in range(60)]
