"""Composite jobs end to end on landed files, PCA properties, invariance."""

import datetime as dt
import json
import math
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from embercast.operators import clean, curves, scale
from embercast.plans import jobs
from embercast.session import checkpoint_path
from embercast.sources import files, sinks


def _folder(spark, name):
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


def test_etl_daily_from_landed_files(spark):
    d1, d2 = dt.date(2023, 8, 1), dt.date(2023, 8, 2)
    lines = [json.dumps({"site_id": 1, "date": str(d), "hourly": {"variables": [
        {"name": "temperature_2m", "values": [1.0, 2.0, 3.0, 10.0]}]}}) for d in (d1, d2)]
    folder = _folder(spark, "hourly")
    os.makedirs(folder)
    with open(os.path.join(folder, "part-0.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    weather = files.read_hourly_json(spark, folder, ["temperature_2m"])
    assert weather.count() == 2 and weather.first().temperature_2m_mean == 4.0
    hot = spark.createDataFrame([(-17.3, -66.1, d1, 90, 310.0, 10.0), (-17.3, -66.1, d2, 50, 300.0, 1.0)],
                                files.HOTSPOT)
    boxes = spark.createDataFrame([(1, -17.6, -17.1, -66.5, -65.8)],
                                  "site_id int, south double, north double, west double, east double")
    raw = spark.read.text(folder).select(F.col("value").alias("body"),
                                         F.get_json_object("value", "$.site_id").cast("int").alias("site_id"),
                                         F.get_json_object("value", "$.date").cast("date").alias("date"))
    out_path = _folder(spark, "etl")
    out = jobs.etl_daily(raw, hot, boxes, ["temperature_2m"], out_path=out_path)
    got = {r.date: (r.fire_count, r.Incendio) for r in spark.read.parquet(out_path).collect()}
    assert got == {d1: (1, 1), d2: (0, 0)}  # day 2 ingested, its only detection below the floor
    assert out.count() == 2


def test_train_and_evaluate_jobs(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        t = rng.uniform(15, 35)
        h = rng.uniform(20, 90)
        rows.append((i % 7, dt.date(2020, 1, 1) + dt.timedelta(days=i), t, h, int(t - h / 3 > 12)))
    df = spark.createDataFrame(rows, "site_id int, date date, temperatura double, humedad double, incendio int")
    space = {"n_estimators": [5], "max_depth": [3, 4], "min_samples_split": [2], "min_samples_leaf": [1],
             "max_features": [None], "bootstrap": [True], "class_weight": ["balanced"]}
    path = _folder(spark, "model")
    model, board, test = jobs.train_job(df, ["temperatura", "humedad"], "incendio", model_path=path, n_iter=2,
                                        folds=2, space=space)
    assert board.count() == 2 and os.path.isdir(path)
    m, rep, cm, roc = jobs.evaluation_job(sinks.load_model(path), test, "incendio",
                                          metrics_path=_folder(spark, "metrics"), report_path=_folder(spark, "rep"))
    mm = {r.metric: r.value for r in m.collect()}
    assert mm["accuracy"] > 0.7 and 0.5 < mm["roc_auc"] <= 1.0
    assert sum(r["count"] for r in cm.collect()) == test.count()


def test_pca_properties(spark):
    rng = random.Random(2)
    rows = [(i, x, 2 * x + rng.gauss(0, 0.1), rng.gauss(0, 1)) for i, x in enumerate(rng.gauss(0, 3) for _ in range(300))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    var = scale.pca_variance(df, ["a", "b", "c"]).orderBy("component").collect()
    ratios = [r.explained_variance_ratio for r in var]
    assert math.isclose(sum(ratios), 1.0, rel_tol=1e-9) and ratios == sorted(ratios, reverse=True)
    assert math.isclose(var[-1].cumulative, 1.0, rel_tol=1e-9)
    proj = scale.pca_project(df, ["a", "b", "c"], 0.95, keep=("id",))
    k = len([c for c in proj.columns if c.startswith("PC")])
    assert k == next(i + 1 for i, r in enumerate(var) if r.cumulative > 0.95)
    means = proj.agg(*[F.avg(c) for c in proj.columns if c.startswith("PC")]).first()
    assert all(abs(v) < 1e-9 for v in means)  # centred output


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_results_invariant_to_partitioning(spark, parts):
    rng = random.Random(9)
    rows = [(i % 11, i // 3, rng.randint(0, 2), float(i), rng.randint(0, 1), round(rng.random(), 2))
            for i in range(600)]
    df = spark.createDataFrame(rows, "site_id int, date int, ingest_seq int, v double, y int, prob double")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        shuffled = df.repartition(parts, F.rand(seed=parts))
        dd = sorted(tuple(r) for r in clean.dedup_first(shuffled, ("site_id", "date"), "ingest_seq").collect())
        auc = curves.roc_auc(shuffled, "y", "prob", partitions=5).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base_dd = sorted(tuple(r) for r in clean.dedup_first(df, ("site_id", "date"), "ingest_seq").collect())
    assert dd == base_dd
    assert auc == curves.roc_auc(df, "y", "prob", partitions=3).first()[0]


def test_model_sweep_with_cv(spark):
    from embercast.operators import split, train
    rng = random.Random(1)
    rows = []
    for i in range(300):
        t = rng.uniform(15, 35)
        h = rng.uniform(20, 90)
        rows.append((i % 5, dt.date(2020, 1, 1) + dt.timedelta(days=i), t, h, int(t - h / 3 > 12)))
    df = spark.createDataFrame(rows, "site_id int, date date, temperatura double, humedad double, incendio int")
    s = split.class_weights(split.stratified_split(df, "incendio", ("site_id", "date")), "incendio")
    tr = split.stratified_folds(s.filter("not is_test"), "incendio", ("site_id", "date"), 2)
    board, votes = train.model_sweep(tr, s.filter("is_test"), ["temperatura", "humedad"], "incendio",
                                     fold_col="fold", folds=2)
    b = {r.model: r for r in board.collect()}
    assert set(b) == {"logistic_regression", "random_forest", "gradient_boosted_trees", "soft_vote"}
    assert all(0.5 < b[m].cv_auc <= 1.0 for m in b if m != "soft_vote")
    assert votes.count() == s.filter("is_test").count()
