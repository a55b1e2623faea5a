"""Fills and rolling windows over one site that holds all rows; the candidate queue; the training job."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from embercast.operators import clean, curves, features, forest, model_queue, split
from embercast.plans import jobs


def hot_site(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(1, i, rng.gauss(0, 1) if rng.random() < 0.1 else None, float(i % 7), 0) for i in range(n)]
    return rows + [(2, 0, None, None, 0), (2, 1, None, 1.0, 0), (None, 0, 5.0, None, 0), (None, 1, None, 2.0, 0)]


def test_fill_of_one_site_with_all_rows(spark):
    rows = hot_site()
    df = spark.createDataFrame(rows, "site_id int, date int, x double, precipitacion double, incendio int").repartition(4)
    pdf = pd.DataFrame(rows, columns=["site_id", "date", "x", "p", "y"])
    median = pdf["x"].median()
    got = {(r["site_id"], r["date"]): r["x"] for r in clean.fill_three_stage(df, ["x"]).collect()}
    assert len(got) == len(rows)
    for site, own in pdf.groupby("site_id", dropna=False):
        want = own.sort_values("date")["x"].ffill().bfill().fillna(median)
        key = None if pd.isna(site) else int(site)
        assert [got[key, i] for i in range(len(own))] == pytest.approx(want.tolist())


@pytest.mark.parametrize("block", [None, 1, 37, 10_000])
def test_rolling_windows_in_blocks(spark, block):
    rows = hot_site(200)
    df = spark.createDataFrame(rows, "site_id int, date int, x double, precipitacion double, incendio int").repartition(4)
    got = {(r["site_id"], r["date"]): r for r in features.rolling_features(df, ["x"], windows=(3, 10), block=block).collect()}
    assert len(got) == len(rows) and set(got[1, 0].asDict()) == {*df.columns, "x_ma3", "x_ma10", "precip_acum_3d", "precip_acum_10d"}
    x, p = [r[2] for r in rows[:200]], [r[3] for r in rows[:200]]
    for i in range(200):
        for n in (3, 10):
            last = [v for v in x[max(0, i - n + 1):i + 1] if v is not None]
            assert got[1, i][f"x_ma{n}"] == (pytest.approx(sum(last) / len(last)) if last else None)
            assert got[1, i][f"precip_acum_{n}d"] == pytest.approx(sum(p[max(0, i - n + 1):i + 1]))


def training_rows(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rng.randint(0, 20) / 2, rng.randint(0, 20) / 2
        rows.append((i, i % 7, a, b, int(a - b + rng.gauss(0, 2) > 2)))
    return spark.createDataFrame(rows, "date int, site_id int, temperatura double, humedad double, incendio int").repartition(3)


def test_queue_stops_and_selects(spark):
    df = split.stratified_folds(training_rows(spark), "incendio", ("site_id", "date"), 3, 1)
    cols, keys = ["temperatura", "humedad"], ("site_id", "date")
    good, poor = forest.Settings(trees=5, max_depth=4, max_features=None), forest.Settings(trees=1, max_depth=1, max_features=1, bootstrap=False)
    out = model_queue.run_queue(df, cols, "incendio", keys, [good, poor, poor, forest.Settings(trees=40)], folds=3, patience=2)
    board = {r["candidate"]: r for r in out.leaderboard.collect()}
    assert set(board) == {0, 1, 2} and out.ensemble[0] == 0  # two without a gain: the fourth never ran
    assert out.auc >= board[0]["cv_auc"] > board[1]["cv_auc"] == board[2]["cv_auc"]
    assert [out.ensemble.count(i) for i in range(3)] == [board[i]["times"] for i in range(3)]
    own = model_queue.out_of_fold(df, cols, "incendio", keys, good, "fold", 3, "p")
    assert math.isclose(curves.roc_auc(own, "incendio", "p").first()[0], board[0]["cv_auc"], rel_tol=1e-12)
    assert curves.roc_auc(out.score(df), "incendio", "prob").first()[0] > board[0]["cv_auc"] - 0.05


def test_training_job(spark):
    df = training_rows(spark).withColumn("incendio", F.when(F.col("date") % 50 > 0, F.col("incendio")))  # some rows without a class
    space = {"n_estimators": [4, 8], "max_depth": [3, None], "min_samples_split": [2], "min_samples_leaf": [1, 5],
             "max_features": ["sqrt", None], "bootstrap": [True], "class_weight": ["balanced", "balanced_subsample"]}
    out = jobs.training_job(df, ["temperatura", "humedad"], n_iter=3, folds=3, space=space)
    board = out["leaderboard"].collect()
    assert len(board) == 3 and [r["mean_f1"] for r in board] == sorted((r["mean_f1"] for r in board), reverse=True)
    assert all(math.isclose(r["mean_f1"], sum(r["fold_f1"]) / 3) for r in board)
    assert len(out["forest"].nodes) == board[0]["trees"]
    values = {r["metric"]: r["value"] for r in out["metrics"].collect()}
    assert values["roc_auc"] > 0.7 and out["test"].count() == sum(r["count"] for r in out["confusion"].collect())
