"""Spark ML forests whose trees are grown by the hash-seeded learner."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from embercast.operators import forest, train


def frame(spark, n=1500):
    u = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("double")
    df = spark.range(n).select("id", u(1, 40).alias("a"), u(2, 25).alias("b"), u(3, 7).alias("noise"))
    df = df.withColumn("y", (F.col("a") + 2 * F.col("b") + F.col("noise") > 52).cast("int"))
    return train.fixed_layout(df.withColumn("w", F.when(F.col("y") == 1, 1.75).otherwise(0.5)), "id", 3)


def jobs_of(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_a_forest_takes_no_jobs_by_level(spark):
    df = frame(spark).cache()
    fit = lambda depth: lambda: train.train_forest(df, ["a", "b"], "y", num_trees=4, max_depth=depth, seed=3)
    jobs_of(spark, "first", fit(2))
    assert jobs_of(spark, "flat", fit(3)) == jobs_of(spark, "deep", fit(14))


def test_spark_model_is_the_grown_forest(spark):
    df = frame(spark)
    model = train.train_forest(df, ["a", "b", "noise"], "y", num_trees=5, max_depth=5, min_leaf=3, weight_col="w", seed=9)
    rf = model.stages[-1]
    assert (rf.getNumTrees, rf.numFeatures, rf.numClasses, rf.getMaxDepth(), rf.getSeed()) == (5, 3, 2, 5, 9)
    settings = forest.Settings(5, 5, 2, 3, 2, True, (0.5, 1.75), seed=9)  # Spark rounds the square root of 3 up
    ready, weights = train._ready(df, ["a", "b", "noise"], "y", train.forest_pipeline(["a", "b", "noise"], "y", weight_col="w", seed=9).getStages()[-1])
    assert weights == (0.5, 1.75)
    grown = forest.fit(df, ["a", "b", "noise"], "y", ["place"], settings, ready=ready)
    # scores: the mean over trees of the weighted shares of the merged leaves, walked here node by node
    trees = [{int(n): rest for n, *rest in train._merged(x, (0.5, 1.75)).tolist()} for x in grown.arrays]
    rows = model.transform(df).select("a", "b", "noise", vector_to_array("probability")[1].alias("p"), "prediction").collect()
    for r in rows[:300]:
        shares = []
        for nodes in trees:
            n = 1
            while nodes[n][0] >= 0:
                f, b, *_ = nodes[n]
                n = 2 * n + (r[f] > grown.cuts[f][b])
            shares.append(1.75 * nodes[n][3] / (0.5 * nodes[n][2] + 1.75 * nodes[n][3]))
        assert r.p == pytest.approx(sum(shares) / 5, abs=1e-12) and r.prediction == float(r.p > 0.5)
    # the merged splits are those without a leaf of the other class below them
    assert all(min(v[2:]) >= 0 and not (v[0] >= 0 and _one_class(nodes, n)) for nodes in trees for n, v in nodes.items())
    by_name = {r.feature: r.importance for r in train.feature_importance(model).collect()}
    assert sum(by_name.values()) == pytest.approx(1) and by_name["b"] > by_name["noise"]


def _one_class(nodes, n):
    leaves, todo = set(), [n]
    while todo:
        f, _, n0, n1 = nodes[m := todo.pop()]
        todo += [2 * m, 2 * m + 1] if f >= 0 else []
        leaves |= {1.75 * n1 > 0.5 * n0} if f < 0 else set()
    return len(leaves) == 1


def test_equals_sparks_learner_where_nothing_is_drawn(spark):
    # no bootstrap, all features, each value a bin of its own: one tree, whoever grows it
    df = frame(spark).withColumn("a", F.col("a") % 16).withColumn("b", F.col("b") % 16)
    args = dict(num_trees=2, max_depth=6, max_features=None, bootstrap=False, weight_col="w")
    one = train.train_forest(df, ["a", "b"], "y", **args)
    two = train.forest_pipeline(["a", "b"], "y", **args).fit(df)
    p = lambda m: [r[0] for r in m.transform(df.orderBy("id")).select(vector_to_array("probability")[1]).collect()]
    assert p(one) == pytest.approx(p(two), abs=1e-12)
    assert np.allclose(one.stages[-1].featureImportances.toArray(), two.stages[-1].featureImportances.toArray(), atol=1e-9)


def test_other_labels_and_weights_go_to_sparks_learner(spark):
    df = frame(spark, 300)
    three = train.train_forest(df.withColumn("y", F.col("id") % 3), ["a", "b"], "y", num_trees=2, max_depth=2)
    assert three.stages[-1].numClasses == 3
    by_row = dict(num_trees=2, max_depth=3, weight_col="v", seed=4)
    df = df.withColumn("v", 1 + F.col("id") % 2)
    text = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.stages[-1].trees]
    assert text(train.train_forest(df, ["a", "b"], "y", **by_row)) == text(train.forest_pipeline(["a", "b"], "y", **by_row).fit(df))
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception):  # noqa: B017
            train.train_forest(df.withColumn("a", F.when(F.col("id") == 7, bad).otherwise(F.col("a"))), ["a", "b"], "y", num_trees=2, max_depth=2)


class Asked(Exception):
    pass


def asked(monkeypatch):
    def stop(df, features, label, keys, candidates, fold, folds, *a, **k):
        raise Asked(candidates, folds)

    monkeypatch.setattr(forest, "search", stop)


def test_registered_searches_leave_out_nothing(spark, monkeypatch):
    from embercast import fixed
    from embercast.plans import catalog

    asked(monkeypatch)
    for query, n in (("forest_search", 20), ("search_leaderboard", 30)):
        with pytest.raises(Asked) as found:
            catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
        candidates, folds = found.value.args
        drawn = train.sample_search_space(n, 42, fixed.SEARCH_SPACE)
        assert folds == 4 and [(c.trees, c.min_split, c.min_leaf, c.bootstrap) for c in candidates] == [
            (c["n_estimators"], c["min_samples_split"], c["min_samples_leaf"], c["bootstrap"]) for c in drawn]
        assert [c.max_depth or 30 for c in candidates] == [c["max_depth"] or 30 for c in drawn]


SPACE = {"n_estimators": [3, 5], "max_depth": [2, None], "min_samples_split": [2, 60], "min_samples_leaf": [1, 4],
         "max_features": ["sqrt", None], "bootstrap": [True, False], "class_weight": ["balanced", "balanced_subsample"]}


def test_search_scores_candidates_as_their_forests_do(spark):
    df = frame(spark, 700).withColumn("fold", (F.col("id") % 3).cast("int"))
    best, board = train.random_search(df, ["a", "b", "noise"], "y", n_iter=4, folds=3, weight_col="w", seed=5, space=SPACE)
    rows = {r.candidate: r for r in board.collect()}
    ready, weights = train._ready(df, ["a", "b", "noise"], "y", train.forest_pipeline(["a"], "y", weight_col="w", seed=5).getStages()[-1], "fold", 3)
    for i, c in enumerate(train.sample_search_space(4, 5, SPACE)):
        assert (rows[i].n_estimators, rows[i].min_samples_split) == (c["n_estimators"], c["min_samples_split"])
        f1 = []
        for k in range(3):
            s = forest.Settings(c["n_estimators"], c["max_depth"], c["min_samples_split"], c["min_samples_leaf"], 2 if c["max_features"] else 3, c["bootstrap"],
                                weights if c["class_weight"] == "balanced" else "balanced_subsample", k, 5)
            grown = forest.fit(df, ["a", "b", "noise"], "y", ["place"], s, fold="fold", ready=ready)
            got = [(r.y, r.p > 0.5) for r in grown.score(df.filter(F.col("fold") == k), "p").collect()]
            tp, wrong = got.count((1, True)), got.count((1, False)) + got.count((0, True))
            f1.append(2 * tp / (2 * tp + wrong))
        assert rows[i].mean_f1 == pytest.approx(sum(f1) / 3, abs=1e-12)
    first = board.first()
    assert best.model().stages[-1].getNumTrees == first.n_estimators and best.model().transform(df).filter("prediction = y").count() > 500


def test_search_in_batches_equals_one(spark):
    df = frame(spark, 500).withColumn("fold", (F.col("id") % 2).cast("int"))
    options = [forest.Settings(7, 6, min_leaf=2, seed=3), forest.Settings(9, 4, max_features=None, bootstrap=False, seed=3), forest.Settings(4, None, seed=3)]
    fits = [forest.replace(s, without_fold=k) for s in options for k in range(2)]
    cut = forest._batches(fits, 3, 500, 500 * 8 * 5)
    assert len(cut) > 3 and all(sum(s.trees if s.bootstrap else 1 for _, s in b) <= 5 for b in cut)
    for i, s in enumerate(fits):
        own = [piece for b in cut for j, piece in b if j == i]
        assert [t for p in own for t in range(p.first, p.first + p.trees)] == list(range(s.trees))
    board = lambda **k: [tuple(r) for r in forest.search(df, ["a", "b", "noise"], "y", ["id"], options, "fold", 2, **k)[1].collect()]
    assert board() == board(sent_bytes=500 * 8 * 5)


def test_trees_grown_in_batches_are_the_same(spark):
    df = frame(spark, 500)
    s = forest.Settings(7, 5, seed=3)
    ready = forest.prepared(df, ["a", "b"], "y", ["id"], 3)
    whole = forest.fit(df, ["a", "b"], "y", ["id"], s, ready=ready)
    cut = forest.fit_arrays(df, ["a", "b"], "y", ["id"], s, 32, ready, sent_bytes=500 * 7 * 3)  # three trees at a time
    assert cut.nodes == whole.nodes and cut.numbers == whole.numbers and cut.twin == whole.twin


def test_sweep_grows_its_forest_like_train_forest(spark):
    df = frame(spark, 600).withColumns({"site_id": F.col("id"), "date": F.lit(1)})
    board, votes = train.model_sweep(df, df, ["a", "b", "noise"], "y", weight_col="w")
    alone = train.train_forest(df, ["a", "b", "noise"], "y", num_trees=100, max_depth=10, weight_col="w", seed=42)
    want = {r.id: r.p for r in alone.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert {r.site_id: r.p_random_forest for r in votes.collect()} == want and board.count() == 4


def test_requests_are_parsed_once(spark):
    from embercast.sources import files

    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        parsed.add(1)
        return text

    df = spark.createDataFrame([("r", '{"data": [[1, 2], [3], [4, null]]}')], "request_id string, body string").select("request_id", seen.asNondeterministic()("body").alias("body"))
    good, bad = files.parse_score_requests(df, features=["a", "b"])
    assert [tuple(r) for r in good.collect()] == [("r", 0, 1.0, 2.0)] and {r.row_idx for r in bad.collect()} == {1, 2}
    assert parsed.value == 1
