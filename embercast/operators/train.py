"""Training and search (M1-M6) as Spark ML models.

The trees of a forest of class 0 / 1 are grown by ``operators/forest.py`` and handed
to Spark as a saved model of its own; other labels and weights go to Spark's learner.
The driver holds only parameter maps, metrics and the model.
For reproducible forests the input layout is fixed first
(rows spread and sorted by a key that names them): same seed + same layout ->
same model.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..session import checkpoint_path, cut_lineage
from . import forest

MAX_DEPTH_UNBOUNDED = 30  # Spark's ceiling for maxDepth (31 is rejected)


def fixed_layout(df: DataFrame, keys, partitions: int | None = None) -> DataFrame:
    """Deterministic row layout so that a seeded forest is reproducible, whatever
    files the rows come from. ``keys`` must name a row: rows spread by the hash
    of all of them (no site fills a partition) and are sorted by all of them."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def forest_pipeline(features, label: str = fixed.TARGET, num_trees: int = 200, max_depth: int | None = None,
                    min_leaf: int = 1, max_features: str | None = "sqrt", bootstrap: bool = True,
                    weight_col: str | None = None, seed: int = 42, scale: bool = False) -> Pipeline:
    """M1/M2: assembler (+ optional scaler) + random forest. ``max_depth=None``
    (unbounded in sklearn) maps to Spark's ceiling 30; ``max_features=None``
    maps to all features. Rows find their nodes by walking the trees: a node id
    cache writes rows x trees numbers anew at every level."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw" if scale else "features",
                              handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    rf = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=num_trees,
        maxDepth=MAX_DEPTH_UNBOUNDED if max_depth is None else max_depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=max_features or "all",
        bootstrap=bootstrap, seed=seed, maxMemoryInMB=1024)
    if weight_col:
        rf.setWeightCol(weight_col)
    stages.append(rf)
    return Pipeline(stages=stages)


def train_forest(df: DataFrame, features, label: str = fixed.TARGET, **kw) -> PipelineModel:
    """``forest_pipeline`` fitted: its parameters, the number of features that Spark draws for them, bootstrap draws by
    the row's place in the layout, sibling leaves of the same class merged as Spark does. All trees grow together
    (``forest.fit``), no bags are kept. Spark's own learner fits (or refuses) what isn't a table of numbers with classes 0
    and 1 and a positive weight for each."""
    pipe = forest_pipeline(features, label, **kw)
    rf = pipe.getStages()[-1]
    model = None if kw.get("scale") else _fitted(df, features, label, rf)
    return pipe.fit(df) if model is None else PipelineModel([pipe.getStages()[0], model])


def _fitted(df: DataFrame, features, label: str, rf: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """``rf`` fitted by ``forest.fit``, or None if that can't take the rows."""
    ready = _ready(df, features, label, rf)
    if ready is None:
        return None
    grown = forest.fit_arrays(df, features, "y", ["place"], _settings(rf, len(features), ready[1]), rf.getMaxBins(), ready[0])
    return _spark_forest(grown, rf, df.sparkSession)


def _ready(df: DataFrame, features, label: str, rf: RandomForestClassifier, fold: str | None = None,
           folds: int = 0) -> tuple[forest.Prepared, tuple[float, float]] | None:
    """The rows, laid out and binned, with the weights of classes 0 and 1, if ``forest.fit`` can take them."""
    if not all(isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in [*features, label]):
        return None
    weight = F.col(rf.getWeightCol()).cast("double") if rf.isDefined(rf.weightCol) else F.lit(1.0)
    laid = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                                 weight.alias("w"), (F.col(fold) if fold else F.lit(-1)).alias("fold"), F.monotonically_increasing_id().alias("place")))
    odd = ~F.col("y").isin(0.0, 1.0) | ~(F.col("w") > 0)
    if fold:
        odd |= ~F.col("fold").between(0, folds - 1)
    for i in range(len(features)):
        odd |= F.isnan(f"x{i}") | F.col(f"x{i}").isNull()
    in_class = [F.when(F.col("y") == k, F.col("w")) for k in (0, 1)]
    found = laid.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"),
                     *[f(c).alias(f"{n}{k}") for k, c in enumerate(in_class) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not found["n"] or found["odd"] or any(found[f"lo{k}"] != found[f"hi{k}"] for k in (0, 1)):
        return None
    x = [f"x{i}" for i in range(len(features))]
    ready = forest.prepared(laid, x, "y", F.pmod(F.xxhash64("place", F.lit(rf.getSeed())), F.lit(forest.PRIME)), rf.getSeed(), rf.getMaxBins(), "fold")
    return ready, tuple(1.0 if found[f"lo{k}"] is None else found[f"lo{k}"] for k in (0, 1))


def _settings(rf: RandomForestClassifier, n: int, weights: tuple[float, float]) -> forest.Settings:
    """Spark rounds the square root and the logarithm of the number of features up."""
    kind = rf.getFeatureSubsetStrategy()
    kind = ("sqrt" if rf.getNumTrees() > 1 else "all") if kind == "auto" else kind
    wanted = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}[kind]
    return forest.Settings(rf.getNumTrees(), rf.getMaxDepth(), 2, rf.getMinInstancesPerNode(), wanted, rf.getBootstrap(), weights, seed=rf.getSeed())


def _merged(x: np.ndarray, w: tuple[float, float]) -> np.ndarray:
    """A tree's nodes (node, feature, bin, n0, n1, ascending: a child comes after its parent) without the splits below
    which all leaves are of one class."""
    x, depth = x.copy(), np.floor(np.log2(x[:, 0])).astype(int)
    left, fire, kept = np.searchsorted(x[:, 0], 2 * x[:, 0]), w[1] * x[:, 4] > w[0] * x[:, 3], np.ones(len(x), bool)
    for d in range(depth.max(), -1, -1):
        at = np.flatnonzero((depth == d) & (x[:, 1] >= 0))
        a, b = left[at], left[at] + 1
        at = at[(x[a, 1] < 0) & (x[b, 1] < 0) & (fire[a] == fire[b])]
        x[at, 1], kept[left[at]], kept[left[at] + 1] = -1, False, False
    return x[kept]


def _spark_forest(grown: forest.Forest, rf: RandomForestClassifier, spark: SparkSession) -> RandomForestClassificationModel:
    """The grown trees as Spark's model, read from files as Spark writes them (a call into the JVM for each node takes
    longer than the growing)."""
    path = checkpoint_path(spark, f"trees-{uuid.uuid4().hex}")
    parts = []
    for t, (x, w) in enumerate(zip(grown.arrays, grown.weights, strict=True)):
        x = _merged(x, w)
        node, f, b, n0, n1 = x.T
        s0, s1 = w[0] * n0, w[1] * n1
        n = s0 + s1
        impurity, left, split = 1 - (s0 * s0 + s1 * s1) / (n * n), np.searchsorted(node, 2 * node), np.flatnonzero(f >= 0)
        l, r = left[split], left[split] + 1
        gain = np.full(len(x), -1.0)
        gain[split] = impurity[split] - (n[l] * impurity[l] + n[r] * impurity[r]) / n[split]
        cut = np.zeros(len(x))
        cut[split] = [grown.cuts[i][j] for i, j in zip(f[split].tolist(), b[split].tolist(), strict=True)]
        parts.append(pa.table({
            "treeID": pa.array(np.full(len(x), t), pa.int32()), "id": pa.array(np.arange(len(x)), pa.int32()), "prediction": pa.array((s1 > s0).astype(float)),
            "impurity": pa.array(impurity), "s0": pa.array(s0), "s1": pa.array(s1), "rawCount": pa.array(n0 + n1), "gain": pa.array(gain),
            "leftChild": pa.array(np.where(f >= 0, left, -1), pa.int32()), "rightChild": pa.array(np.where(f >= 0, left + 1, -1), pa.int32()),
            "f": pa.array(f, pa.int32()), "cut": pa.array(cut)}))
    rows = spark.createDataFrame(pa.concat_tables(parts))
    is_split, c = F.col("f") >= 0, F.col
    split = F.struct(c("f").alias("featureIndex"), F.when(is_split, F.array("cut")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories"))
    rows.select("treeID", F.struct("id", "prediction", "impurity", F.array("s0", "s1").alias("impurityStats"), "rawCount", "gain",
                                   "leftChild", "rightChild", split.alias("split")).alias("nodeData")).coalesce(1).write.parquet(path + "/data")

    def written(model: str, uid: str, without=(), **more) -> str:
        known = [p for p in rf.params if p.name not in without]
        return json.dumps({"class": "org.apache.spark.ml.classification." + model, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: rf.getOrDefault(p) for p in known if rf.isSet(p)},
                           "defaultParamMap": {p.name: rf.getOrDefault(p) for p in known if rf.hasDefault(p) and not rf.isSet(p)}, **more})

    of_forest = ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate")
    trees = [(t, written("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", of_forest), 1.0) for t in range(len(parts))]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(path + "/treesMetadata")
    whole = written("RandomForestClassificationModel", rf.uid, numFeatures=len(grown.features), numClasses=2, numTrees=len(parts))
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(path + "/metadata")
    return RandomForestClassificationModel.load(path)


def feature_importance(model: PipelineModel, top: int | None = None) -> DataFrame:
    """M5 (+ O2): importances with the feature NAMES, descending, ties by name."""
    assembler = model.stages[0]
    names = assembler.getInputCols()
    imp = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    t = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    t = t.orderBy(F.desc("importance"), F.asc("feature"))
    return t.limit(top) if top else t


def sample_search_space(n_iter: int, seed: int = 42, space=None) -> list[dict]:
    """M3: ``n_iter`` distinct candidates drawn with a seeded generator (the
    space is small and discrete; this is driver-side parameter bookkeeping)."""
    space = space or fixed.SEARCH_SPACE
    keys = list(space)
    rng = random.Random(seed)
    grid_size = 1
    for k in keys:
        grid_size *= len(space[k])
    seen, out = set(), []
    while len(out) < min(n_iter, grid_size):
        cand = tuple(rng.randrange(len(space[k])) for k in keys)
        if cand not in seen:
            seen.add(cand)
            out.append({k: space[k][i] for k, i in zip(keys, cand)})
    return out


@dataclass
class Best:
    """The best candidate, refitted on all rows; ``model`` brings its trees to the driver."""
    model: Callable[[], PipelineModel]


def random_search(df: DataFrame, features, label: str = fixed.TARGET, n_iter: int = 30, folds: int = 4,
                  fold_col: str = "fold", weight_col: str | None = "weight", seed: int = 42,
                  parallelism: int = 4, space=None) -> tuple[Best, DataFrame]:
    """M3: sampled candidates over the given stratified ``fold_col`` (M4), scored by F1 of the positive class, best
    refitted on all rows. All candidates x folds grow in shared passes (``forest.search``), every parameter applied:
    "balanced" is the weight column, "balanced_subsample" goes by a tree's draws.

    What ``train_forest`` leaves to Spark's learner goes to its CrossValidator (``parallelism`` fits at once), which knows no
    ``min_samples_split`` and takes the weight column for both. Returns (best, leaderboard DataFrame)."""
    cands = sample_search_space(n_iter, seed, space)
    pipe = forest_pipeline(features, label, weight_col=weight_col, seed=seed)
    rf = pipe.getStages()[-1]
    ready = _ready(df, features, label, rf, fold_col, folds) if fold_col else None
    if ready is None:
        best, means = _cross_validated(df, pipe, cands, label, folds, fold_col, seed, parallelism)
    else:
        def own(c: dict) -> RandomForestClassifier:
            return rf.copy({rf.numTrees: c["n_estimators"], rf.maxDepth: MAX_DEPTH_UNBOUNDED if c["max_depth"] is None else c["max_depth"],
                            rf.minInstancesPerNode: c["min_samples_leaf"], rf.featureSubsetStrategy: c["max_features"] or "all", rf.bootstrap: c["bootstrap"]})

        weights = [c["class_weight"] if weight_col and c["class_weight"] == "balanced_subsample" else ready[1] for c in cands]
        options = [replace(_settings(own(c), len(features), w), min_split=c["min_samples_split"]) for c, w in zip(cands, weights, strict=True)]
        grown, found = forest.search(df, features, "y", ["place"], options, "fold", folds, rf.getMaxBins(), ready=ready[0])
        means = {r["candidate"]: r["mean_f1"] for r in found.collect()}
        first = min(means, key=lambda i: (-means[i], i))
        best = Best(lambda: PipelineModel([pipe.getStages()[0], _spark_forest(grown, own(cands[first]), df.sparkSession)]))
    rows = [(i, c["n_estimators"], c["max_depth"], c["min_samples_split"], c["min_samples_leaf"],
             str(c["max_features"]), c["bootstrap"], c["class_weight"], float(means[i])) for i, c in enumerate(cands)]
    board = df.sparkSession.createDataFrame(rows, "candidate int, n_estimators int, max_depth int, min_samples_split int, "
                                                  "min_samples_leaf int, max_features string, bootstrap boolean, "
                                                  "class_weight string, mean_f1 double")
    return best, board.orderBy(F.desc("mean_f1"), "candidate")


def _cross_validated(df: DataFrame, pipe: Pipeline, cands: list[dict], label: str, folds: int, fold_col: str | None, seed: int, parallelism: int):
    rf, maps = pipe.getStages()[-1], []
    for c in cands:
        maps.append({
            rf.numTrees: c["n_estimators"],
            rf.maxDepth: MAX_DEPTH_UNBOUNDED if c["max_depth"] is None else c["max_depth"],
            rf.minInstancesPerNode: c["min_samples_leaf"],
            rf.featureSubsetStrategy: c["max_features"] or "all",
            rf.bootstrap: c["bootstrap"],
        })
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, parallelism=parallelism, seed=seed)
    if fold_col:
        cv.setFoldCol(fold_col)
    model = cv.fit(df)
    return Best(lambda: model.bestModel), model.avgMetrics


def model_sweep(train: DataFrame, test: DataFrame, features, label: str = fixed.TARGET,
                keys=("site_id", "date"), weight_col: str | None = "weight", seed: int = 42,
                fold_col: str | None = None, folds: int = 5):
    """M6 (re-aimed managed AutoML): fit logistic regression, random forest and
    gradient-boosted trees, rank them by exact ROC-AUC on ``test`` and add a
    soft-vote ensemble (mean probability). With ``fold_col`` the leaderboard
    also carries each model's mean cross-validated AUC (one CrossValidator
    whose candidates swap the pipeline's learner stage). Returns (leaderboard, votes)."""
    from .curves import roc_auc

    def learners(own: bool) -> dict:
        """own: every learner writes columns of its own, so that one chain of transforms holds them all."""
        made = {
            "logistic_regression": LogisticRegression(labelCol=label, maxIter=50),
            "random_forest": RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=10, seed=seed),
            "gradient_boosted_trees": GBTClassifier(labelCol=label, maxIter=20, maxDepth=4, seed=seed),
        }
        for name, m in made.items():
            if own:
                m.setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_c_{name}")
            if weight_col:
                m.setWeightCol(weight_col)
        return made

    prepare = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)]).fit(train)
    ready, out = prepare.transform(train), prepare.transform(test)
    for name, est in learners(True).items():
        model = _fitted(train, features, label, est.copy().setFeaturesCol("_raw")) if name == "random_forest" else None  # scaling moves no split
        out = (model or est.fit(ready)).transform(out)
    names = [f"p_{n}" for n in learners(True)]
    votes = out.select(*keys, F.col(label).alias("y"), *[vector_to_array("_" + n)[1].alias(n) for n in names])
    votes = cut_lineage(votes.withColumn("p_vote", sum(F.col(n) for n in names) / len(names)))
    board = None
    for n in [*names, "p_vote"]:
        one = roc_auc(votes, "y", n).select(F.lit("soft_vote" if n == "p_vote" else n[2:]).alias("model"), "roc_auc")
        board = one if board is None else board.unionByName(one)
    if fold_col:
        ests = learners(False)
        cv = CrossValidator(estimator=Pipeline(stages=[next(iter(ests.values()))]), numFolds=folds, foldCol=fold_col,
                            estimatorParamMaps=[{Pipeline.stages: [est]} for est in ests.values()],
                            evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
                            parallelism=len(ests), seed=seed)
        cv.setEstimatorParamMaps([{cv.getEstimator().stages: [est]} for est in ests.values()])
        cv_auc = train.sparkSession.createDataFrame(
            [(n, float(m)) for n, m in zip(ests, cv.fit(ready).avgMetrics)], "model string, cv_auc double")
        board = board.join(cv_auc, ["model"], "left")
    return board, votes


def binary_auc_evaluator(label: str = fixed.TARGET) -> BinaryClassificationEvaluator:
    """Spark's binned AUC (approximate beyond ``numBins`` distinct scores);
    the exact figure is ``curves.roc_auc``."""
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")



def fixed_logistic(spark: SparkSession, features, coefficients, intercept: float) -> PipelineModel:
    """A logistic scorer with given coefficients (published or fitted elsewhere):
    P(1) = 1 / (1 + exp(-(intercept + sum(coefficient * feature))))."""
    sc = spark.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "fixed_logistic", _py2java(sc, Vectors.dense(list(coefficients))), float(intercept))
    return PipelineModel([VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
                          LogisticRegressionModel(java)])
