"""Composite jobs (X1-X6): operator chains. Statistics that later steps need
(medians, means, counts) are fitted by small jobs while a chain is built; the
rest is lazy until the final write or the model fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import fit_row, numeric_columns
from ..operators import clean, curves, features, forest, hotspots, scale, scoring, split, train
from ..session import cut_lineage
from ..sources import files, sinks

VALUES = ["temperatura", "humedad", "velocidad_viento", "precipitacion", "temp_max", "temp_min"]
MA_COLS = ["temperatura", "humedad", "velocidad_viento", "precipitacion"]


def etl_daily(hourly_replies: DataFrame, detections: DataFrame, boxes: DataFrame, variables,
              out_path: str | None = None, min_confidence: int = fixed.MIN_CONFIDENCE) -> DataFrame:
    """Hourly replies -> daily weather (S2); detections -> sites (J5, with
    the confidence floor of P1) -> daily fires (A1); weather LEFT JOIN fires
    (J1, 0 only on ingested days); optional partitioned write (S6)."""
    weather = files.flatten_hourly(hourly_replies, "body", ("site_id", "date"), variables)
    kept = detections.filter(F.col("confidence") >= min_confidence)
    fires = hotspots.daily_hotspots(hotspots.assign_sites(kept, boxes), keys=("site_id", "acq_date"))
    ingested = detections.select(F.col("acq_date").alias("date")).distinct()
    out = hotspots.join_weather_fires(weather, fires, ("site_id", "date"), ingested)
    if out_path:
        sinks.write_table(out, out_path, partition_by=("date",))
    return out


def clean_job(raw: DataFrame, cols=VALUES, target: str = fixed.TARGET, validate: bool = True,
              out_path: str | None = None) -> DataFrame:
    """First-record dedup (E1) -> three-stage fill (C1) -> outlier flags
    (C3) -> target validation (A5) -> calendar block (C11) [-> sink (S6)].

    The deduplicated, filled table is read three times (flag statistics,
    validation, output), so it is checkpointed once to the shared folder:
    the dedup shuffle and the fill windows run once, and a lost executor
    re-reads the checkpoint instead of recomputing the chain."""
    d = cut_lineage(clean.dedup_first(raw, ("site_id", "date"), "ingest_seq"))  # medians and the fill read it
    f = cut_lineage(clean.fill_three_stage(d, cols, ("site_id",), "date", target))
    flagged = clean.outlier_flags(f, fixed.OUTLIER_FLAG_THRESHOLD, cols, target)
    if validate:
        clean.validate_target(flagged, target)
    out = features.temporal_features(flagged, "date", "clean")
    if out_path:
        sinks.write_table(out, out_path, partition_by=("date",))
    return out


FEATURE_NO_SCALE = ["año", "mes", "dia", fixed.TARGET, "site_id"]


def feature_job(df: DataFrame, value_cols=MA_COLS, target: str = fixed.TARGET, pca=None) -> DataFrame:
    """Calendar (C11, Spanish block) -> meteorological (C12) -> rolling
    (C13, explicit columns, never the target) -> interactions (F12) ->
    standard scaling of the numeric features (C5) -> integer target (P6)
    [-> PCA (C7)]."""
    t = features.temporal_features(df, "date", "feature")
    t = features.meteo_features(t)
    t = features.rolling_features(t, value_cols, ("site_id",), "date", (7, 30), "precipitacion")
    t = cut_lineage(features.interactions(t))  # read twice: scaling statistics and output
    cols = numeric_columns(t, exclude=FEATURE_NO_SCALE)
    t = scale.standard_scale(t, cols)
    t = t.withColumn(target, F.col(target).cast("int"))
    if pca is not None:
        t = scale.pca_project(t, cols, pca, keep=("site_id", "date", target))
    return t


def model_ready(df: DataFrame, target: str = fixed.TARGET, cols=VALUES, test_size: float = 0.2,
                seed: int = 42, exclude_target: bool = True) -> DataFrame:
    """Errors on an empty frame or a missing target; mean fill (C2),
    outlier removal at 3.5 population z (C4), integer target, exact stratified
    split (C9), standard scaling fitted on the training rows only (C5).
    Returns one frame with ``is_test``."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    fill_cols = list(cols) + [target]
    row, st = fit_row(df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in fill_cols]))
    if row["_n"] == 0:  # the row count is part of the same one-row fit
        raise ValueError("empty input")
    f = df.withColumns({c: F.coalesce(F.col(c).cast("double"), st[c]) for c in fill_cols})  # C2 mean
    f = clean.outlier_remove(f, fixed.MODEL_READY_OUTLIER_THRESHOLD, list(cols), target,
                             exclude_target=exclude_target)
    f = f.withColumn(target, F.col(target).cast("int"))
    # read twice (scaler fit on the training rows, then applied to all): checkpoint once
    s = cut_lineage(split.stratified_split(f, target, ("site_id", "date"), test_size, seed))
    return scale.standard_scale(s, list(cols), fit_on=s.filter(~F.col("is_test")))


def train_job(df: DataFrame, features_cols=VALUES, target: str = fixed.TARGET, model_path: str | None = None,
              n_iter: int = 20, folds: int = 4, seed: int = 42, space=None):
    """Split -> balanced weights -> stratified folds -> random search ->
    refit best -> save (S10). Returns (model, leaderboard, test rows)."""
    # every fold reads the training rows again: split, weights and folds are made once
    s = cut_lineage(split.class_weights(split.stratified_split(df, target, ("site_id", "date"), 0.2, seed), target))
    tr = cut_lineage(split.stratified_folds(s.filter(~F.col("is_test")), target, ("site_id", "date"), folds, seed))
    best, board = train.random_search(train.fixed_layout(tr, ("site_id", "date")), features_cols, target, n_iter, folds,
                                      "fold", "weight", seed, space=space)
    model = best.model()
    if model_path:
        sinks.save_model(model, model_path)
    return model, board, s.filter(F.col("is_test"))


def evaluation_job(model, test: DataFrame, target: str = fixed.TARGET, metrics_path: str | None = None,
                   report_path: str | None = None):
    """Score the test rows, then metrics (V1/V2), report (V3), confusion
    (A11) and curves; optional JSON / CSV sinks (S7, S9)."""
    scored = cut_lineage(scoring.batch_score(model, test, keep=(target,)).select(  # scored once, read by four results
        F.col(target).alias("y"), F.col("prediction").alias("pred"), F.col("probability_fire").alias("prob")))
    m = curves.metrics(scored, "y", "pred", "prob")
    rep = curves.report(scored, "y", "pred")
    if metrics_path:
        sinks.write_metrics_json(m, metrics_path)
    if report_path:
        sinks.write_report(rep, report_path)
    return m, rep, curves.confusion(scored, "y", "pred"), curves.roc_points(scored, "y", "prob")


def candidates(n_iter: int, seed: int = 42, space=None, trees_divided_by: int = 1) -> list[forest.Settings]:
    """M3: sampled settings, every parameter of the space applied."""
    return [forest.Settings(trees=max(1, c["n_estimators"] // trees_divided_by), max_depth=c["max_depth"], min_split=c["min_samples_split"],
                            min_leaf=c["min_samples_leaf"], max_features=c["max_features"], bootstrap=c["bootstrap"],
                            class_weight=c["class_weight"], seed=seed) for c in train.sample_search_space(n_iter, seed, space)]


def training_job(df: DataFrame, features_cols=VALUES, target: str = fixed.TARGET, keys=("site_id", "date"), n_iter: int = 20, folds: int = 4,
                 seed: int = 42, space=None, trees_divided_by: int = 1) -> dict:
    """X5 on the hash-seeded forest: split (C9) -> scaling fitted on the training rows (C5) -> stratified folds (M4) ->
    search over candidates x folds in shared passes (M3) -> best refitted -> test rows scored and evaluated (V1-V5).

    Returns forest, leaderboard (with each candidate's settings), test (scored), metrics, report, confusion, roc."""
    s = split.stratified_split(df, target, keys, 0.2, seed)
    s = scale.standard_scale(s, list(features_cols), fit_on=s.filter(~F.col("is_test")))
    s = cut_lineage(s)  # the folds, the search, the refit and the scores read it
    tr = cut_lineage(split.stratified_folds(s.filter(~F.col("is_test")), target, keys, folds, seed))
    options = candidates(n_iter, seed, space, trees_divided_by)
    model, board = forest.search(tr, features_cols, target, keys, options, "fold", folds)
    rows = [(i, c.trees, c.max_depth, c.min_split, c.min_leaf, str(c.max_features), c.bootstrap, c.class_weight) for i, c in enumerate(options)]
    names = "candidate int, trees int, max_depth int, min_split int, min_leaf int, max_features string, bootstrap boolean, class_weight string"
    board = board.join(df.sparkSession.createDataFrame(rows, names), "candidate").orderBy(F.desc("mean_f1"), "candidate")
    test = model.score(s.filter(F.col("is_test")).select(*keys, target, *features_cols), "prob")
    test = cut_lineage(test.withColumns({"y": F.col(target), "pred": (F.col("prob") > 0.5).cast("int")}))
    return {"forest": model, "leaderboard": board, "test": test, "metrics": curves.metrics(test), "report": curves.report(test),
            "confusion": curves.confusion(test), "roc": curves.roc_points(test)}
