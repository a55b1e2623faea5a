"""Scoring (Q1-Q4), risk presentation (P7-P10, P13) and prediction statistics
(A12-A14). Scoring is one ``transform`` in a map stage: no shuffle, and the
same function works on a streaming DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import risk


def batch_score(model: PipelineModel, df: DataFrame, keep=(), upper: bool = False) -> DataFrame:
    """Q1: prediction, label text, P(fire) and 4-level risk, plus ``keep`` columns.
    The input is transformed once (the features are assembled a single time)."""
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        risk.prediction_label(F.col("prediction").cast("int")).alias("prediction_label"),
        p.alias("probability_fire"),
        risk.risk_level4(p, upper=upper).alias("risk_level"),
    )


def score_with_details(model: PipelineModel, df: DataFrame, keep=()) -> DataFrame:
    """Q2: Q1 plus the UTC scoring timestamp (append it to the history with S8)."""
    return batch_score(model, df, keep).withColumn("timestamp", F.current_timestamp())


def predict(model: PipelineModel, df: DataFrame, keep=()) -> DataFrame:
    """Q3: class only."""
    return batch_score(model, df, keep).select(*keep, "prediction")


def predict_proba(model: PipelineModel, df: DataFrame, keep=()) -> DataFrame:
    """Q3: (P(no fire), P(fire))."""
    arr = vector_to_array(F.col("probability"))
    return model.transform(df).select(*keep, arr[0].alias("probability_no_fire"), arr[1].alias("probability_fire"))


def score_requests(model: PipelineModel, rows: DataFrame, model_name: str) -> DataFrame:
    """Q4: bulk positional/named requests (rows from ``parse_score_requests``)
    scored with the per-request envelope (model name, timestamp)."""
    scored = batch_score(model, rows, keep=("request_id", "row_idx"), upper=True)
    return scored.withColumns({"model_name": F.lit(model_name), "timestamp": F.current_timestamp()}) \
                 .withColumnRenamed("probability_fire", "probability")


# --------------------------------------------------------------------------- P12

def rename_vocabulary(df: DataFrame, mapping: dict) -> DataFrame:
    """One explicit projection between column vocabularies (old -> new)."""
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise ValueError(f"columns to rename not found: {missing}")
    return df.withColumnsRenamed(mapping)


# --------------------------------------------------------------------------- P10, P13

def advice_table(spark) -> DataFrame:
    """Risk level -> colour, heading and advice lines (5 rows, fixed values)."""
    return spark.createDataFrame(
        [(lv, col, head, "\n".join(lines)) for lv, col, head, lines in fixed.RISK_ADVICE],
        "risk_level string, color string, heading string, advice string")


def with_advice(df: DataFrame, level_col: str = "risk_level") -> DataFrame:
    """Broadcast lookup of a 5-row dimension (size fixed by definition)."""
    adv = advice_table(df.sparkSession).withColumnRenamed("risk_level", "_lv")
    return df.join(F.broadcast(adv), F.lower(F.col(level_col)) == F.col("_lv"), "left").drop("_lv")


def alerts(df: DataFrame, prob: str = "probability_fire", pred: str = "prediction",
           threshold: float = fixed.ALERT_THRESHOLD) -> DataFrame:
    """P13 (fixed): readings whose P(fire) exceeds the threshold and whose class is fire."""
    return df.withColumn("alert", risk.is_alert(prob, pred, threshold))


# --------------------------------------------------------------------------- A12

def prediction_stats(df: DataFrame, pred: str = "prediction") -> DataFrame:
    """Total, per-label counts and the most common label (ties -> the
    smaller label text). One aggregation, then a tiny one over <= 2 rows."""
    g = df.groupBy(risk.prediction_label(F.col(pred)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.sum("n").alias("total_predictions"),
        F.coalesce(F.sum(F.when(F.col("label") == fixed.LABEL_FIRE, F.col("n"))), F.lit(0)).alias("n_incendio"),
        F.coalesce(F.sum(F.when(F.col("label") == fixed.LABEL_NO_FIRE, F.col("n"))), F.lit(0)).alias("n_sin_incendio"),
        F.max_by("label", F.struct(F.col("n"), F.lit(0) - F.ascii(F.col("label")))).alias("most_common_prediction"),
    )
