"""Sinks (S6-S10): partitioned table writes, metrics and report tables, the
prediction history, and model persistence. All writes are distributed; nothing
is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by=("date",), fmt: str = "parquet") -> None:
    """Partitioned write with dynamic partition overwrite: re-running a day
    replaces only that day's folder (idempotent daily load). Rows are brought
    together by folder and rebalanced by their measured size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): one hot day is spread
    over many tasks and files, a small day is one file."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """The long (metric, value) table as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)  # a handful of rows


def append_predictions(pred: DataFrame, path: str) -> None:
    """Append scored rows (with their timestamp) to the prediction history."""
    out = pred if "timestamp" in pred.columns else pred.withColumn("timestamp", F.current_timestamp())
    out.write.mode("append").parquet(path)


def record_predictions(pred: DataFrame, path: str, batch_id: int) -> None:
    """S8, repeatable: the rows of one batch, under its id. A batch that is written
    again (a retried job, a replayed micro-batch) replaces its own rows only, and
    the folders are the ledger of the batches that the history holds."""
    out = pred if "timestamp" in pred.columns else pred.withColumn("timestamp", F.current_timestamp())
    out.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
       .partitionBy("batch_id").parquet(path)


def recorded_stream(pred: DataFrame, path: str, checkpoint: str, source: int = 0):
    """R1 + S8: a scored stream into the history, each micro-batch once whatever its retries; ``source`` (below
    1,000) keeps the batches of several streams apart. Returns the started query."""
    return pred.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True) \
               .foreachBatch(lambda rows, batch: record_predictions(rows, path, batch * 1000 + source)).start()


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Classification report table (a few rows)."""
    report.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)


def save_model(model, path: str) -> None:
    """Spark ML persistence; feature order lives in the VectorAssembler."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
