"""Manifest of landed replies (S4, X1): what was read, what failed, what never came.

Replies land as JSON lines ``{"site_id": .., "date": .., "body": "<reply text>"}``
in files of any size. ``load_new`` reads each file once, whatever the number of
runs, and writes one row per line with the file it came from; the manifest and
the readable replies are views over these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import HOURLY_REPLY

KEYS = ("site_id", "date")


def with_reason(lines: DataFrame, reply=HOURLY_REPLY) -> DataFrame:
    """Lines (``value``, other columns stay) -> site_id, date, body and ``reason``: NULL if the reply can be read,
    else why not. A line without a key (broken JSON, no site, no date) has NULL there; an hourly reply in which
    no variable has a value counts as failed, a value that is NULL beside others does not."""
    envelope = F.from_json("value", "site_id int, date date, body string")
    rows = lines.withColumn("_e", envelope).select(*[c for c in lines.columns if c != "value"], "_e.*")
    variables = F.from_json("body", reply)["hourly"]["variables"]
    any_value = F.exists(variables, lambda v: F.exists(v["values"], lambda x: x.isNotNull()))
    return rows.withColumn("reason", F.when(F.col("site_id").isNull() | F.col("date").isNull(), "no key")
                           .when(F.col("body").isNull(), "no reply")
                           .when(F.try_parse_json("body").isNull(), "reply is not JSON")
                           .when(~F.coalesce(any_value, F.lit(False)), "reply has no values"))


def load_new(spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int | None = None) -> None:
    """Read the files that landed in ``folder`` since the last call into the table ``out``.

    The checkpoint of the file stream is the ledger of files, so no listing is compared by hand and a call with
    nothing new reads nothing. Each batch has its folder, and one that is written again (a lost driver) replaces
    its own rows; keep the checkpoint as long as ``out``. A file without lines leaves no row: its days stay absent."""
    lines = spark.readStream.schema("value string")
    if max_files:
        lines = lines.option("maxFilesPerTrigger", max_files)
    landed = lines.text(folder).select("value", F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_modification_time").alias("landed_at"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch_id", F.lit(int(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("batch_id").parquet(out)

    query = with_reason(landed).writeStream.option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def expected_days(sites: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(site_id, date) for every day from ``start`` to ``end`` of each site, both included."""
    return sites.select("site_id", F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date"))


def manifest(loaded: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per (site_id, date) that was expected or came: ``status`` is 'read' if some reply can be read,
    'failed' if replies came and none can (``reason``: that of the latest file), else 'absent'; ``replies`` and
    ``failed`` count lines, ``files`` the files; ``expected`` is false for a day that nobody asked for. Lines
    without a key are in ``by_file`` only. Repeated rows of ``expected`` count once."""
    came = loaded.filter(F.col("site_id").isNotNull() & F.col("date").isNotNull()).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("replies"), F.count("reason").alias("failed"), F.count_distinct("file").alias("files"),
        F.max(F.when(F.col("reason").isNotNull(), F.struct("landed_at", "file", "reason")))["reason"].alias("reason"))
    asked = expected.select(*KEYS).distinct().withColumn("expected", F.lit(True))
    j = asked.join(came, list(KEYS), "full")
    n, bad = F.coalesce("replies", F.lit(0)), F.coalesce("failed", F.lit(0))
    status = F.when(n == 0, "absent").when(n == bad, "failed").otherwise("read")
    return j.select(*KEYS, F.coalesce("expected", F.lit(False)).alias("expected"), status.alias("status"), n.alias("replies"),
                    bad.alias("failed"), F.coalesce("files", F.lit(0)).alias("files"),
                    F.when(status == "failed", F.col("reason")).alias("reason"))


def by_file(loaded: DataFrame) -> DataFrame:
    """One row per file: lines, lines that can't be read, lines without a key, and when it landed."""
    return loaded.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("reason").alias("failed"),
                                      F.count_if(F.col("reason") == "no key").alias("without_key"), F.max("landed_at").alias("landed_at"))


def readable(loaded: DataFrame) -> DataFrame:
    """(site_id, date, body) of the readable reply that landed last for each day: the input of ``flatten_hourly``.
    Replies of one moment are told apart by file name, then by text."""
    latest = F.max(F.struct("landed_at", "file", "body"))["body"].alias("body")
    return loaded.filter(F.col("reason").isNull()).groupBy(*KEYS).agg(latest)
