"""Typed sources (S1-S5, S11): landed CSV / JSON files read with explicit schemas,
and the JSON-reply flatteners that turn weather replies into daily rows.

Readers never infer schemas (a full extra pass at scale) and turn NaN into NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..session import cut_lineage
from ..functions import nan_to_null

# Hourly reply; T2: daily reply (parallel arrays); T3: hot-spot row.
HOURLY_REPLY = T.StructType([T.StructField("hourly", T.StructType([
    T.StructField("variables", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ])))]))])

DAILY_REPLY = T.StructType([T.StructField("daily", T.StructType(
    [T.StructField("time", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in fixed.DAILY_RENAME]))])

HOTSPOT = T.StructType([
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("acq_date", T.DateType()), T.StructField("confidence", T.IntegerType()),
    T.StructField("brightness", T.DoubleType()), T.StructField("frp", T.DoubleType()),
])


# --------------------------------------------------------------------------- S1, S5

CORRUPT = "_corrupt_record"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core, as the path is given to the reader; by default each has a task of its own
    (up to 10,000), which costs more than to list it."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """CSV with header and a declared schema -> (rows, rejects). Empty fields
    are NULL; a line with a field that its type can't hold, or with too many or
    too few fields, goes to the rejects whole, as text in ``line``."""
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    with few_listing_tasks(spark):
        raw = spark.read.schema(kept).option("header", True).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    rows = nan_to_null(raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT))
    rejects = raw.filter(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "line")  # beside the fields that did parse
    return rows, rejects


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S1 without a rejects frame: a malformed line is an error, never a silent NULL."""
    with few_listing_tasks(spark):
        return nan_to_null(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path))


def read_hotspots_csv(spark: SparkSession, path: str) -> DataFrame:
    """Hot-spot CSV files (one per day or one per country dump)."""
    return read_csv(spark, path, HOTSPOT)


# --------------------------------------------------------------------------- S2

def flatten_hourly(df: DataFrame, body: str = "body", keys=("site_id", "date"),
                   variables=None) -> DataFrame:
    """One hourly reply per (site, day) -> per variable mean, max, min and
    sample std. ``variables`` fixes the output schema (pivot with known values,
    so no extra pass to discover them). NULL hourly values are skipped."""
    keys = list(keys)
    parsed = df.select(*keys, F.from_json(F.col(body), HOURLY_REPLY).alias("_r"))
    per_var = parsed.select(*keys, F.explode("_r.hourly.variables").alias("_v"))
    vals = per_var.select(*keys, F.col("_v.name").alias("_name"), F.explode("_v.values").alias("_x"))
    if variables is None:
        raise ValueError("pass the variable names: the output schema must not depend on the data")
    aggs = []
    for v in variables:
        x = F.when(F.col("_name") == v, F.col("_x"))
        aggs += [F.avg(x).alias(f"{v}_mean"), F.max(x).alias(f"{v}_max"),
                 F.min(x).alias(f"{v}_min"), F.stddev_samp(x).alias(f"{v}_std")]
    return vals.groupBy(*keys).agg(*aggs)


def read_hourly_json(spark: SparkSession, path: str, variables, keys=("site_id", "date")) -> DataFrame:
    """S2 over landed JSON-lines files holding ``site_id``, ``date`` and the reply."""
    raw = spark.read.text(path)
    key_schema = T.StructType([T.StructField("site_id", T.IntegerType()), T.StructField("date", T.DateType())])
    k = raw.select(F.from_json("value", key_schema).alias("_k"), F.col("value").alias("body"))
    return flatten_hourly(k.select("_k.*", "body"), "body", keys, variables)


# --------------------------------------------------------------------------- S3

def flatten_daily(df: DataFrame, body: str = "body", keys=("site_id",), rename=None) -> DataFrame:
    """S3: daily reply of parallel arrays -> one row per day, columns renamed.
    Every day of the reply is kept (not only the first element)."""
    rename = rename or fixed.DAILY_RENAME
    parsed = df.select(*keys, F.from_json(F.col(body), DAILY_REPLY).alias("_r"))
    zipped = F.arrays_zip(F.col("_r.daily.time").alias("time"),
                          *[F.col(f"_r.daily.{n}").alias(n) for n in rename])
    rows = parsed.select(*keys, F.inline(zipped))
    return rows.select(*keys, F.to_date("time").alias("date"),
                       *[F.col(src).alias(dst) for src, dst in rename.items()])


# --------------------------------------------------------------------------- S11

def route_requests(df: DataFrame, body: str = "body", request_id: str = "request_id", features=None) -> DataFrame:
    """S11 in one scan: ``{"data": [[numbers], ...]}`` or ``{"data": [{name: value}, ...]}``.

    One row for each row that a request sent (or one for a request without
    rows): (request_id, row_idx, values, reason). ``reason`` is NULL and
    ``values`` holds the features in order when the row is accepted; else
    ``reason`` says why not, so accepted and rejected rows add up to those sent.
    Positional and named rows may be mixed in a request. A number in quotes
    counts as a number; names beyond the features are ignored."""
    features = list(features or fixed.SCORING_FEATURES)
    n = len(features)
    rows = df.select(F.col(request_id), F.get_json_object(F.col(body), "$.data").isNull().alias("_no_data"),
                     F.from_json(F.col(body), "data array<string>")["data"].alias("_data"))
    rows = rows.select(request_id, "_no_data", F.size("_data").alias("_size"), F.posexplode_outer("_data").alias("row_idx", "_row"))
    text = F.ltrim(F.col("_row"))
    kind = F.when(text.startswith("["), "list").when(text.startswith("{"), "names")
    listed, named = F.from_json("_row", "array<string>"), F.from_json("_row", "map<string,string>")
    names = F.array(*[F.lit(f) for f in features])
    parsed = rows.withColumn("_kind", kind).withColumn("_list", F.when(F.col("_kind") == "list", listed)) \
        .withColumn("_names", F.when(F.col("_kind") == "names", named))
    have = F.forall(names, lambda k: F.map_contains_key(F.col("_names"), k))
    texts = F.when(F.col("_kind") == "list", F.col("_list")) \
        .when(F.col("_kind") == "names", F.transform(names, lambda k: F.try_element_at(F.col("_names"), k)))
    parsed = parsed.withColumn("_texts", texts).withColumn(
        "values", F.transform("_texts", lambda x: x.try_cast("double")))
    reason = (
        F.when(F.col("_no_data"), "missing data")
        .when(F.col("_size").isNull() | (F.col("_size") < 0), "data is not a list")
        .when(F.col("_size") == 0, "empty data")
        .when(F.col("_row").isNull(), "row is null")
        .when(F.col("_kind").isNull(), "row is not a list or an object")
        .when((F.col("_kind") == "list") & F.coalesce(F.size("_list") != n, F.lit(True)),
              F.format_string("expected %d values, got %d", F.lit(n), F.coalesce(F.size("_list"), F.lit(0))))
        .when((F.col("_kind") == "names") & ~F.coalesce(have, F.lit(False)), "missing columns")
        .when(F.exists("_texts", lambda x: x.isNull()), "null value")
        .when(F.exists("values", lambda x: x.isNull() | F.isnan(x)), "value is not a number"))
    return parsed.withColumn("reason", reason).select(
        request_id, "row_idx", F.when(F.col("reason").isNull(), F.col("values")).alias("values"), "reason")


def parse_score_requests(df: DataFrame, body: str = "body", request_id: str = "request_id",
                         features=None) -> tuple[DataFrame, DataFrame]:
    """S11 as two frames: accepted rows (request_id, row_idx, features...) and the
    quarantine (request_id, row_idx, reason). Both come from ``route_requests``, whose rows are parsed and checkpointed once."""
    features = list(features or fixed.SCORING_FEATURES)
    routed = cut_lineage(route_requests(df, body, request_id, features))
    rows = routed.filter(F.col("reason").isNull()).select(
        request_id, "row_idx", *[F.col("values")[i].alias(f) for i, f in enumerate(features)])
    return rows, routed.filter(F.col("reason").isNotNull()).select(request_id, "row_idx", "reason")


def require_columns(df: DataFrame, features=None) -> DataFrame:
    """Error naming the missing columns (sorted); extras ignored; reorder."""
    features = list(features or fixed.SCORING_FEATURES)
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[c for c in df.columns if c not in features], *features)


def missing_columns(df: DataFrame, body: str = "body", request_id: str = "request_id", features=None) -> DataFrame:
    """P2/O5 by row: (request_id, row_idx, missing, extra) of every object in a request's ``data`` list: the required
    columns that it lacks and the ones that are ignored, both sorted. Rows that aren't objects, and bodies without
    such a list, have none (``route_requests`` names their reason)."""
    features = sorted(features or fixed.SCORING_FEATURES)
    data = F.from_json(F.get_json_object(body, "$.data"), "array<string>")
    rows = df.select(request_id, F.posexplode(data).alias("row_idx", "_row"))
    keys = F.json_object_keys("_row")
    needed = F.array(*[F.lit(f) for f in features])
    return rows.filter(F.col("_row").startswith("{") & keys.isNotNull()).select(
        request_id, "row_idx", F.array_except(needed, keys).alias("missing"), F.sort_array(F.array_except(keys, needed)).alias("extra"))
