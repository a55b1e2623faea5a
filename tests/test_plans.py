"""Plan-shape checks: the physical plans keep the scale properties the design
relies on (no pair-producing joins, pushed-down filters, pre-shuffle limits)."""

import uuid

from pyspark.sql import functions as F

from embercast.operators import hotspots as hs
from embercast.operators import stats
from embercast.session import checkpoint_path

from .conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_join(spark):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    bad = {}
    for name in sorted(orc):
        if name.startswith("stream_"):
            continue  # streams run to completion while being built; their sinks are plain scans
        p = _plan(qs[name](spark, SF))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_bbox_filter_reaches_parquet_scan(spark):
    path = checkpoint_path(spark, "hot-" + uuid.uuid4().hex)
    spark.createDataFrame([(-17.3, -66.1, 85, 1.0)], "latitude double, longitude double, confidence int, frp double") \
         .write.parquet(path)
    p = _plan(hs.filter_bbox(spark.read.parquet(path)))
    pushed = p[p.index("PushedFilters"):].split("]")[0]
    assert "latitude" in pushed and "longitude" in pushed and "confidence" in pushed


def test_last_n_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("station_id"), F.col("id").alias("event_id"), F.col("id").cast("timestamp").alias("ts"),
                                  (F.col("id") % 2 == 0).alias("alert"), F.col("id").cast("double").alias("temperatura"),
                                  F.lit(1.0).alias("humedad"), F.lit(2.0).alias("velocidad_viento"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(stats.monitor_stats(df))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_column_pruning_on_adapter_scan(spark):
    from embercast.sources import testdata as td
    p = _plan(td.obs_daily(spark, SF).select("date", "incendio"))
    schema = p[p.index("ReadSchema"):].split("\n")[0]
    assert "l_quantity" not in schema and "l_orderkey" in schema


def test_dedup_combines_before_shuffle(spark):
    """A hot key is reduced inside every map task: a partial aggregate sits
    below the exchange, so the shuffle carries one row per key and task."""
    from embercast.operators import clean
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("site_id"),
                                  F.lit(1).alias("date"), F.col("id").alias("ingest_seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(clean.dedup_first(df, ("site_id", "date"), "ingest_seq"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    below = p[p.index("Exchange"):]
    assert "partial_min" in below
    out = clean.dedup_first(df, ("site_id", "date"), "ingest_seq").filter("site_id = 0").first()
    assert out.ingest_seq == 0


def test_cluster_conf_sizes_partitions():
    from embercast.session import cluster_conf
    c = cluster_conf(100 * (1 << 40))  # 100 TiB
    assert int(c["spark.sql.shuffle.partitions"]) == 409600 and c["spark.sql.adaptive.enabled"] == "true"
