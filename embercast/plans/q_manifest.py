"""Landed files in two loads, with replies that are cut off, empty or never come."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..sources import files, manifest
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

HV = td.HOURLY_VARIABLES
_DOUBLES = [f"{v}_{s}" for v in HV for s in ("mean", "max", "min", "std")]
_RULES = """
came as (select site_id, date, (site_id + dayofyear(date)) % 13 = 0 as never,
    (site_id + dayofyear(date)) % 11 = 0 as cut, (site_id + dayofyear(date)) % 17 = 0 as bare
  from (select distinct site_id, date from hourly) h),
judged as (select *, not never and (cut or bare) as first_failed, not never and cut and site_id % 2 = 0 as again from came)"""


def _land(replies, folder):
    replies.select(F.to_json(F.struct("site_id", "date", "body")).alias("value")).write.mode("append").text(folder)


def _loaded(spark, d):
    """First every reply (some cut off, some without values, some missing), then whole ones for half of the cut ones."""
    base = checkpoint_path(spark, f"landed-{uuid.uuid4().hex}")
    k = F.col("site_id") + F.dayofyear("date")
    replies = td.hourly_json(spark, d).filter(k % 13 != 0)
    cut, bare = k % 11 == 0, k % 17 == 0
    half = F.expr("substring(body, 1, length(body) div 2)")
    _land(replies.withColumn("body", F.when(cut, half).when(bare, '{"hourly":{"variables":[]}}').otherwise(F.col("body"))), f"{base}/in")
    manifest.load_new(spark, f"{base}/in", f"{base}/out", f"{base}/ledger")
    _land(replies.filter(cut & (F.col("site_id") % 2 == 0)), f"{base}/in")
    manifest.load_new(spark, f"{base}/in", f"{base}/out", f"{base}/ledger")
    return spark.read.parquet(f"{base}/out")


def _manifest(spark, d):
    sites = td.hourly_readings(spark, d).groupBy("site_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return manifest.manifest(_loaded(spark, d), manifest.expected_days(sites)).drop("files")


register("landed_manifest", with_views("hourly", extra=_RULES + """,
days as (select site_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from came group by site_id)""") + """
select d.site_id, d.date, true as expected,
  case when j.site_id is null or never then 'absent' when first_failed and not again then 'failed' else 'read' end as status,
  cast(case when j.site_id is null or never then 0 when again then 2 else 1 end as bigint) as replies,
  cast(case when first_failed then 1 else 0 end as bigint) as failed,
  case when first_failed and not again then case when cut then 'reply is not JSON' else 'reply has no values' end end as reason
from days d left join judged j on d.site_id = j.site_id and d.date = j.date""")(_manifest)

_STATS = ", ".join(f"avg({v}) as {v}_mean, max({v}) as {v}_max, min({v}) as {v}_min, stddev_samp({v}) as {v}_std" for v in HV)
register("landed_stats", wrap(with_views("hourly", extra=_RULES) + f"""
select h.site_id, h.date, {_STATS} from hourly h join judged j on h.site_id = j.site_id and h.date = j.date
where not never and (not first_failed or again) group by h.site_id, h.date""", _DOUBLES))(
    lambda spark, d: rounded(files.flatten_hourly(manifest.readable(_loaded(spark, d)), variables=HV)))
