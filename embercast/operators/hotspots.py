"""Hot-spot operators: study-box filter (P1), daily aggregate (A1), site
assignment (J5) and the weather/fire join (J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed


def filter_bbox(df: DataFrame, west=fixed.BBOX_WEST, south=fixed.BBOX_SOUTH, east=fixed.BBOX_EAST,
                north=fixed.BBOX_NORTH, min_confidence=fixed.MIN_CONFIDENCE, date=None,
                date_col: str = "acq_date") -> DataFrame:
    """Inclusive box AND confidence >= floor [AND acq_date = date].
    Plain comparisons, so Parquet sources get them as pushed filters."""
    cond = (F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
            & (F.col("confidence") >= min_confidence))
    if date is not None:
        cond = cond & (F.col(date_col) == F.to_date(F.lit(date)))
    return df.filter(cond)


def daily_hotspots(df: DataFrame, keys=("site_id", "acq_date"), date_alias: str = "date") -> DataFrame:
    """A1: per (site, day): fire_count, Incendio = 1, mean brightness, mean frp,
    max confidence. Days without detections come from the join (J1)."""
    keys = list(keys)
    group = [F.col(k).alias(date_alias) if k == "acq_date" else F.col(k) for k in keys]
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("fire_count"),
        F.lit(1).alias("Incendio"),
        F.avg("brightness").alias("avg_brightness"),
        F.avg("frp").alias("avg_frp"),
        F.max("confidence").alias("max_confidence"),
    )


def assign_sites(points: DataFrame, boxes: DataFrame, cell: float = 0.1,
                 lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Every (point, site) pair whose inclusive box contains the point.

    A range predicate alone would be a nested-loop join. Boxes are exploded into
    the grid cells they touch, points get their cell, and the join is an
    equi-join on the cell key with the ``between`` test as a residual. Cells are
    ``cell`` degrees wide, or ten, a hundred, a thousand times that: each box
    takes the finest level at which it touches at most some 20 x 20 cells, so
    a world-wide box costs no more rows than a small one. Catalyst / AQE
    broadcast the box side only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a shuffle join,
    with AQE splitting a hot cell.
    """
    span = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.lit(3)
    for k in (2, 1, 0):
        level = F.when(span <= 20 * float(cell) * 10 ** k, k).otherwise(level)
    leveled = boxes.withColumn("_level", level)
    used = sorted(r["_level"] for r in leveled.select("_level").distinct().collect())  # four values at most
    width = F.lit(float(cell)) * F.pow(F.lit(10.0), F.col("_level"))
    box_cells = leveled.select(
        "*",
        F.explode(F.sequence(F.floor(F.col("south") / width), F.floor(F.col("north") / width))).alias("_cy"),
    ).select(
        "*",
        F.explode(F.sequence(F.floor(F.col("west") / width), F.floor(F.col("east") / width))).alias("_cx"),
    )
    pts = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    pts = pts.withColumns({"_cy": F.floor(F.col(lat) / width), "_cx": F.floor(F.col(lon) / width)})
    j = pts.join(box_cells, ["_level", "_cy", "_cx"], "inner").filter(
        F.col(lat).between(F.col("south"), F.col("north"))
        & F.col(lon).between(F.col("west"), F.col("east")))
    return j.drop("_level", "_cy", "_cx", "south", "north", "west", "east")


def join_weather_fires(weather: DataFrame, fires: DataFrame, keys=("site_id", "date"),
                       ingested_days: DataFrame | None = None) -> DataFrame:
    """Weather LEFT JOIN daily fires on (site, day).

    ``fire_count`` and ``Incendio`` become 0 on days whose hot-spot feed was
    ingested (``ingested_days``: one row per date); on other days they stay
    NULL (unknown, not "no fire"). Without ``ingested_days`` every day counts as
    ingested. The averages stay NULL on fire-free days.
    """
    keys = list(keys)
    j = weather.join(fires, keys, "left")
    if ingested_days is None:
        known = F.lit(True)
    else:
        j = j.join(ingested_days.select(F.col("date"), F.lit(True).alias("_ingested")).distinct(), ["date"], "left")
        known = F.coalesce(F.col("_ingested"), F.lit(False))
    j = j.withColumns({
        "fire_count": F.when(F.col("fire_count").isNotNull(), F.col("fire_count"))
                       .when(known, F.lit(0).cast("long")),
        "Incendio": F.when(F.col("Incendio").isNotNull(), F.col("Incendio")).when(known, F.lit(0)),
    })
    return j.drop("_ingested") if ingested_days is not None else j


def complete_calendar(df: DataFrame, partition=("site_id",), date_col: str = "date",
                      start=None, end=None) -> DataFrame:
    """One row per site and calendar day (inclusive range) LEFT JOIN the
    landed days, with ``is_missing_day``. Without start/end each site spans its
    own first..last day. A site's calendar is bounded by the date span."""
    part = list(partition)
    if start is not None and end is not None:
        span = df.select(*part).distinct().withColumns({
            "_lo": F.to_date(F.lit(str(start))), "_hi": F.to_date(F.lit(str(end)))})
    else:
        span = df.groupBy(*part).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    cal = span.select(*part, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date_col))
    landed = df.withColumn("_landed", F.lit(True))
    out = cal.join(landed, part + [date_col], "left")
    return out.withColumn("is_missing_day", F.col("_landed").isNull()).drop("_landed")


def append_days(*frames: DataFrame) -> DataFrame:
    """Append daily tables; columns matched by name, missing ones NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
