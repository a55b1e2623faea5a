"""Tabular statistics.

Rules followed throughout: one wide aggregation per operator (all columns at
once, combined map-side), small results re-joined by broadcast of a table whose
size is bounded by construction (classes, bins, columns), and windows only over
already-aggregated, bounded tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric_columns
from ..session import cut_lineage
from .quantiles import exact_quantiles
from .scan import small


def _pct_approx(c: str, qs) -> Column:
    return F.percentile_approx(F.col(c), list(qs), 100000).cast("array<double>")


def _quantile_table(df: DataFrame, cols, probs, by=(), approx: bool = False) -> DataFrame:
    """(*by, column_name, q_<p>...) with exact (distributed) or sketch quantiles.
    The result has one row per group and column: bounded, joined back by key."""
    names = {p: "q" + str(p).replace(".", "_") for p in probs}
    if approx:
        parts = [F.struct(F.lit(c).alias("column_name"), _pct_approx(c, probs).alias("qs")) for c in cols]
        long = df.groupBy(*by).agg(F.array(*parts).alias("_a")) if by else df.agg(F.array(*parts).alias("_a"))
        long = long.select(*by, F.explode("_a").alias("_x")).select(*by, "_x.column_name", "_x.qs")
        return long.select(*by, "column_name", *[F.col("qs")[i].alias(names[p]) for i, p in enumerate(probs)])
    q = exact_quantiles(df, cols, probs, by)
    return q.groupBy(*by, "column_name").agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(names[p]) for p in probs])


# --------------------------------------------------------------------------- A2, A16, A17

def describe(df: DataFrame, cols=None, digits: int | None = 2, approx: bool = False) -> DataFrame:
    """A2: count, mean, sample std, min, 25/50/75 % (linear interpolation), max.
    Exact quantiles (``df.summary`` is approximate); ``approx=True`` for a sketch."""
    cols = list(cols) if cols is not None else numeric_columns(df)

    def r(e: Column) -> Column:
        e = e.cast("double")
        return F.round(e, digits) if digits is not None else e

    parts = [F.struct(F.count(c).alias("count"), r(F.avg(c)).alias("mean"), r(F.stddev_samp(c)).alias("std"),
                      r(F.min(c)).alias("min"), r(F.max(c)).alias("max")).alias(c) for c in cols]
    base = df.agg(*parts).unpivot([], cols, "column_name", "s").select("column_name", "s.*")
    q = _quantile_table(df, cols, [0.25, 0.5, 0.75], approx=approx)  # one row per column
    out = base.join(q, ["column_name"], "left")
    return out.select("column_name", "count", "mean", "std", "min", r(F.col("q0_25")).alias("p25"),
                      r(F.col("q0_5")).alias("p50"), r(F.col("q0_75")).alias("p75"), "max")


def column_stats(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Mean, median, sample and population std per column (long table)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    parts = [F.struct(F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std_samp"),
                      F.stddev_pop(c).alias("std_pop")).alias(c) for c in cols]
    base = df.agg(*parts).unpivot([], cols, "column_name", "s").select("column_name", "s.*")
    med = _quantile_table(df, cols, [0.5], approx=approx).select("column_name", F.col("q0_5").alias("median"))
    return base.join(med, ["column_name"], "left").select("column_name", "mean", "median", "std_samp", "std_pop")


def date_extent(df: DataFrame, date_col: str = "date", by=()) -> DataFrame:
    """First and last date (optionally per group)."""
    aggs = [F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
            F.count(F.lit(1)).alias("n_rows")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# --------------------------------------------------------------------------- A4, A14, A6

def class_balance(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    """A4: count and share per class. The window runs over the aggregated
    table (one row per class), never over raw rows."""
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("share", F.col("n").cast("double") / total)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Value counts with shares (for pie/bar charts)."""
    return class_balance(df, col)


def seasonal(df: DataFrame, date_col: str = "date", target: str = fixed.TARGET) -> DataFrame:
    """Per month, fire days, observed days (NULL targets not counted) and rate %."""
    return df.groupBy(F.month(date_col).alias("month")).agg(
        F.sum(F.col(target)).cast("long").alias("fires"),
        F.count(F.col(target)).alias("days"),
    ).withColumn("rate", F.lit(100.0).cast("double") * F.col("fires") / F.col("days"))


# --------------------------------------------------------------------------- A7, A8

def gram(df: DataFrame, cols) -> DataFrame:
    """(i, j, n, s, q, p) for each pair of columns over the rows where both are set: their number, and the sums of
    column i, of its square and of the products, each column taken from its mean (so that no digits cancel).

    Every batch gives four matrix products of its values and their masks, whatever the number of columns; tasks add
    them up, and k * k rows a task are shuffled."""
    cols = list(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(cols), len(cols)))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - shift if b.num_rows else np.zeros((0, len(cols)))
            there = ~np.isnan(x)
            x, mask = np.where(there, x, 0.0), there.astype(np.float64)
            total += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        at = np.indices(total.shape[1:]).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*at, total[0].reshape(-1).astype(np.int64), *total[1:].reshape(3, -1))], names=["i", "j", "n", "s", "q", "p"])

    part = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "i long, j long, n long, s double, q double, p double")
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p")])


def _correlations(df: DataFrame, cols) -> DataFrame:
    """(col_a, col_b, corr), pairwise complete; constant on the common rows: NULL."""
    g = cut_lineage(gram(df, cols))  # k * k rows
    other = g.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s_j"), F.col("q").alias("q_j"))
    spread = lambda q, s: F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    a, b = spread("q", "s"), spread("q_j", "s_j")
    varies = (a > 1e-12 * F.col("q")) & (b > 1e-12 * F.col("q_j"))  # what is left of a constant is rounding
    corr = F.when(varies, (F.col("p") - F.try_divide(F.col("s") * F.col("s_j"), F.col("n"))) / F.sqrt(a * b))
    names = F.array(*[F.lit(c) for c in cols])
    return g.join(other, ["i", "j"]).select(names[F.col("i").cast("int")].alias("col_a"), names[F.col("j").cast("int")].alias("col_b"), corr.alias("corr"))


def corr_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Full correlation matrix as (col_a, col_b, corr), pairwise complete, from one masked Gram matrix."""
    return _correlations(df, list(cols) if cols is not None else numeric_columns(df))


def corr_target(df: DataFrame, target: str = fixed.TARGET, cols=None) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target])
    found = _correlations(df, [*cols, target]).filter((F.col("col_b") == target) & (F.col("col_a") != target))
    return found.select(F.col("col_a").alias("column_name"), "corr").orderBy(F.desc_nulls_last("corr"), "column_name")


# --------------------------------------------------------------------------- A9, A10

def hist_density(df: DataFrame, col: str, by: str = fixed.TARGET, bins: int = 30) -> DataFrame:
    """Density histogram per class, edges from that class's own min/max, last
    bin closed. Every bin is listed (empty ones with 0)."""
    stats = df.filter(F.col(col).isNotNull()).groupBy(by).agg(
        F.min(col).alias("_mn"), F.max(col).alias("_mx"), F.count(col).alias("_n"))
    lo = F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5)
    hi = F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5)
    stats = stats.select(by, lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi"), "_n") \
                 .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    # a NULL class is a class of its own, so the joins are null-safe; the rows aren't shuffled by class
    stats = cut_lineage(stats)
    own = small(stats.withColumnRenamed(by, "_by"))
    binned = df.filter(F.col(col).isNotNull()).join(own, F.col(by).eqNullSafe(F.col("_by"))).select(
        by, F.least(F.floor((F.col(col) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(by, "_lo", "_w", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    counts = counts.select(F.col(by).alias("_by"), F.col("bin").alias("_bin"), "count")
    out = grid.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bin") == F.col("_bin")), "left") \
        .fillna(0, ["count"])
    return out.select(
        by, "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
        F.col("count"),
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def box_stats(df: DataFrame, col: str, by: str = fixed.TARGET, whisker: float = 1.5,
              approx: bool = False) -> DataFrame:
    """A10: quartiles, IQR, whiskers (furthest values inside q +- 1.5 IQR) and
    the outlier count per group; a NULL group is a group of its own."""
    q = _quantile_table(df, [col], [0.25, 0.5, 0.75], by=(by,), approx=approx)
    q = q.select(by, F.col("q0_25").alias("q1"), F.col("q0_5").alias("median"), F.col("q0_75").alias("q3")) \
         .withColumn("iqr", F.col("q3") - F.col("q1"))
    q = small(cut_lineage(q))  # a row for each group, read twice; no shuffle of the rows by group: one may be most of them
    lo_f = F.col("q1") - whisker * F.col("iqr")
    hi_f = F.col("q3") + whisker * F.col("iqr")
    x = F.col(col)
    inside = x.between(lo_f, hi_f)
    own = q.withColumnRenamed(by, "_by")
    agg = df.filter(x.isNotNull()).join(own, F.col(by).eqNullSafe(F.col("_by"))).groupBy("_by").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return agg.join(q, F.col(by).eqNullSafe(F.col("_by"))).select(*q.columns, *agg.columns).drop("_by")


# --------------------------------------------------------------------------- V9, A13, A15

def series_long(df: DataFrame, value_cols, date_col: str = "date", target: str = fixed.TARGET,
                ids=("site_id",)) -> DataFrame:
    """V9: long table (ids, date, variable, value, is_fire) for time-series charts."""
    keep = [*ids, date_col, target]
    long = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in value_cols]) \
             .unpivot(keep, list(value_cols), "variable", "value")
    return long.withColumn("is_fire", F.col(target) == 1).drop(target)


def risk_bands(df: DataFrame, level_col: str | None = "risk_level", code_col: str | None = None) -> DataFrame:
    """Counts and shares of high / medium / low risk.

    On P8 levels (default): high = alto + critico, medium = medio, low = bajo.
    On a numeric class code (``code_col``, the dashboard form): high = code >= 3,
    medium = code == 2, low = code <= 1."""
    n = F.count(F.lit(1))
    if code_col is not None:
        c = F.col(code_col)
        high, medium, low = c >= 3, c == 2, c <= 1
    else:
        lv = F.lower(F.col(level_col))
        high, medium, low = lv.isin("alto", "critico"), lv == "medio", lv == "bajo"
    out = df.agg(n.alias("total"), F.count_if(high).alias("high"), F.count_if(medium).alias("medium"),
                 F.count_if(low).alias("low"))
    return out.withColumns({
        f"{b}_pct": F.try_divide(F.col(b) * F.lit(100.0).cast("double"), F.col("total").cast("double"))
        for b in ("high", "medium", "low")})


def monitor_stats(df: DataFrame, station: str = "station_id", ts: str = "ts",
                  alert: str = "alert", means=("temperatura", "humedad", "velocidad_viento"),
                  tie: str = "event_id", history: int = fixed.MONITOR_HISTORY) -> DataFrame:
    """A15 per station: readings, alerts, alert rate (0 when no readings), means
    over the last ``history`` readings (equal times: the larger ``tie`` is later), uptime seconds (last - first reading).

    Skew-safe: the counts are a plain aggregation (combined map-side), and the
    last-N means use ``row_number() <= N`` as a filter, which Spark turns into a
    per-task group limit before the shuffle, so a hot station ships at most N
    rows per map task."""
    totals = df.groupBy(station).agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.count_if(F.col(alert)).alias("total_alerts"),
        ((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp")))
         / 1e6).alias("uptime_seconds"),
    )
    w = Window.partitionBy(station).orderBy(F.col(ts).desc(), F.col(tie).desc())
    recent = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= history) \
               .groupBy(station).agg(*[F.avg(F.col(m)).alias(f"avg_{m}") for m in means])
    return totals.join(recent, [station], "left").withColumn("alert_rate", F.coalesce(
        F.try_divide(F.col("total_alerts").cast("double"), F.col("total_readings").cast("double")), F.lit(0.0)))
