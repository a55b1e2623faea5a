"""Cleaning operators: dedup, order, fill, outliers, null counts, target checks.

Column statistics (mean, std) are computed in ONE aggregation over all columns,
whose single row comes to the driver and goes into the plan as literals; no join
and no per-column passes. The fills hand values on between parts of a series
(``scan.nearest_values``), so a site may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric_columns, scalars
from .quantiles import exact_quantiles
from .scan import nearest_values, parts_for


# --------------------------------------------------------------------------- E1, O1

def dedup_first(df: DataFrame, keys=("site_id", "date"), order: str = "ingest_seq") -> DataFrame:
    """Keep the first record (lowest ``order``, NULL last) of each key; ties
    fall to the lowest of the other columns, so the result doesn't depend on
    the order of arrival.

    Expressed as an aggregation (``min`` of a struct of the row), not a
    window: the aggregation combines map-side, so a hot key that holds a third of
    all rows is reduced inside every map task before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.struct(F.col(order).isNull().alias("_null"), F.col(order).alias("_order"), *[F.col(c) for c in rest])
    packed = F.min(first).alias("_first")
    out = df.groupBy(*keys).agg(packed)
    return out.select(*[F.col(k) for k in keys], *[F.col("_first." + c).alias(c) for c in rest]) \
              .select(*df.columns)


def sort_chronological(df: DataFrame, date_col: str = "date", tie=("site_id",)) -> DataFrame:
    """O1: parse the date and sort ascending (distributed range sort; output only)."""
    out = df.withColumn(date_col, F.to_date(F.col(date_col)))
    return out.orderBy(F.col(date_col), *[F.col(t) for t in tie if t in df.columns])


# --------------------------------------------------------------------------- C1

def _medians(df: DataFrame, cols, approx: bool) -> dict:
    """Fit: the median of each column as a literal (one row per column comes
    back to the driver). Exact medians come from radix selection, so no task
    holds a whole column."""
    if approx:
        return scalars(df.agg(*[F.percentile_approx(F.col(c), 0.5, 100000).cast("double").alias(c) for c in cols]))
    got = {r.column_name: r.q for r in exact_quantiles(df, cols, [0.5]).collect()}
    return {c: F.lit(got.get(c)).cast("double") for c in cols}


def fill_three_stage(df: DataFrame, cols=None, partition=("site_id",), order: str = "date",
                     target: str = fixed.TARGET, approx_median: bool = False) -> DataFrame:
    """Forward fill, then backward fill within each series, then the column's
    global median. Numeric columns only; the target is never touched.

    The median fills a series that has no value at all, so it is only made for
    the columns that have such a series (one combined count tells). It is exact
    (``quantiles``); ``approx_median=True`` uses a bounded sketch instead.
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target, *partition])
    known = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols]) \
              .agg(F.sum("_rows").alias("_rows"), *[F.min(c).alias(c) for c in cols]).first()
    # a series of any length: no task holds a whole one; more parts as the table grows
    n = parts_for(known["_rows"] or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = nearest_values(df, cols, partition, [order], n)
    empty = [c for c in cols if known[c] == 0]
    med = _medians(df, empty, approx_median) if empty else {}
    filled = {
        c: F.coalesce(F.col(f"_prev_{c}"), F.col(f"_next_{c}"), *([med[c].cast(df.schema[c].dataType)] if c in med else []))
        for c in cols
    }
    return near.withColumns(filled).select(*df.columns)


# --------------------------------------------------------------------------- C2

def fill_simple(df: DataFrame, strategy: str = "mean", cols=None, approx_median: bool = False) -> DataFrame:
    """Fill every numeric column (target included) with its mean or median,
    or drop rows holding any NULL."""
    if strategy == "drop":
        return df.na.drop(how="any")
    if strategy not in ("mean", "median"):
        raise ValueError("unsupported strategy: " + strategy)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if strategy == "mean":
        st = scalars(df.agg(*[F.avg(c).alias(c) for c in cols]))
    else:
        st = _medians(df, cols, approx_median)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), st[c]) for c in cols})


# --------------------------------------------------------------------------- C3, C4, O3

def _zscore(c: str, mean: Column, std: Column) -> Column:
    return F.abs(F.try_divide(F.col(c) - mean, std))


def outlier_flags(df: DataFrame, threshold: float = fixed.OUTLIER_FLAG_THRESHOLD, cols=None,
                  target: str = fixed.TARGET, sparse: bool = False) -> DataFrame:
    """``<col>_is_outlier`` = |z| > threshold with the sample std; rows kept.

    The schema is fixed (one flag per column) unless ``sparse=True``, which keeps
    only flags with at least one hit, like the modelled system (one small job).
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=[target, "site_id"])
    st = scalars(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                        *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols]))
    flags = {f"{c}_is_outlier": F.coalesce(_zscore(c, st[f"_m_{c}"], st[f"_s_{c}"]) > F.lit(threshold),
                                           F.lit(False))
             for c in cols}
    out = df.withColumns(flags)
    if sparse:
        hits = out.agg(*[F.count_if(F.col(f)).alias(f) for f in flags]).first().asDict()
        out = out.drop(*[f for f, n in hits.items() if n == 0])
    return out


def outlier_remove(df: DataFrame, threshold: float = fixed.OUTLIER_REMOVE_THRESHOLD, cols=None,
                   target: str = fixed.TARGET, exclude_target: bool = True,
                   skip_constant: bool = False) -> DataFrame:
    """C4: keep rows whose every |z| < threshold, population std.

    Parity with the modelled system: a row with a NULL in a tested column is
    dropped, and a constant column (0/0) drops every row unless
    ``skip_constant``. ``exclude_target=False`` also z-scores the target.
    """
    exclude = ["site_id"] + ([target] if exclude_target else [])
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=exclude)
    st = scalars(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]))
    keep = F.lit(True)
    for c in cols:
        ok = F.coalesce(_zscore(c, st[f"_m_{c}"], st[f"_s_{c}"]) < F.lit(threshold), F.lit(False))
        if skip_constant:
            ok = ok | (st[f"_s_{c}"] == 0)
        keep = keep & ok
    return df.filter(keep)


def outlier_top(df: DataFrame, threshold: float = fixed.OUTLIER_FLAG_THRESHOLD, cols=None,
                target: str = fixed.TARGET, n: int = 5) -> DataFrame:
    """O3: the ``n`` columns with most flagged outliers (only columns with hits)."""
    flagged = outlier_flags(df, threshold, cols, target)
    fcols = [c for c in flagged.columns if c.endswith("_is_outlier")]
    counts = flagged.agg(*[F.count_if(F.col(f)).alias(f[: -len("_is_outlier")]) for f in fcols])
    names = [f[: -len("_is_outlier")] for f in fcols]
    long = counts.unpivot([], names, "column_name", "outliers")
    return long.filter(F.col("outliers") > 0) \
               .orderBy(F.desc("outliers"), F.asc("column_name")).limit(n)


# --------------------------------------------------------------------------- A3, A5

def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """A3: NULL count per column (long table) in one aggregation."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def target_summary(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    """A5 statistics in one aggregation: rows, invalid values, NULLs, class counts
    and shares (an absent class counts 0)."""
    t = F.col(target)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.count_if(t.isNotNull() & ~t.isin(0, 1)).alias("n_invalid"),
        F.count_if(t.isNull()).alias("n_null"),
        F.count_if(t == 0).alias("n_class0"),
        F.count_if(t == 1).alias("n_class1"),
    ).withColumns({
        "pct_class0": F.round(F.try_divide(F.col("n_class0") * 100.0, F.col("n_rows")).cast("double"), 4),
        "pct_class1": F.round(F.try_divide(F.col("n_class1") * 100.0, F.col("n_rows")).cast("double"), 4),
    })


def validate_target(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    """A5: raise unless the target holds only 0/1 and no NULL; returns ``df``."""
    s = target_summary(df, target).first()
    if s["n_invalid"]:
        raise ValueError(f"target {target} holds {s['n_invalid']} values outside {{0, 1}}")
    if s["n_null"]:
        raise ValueError(f"target {target} holds {s['n_null']} NULL values")
    return df


def of_class(df: DataFrame, value: int = 1, target: str = fixed.TARGET) -> DataFrame:
    """P5: the rows of one class (a comparison that reaches the scan); a row without a class belongs to none."""
    return df.filter(F.col(target) == F.lit(value))
