"""Scaling (C5, C6) and PCA.

Scalers are fitted on one DataFrame (the training part) into a one-row
statistics table; its row comes to the driver and goes into the plan as
literals, so the fit never sees test rows (no leak) and apply is a map-only projection.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def fit_standard(df: DataFrame, cols, ddof: int = 0) -> DataFrame:
    """C5 fit: one row with mean and std (population by default, like the
    modelled scaler) per column."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[sd(c).alias(f"_s_{c}") for c in cols])


def apply_standard(df: DataFrame, stats: DataFrame, cols) -> DataFrame:
    """C5 apply: (x - mean) / std; a zero-variance column divides by 1."""
    st = scalars(stats)
    new = {c: (F.col(c) - st[f"_m_{c}"]) / F.when(st[f"_s_{c}"] == 0, F.lit(1.0)).otherwise(st[f"_s_{c}"])
           for c in cols}
    return df.withColumns(new)


def standard_scale(df: DataFrame, cols, fit_on: DataFrame | None = None, ddof: int = 0) -> DataFrame:
    return apply_standard(df, fit_standard(fit_on if fit_on is not None else df, cols, ddof), cols)


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    return df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])


def apply_minmax(df: DataFrame, stats: DataFrame, cols) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0 (not Spark ML's 0.5)."""
    st = scalars(stats)
    new = {c: F.coalesce(F.try_divide(F.col(c) - st[f"_lo_{c}"], st[f"_hi_{c}"] - st[f"_lo_{c}"]),
                         F.when(F.col(c).isNotNull(), F.lit(0.0)))
           for c in cols}
    return df.withColumns(new)


def minmax_scale(df: DataFrame, cols, fit_on: DataFrame | None = None) -> DataFrame:
    return apply_minmax(df, fit_minmax(fit_on if fit_on is not None else df, cols), cols)


# --------------------------------------------------------------------------- C7, C8

def fit_pca(df: DataFrame, cols, n_components=0.95):
    """C7 fit: centre (Spark's PCA does not), fit all components, then keep
    ``k`` = the int given, or the smallest k whose cumulative explained
    variance ratio exceeds the float given. The covariance is a distributed
    tree aggregate of a d x d matrix. A row with a NULL or NaN in ``cols`` is an
    error, not a lost row: fill or filter first. Returns (model, k, ratios, signs)."""
    cols = list(cols)
    d = len(cols)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_pca_in", handleInvalid="error"),
        StandardScaler(inputCol="_pca_in", outputCol="_pca_c", withMean=True, withStd=False),
        PCA(k=d, inputCol="_pca_c", outputCol="_pca_out"),
    ])
    model = pipe.fit(df)
    pca = model.stages[-1]
    ratios = [float(x) for x in pca.explainedVariance.toArray()]
    if isinstance(n_components, int):
        k = n_components
    else:
        acc, k = 0.0, d
        for i, r in enumerate(ratios):
            acc += r
            if acc > n_components:
                k = i + 1
                break
    # deterministic signs: the largest-magnitude loading of each component is positive
    pc = pca.pc.toArray()
    signs = []
    for j in range(d):
        col = pc[:, j]
        i = max(range(d), key=lambda r: abs(col[r]))
        signs.append(1.0 if col[i] >= 0 else -1.0)
    return model, k, ratios, signs


def pca_project(df: DataFrame, cols, n_components=0.95, keep=()) -> DataFrame:
    """``PC1..PCk`` plus the ``keep`` columns (e.g. target, keys)."""
    model, k, _, signs = fit_pca(df, cols, n_components)
    out = model.transform(df).withColumn("_arr", vector_to_array("_pca_out"))
    return out.select(*keep, *[(F.col("_arr")[i] * signs[i]).alias(f"PC{i + 1}") for i in range(k)])


def pca_variance(df: DataFrame, cols) -> DataFrame:
    """(component, explained_variance_ratio, cumulative) per component.
    The table has one row per input column (bounded), built from the fit."""
    _, _, ratios, _ = fit_pca(df, cols, len(list(cols)))
    spark = df.sparkSession
    t = spark.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)],
                              "component int, explained_variance_ratio double")
    return t.withColumn("cumulative", F.sum("explained_variance_ratio").over(
        Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
