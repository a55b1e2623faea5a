"""Exact classification evaluation: confusion (A11), metrics (V1, V2), report
(V3), ROC points and AUC (V4, V5), PR points, average precision and trapezoid
PR-AUC (V6-V8).

The threshold sweep needs cumulative positive/negative counts in descending
score order. It aggregates per distinct score (combined map-side; ties stay
together) and takes running sums over them by ``scan.running_sums``, so no task
holds a whole group's scores. All sums are exact integers, so the curves equal a
one-task sweep exactly.

Every function takes ``by``: group columns (model, fold, ...) whose curves are
all made in the same pass; a NULL group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_sums


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# --------------------------------------------------------------------------- sweep

def score_sweep(df: DataFrame, y: str = "y", score: str = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """One row per distinct score of each group with ``pos, neg`` (rows at this
    score), ``tps, fps`` (rows with score >= it), ``next_pos, next_neg`` (counts
    at the next lower score, NULL for the last), ``P, N`` (class totals) and
    ``is_first`` (highest score). Rows without a score or a label are left out."""
    g = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    s = running_sums(g.withColumn("_falling", -F.col("score")), {"tps": "pos", "fps": "neg"}, by, ["_falling"],
                     {"P": "pos", "N": "neg"}, {"next_pos": "pos", "next_neg": "neg"}, partitions)
    return s.drop("_falling").withColumn("is_first", (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg")))


# --------------------------------------------------------------------------- V4, V5

def roc_points(df: DataFrame, y: str = "y", score: str = "prob", drop_intermediate: bool = True, by=(), partitions: int | None = None) -> DataFrame:
    """V4: (threshold, fpr, tpr). First point (0, 0) at max score + 1; with
    ``drop_intermediate`` a point is kept when the counts at it differ from
    the counts at the next lower score (= non-zero second difference), and the
    first and last points are always kept."""
    s = score_sweep(df, y, score, by, partitions)
    keep = F.lit(True) if not drop_intermediate else (
        F.col("is_first") | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    pts = s.filter(keep).select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(_d("fps"), _d("N")).alias("fpr"),
        F.try_divide(_d("tps"), _d("P")).alias("tpr"))
    start = s.filter("is_first").select(*by, (F.col("score") + 1).alias("threshold"),
                                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def _auc_value() -> Column:
    return F.try_divide(F.sum(_d("neg") * (_d("tps") - _d("pos") / 2)), F.first(_d("P")) * F.first(_d("N")))


def roc_auc(df: DataFrame, y: str = "y", score: str = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """V5: exact area, ties counted 1/2: sum(neg_i * (tps_i - pos_i / 2)) / (P * N).
    NULL unless both classes are present (V2)."""
    return score_sweep(df, y, score, by, partitions).groupBy(*by).agg(_auc_value().alias("roc_auc"))


# --------------------------------------------------------------------------- V6, V7, V8

def pr_points(df: DataFrame, y: str = "y", score: str = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """V6: (threshold, precision, recall) for every distinct score, down to the
    lowest (past full recall too), then the end point (NULL, 1, 0)."""
    s = score_sweep(df, y, score, by, partitions)
    pts = s.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(_d("tps"), _d("tps") + _d("fps")).alias("precision"),
        F.try_divide(_d("tps"), _d("P")).alias("recall"))
    end = s.filter("is_first").select(*by, F.lit(None).cast("double").alias("threshold"),
                                      F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _ap_value() -> Column:
    prec = F.try_divide(_d("tps"), _d("tps") + _d("fps"))
    return F.try_divide(F.sum(_d("pos") * prec), F.first(_d("P")))


def average_precision(df: DataFrame, y: str = "y", score: str = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """V7: sum over scores of (recall step) * precision = sum(pos_i * prec_i) / P."""
    return score_sweep(df, y, score, by, partitions).groupBy(*by).agg(_ap_value().alias("average_precision"))


def pr_auc_trapezoid(df: DataFrame, y: str = "y", score: str = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """V8: trapezoid area under the PR points (a different number from V7).
    The previous point of each score is its cumulative counts minus its own;
    before the first score it is the start point (recall 0, precision 1)."""
    s = score_sweep(df, y, score, by, partitions)
    tp0, fp0 = _d("tps") - _d("pos"), _d("fps") - _d("neg")
    prec = F.try_divide(_d("tps"), _d("tps") + _d("fps"))
    prev_prec = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    area = F.try_divide(_d("pos"), _d("P")) * (prec + prev_prec) / 2
    return s.filter(F.col("tps") - F.col("pos") < F.col("P")).groupBy(*by).agg(F.sum(area).alias("pr_auc"))


# --------------------------------------------------------------------------- A11, V1-V3

def _cells(df: DataFrame, y: str, pred: str, by) -> DataFrame:
    """The four counts of each group, in one aggregation."""
    cell = lambda t, p: F.count_if((F.col(y) == t) & (F.col(pred) == p))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp1"), cell(0, 1).alias("fp1"), cell(1, 0).alias("fn1"), cell(0, 0).alias("tn1"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", normalize: bool = False, by=()) -> DataFrame:
    """The full 2 x 2 grid (absent cells count 0); ``normalize`` adds the
    row share (per true class)."""
    rows = [(0, 0, "tn1", "fp1"), (0, 1, "fp1", "tn1"), (1, 0, "fn1", "tp1"), (1, 1, "tp1", "fn1")]
    out = _cells(df, y, pred, by).select(*by, F.inline(F.array(*[F.struct(
        F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(c).alias("count"),
        F.try_divide(_d(c), _d(c) + _d(other)).alias("share")) for t, p, c, other in rows])))
    return out if normalize else out.drop("share")


def _class_table(df: DataFrame, y: str, pred: str, by=()) -> DataFrame:
    """Per class: tp, fp, fn, support, plus total n (one aggregation)."""
    t = _cells(df, y, pred, by)
    total = F.col("tp1") + F.col("fp1") + F.col("fn1") + F.col("tn1")

    def own(label, tp, fp, fn):
        return F.struct(F.lit(label).alias("label"), F.col(tp).alias("tp"), F.col(fp).alias("fp"), F.col(fn).alias("fn"),
                        (F.col(tp) + F.col(fn)).alias("support"), total.alias("n"))

    c = t.select(*by, F.inline(F.array(own("0", "tn1", "fn1", "fp1"), own("1", "tp1", "fp1", "fn1"))))
    p = F.coalesce(F.try_divide(_d("tp"), _d("tp") + _d("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(_d("tp"), _d("tp") + _d("fn")), F.lit(0.0))
    return c.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), F.lit(0.0)))


def report(df: DataFrame, y: str = "y", pred: str = "pred", by=()) -> DataFrame:
    """V3: per class precision/recall/f1/support, then accuracy, macro avg and
    weighted avg rows (zero_division = 0)."""
    c = _class_table(df, y, pred, by)
    per = c.select(*by, "label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    agg = c.groupBy(*by).agg(
        F.sum("tp").alias("_ok"), F.first("n").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        F.sum(F.col("precision") * _d("support")).alias("_wp"), F.sum(F.col("recall") * _d("support")).alias("_wr"),
        F.sum(F.col("f1") * _d("support")).alias("_wf"))
    acc = F.coalesce(F.try_divide(_d("_ok"), _d("_n")), F.lit(0.0))
    none = F.lit(None).cast("double")

    def row(label, p, r, f):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), F.col("_n").alias("support"))

    rows = agg.select(*by, F.inline(F.array(
        row("accuracy", none, none, acc),
        row("macro avg", F.col("_mp"), F.col("_mr"), F.col("_mf")),
        row("weighted avg", F.try_divide(F.col("_wp"), _d("_n")), F.try_divide(F.col("_wr"), _d("_n")),
            F.try_divide(F.col("_wf"), _d("_n"))))))
    return per.unionByName(rows)


def metrics(df: DataFrame, y: str = "y", pred: str = "pred", score: str | None = "prob", by=(), partitions: int | None = None) -> DataFrame:
    """V1 + V2 as a long (metric, value) table: accuracy and weighted precision,
    recall, f1; roc_auc and average_precision only when both classes occur."""
    rep = report(df, y, pred, by)
    acc = rep.filter(F.col("label") == "accuracy").select(*by, F.lit("accuracy").alias("metric"),
                                                          F.col("f1").alias("value"))
    wavg = rep.filter(F.col("label") == "weighted avg").select(*by, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
        for m, c in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))])))
    base = acc.unionByName(wavg)
    if score is None:
        return base
    both = (F.first("P") > 0) & (F.first("N") > 0)
    extra = score_sweep(df, y, score, by, partitions).groupBy(*by).agg(F.array(
        F.struct(F.lit("roc_auc").alias("metric"), _auc_value().alias("value")),
        F.struct(F.lit("average_precision").alias("metric"), _ap_value().alias("value"))).alias("m"), both.alias("both"))
    return base.unionByName(extra.filter("both").select(*by, F.inline("m")))
