"""FX9 micro-case and brute-force properties of the two-level sweep."""

import math
import random

import pytest

from embercast.operators import curves


def _df(spark, ys, ps):
    return spark.createDataFrame([(i, y, p, int(p >= 0.5)) for i, (y, p) in enumerate(zip(ys, ps))],
                                 "id int, y int, prob double, pred int")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def brute_curve(ys, ps):
    """One-task sweep: per distinct score (desc): tps, fps."""
    scores = sorted(set(ps), reverse=True)
    out, tp, fp = [], 0, 0
    for s in scores:
        tp += sum(1 for y, p in zip(ys, ps) if p == s and y == 1)
        fp += sum(1 for y, p in zip(ys, ps) if p == s and y == 0)
        out.append((s, tp, fp))
    return out


def brute_ap(ys, ps):
    P = sum(ys)
    return sum((tp - ptp) / P * tp / (tp + fp) for (s, tp, fp), (_, ptp, _) in
               zip(brute_curve(ys, ps), [(None, 0, 0)] + brute_curve(ys, ps)[:-1]))


def test_fx9(spark):
    df = _df(spark, [1, 0, 1, 0], [0.9, 0.6, 0.6, 0.1])
    assert math.isclose(curves.roc_auc(df).first()[0], 0.875)
    assert math.isclose(curves.average_precision(df).first()[0], 0.5 * 1 + 0.5 * (2 / 3))


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_sweep_equals_brute_force(spark, partitions):
    rng = random.Random(partitions)
    ys = [rng.randint(0, 1) for _ in range(300)]
    ps = [round(rng.random(), 2) for _ in range(300)]  # heavy ties
    df = _df(spark, ys, ps)
    s = sorted(((r.score, r.tps, r.fps) for r in curves.score_sweep(df, partitions=partitions).collect()),
               key=lambda x: -x[0])
    assert s == brute_curve(ys, ps)
    assert math.isclose(curves.roc_auc(df, partitions=partitions).first()[0], brute_auc(ys, ps), rel_tol=1e-12)
    assert math.isclose(curves.average_precision(df, partitions=partitions).first()[0], brute_ap(ys, ps), rel_tol=1e-9)


def test_roc_drops_collinear_points(spark):
    # scores 0.9, 0.8, 0.7 are all positives: the middle point is collinear and dropped
    ys, ps = [1, 1, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5]
    pts = sorted(((r.threshold, r.fpr, r.tpr) for r in curves.roc_points(_df(spark, ys, ps), partitions=2).collect()),
                 key=lambda x: -x[0])
    assert pts == [(1.9, 0.0, 0.0), (0.9, 0.0, 1 / 3), (0.7, 0.0, 1.0), (0.5, 1.0, 1.0)]


def test_pr_points_go_down_to_the_lowest_score(spark):
    ys, ps = [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1]
    pts = sorted(((r.threshold, r.precision, r.recall) for r in curves.pr_points(_df(spark, ys, ps)).collect()),
                 key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert pts == [(0.9, 1.0, 0.5), (0.8, 0.5, 0.5), (0.7, 2 / 3, 1.0), (0.2, 0.5, 1.0), (0.1, 0.4, 1.0),
                   (None, 1.0, 0.0)]


def test_confusion_full_grid_and_metrics(spark):
    df = _df(spark, [1, 1, 1], [0.9, 0.8, 0.2])  # one class only
    grid = {(r.y_true, r.y_pred): r["count"] for r in curves.confusion(df).collect()}
    assert grid == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    m = {r.metric: r.value for r in curves.metrics(df).collect()}
    assert "roc_auc" not in m and math.isclose(m["accuracy"], 2 / 3)  # AUC only with both classes


def test_report_weighted_recall_is_accuracy(spark):
    rng = random.Random(5)
    ys = [rng.randint(0, 1) for _ in range(200)]
    ps = [rng.random() for _ in range(200)]
    rep = {r.label: r for r in curves.report(_df(spark, ys, ps)).collect()}
    assert math.isclose(rep["weighted avg"].recall, rep["accuracy"].f1)
    assert rep["accuracy"].support == 200
