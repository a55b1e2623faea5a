"""Evaluation queries on ``scored`` (100 distinct scores, heavy ties):
A11, V1-V8. The oracle is a plain one-task sweep; ours is the two-level one."""

from __future__ import annotations

from ..operators import curves
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

SWEEP = """
g as (select prob as score, cast(sum(y) as bigint) as pos, cast(count(*) - sum(y) as bigint) as neg
      from scored where prob is not null group by 1),
c as (select score, pos, neg,
        cast(sum(pos) over w as double) as tps, cast(sum(neg) over w as double) as fps,
        lead(pos) over o as next_pos, lead(neg) over o as next_neg,
        row_number() over o = 1 as is_first,
        cast(sum(pos) over () as double) as P, cast(sum(neg) over () as double) as N
      from g
      window o as (order by score desc),
             w as (order by score desc rows between unbounded preceding and current row))"""

CLASSES = """
t as (select cast(count_if(y = 1 and pred = 1) as bigint) as tp1, cast(count_if(y = 0 and pred = 1) as bigint) as fp1,
             cast(count_if(y = 1 and pred = 0) as bigint) as fn1, cast(count_if(y = 0 and pred = 0) as bigint) as tn1
      from scored),
c0 as (select '0' as label, tn1 as tp, fn1 as fp, fp1 as fn, tn1 + fp1 as support, tp1 + fp1 + fn1 + tn1 as n from t
       union all
       select '1', tp1, fp1, fn1, tp1 + fn1, tp1 + fp1 + fn1 + tn1 from t),
c1 as (select *, coalesce(cast(tp as double) / nullif(tp + fp, 0), 0) as precision,
                 coalesce(cast(tp as double) / nullif(tp + fn, 0), 0) as recall from c0),
cls as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from c1),
rep as (
  select label, precision, recall, f1, cast(support as bigint) as support from cls
  union all
  select 'accuracy', cast(null as double), cast(null as double),
         coalesce(cast(sum(tp) as double) / nullif(max(n), 0), 0), cast(max(n) as bigint) from cls
  union all
  select 'macro avg', avg(precision), avg(recall), avg(f1), cast(max(n) as bigint) from cls
  union all
  select 'weighted avg', sum(precision * support) / max(n), sum(recall * support) / max(n),
         sum(f1 * support) / max(n), cast(max(n) as bigint) from cls)"""

# --------------------------------------------------------------------------- A11
register("confusion", with_views("scored", extra="""
counts as (select cast(y as int) as y_true, cast(pred as int) as y_pred, count(*) as count from scored group by 1, 2),
grid as (select * from (values (0), (1)) a(y_true), (values (0), (1)) b(y_pred))""") + """
select g.y_true, g.y_pred, coalesce(c.count, 0) as count
from grid g left join counts c on g.y_true = c.y_true and g.y_pred = c.y_pred""")(
    lambda spark, d: curves.confusion(td.scored(spark, d), "y", "pred"))

register("confusion_normalized", wrap(with_views("scored", extra="""
counts as (select cast(y as int) as y_true, cast(pred as int) as y_pred, count(*) as count from scored group by 1, 2),
grid as (select * from (values (0), (1)) a(y_true), (values (0), (1)) b(y_pred))""") + """
select y_true, y_pred, count, cast(count as double) / nullif(sum(count) over (partition by y_true), 0) as share
from (select g.y_true, g.y_pred, coalesce(c.count, 0) as count
      from grid g left join counts c on g.y_true = c.y_true and g.y_pred = c.y_pred) q""", ["share"]))(
    lambda spark, d: rounded(curves.confusion(td.scored(spark, d), "y", "pred", normalize=True)))

# --------------------------------------------------------------------------- V3, V1/V2
register("report", wrap(with_views("scored", extra=CLASSES) + "select * from rep",
                        ["precision", "recall", "f1"]))(
    lambda spark, d: rounded(curves.report(td.scored(spark, d), "y", "pred")))

register("metrics", wrap(with_views("scored", extra=CLASSES + "," + SWEEP) + """
select 'accuracy' as metric, f1 as value from rep where label = 'accuracy'
union all select 'precision', precision from rep where label = 'weighted avg'
union all select 'recall', recall from rep where label = 'weighted avg'
union all select 'f1_score', f1 from rep where label = 'weighted avg'
union all select 'roc_auc', sum(neg * (tps - pos / 2.0)) / (max(P) * max(N)) from c
  having (select count(distinct y) from scored) = 2
union all select 'average_precision', sum(pos * tps / (tps + fps)) / max(P) from c
  having (select count(distinct y) from scored) = 2""", ["value"]))(
    lambda spark, d: rounded(curves.metrics(td.scored(spark, d), "y", "pred", "prob")))

# --------------------------------------------------------------------------- V4, V5
register("roc_points", wrap(with_views("scored", extra=SWEEP) + """
select score + 1 as threshold, cast(0 as double) as fpr, cast(0 as double) as tpr from c where is_first
union all
select score, fps / N, tps / P from c
where is_first or next_pos is null or next_pos <> pos or next_neg <> neg""", ["threshold", "fpr", "tpr"]))(
    lambda spark, d: rounded(curves.roc_points(td.scored(spark, d), "y", "prob")))

register("roc_auc", wrap(with_views("scored", extra=SWEEP) + """
select sum(neg * (tps - pos / 2.0)) / (max(P) * max(N)) as roc_auc from c""", ["roc_auc"]))(
    lambda spark, d: rounded(curves.roc_auc(td.scored(spark, d), "y", "prob")))

# --------------------------------------------------------------------------- V6, V7, V8
register("pr_points", wrap(with_views("scored", extra=SWEEP) + """
select score as threshold, tps / (tps + fps) as precision, tps / P as recall from c
union all
select cast(null as double), cast(1 as double), cast(0 as double)""", ["threshold", "precision", "recall"]))(
    lambda spark, d: rounded(curves.pr_points(td.scored(spark, d), "y", "prob")))

register("avg_precision", wrap(with_views("scored", extra=SWEEP) + """
select sum(pos * tps / (tps + fps)) / max(P) as average_precision from c""", ["average_precision"]))(
    lambda spark, d: rounded(curves.average_precision(td.scored(spark, d), "y", "prob")))

register("pr_auc_trapezoid", wrap(with_views("scored", extra=SWEEP) + """
select sum(pos / P * (tps / (tps + fps)
        + case when (tps - pos) + (fps - neg) = 0 then 1.0 else (tps - pos) / ((tps - pos) + (fps - neg)) end) / 2)
  as pr_auc
from c where tps - pos < P""", ["pr_auc"]))(
    lambda spark, d: rounded(curves.pr_auc_trapezoid(td.scored(spark, d), "y", "prob")))
