"""The hash-seeded forest (M1, M2, M3, M5, O2), the training job (X5) and the whole
evaluation job (X6). A forest depends on its rows only, so SQL grows the same trees:
``grown_sql`` writes a level as a few common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, forest, model_queue, split, train
from ..session import cut_lineage
from ..sources import testdata as td
from . import jobs
from .adapters_sql import with_views
from .catalog import register, rounded, wrap
from .q_curves import CLASSES, SWEEP
from .q_models import KEYS, SPLIT_SQL, VALUES

EXAMPLE = forest.Settings(trees=6, max_depth=4, min_split=20, min_leaf=5, max_features="sqrt", class_weight="balanced", seed=42)


def _train_test(spark, d):
    s = cut_lineage(split.stratified_split(td.obs_daily(spark, d), "incendio", KEYS, 0.2, 42))
    return s.filter(~F.col("is_test")), s.filter(F.col("is_test"))


def grown_sql(s: forest.Settings, bins: int = 32) -> str:
    """Common table expressions that end in nodes (tree, node, n0, n1, f, bin), cuts (f, v, b) and weights (w0, w1),
    from the training rows of ``split``."""
    n, p, depth = len(VALUES), forest.PRIME, s.max_depth
    draws = " + ".join(f"(u >= {t})::int" for t in forest.DRAWS)
    trees = ", ".join(f"({t}, {a}, {b})" for t in range(s.trees) for a, b in [forest.draw_factors(t, s.seed)])
    balanced = "(count(*) / (2.0::double * count_if(y = 0))) as w0, (count(*) / (2.0::double * count_if(y = 1))) as w1"
    parts = [f"""
tr as materialized (select row_number() over () as rid, incendio as y, [{", ".join(VALUES)}] as v,
    ('0x' || substr({"md5(concat_ws('|', site_id, date, '" + str(s.seed) + "'))"}, 1, 15))::bigint % {p} as r from split where not is_test),
weights as materialized (select {balanced if s.class_weight else "1.0::double as w0, 1.0::double as w1"} from tr),
lv as materialized (select rid, unnest(range(0, {n})) as f, unnest(v) as v from tr),
cv as materialized (select f, v, count(*) as c from lv group by all),
cc as (select *, sum(c) over (partition by f order by v) as cum, sum(c) over (partition by f) as n from cv),
cuts as materialized (select f, v, row_number() over (partition by f order by v) - 1 as b from cc
    where greatest(1, ((cum - c) * {bins} + n - 1) // n) <= least({bins - 1}, (cum * {bins} + n - 1) // n - 1)),
bm as materialized (select cv.f, cv.v, count(cuts.v) as bin from cv left join cuts on cuts.f = cv.f and cuts.v < cv.v group by all),
lb as materialized (select rid, lv.f, bin from lv join bm on lv.f = bm.f and lv.v = bm.v),
a0 as materialized (select rid, tree, y, node, times from (
    select rid, tree, y, 1::bigint as node, {draws} as times
    from (select rid, y, tree, (r * a + b) % {p} as u from tr cross join (values {trees}) t(tree, a, b))) where times > 0)"""]
    for d in range(depth + 1):
        parts.append(f"""
h{d} as materialized (select tree, node, f, bin, sum(times * (1 - y))::bigint as n0, sum(times * y)::bigint as n1
    from a{d} join lb using (rid) group by all),
t{d} as materialized (select tree, node, sum(n0)::bigint as n0, sum(n1)::bigint as n1 from h{d} where f = 0 group by all)""")
        if d < depth:
            parts.append(f"""
k{d} as (select tree, node, f, row_number() over (partition by tree, node order by (((node * 31 + tree * 17 + {s.seed * 13}) % {p}) * (2654435 + f * 40503) + 12345 * f) % {p}, f) as place
    from t{d} cross join (select unnest(range(0, {n})) as f)),
l{d} as (select tree, node, f, bin, (sum(n0) over w)::bigint as l0, (sum(n1) over w)::bigint as l1 from h{d} window w as (partition by tree, node, f order by bin)),
g{d} as (select tree, node, f, bin, w0 * l0 as x0, w1 * l1 as x1, w0 * (n0 - l0) as y0, w1 * (n1 - l1) as y1
    from l{d} join t{d} using (tree, node) join k{d} using (tree, node, f) cross join weights
    where place <= {forest._n_features(s, n)} and n0 > 0 and n1 > 0 and n0 + n1 >= {s.min_split} and l0 + l1 >= {s.min_leaf} and n0 + n1 - l0 - l1 >= {s.min_leaf}),
s{d} as materialized (select tree, node, f, bin from g{d}
    qualify row_number() over (partition by tree, node order by (x0 * x0 + x1 * x1) / (x0 + x1) + (y0 * y0 + y1 * y1) / (y0 + y1) desc, f, bin) = 1),
a{d + 1} as materialized (select a.rid, a.tree, a.y, 2 * a.node + (lb.bin > s.bin)::int as node, a.times
    from a{d} a join s{d} s using (tree, node) join lb on lb.rid = a.rid and lb.f = s.f)""")
    nodes = [f"select tree, node, n0, n1, f, bin from t{d} left join s{d} using (tree, node)" if d < depth
             else f"select tree, node, n0, n1, null, null from t{d}" for d in range(depth + 1)]
    parts.append("\nnodes as materialized (" + " union all ".join(nodes) + ")")
    return SPLIT_SQL + "," + ",".join(parts)


_NAMES = "case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(VALUES)) + " end"
IMPORTANCE_SQL = """,
purity as (select tree, node, f, (w0 * n0 * (w0 * n0) + w1 * n1 * (w1 * n1)) / (w0 * n0 + w1 * n1) as q from nodes cross join weights),
gains as (select x.tree, x.f, l.q + r.q - x.q as gain from purity x join purity l on l.tree = x.tree and l.node = 2 * x.node
    join purity r on r.tree = x.tree and r.node = 2 * x.node + 1),
shares as (select f, sum(gain / whole) as share from (select *, sum(gain) over (partition by tree) as whole from gains) group by f),
imp as (select """ + _NAMES.replace("case f", "case k.f") + """ as feature, coalesce(share, 0) / (select sum(share) from shares) as importance
    from (select unnest(range(0, """ + str(len(VALUES)) + """)) as f) k left join shares on shares.f = k.f)"""


def _scores_sql(depth: int) -> str:
    out = [f""",
te as materialized (select row_number() over () as rid, site_id, date, incendio, [{", ".join(VALUES)}] as v from split where is_test),
tb as materialized (select x.rid, x.f, count(cuts.v) as bin from (select rid, unnest(range(0, {len(VALUES)})) as f, unnest(v) as v from te) x
    left join cuts on cuts.f = x.f and cuts.v < x.v group by all),
p0 as (select rid, tree, 1::bigint as node from te cross join (select distinct tree from nodes))"""]
    for d in range(depth):
        out.append(f"""
p{d + 1} as materialized (select p.rid, p.tree, case when nodes.f is null then p.node else 2 * p.node + (tb.bin > nodes.bin)::int end as node
    from p{d} p join nodes using (tree, node) left join tb on tb.rid = p.rid and tb.f = nodes.f)""")
    out.append(f"""
votes as (select rid, avg(w1 * n1 / (w0 * n0 + w1 * n1)) as probability_fire from p{depth} join nodes using (tree, node) cross join weights group by rid)""")
    return ",".join(out)


# --------------------------------------------------------------------------- M2 (the trees), M5, O2, Q1
def _example(spark, d):
    tr, te = _train_test(spark, d)
    return forest.fit(tr, VALUES, "incendio", KEYS, EXAMPLE), te


register("forest_nodes", wrap(with_views("obs_daily", extra=grown_sql(EXAMPLE)) + f"""
select tree::int as tree, node, {_NAMES} as feature, cuts.v as threshold, n0, n1
from nodes left join cuts on cuts.f = nodes.f and cuts.b = nodes.bin""".replace("case f", "case nodes.f"), ["threshold"]))(
    lambda spark, d: rounded(_example(spark, d)[0].table(spark)))

register("forest_importance", wrap(with_views("obs_daily", extra=grown_sql(EXAMPLE) + IMPORTANCE_SQL) + "select * from imp", ["importance"]))(
    lambda spark, d: rounded(_example(spark, d)[0].importance(spark)))

register("forest_top5", wrap(with_views("obs_daily", extra=grown_sql(EXAMPLE) + IMPORTANCE_SQL) + """
select * from imp order by importance desc, feature limit 5""", ["importance"]))(
    lambda spark, d: rounded(_example(spark, d)[0].importance(spark, top=5)))


def _example_scores(spark, d):
    model, te = _example(spark, d)
    return rounded(model.score(te.select(*KEYS, "incendio", *VALUES)).select(*KEYS, "incendio", "probability_fire"))


register("forest_scores", wrap(with_views("obs_daily", extra=grown_sql(EXAMPLE) + _scores_sql(EXAMPLE.max_depth)) + """
select site_id, date, incendio, probability_fire from te join votes using (rid)""", ["probability_fire"]))(_example_scores)


# --------------------------------------------------------------------------- M1 (200 trees, unbounded), M3, X5
def _baseline(spark, d):
    """Importances of the baseline forest on all training rows (deterministic; SQL can't unroll its depth)."""
    return forest.fit(_train_test(spark, d)[0], VALUES, "incendio", KEYS, forest.Settings(trees=200)).importance(spark)


register("forest_baseline")(_baseline)


def _training(spark, d):
    return jobs.training_job(td.obs_daily(spark, d), VALUES, n_iter=20, folds=4)


register("forest_search")(lambda spark, d: _training(spark, d)["leaderboard"])


# --------------------------------------------------------------------------- X6: all four results, and X5's on the example forest
def _one_table(results: dict):
    """metrics, report, confusion and ROC points as one table: result, label, a, b, c, d."""
    none = F.lit(None).cast("double")
    cols = lambda *x: [e.cast("double").alias(n) for e, n in zip(x, "abcd", strict=True)]
    c = F.col
    return results["metrics"].select(F.lit("metrics").alias("result"), c("metric").alias("label"), *cols(c("value"), none, none, none)).unionByName(
        results["report"].select(F.lit("report").alias("result"), "label", *cols(c("precision"), c("recall"), c("f1"), c("support")))).unionByName(
        results["confusion"].select(F.lit("confusion").alias("result"), F.concat("y_true", F.lit(" as "), "y_pred").alias("label"), *cols(c("count"), none, none, none))).unionByName(
        results["roc"].select(F.lit("roc").alias("result"), F.lit("").alias("label"), *cols(c("threshold"), c("fpr"), c("tpr"), none)))


EVALUATION_SQL = """
select 'metrics' as result, metric as label, value as a, null::double as b, null::double as c, null::double as d from (
  select 'accuracy' as metric, f1 as value from rep where label = 'accuracy'
  union all select 'precision', precision from rep where label = 'weighted avg'
  union all select 'recall', recall from rep where label = 'weighted avg'
  union all select 'f1_score', f1 from rep where label = 'weighted avg'
  union all select 'roc_auc', sum(neg * (tps - pos / 2.0)) / (max(P) * max(N)) from c
  union all select 'average_precision', sum(pos * tps / (tps + fps)) / max(P) from c)
union all select 'report', label, precision, recall, f1, support::double from rep
union all select 'confusion', '0 as 0', tn1::double, null, null, null from t union all select 'confusion', '0 as 1', fp1::double, null, null, null from t
union all select 'confusion', '1 as 0', fn1::double, null, null, null from t union all select 'confusion', '1 as 1', tp1::double, null, null, null from t
union all select 'roc', '', score + 1, 0.0::double, 0.0::double, null from c where is_first
union all select 'roc', '', score, fps / N, tps / P, null from c
  where is_first or next_pos is null or next_pos <> pos or next_neg <> neg"""


#: Binary fractions: a sum of products is exact in any order, so equal scores are equal in every engine.
FEATURES, COEFFICIENTS, INTERCEPT = ["temperatura", "humedad", "velocidad_viento"], [0.125, -0.0625, 0.0625], -0.9375
_Z = "-0.9375 + 0.125 * temperatura - 0.0625 * humedad + 0.0625 * velocidad_viento"


def _evaluation(spark, d):
    te = _train_test(spark, d)[1]
    names = ("metrics", "report", "confusion", "roc")
    return rounded(_one_table(dict(zip(names, jobs.evaluation_job(train.fixed_logistic(spark, FEATURES, COEFFICIENTS, INTERCEPT), te, "incendio"), strict=True))))


register("evaluation_results", wrap(with_views("obs_daily", extra=SPLIT_SQL + f""",
scored as (select incendio as y, (p > 0.5)::int as pred, p as prob from (
    select incendio, 1 / (1 + exp(-({_Z}))) as p from split where is_test))""" + "," + CLASSES + "," + SWEEP) + EVALUATION_SQL, ["a", "b", "c", "d"]))(_evaluation)


# --------------------------------------------------------------------------- M6: curves of several models in one pass
def _grouped(spark, d):
    """ROC-AUC and average precision of three scorers from one table: the score itself, its complement, its square rounded."""
    s = td.scored(spark, d)
    long = s.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), e.alias("prob")) for n, e in (
        ("as given", F.col("prob")), ("complement", 1 - F.col("prob")), ("coarse", F.floor(F.col("prob") * 10).cast("double")))])).alias("m")).select("y", "m.*")
    auc, ap = curves.roc_auc(long, by=("model",)), curves.average_precision(long, by=("model",))
    return rounded(auc.join(ap, "model"))


_GROUPED = """
long as (select y, 'as given' as model, prob from scored union all select y, 'complement', 1 - prob from scored
    union all select y, 'coarse', floor(prob * 10) from scored),
g as (select model, prob as score, sum(y)::bigint as pos, (count(*) - sum(y))::bigint as neg from long where prob is not null group by all),
c as (select *, (sum(pos) over w)::double as tps, (sum(neg) over w)::double as fps, (sum(pos) over m)::double as P, (sum(neg) over m)::double as N from g
    window m as (partition by model), w as (partition by model order by score desc rows between unbounded preceding and current row))"""
register("curves_by_model", wrap(with_views("scored", extra=_GROUPED) + """
select model, sum(neg * (tps - pos / 2.0)) / (max(P) * max(N)) as roc_auc, sum(pos * tps / (tps + fps)) / max(P) as average_precision
from c group by model""", ["roc_auc", "average_precision"]))(_grouped)


def _queue(spark, d):
    """Five folds, stop after three candidates without a gain, forward-selected vote."""
    tr = split.stratified_folds(_train_test(spark, d)[0].drop("is_test"), "incendio", KEYS, 5, 42)
    options = [forest.Settings(trees=4, max_depth=m, min_leaf=k, class_weight=w) for m, k, w in (
        (3, 1, None), (6, 1, "balanced"), (6, 20, None), (2, 1, None), (2, 20, "balanced"), (1, 1, None), (8, 5, None))]
    return model_queue.run_queue(tr, VALUES, "incendio", KEYS, options, folds=5, patience=3).leaderboard


register("model_queue")(_queue)
