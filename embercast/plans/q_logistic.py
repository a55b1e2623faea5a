"""Scoring, persistence, request and report queries that SQL can check: Q1-Q4,
S7-S11, R1, X1 and C7/C8 on two columns. The scorer is a logistic model with
fixed coefficients, whose probability is one SQL expression."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import curves, scale, scoring, train
from ..session import checkpoint_path, table
from ..sources import files, sinks
from ..sources import testdata as td
from ..streaming import monitor as m
from . import jobs
from .adapters_sql import with_views
from .catalog import ORACLE, register, rounded, wrap

FEATURES = ["temperatura", "humedad", "velocidad_viento"]
COEFFICIENTS, INTERCEPT = [0.11, -0.04, 0.06], -0.9137
_Z = "-0.9137 + 0.11 * temperatura - 0.04 * humedad + 0.06 * velocidad_viento"
_R4 = ("case when {p} >= 0.75 then 'critico' when {p} >= 0.50 then 'alto' when {p} >= 0.25 then 'medio' else 'bajo' end")

READINGS = f"""
raw as (select user_id as station_id, event_id, cast(10 + cast(trunc(value) as int) % 25 as double) as temperatura,
          cast(30 + event_id % 60 as double) as humedad,
          cast((cast(trunc(value) as int) * 7) % 40 as double) as velocidad_viento from events),
scores as (select *, 1 / (1 + exp(-({_Z}))) as p from raw),
named as (select *, cast(p > 0.5 as int) as prediction,
            case when p > 0.5 then 'incendio' else 'sin_incendio' end as prediction_label,
            {_R4.format(p="p")} as risk_level from scores)"""


def model(spark):
    return train.fixed_logistic(spark, FEATURES, COEFFICIENTS, INTERCEPT)


def readings(spark, d):
    return m.to_readings(table(spark, d, "events"))


def _folder(spark, name):
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


# --------------------------------------------------------------------------- Q1, Q3
SCORES_SQL = wrap("with " + READINGS.strip() + """
select station_id, event_id, prediction, prediction_label, p as probability_fire, risk_level from named""", ["probability_fire"])
register("logistic_scores", SCORES_SQL)(
    lambda spark, d: rounded(scoring.batch_score(model(spark), readings(spark, d), keep=("station_id", "event_id"))))

register("logistic_classes", "with " + READINGS.strip() + " select station_id, event_id, prediction from named")(
    lambda spark, d: scoring.predict(model(spark), readings(spark, d), keep=("station_id", "event_id")))

register("logistic_proba", wrap("with " + READINGS.strip() + """
select station_id, event_id, 1 - p as probability_no_fire, p as probability_fire from named""",
                                ["probability_no_fire", "probability_fire"]))(
    lambda spark, d: rounded(scoring.predict_proba(model(spark), readings(spark, d), keep=("station_id", "event_id"))))


# --------------------------------------------------------------------------- R1 (the same scores from the stream)
def _stream(spark, d):
    landed = m.landed_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
    out = spark.read.parquet(m.run_available_now(m.score_stream(model(spark), m.to_readings(landed)), "logistic_stream"))
    return rounded(out.select("station_id", "event_id", "prediction", "prediction_label", "probability_fire", "risk_level"))


register("logistic_stream", SCORES_SQL)(_stream)


# --------------------------------------------------------------------------- Q2 + S8 (two appends to the history)
def _history(spark, d):
    path = _folder(spark, "logistic-history")
    for half in (0, 1):
        part = readings(spark, d).filter(F.col("event_id") % 2 == half)
        sinks.append_predictions(scoring.score_with_details(model(spark), part, keep=("station_id", "event_id")), path)
    h = spark.read.parquet(path)
    return h.groupBy("prediction_label", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("n_stamped"), F.countDistinct("event_id").alias("n_events"))


register("logistic_history", "with " + READINGS.strip() + """
select prediction_label, risk_level, count(*) as n, count(*) as n_stamped, count(distinct event_id) as n_events
from named group by 1, 2""")(_history)


# --------------------------------------------------------------------------- S10 (rows whose score changed by saving)
def _roundtrip(spark, d):
    path = _folder(spark, "logistic-model")
    sinks.save_model(model(spark), path)
    r, keep = readings(spark, d), ("station_id", "event_id")
    before = scoring.batch_score(model(spark), r, keep)
    after = scoring.batch_score(sinks.load_model(path), r, keep)
    changed = before.exceptAll(after).count()
    return after.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(changed).cast("long").alias("n_changed"),
                     F.sum("prediction").alias("n_fire"))


register("logistic_roundtrip", "with " + READINGS.strip() + """
select count(*) as n_rows, cast(0 as bigint) as n_changed, cast(sum(prediction) as bigint) as n_fire from named""")(_roundtrip)


# --------------------------------------------------------------------------- S11 (+ Q4): every kind of request body
def _bodies(spark, d):
    """One request for each event; its id says how the body is spoilt."""
    r = readings(spark, d)
    named = F.to_json(F.struct(*FEATURES))
    listed = F.to_json(F.array(*FEATURES))
    kinds = [
        F.format_string('{"data": [%s, %s]}', listed, named),
        F.format_string('{"data": [%s]}', named),
        F.lit('{"data": "hello"}'), F.lit('{"data": {"temperatura": 1}}'), F.lit('{"data": [1, "x"]}'),
        F.format_string('{"data": [["a", "b", "c"], %s]}', listed),
        F.format_string('{"data": [null, %s]}', named),
        F.format_string('{"data": [[%s, null, 1]]}', F.col("temperatura")),
        F.lit('{"data": [[1, 2], {"temperatura": 4}]}'), F.lit('{"data": []}'), F.lit('{"rows": [[1, 2, 3]]}'), F.lit("broken"),
    ]
    body = kinds[-1]
    for i, k in enumerate(kinds[:-1]):
        body = F.when(F.col("event_id") % len(kinds) == i, k).otherwise(body)
    return r.select(F.col("event_id").alias("request_id"), body.alias("body"))


_KINDS = [  # (kind of body, row, reason or null when accepted)
    (0, 0, None), (0, 1, None), (1, 0, None), (2, None, "data is not a list"), (3, None, "data is not a list"),
    (4, 0, "row is not a list or an object"), (4, 1, "row is not a list or an object"),
    (5, 0, "value is not a number"), (5, 1, None), (6, 0, "row is null"), (6, 1, None), (7, 0, "null value"),
    (8, 0, "expected 3 values, got 2"), (8, 1, "missing columns"), (9, None, "empty data"), (10, None, "missing data"),
    (11, None, "missing data"),
]
_lit = lambda x, kind: f"cast({'null' if x is None else repr(x)} as {kind})"
_VALUES = ", ".join(f"({k}, {_lit(i, 'int')}, {_lit(r, 'varchar')})" for k, i, r in _KINDS)

register("requests_routing", f"""
select event_id as request_id, k.row_idx, k.reason
from events join (values {_VALUES}) k(kind, row_idx, reason) on event_id % 12 = k.kind""")(
    lambda spark, d: files.route_requests(_bodies(spark, d), features=FEATURES).select("request_id", "row_idx", "reason"))


# --------------------------------------------------------------------------- P2, O5: the columns that a request's rows lack
def _missing(spark, d):
    """Each event's request leaves out the features whose bit of its id is set, and carries one that nobody asked for."""
    r = readings(spark, d)
    kept = [F.when(F.shiftright(F.col("event_id"), i).bitwiseAND(F.lit(1)) == 0, F.col(f)).alias(f) for i, f in enumerate(FEATURES)]
    body = F.concat(F.lit('{"data": ['), F.to_json(F.struct(*kept, F.col("station_id").alias("zone"))), F.lit("]}"))
    out = files.missing_columns(r.select(F.col("event_id").alias("request_id"), body.alias("body")), features=FEATURES)
    return out.select("request_id", "row_idx", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


register("requests_missing_columns", """
select event_id as request_id, 0 as row_idx, concat_ws(',',
  case when (event_id >> 1) & 1 = 1 then 'humedad' end, case when event_id & 1 = 1 then 'temperatura' end,
  case when (event_id >> 2) & 1 = 1 then 'velocidad_viento' end) as missing, 'zone' as extra from events""")(_missing)


# --------------------------------------------------------------------------- R1 + S8: a stream's history, one batch replayed
def _recorded(spark, d):
    path = _folder(spark, "recorded")
    for replay in range(2):  # the second stream has lost its checkpoint: it sends every batch again
        landed = m.landed_stream(spark, d, table(spark, d, "events").schema, "events.parquet")
        sinks.recorded_stream(m.score_stream(model(spark), m.to_readings(landed)), path, _folder(spark, f"recorded-checkpoint-{replay}")).awaitTermination()
    h = spark.read.parquet(path)
    return h.groupBy("prediction_label", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("n_stamped"), F.countDistinct("event_id").alias("n_events"))


register("stream_history", ORACLE["logistic_history"])(_recorded)


def _request_scores(spark, d):
    rows, _ = files.parse_score_requests(_bodies(spark, d), features=FEATURES)
    out = scoring.score_requests(model(spark), rows, "fixed_logistic")
    return rounded(out.select("request_id", "row_idx", "prediction", "probability", "risk_level", "model_name"))


register("logistic_requests", wrap("with " + READINGS.strip() + f"""
select event_id as request_id, k.row_idx, prediction, p as probability, upper(risk_level) as risk_level,
  'fixed_logistic' as model_name
from named join (values {_VALUES}) k(kind, row_idx, reason) on event_id % 12 = k.kind and k.reason is null""",
                                   ["probability"]))(_request_scores)


# --------------------------------------------------------------------------- S7, S9 (files read back)
def _metrics_file(spark, d):
    path = _folder(spark, "metrics")
    sinks.write_metrics_json(curves.metrics(td.scored(spark, d), "y", "pred", "prob"), path)
    return rounded(spark.read.schema("metric string, value double").json(path))


def _report_file(spark, d):
    path = _folder(spark, "report")
    sinks.write_report(curves.report(td.scored(spark, d), "y", "pred"), path)
    schema = "label string, precision double, recall double, f1 double, support long"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


register("metrics_file", ORACLE["metrics"])(_metrics_file)
register("report_file", ORACLE["report"])(_report_file)


# --------------------------------------------------------------------------- X1 through the job, sink included
def _etl_job(spark, d):
    path = _folder(spark, "etl")
    jobs.etl_daily(td.hourly_json(spark, d), td.hotspots(spark, d), td.sites(spark, d), td.HOURLY_VARIABLES, out_path=path)
    back = spark.read.parquet(path)
    return rounded(back)


register("etl_daily_job", ORACLE["etl_daily"])(_etl_job)

# --------------------------------------------------------------------------- C7, C8: two columns have closed-form eigenvalues
_PCA = """
s as (select avg(temperatura) as ma, avg(humedad) as mb, var_samp(temperatura) as va, var_samp(humedad) as vb,
        covar_samp(temperatura, humedad) as c from obs_daily),
e as (select *, (va + vb) / 2 as mid, sqrt(((va - vb) / 2) * ((va - vb) / 2) + c * c) as half from s)"""
register("pca_variance_two", wrap(with_views("obs_daily", extra=_PCA) + """
select 1 as component, (mid + half) / (2 * mid) as explained_variance_ratio, (mid + half) / (2 * mid) as cumulative from e
union all
select 2, (mid - half) / (2 * mid), cast(1 as double) from e""", ["explained_variance_ratio", "cumulative"]))(
    lambda spark, d: rounded(scale.pca_variance(td.obs_daily(spark, d), ["temperatura", "humedad"])))

# first axis: (c, l1 - va) of unit length, its larger component positive
register("pca_project_two", wrap(with_views("obs_daily", extra=_PCA + """,
v as (select *, c as x, mid + half - va as y from e),
w as (select ma, mb, x / sqrt(x * x + y * y) as x, y / sqrt(x * x + y * y) as y from v)""") + """
select site_id, date, ((temperatura - ma) * x + (humedad - mb) * y)
  * case when (abs(x) >= abs(y) and x < 0) or (abs(y) > abs(x) and y < 0) then -1 else 1 end as "PC1"
from obs_daily cross join w""", ["PC1"]))(
    lambda spark, d: rounded(scale.pca_project(td.obs_daily(spark, d), ["temperatura", "humedad"], 1,
                                               keep=("site_id", "date"))))
