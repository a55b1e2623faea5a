"""Risk / alert / prediction-statistics queries (P7-P10, P13, A12-A15) on
``scored`` (the probabilities and classes of a scorer) and on event readings."""

from __future__ import annotations

from .. import fixed
from ..functions import risk
from ..operators import scoring, stats
from ..session import table
from ..sources import testdata as td
from .adapters_sql import with_views
from .catalog import register, rounded, wrap

_R4 = ("case when prob is null then 'desconocido' when prob >= 0.75 then 'critico' when prob >= 0.50 then 'alto' "
       "when prob >= 0.25 then 'medio' else 'bajo' end")
_R3 = "case when prob is null then null when prob < 0.30 then 'BAJO' when prob < 0.60 then 'MEDIO' else 'ALTO' end"
_LBL = "case when pred = 1 then 'incendio' else 'sin_incendio' end"


def _levels(spark, d):
    s = td.scored(spark, d)
    return s.select("event_id", "prob", "pred",
                    risk.prediction_label("pred").alias("prediction_label"),
                    risk.risk_level4("prob").alias("risk_level"))


# --------------------------------------------------------------------------- P7, P8, P9
register("risk_bucket4", wrap(with_views("scored") + f"""
select event_id, prob, pred, {_LBL} as prediction_label, {_R4} as risk_level from scored""", ["prob"]))(
    lambda spark, d: rounded(_levels(spark, d)))

register("risk_bucket3", wrap(with_views("scored") + f"select event_id, prob, {_R3} as risk_level3 from scored",
                              ["prob"]))(
    lambda spark, d: rounded(td.scored(spark, d).select("event_id", "prob",
                                                         risk.risk_level3("prob").alias("risk_level3"))))

# --------------------------------------------------------------------------- P10
_ADV = ",\n".join("('{}', '{}', '{}', '{}')".format(lv, col, head, "\n".join(lines))
                  for lv, col, head, lines in fixed.RISK_ADVICE)
register("risk_advice", with_views("scored", extra=f"""
adv as (select * from (values {_ADV}) v(lv, color, heading, advice))""") + f"""
select s.event_id, s.risk_level, a.color, a.heading, a.advice
from (select event_id, {_R4} as risk_level from scored) s left join adv a on s.risk_level = a.lv""")(
    lambda spark, d: scoring.with_advice(_levels(spark, d).select("event_id", "risk_level")))

# --------------------------------------------------------------------------- A12
register("prediction_stats", with_views("scored") + f"""
select cast(sum(n) as bigint) as total_predictions,
  cast(coalesce(sum(case when label = 'incendio' then n end), 0) as bigint) as n_incendio,
  cast(coalesce(sum(case when label = 'sin_incendio' then n end), 0) as bigint) as n_sin_incendio,
  arg_max(label, n * 1000 - ascii(label)) as most_common_prediction
from (select {_LBL} as label, count(*) as n from scored group by 1) g""")(
    lambda spark, d: scoring.prediction_stats(td.scored(spark, d), "pred"))

# --------------------------------------------------------------------------- A13, A14
register("risk_bands", wrap(with_views("scored") + f"""
select total, high, medium, low,
  high * cast(100 as double) / total as high_pct, medium * cast(100 as double) / total as medium_pct,
  low * cast(100 as double) / total as low_pct
from (select count(*) as total,
        cast(count_if(lv in ('alto', 'critico')) as bigint) as high,
        cast(count_if(lv = 'medio') as bigint) as medium,
        cast(count_if(lv = 'bajo') as bigint) as low
      from (select {_R4} as lv from scored) s) t""", ["high_pct", "medium_pct", "low_pct"]))(
    lambda spark, d: rounded(stats.risk_bands(_levels(spark, d), "risk_level")))

register("risk_distribution", wrap(with_views("scored") + f"""
select risk_level, count(*) as n, cast(count(*) as double) / sum(count(*)) over () as share
from (select {_R4} as risk_level from scored) s group by 1""", ["share"]))(
    lambda spark, d: rounded(stats.distribution(_levels(spark, d), "risk_level")))

# --------------------------------------------------------------------------- P13
register("alerts", wrap(with_views("scored") + """
select event_id, prob, pred, coalesce(prob > 0.7 and pred = 1, false) as alert from scored""", ["prob"]))(
    lambda spark, d: rounded(scoring.alerts(td.scored(spark, d).select("event_id", "prob", "pred"),
                                            "prob", "pred", 0.7)))


# --------------------------------------------------------------------------- A15
def readings(spark, d):
    """Scored sensor readings (T9) from events, with the alert flag."""
    r = td.scored_readings(table(spark, d, "events"))
    return scoring.alerts(r, "probability_fire", "prediction", fixed.ALERT_THRESHOLD)


READINGS_SQL = """
readings as (
  select user_id as station_id, ts, event_id,
    cast(10 + cast(trunc(value) as int) % 25 as double) as temperatura,
    cast(30 + event_id % 60 as double) as humedad,
    cast((cast(trunc(value) as int) * 7) % 40 as double) as velocidad_viento,
    cast(cast(json_extract_string(props, '$.k') as int) as double) / 100 as probability_fire,
    cast(cast(cast(json_extract_string(props, '$.k') as int) as double) / 100 >= 0.5 as int) as prediction,
    coalesce(cast(cast(json_extract_string(props, '$.k') as int) as double) / 100 > 0.7
             and cast(cast(cast(json_extract_string(props, '$.k') as int) as double) / 100 >= 0.5 as int) = 1,
             false) as alert
  from events)"""

register("monitor_stats", wrap("with " + READINGS_SQL.strip() + """,
tot as (select station_id, count(*) as total_readings, cast(count_if(alert) as bigint) as total_alerts,
          (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as uptime_seconds from readings group by 1),
rec as (select station_id, avg(temperatura) as avg_temperatura, avg(humedad) as avg_humedad,
          avg(velocidad_viento) as avg_velocidad_viento
        from (select *, row_number() over (partition by station_id order by ts desc, event_id desc) as rk from readings) r
        where rk <= 20 group by 1)
select tot.*, rec.avg_temperatura, rec.avg_humedad, rec.avg_velocidad_viento,
  coalesce(cast(total_alerts as double) / nullif(total_readings, 0), 0) as alert_rate
from tot left join rec on tot.station_id = rec.station_id""",
    ["uptime_seconds", "avg_temperatura", "avg_humedad", "avg_velocidad_viento", "alert_rate"]))(
    lambda spark, d: rounded(stats.monitor_stats(readings(spark, d), "station_id", "ts", "alert", history=20)))
