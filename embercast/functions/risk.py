"""Prediction label and risk-bucket expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prediction_label(pred) -> Column:
    """1 -> 'incendio', anything else -> 'sin_incendio'."""
    return F.when(_c(pred) == 1, F.lit(fixed.LABEL_FIRE)).otherwise(F.lit(fixed.LABEL_NO_FIRE))


def risk_level4(prob, upper: bool = False) -> Column:
    """NULL -> 'desconocido'; >= .75 critico; >= .50 alto; >= .25 medio; else bajo.
    One canonical lower-case level; ``upper=True`` is presentation only."""
    p = _c(prob)
    out = F.when(p.isNull(), F.lit(fixed.RISK_UNKNOWN))
    for bound, name in fixed.RISK4[:-1]:
        out = out.when(p >= F.lit(bound), F.lit(name))
    out = out.otherwise(F.lit(fixed.RISK4[-1][1]))
    return F.upper(out) if upper else out


def risk_level3(prob) -> Column:
    """< .30 BAJO, < .60 MEDIO, else ALTO (NULL stays NULL)."""
    p = _c(prob)
    (b1, n1), (b2, n2), (_, n3) = fixed.RISK3
    return F.when(p.isNull(), F.lit(None).cast("string")) \
        .when(p < F.lit(b1), F.lit(n1)).when(p < F.lit(b2), F.lit(n2)).otherwise(F.lit(n3))


def is_alert(prob, pred, threshold: float = fixed.ALERT_THRESHOLD) -> Column:
    """P13 (fixed form): P(fire) above the threshold and the predicted class is fire."""
    return F.coalesce((_c(prob) > F.lit(threshold)) & (_c(pred) == 1), F.lit(False))
