"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the wanted characters
over the characters that it has. Each document draws its number of copies from
the Poisson distribution with that mean, by inverting the distribution at a
uniform number that a hash of seed and document gives, so a run that is
repeated, or restarted after a lost executor, draws the same. Copies are then
shuffled globally: sorted by a hash of seed, document and copy number.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the key's values."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key))), 1, 13), 16, 10)
    return bits.cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ..., past the mean and until no step is larger than 1e-19."""
    out, total, step = [], 0.0, 1.0
    while len(out) <= rate or step > 1e-19:
        k = len(out)
        step = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += step
        out.append(total)
    return out


def rates(df: DataFrame, weights: dict[str, float], expected_chars: float | None = None, source: str = "source", text: str = "text") -> dict[str, float]:
    """Mean copies of each weighted source's documents. The totals that come to the
    driver are one number for each key of ``weights``, however many sources there are.

    ``expected_chars``: size of the mixture; None: as much as the weighted
    sources have. A source without characters has rate 0; its share goes to
    the others in proportion.
    """
    known = {k: float(w) for k, w in weights.items() if w > 0}
    if not known:
        return {}
    chars = F.length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    totals = df.where(F.col(source).isin(*known)).groupBy(F.col(source).alias("s")).agg(F.sum(chars).alias("n"))
    have = {r["s"]: r["n"] for r in totals.collect() if r["n"]}
    share = sum(known[s] for s in have)
    wanted = float(sum(have.values())) if expected_chars is None else float(expected_chars)
    return {s: known[s] / share * wanted / n for s, n in sorted(have.items())}


def copies(source: Column, u: Column, rate_of: dict[str, float], weights: dict[str, float], unlisted: int) -> Column:
    """The Poisson quantile of u at the source's rate: as many steps as u has passed."""
    out = F.when(F.coalesce(source.isin(*weights), F.lit(False)) if weights else F.lit(False), 0).otherwise(unlisted)
    for s, rate in rate_of.items():
        steps = F.array(*(F.lit(x) for x in poisson_steps(rate)))
        out = F.when(source == s, F.size(F.filter(steps, lambda c: c <= u))).otherwise(out)
    return out


def mix(df: DataFrame, weights: dict[str, float], seed: int, expected_chars: float | None = None, unlisted: int = 1, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` with each document as often as drawn: a column ``copy`` counts from 1.

    ``weights`` are target shares of the characters. A weight of 0 or less drops
    its source; a source that isn't listed, or is null, has no target: each of
    its documents stands ``unlisted`` times. Rows of equal doc_id draw the same
    number (null ids count as one id). Null text has no characters but may be
    drawn. A column called ``copy`` is replaced, _n and _at are lost; others stay. The result is
    sorted by the shuffling hash, which no column keeps; an empty table stays
    empty.
    """
    rate_of = rates(df, weights, expected_chars, source, text)
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    drawn = df.withColumn("_n", copies(F.col(source), uniform(F.lit(seed), key), rate_of, weights, unlisted)).where("_n > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    return drawn.withColumn("_at", F.xxhash64(F.lit(seed), key, "copy")).orderBy("_at", doc_id, "copy").drop("_at")
