"""Exact quantiles without a per-group buffer (used by describe, box plots,
column medians and the median fills).

Spark's exact ``percentile`` keeps a value -> count map per group and merges it
in one final task: for a hot group of continuous values that is an unbounded
buffer. Here an order statistic is found by radix selection:

1. count per (group, sixteenth of an octave of the value, by its sign); a window
   over these counts, bounded by the exponents that doubles have, finds the cell
   that holds each wanted rank;
2. only rows in such a cell go on; it is cut into 65,536 equal cells between its
   least and largest value, and so on, three times at most (an octave has 2**52
   doubles);
3. once the wanted cells hold few rows each (``finish``), or no cut is left, the
   distinct values in them are ranked by a window per cell;
4. q = v_lo + (v_hi - v_lo) * frac, frac = p * (n - 1) - floor(p * (n - 1)).

Every step is a combined count, so it is exact for any size, distribution and
number of ties, with nothing to set. The source is read once per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import same_rows, small

FINISH = 1 << 20
CELLS, CUTS = 1 << 16, 3


def octave(v: Column) -> Column:
    """The sixteenth of an octave that ``v`` lies in, in the order of the values (zeros: 0, NaN: the largest)."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * 16).cast("int") + 20_000
    return F.when(F.isnan(v), F.lit(1 << 20)).when(v == 0, F.lit(0)).when(v < 0, -size).otherwise(size)


def cell(v: Column) -> Column:
    """The one of CELLS equal parts between lo and hi that ``v`` lies in: never falls as v grows."""
    return F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("int"))


def _targets(groups: DataFrame, probs, by) -> DataFrame:
    """(*by, p, frac, rank, is_hi): the ranks (from 0) of the one or two order statistics of each p."""
    ps = F.array(*[F.lit(float(p)) for p in probs])
    t = groups.select(*by, "n", F.explode(ps).alias("p")).withColumn("_pos", F.col("p") * (F.col("n") - 1))
    t = t.withColumn("frac", F.col("_pos") - F.floor("_pos"))
    return t.select(*by, "p", "frac", F.explode(F.array(
        F.struct(F.floor("_pos").cast("long").alias("rank"), F.lit(False).alias("is_hi")),
        F.struct(F.ceil("_pos").cast("long").alias("rank"), F.lit(True).alias("is_hi")))).alias("t")).select(*by, "p", "frac", "t.*")


def exact_quantiles_long(long: DataFrame, probs, by=(), finish: int = FINISH) -> DataFrame:
    """``long`` holds (*by, v); returns (*by, p, q) for every group with a value and every p. NULL values are
    skipped; a NULL group is a group of its own."""
    by = list(by)
    if not by:  # one global group: a constant key keeps every join an equi-join
        return exact_quantiles_long(long.withColumn("_g", F.lit(0)), probs, ["_g"], finish).drop("_g")
    rows = long.filter(F.col("v").isNotNull()).select(*by, "v")
    extent = [F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    counts = rows.groupBy(*by, octave(F.col("v")).alias("y")).agg(*extent)
    counts = cut_lineage(counts.withColumn("off", F.sum("c").over(Window.partitionBy(*by).orderBy("y")) - F.col("c")).drop("y"))
    ranks = _targets(counts.groupBy(*by).agg(F.sum("c").alias("n")), probs, by)
    for cut in range(CUTS + 1):
        wanted = cut_lineage(_hold(counts, ranks, by))  # a row for each rank: the cell that holds it
        if cut == CUTS or (wanted.agg(F.max("c")).first()[0] or 0) <= finish:
            break
        inside = _inside(rows, wanted, by).groupBy(*by, "lo", "off", cell(F.col("v")).alias("y")).agg(extent[0], F.min("v").alias("_lo"), F.max("v").alias("hi"))
        off = F.col("off") + F.sum("c").over(Window.partitionBy(*by, "lo").orderBy("y")) - F.col("c")
        counts = cut_lineage(inside.withColumn("off", off).drop("lo", "y").withColumnRenamed("_lo", "lo"))
        ranks = wanted.select(*by, "p", "frac", "rank", "is_hi")
    values = _inside(rows, wanted, by).groupBy(*by, "lo", "off", "v").agg(extent[0])
    values = values.withColumn("off", F.col("off") + F.sum("c").over(Window.partitionBy(*by, "lo").orderBy("v")) - F.col("c")).drop("lo")
    found = _hold(values, wanted.select(*by, "p", "frac", "rank", "is_hi"), by)
    stat = found.groupBy(*by, "p", "frac").agg(
        F.max(F.when(~F.col("is_hi"), F.col("v"))).alias("lo"), F.max(F.when(F.col("is_hi"), F.col("v"))).alias("hi"))
    return stat.select(*by, "p", (F.col("lo") + F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(
        (F.col("hi") - F.col("lo")) * F.col("frac"))).alias("q"))


def _inside(rows: DataFrame, wanted: DataFrame, by) -> DataFrame:
    """Rows whose value lies in a wanted cell of their group (cells don't overlap), with the cell's lo, hi and off.
    The cells are broadcast unless there are many: a shuffle by group would put a whole group into one task."""
    cells = wanted.select(*[F.col(c).alias(f"_k_{c}") for c in by], "lo", "hi", "off").distinct()
    same = same_rows(rows, {c: f"_k_{c}" for c in by}) & F.col("v").between(F.col("lo"), F.col("hi"))
    return rows.join(small(cells), same).select(*rows.columns, "lo", "hi", "off")


def _hold(counts: DataFrame, ranks: DataFrame, by) -> DataFrame:
    """Each rank beside the row of ``counts`` (off, c, ...) that holds it."""
    r = ranks.select(*[F.col(c).alias(f"_k_{c}") for c in by], "p", "frac", "rank", "is_hi")
    inside = (F.col("rank") >= F.col("off")) & (F.col("rank") < F.col("off") + F.col("c"))
    return counts.join(r, same_rows(counts, {c: f"_k_{c}" for c in by}) & inside).select(*counts.columns, "p", "frac", "rank", "is_hi")


def exact_quantiles(df: DataFrame, cols, probs, by=(), finish: int = FINISH) -> DataFrame:
    """(*by, column_name, p, q) for each column: the columns are stacked into one
    long table so that all of them share one pass."""
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x")) \
        .select(*by, "_x.column_name", "_x.v")
    return exact_quantiles_long(long, probs, by + ["column_name"], finish)
