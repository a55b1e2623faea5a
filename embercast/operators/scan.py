"""Running sums over an ordered table of any size (used by the curves, the exact
split and folds, and the last-N statistics).

A window over a whole group, or over the whole table, is one task. Here the rows
are range-partitioned by (group, order) and checkpointed, which fixes the parts;
each part sums up its own rows of each group (a bounded table: parts times the
groups that begin or end in one), an ordered window over those sums gives what
stands before a part, and a window inside each part adds the rest. No quantile
edges and no hash prefixes: Spark's range partitioner balances the parts, however
large one group is. Rows that agree in group and order share a part, so an order
that isn't unique wants a tie column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of one part or task; rows of a table that is broadcast without asking for more.
PART_ROWS, SMALL_ROWS = 1 << 19, 500_000


def parts_for(rows: int, least: int) -> int:
    """How many parts hold ``rows``: never fewer than ``least``, and more as the table grows, so that a task's share doesn't."""
    return max(least, -(-rows // PART_ROWS))


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` (checkpointed: it is counted) marked for a broadcast join unless it has more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def same_rows(left: DataFrame, columns: dict[str, str]) -> Column:
    """Equality of ``left``'s columns with other ones (name -> other name), where NULL equals NULL."""
    cond = F.lit(True)
    for a, b in columns.items():
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def running_sums(df: DataFrame, sums: dict[str, str | Column], by=(), order=(), totals: dict[str, str | Column] | None = None,
                 leads: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its expression over the rows of the group up to this one in
    ascending ``order`` (this one included; NULL orders first); for each in ``totals`` the group's whole sum; for each
    in ``leads`` the column's value in the group's next row (NULL in the last). A NULL group is a group of its own;
    an empty table stays empty. Names starting with an underscore are reserved."""
    by, order, totals, leads = list(by), list(order), totals or {}, leads or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    whole = {**{f"_sum_{k}": x for k, x in sums.items()}, **{f"_total_{k}": x for k, x in totals.items()}}
    placed = df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed)

    per_part = placed.groupBy("_part", *by).agg(
        *[F.sum(as_column(x)).alias(k) for k, x in whole.items()],
        *[F.min_by(F.col(c), F.struct(*order)).alias(f"_first_{k}") for k, c in leads.items()], F.count(F.lit(1)).alias("_rows"))
    parts, group = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by],
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums],
        *[F.sum(f"_total_{k}").over(group).alias(f"_all_{k}") for k in totals],
        *[F.lead(f"_first_{k}").over(parts).alias(f"_next_{k}") for k in leads])

    # shuffled once, for the windows: the join keeps that layout if the parts' sums are broadcast
    j = placed.repartition(n, "_part", *by).join(small(cut_lineage(per_part)), (F.col("_part") == F.col("_p")) & same_rows(placed, {c: f"_k_{c}" for c in by}))
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.sum(as_column(x)).over(run), F.lit(0)) + F.col(f"_before_{k}")).alias(k) for k, x in sums.items()],
        *[F.col(f"_all_{k}").alias(k) for k in totals],
        *[F.when(F.lead(F.lit(True)).over(inside), F.lead(c).over(inside)).otherwise(F.col(f"_next_{k}")).alias(k) for k, c in leads.items()])


def nearest_values(df: DataFrame, cols, by=(), order=(), partitions: int | None = None) -> DataFrame:
    """``df`` with, for each column, ``_prev_<column>``: its last value that isn't NULL up to this row of the group, and
    ``_next_<column>``: the first one from this row on (NULL if there is none). A group of any length: each part
    hands its first and last values on."""
    by, order, cols = list(by), list(order), list(cols)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    own = lambda c: F.when(F.col(c).isNotNull(), at)
    per_part = placed.groupBy("_part", *by).agg(
        *[F.max_by(F.col(c), own(c)).alias(f"_last_{c}") for c in cols], *[F.min_by(F.col(c), own(c)).alias(f"_first_{c}") for c in cols])
    parts = Window.partitionBy(*by).orderBy("_part")
    before, after = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    per_part = per_part.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_k_{c}") for c in by],
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in cols],
        *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_after_{c}") for c in cols])
    j = placed.repartition(n, "_part", *by).join(small(cut_lineage(per_part)), (F.col("_part") == F.col("_p")) & same_rows(placed, {c: f"_k_{c}" for c in by}))
    # the next value = the last one in falling order: a running frame (linear), where a frame to the end is one for each row
    forth = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_part", *by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.last(c, ignorenulls=True).over(forth), F.col(f"_before_{c}")).alias(f"_prev_{c}") for c in cols],
        *[F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_after_{c}")).alias(f"_next_{c}") for c in cols])
