"""Stratified split (C9), class weights (C10) and stratified folds (M4).

Membership is a pure function of the row key and the seed: ``md5(key|seed)``.
Exact per-class counts need each row's rank by hash within its class; a window
per class would put the majority class (most rows) into one task. Folds take the
rank as a running count by ``scan.running_sums``. The split only needs to know who
is below a rank: counts by the hash's first digits tell it for all rows but those
that share them with the class's last test row, and only these few are ranked.

A row without a class (J1 makes NULL labels on purpose) stays in the table, in
neither part and in no fold: ``is_test`` and ``fold`` are NULL, its weight is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import running_sums, same_rows, small

#: Hex digits of the hash that the split counts by.
DIGITS = 4


def row_hash(keys, seed: int) -> Column:
    """md5 hex of ``key1|key2|...|seed`` (same text in Spark and DuckDB)."""
    parts = [F.col(k).cast("string") for k in keys] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def class_rank(df: DataFrame, target: str, keys, seed: int = 42) -> DataFrame:
    """Adds ``_h`` (md5), ``_rank`` (1-based rank by ``_h``, then the keys, within the class)
    and ``_n_class`` (class size)."""
    one = F.lit(1)
    return running_sums(df.withColumn("_h", row_hash(keys, seed)), {"_rank": one}, [target], ["_h", *keys], {"_n_class": one})


def stratified_split(df: DataFrame, target: str, keys, test_size: float = 0.2, seed: int = 42,
                     exact: bool = True) -> DataFrame:
    """Adds ``is_test``. ``exact``: per class exactly round(test_size * n_c)
    rows, the lowest hashes. ``exact=False``: hash threshold on the first 32
    bits (map-only, no shuffle; class shares exact in expectation). NULL class: NULL."""
    has_class = F.col(target).isNotNull()
    if not exact:
        bits = F.conv(F.substring(row_hash(keys, seed), 1, 8), 16, 10).cast("long")
        return df.withColumn("is_test", F.when(has_class, bits < F.lit(int(test_size * 2 ** 32))))
    df = cut_lineage(df)  # counted, ranked at the edges and returned: the same rows each time
    hashed = df.withColumn("_h", row_hash(keys, seed))
    digits = F.substring("_h", 1, DIGITS)
    per_class = Window.partitionBy("_class")
    counts = hashed.filter(has_class).groupBy(F.col(target).alias("_class"), digits.alias("_edge")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumns({
        "_before": F.sum("_c").over(per_class.orderBy("_edge")) - F.col("_c"),
        "_n_test": F.least(F.round(F.lit(float(test_size)) * F.sum("_c").over(per_class)), F.sum("_c").over(per_class))})
    edges = counts.filter((F.col("_before") < F.col("_n_test")) & (F.col("_n_test") <= F.col("_before") + F.col("_c"))).drop("_c")
    hashed = hashed.join(small(cut_lineage(edges)), same_rows(hashed, {target: "_class"}), "left")  # a class without a test row has no edge
    at_edge = F.coalesce(digits == F.col("_edge"), F.lit(False))
    away = hashed.filter(~at_edge).withColumn("is_test", F.when(has_class, F.coalesce(digits < F.col("_edge"), F.lit(False))))
    ranked = running_sums(hashed.filter(at_edge), {"_rank": F.lit(1)}, [target], ["_h", *keys])
    ranked = ranked.withColumn("is_test", F.col("_before") + F.col("_rank") <= F.col("_n_test"))
    return away.select(*df.columns, "is_test").unionByName(ranked.select(*df.columns, "is_test"))


def stratified_folds(df: DataFrame, target: str, keys, k: int = 4, seed: int = 42) -> DataFrame:
    """M4: ``fold`` = (rank within class by hash - 1) mod k: every fold gets
    each class in equal shares (+-1). NULL class: NULL."""
    r = class_rank(df, target, keys, seed)
    return r.withColumn("fold", F.when(F.col(target).isNotNull(), ((F.col("_rank") - 1) % k).cast("int"))).drop("_h", "_rank", "_n_class")


def class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """C10 "balanced": weight = n / (n_classes * n_c), over the rows that have a class; a row without one weighs 0.
    The per-class table is broadcast unless it is large: a shuffle by class would put a whole class into one task."""
    c = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_nc"))
    w = c.select("_class", (F.sum("_nc").over(Window.partitionBy()).cast("double")
                            / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_nc"))).alias("_w"))
    return df.join(small(cut_lineage(w)), same_rows(df, {target: "_class"}), "left").withColumn(out, F.coalesce("_w", F.lit(0.0))).drop("_class", "_w")
