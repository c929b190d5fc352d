"""Numbers of rows within large groups, by ranges of the order first, so that no task gets a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import bounded, save

#: Hexadecimal digits of a hash that tell its range.
DIGITS = 3


def ranked(rows: DataFrame, group: list[str], key: str, ties: list[str], weight: Column | None = None, most: int | None = None) -> DataFrame:
    """rows with total, the weights (1 by default) of their group, and before, those of its rows before them by key and ties.

    key: hexadecimal digits of a hash. Weights are summed by ranges of it; a window sees one range of a group, or one
    row for each of a group's 16 ** DIGITS ranges. Columns named total and before are replaced. most: rows at most, where they
    are counted; there are no more sums of ranges, and their join goes by it, not by Spark's estimate.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    rows = rows.drop("total", "before").withColumn("_range", F.substring(key, 1, DIGITS)).withColumn("_w", w)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_range").agg(F.sum("_w").alias("_sum"))
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumn("total", F.sum("_sum").over(Window.partitionBy(*group))).drop("_sum")
    sums = sums if most is None else bounded(sums, most)
    own = Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_within", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    return within.join(sums, [*group, "_range"]).withColumn("before", F.col("_earlier") + F.col("_within")).drop("_earlier", "_within", "_range", "_w")


def numbered(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """rows with their number from 0 within their group, by columns of any kind.

    Rows are dealt by ranges of group and order, and written; each range is numbered by itself, after the rows of its group
    in the ranges before.
    """
    dealt = save(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = Window.partitionBy(*group, "_range").orderBy(*order)
    named = dealt.withColumn("_within", F.row_number().over(own) - 1)
    same = [named[c].eqNullSafe(sums[c]) for c in [*group, "_range"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = named.join(sums, on)
    return joined.select(*[named[c] for c in rows.columns if c != column], (sums["_earlier"] + named["_within"]).alias(column))
