"""Gaps and islands: the window operators that most line-by-line loops reduce to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows in which `starts` is true only for the first; `starts` may use lag over `ordered(keys, order)`."""
    flagged = df.withColumn("_starts", F.when(starts, 1).otherwise(0))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn(name, F.sum("_starts").over(running)).drop("_starts")


def ordered(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def first_mode(df: DataFrame, keys: list[str], value: str, weight: Column, position: str) -> DataFrame:
    """The value of most weight for each key; of equal ones, that seen first."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(position).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("w"), "first")
    return sums.withColumn("n", F.row_number().over(best)).where("n = 1").select(*keys, value, "w")


def joined(column: str, order: str, separator: str = "\n") -> Column:
    """Aggregate: the column's texts in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column]), separator)
