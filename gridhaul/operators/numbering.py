"""Running numbers within a group of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], coarse: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their number from 1 in the order within by.

    coarse cuts each group into pieces that follow each other in that order. Only a row a piece is summed over the group;
    numbers inside a piece come from a window of the piece, so no task holds a group.
    """
    r = rows.withColumn("__piece", coarse)
    sizes = r.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__piece").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    same = r["__piece"].eqNullSafe(sizes["__at"])
    for c in by:
        same = same & r[c].eqNullSafe(sizes[f"__{c}"])
    inside = F.row_number().over(Window.partitionBy(*by, "__piece").orderBy(*order))
    return r.join(sizes, same).withColumn(name, F.col("__base") + inside).drop("__piece", "__at", "__base", *(f"__{c}" for c in by))
