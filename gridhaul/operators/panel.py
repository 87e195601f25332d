"""Accuracy panels: providers' answers for the same routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PLACES = 4096


def per_route(answers: DataFrame, value: str) -> DataFrame:
    """category, route, median and spread in percent of it, of routes with two or more answers. answers: one row a
    route and provider."""
    v = F.col(value)
    out = answers.filter(v.isNotNull()).groupBy("category", "route").agg(F.count(F.lit(1)).alias("n"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.filter("n >= 2 AND median <> 0").select("category", "route", "median", ((F.col("high") - F.col("low")) / F.col("median") * 100).alias("spread"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median of value: the exact median of groups of any size.

    Values are counted by a coarse place first (PLACES of them between the group's least and greatest value); only
    the places that hold the middle are looked at value by value.
    """
    v = F.col(value)
    rows = rows.filter(v.isNotNull())
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * PLACES)).otherwise(0)
    placed = rows.join(ends, by).withColumn("place", place)
    upto = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.groupBy(*by, "place").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto))
    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = (F.col("upto") > first) & (F.col("upto") - F.col("c") <= last)
    some = placed.join(counted.withColumn("before", F.col("upto") - F.col("c")).drop("c", "upto"), [*by, "place"])
    kept = counted.join(ends.select(*by, "n"), by).filter(middle).select(*by, "place")
    inside = some.join(kept, [*by, "place"], "left_semi").groupBy(*by, "n", "place", "before", value).agg(F.count(F.lit(1)).alias("c"))
    seen = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "place").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rest = inside.withColumn("seen", seen)

    def at(k):
        return F.min(F.when(F.col("seen") > k, v))

    return rest.groupBy(*by, "n").agg(((at(first) + at(last)) / 2).alias("median"))


def long(table: DataFrame, providers: list[str], value: str) -> DataFrame:
    """A row a route and provider of a table with a column a provider; what is missing has none."""
    return table.unpivot(["category", "route"], providers, "provider", value).filter(F.col(value).isNotNull())


def spreads(answers: DataFrame, value: str) -> DataFrame:
    return medians(per_route(answers, value), ["category"], "spread").withColumnsRenamed({"n": "routes", "median": "spread"})


def deviations(answers: DataFrame, value: str) -> DataFrame:
    """category, provider and the median of its deviation from the routes' medians in percent."""
    joined = answers.filter(F.col(value).isNotNull()).join(per_route(answers, value).drop("spread"), ["category", "route"])
    off = joined.select("category", "provider", ((F.col(value) - F.col("median")) / F.col("median") * 100).alias("off"))
    return medians(off, ["category", "provider"], "off").drop("n").withColumnRenamed("median", "deviation")


def latencies(answers: DataFrame) -> DataFrame:
    """provider, n, median and p90 (the element at floor(0.9 n) in order) of answered, timed requests.

    Counts by value come first, so a provider's window has a row a distinct time.
    """
    times = answers.filter("status = 'OK' AND wall_ms > 0").groupBy("provider", "wall_ms").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("provider").orderBy("wall_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = times.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy("provider"))})

    def at(place):
        return F.min(F.when(F.col("upto") > place, F.col("wall_ms")))

    half = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return rows.groupBy("provider", "n").agg(half.alias("median_ms"), at(F.floor(F.col("n") * 0.9)).alias("p90_ms"))


def wide(answers: DataFrame, providers: list[str], value: str) -> DataFrame:
    """category, route and a column a provider."""
    return answers.groupBy("category", "route").pivot("provider", providers).agg(F.min(value))
