"""Street segments by side, and house numbers interpolated along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhaul.functions import text as X
from gridhaul.operators.materialise import materialised

def sides(lines: DataFrame) -> DataFrame:
    """One row a side of each road line (id, state, ...) whose two address ends are numbers."""

    def side(name: str, low: str, high: str, zip_: str):
        a, z = X.leading_int(F.col(low)), X.leading_int(F.col(high))
        return F.struct(F.lit(name).alias("side"), F.trim(F.coalesce(F.col(zip_), F.lit(""))).alias("zip"), F.least(a, z).alias("from_hn"), F.greatest(a, z).alias("to_hn"), (a.isNotNull() & z.isNotNull()).alias("ok"))

    roads = lines.filter(F.col("mtfcc").rlike("^S1[0-9]{3}$") & (F.trim("fullname") != ""))
    both = F.explode(F.array(side("L", "lfrom", "lto", "zipl"), side("R", "rfrom", "rto", "zipr")))
    found = roads.select("id", "state", X.stored_tokens(F.col("fullname")).alias("street"), both.alias("s"), "from_lat", "from_lon", "to_lat", "to_lon")
    return found.filter("s.ok").select("id", "state", "street", "s.side", "s.zip", "s.from_hn", "s.to_hn", "from_lat", "from_lon", "to_lat", "to_lon")


def _blocks() -> Column:
    """The range from_hn to to_hn as blocks (level, block) of 2^level numbers each, two of a level at most."""

    def of(level: Column) -> Column:
        low, end = -F.call_function("shiftright", -F.col("from_hn"), level), F.call_function("shiftright", F.col("to_hn") + 1, level)
        block = lambda at: F.struct(level.alias("level"), at.alias("block"))
        first, last = F.when((low < end) & (low % 2 != 0), block(low)), F.when((low < end) & (end % 2 != 0), block(end - 1))
        return F.array(first, last)

    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("to_hn") - F.col("from_hn") + 1)) - 1)
    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def interpolate(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """id, segment, lat, lon: asked (id, state, number, street, zip) on the segment of its state and street that holds the number;
    one of its own zip before any other, then by segment id and side. The middle if the range is a single number.

    Each range is cut into blocks of 1, 2, 4, ... numbers, and a block keeps its first segment alone, of any zip and of each zip. A number looks in
    the one block of each size that holds it, so it meets at most two segments a size however many overlap, and neither a street nor a number that many ask for
    is gathered. Without a state or number there is no answer.
    """
    keys = ["state", "street", "level", "block"]
    s = segments.filter("from_hn <= to_hn").withColumns({c: F.col(c).cast("long") for c in ("from_hn", "to_hn")})
    first = F.min(F.struct(F.col("id").alias("segment"), "side", "from_hn", "to_hn", "from_lat", "from_lon", "to_lat", "to_lon")).alias("x")
    own = materialised(s.withColumn("b", F.explode(_blocks())).select("*", "b.level", "b.block").groupBy(*keys, "zip").agg(first))
    any_ = own.groupBy(*keys).agg(F.min("x").alias("x"))
    levels = sorted(r.level for r in own.select("level").distinct().collect())
    widths = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col("number"), k).alias("block")) for k in levels)).cast("array<struct<level: int, block: bigint>>")
    a = asked.withColumn("number", F.col("number").cast("long")).filter("number IS NOT NULL AND state IS NOT NULL AND street IS NOT NULL").select("id", "state", "street", "zip", "number")
    a = materialised(a)  # its texts are parsed once
    places = a.select("state", "street", "number", "zip").distinct()

    def best(some: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
        looked = some.withColumn("b", F.explode(widths)).select("*", "b.level", "b.block")
        return looked.join(table, [c for c in ("state", "street", "level", "block", "zip") if c in table.columns]).groupBy(*by).agg(F.min("x").alias("x"))

    near = best(places.filter("zip IS NOT NULL"), own, ["state", "street", "number", "zip"]).withColumnRenamed("x", "near")
    other = best(places.select("state", "street", "number").distinct(), any_, ["state", "street", "number"]).withColumnRenamed("x", "other")
    found = a.join(other, ["state", "street", "number"]).join(near, ["state", "street", "number", "zip"], "left").select("id", "number", F.coalesce("near", "other").alias("x"))
    span = F.col("x.to_hn") - F.col("x.from_hn")
    t = F.when(span == 0, 0.5).otherwise((F.col("number") - F.col("x.from_hn")) / span)
    point = [(F.col(f"x.from_{c}") + t * (F.col(f"x.to_{c}") - F.col(f"x.from_{c}"))).alias(c) for c in ("lat", "lon")]
    return found.select("id", F.col("x.segment").alias("segment"), *point)
