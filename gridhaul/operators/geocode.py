"""Address to point: literal, full text, then interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.functions import constants as C
from gridhaul.functions import text as X
from gridhaul.operators import cache, fulltext
from gridhaul.operators.materialise import materialised
from gridhaul.operators.segments import interpolate


def geocode(asked: DataFrame, stored: DataFrame, segments: DataFrame, entries: DataFrame | None = None, version: str = "v1", now: int = 0) -> DataFrame:
    """id, match, lat, lon of asked (id, text). stored: shard, id, text, tier, lat, lon.

    Without a state all shards are asked: a rooftop row of the first shard that has one, else any row of the first.
    entries (key, value, stored_at, expires_at): what the cache of that version holds; texts that it answers at the time now aren't searched. Points
    come before the cache, and a text without a house number isn't looked up.
    """
    a = asked.select("id", "text", X.coordinate(F.col("text")).alias("point"), X.normalize_query(F.col("text")).alias("norm"), X.parse_state(F.col("text")).alias("state"))
    a = materialised(a)
    gated = a.filter(F.col("point").isNull() & X.has_house_number(F.col("norm")))
    held = None
    if entries is not None:
        held = materialised(cache.cached_points(gated.select("id", F.col("norm").alias("normalized")), entries, version, now))
        gated = gated.join(held, "id", "left_anti")
    shards = F.when(F.col("state").isNotNull(), F.array("state")).otherwise(F.array(*(F.lit(s) for s in C.SHARD_ORDER)))
    queries = gated.select(F.col("id").alias("q"), F.explode(shards).alias("shard"), F.col("norm").alias("text"))
    usable = stored.filter(F.col("tier").isin("rooftop", "interpolated"))
    best = fulltext.ranked(queries, fulltext.postings(usable), usable.select("shard", "id", "tier", "lat", "lon"))
    place = F.array_position(F.array(*(F.lit(s) for s in C.SHARD_ORDER)), F.col("shard"))
    order = Window.partitionBy("q").orderBy(F.desc(F.col("tier") == "rooftop"), place)
    hit = best.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(F.col("q").alias("id"), "tier", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    streets = gated.filter("state IS NOT NULL").select("id", "state", X.parse_address(F.col("text")).alias("p")).filter("p IS NOT NULL").select("id", "state", "p.number", "p.street", "p.zip")
    between = interpolate(streets, segments).select("id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    out = a.join(hit, "id", "left").join(between, "id", "left")
    match = F.when(F.col("point").isNotNull(), "coords").when(F.col("tier").isNotNull(), F.col("tier")).when(F.col("s_lat").isNotNull(), "interpolated").otherwise("NOT_FOUND")
    lat, lon = (F.coalesce(F.col(f"point.{c}"), F.col(f"h_{c}"), F.col(f"s_{c}")).alias(c) for c in ("lat", "lon"))
    found = out.select("id", match.alias("match"), lat, lon)
    if held is None:
        return found
    return found.join(held.select("id", F.struct("match", "lat", "lon").alias("held")), "id", "left").select("id", *(F.coalesce(F.col(f"held.{c}"), F.col(c)).alias(c) for c in ("match", "lat", "lon")))
