"""Caches of legs and geocodes as append-only tables: key, value (JSON), stored_at and expires_at in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhaul.functions import keys

TTL_S = 30 * 86_400
LEG = "t double, l double"
POINT = "lat double, lon double, match string"


def leg_entries(legs: DataFrame, version: str, now: int | Column, ttl: int = TTL_S) -> DataFrame:
    """Entries for legs (origin, dest, seconds, metres, status); only answers that are OK are kept for later."""
    value = F.to_json(F.struct(F.col("seconds").alias("t"), F.col("metres").alias("l")))
    ok = legs.filter("status = 'OK'")
    return ok.select(keys.leg_cache_key(F.lit(version), F.col("origin"), F.col("dest")).alias("key"), value.alias("value"), F.lit(now).cast("long").alias("stored_at"), (F.lit(now) + ttl).cast("long").alias("expires_at"))


def geocode_entries(found: DataFrame, version: str, now: int | Column, ttl: int = TTL_S) -> DataFrame:
    """Entries for geocodes (normalized, match, lat, lon); what wasn't found is asked again next time."""
    value = F.to_json(F.struct("lat", "lon", "match"))
    ok = found.filter("match <> 'NOT_FOUND' AND match <> 'coords'")
    return ok.select(keys.address_cache_key(F.lit(version), F.col("normalized")).alias("key"), value.alias("value"), F.lit(now).cast("long").alias("stored_at"), (F.lit(now) + ttl).cast("long").alias("expires_at"))


def live(entries: DataFrame, schema: str, now: int) -> DataFrame:
    """key and the parsed value of each key's last entry, if it hasn't expired and can be read."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), F.struct("stored_at", "value")).alias("x"))
    return last.filter(F.col("x.expires_at") > now).select("key", F.from_json("x.value", schema).alias("v")).filter("v IS NOT NULL")


def cached_legs(pairs: DataFrame, entries: DataFrame, version: str, now: int) -> DataFrame:
    """origin, dest, seconds, metres of the pairs (origin, dest) that the cache answers."""
    key = keys.leg_cache_key(F.lit(version), F.col("origin"), F.col("dest"))
    hit = live(entries, LEG, now).filter("v.t IS NOT NULL AND v.l IS NOT NULL")
    return pairs.select("origin", "dest", key.alias("key")).distinct().join(hit, "key").select("origin", "dest", F.col("v.t").alias("seconds"), F.col("v.l").alias("metres"))


def cached_points(asked: DataFrame, entries: DataFrame, version: str, now: int) -> DataFrame:
    """id, match, lat, lon of asked (id, normalized) that the cache answers; entries that have expired, can't be read or lack a place don't count."""
    hit = live(entries, POINT, now).filter("v.lat IS NOT NULL AND v.lon IS NOT NULL AND v.match IS NOT NULL")
    key = keys.address_cache_key(F.lit(version), F.col("normalized"))
    return asked.select("id", key.alias("key")).join(hit, "key").select("id", "v.match", "v.lat", "v.lon")
