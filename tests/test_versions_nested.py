"""Versions of tables, nested JSON, bands of house numbers, cached geocodes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridhaul.operators import cache
from gridhaul.operators.geocode import geocode
from gridhaul.operators.segments import interpolate
from gridhaul.operators.upstream import flatten_json
from gridhaul.sources.files import landing
from gridhaul.sources.versions import Refused, Versions

ROW = "state string, id long, x double"


def test_versions(spark):
    """Readers get what the pointer names; refused and failed loads leave it; equal rows publish nothing."""
    v = Versions(spark, landing(spark, "versions"))
    assert v.current() is None
    with pytest.raises(LookupError):
        v.read()
    rows = spark.createDataFrame([("CA", k, k / 2) for k in range(10)] + [(None, 1, None)] * 2, ROW)
    first = v.publish(rows, groups="state")
    m = v.manifest()
    assert v.current() == first and (m["rows"], m["groups"], m["previous"]) == (12, 2, None) and v.read().schema == rows.schema
    assert v.publish(rows.repartition(3), groups="state") == first
    second = v.publish(rows.union(spark.createDataFrame([("NY", 1, 1.0)], ROW)), groups="state")
    assert (v.current(), v.manifest()["previous"], v.read().count(), v.read(first).count()) == (second, first, 13, 12)
    for bad in (rows.limit(0), rows.filter("id < 2"), rows.filter("state = 'CA'").select("state", "id")):
        with pytest.raises(Refused):
            v.publish(bad, groups="state")
    with pytest.raises(Refused, match="1 groups"):
        v.publish(rows.filter("state = 'CA'").union(rows.filter("state = 'CA'")), groups="state", least=0.6)
    with pytest.raises(Exception, match="broken"):
        v.publish(rows.withColumn("x", F.when(F.col("id") == 5, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x"))))
    assert v.current() == second and sorted(map(str, v.read().collect())) == sorted(map(str, rows.union(spark.createDataFrame([("NY", 1, 1.0)], ROW)).collect()))
    third = v.publish(rows.filter("id < 2"), force=True)
    assert v.current() == third and v.read().count() == 4
    with pytest.raises(LookupError):
        v.read("no-such-version")


def plain_leaves(x, path=()):
    if isinstance(x, dict | list) and x:
        for k, y in x.items() if isinstance(x, dict) else enumerate(x):
            yield from plain_leaves(y, (*path, str(k)))
    else:
        yield "/".join(path), {True: "true", False: "false"}[x] if isinstance(x, bool) else None if x is None else json.dumps(x) if isinstance(x, dict | list) else str(x)


def test_flatten_json(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(3 if depth else 1)
        if kind == 0:
            return rng.choice([None, True, False, 3, -12, "a b", "", "é", [], {}])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 1 else {f"k{k}": value(depth - 1) for k in range(rng.randrange(4))}

    values = [value(6) for _ in range(60)] + [{"a": [[[[[[1]]]]]]}, 5, "x", None, [], {"a.b": {"c/d": 1, "": 2}}]
    texts = [(k, json.dumps(v), "kept") for k, v in enumerate(values)] + [(900, None, ""), (901, "", ""), (902, "{'no", ""), (903, '{"a":1', "")]
    rows = spark.createDataFrame(texts, "id long, body string, path_ string")
    got = sorted((r.id, r.path, str(r.value)) for r in flatten_json(rows, "body").collect())
    assert got == sorted((k, p, str(v)) for k, x in enumerate(values) for p, v in plain_leaves(x))
    with pytest.raises(ValueError, match="deeper"):
        flatten_json(rows, "body", max_depth=3).collect()
    assert flatten_json(rows.limit(0), "body").count() == 0


def test_bands_of_numbers(spark):
    """Every range finds its numbers, however wide: against a plain scan."""
    rng = random.Random(4)
    segs = []
    for k in range(120):
        low = rng.randrange(1, 10 ** rng.randrange(1, 12))
        segs.append((k, "CA", rng.choice(["a st", "b st"]), "L", rng.choice(["1", "2", ""]), low, low + rng.choice([0, 1, 255, 256, 16_383, 16_384, 1 << 21, 1 << 40]), 1.0, 2.0, 3.0, 4.0))
    asked = [(k, rng.choice(["CA", "CA", None]), rng.choice([rng.choice(segs)[5 + k % 2], rng.randrange(1, 10**6), None]), rng.choice(["a st", "b st", "c st"]), rng.choice(["1", None])) for k in range(150)]
    found = interpolate(spark.createDataFrame(asked, "id long, state string, number long, street string, zip string"), spark.createDataFrame(segs, "id long, state string, street string, side string, zip string, from_hn long, to_hn long, from_lat double, from_lon double, to_lat double, to_lon double"))
    want = {}
    for k, state, number, street, zip_ in asked:
        fit = [(s[4] != zip_, s[0]) for s in segs if number is not None and s[1] == state and s[2] == street and s[5] <= number <= s[6]]
        if fit:
            want[k] = min(fit)[1]
    assert len(want) > 30 and {r.id: r.segment for r in found.collect()} == want


def test_geocodes_of_the_cache(spark):
    """A live entry answers before the search, an expired or broken one doesn't, points stay points."""
    asked = spark.createDataFrame([(1, "12 Oak St, Troy, CA"), (2, "14 Oak St, Troy, CA"), (3, "37.5,-122.5"), (4, "Troy CA"), (5, "16 Oak St, Troy, CA"), (6, None)], "id long, text string")
    stored = spark.createDataFrame([("CA", 1, "12 oak st troy ca", "rooftop", 1.0, 1.0), ("CA", 2, "14 oak st troy ca", "rooftop", 2.0, 2.0), ("CA", 3, "16 oak st troy ca", "rooftop", 3.0, 3.0)], "shard string, id long, text string, tier string, lat double, lon double")
    segments = spark.createDataFrame([], "id long, state string, street string, side string, zip string, from_hn long, to_hn long, from_lat double, from_lon double, to_lat double, to_lon double")
    plain = {r.id: (r.match, r.lat, r.lon) for r in geocode(asked, stored, segments).collect()}
    from gridhaul.functions import text as X

    norm = {r.id: r.n for r in asked.select("id", X.normalize_query(F.col("text")).alias("n")).collect()}
    told = spark.createDataFrame([(norm[1], "interpolated", 9.0, 9.0, 100), (norm[2], "rooftop", 8.0, 8.0, -10_000_000), (norm[1], "rooftop", 7.0, 7.0, 50), (norm[5], "NOT_FOUND", 6.0, 6.0, 100)], "normalized string, match string, lat double, lon double, at long")
    entries = cache.geocode_entries(told, "v1", F.col("at"))
    found = {r.id: (r.match, r.lat, r.lon) for r in geocode(asked, stored, segments, entries, "v1", 1000).collect()}
    assert plain[1] == ("rooftop", 1.0, 1.0) and found == plain | {1: ("interpolated", 9.0, 9.0)}
    assert {r.id: (r.match, r.lat, r.lon) for r in geocode(asked, stored, segments, entries, "v2", 1000).collect()} == plain
