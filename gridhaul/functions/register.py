"""SQL functions for sessions: the geometry as temporary functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "haversine_m(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE": "CASE WHEN isnotnull(a + b + c + d) THEN 2 * 6371000.0D * asin(sqrt(least(1.0D, sin(radians(c - a) / 2) * sin(radians(c - a) / 2) + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) * sin(radians(d - b) / 2)))) END",
    "tile_x(lon DOUBLE) RETURNS INT": "CAST(floor((lon + 180) / 0.25D) AS INT)",
    "tile_y(lat DOUBLE) RETURNS INT": "CAST(floor((lat + 90) / 0.25D) AS INT)",
    "half_up(x DOUBLE) RETURNS BIGINT": "CAST(floor(x + 0.5D) AS BIGINT)",
    "lerp(a DOUBLE, z DOUBLE, low BIGINT, high BIGINT, at BIGINT) RETURNS DOUBLE": "a + CASE WHEN high = low THEN 0.5D ELSE (at - low) / (high - low) END * (z - a)",
    "snap_cell(value DOUBLE, low DOUBLE) RETURNS INT": "greatest(0, least(24, CAST(floor((value - low) / 0.01D) AS INT)))",
}


#: Great circles between two lists of points as text (lat,lng with bars between), blank places left out: a row a pair, by their places from 0; null where an end is no point.
_POINTS = "transform(filter(split({0}, '[|]'), p -> trim(p) <> ''), p -> IF(size(split(p, ',')) = 2, array(try_cast(trim(split(p, ',')[0]) AS DOUBLE), try_cast(trim(split(p, ',')[1]) AS DOUBLE)), array(NULL, NULL)))"
TABLE_FUNCTIONS = {
    "route_matrix(origins STRING, destinations STRING) RETURNS TABLE (origin INT, dest INT, metres DOUBLE)": f"SELECT o, d, haversine_m(p[0], p[1], q[0], q[1]) FROM inline(flatten(transform({_POINTS.format('origins')}, (p, o) -> transform({_POINTS.format('destinations')}, (q, d) -> struct(o, d, p, q))))) AS x(o, d, p, q)",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of the session; those of tables are SQL as well, so Catalyst inlines them into the plan of the caller (FROM t, LATERAL route_matrix(...))."""
    for head, body in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
