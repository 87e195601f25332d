"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhaul.functions import constants as C
from gridhaul.functions import geo
from gridhaul.functions import text as X
from gridhaul.operators import addresses, fulltext, geocode, graph, limits, panel, routing, segments, snap, sync, upstream
from gridhaul.operators.materialise import materialised
from gridhaul.plans import matrix
from gridhaul.plans.tables import frame, sql, table
from gridhaul.sources import files
from gridhaul.streaming.limiter import limited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# --- SQL shared by the oracles


def s_map(values: dict[str, str], key: str) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + f"}}[{key}]"


def s_hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))))"


def s_norm(t: str) -> str:
    m = C.SUFFIX | C.LONG_DIRECTION
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: coalesce({s_map(m, 'x')}, x)), ' ')"


def s_stored(t: str, m: dict[str, str]) -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex(trim({t}), '\\s+'), lambda x: x <> ''), lambda x: coalesce({s_map(m, "lower(regexp_replace(x, '^[.,]+|[.,]+$', '', 'g'))")}, lower(regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')))), ' ')"


def s_state(t: str) -> str:
    codes = f"list_filter(regexp_split_to_array(upper(trim({t})), '[\\s,]+'), lambda x: list_contains({C.STATE_CODES}, x))"
    names = " ".join(f"WHEN contains(lower({t}), '{n}') THEN '{c}'" for n, c in C.STATE_NAMES.items())
    prefix = f"try_cast(substr(regexp_extract({t}, '{C.ZIP_PATTERN}', 1), 1, 3) AS INTEGER)"
    zips = " ".join(f"WHEN {prefix} BETWEEN {a} AND {z} THEN '{s}'" for a, z, s in C.ZIP3)
    return f"CASE WHEN len({codes}) > 0 THEN {codes}[-1] {names} {zips} END"


def s_house(n: str) -> str:
    rest = f"string_split({n}, ' ')[2:]"
    return f"(regexp_full_match(string_split({n}, ' ')[1], '[0-9]+[a-z]?(-[0-9]+[a-z]?)?') AND NOT (regexp_full_match(string_split({n}, ' ')[1], '[0-9]{{5}}') AND len(list_filter({rest}, lambda t: NOT (length(t) <= 2 OR regexp_full_match(t, '[0-9]+')))) = 0) AND len({rest}) > 0)"


def s_cell(v: str, low: int, deg: str) -> str:
    return f"CAST(floor(({v} + {low}) * {deg}) AS INTEGER)"


S_STREET = C.SUFFIX | C.LONG_DIRECTION
S_LOADED = C.SUFFIX | C.DIRECTION


def s_query_street(t: str) -> str:
    raw = f"regexp_extract({t}, '{C.ADDRESS_PATTERN}', 2)"
    return f"array_to_string(list_filter(list_transform(string_split_regex(trim(lower({raw})), '\\s+'), lambda x: coalesce({s_map(S_STREET, "regexp_replace(x, '[.,]', '', 'g')")}, regexp_replace(x, '[.,]', '', 'g'))), lambda x: x <> ''), ' ')"


def s_number(t: str) -> str:
    return f"try_cast(regexp_extract({t}, '{C.ADDRESS_PATTERN}', 1) AS BIGINT)"


def s_zip(t: str) -> str:
    return f"list_last(regexp_extract_all({t}, '{C.ZIP_PATTERN}', 1))"


# --- matrix, tiles, formats

S_ONE = lambda x: f"CASE WHEN {x} * 4 = floor({x} * 4) THEN printf('%.1f', floor({x} * 10 + 0.5) / 10) ELSE printf('%.1f', {x}) END"
S_DIST = "CASE WHEN m * 3.28084 < 528 THEN concat(CAST(CAST(floor(m * 3.28084 + 0.5) AS BIGINT) AS VARCHAR), ' ft') WHEN m / 1609.344 < 10 THEN concat(" + S_ONE("(m / 1609.344)") + ", ' mi') ELSE concat(CAST(floor(m / 1609.344 + 0.5) AS BIGINT), ' mi') END"
S_KM = "CASE WHEN m < 1000 THEN concat(CAST(CAST(floor(m + 0.5) AS BIGINT) AS VARCHAR), ' m') WHEN m / 1000 < 10 THEN concat(" + S_ONE("(m / 1000)") + ", ' km') ELSE concat(CAST(floor(m / 1000 + 0.5) AS BIGINT), ' km') END"
_MIN = "CAST(floor(s / 60 + 0.5) AS BIGINT)"
S_DUR = (
    f"CASE WHEN s < 60 THEN concat(greatest(1, CAST(floor(s + 0.5) AS BIGINT)), ' sec', CASE WHEN greatest(1, CAST(floor(s + 0.5) AS BIGINT)) = 1 THEN '' ELSE 's' END) WHEN {_MIN} < 60 THEN concat({_MIN}, ' min', CASE WHEN {_MIN} = 1 THEN '' ELSE 's' END) "
    f"ELSE concat({_MIN} // 60, ' hour', CASE WHEN {_MIN} // 60 = 1 THEN '' ELSE 's' END, CASE WHEN {_MIN} % 60 = 0 THEN '' WHEN {_MIN} % 60 = 1 THEN ' 1 min' ELSE concat(' ', {_MIN} % 60, ' mins') END) END"
)
S_MATRIX = f"""WITH x AS (SELECT p.nation AS request, p.id AS origin, d.id AS dest, round(1.3 * ({s_hav("p.lat", "p.lon", "d.lat", "d.lon")}), 3) AS m FROM {sql("places")} p JOIN {sql("depots")} d ON p.nation = d.nation),
y AS (SELECT *, round(m / 20.0, 3) AS s FROM x)
SELECT request, origin, dest, 'OK' AS status, CAST(floor(m + 0.5) AS BIGINT) AS distance_m, CAST(floor(s + 0.5) AS BIGINT) AS duration_s, {S_DIST} AS distance_text, {S_DUR} AS duration_text FROM y"""


@query("distance_matrix_crow", S_MATRIX)
def distance_matrix_crow(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.crow_matrix(frame(spark, sf, "places"), frame(spark, sf, "depots"), "nation")


@query("matrix_response", f"SELECT request, origin, CAST(count(*) AS INTEGER) AS n, true AS all_ok, 'public, max-age=3600, s-maxage=3600' AS cache_control, concat('{{\"elements\":[', string_agg(concat('{{\"distance\":{{\"text\":\"', distance_text, '\",\"value\":', distance_m, '}},\"duration\":{{\"text\":\"', duration_text, '\",\"value\":', duration_s, '}},\"status\":\"OK\"}}'), ',' ORDER BY dest), ']}}') AS body FROM ({S_MATRIX}) GROUP BY request, origin")
def matrix_response(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.crow_responses(frame(spark, sf, "places"), frame(spark, sf, "depots"), "nation")


@query("format_units", f"WITH y AS (SELECT DISTINCT l_extendedprice AS m, l_quantity * 137 AS s FROM lineitem) SELECT m, s, {S_KM} AS metric, {S_DIST} AS imperial, {S_DUR} AS duration FROM y")
def format_units(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("m"), (F.col("l_quantity") * 137).alias("s")).distinct()
    return y.select("m", "s", geo.format_distance(F.col("m"), "metric").alias("metric"), geo.format_distance(F.col("m")).alias("imperial"), geo.format_duration(F.col("s")).alias("duration"))


S_TX, S_TY = s_cell("lon", 180, "4"), s_cell("lat", 90, "4")


@query("tile_assign", f"SELECT {S_TX} AS tx, {S_TY} AS ty, count(*) AS n, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max FROM {sql('places')} GROUP BY 1, 2")
def tile_assign(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "places")
    bounds = [f(c) for c in ("lat", "lon") for f in (lambda c: F.round(F.min(c), 6).alias(f"{c}_min"), lambda c: F.round(F.max(c), 6).alias(f"{c}_max"))]
    return p.groupBy(geo.tile_x(F.col("lon")).alias("tx"), geo.tile_y(F.col("lat")).alias("ty")).agg(F.count(F.lit(1)).alias("n"), *bounds)


@query("pack_tile", f"SELECT id, CAST((((tx % 65536) + 65536) % 65536) AS BIGINT) * 65536 + (((ty % 65536) + 65536) % 65536) AS packed, tx, ty FROM (SELECT id, {S_TX} - 600 AS tx, {S_TY} - 500 AS ty FROM {sql('places')})")
def pack_tile(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "places").select("id", geo.pack_tile(geo.tile_x(F.col("lon")) - 600, geo.tile_y(F.col("lat")) - 500).alias("packed"))
    tx, ty = geo.unpack_tile(F.col("packed"))
    return p.select("id", "packed", tx.alias("tx"), ty.alias("ty"))


@query("snap_cell", f"SELECT id, greatest(0, least(24, CAST(floor((lat - (floor((lat + 90) * 4) / 4 - 90)) / 0.01) AS INTEGER))) AS cy, greatest(0, least(24, CAST(floor((lon - (floor((lon + 180) * 4) / 4 - 180)) / 0.01) AS INTEGER))) AS cx FROM {sql('near_places')}")
def snap_cell(spark: SparkSession, sf: str) -> DataFrame:
    low = [F.floor((F.col(c) + k) * 4) / 4 - k for c, k in (("lat", 90), ("lon", 180))]
    return frame(spark, sf, "near_places").select("id", geo.snap_cell(F.col("lat"), low[0]).alias("cy"), geo.snap_cell(F.col("lon"), low[1]).alias("cx"))


# --- text


@query("normalize_query", f"SELECT id, text, {s_norm('text')} AS normalized FROM {sql('queries')}")
def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "queries").select("id", "text", X.normalize_query(F.col("text")).alias("normalized"))


@query("house_number_gate", f"SELECT id, {s_house('n')} AS ok FROM (SELECT id, {s_norm('text')} AS n FROM {sql('queries')})")
def house_number_gate(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "queries").select("id", X.has_house_number(X.normalize_query(F.col("text"))).alias("ok"))


S_PARSED = f"SELECT id, {s_state('text')} AS state, {s_number('text')} AS number, {s_query_street('text')} AS street, {s_zip('text')} AS zip FROM {sql('queries')}"


@query("parse_address", f"SELECT id, CASE WHEN ok THEN number END AS number, CASE WHEN ok THEN street END AS street, CASE WHEN ok THEN zip END AS zip FROM (SELECT *, coalesce(number > 0 AND street <> '', false) AS ok FROM ({S_PARSED}))")
def parse_address(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "queries").select("id", X.parse_address(F.col("text")).alias("p")).select("id", "p.number", "p.street", "p.zip")


@query("parse_state", f"SELECT id, {s_state('text')} AS state FROM {sql('queries')}")
def parse_state(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "queries").select("id", X.parse_state(F.col("text")).alias("state"))


@query("split_elements", "WITH x AS (SELECT c_custkey AS id, concat(c_name, '| ', c_mktsegment, '||', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'z' END) AS o, concat('a|', c_nationkey) AS d FROM customer) SELECT id, CAST(len(list_filter(string_split(o, '|'), lambda t: trim(t) <> '')) * len(list_filter(string_split(d, '|'), lambda t: trim(t) <> '')) AS INTEGER) AS elements, len(list_filter(string_split(o, '|'), lambda t: trim(t) <> '')) * len(list_filter(string_split(d, '|'), lambda t: trim(t) <> '')) > 5 AS too_many FROM x")
def split_elements(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("concat(c_name, '| ', c_mktsegment, '||', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'z' END)").alias("o"), F.expr("concat('a|', c_nationkey)").alias("d"))
    n = F.size(X.split_multi(F.col("o"))) * F.size(X.split_multi(F.col("d")))
    return c.select("id", n.alias("elements"), (n > 5).alias("too_many"))


@query("coordinate_literal", f"WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat(c_custkey % 90, '.5, -', c_custkey % 180) WHEN 1 THEN concat(' ', c_custkey % 90, ',', c_custkey % 180, '.25 ') WHEN 2 THEN concat(c_custkey, ' Main St') ELSE '1,2,3' END AS t FROM customer) SELECT id, try_cast(nullif(regexp_extract(t, '{C.POINT_PATTERN}', 1), '') AS DOUBLE) AS lat, try_cast(nullif(regexp_extract(t, '{C.POINT_PATTERN}', 2), '') AS DOUBLE) AS lon FROM x")
def coordinate_literal(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(c_custkey % 90, '.5, -', c_custkey % 180) WHEN 1 THEN concat(' ', c_custkey % 90, ',', c_custkey % 180, '.25 ') WHEN 2 THEN concat(c_custkey, ' Main St') ELSE '1,2,3' END")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.coordinate(t).alias("p")).select("id", "p.lat", "p.lon")


S_SPEED = "CASE WHEN regexp_full_match(lower(maxspeed), '\\s*\\d+(\\.\\d+)?\\s*mph\\s*') THEN CAST(regexp_extract(maxspeed, '\\d+(\\.\\d+)?') AS DOUBLE) * 1.60934 WHEN regexp_full_match(lower(maxspeed), '\\s*\\d+(\\.\\d+)?\\s*(km/?h)?\\s*') THEN CAST(regexp_extract(maxspeed, '\\d+(\\.\\d+)?') AS DOUBLE) END"
S_CLASS = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SPEED_KMH.items()) + " ELSE 40 END"


@query("parse_maxspeed", f"SELECT DISTINCT highway, maxspeed, round({S_SPEED}, 3) AS posted, round(CASE WHEN {S_SPEED} > 0 THEN {S_SPEED} ELSE {S_CLASS} END, 3) AS kmh FROM {sql('ways')}")
def parse_maxspeed(spark: SparkSession, sf: str) -> DataFrame:
    w = frame(spark, sf, "ways").select("highway", "maxspeed").distinct()
    return w.select("highway", "maxspeed", F.round(X.parse_maxspeed(F.col("maxspeed")), 3).alias("posted"), F.round(X.road_speed(F.col("highway"), F.col("maxspeed")), 3).alias("kmh"))


# --- address tables

S_LINE = "concat(number, ' ', street, ', ', lower(city), ', ', lower(state), ' ', zip, CASE WHEN plus4 <> '' AND plus4 <> '0' THEN concat('-', plus4) ELSE '' END)"


@query("etl_normalize", f"WITH x AS (SELECT id, state, city, zip, plus4, {s_stored('number', S_LOADED)} AS number, {s_stored('street', S_LOADED)} AS street, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon FROM {sql('raw_addresses')}) SELECT id, state, {S_LINE} AS normalized, round(lat, 6) AS lat, round(lon, 6) AS lon FROM x WHERE lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180")
def etl_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = addresses.address_rows(frame(spark, sf, "raw_addresses"))
    return rows.select("id", "state", "normalized", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("long_street", f"SELECT id, {s_stored('street', C.LONG_SUFFIX | C.LONG_DIRECTION)} AS street FROM {sql('raw_addresses')}")
def long_street(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_addresses").select("id", X.long_street(F.col("street")).alias("street"))


S_SOURCES = f"SELECT *, concat('s', k % 8) AS state, concat('n', k) AS normalized FROM {sql('base_addresses')}"


@query("merge_addresses", f"""WITH r AS ({S_SOURCES}), d AS (SELECT *, row_number() OVER (PARTITION BY state, source, normalized ORDER BY seq) AS n FROM r),
k AS (SELECT *, CASE source WHEN 'NAD' THEN 1 WHEN 'OA' THEN 2 ELSE 3 END AS prio FROM d WHERE n = 1 OR source = 'NAD'),
f AS (SELECT *, row_number() OVER (PARTITION BY state, normalized, CAST(trunc(lat * 10000) AS BIGINT), CAST(trunc(lon * 10000) AS BIGINT) ORDER BY prio, seq) AS first FROM k)
SELECT state, row_number() OVER (PARTITION BY state ORDER BY prio, seq, normalized) AS id, normalized, printf('%.7f', lat) AS lat, printf('%.7f', lon) AS lon, source, CASE WHEN source = 'OSM' THEN 'interpolated' ELSE 'rooftop' END AS tier FROM f WHERE first = 1""")
def merge_addresses(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf, "base_addresses").withColumns({"state": F.expr("concat('s', k % 8)"), "normalized": F.expr("concat('n', k)")})
    return addresses.merge_sources(addresses.distinct_in_source(rows, ["OA", "OSM"]), ["NAD", "OA", "OSM"])


S_INT = lambda c: f"try_cast(regexp_extract(trim({c}), '^(\\d+)', 1) AS BIGINT)"
S_SIDES = (
    f"SELECT id, state, {s_stored('fullname', S_LOADED)} AS street, side, zip, least(a, z) AS from_hn, greatest(a, z) AS to_hn, from_lat, from_lon, to_lat, to_lon FROM ("
    f"SELECT *, 'L' AS side, trim(zipl) AS zip, {S_INT('lfrom')} AS a, {S_INT('lto')} AS z FROM {sql('lines')} UNION ALL SELECT *, 'R', trim(zipr), {S_INT('rfrom')}, {S_INT('rto')} FROM {sql('lines')}) WHERE regexp_full_match(mtfcc, 'S1[0-9]{{3}}') AND a IS NOT NULL AND z IS NOT NULL"
)


@query("segments_unpivot", f"SELECT id, street, side, zip, from_hn, to_hn, printf('%.6f', from_lat) AS from_lat, printf('%.6f', to_lon) AS to_lon FROM ({S_SIDES})")
def segments_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    s = segments.sides(frame(spark, sf, "lines"))
    return s.select("id", "street", "side", "zip", "from_hn", "to_hn", F.format_string("%.6f", "from_lat").alias("from_lat"), F.format_string("%.6f", "to_lon").alias("to_lon"))


S_INTERPOLATED = f"""SELECT id, segment, from_lat + t * (to_lat - from_lat) AS lat, from_lon + t * (to_lon - from_lon) AS lon FROM (
SELECT a.id, s.id AS segment, s.from_lat, s.to_lat, s.from_lon, s.to_lon, CASE WHEN s.to_hn = s.from_hn THEN 0.5 ELSE (a.number - s.from_hn) / (s.to_hn - s.from_hn) END AS t,
row_number() OVER (PARTITION BY a.id ORDER BY coalesce(a.zip = s.zip, false) DESC, s.id, s.side) AS n FROM (SELECT * FROM ({S_PARSED}) WHERE number > 0 AND street <> '') a JOIN ({S_SIDES}) s ON a.state = s.state AND a.street = s.street AND a.number BETWEEN s.from_hn AND s.to_hn) WHERE n = 1"""


@query("interpolate", f"SELECT id, segment, round(lat, 5) AS lat, round(lon, 5) AS lon FROM ({S_INTERPOLATED})")
def interpolate(spark: SparkSession, sf: str) -> DataFrame:
    q = frame(spark, sf, "queries").select("id", X.parse_state(F.col("text")).alias("state"), X.parse_address(F.col("text")).alias("p"))
    asked = q.filter("p IS NOT NULL").select("id", "state", "p.number", "p.street", "p.zip")
    found = segments.interpolate(asked, segments.sides(frame(spark, sf, "lines")))
    return found.select("id", "segment", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("linestring_endpoints", "WITH l AS (SELECT l_orderkey AS id, l_suppkey % 3 AS part, list(struct_pack(pos := l_linenumber, y := l_extendedprice, x := l_quantity) ORDER BY l_linenumber, l_extendedprice, l_quantity) AS p FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(p) DESC, part) AS n FROM l) SELECT id, CAST(len(p) AS INTEGER) AS vertices, p[1].x AS from_x, p[1].y AS from_y, p[-1].x AS to_x, p[-1].y AS to_y FROM b WHERE n = 1")
def linestring_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x")))).alias("p"))  # noqa: E741
    best = l.groupBy("id").agg(F.max_by("p", F.struct(F.size("p"), -F.col("part"))).alias("p"))
    return best.select("id", F.size("p").alias("vertices"), *(F.element_at("p", k)[c].alias(f"{e}_{c}") for k, e in ((1, "from"), (-1, "to")) for c in ("x", "y")))


@query("json_feature_extract", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS lacks FROM events")
def json_feature_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k long, none string").alias("p"))
    return e.select("id", "p.k", F.col("p.none").isNull().alias("lacks"))


@query("feature_rows", "SELECT c_custkey % 900 AS hn, count(*) AS n, round(sum(lat), 2) AS lat, round(sum(lon), 2) AS lon FROM (SELECT c_custkey, 25 + (c_custkey % 1000) / 100.0 AS lat, -100 - (c_custkey % 1000) / 100.0 AS lon FROM customer WHERE c_custkey % 7 <> 0) GROUP BY 1")
def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    line = F.expr("CASE WHEN c_custkey % 7 = 0 THEN '{broken' ELSE concat('{\"type\":\"Feature\",\"properties\":{\"number\":\"', c_custkey % 900, '\",\"street\":\"Oak St\"},\"geometry\":{\"type\":\"Point\",\"coordinates\":[', -100 - (c_custkey % 1000) / 100.0, ',', 25 + (c_custkey % 1000) / 100.0, ']}}') END")
    f = files.features(table(spark, sf, "customer").select(line.alias("value")))
    return f.groupBy(F.col("number").cast("long").alias("hn")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 2).alias("lat"), F.round(F.sum("lon"), 2).alias("lon"))


# --- full text and geocoding

S_STORED = f"SELECT id, state AS shard, tier, lat, lon, concat({s_stored('number', S_LOADED)}, ' ', {s_stored('street', S_LOADED)}, ', ', lower(city), ', ', lower(state), ' ', zip) AS text FROM {sql('stored')}"
S_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
S_POSTINGS = f"SELECT shard, id, len, token, count(*) AS tf FROM (SELECT shard, id, len({S_TOKENS}) AS len, unnest({S_TOKENS}) AS token FROM ({S_STORED})) GROUP BY ALL"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "stored")
    line = X.address_line(X.stored_tokens(F.col("number")), X.stored_tokens(F.col("street")), F.col("city"), F.col("state"), F.col("zip"))
    return s.select("id", F.col("state").alias("shard"), "tier", "lat", "lon", line.alias("text"))


@query("fts_postings", f"SELECT shard, token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({S_POSTINGS}) GROUP BY ALL")
def fts_postings(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.postings(stored(spark, sf)).groupBy("shard", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _ranked(asked: str) -> str:
    return f"""WITH a AS ({asked}), p AS ({S_POSTINGS}), w AS (SELECT q, shard, unnest(list_distinct({S_TOKENS})) AS token, len(list_distinct({S_TOKENS})) AS need FROM a),
df AS (SELECT shard, token, count(*) AS df FROM p GROUP BY ALL), n AS (SELECT shard, count(*) AS n, avg(len) AS mean_len FROM (SELECT DISTINCT shard, id, len FROM p) GROUP BY ALL),
m AS (SELECT w.q, w.shard, p.id, w.need, count(*) AS hits, round(sum(greatest(ln((n.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / n.mean_len))), 6) AS score
FROM w JOIN p USING (shard, token) JOIN df USING (shard, token) JOIN n USING (shard) GROUP BY ALL),
best AS (SELECT m.q, m.shard, m.id, s.tier, s.lat, s.lon, m.score, row_number() OVER (PARTITION BY m.q, m.shard ORDER BY m.score DESC, s.tier = 'rooftop' DESC, m.id) AS n FROM m JOIN ({S_STORED}) s ON s.shard = m.shard AND s.id = m.id WHERE m.hits = m.need)
SELECT q, shard, id, tier, lat, lon, score FROM best WHERE n = 1"""


S_WORDS = f"SELECT id AS q, state AS shard, concat(lower(city), ' ', {s_stored('street', S_LOADED)}) AS text FROM {sql('raw_addresses')}"


@query("fts_match", f"WITH p AS ({S_POSTINGS}), w AS (SELECT q, shard, unnest(list_distinct({S_TOKENS})) AS token, len(list_distinct({S_TOKENS})) AS need FROM ({S_WORDS})), m AS (SELECT q, shard, id, need, count(*) AS n FROM w JOIN p USING (shard, token) GROUP BY ALL) SELECT q, shard, count(*) AS matches, min(id) AS first_id FROM m WHERE n = need GROUP BY ALL")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    asked, named = fulltext.once(_word_queries(spark, sf))
    hits = fulltext.match_all(asked, materialised(fulltext.postings(stored(spark, sf))))
    counts = hits.groupBy(F.col("q").alias("first"), "shard").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("first_id"))
    return named.join(counts, ["first", "shard"]).select("q", "shard", "matches", "first_id")


def _word_queries(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "raw_addresses").select(F.col("id").alias("q"), F.col("state").alias("shard"), F.concat_ws(" ", F.lower("city"), X.stored_tokens(F.col("street"))).alias("text"))


@query("fts_bm25_top1", f"SELECT q, shard, id, tier, round(score, 4) AS score FROM ({_ranked(S_WORDS)})")
def fts_bm25_top1(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf)
    return fulltext.ranked(_word_queries(spark, sf), fulltext.postings(s), s.select("shard", "id", "tier")).select("q", "shard", "id", "tier", F.round("score", 4).alias("score"))


S_POINT = f"'{C.POINT_PATTERN}'"


def s_geocode(texts: str) -> str:
    """id, match, lat, lon of the texts (id, text)."""
    asked = f"SELECT *, {s_house('norm')} AND p_lat IS NULL AS gate FROM (SELECT id, text, {s_norm('text')} AS norm, {s_state('text')} AS state, try_cast(nullif(regexp_extract(text, {S_POINT}, 1), '') AS DOUBLE) AS p_lat, try_cast(nullif(regexp_extract(text, {S_POINT}, 2), '') AS DOUBLE) AS p_lon FROM ({texts}))"
    routed = f"SELECT id AS q, unnest(CASE WHEN state IS NOT NULL THEN [state] ELSE {C.SHARD_ORDER} END) AS shard, norm AS text FROM ({asked}) WHERE gate"
    between = S_INTERPOLATED.replace(sql("queries"), f"({texts})")
    return f"""WITH asked AS ({asked}), hits AS ({_ranked(routed)}),
hit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier = 'rooftop' DESC, list_position({C.SHARD_ORDER}, shard)) AS k FROM hits),
between_ AS ({between})
SELECT a.id, CASE WHEN p_lat IS NOT NULL THEN 'coords' WHEN h.q IS NOT NULL THEN h.tier WHEN b.id IS NOT NULL THEN 'interpolated' ELSE 'NOT_FOUND' END AS match, coalesce(p_lat, h.lat, b.lat) AS lat, coalesce(p_lon, h.lon, b.lon) AS lon
FROM asked a LEFT JOIN hit h ON h.q = a.id AND h.k = 1 LEFT JOIN between_ b ON b.id = a.id AND a.gate AND a.state IS NOT NULL"""



@query("geocode_cascade", f"SELECT id, match, round(lat, 5) AS lat, round(lon, 5) AS lon FROM ({s_geocode('SELECT id, text FROM ' + sql('queries'))})")
def geocode_cascade(spark: SparkSession, sf: str) -> DataFrame:
    found = geocode.geocode(frame(spark, sf, "queries"), stored(spark, sf), segments.sides(frame(spark, sf, "lines")))
    return found.select("id", "match", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


# --- graphs

S_KEPT = "highway IN (" + ", ".join(f"'{k}'" for k in C.SPEED_KMH) + ") AND coalesce(access, '') NOT IN ('no', 'private')"


def _s_steps(where: str) -> str:
    return f"""SELECT way, step, u, v, metres, metres / (CASE WHEN {S_SPEED} > 0 THEN {S_SPEED} ELSE {S_CLASS} END / 3.6) AS seconds, oneway FROM (
SELECT s.*, {s_hav("a.lat", "a.lon", "b.lat", "b.lon")} AS metres FROM (SELECT way, highway, maxspeed, oneway, node AS u, row_number() OVER w AS step, lead(node) OVER w AS v FROM {sql("ways")} WHERE {where} WINDOW w AS (PARTITION BY way ORDER BY pos, node, tie, tie2)) s
JOIN {sql("depots")} a ON a.id = s.u JOIN {sql("depots")} b ON b.id = s.v) WHERE metres > 0"""


S_EDGES = f"""SELECT u, v, metres, seconds FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY way, step, turn) AS n FROM (
SELECT way, step, u, v, metres, seconds, 0 AS turn FROM ({_s_steps(S_KEPT)}) UNION ALL SELECT way, step, v, u, metres, seconds, 1 FROM ({_s_steps(S_KEPT)}) WHERE coalesce(oneway, 'no') NOT IN ('yes', 'true', '1'))) WHERE n = 1"""


def road_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(frame(spark, sf, "ways"), frame(spark, sf, "depots"))


@query("graph_edges", f"SELECT u, v, round(metres, 2) AS metres, round(seconds, 2) AS seconds FROM ({S_EDGES})")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return road_edges(spark, sf).select("u", "v", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"))


S_NODES = f"SELECT id, tx, ty, CAST(row_number() OVER (PARTITION BY tx, ty ORDER BY id) - 1 AS INTEGER) AS dense FROM (SELECT id, {S_TX} AS tx, {S_TY} AS ty FROM {sql('depots')} WHERE id IN (SELECT u FROM ({S_EDGES}) UNION SELECT v FROM ({S_EDGES})))"


@query("graph_nodes", S_NODES)
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tile_nodes(road_edges(spark, sf), frame(spark, sf, "depots"))


@query("graph_csr_degree", f'WITH d AS (SELECT u, count(*) AS degree FROM ({S_EDGES}) GROUP BY u) SELECT n.*, coalesce(degree, 0) AS degree, CAST(coalesce(sum(coalesce(degree, 0)) OVER (PARTITION BY tx, ty ORDER BY dense ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({S_NODES}) n LEFT JOIN d ON d.u = n.id')
def graph_csr_degree(spark: SparkSession, sf: str) -> DataFrame:
    e = road_edges(spark, sf)
    return graph.csr(e, graph.tile_nodes(e, frame(spark, sf, "depots")))


@query("l1_quantize", f"SELECT u, v, seconds, decametres, count(*) AS n FROM (SELECT u, v, CAST(greatest(1, least(65535, round_even(seconds, 0))) AS BIGINT) AS seconds, CAST(greatest(1, least(65535, round_even(metres / 10, 0))) AS BIGINT) AS decametres FROM (SELECT u, v, metres, seconds FROM ({_s_steps(S_KEPT + " AND highway IN ('motorway', 'motorway_link')")}) UNION ALL SELECT v, u, metres, seconds FROM ({_s_steps(S_KEPT + " AND highway IN ('motorway', 'motorway_link')")}))) GROUP BY ALL")
def l1_quantize(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.l1_edges(frame(spark, sf, "ways"), frame(spark, sf, "depots"))
    return e.groupBy("u", "v", "seconds", "decametres").agg(F.count(F.lit(1)).alias("n"))


S_ORIGINS = "SELECT min(s_suppkey) AS origin FROM supplier GROUP BY s_nationkey"


def s_paths(edges: str, origins: str) -> str:
    """origin, node, metres, seconds of all nodes that origins (origin) reach; goes on until nothing improves."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u, v, CAST(seconds AS DOUBLE) AS seconds, CAST(metres AS DOUBLE) AS metres FROM ({edges})), l(origin, node, seconds, metres) USING KEY (origin, node) AS (
SELECT origin, origin, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM (SELECT DISTINCT origin FROM ({origins})) UNION
SELECT n.origin, n.node, n.x.s, n.x.m FROM (SELECT l.origin, e.v AS node, min(struct_pack(s := l.seconds + e.seconds, m := l.metres + e.metres)) AS x FROM l JOIN e ON e.u = l.node GROUP BY 1, 2) n
LEFT JOIN recurring.l k ON k.origin = n.origin AND k.node = n.node WHERE k.origin IS NULL OR n.x < struct_pack(s := k.seconds, m := k.metres)) SELECT origin, node, metres, seconds FROM l"""


S_MOTORWAYS = S_KEPT + " AND highway IN ('motorway', 'motorway_link')"
S_L1_EDGES = f"SELECT u, v, greatest(1, least(65535, round_even(seconds, 0))) AS seconds, 10 * greatest(1, least(65535, round_even(metres / 10, 0))) AS metres FROM (SELECT u, v, metres, seconds FROM ({_s_steps(S_MOTORWAYS)}) UNION ALL SELECT v, u, metres, seconds FROM ({_s_steps(S_MOTORWAYS)}))"


def motorway_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.l1_edges(frame(spark, sf, "ways"), frame(spark, sf, "depots"))
    return e.select("u", "v", F.col("seconds").cast("double").alias("seconds"), (F.col("decametres") * 10.0).alias("metres"))


def _origins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("origin")).select("origin")


@query("route_dijkstra", f"SELECT origin, node, round(seconds, 1) AS seconds, round(metres, 1) AS metres FROM ({s_paths(S_EDGES, S_ORIGINS)})")
def route_dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    p = routing.shortest_paths(_origins(spark, sf), road_edges(spark, sf))
    return p.select("origin", "node", F.round("seconds", 1).alias("seconds"), F.round("metres", 1).alias("metres"))


S_PAIRS = f"SELECT o.id AS origin, d.id AS dest, {s_hav('o.lat', 'o.lon', 'd.lat', 'd.lon')} / 1000 AS km, d.id % 97 <> 96 AS known FROM {sql('depots')} o JOIN nation a ON a.n_nationkey = o.nation JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN {sql('depots')} d ON d.nation = b.n_nationkey WHERE o.id IN ({S_ORIGINS})"


@query("route_matrix_status", f"""WITH p AS ({S_PAIRS}), l0 AS MATERIALIZED ({s_paths(S_EDGES, S_ORIGINS)}), l1 AS MATERIALIZED ({s_paths(S_L1_EDGES, S_ORIGINS)}),
x AS (SELECT p.*, CASE WHEN c.metres < 100000 THEN 'cache' WHEN km <= 500 AND c.node IS NOT NULL THEN 'l0' WHEN m.node IS NOT NULL THEN 'l1' END AS router, c.seconds AS s0, c.metres AS m0, m.seconds AS s1, m.metres AS m1
FROM p LEFT JOIN l0 c ON c.origin = p.origin AND c.node = p.dest LEFT JOIN l1 m ON m.origin = p.origin AND m.node = p.dest)
SELECT origin, dest, round(CASE WHEN NOT known THEN NULL WHEN router = 'l1' THEN s1 WHEN router IS NOT NULL THEN s0 END, 1) AS seconds, round(CASE WHEN NOT known THEN NULL WHEN router = 'l1' THEN m1 WHEN router IS NOT NULL THEN m0 END, 1) AS metres,
CASE WHEN known THEN router END AS router, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN router IS NULL THEN 'ZERO_RESULTS' ELSE 'OK' END AS status FROM x""")
def route_matrix_status(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' first depots to all depots of their region: cache of near legs, roads within 500 km, motorways beyond."""
    depots, origins = frame(spark, sf, "depots"), _origins(spark, sf)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("request"))
    ends = depots.join(nations, "nation")
    o = ends.join(origins.withColumnRenamed("origin", "id"), "id", "left_semi").select("request", F.col("id").alias("origin"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    pairs = o.join(ends.select("request", F.col("id").alias("dest"), "lat", "lon"), "request").select("origin", "dest", (geo.haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) / 1000).alias("km"), (F.col("dest") % 97 != 96).alias("known"))
    l0 = routing.shortest_paths(origins, road_edges(spark, sf)).withColumnRenamed("node", "dest")
    l1 = routing.shortest_paths(origins, motorway_edges(spark, sf)).withColumnRenamed("node", "dest")
    cached = l0.filter("metres < 100000")
    out = routing.cascade(pairs, cached, l0, l1, C.L0_MAX_KM)
    return out.select("origin", "dest", F.round("seconds", 1).alias("seconds"), F.round("metres", 1).alias("metres"), "router", "status")


# --- snapping


def s_near(points: str, nodes: str) -> str:
    """Candidates of the points (id, lat, lon): all nodes within two rings of tiles."""
    return f"SELECT p.id, p.lat, n.id AS node, n.lat AS n_lat, n.lon AS n_lon, {s_hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS metres FROM {points} p JOIN {nodes} n ON abs({s_cell('p.lat', 90, '4')} - {s_cell('n.lat', 90, '4')}) <= 2 AND abs({s_cell('p.lon', 180, '4')} - {s_cell('n.lon', 180, '4')}) <= 2"


def s_apart(points: str, nodes: str, k: int = C.SNAP_K, apart: float = C.SNAP_SEPARATION_M) -> str:
    """id, rank, node, metres: greedily the nearest at least so far from all chosen before."""
    far = f"sqrt(((n_lat - x.n_lat) * 111000) * ((n_lat - x.n_lat) * 111000) + ((n_lon - x.n_lon) * 111000 * cos(radians(lat))) * ((n_lon - x.n_lon) * 111000 * cos(radians(lat)))) >= {apart}"
    parts = [f"c1 AS MATERIALIZED ({s_near(points, nodes)})"]
    for r in range(1, k + 1):
        parts.append(f"b{r} AS MATERIALIZED (SELECT id, min(struct_pack(metres := metres, node := node, n_lat := n_lat, n_lon := n_lon)) AS x FROM c{r} GROUP BY id)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.* FROM c{r} JOIN b{r} b USING (id) WHERE {far.replace('x.', 'b.x.')} AND (metres > b.x.metres OR metres = b.x.metres AND node > b.x.node))")
    rows = " UNION ALL ".join(f"SELECT id, {r} AS rank, x.node AS node, x.metres AS metres FROM b{r}" for r in range(1, k + 1))
    return f"WITH {', '.join(parts)} {rows}"


_NEAR = s_near(sql("near_places"), sql("near_nodes"))


@query("snap_top1", f"SELECT id, node, round(metres, 2) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, node) AS n FROM ({_NEAR})) WHERE n = 1")
def snap_top1(spark: SparkSession, sf: str) -> DataFrame:
    return snap.nearest(frame(spark, sf, "near_places"), frame(spark, sf, "near_nodes"), 1).select("id", "node", F.round("metres", 2).alias("metres"))


@query("snap_topk", f"SELECT id, CAST(n AS INTEGER) AS rank, node, round(metres, 2) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, node) AS n FROM ({_NEAR})) WHERE n <= 5")
def snap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return snap.nearest(frame(spark, sf, "near_places"), frame(spark, sf, "near_nodes")).select("id", "rank", "node", F.round("metres", 2).alias("metres"))


@query("snap_apart", f"SELECT id, CAST(rank AS INTEGER) AS rank, node, round(metres, 2) AS metres FROM ({s_apart(sql('near_places'), sql('near_nodes'))})")
def snap_apart(spark: SparkSession, sf: str) -> DataFrame:
    return snap.nearest_apart(frame(spark, sf, "near_places"), frame(spark, sf, "near_nodes")).select("id", "rank", "node", F.round("metres", 2).alias("metres"))


@query("snap_far", f"SELECT id, CAST(n AS INTEGER) AS rank, node, round(metres, 2) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, node) AS n FROM ({s_near(sql('places'), sql('depots'))} WHERE n.id IN (SELECT u FROM ({S_EDGES})))) WHERE n <= 5")
def snap_far(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that routes can start from, far from most points."""
    nodes = snap.with_exits(frame(spark, sf, "depots"), road_edges(spark, sf))
    return snap.nearest(frame(spark, sf, "places"), nodes).select("id", "rank", "node", F.round("metres", 2).alias("metres"))


def s_l1(points: str, nodes: str) -> str:
    near = f"SELECT p.id, n.id AS node, greatest(abs({s_cell('p.lat', 90, '10.0')} - {s_cell('n.lat', 90, '10.0')}), abs({s_cell('p.lon', 180, '10.0')} - {s_cell('n.lon', 180, '10.0')})) AS ring, {s_hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS metres FROM {points} p JOIN {nodes} n ON abs(p.lat - n.lat) < 1.2 AND abs(p.lon - n.lon) < 1.2"
    return f"SELECT id, node, metres, ring FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, metres, node) AS n FROM ({near}) WHERE ring <= 10) WHERE n = 1"


@query("snap_l1", f"SELECT id, node, round(metres, 2) AS metres, CAST(ring AS INTEGER) AS ring FROM ({s_l1(sql('places'), sql('depots'))})")
def snap_l1(spark: SparkSession, sf: str) -> DataFrame:
    return snap.nearest_l1(frame(spark, sf, "places"), frame(spark, sf, "depots")).select("id", "node", F.round("metres", 2).alias("metres"), "ring")


# --- the whole matrix, from text to answer

S_LIST = "list_filter(list_transform(string_split({c}, '|'), lambda t: trim(t)), lambda t: t <> '')"
S_REQUESTS = f"SELECT *, CASE WHEN len(o) * len(d) = 0 THEN 'INVALID_REQUEST' WHEN len(o) * len(d) > {C.MAX_ELEMENTS} THEN 'MAX_ELEMENTS_EXCEEDED' ELSE 'OK' END AS request_status FROM (SELECT *, {S_LIST.format(c='origins')} AS o, {S_LIST.format(c='destinations')} AS d FROM {sql('asked')})"
S_L1_NODES = f"(SELECT * FROM {sql('depots')} WHERE id IN (SELECT u FROM ({S_L1_EDGES})))"  # both directions: every node has an exit
S_ANSWER = f"""WITH r AS ({S_REQUESTS}), o AS (SELECT request, units, unnest(o) AS text, generate_subscripts(o, 1) - 1 AS at FROM r WHERE request_status = 'OK'), d AS (SELECT request, unnest(d) AS text, generate_subscripts(d, 1) - 1 AS at FROM r WHERE request_status = 'OK'),
texts AS (SELECT DISTINCT text AS id, text FROM (SELECT text FROM o UNION ALL SELECT text FROM d)), g AS MATERIALIZED (SELECT * FROM ({s_geocode('SELECT id, text FROM texts')})), pts AS (SELECT id, lat, lon FROM g WHERE lat IS NOT NULL AND lon IS NOT NULL),
k AS MATERIALIZED (SELECT * FROM ({s_apart('pts', sql('depots'))})), t AS (SELECT id, node FROM k WHERE rank = 1),
x AS MATERIALIZED (SELECT o.request, o.units, o.at AS origin, d.at AS dest, o.text AS a, d.text AS b, ga.match AS origin_match, gb.match AS dest_match, {s_hav('ga.lat', 'ga.lon', 'gb.lat', 'gb.lon')} / 1000 AS km, ta.node AS from_node, ta.node IS NOT NULL AND tb.node IS NOT NULL AS known
FROM o JOIN d USING (request) JOIN g ga ON ga.id = o.text JOIN g gb ON gb.id = d.text LEFT JOIN t ta ON ta.id = o.text LEFT JOIN t tb ON tb.id = d.text),
p0 AS MATERIALIZED (SELECT * FROM ({s_paths(S_EDGES, 'SELECT node AS origin FROM t WHERE id IN (SELECT text FROM o)')})),
n1 AS MATERIALIZED (SELECT * FROM ({s_l1('pts', S_L1_NODES)})), p1 AS MATERIALIZED (SELECT * FROM ({s_paths(S_L1_EDGES, 'SELECT node AS origin FROM n1 WHERE id IN (SELECT text FROM o)')})),
l0 AS (SELECT x.a, x.b, min(struct_pack(s := p.seconds, m := p.metres)) AS leg FROM (SELECT DISTINCT a, b, from_node FROM x WHERE known AND km <= {C.L0_MAX_KM}) x JOIN k ON k.id = x.b JOIN p0 p ON p.origin = x.from_node AND p.node = k.node GROUP BY 1, 2),
l1 AS (SELECT x.a, x.b, struct_pack(s := p.seconds, m := p.metres) AS leg FROM (SELECT DISTINCT a, b FROM x WHERE known) x JOIN n1 f ON f.id = x.a JOIN n1 g ON g.id = x.b JOIN p1 p ON p.origin = f.node AND p.node = g.node),
y AS (SELECT x.*, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN coalesce(l0.leg, l1.leg) IS NULL THEN 'ZERO_RESULTS' ELSE 'OK' END AS status, CASE WHEN NOT known THEN NULL WHEN l0.leg IS NOT NULL THEN 'l0' WHEN l1.leg IS NOT NULL THEN 'l1' END AS router, CASE WHEN known THEN CAST(floor(coalesce(l0.leg, l1.leg).m + 0.5) AS BIGINT) END AS distance_m, CASE WHEN known THEN CAST(floor(coalesce(l0.leg, l1.leg).s + 0.5) AS BIGINT) END AS duration_s
FROM x LEFT JOIN l0 ON l0.a = x.a AND l0.b = x.b LEFT JOIN l1 ON l1.a = x.a AND l1.b = x.b),
z AS (SELECT *, CAST(distance_m AS DOUBLE) AS m, CAST(duration_s AS DOUBLE) AS s FROM y)
SELECT request, CAST(origin AS INTEGER) AS origin, CAST(dest AS INTEGER) AS dest, origin_match, dest_match, status, router, distance_m, duration_s, CASE WHEN m IS NULL THEN NULL WHEN units = 'metric' THEN {S_KM} ELSE {S_DIST} END AS distance_text, CASE WHEN s IS NULL THEN NULL ELSE {S_DUR} END AS duration_text FROM z"""


def answered(spark: SparkSession, sf: str) -> DataFrame:
    edges = materialised(road_edges(spark, sf))
    return matrix.answer(frame(spark, sf, "asked"), stored(spark, sf), segments.sides(frame(spark, sf, "lines")), frame(spark, sf, "depots"), edges, materialised(motorway_edges(spark, sf)))


@query("distance_matrix", S_ANSWER)
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: requests of points and addresses as text, answered by roads and motorways."""
    return answered(spark, sf).select("request", "origin", "dest", "origin_match", "dest_match", "status", "router", "distance_m", "duration_s", "distance_text", "duration_text")


@query("distance_matrix_documents", f"WITH c AS ({S_ANSWER}) SELECT r.request, any_value(r.request_status) AS status, count(c.request) AS elements, CASE WHEN count(c.request) > 0 AND bool_and(c.status = 'OK') THEN '{matrix.CACHED}' ELSE '{matrix.UNCACHED}' END AS cache_control FROM ({S_REQUESTS}) r LEFT JOIN c ON c.request = r.request GROUP BY r.request")
def distance_matrix_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole answers; the JSON itself is held to fixed texts in the tests."""
    return matrix.documents(frame(spark, sf, "asked"), answered(spark, sf)).drop("body")


# --- synchronisation

S_FRESH = f"SELECT a.* FROM (SELECT *, row_number() OVER (PARTITION BY state, normalized, lat, lon, tier ORDER BY id) AS n FROM {sql('arrived')}) a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {sql('mirror')} m WHERE m.state = a.state AND m.normalized = a.normalized AND m.lat = a.lat AND m.lon = a.lon AND m.tier = a.tier)"
S_MARKED = f"SELECT m.*, row_number() OVER (PARTITION BY state, normalized, lat, lon, tier ORDER BY id) AS n, EXISTS (SELECT 1 FROM {sql('arrived')} a WHERE m.state = a.state AND m.normalized = a.normalized AND m.lat = a.lat AND m.lon = a.lon AND m.tier = a.tier) AS stays FROM {sql('mirror')} m"
S_DELS = f"SELECT *, CASE WHEN stays THEN 'duplicate' ELSE 'gone' END AS reason FROM ({S_MARKED}) WHERE NOT stays OR n > 1"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sync.keyed(frame(spark, sf, "mirror")), sync.keyed(frame(spark, sf, "arrived"))


@query("delta_plan", f"""WITH i AS (SELECT state, count(*) AS ins FROM ({S_FRESH}) GROUP BY 1), d AS (SELECT state, count(*) AS del_ids FROM ({S_DELS}) GROUP BY 1), m AS (SELECT state, count(*) AS rows_mirror FROM {sql("mirror")} GROUP BY 1),
x AS (SELECT state, rows_mirror, coalesce(ins, 0) AS ins, coalesce(del_ids, 0) AS del_ids FROM m LEFT JOIN i USING (state) LEFT JOIN d USING (state)),
k AS (SELECT state, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS key_ratio FROM (SELECT DISTINCT p.state, p.normalized, p.lat, p.lon, p.tier, EXISTS (SELECT 1 FROM {sql("mirror")} m WHERE m.state = p.state AND m.normalized = p.normalized AND m.lat = p.lat AND m.lon = p.lon AND m.tier = p.tier) AS hit FROM {sql("previous")} p) GROUP BY 1),
f AS (SELECT *, CAST(ins * 2 + del_ids * 2 + ceil(ins / 250) + ceil(del_ids / 250) AS BIGINT) AS forecast, CASE WHEN (del_ids - ins) / rows_mirror > 0.1 THEN 'shrink' END AS p1, CASE WHEN (ins + del_ids) / rows_mirror >= 0.5 THEN 'churn' END AS p2, CASE WHEN key_ratio < 0.95 THEN 'key ratio' WHEN key_ratio IS NULL THEN 'no previous version' END AS p3 FROM x LEFT JOIN k USING (state))
SELECT state, rows_mirror, ins, del_ids, round((ins + del_ids) / rows_mirror, 6) AS churn, round(key_ratio, 6) AS key_ratio, forecast, CAST(sum(forecast) OVER (ORDER BY forecast, state ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative, concat_ws(', ', p1, p3, p2) AS problems FROM f""")
def delta_plan(spark: SparkSession, sf: str) -> DataFrame:
    m, a = _sides(spark, sf)
    p = sync.schedule(sync.plan(m, a, sync.keyed(frame(spark, sf, "previous"))))
    return p.select("state", "rows_mirror", "ins", "del_ids", F.round("churn", 6).alias("churn"), F.round("key_ratio", 6).alias("key_ratio"), F.col("forecast").cast("long").alias("forecast"), F.col("cumulative").cast("long").alias("cumulative"), "problems")


@query("delta_inserts", f"SELECT state, normalized, tier, 1099511627776 + row_number() OVER (PARTITION BY state ORDER BY normalized, lat, lon, tier) AS id FROM ({S_FRESH})")
def delta_inserts(spark: SparkSession, sf: str) -> DataFrame:
    return sync.inserts(*_sides(spark, sf)).select("state", "normalized", "tier", "id")


@query("delta_deletes", f"SELECT state, id, reason FROM ({S_DELS})")
def delta_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return sync.deletes(*_sides(spark, sf)).select("state", "id", "reason")


@query("dup_cleanup", f"SELECT state, normalized, count(*) AS dropped, min(id) AS least FROM ({S_DELS}) WHERE reason = 'duplicate' GROUP BY 1, 2")
def dup_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    m, a = _sides(spark, sf)
    return sync.deletes(m, a).filter("reason = 'duplicate'").join(m.select("state", "id", "normalized"), ["state", "id"]).groupBy("state", "normalized").agg(F.count(F.lit(1)).alias("dropped"), F.min("id").alias("least"))


@query("delta_apply", f"SELECT state, normalized, tier, count(*) AS n FROM (SELECT DISTINCT state, normalized, lat, lon, tier FROM {sql('arrived')}) GROUP BY 1, 2, 3")
def delta_apply(spark: SparkSession, sf: str) -> DataFrame:
    m, a = _sides(spark, sf)
    after = sync.apply(m, sync.inserts(m, a), sync.deletes(m, a))
    return after.groupBy("state", "normalized", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("jitter_buckets", f"WITH g AS (SELECT state, normalized, lat, lon FROM ({S_DELS}) WHERE reason = 'gone'), d AS (SELECT f.state, f.id, min({s_hav('f.lat', 'f.lon', 'g.lat', 'g.lon')}) AS d FROM ({S_FRESH}) f JOIN g ON g.state = f.state AND g.normalized = f.normalized GROUP BY 1, 2) SELECT state, CASE WHEN d < 1 THEN 'lt_1m' WHEN d < 10 THEN '1_10m' ELSE 'gt_10m' END AS bucket, count(*) AS n FROM d GROUP BY 1, 2")
def jitter_buckets(spark: SparkSession, sf: str) -> DataFrame:
    m, a = _sides(spark, sf)
    gone = sync.deletes(m, a).filter("reason = 'gone'").join(m.select("state", "id", "normalized", "lat", "lon"), ["state", "id"])
    return sync.jitter(sync.inserts(m, a), gone)


@query("range_counts", "SELECT o_orderkey // 2000 AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def range_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 2000).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


# --- upstream signals

S_CHANGE = "CASE WHEN prev_job IS NULL AND cur_job IS NULL THEN 'unknown' WHEN prev_job IS NULL THEN 'new' WHEN cur_job IS NULL THEN 'removed' WHEN prev_job <> cur_job THEN 'changed' ELSE 'unchanged' END"


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "signals")
    prev = s.filter("prev_job IS NOT NULL").withColumnRenamed("prev_job", "job")
    cur = s.filter("cur_job IS NOT NULL").withColumnRenamed("cur_job", "job")
    return upstream.compare(prev, cur, ["state", "source"], "job")


@query("upstream_diff", f"SELECT state, change, count(*) AS n FROM (SELECT state, {S_CHANGE} AS change FROM {sql('signals')}) WHERE change <> 'unknown' GROUP BY 1, 2")
def upstream_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).groupBy("state", "change").agg(F.count(F.lit(1)).alias("n"))


@query("upstream_top_states", f"SELECT state, count(*) AS changes FROM (SELECT state, {S_CHANGE} AS change FROM {sql('signals')}) WHERE change NOT IN ('unknown', 'unchanged') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def upstream_top_states(spark: SparkSession, sf: str) -> DataFrame:
    return upstream.top_changes(_compared(spark, sf), "state")


@query("snapshot_merge", f"SELECT state, source, coalesce(cur_job, prev_job) AS job FROM {sql('signals')} WHERE prev_job IS NOT NULL OR cur_job IS NOT NULL")
def snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "signals")
    return upstream.merged(s.filter("prev_job IS NOT NULL").withColumnRenamed("prev_job", "job"), s.filter("cur_job IS NOT NULL").withColumnRenamed("cur_job", "job"), ["state", "source"], "job")


@query("latest_run_per_source", f"SELECT source, run FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY updated DESC, run) AS n FROM {sql('runs')} WHERE layer = 'addresses' AND has_output) WHERE n = 1")
def latest_run_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return upstream.latest(frame(spark, sf, "runs")).select("source", "run")


S_ATTRIBUTED = f"WITH r AS (SELECT DISTINCT source FROM {sql('runs')} WHERE layer = 'addresses' AND has_output), x AS (SELECT upper(string_split(source, '/')[2]) AS state, array_to_string(string_split(source, '/')[3:], '/') AS slug FROM r) SELECT x.state, x.slug, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN r_name END, n_name, 'unknown') AS attribution, n_name IS NOT NULL AS has_attribution, coalesce(n_nationkey % 3 = 0, false) AS has_license FROM x LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) n ON CAST(n.n_nationkey AS VARCHAR) = regexp_extract(x.slug, '(\\d+)$', 1)"


def _attributed(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = n.select(F.col("n_nationkey").cast("string").alias("slug_key"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("layer_attribution"), F.col("n_name").alias("attribution"), F.when(F.col("n_nationkey") % 3 == 0, "open").alias("license"))
    return upstream.attributed(frame(spark, sf, "runs"), known)


@query("attribution_join", S_ATTRIBUTED)
def attribution_join(spark: SparkSession, sf: str) -> DataFrame:
    return _attributed(spark, sf)


@query("attribution_counts", f"SELECT state, count(*) AS sources, count(*) FILTER (has_attribution) AS with_attribution, count(*) FILTER (has_license) AS with_license FROM ({S_ATTRIBUTED}) GROUP BY 1")
def attribution_counts(spark: SparkSession, sf: str) -> DataFrame:
    return upstream.attribution_counts(_attributed(spark, sf))


@query("upstream_lists", f"WITH c AS (SELECT state, source FROM (SELECT *, {S_CHANGE} AS change FROM {sql('signals')}) WHERE change NOT IN ('unknown', 'unchanged')) SELECT state, count(*) AS n, concat(array_to_string(list_sort(list(source))[:20], ' '), CASE WHEN count(*) > 20 THEN concat(' (+', count(*) - 20, ' more)') ELSE '' END) AS listed FROM c GROUP BY 1")
def upstream_lists(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in each state: twenty names and how many more."""
    return upstream.capped(_compared(spark, sf), "state", "source")


# --- limits

PER_WINDOW, WINDOW_S, PER_DAY, ALL_DAY = 2, 3600, 60, 2_000
S_LIMITED = f"""WITH r AS (SELECT seq, ip, CAST(floor(epoch(ts)) AS BIGINT) AS now, elements FROM {sql("requests")}), w AS (SELECT *, now // {WINDOW_S} AS sec, now // 86400 AS day FROM r),
a AS (SELECT *, row_number() OVER (PARTITION BY ip, day, sec ORDER BY seq) AS n FROM w),
b AS (SELECT *, coalesce(sum(CASE WHEN n <= {PER_WINDOW} THEN elements ELSE 0 END) OVER (PARTITION BY ip, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tried FROM a),
c AS (SELECT *, n <= {PER_WINDOW} AND tried < {PER_DAY} AS ok FROM b),
d AS (SELECT *, CAST(coalesce(sum(CASE WHEN ok THEN elements ELSE 0 END) OVER (PARTITION BY ip, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS day_used, CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY ip, day, sec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sec_used FROM c)
SELECT seq, ip, now, elements, ok, CASE WHEN ok THEN NULL WHEN sec_used >= {PER_WINDOW} THEN 'sec' ELSE 'day' END AS blocked_by, sec_used, day_used FROM d"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    now = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return frame(spark, sf, "requests").select("seq", "ip", now.alias("now"), "elements")


@query("limiter_batch", S_LIMITED)
def limiter_batch(spark: SparkSession, sf: str) -> DataFrame:
    return limits.decisions(requests(spark, sf), PER_WINDOW, PER_DAY, WINDOW_S)


@query("limiter_global", f"SELECT seq, day, elements, used < {ALL_DAY} AS ok, least(used, {ALL_DAY}) AS used FROM (SELECT seq, now // 86400 AS day, elements, CAST(coalesce(sum(elements) OVER (PARTITION BY now // 86400 ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM ({S_LIMITED}) WHERE ok)")
def limiter_global(spark: SparkSession, sf: str) -> DataFrame:
    return limits.global_cap(limiter_batch(spark, sf), ALL_DAY)


@query("ratelimit_headers", f"WITH x AS (SELECT seq, now, greatest(0, {PER_WINDOW} - sec_used - CAST(ok AS INTEGER)) AS s, greatest(0, {PER_DAY} - day_used - CASE WHEN ok THEN elements ELSE 0 END) AS d FROM ({S_LIMITED})) SELECT seq, s AS remaining_second, d AS remaining_day, 86400 - now % 86400 AS reset_day, CASE WHEN s <= d THEN {PER_WINDOW} ELSE {PER_DAY} END AS \"limit\", least(s, d) AS remaining, CASE WHEN s <= d THEN 1 ELSE 86400 - now % 86400 END AS reset FROM x")
def ratelimit_headers(spark: SparkSession, sf: str) -> DataFrame:
    return limits.headers(limiter_batch(spark, sf), PER_WINDOW, PER_DAY)


@query("limiter_streaming", S_LIMITED)
def limiter_streaming(spark: SparkSession, sf: str) -> DataFrame:
    """The same decisions by a stateful stream over the requests."""
    source, out, state = (files.landing(spark, f"limiter-{x}") for x in ("requests", "decisions", "state"))
    (r := requests(spark, sf)).write.parquet(source)
    stream = limited(spark.readStream.schema(r.schema).parquet(source), PER_WINDOW, PER_DAY, WINDOW_S)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# --- panels

S_ANSWERS = f"SELECT category, route, provider, min(distance_m) AS distance_m, min(duration_s) AS duration_s FROM {sql('panel')} WHERE status = 'OK' GROUP BY ALL"
S_ROUTE = f"SELECT category, route, median(distance_m) AS med, (max(distance_m) - min(distance_m)) / median(distance_m) * 100 AS spread FROM ({S_ANSWERS}) WHERE distance_m IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "panel").filter("status = 'OK'").groupBy("category", "route", "provider").agg(F.min("distance_m").alias("distance_m"), F.min("duration_s").alias("duration_s"))


@query("panel_spread", f"SELECT category, count(*) AS routes, round(median(spread), 3) AS spread FROM ({S_ROUTE}) GROUP BY 1")
def panel_spread(spark: SparkSession, sf: str) -> DataFrame:
    return panel.spreads(answers(spark, sf), "distance_m").withColumn("spread", F.round("spread", 3))


@query("panel_deviation", f"SELECT a.category, a.provider, round(median((a.distance_m - r.med) / r.med * 100), 3) AS deviation FROM ({S_ANSWERS}) a JOIN ({S_ROUTE}) r USING (category, route) WHERE a.distance_m IS NOT NULL GROUP BY ALL")
def panel_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return panel.deviations(answers(spark, sf), "distance_m").withColumn("deviation", F.round("deviation", 3))


@query("panel_latency_p90", f"SELECT provider, count(*) AS n, median(wall_ms) AS median_ms, list_sort(list(wall_ms))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS p90_ms FROM {sql('panel')} WHERE status = 'OK' AND wall_ms > 0 GROUP BY 1")
def panel_latency_p90(spark: SparkSession, sf: str) -> DataFrame:
    return panel.latencies(frame(spark, sf, "panel"))


@query("panel_wide", f"SELECT category, route, min(distance_m) FILTER (provider = 'A') AS A, min(distance_m) FILTER (provider = 'B') AS B, min(distance_m) FILTER (provider = 'C') AS C, min(distance_m) FILTER (provider = 'D') AS D FROM ({S_ANSWERS}) GROUP BY ALL")
def panel_wide(spark: SparkSession, sf: str) -> DataFrame:
    return panel.wide(answers(spark, sf), ["A", "B", "C", "D"], "distance_m")
