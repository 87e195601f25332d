"""More registered queries: fields, keys, signals, corridors, caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhaul.functions import constants as C
from gridhaul.functions import geo, keys
from gridhaul.functions import text as X
from gridhaul.functions.register import register
from gridhaul.operators import addresses, cache, corridor, graph, panel, sync, upstream
from gridhaul.operators.numbering import numbered
from gridhaul.plans.queries import S_EDGES, S_KEPT, S_LINE, S_LOADED, S_NODES, S_TX, S_TY, panel_wide, query, road_edges, s_hav, s_stored
from gridhaul.plans.tables import frame, sql, table
from gridhaul.sources import files

S_NOW = "CAST(floor(epoch(o_orderdate)) AS BIGINT)"


def _seconds(column: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


@query("cache_keys", "SELECT c_custkey AS id, concat('geo4:v1:', sha1(lower(c_name))) AS geo, concat('leg2:v1:', c_custkey, ':', c_nationkey) AS leg, substr(sha256(concat('salt', c_name)), 1, 32) AS caller FROM customer")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), keys.address_cache_key(F.lit("v1"), F.lower("c_name")).alias("geo"), keys.leg_cache_key(F.lit("v1"), F.col("c_custkey"), F.col("c_nationkey")).alias("leg"), keys.caller_key("salt", F.col("c_name")).alias("caller"))


@query("time_buckets", f"SELECT o_orderkey AS id, {S_NOW} // 86400 AS day, 86400 - {S_NOW} % 86400 AS to_midnight, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, (year(o_orderdate) - 2026) * 4 + (month(o_orderdate) - 1) // 3 AS quarter FROM orders")
def time_buckets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _seconds("o_orderdate").alias("s"))
    iso = keys.iso_time(F.col("s"))
    return o.select("id", keys.day_bucket(F.col("s")).alias("day"), keys.to_midnight(F.col("s")).alias("to_midnight"), iso.alias("iso"), X.quarter_index(F.substring(iso, 1, 7)).cast("long").alias("quarter"))


@query("signal_fields", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE md5(s_name) END AS md5, concat('tlgdb_', 2020 + s_suppkey % 10, CASE WHEN 2020 + s_suppkey % 10 >= 2026 THEN '_' ELSE '_a_' END, lpad(CAST(s_nationkey AS VARCHAR), 2, '0'), '.gdb.zip') AS archive, upper(string_split(source, '/')[2]) AS state, array_to_string(string_split(source, '/')[3:], '-') AS slug FROM (SELECT *, concat('us/', CASE s_suppkey % 2 WHEN 0 THEN 'ca' ELSE 'ny' END, '/a', s_suppkey, '/b') AS source FROM supplier)")
def signal_fields(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 3 = 0 THEN concat('x', s_name) ELSE concat(' ', upper(md5(s_name)), '  file.pbf') END AS body", "2020 + s_suppkey % 10 AS vintage", "lpad(CAST(s_nationkey AS STRING), 2, '0') AS fips", "concat('us/', CASE s_suppkey % 2 WHEN 0 THEN 'ca' ELSE 'ny' END, '/a', s_suppkey, '/b') AS source")
    state, slug = keys.source_parts(F.col("source"))
    return s.select("id", keys.md5_of_body(F.col("body")).alias("md5"), keys.shapefile_name(F.col("vintage"), F.col("fips")).alias("archive"), state.alias("state"), slug.alias("slug"))


@query("flatten_signals", "SELECT s_nationkey AS nation, concat('group', s_suppkey % 4, '/', CASE WHEN s_suppkey % 5 = 0 THEN 'Last Update' ELSE concat('k', s_suppkey) END) AS path, count(*) AS n, min(s_suppkey) AS least FROM supplier GROUP BY 1, 2")
def flatten_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Nested maps group -> key -> values to rows by path."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.expr("concat('group', s_suppkey % 4)").alias("g"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'Last Update' ELSE concat('k', s_suppkey) END").alias("k"), "s_suppkey")
    inner = s.groupBy("nation", "g", "k").agg(F.collect_list("s_suppkey").alias("v")).groupBy("nation", "g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    nested = inner.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("g", "m"))).alias("m"))
    return upstream.flatten(nested, "m", 2).select("nation", "path", F.size("value").cast("long").alias("n"), F.array_min("value").alias("least"))


@query("last_update_signal", "SELECT s_nationkey AS nation, min(s_suppkey) AS first FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY 1")
def last_update_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The first leaf of each group's map whose name has 'last update'."""
    s = table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "struct(s_suppkey AS at, CASE WHEN s_suppkey % 5 = 0 THEN concat('Last Update ', s_suppkey) ELSE concat('k', s_suppkey) END AS k) AS leaf")
    hit = F.get(F.filter(F.array_sort(F.collect_list("leaf")), lambda x: F.contains(F.lower(x["k"]), F.lit("last update"))), F.lit(0))
    return s.groupBy("nation").agg(hit["at"].alias("first")).filter("first IS NOT NULL")


@query("needs_download", f"WITH c AS (SELECT * FROM {sql('signals')} WHERE cur_job IS NOT NULL) SELECT source, CASE WHEN prev_job IS NULL THEN 'missing' ELSE 'stale' END AS why FROM c WHERE prev_job IS NULL OR prev_job <> cur_job")
def needs_download(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose current job isn't the one on disk."""
    s = frame(spark, sf, "signals")
    have = s.filter("prev_job IS NOT NULL").select("source", F.col("prev_job").alias("have"))
    joined = s.filter("cur_job IS NOT NULL").select("source", "cur_job").join(have, "source", "left").filter("have IS NULL OR have <> cur_job")
    return joined.select("source", F.when(F.col("have").isNull(), "missing").otherwise("stale").alias("why"))


@query("upstream_status", f"SELECT CASE WHEN count(*) FILTER (c = 'changed' OR c = 'new' OR c = 'removed') > 0 THEN 3 ELSE 0 END AS code, state FROM (SELECT state, CASE WHEN prev_job IS NULL THEN 'new' WHEN cur_job IS NULL THEN 'removed' WHEN prev_job <> cur_job THEN 'changed' ELSE 'unchanged' END AS c FROM {sql('signals')} WHERE prev_job IS NOT NULL OR cur_job IS NOT NULL) GROUP BY state")
def upstream_status(spark: SparkSession, sf: str) -> DataFrame:
    """Exit code by state: 3 where a signal changed, else 0."""
    s = frame(spark, sf, "signals").filter("prev_job IS NOT NULL OR cur_job IS NOT NULL").withColumn("c", upstream.change(F.col("prev_job"), F.col("cur_job")))
    return s.groupBy("state").agg(F.when(F.bool_or(F.col("c") != "unchanged"), 3).otherwise(0).alias("code"))


@query("ledger_totals", "SELECT l_shipdate::DATE AS day, l_returnflag AS db, count(*) AS statements, CAST(sum(l_linenumber) AS BIGINT) AS rows_written, count(*) FILTER (l_linestatus = 'F') AS failed FROM lineitem GROUP BY 1, 2")
def ledger_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("db"))
    return t.agg(F.count(F.lit(1)).alias("statements"), F.sum("l_linenumber").alias("rows_written"), F.count_if(F.col("l_linestatus") == "F").alias("failed"))


@query("listed_shards", "SELECT o_orderkey AS id, o_orderstatus = 'F' AS allowed FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def listed_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Loads onto listed shards, and whether their override flag lets them through."""
    listed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(listed, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("allowed"))


_CITY = ["CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE c_name END AS a", "CASE c_custkey % 2 WHEN 0 THEN NULL ELSE c_mktsegment END AS b", "CAST(c_nationkey AS STRING) AS c"]


@query("field_fallbacks", f"SELECT c_custkey AS id, trim(coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '')) AS city FROM (SELECT c_custkey, {', '.join(_CITY)} FROM customer)")
def field_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Empty text gives way to the next column, blanks don't."""
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", *_CITY)
    return c.select("id", X.filled_or(F.col("a"), F.col("b"), F.col("c")).alias("city"))


@query("authority_rows", f"WITH x AS (SELECT id, state, city, zip, '' AS plus4, {s_stored('number', S_LOADED)} AS number, {s_stored("concat(street, ' BL')", S_LOADED | {'bl': 'blvd'})} AS street, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon FROM {sql('raw_addresses')}) SELECT id, {S_LINE} AS normalized FROM x WHERE abs(lat) <= 90 AND abs(lon) <= 180")
def authority_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a source that knows one suffix more."""
    raw = frame(spark, sf, "raw_addresses").withColumns({"street": F.concat("street", F.lit(" BL")), "plus4": F.lit("")})
    return addresses.address_rows(raw, {"bl": "blvd"}).select("id", "normalized")


S_BOXES = f"SELECT id % 500 AS request, min(lat) AS a, max(lat) AS z, min(lon) AS w, max(lon) AS e FROM {sql('near_places')} GROUP BY 1"


@query("request_corridors", f"WITH b AS ({S_BOXES}), t AS (SELECT request, CAST(floor((w + 180) * 4) AS INTEGER) - 1 AS x0, CAST(floor((e + 180) * 4) AS INTEGER) + 1 AS x1, CAST(floor((a + 90) * 4) AS INTEGER) - 1 AS y0, CAST(floor((z + 90) * 4) AS INTEGER) + 1 AS y1 FROM b), x AS (SELECT request, unnest(generate_series(x0, x1)) AS tx, y0, y1 FROM t WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 16) SELECT request, CAST(tx AS INTEGER) AS tx, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS ty FROM x")
def request_corridors(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of each request's box and around it, of requests that need sixteen at most."""
    points = frame(spark, sf, "near_places").withColumn("request", F.col("id") % 500)
    return corridor.tiles(corridor.bounds(points, "request"), "request")


S_ENDS = f"(SELECT id % 700 AS request, CASE WHEN id % 11 = 0 THEN concat(printf('%.4f', lat), ', ', printf('%.4f', lon)) ELSE concat(printf('%.4f', 37 + (lat - 37) / 40), ',', printf('%.4f', lon)) END AS text FROM {sql('near_places')})"


@query("corridor_requests", f"WITH p AS (SELECT request, regexp_full_match(text, '-?[0-9]{{1,3}}(\\.[0-9]+)?,-?[0-9]{{1,3}}(\\.[0-9]+)?') AS ok, CAST(trim(string_split(text, ',')[1]) AS DOUBLE) AS lat, CAST(trim(string_split(text, ',')[2]) AS DOUBLE) AS lon FROM {S_ENDS}), b AS (SELECT request, bool_and(ok) AS ok, min(lat) AS a, max(lat) AS z, min(lon) AS w, max(lon) AS e FROM p GROUP BY 1) SELECT request, ok AND {s_hav('a', 'w', 'z', 'e')} <= 3000 AS small FROM b")
def corridor_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests all of whose ends are literals close together."""
    text = F.expr("CASE WHEN id % 11 = 0 THEN concat(printf('%.4f', lat), ', ', printf('%.4f', lon)) ELSE concat(printf('%.4f', 37 + (lat - 37) / 40), ',', printf('%.4f', lon)) END")
    return corridor.small_enough(frame(spark, sf, "near_places").select((F.col("id") % 700).alias("request"), text.alias("text")), "request")


@query("router_choice", f"WITH b AS (SELECT nation, min(lat) AS a, max(lat) AS z, min(lon) AS w, max(lon) AS e FROM {sql('places')} GROUP BY 1) SELECT nation, round({s_hav('a', 'w', 'z', 'e')} / 1000, 2) AS km, CASE WHEN {s_hav('a', 'w', 'z', 'e')} <= 3000 THEN 'corridor' WHEN {s_hav('a', 'w', 'z', 'e')} / 1000 <= 500 THEN 'roads' ELSE 'motorways' END AS router FROM b")
def router_choice(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("diagonal_m")
    choice = F.when(d <= 3000, "corridor").when(d / 1000 <= C.L0_MAX_KM, "roads").otherwise("motorways")
    return corridor.bounds(frame(spark, sf, "places"), "nation").select("nation", F.round(d / 1000, 2).alias("km"), choice.alias("router"))


S_LEGS = "SELECT o_custkey AS origin, o_orderkey % 50 AS dest, CASE WHEN o_orderstatus = 'P' THEN 'ZERO_RESULTS' ELSE 'OK' END AS status, CAST(o_orderkey AS DOUBLE) AS seconds, CAST(o_orderkey * 10 AS DOUBLE) AS metres, o_orderdate FROM orders"
NOW = 883_612_800  # 1998-01-01


@query("cache_hits", f"WITH e AS (SELECT origin, dest, seconds, metres, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS stored FROM ({S_LEGS}) WHERE status = 'OK'), l AS (SELECT origin, dest, arg_max(seconds, (stored, seconds)) AS seconds, arg_max(metres, (stored, seconds)) AS metres, max(stored) AS stored FROM e GROUP BY 1, 2) SELECT origin, dest, seconds, metres FROM l WHERE stored + 30 * 86400 > {NOW} AND origin IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Legs stored day by day, OK ones only, and what the cache answers on a day: the last entry of a key, for thirty days."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("origin"), (F.col("o_orderkey") % 50).alias("dest"), F.when(F.col("o_orderstatus") == "P", "ZERO_RESULTS").otherwise("OK").alias("status"), F.col("o_orderkey").cast("double").alias("seconds"), (F.col("o_orderkey") * 10).cast("double").alias("metres"), _seconds("o_orderdate").alias("at"))
    entries = cache.leg_entries(o, "v1", F.col("at"))
    asked = o.join(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("origin")), "origin", "left_semi")
    return cache.cached_legs(asked, entries, "v1", NOW)


@query("near_tile_edges", f"SELECT e.u, e.v, a.dense AS u_dense, b.dense AS v_dense, a.tx = b.tx AND a.ty = b.ty AS inside FROM ({S_EDGES}) e JOIN ({S_NODES}) a ON a.id = e.u JOIN ({S_NODES}) b ON b.id = e.v WHERE abs(a.tx - b.tx) <= 20 AND abs(a.ty - b.ty) <= 20")
def near_tile_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = road_edges(spark, sf)
    near = graph.near_tiles(e, graph.tile_nodes(e, frame(spark, sf, "depots")), 20)
    return near.select("u", "v", "u_dense", "v_dense", ((F.col("u_tx") == F.col("v_tx")) & (F.col("u_ty") == F.col("v_ty"))).alias("inside"))


@query("needed_nodes", f"SELECT id, {S_TX} AS tx, {S_TY} AS ty FROM {sql('depots')} WHERE id IN (SELECT node FROM {sql('ways')} WHERE {S_KEPT}) AND lat BETWEEN -90 AND 90")
def needed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that a drivable way refers to and that have a point."""
    found = graph.needed_nodes(frame(spark, sf, "ways"), frame(spark, sf, "depots"))
    return found.select("id", geo.tile_x(F.col("lon")).alias("tx"), geo.tile_y(F.col("lat")).alias("ty"))


@query("panel_cells", "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN coalesce(l_quantity, 0) = 0 THEN '—' ELSE printf('%.1f', CAST(l_quantity * 1609.344 / 1609.344 AS DOUBLE)) END AS miles, CASE WHEN l_quantity < 3 THEN '—' ELSE printf('%.0f', CAST(l_quantity - 2 AS DOUBLE)) END AS minutes, CASE WHEN l_linenumber = 1 THEN '—' ELSE concat(printf('%+.1f', CAST(l_quantity - 25 AS DOUBLE)), '%') END AS off, count(*) AS n FROM lineitem GROUP BY ALL")
def panel_cells(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), keys.miles(F.col("l_quantity") * 1609.344).alias("miles"), keys.minutes(F.when(F.col("l_quantity") >= 3, (F.col("l_quantity") - 2) * 60)).alias("minutes"), keys.percent(F.when(F.col("l_linenumber") != 1, F.col("l_quantity") - 25.0)).alias("off"))
    return t.groupBy("id", "line", "miles", "minutes", "off").agg(F.count(F.lit(1)).alias("n"))


@query("markdown_rows", "SELECT n_name AS label, n_regionkey AS a, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey + 0.5 AS DOUBLE) END AS b FROM nation")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a rendered table read back: cells by bars, dashes as nothing."""
    n = table(spark, sf, "nation")
    line = n.select(F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" | "), F.when(F.col("n_nationkey") % 4 == 0, "—").otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(".5"))), F.lit(" |")).alias("value"))
    rows = files.table_rows(line, ["label", "a", "b"])
    return rows.select("label", F.col("a").try_cast("int").alias("a"), files.number_of(F.col("b")).alias("b"))


@query("state_rows", f"SELECT state, count(*) AS n, min(id) AS first_id, max(rn) AS last_rank FROM (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY id) AS rn FROM {sql('mirror')}) GROUP BY 1")
def state_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Running ids within a state, as the writers by state give them."""
    m = numbered(frame(spark, sf, "mirror"), ["state"], F.floor(F.col("id") / 100_000), ["id"], "rn")
    return m.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("rn").alias("last_rank"))


@query("tagged_addresses", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'TX' ELSE 'CA' END AS state, concat(c_custkey % 90 + 1, ' ', CASE c_custkey % 2 WHEN 0 THEN 'oak st' ELSE 'n elm ave' END, ', ', lower(c_mktsegment), ', ', CASE WHEN c_custkey % 4 = 0 THEN 'tx' ELSE 'ca' END) AS normalized FROM customer WHERE c_custkey % 3 <> 0")
def tagged_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Map nodes with tags of number and street; the state of the file where no tag has one."""
    tags = F.expr("map_from_entries(filter(array(struct('addr:housenumber' AS key, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 90 + 1 AS STRING) END AS value), struct('addr:street' AS key, CASE c_custkey % 2 WHEN 0 THEN 'Oak Street' ELSE 'North Elm Avenue' END AS value), struct('addr:city' AS key, c_mktsegment AS value), struct('addr:state' AS key, CASE WHEN c_custkey % 4 = 0 THEN 'TX' END AS value)), e -> e.value IS NOT NULL))")
    n = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tags.alias("tags"))
    return addresses.tagged_rows(n, "CA")


@query("request_params", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST((2 + c_custkey % 2) * 1 AS INTEGER) END AS elements, CASE WHEN c_custkey % 3 = 0 THEN 'metric' ELSE 'imperial' END AS units, c_custkey % 5 <> 0 AS valid FROM customer")
def request_params(spark: SparkSession, sf: str) -> DataFrame:
    """Origins, destinations and units of query strings; without either list a request is invalid."""
    url = F.expr("concat('https://host/matrix?origins=1%2C2%7C%20%7C3%2C4', CASE WHEN c_custkey % 2 = 1 THEN '%7CA+St' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '&destinations=5%2C6' END, CASE c_custkey % 3 WHEN 0 THEN '&units=Metric' WHEN 1 THEN '&units=feet' ELSE '' END)")
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), url.alias("url"))
    origins, destinations, units = X.request_parts(F.col("url"))
    n = F.size(X.split_multi(origins)) * F.size(X.split_multi(destinations))
    return r.select("id", n.alias("elements"), units.alias("units"), (n > 0).alias("valid"))


@query("config_values", "SELECT id, CASE WHEN id % 6 = 0 OR id % 6 = 5 THEN 25 WHEN id % 6 = 1 THEN 100 WHEN id % 6 = 4 THEN 7 ELSE 1 END AS n FROM (SELECT c_custkey AS id FROM customer)")
def config_values(spark: SparkSession, sf: str) -> DataFrame:
    """Limits from text: 25 where nothing or no number is given, whole and at least 1."""
    t = F.expr("CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '100' WHEN 2 THEN '0' WHEN 3 THEN '-5' WHEN 4 THEN '7.9' ELSE 'abc' END")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.whole_limit(t, C.MAX_ELEMENTS).alias("n"))


_CELL = "CAST(floor(({c} + {k}) * 100) AS INTEGER)"


@query("grid_offsets", f"WITH c AS (SELECT {_CELL.format(c='lat', k=90)} AS cy, {_CELL.format(c='lon', k=180)} AS cx, count(*) AS n FROM {sql('near_nodes')} GROUP BY 1, 2) SELECT cy, cx, n, CAST(coalesce(sum(n) OVER (PARTITION BY cy // 25, cx // 25 ORDER BY cy, cx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def grid_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of each sub-cell and where they begin within their tile."""
    cell = {a: F.floor((F.col(c) + k) * 100).cast("int") for a, c, k in (("cy", "lat", 90), ("cx", "lon", 180))}
    n = frame(spark, sf, "near_nodes").groupBy(cell["cy"].alias("cy"), cell["cx"].alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.floor(F.col("cy") / 25), F.floor(F.col("cx") / 25)).orderBy("cy", "cx").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("sql_functions", f"SELECT p.id, {S_TX} AS tx, {S_TY} AS ty, CAST(floor({s_hav('lat', 'lon', '37.0', '-122.0')} + 0.5) AS BIGINT) AS metres, round(lat + CASE WHEN id % 9 = 0 THEN 0.5 ELSE (id % 9 / 2.0) / (id % 9) END * (lon - lat), 5) AS mid FROM {sql('places')} p")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The registered SQL functions at work."""
    register(spark)
    p = frame(spark, sf, "places")
    return p.selectExpr("id", "tile_x(lon) AS tx", "tile_y(lat) AS ty", "half_up(haversine_m(lat, lon, 37.0D, -122.0D)) AS metres", "round(lerp(lat, lon, 0, 2 * (id % 9), id % 9), 5) AS mid")


@query("first_state_nodes", f"SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY state, lat, lon) AS n FROM {sql('state_nodes')}) WHERE n = 1")
def first_state_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that several states' files have, once each."""
    return graph.first_of_states(frame(spark, sf, "state_nodes")).select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("row_hashes", "SELECT c_custkey AS id, sha256(concat_ws(chr(31), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR))) AS h FROM customer")
def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), keys.content_hash(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("h"))


@query("panel_long", f"SELECT category, route, provider, min(distance_m) AS distance_m FROM {sql('panel')} WHERE status = 'OK' AND distance_m IS NOT NULL GROUP BY ALL")
def panel_long(spark: SparkSession, sf: str) -> DataFrame:
    """Columns a provider back to rows."""
    return panel.long(panel_wide(spark, sf), ["A", "B", "C", "D"], "distance_m")


@query("keyset_page", f"SELECT id, state, normalized FROM {sql('mirror')} WHERE id > 1000 ORDER BY id LIMIT 500")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of an export by id, after a cursor."""
    return sync.pages(frame(spark, sf, "mirror"), 1000, 500).select("id", "state", "normalized")


@query("tiles_read_back", f"SELECT e.u, e.v, CAST(a.tx AS INTEGER) AS u_tx, CAST(a.ty AS INTEGER) AS u_ty, a.dense AS u_dense FROM ({S_EDGES}) e JOIN ({S_NODES}) a ON a.id = e.u JOIN ({S_NODES}) b ON b.id = e.v WHERE abs(a.tx - b.tx) <= 20 AND abs(a.ty - b.ty) <= 20 AND a.tx % 2 = 0")
def tiles_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Edges written by the tile of their source, and those of some tiles read again."""
    e = road_edges(spark, sf)
    nodes = graph.tile_nodes(e, frame(spark, sf, "depots"))
    path = files.landing(spark, "tiles")
    files.write_tiles(graph.near_tiles(e, nodes, 20), path)
    return files.read_tiles(spark, path, nodes.filter("tx % 2 = 0").select("tx", "ty")).select("u", "v", "u_tx", "u_ty", "u_dense")


@query("mirror_read_back", f"SELECT state, count(*) AS n, min(id) AS low, max(id) AS high FROM {sql('mirror')} GROUP BY 1")
def mirror_read_back(spark: SparkSession, sf: str) -> DataFrame:
    path = files.landing(spark, "mirror")
    files.write_mirror(sync.keyed(frame(spark, sf, "mirror")).select("state", "key", "id"), path)
    return files.read_mirror(spark, path).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


_SAME = "state IN ('CA', 'TX')"
S_RELOADED = f"SELECT state, normalized, tier FROM {sql('mirror')} WHERE {_SAME} UNION ALL SELECT state, normalized, tier FROM {sql('arrived')} WHERE NOT ({_SAME})"


@query("changed_shards", f"WITH n AS (SELECT *, count(*) AS k FROM ({S_RELOADED}) GROUP BY ALL), o AS (SELECT state, normalized, tier, count(*) AS k FROM {sql('mirror')} GROUP BY ALL), c AS (SELECT state FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION SELECT state FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) SELECT state, count(*) AS n FROM ({S_RELOADED}) WHERE state IN (SELECT state FROM c) GROUP BY 1")
def changed_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to load of the states whose content isn't what is stored."""
    kept = ["state", "normalized", "tier"]
    mirror = frame(spark, sf, "mirror").select(*kept)
    rows = mirror.filter(_SAME).unionByName(frame(spark, sf, "arrived").select(*kept).filter(f"NOT ({_SAME})"))
    return files.changed_states(rows, files.state_digests(mirror)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
