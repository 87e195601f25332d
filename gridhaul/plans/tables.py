"""The tables that the registered queries read, derived from the order tables by the same expressions in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(index: str, values: list[str]) -> str:
    """CASE that gives values[index % len(values)]."""
    return f"CASE ({index}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


STREETS = ["Main", "Elm", "Harbor", "Copper Kettle", "Juniper", "Washington", "Quarry", "Saint Olaf", "Lake Shore", "Sycamore"]
KINDS = ["Street", "Avenue", "Blvd.", "Road", "Dr", "Lane", "Ct.", "Parkway", "Way", "Plaza", "St.", "Ter"]
SIDES = ["", "North ", "S ", "West ", "NE ", ""]
CITIES = ["Fairview", "Springdale", "Granite Falls", "South Bend", "Oakdale", "Cedar Rapids", "Pinehurst"]
STATES = ["CA", "NY", "TX", "MA", "WA", "FL", "VA", "OH"]
SPEEDS = ["50 mph", "30", "45 km/h", "none", "0", " 25 MPH ", "12.5", "80kmh", "signals", ""]
CLASSES = ["motorway", "trunk", "primary", "residential", "motorway_link", "footway", "service", "tertiary"]


def _address(key: str) -> dict[str, str]:
    return {
        "number": f"CAST(1 + ({key} * 13) % 900 AS STRING)",
        "street": f"concat({pick(key, SIDES)}, {pick(f'{key} * 7', STREETS)}, ' ', {pick(f'{key} * 5', KINDS)})",
        "city": pick(f"{key} * 3", CITIES),
        "state": pick(f"{key} * 11", STATES),
        "zip": f"lpad(CAST(1000 + ({key} * 7919) % 98000 AS STRING), 5, '0')",
    }


def _point(key: str, a: int, b: int) -> list[str]:
    return [f"25 + (({key} * {a} + 13) % 240000) / 1e4 AS lat", f"-124 + (({key} * {b} + 29) % 560000) / 1e4 AS lon"]


def _columns(parts: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in parts.items()]


_C, _S = _address("c_custkey"), _address("s_suppkey")
_FULL = f"concat({_C['number']}, ' ', {_C['street']}, ', ', {_C['city']}, ', ', {_C['state']}, ' ', {_C['zip']})"
_TEXT = (
    f"CASE c_custkey % 9 WHEN 0 THEN concat({_C['city']}, ' ', {_C['state']}) WHEN 1 THEN {_C['zip']} WHEN 2 THEN concat({_C['zip']}, ' ', lower({_C['state']})) "
    f"WHEN 3 THEN concat('  ', {_C['number']}, 'a   ', {_C['street']}, ' ,', {_C['city']}) WHEN 4 THEN concat({_C['number']}, ' ', {_C['street']}, ', ', {_C['city']}, ', Virginia') "
    f"WHEN 5 THEN concat({_C['number']}, ' ', {_C['street']}, ' ', {_C['zip']}) WHEN 6 THEN '' ELSE {_FULL} END"
)

def _asked_point(key: str) -> str:
    lat, lon = (x.rsplit(" AS ", 1)[0] for x in _point(key, 6151, 7529))
    return f"printf('%.4f', {lat}), ',', printf('%.4f', {lon})"


def _asked_address(key: str) -> str:
    a = _address(key)
    return f"{a['number']}, ' ', {a['street']}, ', ', {a['city']}, ', ', {a['state']}, ' ', {a['zip']}"


#: Requests of two origins and three destinations: points near depots, addresses, one that is nowhere; some are invalid or too large.
_ORIGINS = f"CASE WHEN s_suppkey % 19 = 18 THEN repeat('1,2|', 14) ELSE concat({_asked_point('(s_suppkey % 25)')}, ' | ', {_asked_address('(s_suppkey % 20)')}) END"
_DESTINATIONS = f"CASE WHEN s_suppkey % 17 = 16 THEN ' | ' ELSE concat({_asked_point('(s_suppkey * 3 + 1) % 100')}, '|', {_asked_address('((s_suppkey * 7) % 100)')}, CASE s_suppkey % 3 WHEN 0 THEN '|Main St, Springdale' WHEN 1 THEN '|0.0,0.0' ELSE '' END) END"

#: name: (source, expressions)
TABLES: dict[str, tuple[str, list[str]]] = {
    "places": ("customer", ["c_custkey AS id", "c_nationkey AS nation", *_point("c_custkey", 7919, 104729)]),
    "depots": ("supplier", ["s_suppkey AS id", "s_nationkey AS nation", *_point("s_suppkey", 6151, 7529)]),
    "near_places": ("customer", ["c_custkey AS id", "37 + ((c_custkey * 7919) % 5000) / 1e4 AS lat", "-122 + ((c_custkey * 104729) % 5000) / 1e4 AS lon"]),
    "near_nodes": ("part", ["p_partkey AS id", "37 + ((p_partkey * 6151) % 5000) / 1e4 AS lat", "-122 + ((p_partkey * 7529) % 5000) / 1e4 AS lon"]),
    "queries": ("customer", ["c_custkey AS id", f"{_TEXT} AS text"]),
    "raw_addresses": (
        "customer",
        ["c_custkey AS id", *_columns(_C), "CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE CAST(1000 + c_custkey % 9000 AS STRING) END AS plus4",
         "CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE CAST(25 + ((c_custkey * 7919) % 240000) / 1e4 AS STRING) END AS lat", "CASE WHEN c_custkey % 19 = 0 THEN '999' ELSE CAST(-124 + ((c_custkey * 104729) % 560000) / 1e4 AS STRING) END AS lon"],
    ),
    "base_addresses": ("customer", ["c_custkey AS seq", "c_custkey % 400 AS k", f"{pick('c_custkey', ['NAD', 'OA', 'OSM'])} AS source", "25 + ((c_custkey % 400) * 7 % 240) / 1e2 + (c_custkey % 3) / 1e5 AS lat", "-124 + ((c_custkey % 400) * 11 % 560) / 1e2 - (c_custkey % 2) / 1e5 AS lon"]),
    "stored": ("supplier", ["s_suppkey AS id", *_columns(_S), *_point("s_suppkey", 6151, 7529), "CASE WHEN s_suppkey % 4 = 0 THEN 'interpolated' ELSE 'rooftop' END AS tier"]),
    "lines": (
        "supplier",
        ["s_suppkey AS id", f"{pick('s_suppkey', STATES)} AS state", f"{_S['street']} AS fullname", "CASE WHEN s_suppkey % 10 = 9 THEN 'P0001' ELSE 'S1400' END AS mtfcc", "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE CAST(1 + (s_suppkey * 13) % 800 AS STRING) END AS lfrom",
         "CAST(60 + (s_suppkey * 17) % 900 AS STRING) AS lto", "concat(CAST(2 + (s_suppkey * 13) % 800 AS STRING), '-A') AS rfrom", "CAST(61 + (s_suppkey * 17) % 900 AS STRING) AS rto", f"{_S['zip']} AS zipl", f"{_S['zip']} AS zipr",
         *[x.replace(" AS lat", " AS from_lat").replace(" AS lon", " AS from_lon") for x in _point("s_suppkey", 7919, 104729)],
         *[x.replace(" AS lat", " AS to_lat").replace(" AS lon", " AS to_lon") for x in _point("(s_suppkey + 1)", 7919, 104729)]],
    ),
    "ways": ("lineitem", ["l_orderkey AS way", "l_linenumber AS pos", "l_suppkey AS node", "l_partkey AS tie", "l_extendedprice AS tie2", f"{pick('l_orderkey', CLASSES)} AS highway", f"{pick('l_orderkey * 3', SPEEDS)} AS maxspeed", f"CASE WHEN l_orderkey % 6 = 5 THEN NULL ELSE {pick('l_orderkey', ['yes', 'no', '', '-1', '1'])} END AS oneway", f"CASE WHEN l_orderkey % 3 = 1 THEN NULL ELSE {pick('l_orderkey', ['', '', '', '', '', '', 'private'])} END AS access"]),
    "panel": ("lineitem", ["l_partkey AS route", "l_shipdate AS day", f"{pick('l_partkey', ['short urban', 'commute', 'inter_city', 'long', 'rural'])} AS category", f"{pick('l_suppkey', ['A', 'B', 'C', 'D'])} AS provider", "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS distance_m", "l_quantity * 60 AS duration_s", "CAST(l_quantity * 10 AS BIGINT) AS wall_ms", "CASE WHEN l_discount > 0.08 THEN 'ERROR' ELSE 'OK' END AS status"]),
    "mirror": ("orders", ["o_orderkey AS id", f"{pick('o_orderkey', STATES)} AS state", "concat('addr ', CAST(o_custkey AS STRING), ' ', o_orderpriority) AS normalized", "CAST(o_orderkey % 7 AS STRING) AS tier", "25 + (o_custkey * 7919 % 240000) / 1e4 AS lat", "-124 + (o_custkey * 104729 % 560000) / 1e4 AS lon"]),
    "arrived": ("orders", ["o_orderkey AS id", f"{pick('o_orderkey', STATES)} AS state", "concat('addr ', CAST(CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 100000 ELSE o_custkey END AS STRING), ' ', o_orderpriority) AS normalized", "CAST(o_orderkey % 7 AS STRING) AS tier", "25 + (o_custkey * 7919 % 240000) / 1e4 + CASE WHEN o_orderkey % 31 = 0 THEN 0.000005 WHEN o_orderkey % 37 = 0 THEN 0.00005 WHEN o_orderkey % 41 = 0 THEN 0.01 ELSE 0 END AS lat", "-124 + (o_custkey * 104729 % 560000) / 1e4 AS lon"]),
    "previous": ("orders", ["o_orderkey AS id", f"{pick('o_orderkey', STATES)} AS state", "concat('addr ', CAST(CASE WHEN o_orderkey % (17 + o_orderkey % 8 * 3) = 0 THEN o_custkey + 200000 ELSE o_custkey END AS STRING), ' ', o_orderpriority) AS normalized", "CAST(o_orderkey % 7 AS STRING) AS tier", "25 + (o_custkey * 7919 % 240000) / 1e4 AS lat", "-124 + (o_custkey * 104729 % 560000) / 1e4 AS lon"]),
    "signals": ("supplier", ["s_suppkey AS id", f"{pick('s_suppkey', STATES)} AS state", "concat('us/', lower(" + pick("s_suppkey", STATES) + "), '/county', CAST(s_suppkey AS STRING)) AS source", "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_suppkey % 97 AS STRING) END AS prev_job", "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 97 + 1 AS STRING) ELSE CAST(s_suppkey % 97 AS STRING) END AS cur_job", "CAST(s_acctbal AS BIGINT) AS size"]),
    "state_nodes": ("lineitem", ["l_suppkey AS id", f"{pick('l_orderkey', STATES)} AS state", "25 + (l_suppkey * 6151 % 240000) / 1e4 + (l_orderkey % 7) / 1e5 AS lat", "-124 + (l_suppkey * 7529 % 560000) / 1e4 + l_linenumber / 1e5 AS lon"]),
    "asked": ("supplier", ["s_suppkey AS request", f"{_ORIGINS} AS origins", f"{_DESTINATIONS} AS destinations", "CASE s_suppkey % 2 WHEN 0 THEN 'metric' ELSE 'imperial' END AS units"]),
    "requests": ("events", ["event_id AS seq", "user_id % 40 AS ip", "ts", "event_id * 7 % 25 + 1 AS elements"]),
    "runs": ("events", ["event_id AS run", f"concat('us/', {pick('user_id', ['ca', 'ny', 'tx'])}, '/', event_type, '_', CAST(user_id % 50 AS STRING)) AS source", "ts AS updated", f"{pick('event_id', ['addresses', 'addresses', 'parcels'])} AS layer", "event_id % 13 <> 0 AS has_output"]),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def sql(name: str) -> str:
    source, columns = TABLES[name]
    return f"(SELECT {', '.join(columns)} FROM {source})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
