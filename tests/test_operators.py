import heapq
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridhaul.operators import addresses, cache, fulltext, graph, limits, numbering, panel, routing, snap, sync, upstream
from gridhaul.operators.segments import interpolate
from gridhaul.plans import matrix
from gridhaul.sources import files


def test_shortest_paths_fixture(spark):
    edges = spark.createDataFrame([(0, 1, 10.0, 100.0), (1, 2, 20.0, 200.0)], "u long, v long, seconds double, metres double")
    found = {(r.origin, r.node): (r.seconds, r.metres) for r in routing.shortest_paths(spark.createDataFrame([(0,), (2,), (1,)], "origin long"), edges).collect()}
    assert found[0, 2] == (30.0, 300.0) and found[1, 1] == (0.0, 0.0) and (2, 0) not in found


def test_shortest_paths_random(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)): float(rng.randrange(1, 50)) for _ in range(140)}
    rows = [(u, v, w, 2 * w) for (u, v), w in edges.items() if u != v]
    found = {(r.origin, r.node): r.seconds for r in routing.shortest_paths(spark.createDataFrame([(0,), (7,)], "origin long"), spark.createDataFrame(rows, "u long, v long, seconds double, metres double")).collect()}
    for origin in (0, 7):
        best, queue = {}, [(0.0, origin)]
        while queue:
            d, u = heapq.heappop(queue)
            if u not in best:
                best[u] = d
                for a, b, w, _ in rows:
                    if a == u and b not in best:
                        heapq.heappush(queue, (d + w, b))
        assert {n: d for (o, n), d in found.items() if o == origin} == best


def test_shortest_paths_of_many_hops(spark):
    """A road of 500 edges, in one region, in many, in tiles, and a bound that is too low."""
    rows = [(k, k + 1, 1.0, 2.0) for k in range(500)]
    edges, origin = spark.createDataFrame(rows, "u long, v long, seconds double, metres double").coalesce(1), spark.createDataFrame([(0,)], "origin long")
    want = {(k, float(k), 2.0 * k) for k in range(501)}
    tiles = spark.createDataFrame([(k, k // 100) for k in range(501)], "node long, region long")
    for found in (routing.shortest_paths(origin, edges), routing.shortest_paths(origin, edges, regions=tiles)):
        assert {(r.node, r.seconds, r.metres) for r in found.collect()} == want
    with pytest.raises(RuntimeError):
        routing.shortest_paths(origin, edges, 3, region_edges=10)


def test_shortest_paths_over_regions(spark):
    """Paths that leave a region and come back, with ties in time; any split gives the same."""
    rng = random.Random(8)
    rows = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 6)), float(rng.randrange(1, 6))) for _ in range(150)]
    edges, origins = spark.createDataFrame(rows, "u long, v long, seconds double, metres double"), spark.createDataFrame([(0,), (3,), (99,)], "origin long")
    one = sorted(tuple(r) for r in routing.shortest_paths(origins, edges).collect())
    assert one == sorted(tuple(r) for r in routing.shortest_paths(origins, edges, region_edges=30).collect()) and (99, 99, 0.0, 0.0) in one
    assert routing.shortest_paths(origins.limit(0), edges).count() == 0


def plain_paths(rows, origin):
    """rows: (u, v, seconds, metres)."""
    out, best, queue = {}, {}, [((0.0, 0.0), origin)]
    for u, v, s, m in rows:
        out.setdefault(u, []).append((v, s, m))
    while queue:
        d, u = heapq.heappop(queue)
        if u not in best:
            best[u] = d
            for v, s, m in out.get(u, ()):
                if v not in best:
                    heapq.heappush(queue, ((d[0] + s, d[1] + m), v))
    return best


def road_grid(side, seed):
    """Nodes 0.02 degrees apart and roads between neighbours, both ways, of speeds from 10 to 30 m/s."""
    rng = random.Random(seed)
    nodes = [(x * side + y, 40 + 0.02 * y, -100 + 0.02 * x) for x in range(side) for y in range(side)]
    rows = []
    for x in range(side):
        for y in range(side):
            for v in ([(x + 1) * side + y] if x + 1 < side else []) + ([x * side + y + 1] if y + 1 < side else []):
                metres = 2224.0 if v == x * side + y + 1 else 1800.0
                rows += [(a, b, round(metres / rng.uniform(10, 30), 1), metres) for a, b in ((x * side + y, v), (v, x * side + y))]
    return nodes, rows


@pytest.mark.parametrize("region_edges", [100_000, 900])
def test_routes_aim_and_stop(spark, region_edges):
    """Times and lengths of a plain search, for few goals, many goals, goals of several nodes and unreachable ones, from a small share of its labels."""
    nodes, rows = road_grid(40, 3)
    table = spark.createDataFrame([*nodes, (5000, 41.0, -99.0), (5001, None, None)], "id long, lat double, lon double")
    edges = spark.createDataFrame(rows, "u long, v long, seconds double, metres double")
    at = {n: (lat, lon) for n, lat, lon in nodes} | {5000: (41.0, -99.0), 5001: (None, None)}
    asked = [(0, "near", 82), (0, "near", 121), (0, "near", 121), (820, "far", 1590), (820, "self", 820), (1599, "nowhere", 5000), (1599, "lost", 5001), (1599, "found", 1597), (None, "x", 3), (5, None, 3), (5, "none", None)]
    asked += [(40, f"g{k}", k) for k in range(300)] if region_edges > 1000 else []
    goals = spark.createDataFrame([(o, g, n, *at.get(n, (None, None))) for o, g, n in asked], "origin long, goal string, node long, lat double, lon double")
    road = routing.Graph(edges, table, region_edges=region_edges)
    want = {}
    for o, g, n in asked:
        if None not in (o, g, n) and n in (best := plain_paths(rows, o)):
            want[o, g] = min(want.get((o, g), best[n]), best[n])
    found = {(r.origin, r.goal): (r.seconds, r.metres) for r in routing.routes(goals, road).collect()}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    if region_edges < 1000:
        return
    few = goals.filter("origin IN (0, 820)")
    kept = road.search(few.select("origin"), few).select("origin", "node").distinct().groupBy("origin").count().collect()
    kept = {r.origin: r["count"] for r in kept}
    assert kept[0] < 0.1 * len(nodes) and kept[820] < 0.9 * len(nodes), kept
    assert routing.routes(goals.limit(0), road).count() == 0


def test_cascade(spark):
    leg = "origin long, dest long, seconds double, metres double"
    pairs = spark.createDataFrame([(1, 1, 10.0, True), (1, 2, 10.0, True), (1, 3, 900.0, True), (1, 4, 900.0, True), (1, 5, 1.0, False)], "origin long, dest long, km double, known boolean")
    out = routing.cascade(pairs, spark.createDataFrame([(1, 1, 5.0, 5.0)], leg), spark.createDataFrame([(1, d, 6.0, 6.0) for d in (1, 2, 3)], leg), spark.createDataFrame([(1, 3, 7.0, 7.0)], leg), 500.0)
    assert {r.dest: (r.router, r.status) for r in out.collect()} == {1: ("cache", "OK"), 2: ("l0", "OK"), 3: ("l1", "OK"), 4: (None, "ZERO_RESULTS"), 5: (None, "NOT_FOUND")}


def sequential(rows, per_sec, per_day, second):
    out, state = {}, {}
    for seq, ip, now, n in rows:
        s = state.setdefault(ip, [-1, 0, -1, 0])
        if now // 86400 != s[2]:
            s[2:] = [now // 86400, 0]
        if now // second != s[0]:
            s[:2] = [now // second, 0]
        blocked = "sec" if 0 < per_sec <= s[1] else "day" if 0 < per_day <= s[3] else None
        out[seq] = (blocked, s[1], s[3])
        if not blocked:
            s[1], s[3] = s[1] + 1, s[3] + n
    return out


@pytest.mark.parametrize("per_sec,per_day", [(5, 2500), (2, 30), (0, 30), (3, 0)])
def test_limits_equal_sequence(spark, per_sec, per_day):
    rng, now, rows = random.Random(per_sec), 86_300, []
    for seq in range(600):
        now += rng.choice([0, 0, 1, 40])
        rows.append((seq, rng.randrange(3), now, rng.randrange(0, 26)))
    found = limits.decisions(spark.createDataFrame(rows, "seq long, ip long, now long, elements long"), per_sec, per_day, 10)
    got = {r.seq: (r.blocked_by, r.sec_used if per_sec > 0 else None, r.day_used if per_day > 0 else None) for r in found.collect()}
    want = {k: (b, s if per_sec > 0 else None, d if per_day > 0 else None) for k, (b, s, d) in sequential(rows, per_sec, per_day, 10).items()}
    assert got == want


def test_limit_cases(spark):
    def run(rows, per_sec, per_day):
        df = spark.createDataFrame([(k, 1, *r) for k, r in enumerate(rows)], "seq long, ip long, now long, elements long")
        return [(r.ok, r.blocked_by) for r in limits.decisions(df, per_sec, per_day).orderBy("seq").collect()]

    assert run([(0, 10)] * 6, 5, 2500) == [(True, None)] * 5 + [(False, "sec")]
    assert run([(0, 10), (1, 10), (2, 10), (3, 10)], 0, 30) == [(True, None)] * 3 + [(False, "day")]
    day = spark.createDataFrame([(k, 1, k, n, True) for k, n in enumerate([20, 25, 1])], "seq long, ip long, now long, elements long, ok boolean")
    assert [(r.ok, r.used) for r in limits.global_cap(day, 30).orderBy("seq").collect()] == [(True, 0), (True, 20), (False, 30)]


def test_merge_truncates_towards_zero(spark):
    rows = [("S", "NAD", 1, "a", 0.00005, -0.00005), ("S", "OA", 1, "a", -0.00004, 0.00009), ("S", "OSM", 1, "a", 0.00011, 0.0), ("S", "OA", 2, "b", 1.0, 1.0), ("S", "OA", 3, "b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "state string, source string, seq long, normalized string, lat double, lon double")
    out = addresses.merge_sources(addresses.distinct_in_source(df, ["OA", "OSM"]), ["NAD", "OA", "OSM"]).orderBy("id").collect()
    assert [(r.id, r.source, r.normalized, r.tier) for r in out] == [(1, "NAD", "a", "rooftop"), (2, "OA", "b", "rooftop"), (3, "OSM", "a", "interpolated")]


def test_interpolation(spark):
    asked = spark.createDataFrame([(1, "TX", 15, "oak st", "2"), (2, "TX", 7, "oak st", None), (3, "TX", 7, "elm st", None), (4, "CA", 15, "oak st", "2"), (5, None, 15, "oak st", "2")], "id long, state string, number long, street string, zip string")
    rows = [(1, "TX", "oak st", "L", "1", 10, 20, 0.0, 0.0, 1.0, 2.0), (2, "TX", "oak st", "R", "2", 10, 30, 0.0, 0.0, 4.0, 4.0), (3, "TX", "oak st", "L", "1", 7, 7, 0.0, 0.0, 1.0, 1.0), (9, "CA", "oak st", "L", "1", 15, 15, 8.0, 8.0, 8.0, 8.0)]
    seg = spark.createDataFrame(rows, "id long, state string, street string, side string, zip string, from_hn long, to_hn long, from_lat double, from_lon double, to_lat double, to_lon double")
    assert {r.id: (r.segment, r.lat, r.lon) for r in interpolate(asked, seg).collect()} == {1: (2, 1.0, 1.0), 2: (3, 0.5, 0.5), 4: (9, 8.0, 8.0)}


def test_snap_apart(spark):
    points = spark.createDataFrame([(1, 37.0, -122.0)], "id long, lat double, lon double")
    nodes = spark.createDataFrame([(1, 37.0001, -122.0), (2, 37.0002, -122.0), (3, 37.003, -122.0), (4, 37.0031, -122.0), (5, 36.99, -122.0)], "id long, lat double, lon double")
    assert [r.node for r in snap.nearest_apart(points, nodes, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert [r.node for r in snap.nearest(points, nodes, 2).orderBy("rank").collect()] == [1, 2]


def test_snap_apart_beyond_a_crowd(spark):
    """A hundred nodes at one spot don't hide those farther off."""
    points = spark.createDataFrame([(1, 37.0, -122.0)], "id long, lat double, lon double")
    nodes = spark.createDataFrame([(k, 37.0, -122.0) for k in range(100)] + [(200, 37.003, -122.0), (201, 36.99, -122.0)], "id long, lat double, lon double")
    assert [(r["rank"], r.node) for r in snap.nearest_apart(points, nodes).orderBy("rank").collect()] == [(1, 0), (2, 200), (3, 201)]


def test_sync_plan_replays_to_nothing(spark):
    schema = "state string, id long, normalized string, lat double, lon double, tier string"
    mirror = sync.keyed(spark.createDataFrame([("S", k, f"n{k % 7}", 1.0, 2.0, "t") for k in range(10)] + [("S", 90, "gone", 1.0, 2.0, None)], schema))
    arrived = sync.keyed(spark.createDataFrame([("S", k, f"n{k}", 1.0, 2.0, "t") for k in range(9)] + [("S", 99, "n8", 1.0, 2.0, "t")], schema))
    ins, dels = sync.inserts(mirror, arrived), sync.deletes(mirror, arrived)
    after = sync.apply(mirror, ins, dels)
    assert {r.normalized for r in after.collect()} == {f"n{k}" for k in range(9)} and after.count() == 9
    assert sorted((r.id, r.reason) for r in dels.collect()) == [(7, "duplicate"), (8, "duplicate"), (9, "duplicate"), (90, "gone")]
    assert sync.inserts(after, arrived).isEmpty() and sync.deletes(after, arrived).isEmpty()
    assert sync.apply(after, ins, dels).count() == 9
    plan = sync.plan(mirror, arrived, mirror).first()
    assert (plan.ins, plan.del_ids, plan.key_ratio, plan.problems) == (2, 4, 1.0, "shrink, churn")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,normalized,lat,lon,tier\n1,a,1.5,2,rooftop\n2,b,x,2,rooftop\n3,c\n")
    assert [r.id for r in files.read_addresses(spark, str(tmp_path / "a.csv")).collect()] == [1]
    (tmp_path / "f.geojson").write_text('{"properties":{"number":"1","street":"Oak"},"geometry":{"type":"Point","coordinates":[2.0,1.0]}}\n{bad\n{"properties":{"number":"","street":"Oak"},"geometry":{"coordinates":[2.0,1.0]}}\n')
    assert [(r.lat, r.lon) for r in files.read_features(spark, str(tmp_path / "f.geojson")).collect()] == [(1.0, 2.0)]
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "state string, id int")
    files.write_by_state(rows, str(tmp_path / "out"))
    files.write_by_state(rows.filter("state = 'B'").withColumn("id", F.lit(3)), str(tmp_path / "out"))
    assert sorted((r.state, r.id) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == [("A", "1"), ("B", "3")]


def test_snap_goes_on_until_something_is_near(spark):
    """A node 0.05 degrees off, one 0.4 off, one out of reach; seventy nodes within 200 m of each other."""
    points = spark.createDataFrame([(1, 37.0, -122.0), (2, 50.0, -100.0), (3, -60.0, 10.0)], "id long, lat double, lon double")
    nodes = spark.createDataFrame([(1, 37.05, -122.0), (2, 37.0, -121.6), (3, 50.0, -98.9)] + [(100 + k, -60.0 + k / 1e5, 10.0) for k in range(70)] + [(300, -60.01, 10.0)], "id long, lat double, lon double")
    assert {(r.id, r["rank"], r.node) for r in snap.nearest(points, nodes, 2).collect()} == {(1, 1, 1), (1, 2, 2), (3, 1, 100), (3, 2, 101)}
    assert {(r.id, r["rank"], r.node) for r in snap.nearest_apart(points, nodes, 3).collect()} == {(1, 1, 1), (1, 2, 2), (3, 1, 100), (3, 2, 300)}
    l1 = {r.id: (r.node, r.ring) for r in snap.nearest_l1(points, nodes).collect()}
    assert l1[1][0] == 1 and l1[3][0] == 100 and 2 not in l1
    some = spark.createDataFrame([(300, 1)], "u long, v long")
    assert [r.id for r in snap.with_exits(nodes, some).collect()] == [300]


def test_snap_equals_brute_force(spark):
    rng = random.Random(12)
    points = [(k, 60 + rng.random(), 20 + rng.random()) for k in range(30)]
    nodes = [(k, 60 + rng.random() * rng.random(), 20 + rng.random()) for k in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    every = make(points).crossJoin(make(nodes).toDF("node", "a", "b")).select("id", "node", snap.geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("m")).collect()
    want = {(i, r + 1, n) for i, _, _ in points for r, (_, n) in enumerate(sorted((x.m, x.node) for x in every if x.id == i)[:3])}
    assert {(r.id, r["rank"], r.node) for r in snap.nearest(make(points), make(nodes), 3).collect()} == want


def test_missing_tags_close_nothing(spark):
    ways = spark.createDataFrame([(1, 0, 1, 0, 0, "primary", None, None, None), (1, 1, 2, 0, 0, "primary", None, None, None), (2, 0, 2, 0, 0, "primary", "30", "yes", None), (2, 1, 3, 0, 0, "primary", "30", "yes", None), (3, 0, 1, 0, 0, "primary", None, None, "private"), (3, 1, 3, 0, 0, "primary", None, None, "private")], "way long, pos int, node long, tie long, tie2 long, highway string, maxspeed string, oneway string, access string")
    nodes = spark.createDataFrame([(1, 37.0, -122.0), (2, 37.01, -122.0), (3, 37.02, -122.0), (4, 1.0, 1.0)], "id long, lat double, lon double")
    assert sorted((r.u, r.v) for r in graph.edges(ways, nodes).collect()) == [(1, 2), (2, 1), (2, 3)]
    assert sorted(r.id for r in graph.needed_nodes(ways, nodes).collect()) == [1, 2, 3]
    states = spark.createDataFrame([("TX", 1, 5.0, 5.0), ("CA", 1, 4.0, 4.0), ("TX", 2, 6.0, 6.0)], "state string, id long, lat double, lon double")
    assert sorted((r.id, r.lat) for r in graph.first_of_states(states).collect()) == [(1, 4.0), (2, 6.0)]


def test_matching_by_the_rarest_token(spark):
    docs = spark.createDataFrame([("S", k, f"{k} elm st tx") for k in range(50)] + [("S", 99, "7 7 oak st tx"), ("T", 7, "7 elm st tx")], "shard string, id long, text string")
    asked = spark.createDataFrame([(1, "S", "7 ELM st"), (2, "S", "7 st"), (3, "S", "7 nowhere"), (4, "S", ""), (5, "T", "elm, elm")], "q long, shard string, text string")
    found = fulltext.match_all(asked, fulltext.postings(docs)).collect()
    assert {(r.q, r.id) for r in found} == {(1, 7), (2, 7), (2, 99), (5, 7)}
    tiers = docs.select("shard", "id", F.lit("rooftop").alias("tier"))
    assert {r.q: r.id for r in fulltext.ranked(asked, fulltext.postings(docs), tiers).collect()} == {1: 7, 2: 99, 5: 7}


def test_numbers_run_through_pieces(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(400)]
    found = numbering.numbered(spark.createDataFrame(rows, "g string, x long, y long"), ["g"], F.floor(F.col("x") / 100), ["x", "y"], "n").collect()
    for g in ("a", "b", None):
        mine = sorted((r.x, r.y, r.n) for r in found if r.g == g)
        assert [n for _, _, n in mine] == list(range(1, len(mine) + 1))


def test_medians(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([1.0, 2.0, rng.random() * 1e6, None])) for g in "abc" for _ in range(rng.randrange(1, 300))] + [("one", 5.0), ("same", 2.0), ("same", 2.0)]
    found = {r.g: (r.n, r.median) for r in panel.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        mine = [v for k, v in rows if k == g and v is not None]
        assert not mine or found[g] == (len(mine), pytest.approx(statistics.median(mine)))
    wide = spark.createDataFrame([("c", 1, 5.0, None)], "category string, route long, A double, B double")
    assert [tuple(r) for r in panel.long(wide, ["A", "B"], "d").collect()] == [("c", 1, "A", 5.0)]


def test_leg_cache(spark):
    legs = spark.createDataFrame([(1, 2, 5.0, 50.0, "OK"), (1, 3, None, None, "ZERO_RESULTS")], "origin long, dest long, seconds double, metres double, status string")
    entries = cache.leg_entries(legs, "v1", 1000).unionByName(cache.leg_entries(legs.withColumn("seconds", F.lit(9.0)), "v1", 2000))
    asked = legs.select("origin", "dest")
    assert [tuple(r) for r in cache.cached_legs(asked, entries, "v1", 3000).collect()] == [(1, 2, 9.0, 50.0)]
    assert cache.cached_legs(asked, entries, "v2", 3000).isEmpty() and cache.cached_legs(asked, entries, "v1", 2000 + cache.TTL_S).isEmpty()
    broken = entries.withColumn("value", F.lit("{"))
    assert cache.cached_legs(asked, broken, "v1", 3000).isEmpty()
    found = spark.createDataFrame([("a", "rooftop", 1.0, 2.0), ("b", "NOT_FOUND", None, None), ("1,2", "coords", 1.0, 2.0)], "normalized string, match string, lat double, lon double")
    assert [r.v.match for r in cache.live(cache.geocode_entries(found, "v1", 0), cache.POINT, 5).collect()] == ["rooftop"]


def test_signals_and_reports(spark):
    compared = spark.createDataFrame([("TX", f"s{k:02}", "changed" if k % 2 else "new") for k in range(23)] + [("CA", "x", "unchanged"), ("CA", "y", "removed")], "state string, source string, change string")
    assert {r.state: (r.n, r.listed) for r in upstream.capped(compared, "state", "source").collect()} == {"TX": (23, " ".join(f"s{k:02}" for k in range(20)) + " (+3 more)"), "CA": (1, "y")}
    assert [upstream.exit_code(x, f).first().code for x, f in ((compared, 0), (compared, 2), (compared.limit(0), 0))] == [3, 1, 0]
    nested = spark.createDataFrame([(1, {"a": {"b": {"c": 5}}, "d": {"e": {"f": 6}}})], "id long, m map<string,map<string,map<string,long>>>")
    assert sorted((r.path, r.value) for r in upstream.flatten(nested, "m", 3).collect()) == [("a/b/c", 5), ("d/e/f", 6)]
    lines = spark.createDataFrame([(x,) for x in ["# Title", "| cat | n | off |", "|---|---|---|", "| long | 3 | +1.5% |", "| short | — | -2% |", "| broken |"]], "value string")
    rows = files.table_rows(lines, ["cat", "n", "off"])
    assert [tuple(r) for r in rows.select("cat", "n", files.number_of(F.col("off"))).collect()] == [("long", "3", 1.5), ("short", None, -2.0)]


def test_tables_are_read_back(spark, tmp_path):
    edges = spark.createDataFrame([(1, 5, 0, 2, 9.0), (2, 6, 0, 3, 8.0), (1, 5, 1, 4, 7.0)], "u_tx int, u_ty int, u_dense int, v long, seconds double")
    files.write_tiles(edges, str(tmp_path / "tiles"))
    assert files.read_tiles(spark, str(tmp_path / "tiles")).count() == 3
    some = files.read_tiles(spark, str(tmp_path / "tiles"), spark.createDataFrame([(1, 5), (9, 9)], "tx int, ty int"))
    assert sorted(r.v for r in some.collect()) == [2, 4]
    mirror = spark.createDataFrame([("A", f"k{9 - k}", k) for k in range(5)] + [("B", "k", 7)], "state string, key string, id long")
    files.write_mirror(mirror, str(tmp_path / "mirror"))
    assert [r.key for r in files.read_mirror(spark, str(tmp_path / "mirror"), "A").collect()] == sorted(f"k{9 - k}" for k in range(5))
    l1 = spark.createDataFrame([(2, 1, 7, 9), (1, 2, 7, 9)], "u long, v long, seconds long, decametres long")
    files.write_overlay(l1, str(tmp_path / "l1"))
    assert sorted(tuple(r) for r in files.read_overlay(spark, str(tmp_path / "l1")).collect()) == [(1, 2, 7.0, 90.0), (2, 1, 7.0, 90.0)]


def test_unchanged_states_are_left_out(spark):
    rows = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("B", 1, "z")], "state string, id long, t string")
    stored = files.state_digests(rows.orderBy(F.desc("id")))
    assert files.changed_states(rows, stored).isEmpty()
    new = rows.withColumn("t", F.when(F.col("state") == "B", "zz").otherwise(F.col("t")))
    assert [r.state for r in files.changed_states(new, stored).collect()] == ["B"]
    live = spark.createDataFrame([("B",)], "state string")
    with pytest.raises(ValueError, match="B"):
        files.changed_states(new, stored, live)
    assert files.changed_states(new, stored, live, override=True).count() == 1


def test_pages_and_resumption(spark):
    rows = spark.createDataFrame([(k * 3,) for k in range(10)], "id long")
    seen, at = [], -1
    while page := [r.id for r in sync.pages(rows, at, 4).collect()]:
        seen, at = seen + page, page[-1]
    assert seen == [k * 3 for k in range(10)]
    mirror = spark.createDataFrame([("S", 1), ("S", 100)], "state string, id long")
    left = sync.resumed(mirror, spark.createDataFrame([("S", 100), ("S", 101)], "state string, id long"), spark.createDataFrame([("S", 1), ("S", 2)], "state string, id long")).first()
    assert (left.ins, left.del_ids) == (1, 1)


def test_authority_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("State,Add_Number,AddNo_Full,StNam_Full,St_PreDir,St_Name,St_PosTyp,Inc_Muni,Post_City,Zip_Code,Plus_4,Longitude,Latitude\ntx,5,5 B,,North,Elm,Street,,Fairview,75090,0,-97.5,32.5\nXX,5,,Elm St,,,,,,,,-97.5,32.5\nTX,6,,Oak Ave,,,,Oakdale,Fairview,,12,-97.5,32.5\nTX,,,Oak Ave,,,,,,,,-97.5,32.5\n")
    rows = addresses.address_rows(files.read_authority(spark, str(tmp_path / "a.csv")))
    assert sorted((r.state, r.normalized, r.lat) for r in rows.collect()) == [("TX", "5 b n elm st, fairview, tx 75090", 32.5), ("TX", "6 oak ave, oakdale, tx", 32.5)]


def test_matrix_from_text_to_answer(spark):
    """One road of three nodes, a motorway far away, addresses by number; every status, the JSON and whether it may be cached."""
    nodes = spark.createDataFrame([(1, 32.5, -97.5), (2, 32.51, -97.5), (3, 32.52, -97.5), (10, 40.0, -80.0), (11, 40.1, -80.0)], "id long, lat double, lon double")
    edge = "u long, v long, seconds double, metres double"
    edges = spark.createDataFrame([(1, 2, 60.0, 1100.0), (2, 3, 60.0, 1100.0)], edge)
    l1 = spark.createDataFrame([(10, 11, 300.0, 11000.0), (11, 10, 300.0, 11000.0)], edge)
    stored = spark.createDataFrame([("TX", 1, "27 quarry st, fairview, tx 75090", "rooftop", 32.51, -97.5)], "shard string, id long, text string, tier string, lat double, lon double")
    seg = spark.createDataFrame([(1, "TX", "elm st", "L", "75090", 10, 20, 32.52, -97.5, 32.52, -97.5)], "id long, state string, street string, side string, zip string, from_hn long, to_hn long, from_lat double, from_lon double, to_lat double, to_lon double")
    asked = spark.createDataFrame([
        (1, "32.5,-97.5", "27 Quarry Street, Fairview, TX | 15 Elm St, Fairview, TX 75090", "metric"), (2, "32.52,-97.5|Nowhere", "32.5,-97.5", "imperial"), (3, "40.0,-80.0", "40.1,-80.0", "imperial"),
        (4, "", "1,2", "metric"), (5, "1,2|" * 6, "3,4|" * 5, "metric"), (6, "32.5,-97.5", "0,0", "metric"), (7, None, None, None),
    ], "request long, origins string, destinations string, units string")
    entries = cache.leg_entries(spark.createDataFrame([(10, 11, 240.0, 10000.0, "OK")], edge.replace("u long, v", "origin long, dest") + ", status string"), "v1", 0)
    cells = matrix.answer(asked, stored, seg, nodes, edges, l1, entries, "v1", 100, k=1)
    got = {(r.request, r.origin, r.dest): (r.status, r.router, r.distance_m, r.duration_text, r.origin_match, r.dest_match) for r in cells.collect()}
    assert got == {
        (1, 0, 0): ("OK", "l0", 1100, "1 min", "coords", "rooftop"), (1, 0, 1): ("OK", "l0", 2200, "2 mins", "coords", "interpolated"), (2, 0, 0): ("ZERO_RESULTS", None, None, None, "coords", "coords"),
        (2, 1, 0): ("NOT_FOUND", None, None, None, "NOT_FOUND", "coords"), (3, 0, 0): ("OK", "cache", 10000, "4 mins", "coords", "coords"), (6, 0, 0): ("NOT_FOUND", None, None, None, "coords", "coords"),
    }
    out = {r.request: r for r in matrix.documents(asked, cells).collect()}
    assert {k: (r.status, r.elements, r.cache_control) for k, r in out.items()} == {
        1: ("OK", 2, matrix.CACHED), 2: ("OK", 2, matrix.UNCACHED), 3: ("OK", 1, matrix.CACHED), 4: ("INVALID_REQUEST", 0, matrix.UNCACHED), 5: ("MAX_ELEMENTS_EXCEEDED", 0, matrix.UNCACHED), 6: ("OK", 1, matrix.UNCACHED), 7: ("INVALID_REQUEST", 0, matrix.UNCACHED),
    }
    body = json.loads(out[1].body)
    assert body["origin_addresses"] == ["32.5,-97.5"] and body["destination_addresses"] == ["27 quarry st fairview tx", "15 elm st fairview tx 75090"] and body["destination_matches"] == ["rooftop", "interpolated"]
    assert body["rows"] == [{"elements": [{"distance": {"text": "1.1 km", "value": 1100}, "duration": {"text": "1 min", "value": 60}, "status": "OK"}, {"distance": {"text": "2.2 km", "value": 2200}, "duration": {"text": "2 mins", "value": 120}, "status": "OK"}]}]
    assert json.loads(out[2].body)["rows"] == [{"elements": [{"status": "ZERO_RESULTS"}]}, {"elements": [{"status": "NOT_FOUND"}]}] and json.loads(out[2].body)["origin_addresses"][1] == "Nowhere"
