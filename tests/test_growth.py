"""Steps whose work must not grow faster than the tables: copies and rows alike are looked at once."""

import pytest
from pyspark.sql import functions as F

from gridhaul.functions import geo
from gridhaul.operators import routing, snap


def test_rounded_goes_by_the_product(spark):
    seconds = 659049.99 / 20  # its product with 1000 lies below a half, its shortest text is 32952.4995
    row = spark.range(1).select(*(geo.rounded(F.lit(x), 3).alias(n) for n, x in (("s", seconds), ("minus", -2.0625), ("half", 2.0625)))).first()
    assert (row.s, row.minus, row.half) == (32952.499, -2.063, 2.063)


@pytest.mark.parametrize("k", [1, 5])
def test_snap_asks_a_position_once(spark, k):
    points = spark.range(400).selectExpr("id", "37.0 + (id % 4) / 100 AS lat", "-122.0 AS lon")
    nodes = spark.range(400).selectExpr("id + 1000 AS id", "37.0 + (id % 4) / 100 AS lat", "-122.0 + (id % 2) / 1000 AS lon")
    seen = []

    def choose(found):
        seen.append(found.count())
        best = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("metres", "node"))).alias("x"))
        return best.select("id", F.posexplode(F.slice("x", 1, k)).alias("rank", "v")).select("id", (F.col("rank") + 1).alias("rank"), "v.node", "v.metres")

    rows = snap._widening(points, nodes, k, choose, k).collect()
    assert sum(seen) <= 4 * 4 * k * 4  # 400 x 400 before
    assert len(rows) == 400 * k and {r.node for r in rows if r.id % 4 == 1 and r["rank"] == 1} == {1001}
    assert sorted((r.id, r["rank"], r.node) for r in rows) == sorted((r.id, r["rank"], r.node) for r in snap.nearest(points, nodes, k).collect())
    assert {r.node for r in snap.nearest_l1(points, nodes).collect()} == {1000, 1001, 1002, 1003}


def test_snap_beyond_its_first_grid(spark):
    """A crowd in the tile makes the first grid fine; points away from it are answered by coarser ones."""
    nodes = spark.range(900).selectExpr("id", "37.01 + floor(id / 30) / 1e4 AS lat", "-122.01 - (id % 30) / 1e4 AS lon")
    points = spark.createDataFrame([(1, 37.2, -122.2), (2, 37.6, -122.01), (3, 37.0101, -122.0101), (4, 39.0, -122.0), (5, None, -122.0)], "id long, lat double, lon double")
    found = {}
    for r in snap.nearest(points, nodes, 3).collect():
        found.setdefault(r.id, []).append((r["rank"], r.node))
    far = points.filter("id < 4").crossJoin(nodes.toDF("node", "a", "b")).select("id", "node", geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("m")).collect()
    for id_ in (1, 2, 3):
        best = sorted((r.m, r.node) for r in far if r.id == id_)[:3]
        assert sorted(found[id_]) == [(n + 1, x[1]) for n, x in enumerate(best)]
    assert set(found) == {1, 2, 3}


def test_interpolate_meets_few_of_many_overlapping_segments(spark):
    """Brute force over ranges that all overlap; a number meets one row a size of blocks and zip."""
    from gridhaul.operators.segments import interpolate

    segs = spark.range(300).selectExpr("300 - id AS id", "'CA' AS state", "'elm st' AS street", "CASE id % 2 WHEN 0 THEN 'L' ELSE 'R' END AS side", "CAST(id % 7 AS STRING) AS zip", "CAST(id % 50 AS INT) AS from_hn", "CAST(id % 50 + (id * 13) % 400 AS INT) AS to_hn", "1.0D * id AS from_lat", "0.0D AS from_lon", "1.0D * id + 1 AS to_lat", "1.0D AS to_lon")
    asked = spark.range(900).selectExpr("id", "'CA' AS state", "id % 450 AS number", "'elm st' AS street", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 9 AS STRING) END AS zip")
    rows, want = segs.collect(), {}
    for a in asked.collect():
        held = [(s.zip != a.zip, s.id, s.side, s) for s in rows if s.from_hn <= a.number <= s.to_hn]
        if held:
            s = min(held, key=lambda x: x[:3])[3]
            t = 0.5 if s.to_hn == s.from_hn else (a.number - s.from_hn) / (s.to_hn - s.from_hn)
            want[a.id] = (s.id, s.from_lat + t * (s.to_lat - s.from_lat), t)
    found = interpolate(asked, segs)
    assert {r.id: (r.segment, r.lat, r.lon) for r in found.collect()} == want and len(want) > 600


def test_queries_of_the_same_words_are_asked_once(spark):
    from gridhaul.operators import fulltext

    docs = spark.range(50).selectExpr("'CA' AS shard", "id", "concat('elm st ', id % 5) AS text")
    asked = spark.range(200).selectExpr("id AS q", "'CA' AS shard", "CASE WHEN id % 2 = 0 THEN '3 Elm st' ELSE 'st elm, 3 elm' END AS text")
    few, named = fulltext.once(asked)
    assert [r.q for r in few.collect()] == [0] and named.count() == 200
    best = fulltext.ranked(asked, fulltext.postings(docs), docs.selectExpr("shard", "id", "'rooftop' AS tier"))
    assert {(r.q, r.id) for r in best.collect()} == {(q, 3) for q in range(200)}


def test_paths_over_many_edges_ship_no_edges(spark, monkeypatch):
    """More edges than a region holds and no positions: hop by hop, and never packed for each round."""
    from gridhaul.operators import routing

    rows = [(u, v, float(1 + (u * 7 + v * 3) % 11), float(1 + v % 3)) for u in range(20) for v in range(20) if u != v and (u + v) % 3]
    edges, origins = spark.createDataFrame(rows, "u long, v long, seconds double, metres double"), spark.createDataFrame([(0,), (5,), (77,)], "origin long")
    want = sorted(map(tuple, routing.shortest_paths(origins, edges).collect()))
    monkeypatch.setattr(routing, "_rows", None)  # what packs edges and labels for a round
    assert sorted(map(tuple, routing.shortest_paths(origins, edges, region_edges=30).collect())) == want and (77, 77, 0.0, 0.0) in want


def test_tiles_share_folders(spark, tmp_path):
    from gridhaul.sources import files

    edges = spark.range(640).selectExpr("id AS u", "id + 1 AS v", "CAST(id % 16 - 8 AS INT) AS u_tx", "CAST(id % 10 AS INT) AS u_ty", "CAST(id AS INT) AS u_dense")
    files.write_tiles(edges, str(tmp_path / "t"))
    assert len([p for p in (tmp_path / "t").glob("*/*") if p.is_dir()]) == 4  # 80 tiles
    rows = lambda df: sorted(map(tuple, df.select("u", "v", "u_tx", "u_ty", "u_dense").collect()))
    assert rows(files.read_tiles(spark, str(tmp_path / "t"))) == rows(edges) and "f_tx" not in files.read_tiles(spark, str(tmp_path / "t")).columns
    wanted = spark.createDataFrame([(-8, 0), (3, 1), (50, 50)], "tx int, ty int")
    assert rows(files.read_tiles(spark, str(tmp_path / "t"), wanted)) == rows(edges.filter("u_tx = -8 AND u_ty = 0 OR u_tx = 3 AND u_ty = 1"))


def test_rows_of_few_states_are_not_dealt_by_state(spark):
    from gridhaul.sources import files

    rows = spark.range(100).selectExpr("CASE WHEN id % 2 = 0 THEN 'CA' ELSE 'TX' END AS state", "id")
    changed = files.changed_states(rows, files.state_digests(rows.filter("id <> 7")))
    assert changed.count() == 50 and "SortMergeJoin" not in changed._jdf.queryExecution().toString().split("left_semi")[0].split("LeftSemi")[0]
    assert "BroadcastHashJoin [state" in changed._jdf.queryExecution().executedPlan().toString()


def test_goals_that_no_edge_enters_are_not_searched(spark):
    """Only goals that some edge enters, or the origin itself, are searched for; edges out of nodes that nothing reaches are left out."""
    edges = spark.createDataFrame([(1, 2, 1.0, 1.0), (2, 1, 1.0, 1.0), (7, 2, 1.0, 1.0), (8, 7, 1.0, 1.0)], "u long, v long, seconds double, metres double")
    assert {(r.u, r.v) for r in routing.leading(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 2), (2, 1), (7, 2)}
    graph, seen = routing.Graph(edges), []
    plain = graph.search
    graph.search = lambda origins, goals=None, rounds=10_000: seen.extend(r.node for r in goals.collect()) or plain(origins, goals, rounds)
    goals = [(1, 2, 2), (1, 8, 8), (8, 8, 8), (8, 9, 9), (8, 1, 1)]
    asked = spark.createDataFrame([(o, g, n, 0.0, 0.0) for o, g, n in goals], "origin long, goal long, node long, lat double, lon double")
    assert {(r.origin, r.goal, r.seconds) for r in routing.routes(asked, graph).collect()} == {(1, 2, 1.0), (8, 8, 0.0), (8, 1, 3.0)}
    assert sorted(seen) == [1, 2, 8]


@pytest.mark.parametrize("group_labels", [2_000_000, 3])
def test_edges_of_regions_stay_where_they_are(spark, monkeypatch, group_labels):
    """With more regions than half the cores, rounds copy no packed edges to other tasks, but for regions whose labels fill more than one group."""
    rows = [(u, v, 1.0, float(u + v)) for u in range(12) for v in range(12) if u != v] + [(0, 99, 3.0, 1.0)]
    edges = spark.createDataFrame(rows, "u long, v long, seconds double, metres double").coalesce(1)
    shipped, plain = [], routing._rows

    def seen(df, kind, **given):
        if kind == routing.EDGES and "data" in given:
            shipped.append(df.count())
        return plain(df, kind, **given)

    monkeypatch.setattr(routing, "_rows", seen)
    monkeypatch.setattr(routing, "GROUP_LABELS", group_labels)
    graph = routing.Graph(edges, regions=spark.range(12).selectExpr("id AS node", "id % 6 AS region"))
    labels = graph.search(spark.range(12).toDF("origin"))
    graph.close()
    found = {(r.origin, r.node): min((x.s, x.m) for x in r.x) for r in labels.groupBy("origin", "node").agg(F.collect_list(F.struct("s", "m")).alias("x")).collect()}
    want = {(o, n): (0.0, 0.0) if o == n else (1.0, float(o + n)) for o in range(12) for n in range(12)}
    assert found == want | {(o, 99): (4.0, o + 1.0) if o else (3.0, 1.0) for o in range(12)}
    assert (sum(shipped[:2]) == 0) == (group_labels > 3)  # the last round has one region
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_edges_go_by_hashes_and_are_the_first(spark):
    """Of parallel edges of either direction the first by way and step; nothing but the order inside ways is sorted."""
    from gridhaul.operators import graph

    ways = spark.range(400).selectExpr("id % 37 AS way", "id AS pos", "(id * id + floor(id / 37)) % 7 AS node", "0 AS tie", "0 AS tie2", "element_at(array('motorway', 'primary', 'footway', 'service'), cast(id % 4 + 1 AS int)) AS highway", "element_at(array('50 mph', '30', '', 'none', '0', '45 km/h', '12.5'), cast(id % 7 + 1 AS int)) AS maxspeed", "element_at(array('yes', 'no', null), cast(id % 3 + 1 AS int)) AS oneway", "'' AS access")
    nodes = spark.range(6).selectExpr("id", "37.0 + id / 10 AS lat", "-120.0 - (id % 3) / 10 AS lon")
    found = graph.edges(ways, nodes)
    want, at = {}, {r.id: r for r in nodes.collect()}
    kmh = {"50 mph": 50 * 1.60934, "30": 30.0, "45 km/h": 45.0, "12.5": 12.5}
    rows = [r for r in ways.collect() if r.highway != "footway"]
    for way in range(37):
        of_way = sorted((r for r in rows if r.way == way), key=lambda r: r.pos)
        for a, b in zip(of_way, of_way[1:]):
            if a.node in at and b.node in at and a.node != b.node:
                speed = kmh.get(a.maxspeed) or {"motorway": 105.0, "primary": 65.0, "service": 20.0}[a.highway]
                for u, v in [(a.node, b.node)] + ([(b.node, a.node)] if a.oneway != "yes" else []):
                    want.setdefault((u, v), speed)
    assert {(r.u, r.v): round(r.metres / r.seconds * 3.6, 6) for r in found.collect()} == {k: round(x, 6) for k, x in want.items()} and len(want) > 20
    assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_edges_without_positions_are_written_once(spark, monkeypatch):
    """They lie in buckets and nowhere else, and are gone afterwards, after a failure too."""
    seen, plain = [], routing.materialised
    monkeypatch.setattr(routing, "materialised", lambda df: seen.append(df.columns) or plain(df))
    edges = spark.createDataFrame([(k, k + 1, 1.0, 1.0) for k in range(9)], "u long, v long, seconds double, metres double")
    origins = spark.createDataFrame([(0,)], "origin long")
    assert routing.shortest_paths(origins, edges, region_edges=5).count() == 10
    with pytest.raises(RuntimeError, match="did not settle"):
        routing.shortest_paths(origins, edges, 3, region_edges=5)
    assert not [c for c in seen if "v" in c] and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def _points(spark, n, k):
    return spark.range(n).selectExpr("CAST(id % 3 AS INT) AS nation", "id", f"CASE WHEN id % {k} = 4 THEN NULL ELSE 25 + (id * 7919 % 240000) / 1e4 END AS lat", "-124 + (id * 104729 % 560000) / 1e4 AS lon")


def test_crow_matrix_in_parts_and_compiled(spark, monkeypatch):
    """Origins of a request are dealt to parts, each cell comes once, and no generated method is too large for the JVM's compiler."""
    import re

    from gridhaul.plans import matrix

    o, d = _points(spark, 60, 11), _points(spark, 30, 7)
    whole = sorted(map(str, matrix.crow_matrix(o, d, "nation").collect()))
    monkeypatch.setattr(matrix, "ORIGINS", 3)
    assert sorted(map(str, matrix.crow_matrix(o, d, "nation").collect())) == whole and len(set(whole)) == 600
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = matrix.crow_matrix(o, d, "nation")._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_answers_are_joined_where_cells_are_made(spark):
    """The answers of collected cells, though no cell is dealt again; batches end inside answers."""
    from gridhaul.plans import matrix

    o, d = _points(spark, 60, 11), _points(spark, 30, 7)
    want = sorted(map(str, matrix.responses(matrix.crow_matrix(o, d, "nation")).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = matrix.crow_responses(o, d, "nation")
        assert sorted(map(str, found.collect())) == want and len(want) == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("Generate")[0]


def test_rounds_read_few_partitions(spark, monkeypatch):
    """Improved labels of earlier rounds come in as many partitions as cores, not as many as buckets for each round; and nothing is left in the catalogue."""
    seen, plain = [], routing._rows

    def rows(df, kind, **given):
        if kind == routing.KNOWN:
            seen.append(routing_known[-1].rdd.getNumPartitions())
        return plain(df, kind, **given)

    routing_known, union = [], routing._union
    monkeypatch.setattr(routing, "_union", lambda tables: routing_known.append(union(tables)) or routing_known[-1])
    monkeypatch.setattr(routing, "_rows", rows)
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        chain = spark.createDataFrame([(k, k + 1, 1.0, 1.0) for k in range(4)], "u long, v long, seconds double, metres double")
        graph = routing.Graph(chain, regions=spark.range(5).selectExpr("id AS node", "id AS region"))
        labels = graph.search(spark.range(1).toDF("origin"))
        graph.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", buckets)
    assert {r.node: r.s for r in labels.collect()} == {k: float(k) for k in range(5)}
    cores = spark.sparkContext.defaultParallelism
    assert seen and all(n <= cores * (k + 1) for k, n in enumerate(seen))


def test_two_sided_leaves_no_table_after_a_failure(spark):
    from gridhaul.operators.two_sided import two_sided

    pairs, edges = spark.createDataFrame([(1, 2)], "origin long, dest long"), spark.createDataFrame([(1, 2, -1.0, 1.0)], "u long, v long, seconds double, metres double")
    before = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(RuntimeError, match="did not meet"):
        two_sided(pairs, edges.withColumn("seconds", -F.col("seconds")), max_rounds=1)
    assert {t.name for t in spark.catalog.listTables()} == before
