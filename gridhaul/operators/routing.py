"""One-to-many shortest paths over regions of a road graph, and the cascade of routers.

Nodes belong to regions: tiles as coarse as a bound on a region's edges allows where positions are known, else parts by a hash. The edges of a
region are packed once, in a few rows in the shared folder, in buckets by region, where they stay. A round sends fresh labels (best time and length from an
origin to a node) to their region, and with them what is known of the same origin there; regions without fresh labels take no part. Each origin's labels are
followed to the end inside the region, one origin after another, so a task holds one region and one origin's labels; labels of nodes beyond the border are
fresh in the next round. So rounds count crossings of borders, and a round shuffles labels alone. A region is copied to other tasks only where its labels fill
more than one group, so copies are in proportion to labels, or while there are half as many regions as cores at most, so copies are as many as cores.
What improves is appended; nothing is written anew.

With goals the search is directed and stops: a label counts only while its time, and the least time from there to some goal that is still open for it,
isn't above what that goal is known to take. The least time is the great circle at the fastest edge's speed, so paths stay exact. Of an origin's many
goals near ones share a circle. Labels with the least sum go first, inside a region and over rounds: those whose sum is more than AHEAD times the least of
their origin wait, in later rounds those more than twice, four times as many times above it. A round later every region knows what the others found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridhaul.functions import geo
from gridhaul.functions.constants import EARTH_M
from gridhaul.operators.materialise import bucketed, dropped, materialised

REGION_EDGES = 500_000  # edges of a region, about
GROUP_LABELS = 2_000_000  # fresh labels that meet in one group, about
CIRCLES = 256  # of an origin's goals
BLOCKS = 16  # rows that a region's edges are packed into
LEVELS = 12  # the coarsest region is 2^11 tiles wide
NEAR = 64  # labels that go first, at least
AHEAD = 2.0  # labels whose sum is so many times the least wait a round; twice as many times from round to round
ROUNDS_KEPT = 8  # tables of improved labels before they are merged
EDGES, GOAL, KNOWN, FRESH = range(4)
FIRST = -(1 << 63)  # sorts before every origin
ROW = "region long, part int, origin long, kind int, node long, s double, m double, data binary, circles array<double>"
FOUND = "region long, origin long, node long, s double, m double, here boolean, key double"


class _Region:
    """Packed edges, and the best labels of one origin at a time."""

    def __init__(self, blocks: list[bytes]):
        if not blocks:
            u = v = v_region = np.zeros(0, np.int64)
            s = m = lat = lon = np.zeros(0)
        else:
            t = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks])
            order = np.argsort(t.column("u").to_numpy(), kind="stable")
            u, v, v_region, s, m, lat, lon = (t.column(c).to_numpy()[order] for c in ("u", "v", "v_region", "s", "m", "lat", "lon"))
        self.nodes = np.unique(np.concatenate([u, v]))
        head, self.tail = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        self.head, self.s, self.m, self.v_region = head, s, m, v_region
        self.begin = np.searchsorted(head, np.arange(len(self.nodes) + 1))
        self.lat, self.lon = np.full(len(self.nodes), np.nan), np.full(len(self.nodes), np.nan)
        self.lat[self.tail], self.lon[self.tail] = lat, lon
        self.best_s, self.best_m = np.full(len(self.nodes), np.inf), np.full(len(self.nodes), np.inf)
        self.changed = np.zeros(len(self.nodes), bool)

    def follow(self, here: int, kind: np.ndarray, node: np.ndarray, s: np.ndarray, m: np.ndarray, circles: np.ndarray | None, pace: float, cap: float) -> list[tuple[np.ndarray, ...]]:
        """(region, node, s, m, here, key) of what improves for one origin; labels that wait aren't here, though their region is."""
        label = kind >= KNOWN
        at = np.searchsorted(self.nodes, node)
        inside = np.isin(node, self.nodes, kind="sort")
        fresh = kind == FRESH
        out = []
        alone = label & ~inside  # no edge leaves or reaches it here
        if alone.any():
            known = dict(zip(node[alone & ~fresh].tolist(), zip(s[alone & ~fresh].tolist(), m[alone & ~fresh].tolist(), strict=True), strict=True))
            better = [k for k in np.flatnonzero(alone & fresh) if (s[k], m[k]) < known.get(int(node[k]), (np.inf, np.inf))]
            if better:
                out.append((np.full(len(better), here), node[better], s[better], m[better], np.ones(len(better), bool), np.zeros(len(better))))
        old = at[label & inside & ~fresh]
        order = np.lexsort((-m[label & inside & ~fresh], -s[label & inside & ~fresh]))  # the best is written last
        self.best_s[old[order]], self.best_m[old[order]] = s[label & inside & ~fresh][order], m[label & inside & ~fresh][order]
        new, new_s, new_m = at[inside & fresh], s[inside & fresh], m[inside & fresh]
        goal_at = at[(kind == GOAL) & inside & (m == 1)]
        goal_circle = s[(kind == GOAL) & inside & (m == 1)].astype(np.int64)
        limit = None if circles is None else circles[:, 3].copy()
        touched = [old]

        def least(nodes: np.ndarray) -> np.ndarray:
            """Seconds from nodes to each circle at least."""
            lat, lon = np.radians(self.lat[nodes])[:, None], np.radians(self.lon[nodes])[:, None]
            lat2, lon2 = np.radians(circles[:, 0]), np.radians(circles[:, 1])
            a = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
            far = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0))) - circles[:, 2]
            return np.nan_to_num(np.maximum(far, 0) * pace * (1 - 1e-9), nan=0.0)

        def put(nodes: np.ndarray, s_: np.ndarray, m_: np.ndarray) -> np.ndarray:
            better = (s_ < self.best_s[nodes]) | (s_ == self.best_s[nodes]) & (m_ < self.best_m[nodes])
            nodes, s_, m_ = nodes[better], s_[better], m_[better]
            order = np.lexsort((m_, s_, nodes))
            nodes, s_, m_ = nodes[order], s_[order], m_[order]
            lead = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, np.int64)
            nodes, s_, m_ = nodes[lead], s_[lead], m_[lead]
            if limit is not None and len(nodes):
                open_ = (s_[:, None] + least(nodes) <= limit).any(axis=1)
                nodes, s_, m_ = nodes[open_], s_[open_], m_[open_]
            self.best_s[nodes], self.best_m[nodes] = s_, m_
            self.changed[nodes] = True
            touched.append(nodes)
            if limit is not None and len(goal_at):
                np.minimum.at(limit, goal_circle, self.best_s[goal_at])
            return nodes

        region_of = np.full(len(self.nodes), here)
        region_of[self.tail] = self.v_region
        active, steps = put(new, new_s, new_m), 0
        active = active[region_of[active] == here]
        waits = np.zeros(0, np.int64)
        while len(active):
            if (steps := steps + 1) > 1_000_000 + 100 * len(self.nodes):
                raise ValueError("shortest paths don't settle: a cycle of negative length")
            later = active[:0]
            if limit is not None:
                key = self.best_s[active][:, None] + least(active)
                key = np.where(key <= limit, key, np.inf).min(axis=1)
                waits = np.append(waits, active[np.isfinite(key) & (key > cap)])
                active, key = active[key <= cap], key[key <= cap]
                first = max(NEAR, len(active) // 4)
                if len(active) > first:
                    order = np.argpartition(key, first)
                    active, later = active[order[:first]], active[order[first:]]
            elif steps > len(self.nodes) + 1:
                raise ValueError("shortest paths don't settle: a cycle of negative length")
            n = self.begin[active + 1] - self.begin[active]
            ends = np.cumsum(n)
            e = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[active] - (ends - n), n)
            moved = put(self.tail[e], self.best_s[self.head[e]] + self.s[e], self.best_m[self.head[e]] + self.m[e])
            active = np.union1d(later, moved[region_of[moved] == here])
        every = np.unique(np.concatenate(touched))
        found = every[self.changed[every]]
        if len(found):
            key = np.zeros(len(found)) if limit is None else (self.best_s[found][:, None] + least(found)).min(axis=1)
            out.append((region_of[found], self.nodes[found], self.best_s[found], self.best_m[found], (region_of[found] == here) & ~np.isin(found, waits), key))
        self.best_s[every], self.best_m[every], self.changed[every] = np.inf, np.inf, False
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one region, part and origin together; the rows come sorted."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = [t.column(c).to_numpy() for c in ("region", "part", "origin")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, z in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield t.slice(a, z - a)
        held = t.slice(cuts[-1] if len(cuts) else 0)
    if held is not None:
        yield held


def _relaxed(pace: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, region = None, _Region([])
        for rows in _runs(batches):
            here, origin = rows.column("region")[0].as_py(), rows.column("origin")[0].as_py()
            if (here, rows.column("part")[0].as_py()) != where:
                where, region = (here, rows.column("part")[0].as_py()), _Region([])
            if origin == FIRST:
                region = _Region(rows.column("data").drop_null().to_pylist())  # none: no edge leaves the region
                continue
            kind, node, s, m = (rows.column(c).to_numpy() for c in ("kind", "node", "s", "m"))
            circles = next((np.array(c.as_py()).reshape(-1, 4) for c in rows.column("circles") if c.is_valid), None)
            cap = next((x.as_py() for x, c in zip(rows.column("s"), rows.column("circles"), strict=True) if c.is_valid), np.inf)
            for of, nodes, seconds, metres, inside, key in region.follow(here, kind, node, s, m, circles, pace, cap):
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.full(len(of), origin)), pa.array(nodes), pa.array(seconds), pa.array(metres), pa.array(inside), pa.array(key)], names=[c.split(" ")[0] for c in FOUND.split(", ")])

    return run


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    table = table.drop_columns(["region", "block"]).sort_by([("u", "ascending"), ("v", "ascending"), ("s", "ascending"), ("m", "ascending")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.table({"region": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


class Graph:
    """Edges (u, v, seconds, metres) packed by region, for any number of searches.

    nodes (id, lat, lon): positions; without them searches aren't directed. regions (node, region) overrides where nodes belong. region_edges
    bounds a region's edges, but a tile of 0.25 degrees is never cut.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, regions: DataFrame | None = None, region_edges: int = REGION_EDGES):
        self.spark = edges.sparkSession
        e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("seconds").cast("double").alias("s"), F.col("metres").cast("double").alias("m"))
        nowhere = F.lit(None).cast("double")
        if nodes is None:
            e = e.withColumns({"u_lat": nowhere, "u_lon": nowhere, "lat": nowhere, "lon": nowhere})
        else:
            known = nodes.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropDuplicates(["id"])
            e = e.join(known.select(F.col("id").alias("u"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon")), "u", "left").join(known.withColumnRenamed("id", "v"), "v", "left")
        e = materialised(e.select("u", "v", "s", "m", "u_lat", "u_lon", "lat", "lon"))
        self.entered = e.select(F.col("v").alias("node")).distinct()
        straight = geo.haversine(F.col("u_lat"), F.col("u_lon"), F.col("lat"), F.col("lon"))
        n, longest, fastest, unknown = e.agg(F.count(F.lit(1)), F.max("s"), F.max(F.when(straight > 0, straight / F.col("s"))), F.bool_or(F.isnull(straight) | (F.col("s") <= 0) & (straight > 0))).first()
        self.pace = 0.0 if not fastest or unknown else 1.0 / fastest  # seconds a metre, at least
        self.of, self.table = None, None
        if regions is not None:
            self.table = materialised(regions.select(F.col("node").cast("long").alias("_node"), F.col("region").cast("long").alias("_region")).dropDuplicates(["_node"]))
        elif nodes is not None:
            level = self._level(e, region_edges)
            self.of = lambda lat, lon: F.coalesce(F.shiftleft(F.shiftright(geo.tile_x(lon), level).cast("long"), 20) + F.shiftright(geo.tile_y(lat), level), F.lit(-1).cast("long"))
            self.table = materialised(known.select(F.col("id").alias("_node"), self.of(F.col("lat"), F.col("lon")).alias("_region")))
        else:
            parts = max(1, -(-(n or 0) // region_edges))
            self.by_hash = lambda node: F.pmod(F.xxhash64(node), F.lit(parts))
        if self.of is not None:
            placed = e.withColumns({"region": self.of(F.col("u_lat"), F.col("u_lon")), "v_region": self.of(F.col("lat"), F.col("lon"))})
        else:
            placed = self.place(self.place(e, "v", "v_region"), "u", "region")
        blocks = placed.select("region", F.pmod(F.xxhash64("u"), F.lit(BLOCKS)).alias("block"), "u", "v", "v_region", "s", "m", "lat", "lon")
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        packed = blocks.repartition(self.buckets, "region").groupBy("region", "block").applyInArrow(_packed, "region long, data binary")
        self.packed = bucketed(packed, "region", dealt=True)

    @staticmethod
    def _level(e: DataFrame, most: int) -> int:
        """The coarsest tiles none of which has more edges than most; 0 where even the finest have."""
        tiles = e.groupBy(geo.tile_x(F.col("u_lon")).alias("x"), geo.tile_y(F.col("u_lat")).alias("y")).agg(F.count(F.lit(1)).alias("n"))
        coarse = tiles.select("x", "y", "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
        counts = coarse.groupBy("level", F.expr("shiftright(x, level)"), F.expr("shiftright(y, level)")).agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n"))
        return max((r.level for r in counts.collect() if r.n <= most), default=0)

    def close(self) -> None:
        """Delete the packed edges; what searches gave stays."""
        dropped(self.packed)

    def place(self, df: DataFrame, node: str, name: str) -> DataFrame:
        """df with the region of a node column."""
        if self.table is None:
            return df.withColumn(name, self.by_hash(node))
        return df.join(self.table, df[node] == self.table["_node"], "left").withColumn(name, F.coalesce("_region", F.lit(-1).cast("long"))).drop("_node", "_region")

    def search(self, origins: DataFrame, goals: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
        """origin, node, s, m: labels that the search keeps, of which the least of a node is the best; goals: origin, goal, node, lat, lon."""
        spark = self.spark
        zero = F.lit(0.0)
        first = origins.select(F.col("origin").cast("long").alias("origin")).distinct().withColumn("node", F.col("origin"))
        fresh = materialised(self.place(first, "node", "region").select("region", "origin", "node", zero.alias("s"), zero.alias("m"), zero.alias("key")))
        aims = None if goals is None else _circled(materialised(self.place(goals, "node", "region")))
        known: list[DataFrame] = []
        for turn in range(max_rounds):
            waiting, told = None, aims
            if aims is not None and known:
                told = materialised(_limited(aims, _union(known)))
                open_ = fresh.join(told.groupBy("origin").agg(F.max("limit").alias("last")), "origin").filter("key <= last").drop("last")
                open_ = materialised(open_.withColumn("cap", float(AHEAD ** min(turn, 60)) * F.min("key").over(Window.partitionBy("origin"))))
                waiting, fresh = open_.filter("key > cap").drop("cap"), open_.filter("key <= cap")
            cap = F.max("cap") if waiting is not None else F.lit(float("inf"))
            asked = materialised(fresh.groupBy("region", "origin").agg(F.count(F.lit(1)).alias("n"), cap.alias("cap")))
            of_region = asked.groupBy("region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("origins"))
            touched, most, n_origins = of_region.agg(F.count(F.lit(1)), F.max("n"), F.max("origins")).first()
            if not touched:
                return _union(known).select("origin", "node", "s", "m") if known else fresh.select("origin", "node", "s", "m")
            spread = max(1, min(n_origins, spark.sparkContext.defaultParallelism // touched))
            if spread == 1 and most <= GROUP_LABELS:
                parts, copied = F.lit(1).cast("long"), asked
            else:
                counts = of_region.select("region", F.greatest(F.lit(spread).cast("long"), F.ceil(F.col("n") / GROUP_LABELS)).alias("parts"))
                parts, copied = F.col("parts"), asked.join(counts, "region")
            places = copied.select("region", parts.alias("parts"), "origin", "cap").withColumn("part", F.pmod(F.xxhash64("origin"), F.col("parts")).cast("int"))
            if copied is asked:
                dealt = fresh.withColumns({"parts": parts, "part": F.lit(0)})
            else:
                places = materialised(places)
                dealt = fresh.join(places.select("region", "origin", "parts", "part"), ["region", "origin"])

            def labels(which: str) -> list[DataFrame]:
                """What the places need beside edges."""
                at = places.filter(which).drop("parts")
                rows = [_rows(dealt.filter(which), FRESH, node="node", s="s", m="m")]
                if known:
                    rows.append(_rows(_union(known).join(at, ["region", "origin"]), KNOWN, node="node", s="s", m="m"))
                if aims is not None:
                    rows.append(_rows(told.join(at, ["region", "origin"]), GOAL, node="node", s="circle", m="alone"))
                    rows.append(_rows(_circles(told).join(at, "origin"), GOAL, circles="circles", s="cap"))
                return rows

            together = []
            if spread == 1:  # a region's edges join the one row that asks for them, in the bucket where they lie
                wanted = _rows(places.filter("parts = 1").select("region", "part").distinct(), EDGES, origin=F.lit(FIRST))
                rows = _union([*labels("parts = 1"), wanted]).drop("data").repartition(self.buckets, "region").alias("l")
                rows = rows.join(self.packed.alias("e"), (F.col("l.region") == F.col("e.region")) & (F.col("l.kind") == EDGES), "left")
                together.append(rows.select("l.*", "e.data"))
            if spread > 1 or most > GROUP_LABELS:
                copies = self.packed.join(places.filter("parts > 1").select("region", "part").distinct(), "region")
                together.append(_union([*labels("parts > 1"), _rows(copies, EDGES, origin=F.lit(FIRST), data="data")]).repartition("region", "part"))
            followed = [x.select(*(c.split(" ")[0] for c in ROW.split(", "))).sortWithinPartitions("region", "part", "origin", "kind", "node").mapInArrow(_relaxed(self.pace), FOUND) for x in together]
            out = materialised(_union(followed))
            known.append(out.filter("here").select("region", "origin", "node", "s", "m").coalesce(spark.sparkContext.defaultParallelism))  # else later rounds have a task a bucket and table
            if len(known) > ROUNDS_KEPT:
                known = [materialised(_least(_union(known)).drop("key"))]
            later = out.filter("NOT here").drop("here")
            fresh = materialised(_least(later if waiting is None else later.unionByName(waiting)))
            if fresh.isEmpty():
                return _union(known).select("origin", "node", "s", "m")
        raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _least(labels: DataFrame) -> DataFrame:
    key = F.min("key") if "key" in labels.columns else F.lit(0.0)
    return labels.groupBy("region", "origin", "node").agg(F.min(F.struct("s", "m")).alias("x"), key.alias("key")).select("region", "origin", "node", "x.s", "x.m", "key")


def _rows(df: DataFrame, kind: int, **given: str | Column) -> DataFrame:
    kinds = dict(c.split(" ") for c in ROW.split(", "))
    values = {"region": F.col("region"), "part": F.col("part"), "origin": F.col("origin") if "origin" not in given else given["origin"], "kind": F.lit(kind)}
    for name in ("node", "s", "m", "data", "circles"):
        blank = F.lit(0) if name in ("node", "s", "m") else F.lit(None)
        values[name] = F.col(given[name]) if name in given else blank
    return df.select(*(v.cast(kinds[n]).alias(n) for n, v in values.items()))


def _circled(goals: DataFrame) -> DataFrame:
    """goals with the circle that each belongs to: its own where an origin has few, else shared with near ones; alone is 1 where a circle is one goal's."""
    one = goals.groupBy("origin", "goal").agg(F.avg("lat").alias("y"), F.avg("lon").alias("x"))
    band = F.floor(F.col("y") / 2)
    rank = F.ntile(CIRCLES).over(Window.partitionBy("origin").orderBy(band, F.when(band % 2 == 0, F.col("x")).otherwise(-F.col("x")), "goal")) - 1
    dealt = one.withColumn("circle", rank)
    held = dealt.groupBy("origin", "circle").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    dealt = dealt.select("origin", "goal", "circle").join(held, ["origin", "circle"])
    far = geo.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))
    out = goals.join(dealt, ["origin", "goal"]).withColumns({"far": F.coalesce(far, F.lit(float("inf"))), "alone": (F.col("n") == 1).cast("double"), "circle": F.col("circle").cast("double"), "limit": F.lit(float("inf"))})
    return materialised(out.drop("n"))


def _limited(aims: DataFrame, known: DataFrame) -> DataFrame:
    """aims with the time that each goal is known to take at most."""
    at = known.join(aims.select("origin", "goal", "node"), ["origin", "node"]).groupBy("origin", "goal").agg(F.min("s").alias("at_most"))
    return aims.join(at, ["origin", "goal"], "left").withColumn("limit", F.coalesce("at_most", F.lit(float("inf")))).drop("at_most")


def _circles(aims: DataFrame) -> DataFrame:
    """origin, circles: centre, radius and limit of each, one after another."""
    goal = aims.groupBy("origin", "circle", "goal").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.max("far").alias("far"), F.min("limit").alias("limit"))
    circle = goal.groupBy("origin", "circle").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.max("far").alias("far"), F.max("limit").alias("limit"))
    listed = circle.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("circle", "y", "x", "far", "limit"))).alias("c"))
    return listed.select("origin", F.flatten(F.transform("c", lambda c: F.array(F.coalesce(c["y"], F.lit(0.0)), F.coalesce(c["x"], F.lit(0.0)), c["far"], c["limit"]))).alias("circles"))


def _by_hops(origins: DataFrame, e: DataFrame, max_rounds: int) -> DataFrame:
    """shortest_paths by a join a hop. Edges (u, v, es, em) lie in buckets of their source, so a round shuffles labels alone; a cycle of negative length ends by max_rounds."""

    def least(labels: DataFrame) -> DataFrame:
        return labels.groupBy("origin", "node").agg(F.min(F.struct("s", "m")).alias("x")).select("origin", "node", "x.s", "x.m")

    first = origins.select(F.col("origin").cast("long").alias("origin")).distinct()
    fresh = materialised(first.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m")))
    known = [fresh]
    for _ in range(max_rounds):
        on = fresh.hint("shuffle_hash").join(e, fresh["node"] == e["u"])
        reached = least(on.select("origin", F.col("v").alias("node"), (F.col("s") + F.col("es")).alias("s"), (F.col("m") + F.col("em")).alias("m")))
        old = least(_union(known)).select("origin", "node", F.struct("s", "m").alias("old"))
        fresh = materialised(reached.join(old, ["origin", "node"], "left").filter(F.isnull("old") | (F.struct("s", "m") < F.col("old"))).drop("old"))
        if fresh.isEmpty():
            return least(_union(known)).withColumnsRenamed({"s": "seconds", "m": "metres"})
        known.append(fresh)
        if len(known) > ROUNDS_KEPT:
            known = [materialised(least(_union(known)))]
    raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")


def shortest_paths(origins: DataFrame, edges: DataFrame, max_rounds: int = 10_000, regions: DataFrame | None = None, region_edges: int = REGION_EDGES, nodes: DataFrame | None = None) -> DataFrame:
    """origin, node, seconds, metres for all nodes that origins (origin) reach over edges (u, v, seconds, metres); ids are longs.

    Rounds go on until no label improves; more than max_rounds crossings of borders, or a cycle of negative length, raise. regions, region_edges and
    nodes: see Graph. Edges of unknown position that are too many for one region are followed hop by hop: parts by hash would have every round read all edges.
    They are written once, in buckets, and nowhere else.
    """
    kept, graph = None, None
    try:
        if nodes is None and regions is None:
            legs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("seconds").cast("double").alias("es"), F.col("metres").cast("double").alias("em"))
            kept = bucketed(legs.filter("u IS NOT NULL"), "u")
            if kept.count() > region_edges:
                return _by_hops(origins, kept, max_rounds)
            edges = kept.withColumnsRenamed({"es": "seconds", "em": "metres"})
        graph = Graph(edges, nodes, regions, region_edges)
        labels = graph.search(origins, None, max_rounds)
        best = labels.groupBy("origin", "node").agg(F.min(F.struct("s", "m")).alias("x"))
        return best.select("origin", "node", F.col("x.s").alias("seconds"), F.col("x.m").alias("metres"))
    finally:
        if kept is not None:
            dropped(kept)
        if graph is not None:
            graph.close()


def leading(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The edges (u, v, ...) that a path from a start (node) can take, by a look at one step: those out of starts and of nodes that some edge enters."""
    sources = edges.select(F.col("v").alias("u")).union(starts.select(F.col("node").alias("u"))).distinct()
    return edges.join(sources, "u", "left_semi")


def routes(goals: DataFrame, graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """origin, goal, seconds, metres of every goal that is reached: goals (origin, goal, node, lat, lon), where a goal may have several nodes and is reached
    at the best of them. Repeated rows count once; goals without a node are left out, nodes that no edge enters are asked from themselves alone."""
    asked = goals.select(F.col("origin").cast("long").alias("origin"), "goal", F.col("node").cast("long").alias("node"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    asked = asked.filter("origin IS NOT NULL AND goal IS NOT NULL AND node IS NOT NULL").dropDuplicates(["origin", "goal", "node"])
    asked = materialised(asked.join(graph.entered.withColumn("entered", F.lit(True)), "node", "left").filter("entered OR node = origin").drop("entered"))
    labels = graph.search(asked.select("origin"), asked, max_rounds)
    met = labels.join(asked.select("origin", "goal", "node"), ["origin", "node"]).groupBy("origin", "goal").agg(F.min(F.struct("s", "m")).alias("x"))
    return met.select("origin", "goal", F.col("x.s").alias("seconds"), F.col("x.m").alias("metres"))


def cascade(pairs: DataFrame, cached: DataFrame, l0: DataFrame, l1: DataFrame, threshold_km: float) -> DataFrame:
    """pairs (origin, dest, km, known) with seconds, metres, router and status: cache, then L0 within the
    threshold, then L1, else ZERO_RESULTS; NOT_FOUND where an end is unknown."""
    leg = F.struct("seconds", "metres")
    out = pairs
    for name, legs in (("cache", cached), ("l0", l0), ("l1", l1)):
        out = out.join(legs.select("origin", "dest", leg.alias(name)), ["origin", "dest"], "left")
    near = F.when(F.col("km") <= threshold_km, F.col("l0"))
    found = F.coalesce("cache", near, "l1")
    router = F.when(F.col("cache").isNotNull(), "cache").when(near.isNotNull(), "l0").when(F.col("l1").isNotNull(), "l1")
    status = F.when(~F.col("known"), "NOT_FOUND").when(found.isNull(), "ZERO_RESULTS").otherwise("OK")
    ok = status == "OK"
    return out.select("origin", "dest", F.when(ok, found["seconds"]).alias("seconds"), F.when(ok, found["metres"]).alias("metres"), F.when(ok, router).alias("router"), status.alias("status"))
