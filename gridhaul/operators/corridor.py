"""Which tiles a request needs, and which router it can use."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.functions import geo
from gridhaul.functions import text as X
from gridhaul.operators.materialise import materialised
from gridhaul.operators.routing import leading


def bounds(points: DataFrame, request: str) -> DataFrame:
    """A row a request: its bounding box and the box's diagonal in metres."""
    box = points.groupBy(request).agg(*(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))))
    return box.withColumn("diagonal_m", geo.haversine(F.col("lat_min"), F.col("lon_min"), F.col("lat_max"), F.col("lon_max")))


def small_enough(ends: DataFrame, request: str, most_m: float = 3000.0) -> DataFrame:
    """request, small: whether all ends of a request (request, text) are literals and lie in a box of that diagonal; only then the
    corridor's router is tried unasked."""
    point = X.coordinate(F.col("text"))
    literal = F.bool_and(F.coalesce(X.strict_coordinate(F.col("text")), F.lit(False))).alias("literal")
    told = ends.groupBy(request).agg(literal)
    box = bounds(ends.select(request, point.alias("p")).filter("p IS NOT NULL").select(request, "p.lat", "p.lon"), request)
    return told.join(box, request, "left").select(request, (F.col("literal") & F.coalesce(F.col("diagonal_m") <= most_m, F.lit(False))).alias("small"))


def tiles(boxes: DataFrame, request: str, buffer: int = 1, most: int = 16) -> DataFrame:
    """request, tx, ty of the tiles of each box and around it; requests that need more than most have none."""
    x0, x1 = geo.tile_x(F.col("lon_min")) - buffer, geo.tile_x(F.col("lon_max")) + buffer
    y0, y1 = geo.tile_y(F.col("lat_min")) - buffer, geo.tile_y(F.col("lat_max")) + buffer
    few = boxes.filter((x1 - x0 + 1) * (y1 - y0 + 1) <= most)
    return few.select(request, F.explode(F.sequence(x0, x1)).alias("tx"), y0.alias("a"), y1.alias("z")).select(request, "tx", F.explode(F.sequence("a", "z")).alias("ty"))


MOST_SETTLED = 500_000  # nodes that one request may settle
GROUP_REQUESTS = 100  # requests of one corridor that meet in one group, about


def _nearest_first(legs: pa.Table, edges: pa.Table) -> pa.Table:
    """request, dest, seconds, metres of the requests all of whose goals are reached: a heap a request, which ends at its last goal."""
    nodes = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]))
    u = np.searchsorted(nodes, edges["u"].to_numpy())
    order = np.argsort(u, kind="stable")
    begin = np.searchsorted(u[order], np.arange(len(nodes) + 1)).tolist()
    v, s, m = np.searchsorted(nodes, edges["v"].to_numpy())[order].tolist(), edges["seconds"].to_numpy()[order].tolist(), edges["metres"].to_numpy()[order].tolist()
    place = {n: k for k, n in enumerate(nodes.tolist())}
    out: dict[str, list] = {"request": [], "dest": [], "seconds": [], "metres": []}
    asked: dict[int, tuple[int, list]] = {}
    for request, dest, start, goal in zip(*(legs[c].to_pylist() for c in ("request", "dest", "origin_node", "dest_node")), strict=True):
        asked.setdefault(request, (start, []))[1].append((dest, goal))
    entered = set(nodes[np.unique(v)].tolist())
    for request, (start, goals) in asked.items():
        open_, found = {goal for _, goal in goals}, {}
        if not open_ <= entered | {start}:
            continue
        best, heap = {}, [(0.0, 0.0, start)]
        while heap and open_ and len(best) < MOST_SETTLED:
            at_s, at_m, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = True
            if node in open_:
                open_.discard(node)
                found[node] = (at_s, at_m)
            k = place.get(node)
            for e in range(begin[k], begin[k + 1]) if k is not None else ():
                to = int(nodes[v[e]])
                if to not in best:
                    heapq.heappush(heap, (at_s + s[e], at_m + m[e], to))
        if not open_:
            for dest, goal in goals:
                for name, value in zip(out, (request, dest, *found[goal]), strict=True):
                    out[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table({n: pa.array(c, k) for (n, c), k in zip(out.items(), kinds, strict=True)})


def route_within(legs: DataFrame, edges: DataFrame, most: int = 16) -> DataFrame:
    """request, dest, seconds, metres of the requests whose corridor is small and reaches all their goals; others have no row and go on to other routers.

    legs: request, dest (longs), origin_node, dest_node with their points (origin_lat, origin_lon, dest_lat, dest_lon), one origin a request; legs without
    a node take no part. edges: u, v, seconds, metres and the tile of their source (u_tx, u_ty). A corridor is the tiles of a request's nodes and those around;
    requests with one corridor share its edges, in groups of about GROUP_REQUESTS. Requests with a goal that no edge enters are told at once, and edges
    that no path can take (see `routing.leading`) are left out.
    """
    some = legs.filter("origin_node IS NOT NULL AND dest_node IS NOT NULL")
    entered = edges.select(F.col("v").alias("dest_node"), F.lit(True).alias("entered")).distinct()
    lost = some.join(entered, "dest_node", "left").filter(F.isnull("entered") & (F.col("dest_node") != F.col("origin_node"))).select("request").distinct()
    some = materialised(some.join(lost, "request", "left_anti"))
    edges = leading(edges, some.select(F.col("origin_node").alias("node")))
    ends = some.select("request", F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon")).unionByName(some.select("request", F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon")))
    found = tiles(bounds(ends, "request"), "request", most=most)
    box = found.groupBy("request").agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    corridor = F.concat_ws(":", "x0", "x1", "y0", "y1")
    box = materialised(box.withColumn("corridor", corridor))
    parts = box.groupBy("corridor", "x0", "x1", "y0", "y1").agg(F.ceil(F.count(F.lit(1)) / GROUP_REQUESTS).cast("int").alias("parts"))
    dealt = some.join(box.select("request", "corridor"), "request").join(parts.select("corridor", "parts"), "corridor").withColumn("part", F.pmod(F.xxhash64("request"), F.col("parts")).cast("int"))
    columns = parts.select("corridor", "parts", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("u_tx"))
    covered = columns.select("corridor", "parts", "u_tx", F.explode(F.sequence("y0", "y1")).alias("u_ty")).select("corridor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "u_tx", "u_ty")
    roads = edges.select("u_tx", "u_ty", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("seconds").cast("double").alias("seconds"), F.col("metres").cast("double").alias("metres")).join(covered, ["u_tx", "u_ty"])
    own = dealt.select("corridor", "part", F.col("request").cast("long").alias("request"), F.col("dest").cast("long").alias("dest"), F.col("origin_node").cast("long").alias("origin_node"), F.col("dest_node").cast("long").alias("dest_node"))
    return own.groupBy("corridor", "part").cogroup(roads.groupBy("corridor", "part")).applyInArrow(_nearest_first, "request long, dest long, seconds double, metres double")
