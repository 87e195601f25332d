"""Compressing vectors to codes: Lloyd's rounds on cover trees, exact on whole numbers.

Components become floor(scale * x), x as double. Vectors are cut into parts; each part has a codebook, which starts as that part of the first
ids' vectors. Rows stay where they are, in blocks of at most BLOCK_ROWS, and each block gets a cover tree for every part, built once: a node is
a centre, a radius that holds all its points, their number and their sum; its children's centres lie further apart than half its radius and cover it. In
each round tasks walk the trees of their blocks, a level at a time. A node whose nearest entry is nearer by more than twice its radius than
any other is assigned as a whole, by its number and sum; only the others go down, to points at last, which are compared exactly. Sums by part and
entry are added by Spark, so only the codebooks go to the driver and back: parts x entries x components, whatever the rows.
The last walk gives every point its entry and exact distance.

Ties go to the lower entry; entries without points stay; means are floored. Null vectors and vectors with null or non-finite components take no part.
The first ids are the smallest; repeated ids are rows of their own, the lesser vector first, null ids last. Fewer rows than entries make smaller
codebooks. Vectors of different lengths are coded apart; lengths that the parts don't divide give the first parts one component more. Empty vectors have
code 0 and error 0. Components past 2^53 in size when scaled count as 2^53; where squared distances may pass it, Python's whole numbers compute them, slower. Labels of any type are compared
as they are, nulls together; a missing label column counts as null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS = 2048
LEAF = 12  # nodes of so few points are compared point by point
EXACT = float(1 << 53)


class Tree:
    """A cover tree over the rows of x: arrays of the nodes, a level after the other, children of a node together; rows of a node together in order."""

    def __init__(self, centre: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, order: np.ndarray):
        self.centre, self.radius, self.lo, self.hi, self.first, self.last, self.order = centre, radius, lo, hi, first, last, order

    @classmethod
    def of(cls, x: np.ndarray) -> Tree:
        order = np.arange(len(x))
        centre, radius, lo, hi, first, last = [], [], [], [], [], []
        level = [(0, len(x))]
        at = 0
        while level:
            below: list[tuple[int, int]] = []
            at += len(level)
            for a, b in level:
                own = x[order[a:b]]
                middle = own[0] if len(own) == 1 else np.rint(own.mean(axis=0))
                far = np.sqrt(((own - middle) ** 2).sum(axis=1))
                centre.append(middle)
                radius.append(float(far.max()))
                lo.append(a)
                hi.append(b)
                first.append(at + len(below))
                if b - a > LEAF and radius[-1] > 0:
                    below += cls._split(x, order, a, b, radius[-1] / 2)
                last.append(at + len(below))
            level = below
        return cls(np.array(centre).reshape(len(centre), x.shape[1]), np.array(radius), *(np.array(c, np.int32) for c in (lo, hi, first, last, order)))

    @staticmethod
    def _split(x: np.ndarray, order: np.ndarray, a: int, b: int, near: float) -> list[tuple[int, int]]:
        """Rows a to b regrouped around centres more than near apart, or than a part of it that parts them at all; nothing where nearly every row would
        be a centre."""
        rows, groups = order[a:b].copy(), []
        while len(groups) < 2:
            if groups and near < 0.5:  # whole numbers so close are equal
                return []
            left, groups = rows, []
            while len(left):
                if len(groups) > len(rows) // 4:
                    return []
                own = ((x[left] - x[left[0]]) ** 2).sum(axis=1) <= near * near
                groups.append(left[own])
                left = left[~own]
            near /= 2
        order[a:b] = np.concatenate(groups)
        ends = a + np.cumsum([len(g) for g in groups])
        return list(zip([a, *ends[:-1].tolist()], ends.tolist(), strict=True))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to entries."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    return ((x.astype(np.int64).astype(object)[:, None, :] - entries.astype(np.int64).astype(object)[None]) ** 2).sum(axis=2)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to that of y."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(y).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        return ((x - y) ** 2).sum(axis=1)
    return ((x.astype(np.int64).astype(object) - y.astype(np.int64).astype(object)) ** 2).sum(axis=1)


def _decided(tree: Tree, nodes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each node's centre, and whether it is that of all its points."""
    d = _squares(tree.centre[nodes], entries).astype(float)
    best = d.argmin(axis=1)
    nearest = d[np.arange(len(nodes)), best]
    d[np.arange(len(nodes)), best] = np.inf
    return best, np.sqrt(d.min(axis=1)) - np.sqrt(nearest) > 2 * tree.radius[nodes] * (1 + 1e-9) + 1e-9 * np.sqrt(np.abs(nearest))


def assign(tree: Tree, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every row; whole nodes at once where the triangle inequality allows it."""
    code = np.zeros(len(x), np.int64)
    nodes = np.zeros(min(1, len(x)), np.int64)
    while len(nodes):
        best, sure = _decided(tree, nodes, entries) if len(entries) > 1 else (np.zeros(len(nodes), np.int64), np.ones(len(nodes), bool))
        whole = nodes[sure]
        code[tree.order[common.ragged(tree.lo[whole], tree.hi[whole] - tree.lo[whole])]] = np.repeat(best[sure], tree.hi[whole] - tree.lo[whole])
        nodes = nodes[~sure]
        leaf = tree.first[nodes] == tree.last[nodes]
        rows = tree.order[common.ragged(tree.lo[nodes[leaf]], tree.hi[nodes[leaf]] - tree.lo[nodes[leaf]])]
        if len(rows):
            code[rows] = _squares(x[rows], entries).argmin(axis=1)
        nodes = nodes[~leaf]
        nodes = common.ragged(tree.first[nodes], tree.last[nodes] - tree.first[nodes])
    return code


def sums(tree: Tree, cumulated: np.ndarray, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by entry and their componentwise sums; of whole nodes from the cumulated sums of the rows in the tree's order."""
    n, total = np.zeros(len(entries), np.int64), np.zeros((len(entries), x.shape[1]), cumulated.dtype)
    nodes = np.zeros(min(1, len(x)), np.int64)
    while len(nodes):
        best, sure = _decided(tree, nodes, entries) if len(entries) > 1 else (np.zeros(len(nodes), np.int64), np.ones(len(nodes), bool))
        whole = nodes[sure]
        np.add.at(n, best[sure], tree.hi[whole] - tree.lo[whole])
        np.add.at(total, best[sure], cumulated[tree.hi[whole]] - cumulated[tree.lo[whole]])
        nodes = nodes[~sure]
        leaf = tree.first[nodes] == tree.last[nodes]
        places = common.ragged(tree.lo[nodes[leaf]], tree.hi[nodes[leaf]] - tree.lo[nodes[leaf]])
        if len(places):
            own = _squares(x[tree.order[places]], entries).argmin(axis=1)
            np.add.at(n, own, 1)
            np.add.at(total, own, cumulated[places + 1] - cumulated[places])
        nodes = nodes[~leaf]
        nodes = common.ragged(tree.first[nodes], tree.last[nodes] - tree.first[nodes])
    return n, total


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers that add up exactly: 64 bits, Python's where they might not do."""
    out = x.astype(np.int64)
    return out if float(np.abs(x).max(initial=0)) * max(1, len(x)) < float(1 << 62) else out.astype(object)


def widths(dims: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([len(p) for p in np.array_split(np.zeros(dims), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _dump(tree: Tree) -> bytes:
    sink = pa.BufferOutputStream()
    fields = {"radius": tree.radius, "lo": tree.lo, "hi": tree.hi, "first": tree.first, "last": tree.last}
    batch = pa.record_batch({**{k: pa.array(v) for k, v in fields.items()}, "centre": pa.array(list(tree.centre), pa.list_(pa.float64()))})
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return len(tree.order).to_bytes(8, "little") + tree.order.tobytes() + sink.getvalue().to_pybytes()


def _load(data: bytes, dims: int) -> Tree:
    n = int.from_bytes(data[:8], "little")
    order = np.frombuffer(data, np.int32, n, 8)
    b = pa.ipc.open_stream(data[8 + 4 * n :]).read_all()
    centre = b.column("centre").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
    return Tree(centre, *(b.column(c).to_numpy() for c in ("radius", "lo", "hi", "first", "last")), order)


def kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """id, label, dims and x, the floored components as doubles (they hold whole numbers), of vectors that take part."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))
    label = F.col(label_col) if label_col and label_col in rows.columns else F.lit(None).cast("int")
    found = rows.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), x.alias("x")).filter("x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    floored = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-EXACT), F.least(F.lit(EXACT), v * scale))).cast("double"))
    return found.select("id", "label", F.size("x").alias("dims"), floored.alias("x"))


class Coder:
    """Codebooks of one vector length and the blocks of its rows."""

    def __init__(self, found: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES):
        self.spark, self.dims, self.cuts = found.sparkSession, dims, widths(dims, parts)
        own = found.filter(F.col("dims") == dims)
        start = own.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
        self.books = [np.array([r.x[a:b] for r in start], float).reshape(len(start), b - a) for a, b in self.cuts]
        self.blocks = common.work_table(self._grown(own.select("id", "label", "x")), "vector-trees")

    def _grown(self, rows: DataFrame) -> DataFrame:
        """Blocks of rows with their trees, where the rows are: ids and labels as lists, components as bytes, a tree a part."""
        cuts, dims, label = self.cuts, self.dims, rows.schema["label"].dataType.simpleString()

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(at, BLOCK_ROWS)
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
                    trees = [_dump(Tree.of(np.ascontiguousarray(x[:, lo:hi]))) for lo, hi in cuts]
                    lists = [pa.ListArray.from_arrays([0, b.num_rows], b.column(c)) for c in ("id", "label")]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "x", "trees"])

        return rows.mapInArrow(grown, f"ids array<bigint>, labels array<{label}>, x binary, trees array<binary>")

    def refine(self) -> None:
        """One round: every part is assigned, then each entry becomes the floored mean of its parts."""
        if not self.dims:
            return
        books, cuts, dims = self.spark.sparkContext.broadcast(self.books), self.cuts, self.dims

        def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(len(e), np.int64) for e in books.value]
            total = [np.zeros(e.shape, object) for e in books.value]
            for b in batches:
                for data, trees in zip(b.column("x").to_pylist(), b.column("trees").to_pylist(), strict=True):
                    x = np.frombuffer(data).reshape(-1, dims)
                    for p, ((lo, hi), entries, packed) in enumerate(zip(cuts, books.value, trees, strict=True)):
                        own, tree = np.ascontiguousarray(x[:, lo:hi]), _load(packed, hi - lo)
                        whole = _whole(own[tree.order])
                        count, added = sums(tree, np.concatenate([np.zeros_like(whole[:1]), np.cumsum(whole, axis=0)]), own, entries)
                        n[p] += count
                        total[p] = total[p] + added
            rows = [(p, int(e), int(n[p][e]), [str(v) for v in total[p][e]]) for p in range(len(cuts)) for e in np.flatnonzero(n[p])]
            for at in range(0, len(rows), 1000):
                some = rows[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["part", "entry", "n", "sums"])

        found = self.blocks.select("x", "trees").mapInArrow(walked, "part int, entry int, n long, sums array<string>")
        long = found.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "v"))
        added = long.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        fresh = [b.copy() for b in self.books]
        for r in added:
            if r["at"] is not None:
                fresh[r.part][r.entry, r["at"]] = float(int(r.v) // r.n)
        self.books = fresh

    def codes(self) -> DataFrame:
        """vec_id, label, code (entries in order of the parts) and error of every row."""
        books, cuts, dims = self.spark.sparkContext.broadcast(self.books), self.cuts, self.dims
        label = self.blocks.schema["labels"].dataType.elementType.simpleString()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, (data, trees) in enumerate(zip(b.column("x").to_pylist(), b.column("trees").to_pylist(), strict=True)):
                    ids, labels = b.column("ids")[k].values, b.column("labels")[k].values
                    x = np.frombuffer(data or b"\0" * 8)[: len(ids) * dims].reshape(len(ids), dims)
                    error, code = [0] * len(ids), [b""] * len(ids)
                    for (lo, hi), entries, packed in zip(cuts, books.value, trees, strict=True):
                        own = np.ascontiguousarray(x[:, lo:hi])
                        found = assign(_load(packed, hi - lo), own, entries)
                        error = [e + int(d) for e, d in zip(error, _gaps(own, entries[found]), strict=True)]
                        code = [c + int(e).to_bytes(1 if len(entries) <= 256 else 4, "big") for c, e in zip(code, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.hex() for c in code]), pa.array([str(e) for e in error])], names=["vec_id", "label", "code", "error"])

        out = self.blocks.mapInArrow(coded, f"vec_id long, label {label}, code string, error string")
        return out.withColumn("error", F.col("error").cast("decimal(38,0)"))

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for e in b for v in e).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    found = common.work_table(kept(rows, id_col, vector_col, label_col, scale), "vectors")
    out = None
    for r in found.select("dims").distinct().collect():  # one length, nearly always
        coder = Coder(found, r.dims, parts, entries)
        for _ in range(rounds):
            coder.refine()
        coded = coder.codes().withColumn("codebooks_sha256", F.lit(coder.digest()))
        out = coded if out is None else out.unionByName(coded)
    if out is None:
        return found.select(F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("error"), F.lit(0).cast("decimal(38,0)").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = common.work_table(out, "vector-codes")
    keyed = out.withColumn("key", F.struct("label"))  # a struct is never null, so nulls meet
    totals = keyed.groupBy("key").agg(F.sum("error").alias("label_error"))
    return common.spread_join(keyed, totals, ["key"], "vec_id").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    found = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", F.col("error").try_cast("long").alias("error"), F.col("label_error").try_cast("long").alias("label_error"), "codebooks_sha256")


def _oracle(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Every point beside every entry, a round after another."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, t.part, x[t.part * len(x) // {parts} + 1 : (t.part + 1) * len(x) // {parts}] AS v FROM k, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries}))",
    ]
    near = "SELECT p.vec_id, p.part, min((list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry)) AS m FROM p JOIN b{0} b USING (part) GROUP BY ALL"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"""m{r} AS MATERIALIZED (SELECT part, entry, list(v ORDER BY pos) AS v FROM (SELECT a.part, a.m[2] AS entry, pos, CAST(floor(sum(p.v[pos])::DOUBLE / count(*)) AS BIGINT) AS v
  FROM a{r} a JOIN p USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(p.v) + 1)) AS pos) GROUP BY ALL) GROUP BY ALL)""")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    steps.append(f"f AS MATERIALIZED ({near.format(rounds)})")
    steps.append("c AS (SELECT vec_id, string_agg(lpad(to_hex(m[2]), 2, '0'), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM f GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"


ORACLE = _oracle()
