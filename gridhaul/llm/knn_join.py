"""Exact top-k search by inner product: a Voronoi join on pivots.

Rows go to the cell of their nearest pivot. Per cell the summaries are its number of rows and the distances of its k + 1
nearest ids to the pivot; for queries their number and radius. From these alone follows for every query cell a score that
its k-th best answer reaches at least, and for every row an upper bound of its score against the cell, so
only rows that may count are replicated to it: q.x = p.x + (q-p).x, with |q-p| at most the query cell's radius.
Cells are solved in parts of bounded size, each part one matrix product; answers of the parts are merged.

Components become floor(scale * x), x as double. Null vectors and vectors with null or non-finite components
take no part, nor do rows with a null id; empty vectors score 0. Vectors of different lengths are searched
apart. Repeated ids are rows of their own, but no row answers a query of its own id. Ties go to the smaller
id. Fewer than k rows give fewer answers; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.llm import common

PIVOTS = 64
SAMPLE = 4096  # rows from which pivots are drawn
PART_ROWS, PART_QUERIES = 16_384, 2_048
EXACT = float(1 << 53)


def vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, dims and x, the scaled vector as doubles that hold whole numbers."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))
    good = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()) & F.col("id").isNotNull()
    scaled = F.transform("x", lambda v: F.floor(v * scale).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(good).select("id", F.size("x").alias("dims"), scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact as long as they fit in 64 bits."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


class Cells:
    """Pivots and what is known of the rows and queries around them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n = len(pivots)
        self.rows, self.queries, self.reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        self.close: list[tuple[int, int, float]] = []  # cell, id and distance of the ids nearest to each pivot
        self.floor = np.full(n, -np.inf)

    def settle(self, k: int) -> None:
        """The score that k answers of any query of a cell reach at least, from the summaries alone: k + 1 different ids
        do, of which one may be the query's own."""
        if not self.close:
            return
        cell, ids, far = (np.array(x) for x in zip(*self.close, strict=True))
        dots = self.pivots @ self.pivots.T
        norm = np.sqrt(np.diag(dots))
        for c in np.flatnonzero(self.queries):
            # q.x >= p.p' - reach |p'| - (|p| + reach) |x - p'|, for any q of cell p
            low = dots[c][cell] - self.reach[c] * norm[cell] - (norm[c] + self.reach[c]) * far
            seen: set[int] = set()
            for i in np.argsort(-low, kind="stable"):
                seen.add(int(ids[i]))
                if len(seen) > k:
                    self.floor[c] = low[i] - 1e-6 * (1 + abs(low[i]))
                    break

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """rows x cells: whether a row may be among the best of a query of the cell."""
        high = x @ self.pivots.T + np.sqrt((x * x).sum(1))[:, None] * self.reach
        return (self.queries > 0) & (high + 1e-6 * (1 + np.abs(high)) >= self.floor)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    cell = d.argmin(1)
    return cell, np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0))


def _summaries(rows: DataFrame, is_query: Column, dims: int, pivots: np.ndarray, k: int) -> Cells:
    def near(b: pa.RecordBatch) -> pa.RecordBatch:
        cell, far = _nearest(_matrix(b.column("x")), pivots)
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), b.column("is_query")], names=["cell", "far", "is_query"])

    def close(b: pa.RecordBatch) -> pa.RecordBatch:
        """The k + 1 ids of the batch that are nearest to each pivot."""
        cell, far = _nearest(_matrix(b.column("x")), pivots)
        ids = b.column("id").to_numpy()
        order = np.lexsort((ids, far, cell))
        taken: list[int] = []
        seen: dict[int, set[int]] = {}
        for i in order.tolist():
            ids_of = seen.setdefault(int(cell[i]), set())
            if len(ids_of) <= k and int(ids[i]) not in ids_of:
                ids_of.add(int(ids[i]))
                taken.append(i)
        return pa.RecordBatch.from_arrays([pa.array(cell[taken], pa.int32()), pa.array(ids[taken]), pa.array(far[taken])], names=["cell", "id", "far"])

    cells = Cells(pivots)
    dealt = rows.select("x", is_query.alias("is_query")).mapInArrow(common.per_batch(near), "cell int, far double, is_query boolean")
    asked = F.col("is_query")
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q"), F.max(F.when(asked, F.col("far"))).alias("reach")).collect():  # a row a pivot
        cells.rows[r.cell], cells.queries[r.cell], cells.reach[r.cell] = r.n, r.q, r.reach or 0.0
    some = rows.select("id", "x").mapInArrow(common.per_batch(close), "cell int, id long, far double").groupBy("cell", "id").agg(F.min("far").alias("far"))
    first = F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))
    cells.close = [(r.cell, r.id, r.far) for r in some.withColumn("n", first).filter(F.col("n") <= k + 1).collect()]  # k + 1 rows a pivot
    return cells


def _deal(cells: Cells, as_query: bool, parts: np.ndarray, groups: np.ndarray):
    """Each row once for every part that needs it: queries to all row parts of their own cell, rows to one row
    part of every cell that may want them and to all query parts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("id").to_numpy(), _matrix(b.column("x"))
            mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(8)
            if as_query:
                at, cell = np.arange(len(ids)), _nearest(x, cells.pivots)[0]
                own, spread = mixed % groups[cell].astype(np.uint64), parts[cell]
            else:
                at, cell = np.nonzero(cells.wanted(x))
                own, spread = mixed[at] % parts[cell].astype(np.uint64), groups[cell]
            rep = np.repeat(np.arange(len(at)), spread)
            other = common.ragged(np.zeros(len(at), np.int64), spread)
            row_part, query_part = (other, own[rep].astype(np.int64)) if as_query else (own[rep].astype(np.int64), other)
            cols = [pa.array(cell[rep], pa.int32()), pa.array(row_part, pa.int32()), pa.array(query_part, pa.int32())]
            for lo in range(0, len(rep), 4096):  # replicas leave in small batches
                some = rep[lo : lo + 4096]
                taken = pa.array(at[some])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, 4096) for c in cols), b.column("id").take(taken), b.column("x").take(taken)], names=["cell", "row_part", "query_part", "id", "x"])

    return run


def _best(k: int):
    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            qid, rid = queries["id"].to_numpy(), rows["id"].to_numpy()
            order = np.argsort(rid, kind="stable")  # equal scores: the smaller id first
            rid = rid[order]
            q, x = _matrix(queries["x"].combine_chunks()), _matrix(rows["x"].combine_chunks())[order]
            for lo in range(0, len(qid), 256):
                score = _scores(q[lo : lo + 256], x)
                for i, s in enumerate(score):
                    ok = np.flatnonzero(rid != qid[lo + i])
                    s = s[ok]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        above, ties = np.flatnonzero(s > least), np.flatnonzero(s == least)
                        keep = np.concatenate([above, ties[: k - len(above)]])
                    else:
                        keep = np.arange(len(s))
                    out["query_id"] += [qid[lo + i]] * len(keep)
                    out["id"] += rid[ok[keep]].tolist()
                    out["score"] += s[keep].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return solve


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row that is_query (over the column id) marks, the k best others."""
    spark = rows.sparkSession
    ready = common.work_table(vectors(rows, id_col, vector_col, scale), "vectors")
    found = None
    for (dims,) in ready.select("dims").distinct().orderBy("dims").collect():
        same = ready.filter(F.col("dims") == dims)
        sample = common.sampled(same, SAMPLE, "id").select("x").toPandas()["x"]
        matrix = np.unique(np.array(sample.tolist(), float).reshape(len(sample), dims), axis=0)
        chosen = np.random.default_rng(0).permutation(len(matrix))[:pivots]
        cells = _summaries(same, is_query, dims, matrix[chosen], k)
        cells.settle(k)
        parts = np.maximum(1, -(-_needed(same, cells) // PART_ROWS))
        groups = np.maximum(1, -(-cells.queries // PART_QUERIES))
        schema = "cell int, row_part int, query_part int, id long, x array<double>"
        queries = same.filter(is_query).select("id", "x").mapInArrow(_deal(cells, True, parts, groups), schema)
        data = same.select("id", "x").mapInArrow(_deal(cells, False, parts, groups), schema)
        at = ("cell", "row_part", "query_part")
        some = queries.groupBy(*at).cogroup(data.groupBy(*at)).applyInArrow(_best(k), "query_id long, id long, score long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _needed(rows: DataFrame, cells: Cells) -> np.ndarray:
    """How many rows each query cell wants: a partial sum from every batch, one row a cell in the end."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = cells.wanted(_matrix(b.column("x"))).sum(0)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    out = np.zeros(len(cells.pivots), np.int64)
    for r in rows.select("x").mapInArrow(common.per_batch(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
