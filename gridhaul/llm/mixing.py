"""Mixing sources to target weights by blocks.

The words of a source, document after document, form one long row that is cut into blocks of equal length.
Targets share out a number of words by weight and stop at a multiple of each source's size. Every output
shard draws its number of slots of each source from a multinomial over what the targets still ask for (the
last shard takes what is left, so totals meet the targets to within a block). Slot j of a source takes block
perm(j mod n) of its n blocks, perm being a keyed pseudorandom permutation for each pass over the source;
slots join blocks by (source, block), so a hot source is spread over its blocks. Only one row a source comes
to the driver, and the plan sent out is shards x sources counts. Seeds are fixed: reruns agree.

Null text has size 0; a null source is a source of its own, last in order. Documents of size 0 stay with 0
words taken. Repeated rows are placed one after another; null ids sort first. An empty table, or one without
any word, takes nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.llm import common

BLOCK = 64
SHARDS = 64
SEED = 7
WEIGHTS = (3, 1, 2)
CHUNK = 1 << 16  # slots that one row of the plan unfolds to at a time
BUCKET_ROWS = 20_000
SPAN = re.compile(rb"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """total shared by weight; shares above most x size stop there and the rest is shared anew."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / whole > most * sizes[s]]
        if not above:
            for s in open_:
                out[s] = left * weights[s] / whole
            break
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1, for each row: a Feistel network, walked until it stays below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, m: np.ndarray, h: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & m
        for step in range(4):
            mixed = (right + k + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        return left << h | right

    key = key.astype(np.uint64)
    out = once(index.astype(np.uint64), mask, half, key)
    while len(over := np.flatnonzero(out >= n.astype(np.uint64))):
        out[over] = once(out[over], mask[over], half[over], key[over])
    return out.astype(np.int64)


def draw(quotas: list[int], shards: int, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): multinomial counts for each shard, never more than is left."""
    rng, left, given, rows = np.random.default_rng(seed), np.array(quotas, np.int64), np.zeros(len(quotas), np.int64), []
    for shard in range(shards):
        need = int(left.sum()) // (shards - shard)
        counts = np.zeros_like(left)
        while (short := need - int(counts.sum())) > 0:
            rest = left - counts
            counts += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        rows += [(shard, s, int(given[s]), int(c)) for s, c in enumerate(counts) if c]
        left, given = left - counts, given + counts
    return rows


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (a hash of the text) and size in words."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(x.split()) for x in common.blobs(b.column("text"))], pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "mark")), n], names=["doc_id", "source", "mark", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.per_batch(count), "doc_id long, source string, mark long, size long")


def _placed(counted: DataFrame, table: DataFrame, n_docs: int) -> DataFrame:
    """counted with its source's rank, size and target, and its place in the source's row of words."""
    buckets = max(64, n_docs // BUCKET_ROWS)
    rows = counted.join(table, counted.source.eqNullSafe(table.name)).drop("name").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    inside = Window.partitionBy("rank", "bucket").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n")).select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(sums, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("local")).drop("bucket", "base", "local")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix, one row a piece of a document in a block and slot that takes it; shard and slot are null for
    pieces that nothing takes. Columns: doc_id, source, mark, size, source_size, target, rank, start, block, first
    (word of the document), words, shard, slot, turn (0 for the first pass over the source)."""
    spark = docs.sparkSession
    counted = common.work_table(sizes(docs), "sizes")
    found = counted.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    given = [r["size"] for r in found]
    aims = targets(given, [weights[k % len(weights)] for k in range(len(found))], share * sum(given), most)
    table = spark.createDataFrame([(r.source, k, r["size"], aims[k]) for k, r in enumerate(found)], "name string, rank int, source_size long, target double")
    blocks = [-(-n // block) for n in given]
    quotas = [min(int(most * b), round(a / n * b)) if n else 0 for a, n, b in zip(aims, given, blocks, strict=True)]
    plan = spark.createDataFrame([(shard, s, at, n, blocks[s]) for shard, s, at, n in draw(quotas, shards, seed)], "shard int, rank int, at long, n long, blocks long")
    chunks = plan.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    spread = chunks.repartition(min(10 * shards, max(8, sum(quotas) // (4 * CHUNK))), "shard", "rank", "chunk")
    unfolded = spread.select("shard", "rank", "blocks", F.explode(F.sequence(F.col("at") + F.col("chunk") * CHUNK, F.col("at") + F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot"))

    def taken(b: pa.RecordBatch) -> pa.RecordBatch:
        rank, n, slot = (b.column(c).to_numpy() for c in ("rank", "blocks", "slot"))
        turn = slot // n
        at = permute(slot % n, n, (rank.astype(np.int64) << 20) + (turn << 8) + seed)
        return pa.RecordBatch.from_arrays([b.column("shard"), b.column("rank"), b.column("slot"), pa.array(turn), pa.array(at)], names=["shard", "rank", "slot", "turn", "block"])

    slots = unfolded.mapInArrow(common.per_batch(taken), "shard int, rank int, slot long, turn long, block long")
    placed = _placed(counted, table, sum(r.n for r in found))
    none = F.array(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))  # no block; spread out for the join
    at = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).otherwise(none)
    pieces = placed.select("*", F.explode(at).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    words = F.when(F.col("size") > 0, F.least("size", (F.col("block") + 1) * block - F.col("start")) - first).otherwise(0)
    pieces = pieces.withColumn("first", first).withColumn("words", words)
    return pieces.join(slots.hint("merge"), ["rank", "block"], "left")  # Spark takes the unfolded plan for small


def _of_document() -> list[str]:
    return ["doc_id", "mark", "rank", "start", "size", "source_size", "target"]


def words_taken(mixed: DataFrame) -> DataFrame:
    """One row a document with the words that the mix takes of it, repeats counted."""
    n = F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).alias("taken")
    empty = F.when(F.col("size") == 0, F.col("block")).otherwise(0)
    return mixed.groupBy(*_of_document(), empty.alias("_")).agg(n).drop("_")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs after the mix, in their own columns: a row for each pass over the source that takes a document,
    with the words that it takes (the whole text as it stands, where all are taken)."""
    mixed = mix(docs, **options).filter("slot IS NOT NULL")
    def row(mark):
        return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), mark.alias("__mark"), F.coalesce(F.concat(F.lit("."), "source"), F.lit("")).alias("__source")]
    runs = mixed.groupBy(*row(F.col("mark")), "start", F.col("size").alias("__size"), "turn").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("__runs")).drop("start", "turn")
    keys = ["__id", "__mark", "__source"]
    rows = docs.select("*", *row(F.xxhash64("text"))).dropDuplicates(keys)  # a run has a row for each of rows alike
    joined = rows.hint("merge").join(runs, keys)
    names = docs.columns
    where = names.index("text")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, size, found in zip(common.blobs(b.column("text")), b.column("__size").to_pylist(), b.column("__runs").to_pylist(), strict=True):
            if sum(r["words"] for r in found) == size:
                out.append(text.decode())
                continue
            spans = [m.span() for m in SPAN.finditer(text)]
            joined_runs: list[list[int]] = []
            for r in found:
                if joined_runs and joined_runs[-1][1] == r["first"]:
                    joined_runs[-1][1] += r["words"]
                else:
                    joined_runs.append([r["first"], r["first"] + r["words"]])
            parts = [text[spans[a][0] : spans[z - 1][1]] for a, z in joined_runs]
            out.append(b"\n".join(parts).decode())
        cols = [b.column(c) for c in names]
        cols[where] = pa.array(out, pa.string())
        if "n_chars" in names:
            cols[names.index("n_chars")] = pa.array([len(x) for x in out], b.column("n_chars").type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*names, "__size", "__runs").mapInArrow(common.per_batch(cut), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return words_taken(mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "size", "source_size", "target", "taken")
