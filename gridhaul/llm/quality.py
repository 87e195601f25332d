"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A text becomes a vector of fixed length (shares of byte classes and of pairs of byte classes, repetition,
word and line shape), from the whole text and nothing else. A pair of a good and a bad document says that
the good one is preferred; weights minimise the logistic loss on the difference of the two vectors. All labelled
rows are dealt to blocks of about BLOCK of each kind, by a hash of the id; of a rarer kind a row goes to several. All pairs
within a block count, so pairs grow with the rows; a round of Newton's method adds up the blocks' gradients and
Hessians, and only these reach the driver. The cut is the exact quantile of all labelled rows' scores at the share
of bad documents; scores are the logistic function of the distance to it.

Null and empty texts have the vector of an empty text and a score like any other. Repeated rows are scored
one by one; a null doc_id is not held out. An empty table gives no rows; without labels of both kinds, all
scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridhaul.llm import common

BLOCK = 256  # labelled rows of a kind that meet
RIDGE = 1.0  # for RIDGE_PAIRS pairs or fewer, in proportion for more
RIDGE_PAIRS = 30_000
SPLITS = 4_096  # of the range of scores in one look for a quantile
PAIR_SLOTS = 128
SCORE = "__quality"  # columns that begin so are reserved
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """Byte to class: lower, upper, digit, blank, line end, lead and trail bytes of UTF-8, each mark, others."""
    out = np.full(256, 7, np.int64)
    for k, these in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c", b"\n\r", range(0xC0, 0x100), range(0x80, 0xC0))):
        out[list(these)] = k
    for k, b in enumerate(MARKS):
        out[b] = 8 + k
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
PAIR = np.random.default_rng(5).integers(0, PAIR_SLOTS, N_CLASSES * N_CLASSES)
N_SHAPE = 8
N_FEATURES = N_CLASSES + PAIR_SLOTS + N_SHAPE


def features(text: bytes) -> np.ndarray:
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    classes = CLASS[np.frombuffer(text, np.uint8)]
    n = len(classes)
    out[:N_CLASSES] = np.sqrt(np.bincount(classes, minlength=N_CLASSES) / n)
    if n > 1:
        out[N_CLASSES : N_CLASSES + PAIR_SLOTS] = np.sqrt(np.bincount(PAIR[classes[:-1] * N_CLASSES + classes[1:]], minlength=PAIR_SLOTS) / (n - 1))
    words, lines = text.split(), text.split(b"\n")
    w = len(words)
    if w:
        distinct = len(set(words))
        repeated = sum(map(eq, words, words[1:])) / w
        out[-N_SHAPE:] = (np.log1p(w), distinct / w, np.log1p(w) * (1 - distinct / w), np.sqrt(repeated), min(n / w, 40) / 10, len(set(lines)) / len(lines), np.log1p(n / len(lines)), repeated > 0.2)
    return out


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    texts = common.blobs(b.column("text"))
    return np.stack([features(x) for x in texts])


def _pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss over all pairs."""
    p = 1 / (1 + np.exp(-np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    h = p * (1 - p)
    mixed = good.T @ h @ bad
    grad = good.T @ (p - 1).sum(1) - bad.T @ (p - 1).sum(0)
    return grad, (good * h.sum(1)[:, None]).T @ good + (bad * h.sum(0)[:, None]).T @ bad - mixed - mixed.T


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float) -> np.ndarray:
    w = np.zeros(width)
    for _ in range(12):
        grad, hess = sums(w)
        step = np.linalg.solve(hess + ridge * np.eye(width), grad + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)  # sums come in any order


def fit_pairs(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the Bradley-Terry model over all pairs of two small tables, by Newton's method."""
    return _newton(lambda w: _pair_sums(good, bad, w), good.shape[1], ridge * max(1.0, len(good) * len(bad) / RIDGE_PAIRS))


class Model:
    """Standardisation, weights, cut and slope."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ((x - self.mean) / self.scale @ self.weights - self.cut), -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, wanted) -> DataFrame:
    """doc_id, label and x (the vector) of all wanted labelled documents, a row an id; of contradicting labels and texts the least counts.

    Vectors are made before the join, so no text is shuffled.
    """

    def vectors(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([v.tobytes() for v in _vectors(b)], pa.binary())], names=["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & wanted)
    x = texts.filter(F.col("doc_id").isNotNull() & wanted).mapInArrow(common.per_batch(vectors), "doc_id long, x binary")
    rows = x.join(found.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.*")


def _matrix(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows there are, and the mean and deviation of their vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((2, N_FEATURES))
        for b in batches:
            x = _matrix(b.column("x").to_pylist())
            n, sums = n + len(x), sums + (x.sum(0), (x * x).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

    found = rows.select("x").mapInArrow(add, "n long, sums binary").collect()
    n = sum(r.n for r in found)
    first, second = sum(np.frombuffer(r.sums).reshape(2, -1) for r in found) / max(n, 1)
    return n, np.round(first, 9), np.round(np.sqrt(np.maximum(second - first * first, 0)) + 1e-3, 9)


def _blocks(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """good and bad (vectors of one block, one after another), and how many pairs they make."""
    k = -(-max(n_good, n_bad) // BLOCK)
    copies = {1: min(k, -(-BLOCK * k // n_good)) if n_good < n_bad else 1, 0: min(k, -(-BLOCK * k // n_bad)) if n_bad < n_good else 1}
    places = F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        label, x = np.array(t["label"]), t["x"].to_pylist()
        kinds = [[x[i] for i in np.flatnonzero(label == kind)] for kind in (1, 0)]
        return pa.table({"good": pa.array([b"".join(kinds[0])], pa.binary()), "bad": pa.array([b"".join(kinds[1])], pa.binary()), "pairs": pa.array([len(kinds[0]) * len(kinds[1])], pa.int64())})

    dealt = rows.withColumn("place", F.explode(places)).withColumn("block", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(k)) + F.col("place"), F.lit(k)))
    return common.work_table(dealt.select("block", "doc_id", "label", "x").groupBy("block").applyInArrow(pack, "good binary, bad binary, pairs long"), "quality-blocks")


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The value of s that has rank values before it (from 0): ranges are counted, and the one that holds it is split again."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        part = F.least(F.floor((F.col("s") - low) / (high - low) * SPLITS), F.lit(SPLITS - 1))
        ranges = scores.filter(F.col("s").between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
        for r in ranges:
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def fit(docs: DataFrame, labels: DataFrame, wanted) -> Model | None:
    rows = common.work_table(_labelled(docs, labels, wanted), "quality-vectors")
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        common.discard(rows)
        return None
    n, mean, scale = _moments(rows)
    blocks = _blocks(rows, count[1], count[0])
    pairs = blocks.agg(F.sum("pairs")).first()[0]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, hess = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
            for b in batches:
                for good, bad in zip(b.column("good").to_pylist(), b.column("bad").to_pylist(), strict=True):
                    g, h = _pair_sums((_matrix([good]) - mean) / scale, (_matrix([bad]) - mean) / scale, w)
                    grad, hess = grad + g, hess + h
            yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary()), pa.array([hess.tobytes()], pa.binary())], names=["grad", "hess"])

        found = blocks.select("good", "bad").mapInArrow(add, "grad binary, hess binary").collect()
        return sum(np.frombuffer(r.grad) for r in found), sum(np.frombuffer(r.hess).reshape(N_FEATURES, -1) for r in found)

    weights = _newton(sums, N_FEATURES, RIDGE * max(1.0, pairs / RIDGE_PAIRS))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        s = ((_matrix(b.column("x").to_pylist()) - mean) / scale * weights).sum(1)
        return pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    scores = common.work_table(rows.select("x").mapInArrow(common.per_batch(score), "s double"), "quality-scores")
    cut = (_at_rank(scores, count[0] - 1) + _at_rank(scores, count[0])) / 2  # the quantile at the share of bad documents
    spread = scores.agg(F.avg(F.abs(F.col("s") - cut))).first()[0]
    common.discard(rows, blocks, scores)
    return Model(mean, scale, weights, cut, 1.0 / (spread / 4 + 1e-9))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column SCORE."""
    names = docs.columns

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.full(b.num_rows, 0.5) if model is None else model.score(_vectors(b).astype(np.float64))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s)], names=[*names, SCORE])

    return docs.mapInArrow(common.per_batch(score), StructType([*docs.schema.fields, StructField(SCORE, DoubleType())]))


def training(modulus: int = 3, held: int = 1):
    return common.fold(F.col("doc_id"), modulus) != held


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training())
    out = scored(docs, model)
    held = F.coalesce(~training(), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
