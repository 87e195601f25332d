"""Language-model scores of whole texts by a log-bilinear neural model, trained with noise-contrastive estimation.

Token counts are gathered over all training texts. The model predicts a class for each token: the most
frequent tokens (and the end of a text) are classes of their own, all others share BUCKETS classes by their
first two bytes, and inside such a class tokens have add-one probabilities from the corpus counts, one share
being for all unseen ones. The class depends on the two tokens before: q = r(w-1) A + r(w-2) B, score
q.s(w) + bias(w). Training texts are dealt to shards by a hash of id and text, one shard for every SHARD_TOKENS tokens of the corpus; every
shard trains a copy over all its tokens, from weights warmed up on a small sample, and the copies are averaged by tokens. Shards and their order
depend on the texts alone, so scores don't change with files, partitions or cores. Since the score is a sum of two tables, the
normaliser of every pair of contexts is one matrix product, and class probabilities are exactly normalised.

Only the most frequent tokens, LOOKUP at most, are sent to the workers; counts of rarer ones come by a join on the
token, in which frequent tokens have no part. Null texts are empty and have one token, the end. Repeated rows
are scored one by one; a null doc_id belongs to no fold and is neither trained on nor held out. Without
training texts no token is known: the base score is 0 and classes are as likely as untrained weights have them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common

LOOKUP = 200_000
STEPS = 32
CLASSES, BUCKETS = 1024, 64
WIDTH = 16
BATCH, NOISE = 2048, 32
RATE = 0.15
WARM_DOCS, WARM_TOKENS = 300, 4_000  # the warm-up's sample: so many whole texts of at most that length
FAN_IN = 64
SHARD_TOKENS = 1_000_000  # of the corpus, a shard of training
FLUSH = 400_000
END = b""  # no word is empty
LN10 = float(np.log(10))


def bucket(token: bytes) -> int:
    return zlib.crc32(token[:2]) % BUCKETS


def token_counts(texts: DataFrame) -> DataFrame:
    """token (bytes, the end as empty) and its count in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

        for b in batches:
            texts_ = common.blobs(b.column("text"))
            ends += len(texts_)
            for x in texts_:
                seen.update(x.lower().split())
                if len(seen) > FLUSH:
                    yield flush()
                    seen.clear()
        if ends:
            seen[END] += ends
            yield flush()

    return texts.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What workers know of the corpus: frequent tokens with class and count, and the totals of each bucket."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int, buckets: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        n_own = min(len(frequent), CLASSES - BUCKETS)
        self.index = {t: k for k, (t, _) in enumerate(frequent)}
        counts = np.array([c for _, c in frequent], np.int64)
        own = np.arange(len(frequent)) < n_own
        self.klass = np.where(own, np.arange(len(frequent)) + BUCKETS, [bucket(t) for t, _ in frequent] if frequent else np.zeros(0)).astype(np.int64)
        self.n_classes = BUCKETS + n_own
        n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for k, (tokens, kinds) in buckets.items():
            n[k], v[k] = tokens, kinds
        own_buckets = np.array([bucket(t) for t, _ in frequent[:n_own]], np.int64)
        np.subtract.at(n, own_buckets, counts[:n_own])
        np.subtract.at(v, own_buckets, 1)
        self.room = (n + v + 1).astype(float)  # of each bucket; the last share is for all unseen tokens
        self.class_counts = np.concatenate([n + 1, counts[:n_own]]).astype(float)
        self.base = np.log10((counts + 1) / self.base_room)
        self.inside = np.where(own, 0.0, np.log10((counts + 1) / self.room[np.minimum(self.klass, BUCKETS - 1)]))
        self.end = self.index.get(END, -1)

    @property
    def base_room(self) -> float:
        return float(self.total + self.distinct + 1)

    def numbers(self, text: bytes) -> tuple[list[int], list[bytes]]:
        """Numbers of a text's tokens, its end included; -1 for rare ones, which follow."""
        words, get = text.lower().split(), self.index.get
        found = [get(w, -1) for w in words]
        found.append(self.end)
        return found, [w for w, k in zip(words, found, strict=False) if k < 0]

    def classes(self, numbers: np.ndarray, rare: list[bytes]) -> np.ndarray:
        out = self.klass[numbers] if len(self.klass) else np.zeros(len(numbers), np.int64)
        if len(lost := np.flatnonzero(numbers < 0)):
            found = np.full(len(lost), bucket(END))
            found[: len(rare)] = [bucket(w) for w in rare]
            out[lost] = found
        return out


class LogBilinear:
    """Weights, their NCE training and the tables for scoring."""

    def __init__(self, class_counts: np.ndarray, width: int = WIDTH, seed: int = 11):
        rng, n = np.random.default_rng(seed), len(class_counts)
        p = class_counts / class_counts.sum()
        self.noise_p = p
        self.log_noise = np.log(p).astype(np.float32)
        shapes = {"r": (n, width), "s": (n, width), "a": (width, width), "b": (width, width), "bias": (n,)}
        self.w = {k: (0.3 * rng.standard_normal(x)).astype(np.float32) for k, x in shapes.items()}
        self.w["a"], self.w["b"] = np.eye(width, dtype=np.float32), 0.5 * np.eye(width, dtype=np.float32)
        self.w["s"] *= 0.3
        self.w["bias"] = self.log_noise.copy()

    def start(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.cdf = np.cumsum(self.noise_p)
        self.seen = {k: np.full(x.shape, 1e-3, np.float32) for k, x in self.w.items()}

    def step(self, target: np.ndarray, near: np.ndarray, far: np.ndarray, rate: float = RATE) -> None:
        """One batch: data against NOISE classes drawn from the unigram distribution, shared by the batch."""
        w, n, d = self.w, len(self.noise_p), self.w["a"].shape[0]
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), n - 1)
        rn, rf, st, sn = w["r"][near], w["r"][far], w["s"][target], w["s"][noise]
        q = rn @ w["a"] + rf @ w["b"]
        shift = np.float32(np.log(NOISE))
        data = (q * st).sum(1) + w["bias"][target] - self.log_noise[target] - shift
        fake = q @ sn.T + w["bias"][noise] - self.log_noise[noise] - shift
        g_data = -1 / (1 + np.exp(np.clip(data, -30, 30)))  # of the negative log likelihood
        g_fake = 1 / (1 + np.exp(np.clip(-fake, -30, 30)))
        dq = g_data[:, None] * st + g_fake @ sn

        def spread(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.bincount((at[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)

        grads = {
            "a": rn.T @ dq, "b": rf.T @ dq, "r": spread(near, dq @ w["a"].T) + spread(far, dq @ w["b"].T),
            "s": spread(target, g_data[:, None] * q) + spread(noise, g_fake.T @ q),
            "bias": (np.bincount(target, g_data, n) + np.bincount(noise, g_fake.sum(0), n)).astype(np.float32),
        }
        for k, g in grads.items():
            g /= len(target)
            self.seen[k] += g * g
            w[k] -= (rate * (0.2 if k in "ab" else 1)) * g / np.sqrt(self.seen[k])

    def train(self, streams: Iterator[np.ndarray], end: int, batch: int = BATCH) -> int:
        """Class sequences of texts, joined into batches; the number of tokens."""
        held, n = [], 0
        for s in streams:
            near, far = np.concatenate([[end], s[:-1]]), np.concatenate([[end, end], s[:-2]])[: len(s)]
            held.append(np.stack([s, near, far]))
            if sum(x.shape[1] for x in held) >= batch:
                n += self._run(np.concatenate(held, axis=1), batch)
                held = []
        return n + (self._run(np.concatenate(held, axis=1), batch) if held else 0)

    def _run(self, x: np.ndarray, batch: int) -> int:
        for lo in range(0, x.shape[1], batch):
            self.step(*x[:, lo : lo + batch])
        return x.shape[1]

    def pack(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in sorted(self.w))

    def unpack(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, np.float32), 0
        for k in sorted(self.w):
            size = self.w[k].size
            self.w[k] = flat[at : at + size].reshape(self.w[k].shape).copy()
            at += size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs: near[v, w] + far[u, w] - norm[v, u] is the log probability of class w after u, v."""
        near = (self.w["r"] @ self.w["a"] @ self.w["s"].T + self.w["bias"]).astype(np.float32)
        far = (self.w["r"] @ self.w["b"] @ self.w["s"].T).astype(np.float32)
        tops = near.max(1, keepdims=True), far.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(near - tops[0]) @ np.exp(far - tops[1]).T, 1e-37)) + tops[0] + tops[1].T
        return near, far, norm.astype(np.float32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: a written table of token and n."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = sorted((r.k, r["count"]) for r in counts.groupBy(step.alias("k")).count().collect())  # STEPS a doubling of n
    least, room = None, LOOKUP - 1
    for k, size in reversed(sizes):
        if size > room:
            break
        least, room = k, room - size
    chosen = (F.col("token") == END) | (F.lit(False) if least is None else step >= least)  # LOOKUP tokens at most
    frequent = sorted(counts.filter(chosen).collect(), key=lambda r: (bytes(r.token) != END, -r.n, bytes(r.token)))
    inside = counts.groupBy((F.crc32(F.substring("token", 1, 2)) % BUCKETS).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    return Vocabulary([(bytes(r.token), r.n) for r in frequent], total[0], total[1], {r.k: (r.n, r.v) for r in inside})


ENCODED = "row long, doc_id long, held_out boolean, trains boolean, seq binary, n_tokens long, n_known long, base double, inside double, rare array<binary>, times array<long>"


def encoded(docs: DataFrame, words) -> DataFrame:
    """Every text (docs: doc_id, held_out, trains, text) as its classes (16-bit), what is known of its frequent tokens,
    and its rare tokens with their numbers. words: the broadcast vocabulary."""

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        v: Vocabulary = words.value
        base, inside = np.append(v.base, 0.0), np.append(v.inside, 0.0)  # number -1: by the join
        rows = []
        for text in common.blobs(b.column("text")):
            numbers, rare = v.numbers(text)
            x = np.array(numbers)
            seq = v.classes(x, rare).astype("<u2").tobytes()
            some = Counter(rare + ([END] if v.end < 0 else []))
            rows.append((seq, len(x), len(x) - some.total(), float(base[x].sum()), float(inside[x].sum()), list(some), list(some.values())))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        cols = [b.column(c) for c in ("row", "doc_id", "held_out", "trains")] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in ENCODED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "trains", "text")
    return common.work_table(rows.mapInArrow(common.per_batch(encode), ENCODED), "lm-encoded")


def train(texts: DataFrame, words) -> LogBilinear:
    """A model of encoded texts. Every partition trains over all its texts; copies are averaged by tokens."""
    spark = texts.sparkSession
    vocab: Vocabulary = words.value
    model = LogBilinear(vocab.class_counts)
    if vocab.end < 0:
        return model

    def sequence(seq: bytes) -> np.ndarray:
        return np.frombuffer(seq, "<u2").astype(np.int64)

    short = common.sampled(texts.filter(F.col("n_tokens") <= WARM_TOKENS), WARM_DOCS, "doc_id")
    sample = sorted(short.select("doc_id", "seq").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r.seq)))
    model.start(0)
    model.train((sequence(r.seq) for r in sample), int(vocab.klass[vocab.end]), 512)
    warm = spark.sparkContext.broadcast(model.pack())
    shards = -(-vocab.total // SHARD_TOKENS)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        runs = ((shard, seq) for b in batches for shard, seq in zip(b.column("shard").to_pylist(), b.column("seq").to_pylist(), strict=True))
        for _, run in groupby(runs, lambda r: r[0]):
            copy = LogBilinear(v.class_counts)
            copy.unpack(warm.value)
            copy.start(1)
            n = copy.train((sequence(seq) for _, seq in run), int(v.klass[v.end]))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([copy.pack()], pa.binary())], names=["n", "weights"])

    def averaged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "weights"])
        n = rows["n"].to_numpy(float)
        flat = sum(k * np.frombuffer(x, np.float32).astype(float) for k, x in zip(n / n.sum(), rows["weights"], strict=True))
        return pd.DataFrame({"n": [int(n.sum())], "weights": [flat.astype(np.float32).tobytes()]})

    mark = F.xxhash64("doc_id", "seq")
    dealt = texts.select(F.pmod(mark, F.lit(shards)).alias("shard"), mark.alias("mark"), "doc_id", "seq").repartition(shards, "shard").sortWithinPartitions("shard", "mark", "doc_id", "seq")
    found = common.work_table(dealt.select("shard", "seq").mapInArrow(copies, "n long, weights binary"), "lm-copies")
    left = found.count()
    while left > FAN_IN:  # so many copies at most meet in one task or on the driver
        left = -(-left // FAN_IN)
        found = common.work_table(found.groupBy(F.pmod(F.xxhash64("weights"), F.lit(left))).applyInPandas(averaged, "n long, weights binary"), "lm-copies")
        left = min(left, found.count())
    rows = found.toPandas()
    model.unpack(averaged(rows)["weights"][0])
    return model


def score(texts: DataFrame, counts: DataFrame, words, model: LogBilinear) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score, score of every encoded text."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model.tables())
    vocab: Vocabulary = words.value
    end = int(vocab.klass[vocab.end]) if vocab.end >= 0 else bucket(END)
    schema = "row long, token binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bucket int"

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        near_t, far_t, norm = sent.value
        natural = []
        for seq in b.column("seq").to_pylist():
            c = np.frombuffer(seq, "<u2").astype(np.int64)
            near, far = np.concatenate([[end], c[:-1]]), np.concatenate([[end, end], c[:-2]])[: len(c)]
            natural.append(float((near_t[near, c] + far_t[far, c] - norm[near, far]).sum(dtype=np.float64)))
        ids = b.column("row").to_pylist()
        found = np.array(natural) / LN10 + b.column("inside").to_numpy()
        lists = b.column("rare").to_pylist()
        tokens, times = [t for x in lists for t in x], [k for x in b.column("times").to_pylist() for k in x]
        rows = np.repeat(np.array(ids, np.int64), [len(x) for x in lists]).tolist()
        n, m = len(ids), len(tokens)
        cols = [ids + rows, [b" %d" % r for r in ids] + tokens, [0] * n + times]
        cols += [b.column(c).to_pylist() + [None] * m for c in ("doc_id", "held_out", "n_tokens", "n_known", "base")] + [found.tolist() + [None] * m, [None] * n + [bucket(t) for t in tokens]]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    flat = texts.mapInArrow(common.per_batch(scored), schema)
    rooms = F.array(*[F.lit(float(x)) for x in vocab.room])
    joined = flat.join(counts.withColumnRenamed("n", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = F.col("times") > 0
    part = lambda room: F.when(rare, F.col("times") * F.log10((F.col("c") + 1) / room)).otherwise(0.0)
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(rare & (F.col("c") > 0), F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(part(F.lit(vocab.base_room)))).alias("base_score"),
        (F.max("score") + F.sum(part(F.get(rooms, F.col("bucket"))))).alias("score"),
    )


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all docs from a model of those that held_out (over doc_id) doesn't mark; null marks no fold."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    texts = rows.filter(~held_out)
    counts = common.work_table(token_counts(texts), "token-counts")
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(counts))
    ready = encoded(rows.select("*", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("trains")), words)
    out = score(ready, counts, words, train(ready.filter("trains"), words))
    return out.withColumn("train_tokens", F.lit(words.value.total).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), common.fold(F.col("doc_id"), 7) == 2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
