"""Toxicity classifier with counterfactual regularisation.

A text is the set of its words and of the words' beginnings (4 to 6 letters), so that unseen endings of a known
stem count. Features that toxic training texts favour enter a logistic regression. For every labelled text
that mentions a group, counterfactual texts are built, one for each other term of the list: the mention is replaced in
the text and all features are taken anew, words and beginnings alike. The squared difference of the two texts' scores is
penalised, so no trace of the mention earns weight and neutral mentions stay clean. A score of 0.5 is the cut that parts
the sample's two kinds best. Fitting uses about MAX_TOXIC and MAX_CLEAN labelled rows at most; scoring reads every whole text.

Null and empty texts have no features and a score like any other. Repeated rows are scored one by one; a null
doc_id is not held out. An empty table gives no rows; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common
from gridhaul.llm.labelled import labelled_documents, labelled_ids

MAX_TOXIC, MAX_CLEAN = 3_000, 6_000
CANDIDATES = 30_000  # features that enough toxic texts of the sample have
MAX_FEATURES = 1_000
LEAST = 4  # toxic texts with a feature
STEMS = (4, 5, 6)
CACHE = 400_000
MARKS = b".,!?;:*#$%&|\"'()[]{}<>-_=+/\\~`"
#: Terms that may stand in for each other, by language.
IDENTITY = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male"),
    ("christian", "christians", "muslim", "muslims", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "indian", "arab", "american", "mexican", "chinese"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("blind", "deaf", "disabled", "elderly", "old", "young"),
    ("immigrants", "immigrant", "refugees", "refugee", "migrants", "migrant", "foreigners", "foreigner"),
    ("frauen", "männer", "mädchen", "jungen", "frau", "mann"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "christlich", "muslimisch", "jüdisch"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "türken", "amerikaner"),
    ("schwule", "lesben", "schwul", "lesbisch", "heterosexuelle", "bisexuelle"),
    ("blinde", "gehörlose", "behinderte", "alte", "junge"),
    ("einwanderer", "flüchtlinge", "migranten", "ausländer"),
    ("femmes", "hommes", "filles", "garçons", "femme", "homme"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "chrétien", "musulman", "juif"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes", "américains"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("aveugles", "sourds", "handicapés", "vieux", "jeunes"),
    ("immigrés", "réfugiés", "migrants", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños", "mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "cristiano", "musulmán", "judío"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes", "americanos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("ciegos", "sordos", "discapacitados", "viejos", "jóvenes"),
    ("inmigrantes", "refugiados", "migrantes", "extranjeros"),
)
RIDGE, COUNTERFACTUAL = 1.0, 200.0
#: Each term's other terms; a term of several lists has those of all.
OTHERS: dict[bytes, tuple[bytes, ...]] = {t.encode(): tuple(sorted({o.encode() for g in IDENTITY if t in g for o in g} - {t.encode()})) for g in IDENTITY for t in g}


def word_features(word: bytes) -> tuple[bytes, ...]:
    """Names of what a word counts as: itself and its beginnings."""
    core = word.strip(MARKS)
    if not core:
        return ()
    text = core.decode("utf-8", "replace")
    return (b"w" + core, *(b"s" + text[:n].encode() for n in STEMS if len(text) > n))


class Index(dict):
    """Word to the numbers of its features that the model knows; forgets when it grows too large."""

    def __init__(self, names: list[bytes]):
        self.number = {n: k for k, n in enumerate(names)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(k for n in word_features(word) if (k := self.number.get(n)) is not None)
        return found

    def of(self, text: bytes) -> set[int]:
        out: set[int] = set()
        for f in map(self.__getitem__, set(text.lower().split())):
            if f:
                out.update(f)
        return out


def _candidates(toxic: DataFrame) -> list[bytes]:
    """The features that most toxic texts have, LEAST of them at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            for text in common.blobs(b.column("text")):
                for f in {f for w in set(text.lower().split()) for f in word_features(w)}:
                    seen[f] = seen.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["name", "n"])

    found = toxic.select("text").mapInArrow(count, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    return [bytes(r.name) for r in found.orderBy(F.desc("n"), "name").limit(CANDIDATES).collect()]


def counterfactuals(text: bytes, index: Index) -> list[tuple[list[int], list[int]]]:
    """(lost, gained) features of the text for each other term that takes the place of one it mentions."""
    words = set(text.lower().split())
    cores = {w: w.strip(MARKS) for w in words}
    out = []
    for term in sorted(set(cores.values()) & OTHERS.keys()):
        rest = {f for w, core in cores.items() if core != term for f in index[w]}
        was = set(index[term])
        for other in OTHERS[term]:
            now = set(index[other])
            lost, gained = was - rest - now, now - rest - was
            if lost or gained:
                out.append((sorted(lost), sorted(gained)))
    return out


GRAM_PARTS = 8  # groups of the sample whose sums the driver adds


def fit_logistic(x: np.ndarray, y: np.ndarray, changes: np.ndarray, rounds: int = 25, gram: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept: logistic loss, ridge, and the squared score change of each row of changes (features of the
    swapped text less those of the text, scaled by the root of its share); gram, if given, is the sum of their outer products."""
    n, d = x.shape
    penalty = np.full(d, RIDGE)
    change = COUNTERFACTUAL * (gram if gram is not None else changes.T @ changes)
    w, b0 = np.zeros(d), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b0, -30, 30)))
        r, v = p - y, np.maximum(p * (1 - p), 1e-4)
        xv = x * v[:, None].astype(x.dtype)
        hess = np.empty((d + 1, d + 1))
        hess[:d, :d] = x.T @ xv + np.diag(penalty) + change
        hess[:d, d] = hess[d, :d] = xv.sum(0)
        hess[d, d] = v.sum()
        grad = np.append(x.T @ r.astype(x.dtype) + penalty * w + change @ w, r.sum())
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / (np.abs(step).max() + 1e-12))
        w, b0 = w - step[:d], b0 - step[d]
        if np.abs(step).max() < 1e-5:
            break
    return w, b0


def cut_point(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cuts that tell the two kinds of the sample apart best (share of toxic less share of clean above)."""
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    gain = (1 - np.cumsum(t) / t.sum()) - (1 - np.cumsum(1 - t) / (1 - t).sum())
    gain[:-1][s[:-1] == s[1:]] = -1.0  # no cut between equal scores
    best = np.flatnonzero(gain[:-1] >= gain[:-1].max() - 1e-12)
    k = best[len(best) // 2]
    return float((s[k] + s[k + 1]) / 2)


class Model:
    def __init__(self, names: list[bytes], weights: np.ndarray, intercept: float):
        self.names, self.weights, self.intercept = names, weights, intercept

    def scorer(self):
        index, w, b0 = Index(self.names), self.weights.tolist(), self.intercept
        return lambda text: float(1 / (1 + np.exp(-np.clip(sum(w[k] for k in index.of(text)) + b0, -30, 30))))


def _swap_gram(sample: DataFrame, names: list[bytes], place: np.ndarray, d: int) -> np.ndarray:
    """The sum over swaps of the outer product of their score changes, a text's swaps weighing one together: added up in GRAM_PARTS groups of the
    sample, of which only the features that swaps change come to the driver."""
    sent = sample.sparkSession.sparkContext.broadcast((names, place))

    def added(table: pa.Table) -> pa.Table:
        names, place = sent.value
        index, total = Index(names), np.zeros((d, d))
        for text in common.blobs(table.column("text")):
            changes = []
            for lost, gained in counterfactuals(text, index):
                row = np.zeros(d)
                for side, sign in ((lost, -1.0), (gained, 1.0)):
                    at = place[np.array(side, np.int64)]
                    row[at[at >= 0]] = sign
                changes.append(row)
            if changes:
                rows = np.array(changes)
                total += rows.T @ rows / len(rows)
        used = np.flatnonzero(total.diagonal())
        return pa.table({"used": pa.array([used.astype("<i8").tobytes()], pa.binary()), "gram": pa.array([total[np.ix_(used, used)].tobytes()], pa.binary())})

    dealt = sample.select(F.pmod(F.xxhash64("doc_id"), F.lit(GRAM_PARTS)).alias("key"), "text").groupBy("key")
    out = np.zeros((d, d))
    for r in dealt.applyInArrow(added, "used binary, gram binary").collect():
        used = np.frombuffer(r.used, "<i8")
        out[np.ix_(used, used)] += np.frombuffer(r.gram).reshape(len(used), len(used))
    return out


def fit(docs: DataFrame, labels: DataFrame, wanted) -> Model | None:
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))  # of contradicting labels the least
    some = [labelled_ids(known.filter(F.col("toxic") == k), "toxic", wanted, n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    texts = labelled_documents(docs, some[0].unionByName(some[1])).groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of several texts the least
    sample = common.work_table(texts, "toxicity-sample")
    names = _candidates(sample.filter("label = 1"))
    sent = spark.sparkContext.broadcast(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in batches:
            if b.num_rows:
                texts = common.blobs(b.column("text"))
                x = [np.array(sorted(index.of(t)), "<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    found = sorted(sample.mapInArrow(rows, "doc_id long, label int, x binary").collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in found], float)
    if not ((y == 0).any() and (y == 1).any()):
        return None
    hits = np.zeros((2, len(names)))
    for r in found:
        hits[r.label, np.frombuffer(r.x, "<u2")] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p1, p0 = (hits[1] + 0.5) / (n1 + 1), (hits[0] + 0.5) / (n0 + 1)
    pooled = (hits[0] + hits[1] + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    chosen = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = chosen[z[chosen] > 2]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(found), len(chosen)), np.float32)
    for i, r in enumerate(found):
        at = place[np.frombuffer(r.x, "<u2")]
        x[i, at[at >= 0]] = 1
    kept = [names[k] for k in chosen]
    weights, intercept = fit_logistic(x, y, np.zeros((0, len(chosen))), gram=_swap_gram(sample, names, place, len(chosen)))
    logits = x @ weights.astype(x.dtype) + intercept
    return Model(kept, weights, intercept - cut_point(logits, y))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and toxicity of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer() if model else lambda text: 0.0
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f(x) for x in common.blobs(b.column("text"))], pa.float64())], names=["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, toxicity double")


def training(modulus: int = 5, held: int = 0):
    return common.fold(F.col("doc_id"), modulus) != held


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training())
    held = F.coalesce(~training(), F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
