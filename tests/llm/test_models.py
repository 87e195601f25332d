import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridhaul.llm import common, lm_scoring, quality, toxicity
from tests.llm import docs

GOOD = ["the house stands by the river and the road leads to it", "we walked in the morning and found the old bridge", "a letter came with news of the harvest"]


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = lm_scoring.LogBilinear(rng.integers(1, 100, 90).astype(float))
    model.start(0)
    x = rng.integers(0, 90, 4000)
    model.train(iter([x]), 0, 256)
    near, far, norm = model.tables()
    for v, u in ((0, 1), (5, 88), (40, 40)):
        assert abs(np.exp(near[v] + far[u] - norm[v, u]).sum() - 1) < 1e-3


def test_training_learns_a_pattern():
    """Class k is followed by k+1: the model must beat the unigram by far."""
    x = np.arange(40_000) % 20
    model = lm_scoring.LogBilinear(np.bincount(x).astype(float))
    model.start(0)
    model.train(iter(np.split(x, 40)), 0, 256)
    near, far, norm = model.tables()
    score = (near[x[1:-1], x[2:]] + far[x[:-2], x[2:]] - norm[x[1:-1], x[:-2]]).mean()
    assert score > math.log(1 / 20) + 1.5


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LOOKUP", 50)  # so that rare tokens come by the join
    rows = docs.odd(3000) + [(500 + k, docs.words(k, 80, 300), "s") for k in range(60)]
    found = lm_scoring.lm_scores(docs.table(spark, rows), common.fold(F.col("doc_id"), 7) == 2).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    counts = Counter(x for i, t, _ in rows if i is not None and not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    some = [r for r in found if r.held_out]
    assert sum(r.score for r in some) > 1.02 * sum(r.base_score for r in some)  # random words: nothing to learn, little to lose


def test_lm_scores_equal_a_plain_loop(spark, monkeypatch):
    """The score, token by token from the same weights by an explicit softmax; however the table is split."""
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 1500)
    rows = [(k, docs.words(k, 40 + k, 300), "s") for k in range(50)] + [(90, None, "s"), (91, "never seen W1", "s")]
    table = docs.table(spark, rows)
    found = {r.doc_id: r.score for r in lm_scoring.lm_scores(table.repartition(1), F.lit(False) | (F.col("doc_id") >= 45)).collect()}
    again = {r.doc_id: r.score for r in lm_scoring.lm_scores(table.repartition(7), F.lit(False) | (F.col("doc_id") >= 45)).collect()}
    assert found.keys() == again.keys() and all(abs(found[k] - again[k]) < 1e-6 for k in found)
    texts = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = common.work_table(lm_scoring.token_counts(texts.filter("doc_id < 45")), "counts")
    v = lm_scoring.vocabulary(counts)
    words = spark.sparkContext.broadcast(v)
    ready = lm_scoring.encoded(texts.select("*", F.lit(False).alias("held_out"), (F.col("doc_id") < 45).alias("trains")), words)
    w = lm_scoring.train(ready.filter("trains"), words).w
    seen = {bytes(r.token): r.n for r in counts.collect()}
    own = set(v.index) if len(v.index) <= lm_scoring.CLASSES - lm_scoring.BUCKETS else None
    end = int(v.klass[v.end])
    for i, t, _ in rows:
        total, near, far = 0.0, end, end
        for token in [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), b""]:
            c = int(v.klass[v.index[token]]) if token in own else lm_scoring.bucket(token)
            q = w["r"][near].astype(float) @ w["a"] + w["r"][far].astype(float) @ w["b"]
            logits = w["s"].astype(float) @ q + w["bias"]
            inside = 1.0 if token in own else (seen.get(token, 0) + 1) / v.room[c]
            total += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10) + math.log10(inside)
            near, far = c, near
        assert abs(total - found[i]) < 1e-3 * (1 + abs(total))


def test_lm_scores_without_training_texts(spark):
    table = docs.table(spark, [(1, "a b", "s"), (2, None, "s")])
    assert lm_scoring.lm_scores(table.limit(0), F.col("doc_id") == 0).count() == 0
    found = lm_scoring.lm_scores(table, F.lit(True)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}


def corpus():
    rows, labels = [], []
    for k in range(240):
        base = " ".join(GOOD[(k + j) % 3] for j in range(1 + k % 4)) + " " + docs.words(k, 30)
        kind = k % 6
        text = {0: base.upper().replace(" ", "!! "), 1: base.replace(" ", "### ")}.get(kind, base)
        rows.append((k, text, "s"))
        labels.append((k, int(kind > 1), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    table = docs.table(spark, rows + docs.odd(500))
    model = quality.fit(table, lab, quality.training())
    out = quality.scored(table, model)
    assert out.columns == [*table.columns, quality.SCORE] and out.count() == len(rows) + len(docs.odd())
    truth = {k: q for k, q, _ in labels}
    held = [r for r in out.filter("text IS NOT NULL").collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and (r.doc_id, r.text, "s") in set(rows)]
    assert len(held) > 50 and all((r[quality.SCORE] >= 0.5) == truth[r.doc_id] for r in held)
    assert all(0 <= r[quality.SCORE] <= 1 for r in out.collect())
    assert quality.fit(table, lab.limit(0), quality.training()) is None
    assert {r[quality.SCORE] for r in quality.scored(table, None).collect()} == {0.5}


def test_preference_pairs():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (200, 3))
    w = quality.fit_pairs(good, bad)
    assert ((good @ w)[:, None] > (bad @ w)[None, :]).mean() > 0.95


def test_counterfactual_penalty_removes_identity_weight():
    """A term that toxic texts mention more often: without the penalty it earns weight, with it hardly any."""
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.4).astype(float)
    insult = (rng.random(600) < np.where(y == 1, 0.8, 0.01)).astype(np.float32)
    group = (rng.random(600) < np.where(y == 1, 0.6, 0.2)).astype(np.float32)
    other = (rng.random(600) < 0.1).astype(np.float32)
    x = np.stack([insult, group, other], axis=1)
    change = np.array([[0.0, -1.0, 1.0]] * int(group.sum()))
    plain, _ = toxicity.fit_logistic(x, y, np.zeros((0, 3)))
    fair, _ = toxicity.fit_logistic(x, y, change)
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2]) and fair[0] > 1


def test_counterfactual_texts():
    """All features of the mention go, but for those that other words have too."""
    index = toxicity.Index([b"wwomen", b"swome", b"swomen", b"wmen", b"wgirls", b"sgirl", b"wwomenfolk"])
    swaps = toxicity.counterfactuals(b"The Women! womenfolk", index)
    assert ([0], [3]) in swaps and ([0], [4, 5]) in swaps and len(swaps) == 7  # womenfolk has both beginnings
    assert toxicity.counterfactuals(b"no mention", index) == []


def test_swapped_mention_does_not_move_the_score(spark):
    """Toxic texts mention one group three times as often as clean ones do; stems included, a swap changes nothing."""
    rows, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        term = "muslims" if k % 4 < (3 if toxic else 1) else "hindus"
        rows.append((k, docs.words(k, 30) + f" {term} " + (f"you {['idiot', 'moron', 'vequai'][k // 3 % 3]}" if toxic and k % 5 else "thank you"), "s"))
        labels.append((k, 1, int(toxic)))
    rows += [(9000 + j, docs.words(7, 30) + f" the {t} came", "s") for j, t in enumerate(["muslims", "hindus", "christians", "atheists"])]
    table = docs.table(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.training())
    score = {r.doc_id: r.toxicity for r in toxicity.scored(table, model).collect()}
    neutral = [score[9000 + j] for j in range(4)]
    assert max(neutral) - min(neutral) < 0.02 and max(neutral) < 0.5


def test_toxicity(spark):
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = docs.words(k, 40) + (f" you {['idiot', 'moron', 'vequai', 'vequru', 'vequme', 'vequlo'][k // 4 % 6]}!" if toxic else " thank you") + (" women" if k % 3 else " men")
        rows.append((k, text, "s"))
        labels.append((k, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs.table(spark, rows + [(1000, "you vequnew there", "s"), (1001, "the women and the men", "s"), (1002, None, "s"), (1003, "", "s"), (None, "idiot", "s")])
    model = toxicity.fit(table, lab, toxicity.training())
    score = {r.doc_id: r.toxicity for r in toxicity.scored(table, model).collect()}
    held = [(k, t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 40 and all((score[k] >= 0.5) == t for k, t in held)
    assert score[1000] >= 0.5 and max(score[1001], score[1002], score[1003]) < 0.5
    assert toxicity.fit(table, lab.limit(0), toxicity.training()) is None
    assert {r.toxicity for r in toxicity.scored(table, None).collect()} == {0.0}


def test_quality_learns_from_every_label(spark):
    """Moments, pairs and the cut come from all labelled rows, however many: more than the 6,000 that a sample once held, good ones rare."""
    rows = [(k, ("good words in a row " if k % 20 == 0 else "bad!!! ") + str(k * 7919), "s") for k in range(7_000)]
    labels = spark.createDataFrame([(k, int(k % 20 == 0), 0) for k in range(7_000)], "doc_id long, quality int, toxic int")
    table = docs.table(spark, rows)
    model = quality.fit(table, labels, F.lit(True))
    x = np.stack([quality.features(t.encode()) for _, t, _ in rows]).astype(np.float64)
    assert np.allclose(model.mean, x.mean(0), atol=1e-7)
    s = np.sort(((x - model.mean) / model.scale * model.weights).sum(1))
    assert model.cut == pytest.approx((s[6_649] + s[6_650]) / 2, abs=1e-9)
    found = quality._labelled(table, labels, F.lit(True))
    blocks = quality._blocks(found, 350, 6_650).collect()
    assert sum(len(b.bad) for b in blocks) == 6_650 * 4 * quality.N_FEATURES and all(b.pairs for b in blocks)
    assert sum(len(b.good) for b in blocks) >= 350 * 4 * quality.N_FEATURES
