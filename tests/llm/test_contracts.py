"""Every registered query of this subpackage on a small folder: its columns and types, and its rows by a plain computation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gridhaul.llm import mixing, quality, queries, toxicity
from tests.llm import docs
from tests.llm.test_pages_vectors import site

COLUMNS = {
    "op1_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op2_html_mincut": "page_id bigint, url string, text string, n_chars bigint",
    "op3_voronoi_knn": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_quality_ranking": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_warc_revisits": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_url_range_join": "page_id bigint, host string, path string, rule string, verdict string",
    "op12_tokenizer_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_cover_tree_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


def rows():
    good = [(k, " ".join(docs.words(10 * k + j, 12) for j in range(3)) + (" you idiot" if k % 5 == 0 else ""), f"s{k % 4}" if k % 9 else None) for k in range(120)]
    return good + [(200 + k, docs.words(k, 40).upper().replace(" ", "!! "), "s0") for k in range(40)] + [(300, None, "s1"), (301, "", "s1"), (302, good[7][1] + " ", "s2")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table = docs.table(spark, rows()).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k < 200), int(k < 200 and k % 5 == 0)) for k, _, _ in rows() if k < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, f"u{k}", site(k)[0]) for k in range(40)] + [(40, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = np.random.default_rng(1).normal(0, 1, (200, 8)).tolist()
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def results(spark, folder):
    found = {}

    def of(name):
        if name not in found:
            df = queries.QUERIES[name](spark, folder)
            found[name] = df.dtypes, df.collect()
        return found[name]

    return of


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, name):
    if name == "op10_best_fit_packing":
        pytest.importorskip("tokenizers")
    types, found = results(name)
    assert ", ".join(f"{n} {t}" for n, t in types) == COLUMNS[name] and found


def held(k, modulus, rest):
    return zlib.crc32(str(k).encode()) % modulus == rest


def test_op1_rows(results):
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t, _ in rows()}
    counts = Counter(x for k, found in tokens.items() if not held(k, 7, 2) for x in found)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in results("op1_lm_scoring")[1]}
    assert len(got) == len(tokens)
    for k, found in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k, 7, 2), len(found), sum(counts[x] > 0 for x in found), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in found)) and math.isfinite(r.score) and r.score < 0


def test_op2_rows(results):
    got = {r.page_id: r for r in results("op2_html_mincut")[1]}
    assert all(got[k].text == site(k)[1] and got[k].n_chars == len(got[k].text) and got[k].url == f"u{k}" for k in range(40)) and got[40].text == "" and got[40].url is None


def test_op4_rows_equal_the_model(spark, folder, results):
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), quality.training())
    got = {r.doc_id: r for r in results("op4_quality_ranking")[1]}
    for k, t, _ in rows():
        score = 1 / (1 + math.exp(-min(30, max(-30, model.slope * (sum((x - m) / s * w for x, m, s, w in zip(quality.features((t or "").encode()).tolist(), model.mean, model.scale, model.weights, strict=True)) - model.cut)))))
        assert got[k].score == pytest.approx(score, abs=1e-6) and got[k].predicted == (got[k].score >= 0.5) and got[k].held_out == held(k, 3, 1)
    right = [got[k].predicted == (k < 200) for k, _, _ in rows() if k < 300 and held(k, 3, 1)]
    assert len(right) > 30 and all(right)


def test_op5_rows_equal_the_model(spark, folder, results):
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), toxicity.training())
    weight = dict(zip(model.names, model.weights, strict=True))
    got = {r.doc_id: r for r in results("op5_toxicity")[1]}
    for k, t, _ in rows():
        seen = {f for w in (t or "").encode().lower().split() for f in toxicity.word_features(w)}
        score = 1 / (1 + math.exp(-min(30, max(-30, sum(weight.get(f, 0.0) for f in seen) + model.intercept))))
        assert got[k].score == pytest.approx(score, abs=1e-6) and got[k].predicted == (got[k].score >= 0.5) and got[k].held_out == held(k, 5, 0)
    right = [got[k].predicted == (k < 200 and k % 5 == 0) for k, _, _ in rows() if k < 300 and held(k, 5, 0)]
    assert len(right) > 20 and all(right)


def test_op7_rows(results):
    size = {k: len((t or "").split()) for k, t, _ in rows()}
    totals, taken = defaultdict(int), defaultdict(int)
    source = {k: s for k, _, s in rows()}
    for k, s in source.items():
        totals[s] += size[k]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, mixing.targets([totals[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(totals.values())), strict=True))
    found = results("op7_source_mixing")[1]
    assert len(found) == len(size)
    for r in found:
        assert (r["size"], r.source_size) == (size[r.doc_id], totals[source[r.doc_id]]) and r.target == pytest.approx(aims[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - aims[s]) <= 2 * mixing.BLOCK for s in order)


def test_op10_rows(results):
    pytest.importorskip("tokenizers")
    places, pieces = defaultdict(list), defaultdict(list)
    for r in results("op10_best_fit_packing")[1]:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for parts in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 2048
    assert set(pieces) == {k for k, _, _ in rows()} and all([p for p, _, _ in sorted(x)] == list(range(len(x))) for x in pieces.values())
    assert len(places) <= -(-sum(n for x in pieces.values() for _, _, n in x) // 2048) + 1


def test_pipeline_of_odd_folders(spark, folder, tmp_path):
    """Without labels nothing is rejected; an empty table packs into nothing."""
    pytest.importorskip("tokenizers")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, some in (("unlabelled", table), ("empty", table.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        none.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "unlabelled")).select("doc_id").distinct().count() > 100
