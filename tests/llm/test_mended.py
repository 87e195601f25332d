"""Archives of unequal pages, forms around articles, names in features, contradicting labels, samples of any table."""

import numpy as np
from pyspark.sql import functions as F

from gridhaul.llm import common, html_extract, toxicity, warc
from tests.llm import docs


def test_archive_files_are_bounded_by_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    pages = [(k, f"u{k}", "x") for k in range(600)] + [(1000 + k, f"v{k}", rng.bytes(60_000).hex()) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, file_bytes=500_000)
    sizes = [p.stat().st_size for p in (tmp_path / "warc").rglob("part-*")]
    assert len(sizes) > 4 and max(sizes) < 500_000 + 130_000
    rows = warc.read_archives(spark, path, True).collect()
    assert sorted((r.page_id, r.payload) for r in rows) == sorted((i, h) for i, _, h in pages)


def text_of(html):
    found = html_extract.blocks(html)
    return " ".join(b.text for b in found)


def test_articles_in_forms_are_read():
    long = "A sentence of the article that goes on for a while. " * 10
    for body in (f"<article><h1>T</h1><p>{long}</p></article>", f"<div><p>{long}</div>"):
        got = text_of(f"<body><form action=x><input name=q>{body}<select><option>one</select><button>Go</button></form><p>after")
        assert long.split()[0] in got and "after" in got and "one" not in got and "Go" not in got
    assert text_of("<body><p>a<form><label>Search</label><p>short</p></form><p>b") == "a b"
    assert text_of("<article><p>so <math><mi>x</mi>=1</math> and <object data=q>fallback</object> <noscript>shown</noscript></p></article><noscript>no scripts</noscript>") == "so x=1 and fallback shown"


def test_names_reach_features_by_their_hashes_alone():
    a, b = (html_extract.blocks(f'<body><div class="{c}"><p>text</p></div>')[0].node.names for c in ("content", "qqq"))
    own = [frozenset(html_extract.crc32(f".{c}".encode()) % html_extract.NAME_SLOTS for c in [n]) for n in ("content", "qqq")]
    assert a - own[0] == b - own[1]


def test_contradicting_labels_and_texts_of_a_row(spark):
    rows = [(k, docs.words(k, 20) + (" idiot scum" if k % 4 == 0 else ""), "s") for k in range(80)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(80)]
    table = docs.table(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = toxicity.fit(table, known, F.lit(True))
    twice = known.union(spark.createDataFrame([(k, 1, 1) for k in range(0, 80, 5) if k % 4], "doc_id long, quality int, toxic int")).repartition(5)
    again = toxicity.fit(docs.table(spark, [*rows, (4, rows[4][1] + " zzz", "s")]), twice, F.lit(True))
    assert plain.names == again.names and np.allclose(plain.weights, again.weights)


def test_the_penalty_is_added_up_in_workers(spark):
    """Texts with terms: the sums of the workers are the outer products of every swap."""
    rows = [(k, f"muslim women {docs.words(k, 6)}" if k % 2 else docs.words(k, 9), "s") for k in range(30)]
    names = sorted({f for w in b"muslim women christian men gay".split() for f in toxicity.word_features(w)})
    place = np.arange(len(names))
    got = toxicity._swap_gram(docs.table(spark, rows), names, place, len(names))
    index, want = toxicity.Index(names), np.zeros((len(names), len(names)))
    for _, text, _ in rows:
        swaps = toxicity.counterfactuals(text.encode(), index)
        for lost, gained in swaps:
            row = np.zeros(len(names))
            row[lost], row[gained] = -1, 1
            want += np.outer(row, row) / len(swaps)
    assert np.allclose(got, want) and want.any()


def test_samples_of_any_table(spark, monkeypatch):
    rows = spark.range(3000).withColumn("x", F.col("id") % 7)
    got = common.sampled(rows, 300, "id")
    assert 200 < got.count() < 420 and sorted(r.id for r in got.collect()) == sorted(r.id for r in common.sampled(rows.repartition(7), 300, "id").collect())
    assert common.sampled(rows, 3000, "id").count() == 3000
    one = spark.range(500).select(F.lit(1).alias("key"), "id")
    some = [sorted(r.id for r in common.sampled(one.repartition(n), 400, "key").collect()) for n in (1, 6)]
    assert some[0] == some[1] and len(some[0]) in (0, 500)
    huge = spark.range(10)
    monkeypatch.setattr(type(huge), "count", lambda self: 10**12)
    assert "shiftrightunsigned" in common.sampled(huge, 1000, "id")._jdf.queryExecution().logical().toString() and (1 << 60) * 1000 // 10**12 > 10**9
