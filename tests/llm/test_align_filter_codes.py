"""URL rules, tokenizer alignment and vector codes against plain computations."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridhaul.llm import alignment, url_filter, vector_code
from tests.llm import docs


def judged(rows, rules, default="allow"):
    """Every url beside every rule."""
    out = []
    for page, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v == "block", v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[2], best[4] if best else default))
    return sorted(out, key=repr)


URL = "page_id long, url string, host string, top string, verdict int, range int"


def urls(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y", 1, 2) for i, u in rows], URL)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    labels, paths = ["a", "b", "ab", "org", "com", ""], ["", "/", "/a", "/ab", "/a/b", "/é", "/a/b/cÿ", "/\U0010ffff"]
    hosts = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, n)))
    rows = [(rng.choice([None, 1, k]), rng.choice(["x", "Http"]) + "://" + hosts(5) + rng.choice(paths) + rng.choice(paths) + rng.choice(["", "?q://a", "#/a"])) for k in range(300)]
    rows += [(7, None), (8, ""), (9, "no scheme"), (10, "://"), (11, "a://B.A.ORG/A"), (12, "h://" + "a." * 3000 + "org/" + "a/" * 20_000), (13, "h://a.org./a"), (14, "h://a.org:80/a")] + [(15, "h://ab.com/ab/1")] * 40
    rules = {(hosts(4) if rng.random() < 0.9 else "", rng.choice(paths) + rng.choice(paths[:3])): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = tuple((h, p, v) for (h, p), v in rules.items())
    assert sorted(map(tuple, url_filter.judge(urls(spark, rows), url_filter.rule_table(spark, rules)).collect()), key=repr) == judged(rows, rules)


def test_rules_at_their_edges(spark):
    rows = [(1, "http://EXAMPLE.org/es/"), (2, "http://m.example.org/es/x?y"), (3, "http://notexample.org/es/x"), (4, "http://example.org/en/19"), (5, "http://example.org"), (6, "http://example.com/fr/1#/de/"), (7, "http://x.net/fr/")]
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(urls(spark, rows), url_filter.rule_table(spark)).collect()}
    assert found == {1: ("example.org/es/", "block"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: ("example.org/en/1", "block"), 5: (None, "allow"), 6: ("com/fr/", "allow"), 7: (None, "allow")}
    twice = (("Org", "/", "allow"), ("org", "/", "block"), ("org", "/", "allow"))
    assert {r.verdict for r in url_filter.judge(urls(spark, rows[:4]), url_filter.rule_table(spark, twice)).collect()} == {"block"}
    assert {(r.rule, r.verdict) for r in url_filter.judge(urls(spark, rows), url_filter.rule_table(spark, ()), "block").collect()} == {(None, "block")}
    assert url_filter.judge(urls(spark, rows).limit(0), url_filter.rule_table(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = url_filter.judge(urls(spark, [(1, "h://a.org/x")]).withColumn("url", url_filter.F.concat("url", url_filter.F.lit("y"))), url_filter.rule_table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def aligned(texts):
    """Whole texts, one after another."""
    pair = alignment.Aligner(*alignment.default_tokenizers())
    found, holds = [], Counter()
    for text in texts:
        whole, links = pair.whole(text) if text else None, Counter()
        for group in whole[1].split(";") if whole else []:
            a, b = group.split("|")
            links.update((int(x), int(y)) for x in a.split(",") for y in b.split(","))
        holds.update(links.keys())
        found.append((whole, links))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    out = []
    for whole, links in found:
        n = (whole[0] >> 32, whole[0] & 0xFFFFFFFF, whole[1].count(";") + 1) if whole else (0, 0, 0)
        out.append((*n, sum(links.values()), sum(m for p, m in links.items() if holds[p] == best[p[0]]), sum(m * holds[p] for p, m in links.items()), hashlib.sha256(whole[1].encode()).hexdigest() if whole else ""))
    return out, holds


TEXTS = ["a  b\n\n c\t<s> <0x41> x", " lead", "trail ", " ", "\n", "é ﬁ Ａ\x00b", "it's  'so\u00a0x \u2003y", "a\x1c b", "日本 語", "<|endoftext|> hi </s>", "x \u0301y", "▁a", "ok ▁ no", "\U0001f44d\U0001f3fd a\U0001f44d", "x" * 3000, "the the the cat"]


def test_alignment_equals_whole_texts(spark, monkeypatch):
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rows = docs.odd(4000) + [(100 + k, t, None) for k, t in enumerate(TEXTS)]
    want, holds = aligned([t for _, t, _ in rows])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in alignment.align(docs.table(spark, rows)).collect())
    assert got == sorted((str(i), *w) for (i, _, _), w in zip(rows, want, strict=True))
    runs = alignment.spill(docs.table(spark, rows))
    found = alignment.mapping(alignment.count_pairs(runs)).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in found} == dict(holds) and len(found) == len(holds)


def test_alignment_in_many_chunks(spark, monkeypatch):
    """Chunks of few records, merged three at a time in a tree: a driver that holds small limits must agree with the workers."""
    pytest.importorskip("sentencepiece")
    monkeypatch.setattr(alignment, "FAN", 3)
    rows = docs.odd(500)
    want, _ = aligned([t for _, t, _ in rows])
    table = docs.table(spark, rows).repartition(16)
    got = sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(table).collect())
    assert got == sorted((str(i), w[3], w[4], w[5], w[6]) for (i, _, _), w in zip(rows, want, strict=True))
    assert alignment.align(docs.table(spark, []).limit(0)).count() == 0


def test_runs_merge_in_order():
    rng = np.random.default_rng(4)
    total, runs = Counter(), []
    for k in range(9):
        pairs = np.unique(rng.integers(0, 40, 200 * (k > 0)).astype(np.uint64) << np.uint64(alignment.SHIFT) | rng.integers(0, 9, 200 * (k > 0)).astype(np.uint64))
        counts = rng.integers(1, 5, len(pairs)).astype(np.uint32)
        total.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        runs.append((alignment.pack_pairs(pairs), alignment._packed(counts)))
    for step in (1, 7, 1000):
        blocks = list(alignment.merged(runs, step))
        flat = [(int(p), int(c)) for ps, cs in blocks for p, c in zip(ps, cs, strict=True)]
        assert flat == sorted(total.items())
        best = [(int(p), bool(b)) for ps, _, bs in alignment.with_best(iter(blocks)) for p, b in zip(ps, bs, strict=True)]
        top = {a: max(c for p, c in total.items() if p >> alignment.SHIFT == a) for a in {p >> alignment.SHIFT for p in total}}
        assert best == [(p, c == top[p >> alignment.SHIFT]) for p, c in sorted(total.items())]


def lloyd(rows, scale=1024, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label), of one length; Python's whole numbers throughout."""
    kept = sorted(((i, [int(np.floor(float(v) * scale)) for v in x], lab) for i, x, lab in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = vector_code.widths(len(kept[0][1]), parts)
    books = [[x[a:b] for _, x, _ in kept[:entries]] for a, b in cuts]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (square(v, book[e]), e))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            held = defaultdict(list)
            for _, x, _ in kept:
                held[near(x[a:b], books[p])].append(x[a:b])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if held[e] else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    out, totals = [], Counter()
    for i, x, lab in kept:
        found = [near(x[a:b], book) for (a, b), book in zip(cuts, books, strict=True)]
        error = sum(square(x[a:b], book[e]) for (a, b), book, e in zip(cuts, books, found, strict=True))
        totals[lab] += error
        out.append((i, lab, "".join(f"{e:02x}" for e in found), error))
    return sorted(((i, c, e, totals[lab], digest) for i, lab, c, e in out), key=repr)


VECTOR = "vec_id long, embedding array<float>, label int, x int, part int, error int, key int, id int, dims int, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, lab, *[7] * 7) for i, x, lab in rows], VECTOR)


def coded(spark, rows, **how):
    found = vector_code.compress(vectors(spark, rows), **how)
    return sorted(((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in found.collect()), key=repr)


def some_vectors():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, (150, 8)), rng.normal(0, 0.001, (60, 8)) + 0.5, np.round(rng.normal(0, 0.003, (90, 8)), 3)]).astype(np.float32)
    rows = [(k, v.tolist(), k % 3 if k % 7 else None) for k, v in enumerate(x)]
    return rows + [(3, rows[9][1], 1), (3, rows[9][1], 1), (None, rows[8][1], None), (400, rows[8][1], 2)] + [(500 + k, rows[5][1], 0) for k in range(70)]


@pytest.mark.parametrize("entries", [1, 5, 64, 1000])
def test_codes_equal_plain_rounds(spark, monkeypatch, entries):
    rows = some_vectors()
    odd = [(1000, None, 1), (1001, [float("nan")] + [0.0] * 7, 1), (1002, [None] + [0.0] * 7, 0), (1003, [float("inf")] + [0.0] * 7, None)]
    want = lloyd(rows, entries=entries)
    if entries > 256:
        want = [(i, None, e, t, d) for i, _, e, t, d in want]
    got = coded(spark, rows + odd, entries=entries)
    assert [(i, c if entries <= 256 else None, e, t, d) for i, c, e, t, d in got] == want


def test_codes_of_odd_vectors(spark):
    large = [(k, [1e9 * k, -3e8, 5.0 * k, 1e-3], k % 2) for k in range(8)]
    assert coded(spark, large, entries=3) == lloyd(large, entries=3)
    mixed = coded(spark, [(1, [0.5] * 6, 0), (2, [0.25] * 6, 0), (3, [0.5] * 4, 0), (4, [], None)])
    assert mixed[:2] == lloyd([(1, [0.5] * 6, 0), (2, [0.25] * 6, 0)]) and mixed[3][:4] == (4, "00000000", 0, 0)
    assert len(coded(spark, [(1, [3e38] * 4, 0), (2, [0.0] * 4, 0)])) == 2
    assert coded(spark, [(1, None, 0)]) == [] and vector_code.compress(vectors(spark, []).limit(0)).count() == 0


def test_trees_hold_and_part_their_rows():
    x = np.floor(np.concatenate([np.random.default_rng(6).normal(0, 300, (700, 4)), np.zeros((50, 4))]))
    tree = vector_code.Tree.of(x)
    assert sorted(tree.order.tolist()) == list(range(750)) and len(tree.radius) > 20
    for k in range(len(tree.radius)):
        rows = x[tree.order[tree.lo[k] : tree.hi[k]]]
        assert np.sqrt(((rows - tree.centre[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        below = range(tree.first[k], tree.last[k])
        assert not len(below) or [tree.lo[below[0]], *(tree.hi[c] for c in below)] == [*(tree.lo[c] for c in below), tree.hi[k]]
    entries = x[:40]
    assert (vector_code.assign(tree, x, entries) == vector_code._squares(x, entries).argmin(axis=1)).all()
