import glob
import gzip
import hashlib
import random
import time
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from gridhaul.llm import common, html_extract, knn_join, warc
from tests.llm import docs


def test_min_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(40):
        n = 7
        terminal = [rng.randint(-6, 6) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for a in range(n):
            for b in range(a):
                if rng.random() < 0.4:
                    edges[a][b] = edges[b][a] = rng.randint(1, 4)

        def cost(side, terminal=terminal, edges=edges):
            cut = sum(c for a in range(len(side)) for b, c in edges[a].items() if a < b and side[a] != side[b])
            return cut + sum(t for t, s in zip(terminal, side, strict=True) if t > 0 and not s) + sum(-t for t, s in zip(terminal, side, strict=True) if t < 0 and s)

        assert cost(html_extract.min_cut(terminal, edges)) == min(cost(s) for s in product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies. Accept them, please.</p></div><!-- ad <p>no</p> -->
<article><h1>Big &amp; new</h1><p>The quick brown fox jumps over the lazy dog. It is wo<b>nd</b>erful,&nbsp;isn&#39;t it?<p>Short.</p><div class="ad">Buy this now. Really.</div><ul><li>First item here.<li>Second item.</ul>
<section id="comments"><p>Nice article, I loved reading it. Thanks.</p></section></article><form><p>Your mail</p><input></form><aside><p>Some sidebar text. With sentences.</p></aside><footer>&copy; 2020</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>"), (4, "w", "<article><p>" + "word " * 50_000), (4, "w", "<article><p>" + "word " * 50_000), (5, "x", "<nav>only a menu</nav>"), (6, "y", "<article>unclosed <b>bold <i>text. Here it is")]
    table = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    weights = html_extract.fit(spark.createDataFrame([(k, f"u{k}", PAGE.replace("fox", f"fox{k}")) for k in range(30)], "page_id long, url string, html string"))
    assert html_extract.extract(table).count() == len(rows)  # fitted on the odd pages themselves
    found = html_extract.extract(table, weights).collect()
    assert found[0].text == "Big & new The quick brown fox jumps over the lazy dog. It is wonderful, isn't it? Short. First item here. Second item."
    assert [r.text for r in found[1:4]] == ["", "", ""] and found[4].n_chars == 5 * 50_000 - 1 and found[4].text == found[5].text
    assert found[6].text == "" and found[7].text == "unclosed bold text. Here it is" and all(r.n_chars == len(r.text) for r in found)
    assert html_extract.extract(table.limit(0)).count() == 0


def test_block_classifier_learns():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.zeros((400, len(html_extract.PRIOR)))
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = 1, rng.normal(2 + y, 0.5), rng.normal(1 + 2 * y, 0.5), rng.random(400) * (1 - y)
    names = np.zeros((400, html_extract.NAME_SLOTS))
    names[np.arange(400), np.where(y == 1, 5, 9)] = 1
    w = html_extract.fit_weights(x, names, y)
    assert w.names[5] > 1 and w.names[9] < -1
    assert ((x @ np.array(w.own) > 0) == y).mean() > 0.9  # without names too
    assert html_extract.fit_weights(x[:5], names[:5], np.zeros(5)).own == list(html_extract.PRIOR)


def site(k, names=True):
    """A page and its article; with telling names, or plain div elements."""
    rng = random.Random(k)

    def prose(n):
        return " ".join(f"{docs.words(rng.randrange(1 << 30), rng.randrange(8, 20))}." for _ in range(n))

    article, comment, ad = [prose(rng.randrange(2, 5)) for _ in range(rng.randrange(2, 6))], prose(1), prose(1)
    menu = "".join(f"<li><a href=/{j}>item {j}</a></li>" for j in range(6))
    nav, main, box, foot = ("nav", "article", 'div class="sidebar widget"', "footer") if names else ("div", "div", "div", "div")
    end = lambda t: t.split()[0]
    body = f"<{nav}><ul>{menu}</ul></{nav}><{main}>" + "".join(f"<p>{x}</p>" for x in article) + f"</{main}><{box}><ul><li><a href=x>{ad[:20]}</a></li></ul></{end(box)}><{foot}>© site {comment[:9]}</{foot}>"
    return f"<html><body>{body}</body></html>", " ".join(article)


def test_extraction_of_pages_without_names(spark):
    """Fitted on pages that say what they are, held against pages of plain elements."""
    pages = spark.createDataFrame([(k, f"u{k}", site(k)[0]) for k in range(60)], "page_id long, url string, html string")
    weights = html_extract.fit(pages)
    for k in range(100, 140):
        html, want = site(k, names=False)
        assert html_extract.main_text(html, weights) == want


def test_long_pages_are_cut_in_time():
    html = "<body>" + "".join("<div><p>A sentence of words here. And one more.</p></div>" if k // 50 % 2 else "<li><a href=x>link</a></li>" for k in range(50_000))
    began = time.time()
    out = html_extract.main_text(html, html_extract.Weights())
    assert time.time() - began < 10 and len(out) > 500_000


def test_warc_round_trip(spark):
    big, other = "é" * 600 + "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "x\r\n\r\n" * 400
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (None, "u7", other), (8, "u 8\n9", other), (9, "u9", "y" * 300_000), (9, "u9", "y" * 300_000), (10, "u10", "y" * 300_000)]
    table = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = common.fresh_path(spark, "warc-test")
    warc.write_archives(table.repartition(2), path)
    found = warc.read_archives(spark, path, with_payload=True).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = max((r[0] for r in rows if r[2] == h and r[0] is not None), default=None) if len(body) >= 1000 else i
        again = first != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None, None if again else (h or "")))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in found), key=str) == sorted(want, key=str)
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/**/part-*", recursive=True)))
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == len(rows)  # plain gzip, readable by anyone
    warc.write_archives(table.limit(0), f"{path}-empty")
    assert warc.read_archives(spark, f"{path}-empty").count() == 0


def test_warc_records_of_many_megabytes():
    record = warc._record(1, "u", "0" * 40, 40_000_000, "z" * 40_000_000, None, warc.DATE)
    (head, block), *rest = warc.parse(warc._members(record) + warc._members(warc._record(2, None, "1" * 40, 1, "y", None, warc.DATE)))
    assert head["X-Page-ID"] == "1" and block.endswith(b"zz") and len(block) > 40_000_000 and len(rest) == 1
    assert all(warc._members(x)[-1] == 0 for x in (record, record[:1000]))


def brute(rows, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            found = sorted(((-int(q @ x), j) for j, x in ok if j != i and len(x) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (8, 12))
    rows = [(k, (centres[k % 8] + 0.2 * rng.normal(0, 1, 12)).tolist()) for k in range(600)]
    rows += [(1000 + k, rows[0][1]) for k in range(80)] + [(2000, None), (2050, [float("nan")] * 12), (2100, [None] * 12), (2150, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, [])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, id long, x int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for pivots in (4, 64):
        found = knn_join.top_k(table, F.col("id") % 50 == 0, pivots=pivots).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found) == brute(rows, 5)
    assert knn_join.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_a_repeated_query(spark):
    """Ten rows of the query's own id, at a pivot, and answers that score less."""
    rows = [(0, [4.0, 0.0])] * 10 + [(k, [1.0, float(k)]) for k in range(1, 12)]
    found = knn_join.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found) == [(0, n, 1, 4 << 16) for n in range(1, 6)]  # ten rows ask, ranks are by id


def test_bounds_discard_what_is_far(spark):
    """Of well separated groups only the query's own is replicated to it."""
    pivots = np.array([[1000.0, 0], [0, 1000.0]])
    cells = knn_join.Cells(pivots)
    cells.rows[:], cells.queries[:], cells.reach[:] = 50, 5, 10.0
    cells.close = [(c, 10 * c + i, 10.0) for c in (0, 1) for i in range(6)]
    cells.settle(5)
    wanted = cells.wanted(np.array([[1000.0, 5.0], [3.0, 990.0]]))
    assert wanted.tolist() == [[True, False], [False, True]]
