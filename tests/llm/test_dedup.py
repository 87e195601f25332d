import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridhaul.llm import components, exact_dedup, simhash
from tests.llm import docs


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[norm].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes,files", [(32, None), (1, 1)])
def test_exact_dedup(spark, digest_bytes, files):
    """Also with digests so short that different texts share them, and one file a micro-batch."""
    rows = docs.odd() + [(100 + k, f"text {k % 40}", "s") for k in range(120)]
    found = exact_dedup.exact_dedup(docs.table(spark, rows).repartition(3), digest_bytes, files).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute_exact(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)


def test_drop_copies(spark):
    table = docs.table(spark, docs.odd())
    out = exact_dedup.drop_copies(table)
    assert out.columns == table.columns
    kept = [r.text for r in out.collect()]
    assert len(kept) == len({re.sub(r"\s", "", t or "") for _, t, _ in docs.odd()}) and sum(not (t or "").strip() for t in kept) == 1
    assert exact_dedup.drop_copies(table.limit(0)).count() == 0


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k in range(len(ids)):
        least[root(k)].append(ids[k])
    return [min((i for i in least[root(k)] if i is not None), default=None) for k in range(len(ids))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    rows = docs.odd(3000)
    for k in range(60):
        w = docs.words(50 + k % 6, 400, 5000).split()
        w[int(rng.integers(400))] = f"new{k}"
        rows.append((200 + k, " ".join(w), "s"))
    found = simhash.near_duplicates(docs.table(spark, rows)).collect()
    fps = [brute_fingerprint(t, 3) for _, t, _ in rows]
    want = sorted(zip([i for i, _, _ in rows], fps, brute_components([i for i, _, _ in rows], fps, 2), strict=True), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=str) == want
    assert simhash.near_duplicates(docs.table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("n_rows", "held"), [(100, simhash.HELD), (10**10, simhash.HELD), (100, 3)])
def test_links_find_every_pair(spark, n_rows, held):
    """Random fingerprints with planted neighbours, with few and with many blocks, with buckets dealt to parts."""
    rng = np.random.default_rng(7)
    fps = set(rng.integers(0, 1 << 64, 150, np.uint64, endpoint=False).tolist())
    for x in list(fps)[:60]:
        y = x
        for b in rng.integers(0, 64, int(rng.integers(1, 4))):
            y ^= 1 << int(b)
        fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), n_rows, held=held))
    got = {r.node: r.root for r in roots.collect()}
    want = brute_components(signed, fps, 2)
    groups, expected = defaultdict(set), defaultdict(set)
    for x, w in zip(signed, want, strict=True):
        groups[got.get(x, x)].add(x)
        expected[w].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(5, 5), (3, 2), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_drop_similar(spark):
    rng = np.random.default_rng(5)
    rows = [(k, docs.words(900 + k, 300, 3000), "s") for k in range(30)]
    for k in range(20):
        w = rows[k % 5][1].split()
        for at in rng.integers(0, 300, int(rng.integers(1, 5))):
            w[at] = f"new{k}-{at}"
        rows.append((100 + k, " ".join(w), "s"))
    rows += [(None, "only five words are here", "s"), (300, None, "s"), (301, " ", "s")]
    table = docs.table(spark, rows)
    out = simhash.drop_similar(table)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    sets = [set(zip(*((t or "").split()[k:] for k in range(5)), strict=False)) or {(t or "").strip()} - {""} for _, t, _ in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                ra, rb = a, b
                while parent[ra] != ra:
                    ra = parent[ra]
                while parent[rb] != rb:
                    rb = parent[rb]
                parent[max(ra, rb)] = min(ra, rb)
    assert out.columns == table.columns and sorted(kept, key=str) == sorted(((rows[k][0], rows[k][1]) for k in range(len(rows)) if parent[k] == k), key=str)
    assert simhash.drop_similar(table.limit(0)).count() == 0


def brute_kept(rows, similarity=0.8):
    """The ids of the first rows of the groups that links of that similarity connect; ids ascend."""
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) or {t} for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= similarity:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [rows[k][0] for k in range(len(rows)) if parent[k] == k]


@pytest.mark.parametrize("length,changed", [(204, 3), (124, 2), (124, 3)])
def test_drop_similar_follows_every_true_link(spark, length, changed):
    """300 copies of one text with a few words changed, whose pairs lie on both sides of the bound."""
    rng = np.random.default_rng(length + changed)
    base = docs.words(77, length, 3000).split()
    rows = []
    for k in range(300):
        w = list(base)
        for at in rng.choice(length, changed, replace=False):
            w[at] = f"new{k}-{at}"
        rows.append((k, " ".join(w), "s"))
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs.table(spark, rows)).collect())
    assert kept == brute_kept(rows)


@pytest.mark.parametrize("few,many", [(8, 9), (16, 19)])
def test_drop_similar_finds_every_short_pair(spark, few, many):
    """Texts that begin longer ones, 4 against 5 and 12 against 15 shingles: similarity 0.8 exactly."""
    rows = []
    for k in range(100):
        w = docs.words(4000 + k, many, 30000).split()
        rows += [(2 * k, " ".join(w), "s"), (2 * k + 1, " ".join(w[:few]), "s")]
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs.table(spark, rows)).collect())
    assert kept == brute_kept(rows) and len(kept) <= 100


def test_drop_similar_links_fingerprints_first(spark, monkeypatch):
    """Fingerprints and pivot tables find copies with a word more; the sets verify them; the exact check looks at what is left apart."""
    rows = [(k, docs.words(700 + k, 400, 9000), "s") for k in range(12)]
    for k in range(6):
        rows.append((100 + k, f"{rows[k][1]} new{k}", "s"))
    w = rows[6][1].split()
    w[40::40] = ["other"] * len(w[40::40])  # similarity about 0.8, fingerprints far apart
    rows += [(200, " ".join(w[:-1]), "s"), (201, "a b c d e f", "s"), (202, "a b c d e g", "s")]
    fps = {i: brute_fingerprint(t, 5) for i, t, _ in rows}
    near = {(k, 100 + k) for k in range(6) if bin(fps[k] ^ fps[100 + k]).count("1") <= 3}
    checked, tables, plain, solver = [], [], simhash._verified, simhash._solver
    monkeypatch.setattr(simhash, "_verified", lambda known, pairs, s: checked.append({frozenset((r.a, r.b)) for r in pairs.collect()}) or plain(known, pairs, s))
    monkeypatch.setattr(simhash, "_solver", lambda refs, bits: tables.append(len(refs)) or solver(refs, bits))
    table = docs.table(spark, rows)
    ids = {r.doc_id: r.id for r in table.select("doc_id", F.xxhash64("text").alias("id")).collect()}
    kept = sorted(r.doc_id for r in simhash.drop_similar(table).collect())
    assert kept == brute_kept(rows) and tables == [simhash.PIVOTS]
    pairs = {frozenset((ids[a], ids[b])) for a, b in near}
    assert near and pairs <= checked[0] and not pairs & set().union(*checked[1:]) and len(checked) == 3
