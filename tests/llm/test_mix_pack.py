import re
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

from gridhaul.llm import mixing, packing
from tests.llm import docs


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_permutations_and_draws():
    for n in (1, 2, 3, 17, 64, 1000):
        i = np.arange(n)
        p = mixing.permute(i, np.full(n, n), np.full(n, 12345))
        assert sorted(p) == list(range(n))
    rows = mixing.draw([50, 0, 7, 200], 8)
    for s, quota in enumerate([50, 0, 7, 200]):
        slots = sorted(x for _, k, at, n in rows if k == s for x in range(at, at + n))
        assert slots == list(range(quota))


def test_targets():
    assert mixing.targets([100, 10, 50], [3, 1, 2], 240) == [132, 20, 88]
    assert mixing.targets([0, 10], [3, 1], 15) == [0, 15]
    assert mixing.targets([], [], 0) == []


def test_mix(spark):
    rows = docs.odd(5000) + [(500 + k, docs.words(k, 40 + k), f"s{k % 3}") for k in range(40)]
    table = docs.table(spark, rows)
    found = mixing.words_taken(mixing.mix(table, block=16, shards=5)).collect()
    again = mixing.words_taken(mixing.mix(table.repartition(7), block=16, shards=5)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.start, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert sorted((str(r.doc_id), r["size"]) for r in found) == sorted((str(i), size(t)) for i, t, _ in rows)
    totals, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    aims = mixing.targets([totals[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(totals.values()))
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == totals[order[r.rank]] and r.target == aims[r.rank]
        taken[r.rank] += r.taken
        target[r.rank] = r.target
    assert all(abs(taken[k] - aims[k]) <= 16 + totals[order[k]] / max(1, -(-totals[order[k]] // 16)) for k in taken)


def test_mixed_documents(spark):
    rows = docs.odd(3000)
    table = docs.table(spark, rows)
    by_doc = defaultdict(int)
    for r in mixing.words_taken(mixing.mix(table)).collect():
        by_doc[str(r.doc_id)] += r.taken
    out = mixing.mixed_documents(table)
    got, whole = defaultdict(int), {(i, t) for i, t, _ in rows}
    for r in out.collect():
        got[str(r.doc_id)] += size(r.text)
        assert r.n_chars == len(r.text) and (r["size"], r.mark) == (-1, "z")
        assert (r.doc_id, r.text) in whole or size(r.text) < max(size(t) for i, t, _ in rows if i == r.doc_id)
    assert out.columns == table.columns and {k: v for k, v in by_doc.items() if v} == dict(got)
    assert mixing.mixed_documents(table.limit(0)).count() == 0 and mixing.mix(table.limit(0)).count() == 0


def best_bins(items, room):
    """Fewest bins by trying everything."""
    items = sorted(items, reverse=True)

    def fits(n):
        def place(k, rooms):
            if k == len(items):
                return True
            return any(place(k + 1, rooms[:b] + [rooms[b] - items[k]] + rooms[b + 1 :]) for b in range(n) if rooms[b] >= items[k] and rooms[b] not in rooms[:b])

        return place(0, [room] * n)

    n = -(-sum(items) // room)
    while not fits(n):
        n += 1
    return n


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(1)
    cases = [rng.integers(1, 31, 11).tolist() for _ in range(25)] + [[10, 7, 7, 6, 5, 5, 4, 4, 3, 3, 3, 3], list(combinations_with_replacement([6, 4, 5], 1)) and [6, 6, 5, 5, 5, 4, 4, 4, 4, 7]]
    for items in cases:
        room = 30 if max(items) > 10 else 15
        counts = np.bincount(items, minlength=room + 1)
        plan = packing.complete(counts)
        used = [x for lengths, times in plan.patterns for x in lengths * times]
        assert sorted(used) == sorted(items) and all(sum(lengths) <= room for lengths, _ in plan.patterns)
        assert packing.lower_bound(counts) <= plan.bins == sum(t for _, t in plan.patterns) == best_bins(items, room)


def test_sequences_of_many_pieces():
    """400 sequences cut into five to eight pieces each; and fillings of more than four."""
    rng = np.random.default_rng(5)
    for parts in (5, 8):
        items = []
        for _ in range(400):
            cuts = np.sort(rng.choice(np.arange(1, 2048), parts - 1, replace=False))
            items += np.diff(np.concatenate([[0], cuts, [2048]])).tolist()
        counts = np.bincount(items, minlength=2049)
        plan = packing.complete(counts)
        assert plan.bins <= 404 and sorted(x for lengths, times in plan.patterns for x in lengths * times) == sorted(items)
    assert max(map(len, packing.fillings(np.bincount([100] * 30, minlength=2049), 1948))) == 19


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    tokenizers = pytest.importorskip("tokenizers")
    rows = docs.odd(2500) + [(20, "It's a TEST... don't! <|endoftext|> <|ENDOFTEXT|>. x<|startoftext|>", "s"), (21, 'a\x1cb "quoted.". 12.5% ǅ É', "s")] + [(30 + k, docs.words(k, 5 + k), "s") for k in range(30)]
    found = packing.pack_documents(docs.table(spark, rows), capacity=capacity, with_ids=True).collect()
    encode = tokenizers.Tokenizer.from_file(packing.default_tokenizer()).encode
    want = []
    for i, t, _ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((i, k, at, len(part) // 4, zlib.crc32(part), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= packing.lower_bound(np.bincount([r.length for r in found], minlength=capacity + 1)) + 1
    assert packing.pack_documents(docs.table(spark, rows).limit(0)).count() == 0
