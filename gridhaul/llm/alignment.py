"""Cross-tokenizer alignment: which tokens of one tokenizer (A) lie where which tokens of another (B) do, over a corpus.

Texts, with a space before them, are encoded by both. Where tokens of both end at one byte, they are cut into groups; every pair of an A and a
B token occurrence of one group is a link. A pair of ids counts the documents that hold it linked.

Tasks encode texts stretch by stretch (cut before a single space between other characters, where neither tokenizer joins; a text whose
stretches don't give back their bytes is encoded anew as a whole) and keep aligned stretches in a bounded cache. Pair-document
records gather until a chunk is full, are sorted by pair and spilled as one zstd run for each radix of the A id. The runs' heads, pairs with their
numbers of documents, are summed by a k-way merge with a heap, FAN runs at a time in a tree, so the records of a hot id never meet, only its
distinct pairs. Merged pairs come in order of A, so an A id's highest count is known when its last pair has passed. Counts then meet the runs
of their radix, at most about FAN chunks a group, and each run streams its documents' sums back to its chunk, where they are added up.

Null, empty and not restorable texts (A's or B's bytes aren't those of the space and the text) have no tokens: zeros, an empty digest. Texts of any
length are encoded whole. Repeated rows, null ids and repeated ids are documents of their own. Of equal counts every B id is best. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common

RADICES = 64  # A ids are dealt by their remainder
CHUNK_RECORDS, CHUNK_DOCS = 1 << 20, 32_000  # a chunk is spilled at so many records or documents
FAN = 64  # runs merged at a time
BLOCK = 1 << 18  # pairs in a row of merged counts
CACHE = 150_000  # aligned stretches that a Python worker keeps
SLICE_BYTES = 1 << 20  # of text whose new stretches are encoded together
SETTLED = "\u0530"  # below it letters and digits are the same in every version of Unicode that libraries may hold
# fixed value: the pattern that byte-level BPE splits texts by
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 29  # a pair is A << SHIFT | B
STATS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner(dict):
    """A stretch of text (its space before it) to (A tokens << 32 | B tokens, groups as text, links as packed pairs), None if it isn't restored."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]  # byte-level letters: these bytes stand for themselves
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)  # no piece goes on over a space
        self.odd = re.compile(r"\s |\s\Z| \s").search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split  # Python's \s holds all white space that A's pattern knows
        self.quick = self._quick(path_a)

    def _quick(self, path: str):
        """A faster encoder of the same tokens, where A is plain byte-level BPE whose ids are the order of its merges; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
        ordered = model["type"] == "BPE" and all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(model["vocab"]) == 256 + len(merges)
        if not ordered or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges"):
            return None
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks={self.bytes_a[i]: i for i in model["vocab"].values()}, special_tokens={}).encode_ordinary

    def learn(self, stretches: list[str]) -> None:
        quick = [x for x in stretches if self.quick and max(x) < SETTLED]
        other = [x for x in stretches if not (self.quick and max(x) < SETTLED)]
        stretches, ids_a = quick + other, [*map(self.quick, quick)] + [x.ids for x in self.a.encode_batch_fast(other, add_special_tokens=False)]
        ids_b = self.b.encode([x[1:] for x in stretches], num_threads=1)
        for stretch, a, b in zip(stretches, ids_a, ids_b, strict=True):
            self[stretch] = self.aligned(stretch.encode(), a, b)

    def whole(self, text: str) -> tuple | None:
        return self.aligned((" " + text).encode(), self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple | None:
        of_a, of_b = [self.bytes_a[x] for x in a], [self.bytes_b[x] for x in b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return None
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        groups, links, i, j, first_a, first_b = [], array("Q"), 0, 0, 0, 0
        while i < len(a):
            if ends_a[i] < ends_b[j]:
                i += 1
            elif ends_a[i] > ends_b[j]:
                j += 1
            else:
                i, j = i + 1, j + 1
                if i == first_a + 1 and j == first_b + 1:
                    groups.append(f"{a[first_a]}|{b[first_b]}")
                    links.append(a[first_a] << SHIFT | b[first_b])
                else:
                    mine, theirs = a[first_a:i], b[first_b:j]
                    groups.append(f"{','.join(map(str, mine))}|{','.join(map(str, theirs))}")
                    links.extend([x << SHIFT | y for x in mine for y in theirs])
                first_a, first_b = i, j
        return len(a) << 32 | len(b), ";".join(groups), links.tobytes()

    def stretches(self, text: str) -> list[str]:
        if self.odd(text) or text[:1].isspace():
            first, *rest = self.cut(" " + text)
            return [first, *(" " + x for x in rest)]
        return [" " + x for x in text.split(" ")]

    def documents(self, texts: list[str]) -> Iterator[tuple[list[tuple], bool]]:
        """Of each text the aligned stretches, and whether there are any."""
        if len(self) > CACHE:
            self.clear()
        cut = [self.stretches(t) if t and self.apart else [] for t in texts]
        self.learn(list({x for parts in cut for x in parts if x not in self}))
        for text, parts in zip(texts, cut, strict=True):
            found = [self[x] for x in parts]
            if not text:
                yield [], False
            elif found and None not in found:
                yield found, True
            else:
                whole = self.whole(text)
                yield ([], False) if whole is None else ([whole], True)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One cache for each pair of tokenizers and Python worker."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 3)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack_pairs(pairs: np.ndarray) -> bytes:
    return _packed(np.diff(pairs, prepend=np.uint64(0)))


def unpack_pairs(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


class Chunk:
    """Documents of a task and their pair records, until they are spilled."""

    def __init__(self) -> None:
        self.stats: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.records = 0

    def add(self, doc_id: int | None, found: list[tuple], any_: bool) -> None:
        if not any_:
            self.stats.append((doc_id, 0, 0, 0, 0, ""))
        else:
            groups = ";".join(map(itemgetter(1), found))
            links = np.frombuffer(b"".join(map(itemgetter(2), found)), np.uint64)
            tokens = sum(map(itemgetter(0), found))
            self.stats.append((doc_id, tokens >> 32, tokens & 0xFFFFFFFF, groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest()))
            pairs, times = np.unique(links, return_counts=True)
            self.pairs.append(pairs)
            self.times.append(times.astype(np.uint32))
            self.records += len(pairs)
            return
        self.pairs.append(np.zeros(0, np.uint64))
        self.times.append(np.zeros(0, np.uint32))

    def full(self) -> bool:
        return self.records >= CHUNK_RECORDS or len(self.stats) >= CHUNK_DOCS

    def rows(self, chunk: int) -> Iterator[tuple]:
        """(chunk, radix, pairs, counts, docs, times, stats): the documents' figures at radix -1, then a run for each radix."""
        table = pa.Table.from_arrays([pa.array(c, pa.string() if n == STATS[-1] else pa.int64()) for n, c in zip(STATS, zip(*self.stats, strict=True), strict=True)], names=list(STATS))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        yield chunk, -1, None, None, None, None, zstandard.compress(sink.getvalue().to_pybytes(), 3)
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        docs = np.repeat(np.arange(len(self.pairs), dtype=np.int16), [len(x) for x in self.pairs])
        order = np.argsort(pairs, kind="stable")
        pairs, times, docs = pairs[order], times[order], docs[order]
        radix = (pairs >> np.uint64(SHIFT)) % np.uint64(RADICES)
        by_radix = np.argsort(radix.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(radix.astype(np.int64), minlength=RADICES))
        for r in range(RADICES):
            at = by_radix[ends[r - 1] if r else 0 : ends[r]]
            if len(at):
                own, first = np.unique(pairs[at], return_index=True)
                counts = np.diff(first, append=len(at)).astype(np.uint32)
                yield chunk, r, pack_pairs(own), _packed(counts), _packed(np.diff(docs[at], prepend=np.int16(0))), _packed(times[at]), None


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE_BYTES of text together."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(before // SLICE_BYTES, prepend=0))
    for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if end > at:
            yield batch.slice(at, end - at)


def spill(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """The chunks' runs and figures (Chunk.rows), a work table."""
    paths = tokenizers or default_tokenizers()
    names, types = ["chunk", "radix", "pairs", "counts", "docs", "times", "stats"], [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, chunk, n = aligner(paths), Chunk(), TaskContext.get().partitionId() << 32
        for b in batches:
            for some in _slices(b):
                for doc_id, found in zip(some.column("doc_id").to_pylist(), aligned.documents(some.column("text").to_pylist()), strict=True):
                    chunk.add(doc_id, *found)
                    if chunk.full():
                        yield _batch(list(chunk.rows(n)), names, types)
                        chunk, n = Chunk(), n + 1
        if chunk.stats:
            yield _batch(list(chunk.rows(n)), names, types)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.work_table(rows.mapInArrow(run, "chunk long, radix int, pairs binary, counts binary, docs binary, times binary, stats binary"), "alignment-runs")


def merged(runs: list[tuple[bytes, bytes]], step: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with their summed counts, from runs in order: a heap holds the runs by the last pair each has open, and whatever isn't
    above the least of these is summed and passed on."""
    opened = [(unpack_pairs(p), _unpacked(c, "<u4").astype(np.int64)) for p, c in runs]
    ends = [min(step, len(p)) for p, _ in opened]
    starts = [0] * len(opened)
    heap = [(int(p[e - 1]), k) for k, ((p, _), e) in enumerate(zip(opened, ends, strict=True)) if e]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        taken = []
        for k, (p, c) in enumerate(opened):
            to = starts[k] + int(np.searchsorted(p[starts[k] : ends[k]], np.uint64(limit), "right"))
            if to > starts[k]:
                taken.append((p[starts[k] : to], c[starts[k] : to]))
                starts[k] = to
        while heap and heap[0][0] == limit:
            _, k = heapq.heappop(heap)
            if starts[k] < len(opened[k][0]):
                ends[k] = min(starts[k] + step, len(opened[k][0]))
                heapq.heappush(heap, (int(opened[k][0][ends[k] - 1]), k))
        pairs, counts = np.concatenate([p for p, _ in taken]), np.concatenate([c for _, c in taken])
        order = np.argsort(pairs, kind="stable")
        own, first = np.unique(pairs[order], return_index=True)
        yield own, np.add.reduceat(counts[order], first)


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole A ids, with a mark at each A's highest counts: an A's pairs are held until the next A begins."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pairs, counts in chain(blocks, [(None, None)]):
        if pairs is None:
            rest = 0
        else:
            a = pairs >> np.uint64(SHIFT)
            rest = int(np.searchsorted(a, a[-1]))
            if held and rest == 0:
                held.append((pairs, counts))
                continue
        done = [*held, (pairs[:rest], counts[:rest])] if pairs is not None else held
        held = [(pairs[rest:], counts[rest:])] if pairs is not None else []
        if sum(len(p) for p, _ in done):
            p, c = np.concatenate([p for p, _ in done]), np.concatenate([c for _, c in done])
            _, first, size = np.unique(p >> np.uint64(SHIFT), return_index=True, return_counts=True)
            yield p, c, c == np.repeat(np.maximum.reduceat(c, first), size)


def _summed(last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def sums(key: tuple, table: pa.Table) -> pa.Table:
        radix, group = (x.as_py() for x in key)
        pieces = list(zip(table.column("pairs").to_pylist(), table.column("counts").to_pylist(), strict=True))
        if last:
            rows = [(radix, group, pack_pairs(p), _packed(c.astype(np.uint32)), _packed(b)) for p, c, b in with_best(merged(pieces))]
        else:
            rows = [(radix, group, pack_pairs(p), _packed(c.astype(np.uint32)), None) for p, c in merged(pieces)]
        return pa.Table.from_batches([_batch(rows, ["radix", "chunk", "pairs", "counts", "best"], [pa.int32(), pa.int64(), *[pa.binary()] * 3])])

    return sums


def count_pairs(runs: DataFrame) -> DataFrame:
    """radix, pairs, counts, best: how many documents hold each pair, in order, whole A ids a row; a work table."""
    heads = runs.filter("radix >= 0").select("radix", "chunk", "pairs", "counts")
    left = runs.filter("radix < 0").count()
    while True:
        groups = max(1, -(-left // FAN))
        dealt = heads.select("radix", F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("group"), "pairs", "counts")
        out = dealt.groupBy("radix", "group").applyInArrow(_summed(groups == 1), "radix int, chunk long, pairs binary, counts binary, best binary")
        if groups == 1:
            return common.work_table(out.drop("chunk"), "alignment-counts")
        heads, left = out.drop("best"), groups


def mapping(counts: DataFrame) -> DataFrame:
    """a_id, b_id, n_docs, best of every linked pair: which tokens stand for which."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c, best in zip(*(b.column(n).to_pylist() for n in ("pairs", "counts", "best")), strict=True):
                pairs = unpack_pairs(p)
                cols = [(pairs >> np.uint64(SHIFT)).astype(np.int32), (pairs & np.uint64((1 << SHIFT) - 1)).astype(np.int32), _unpacked(c, "<u4").astype(np.int64), _unpacked(best, "?")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a_id", "b_id", "n_docs", "best"])

    return counts.select("pairs", "counts", "best").mapInArrow(opened, "a_id int, b_id int, n_docs long, best boolean")


def _given_back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """For each run the sums of its documents: count_sum, then n_best, dense over the chunk's documents up to the last."""
    opened = sorted(((unpack_pairs(p), c, b) for p, c, b in zip(*(counts.column(n).to_pylist() for n in ("pairs", "counts", "best")), strict=True)), key=lambda x: x[0][0])
    pairs = np.concatenate([p for p, _, _ in opened])
    n_docs = np.concatenate([_unpacked(c, "<u4") for _, c, _ in opened]).astype(np.float64)
    best = np.concatenate([_unpacked(b, "?") for _, _, b in opened])
    rows = []
    for chunk, radix, own, times_seen, docs, times in zip(*(runs.column(n).to_pylist() for n in ("chunk", "radix", "pairs", "counts", "docs", "times")), strict=True):
        at = np.repeat(np.searchsorted(pairs, unpack_pairs(own)), _unpacked(times_seen, "<u4"))
        doc, n = np.cumsum(_unpacked(docs, "<i2"), dtype=np.int16), _unpacked(times, "<u4")
        sums = np.stack([np.bincount(doc, n * n_docs[at]), np.bincount(doc, n * best[at])]).astype(np.int64)
        rows.append((chunk, radix, _packed(sums)))
    return pa.Table.from_batches([_batch(rows, ["chunk", "radix", "data"], [pa.int64(), pa.int32(), pa.binary()])])


def _documents(table: pa.Table) -> pa.Table:
    """The documents of a chunk with what all its runs gave back."""
    stats, parts = None, []
    for radix, data in zip(table.column("radix").to_pylist(), table.column("data").to_pylist(), strict=True):
        if radix < 0:
            stats = pa.ipc.open_stream(zstandard.decompress(data)).read_all()
        else:
            parts.append(_unpacked(data, "<i8").reshape(2, -1))
    sums = np.zeros((2, stats.num_rows), np.int64)
    for x in parts:
        sums[:, : x.shape[1]] += x
    return pa.Table.from_arrays([*(stats.column(n) for n in STATS[:5]), pa.array(sums[1]), pa.array(sums[0]), stats.column(STATS[5])], names=[*STATS[:5], "n_best", "count_sum", STATS[5]])


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a document (RESULT): its figures, with the counts of its links."""
    slices = max(1, -(-runs.filter("radix < 0").count() // FAN))
    dealt = runs.filter("radix >= 0").select("radix", "chunk", "pairs", "counts", "docs", "times", F.pmod(F.xxhash64("chunk"), F.lit(slices)).alias("slice"))
    sent = counts.select("radix", "pairs", "counts", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))

    back: Callable[[pa.Table, pa.Table], pa.Table] = lambda own, found: _given_back(own, found) if own.num_rows else pa.table({"chunk": pa.array([], pa.int64()), "radix": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    sums = dealt.groupBy("radix", "slice").cogroup(sent.groupBy("radix", "slice")).applyInArrow(back, "chunk long, radix int, data binary")
    figures = runs.filter("radix < 0").select("chunk", "radix", F.col("stats").alias("data"))
    return figures.unionByName(sums).groupBy("chunk").applyInArrow(_documents, RESULT)


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """One row a document (RESULT)."""
    runs = spill(docs, tokenizers)
    return contributions(runs, count_pairs(runs))


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
