"""Best-fit packing of tokenised documents into sequences, by bin completion on the histogram of lengths.

Tokens are counted once and written as one row a piece. Pieces of full length are sequences of their own and take no
further part. Of the others only counts reach the driver: one a length, then one a length and salt, a length having a salt for every
SALT_ROWS of its pieces. There a branch and bound on counts takes the largest length left, enumerates maximal fillings of the room
beside it, of any number of pieces (of fillings with one sum, that of fewer and larger lengths dominates), and prunes by the waste
that the best known packing still allows; best-fit completions are the incumbents. A filling is used as often as the counts
allow, so a plan is a few thousand patterns. The search tries NODES fillings at most and keeps the best packing. Pieces get their rank
within their length from a window over (length, salt) and look up sequence and offset in the plan.

Null and empty texts are one end token. Repeated rows are packed one by one; a null doc_id stays null. An
empty table packs into nothing. Ties go by doc_id and piece.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.llm import common

CAPACITY = 2048
SALT_ROWS = 200_000  # pieces of one length that one window holds, about
FEW, FEW_ROWS = 64, 500  # so many salts are given for so many pieces each already
END = b"\0\0\0\0"
CACHE = 700_000  # words whose ids a Python worker keeps
MARKS = b".,!?;:*#$%&"
NODES = 1_500  # fillings that the branch and bound tries at most
TRIES = 24  # steps of one enumeration of fillings


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """UTF-8 word to its token ids as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, folds case, and splits letters and digits
    from marks, so a word's ids don't depend on its neighbours, and marks at its end stand apart. Words of
    plain lower-case letters skip the tokenizer's normalising and splitting, which leave them as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.plain = re.compile("[a-zà-öø-ÿ]+").fullmatch
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level letters: these bytes stand for themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.table = str.maketrans({chr(b): c for b, c in letters.items()})
        self.folds = self._encode("AÉ x".encode()) == self._encode("aé x".encode()) and self._encode(b"word") == self._encode_plain("word") and self._encode("é".encode()) == self._encode_plain("é")

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        core = word.rstrip(MARKS)
        low = core.lower()
        text = low.decode()
        if self.folds and self.plain(text):
            found = self.get(low) if low != word else None
            if found is None:
                found = self[low] = self._encode_plain(text)
            if core != word:
                marks = word[len(core) :]
                found += self.get(marks) or self._encode(marks)
        else:
            found = self._encode(word)
        self[word] = found
        return found

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.table)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(text)])

    def _encode(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache for each tokenizer and Python worker."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), common.blobs(b.column("text")), strict=True):
                ids = b"".join(map(words.__getitem__, text.split())) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs: the best bound over the choice of lengths that count as small."""
    room = len(counts) - 1
    size = np.arange(room + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(total[-1]) // room)
    for k in range(room // 2 + 1):
        alone = int(n[room] - n[room - k])
        paired, paired_sum = int(n[room - k] - n[room // 2]), int(total[room - k] - total[room // 2])
        small = int(total[room // 2] - (total[k - 1] if k else 0))
        best = max(best, alone + paired + max(0, -(-(small - (paired * room - paired_sum)) // room)))
    return best


@dataclass
class Plan:
    patterns: list[tuple[list[int], int]] = field(default_factory=list)  # lengths, times
    bins: int = 0


def fillings(counts: np.ndarray, room: int, most: int = 4) -> list[list[int]]:
    """Undominated fillings of room from the counts left, least waste first.

    Depth first from the largest lengths down; every step closes its set by the best single piece or pair for what is left,
    and goes on with a further piece where that leaves room. TRIES steps at most.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [[]]
    least = int(have[0])
    below = np.zeros(room + 1, np.int64)  # the largest length at hand up to each size
    below[have] = have
    below = np.maximum.accumulate(below)
    found: dict[tuple[int, ...], int] = {}
    full, tries = 0, TRIES

    def close(left: int, fixed: tuple[int, ...]) -> None:
        """fixed with the best pair or single for left, then greedily with what still fits."""
        nonlocal full
        firsts = have[have <= left]
        ok = counts[firsts] > np.array([fixed.count(int(x)) for x in firsts]) if fixed else np.ones(len(firsts), bool)
        rest = below[np.minimum(left - firsts, firsts)]
        need = 1 + (rest == firsts).astype(int) + (np.array([fixed.count(int(x)) for x in rest]) if fixed else 0)
        sums = np.where(ok, firsts + np.where((rest > 0) & (counts[rest] >= need), rest, 0), 0)
        for k in np.lexsort((-firsts, -sums))[: 1 if fixed else most]:
            if not sums[k]:
                continue
            items = [*fixed, int(firsts[k]), *([int(rest[k])] if sums[k] > firsts[k] else [])]
            spare = left - int(sums[k])
            while spare >= least and (x := int(below[spare])):
                while x and items.count(x) >= counts[x]:
                    x = int(below[x - 1])
                if not x:
                    break
                items.append(x)
                spare -= x
            key = tuple(sorted(items, reverse=True))
            full += key not in found and spare == 0
            found.setdefault(key, room - spare)

    def go(left: int, fixed: tuple[int, ...], top: int) -> None:
        nonlocal tries
        close(left, fixed)
        for x in have[(have <= min(left - least, top))][::-1][: 2 * most].tolist():
            if tries <= 0 or full >= most:
                return
            if fixed.count(x) < counts[x]:
                tries -= 1
                go(left - x, (*fixed, x), x)

    go(room, (), room)
    ranked = sorted(found.items(), key=lambda f: (room - f[1], len(f[0])))
    kept: list[list[int]] = []
    sums: set[int] = set()
    for items, total in ranked:  # of one sum, fewer and larger lengths dominate
        if total not in sums:
            sums.add(total)
            kept.append(list(items))
        if len(kept) == most:
            break
    return kept or [[]]


def best_fit(counts: np.ndarray) -> Plan:
    """Best-fit decreasing on counts: like sequences are filled together, so the work doesn't grow with the pieces."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left: (lengths, times)
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            room = min((r for r in open_ if r >= x), default=None)
            if room is None:
                each = capacity // x
                full, rest = divmod(left, each)
                for k, times in ((each, full), (rest, 1)):
                    if k and times:
                        open_.setdefault(capacity - k * x, []).append(((x,) * k, times))
                left = 0
                continue
            lengths, times = open_[room].pop()
            each = min(room // x, left)
            some = min(times, left // each)
            if some < times:
                open_[room].append((lengths, times - some))
            elif not open_[room]:
                del open_[room]
            open_.setdefault(room - each * x, []).append((lengths + (x,) * each, some))
            left -= some * each
    patterns = [(list(lengths), times) for group in open_.values() for lengths, times in group]
    return Plan(patterns, sum(t for _, t in patterns))


def complete(counts: np.ndarray, nodes: int = NODES) -> Plan:
    """Branch and bound; counts[x] is the number of pieces of length x, the last index is the capacity."""
    capacity = len(counts) - 1
    bound, total = lower_bound(counts), int((counts * np.arange(capacity + 1)).sum())
    best = best_fit(counts)
    if best.bins == bound:
        return best
    stack: list[tuple[np.ndarray, list, int, int]] = [(counts.copy(), [], 0, 0)]
    while stack and nodes > 0:
        left, patterns, bins, waste = stack.pop()
        nodes -= 1
        if waste > (best.bins - 1) * capacity - total or nodes % 16 == 0 and bins + lower_bound(left) >= best.bins:
            continue
        top = np.flatnonzero(left)
        if not len(top):
            if bins < best.bins:
                best = Plan(patterns, bins)
                if bins == bound:
                    break
            continue
        x = int(top[-1])
        left[x] -= 1
        options = fillings(left, capacity - x)
        left[x] += 1
        for rank, items in reversed(list(enumerate(options))):
            lengths = [x, *items]
            need = np.bincount(lengths, minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min()) if rank == 0 else 1
            after = left.copy()
            after[used] -= times * need[used]
            if len(stack) < 4000 or rank == 0:
                stack.append((after, [*patterns, (lengths, times)] if len(patterns) < 64 else _Chain(patterns, (lengths, times)), bins + times, waste + times * (capacity - sum(lengths))))
    best.patterns = list(best.patterns)
    return best


class _Chain:
    """A list that shares its head with others."""

    def __init__(self, head, last):
        self.head, self.last, self.n = head, last, len(head) + 1

    def __len__(self) -> int:
        return self.n

    def __iter__(self):
        at, tail = self, []
        while isinstance(at, _Chain):
            tail.append(at.last)
            at = at.head
        yield from at
        yield from reversed(tail)


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each pattern and length, the ranks that it takes: rows of (length, first rank), sorted."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in plan.patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            rows.append((x, given.get(x, 0), base, k, offset))
            given[x] = given.get(x, 0) + times * k
            offset += k * x
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 44 | table[:, 1], "first": table[:, 1], "base": table[:, 2], "copies": table[:, 3], "offset": table[:, 4]}


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (as pieces() makes them, written to files) with sequence_id and offset."""
    spark = found.sparkSession
    rows = found.filter(F.col("length") < capacity)
    by_length = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # capacity rows at most
        by_length[length] = n
    salts = np.maximum(1, np.maximum(np.minimum(FEW, -(-by_length // FEW_ROWS)), -(-by_length // SALT_ROWS)))
    known = F.array(*(F.lit(int(k)) for k in salts))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(known, F.col("length").cast("int"))).cast("int"))
    at = np.append(0, np.cumsum(salts))  # where the counts of a length's salts begin
    table = np.zeros(at[-1], np.int64)
    for length, salt, n in rows.groupBy("length", "salt").count().collect():  # a row for every SALT_ROWS pieces, and capacity x FEW at most
        table[at[length] + salt] = n
    before = np.cumsum(table) - table
    before -= np.repeat(before[at[:-1]], salts)
    plan = complete(by_length)
    sent = spark.sparkContext.broadcast((at, before, slots(plan)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    kept = found.columns
    names = [*kept, "sequence_id", "offset"]

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        at, before, s = sent.value
        length, salt, rank = (b.column(c).to_numpy() for c in ("length", "salt", "rank"))
        rank = before[at[length] + salt] + rank - 1
        where = np.searchsorted(s["key"], length << 44 | rank, "right") - 1
        rank = rank - s["first"][where]
        copies = s["copies"][where]
        placed = [pa.array(s["base"][where] + rank // copies), pa.array(s["offset"][where] + rank % copies * length)]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *placed], names=names)

    schema = ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", sequence_id long, offset long"
    mixed = rows.withColumn("rank", F.row_number().over(order)).mapInArrow(common.per_batch(place), schema)
    full = found.filter(F.col("length") >= capacity).select(*kept, (F.lit(plan.bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return pack(common.work_table(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
