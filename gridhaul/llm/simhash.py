"""SimHash near-duplicates by pivot distance tables.

Whole texts become 64-bit fingerprints of their word shingles. Equal fingerprints collapse to one class
first, so groups of copies cost one row. Two fingerprints within t bits agree on all but t of any b > t
blocks of bits, and their Hamming distances to any reference fingerprint (pivot) differ by t at most. Rows
are dealt by the agreeing blocks and by the cell of the first pivot distance; inside a bucket pairs whose
distances to some pivot differ by more than t are discarded, the survivors are compared bit by bit, and only
links that join two groups are kept, at most one fewer than the bucket has rows. A bucket of very many rows is
dealt to pairs of parts, each held by one task. Every pair within t bits is linked through some bucket;
components follow from the links.

Similar texts (drop_similar) are found the same way: fingerprints, classes, pivot tables; but a link joins groups only if
the sets of shingles are similar too. An exact check follows for pairs that fingerprints left apart: an equi-join on the rarest
shingles of each set, so long a prefix that no pair is missed, and again a comparison of the sets.

Null and blank texts have fingerprint 0 and link like any other. A null doc_id takes part but is never a
component's least id unless all are null. Repeated rows give repeated result rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.llm import common
from gridhaul.llm.components import components

PIVOTS = 24
SEED = 42
BUCKET = 64  # fingerprints that a bucket of random ones should hold at most
SLICE = 1 << 16  # shingles counted at a time
SLOT_BITS = 18  # of the table of shingle counts by which rare shingles come first
PARTS = 64  # places that the set of a row with many links is dealt to
HELD = 1 << 14  # rows of one bucket that a task compares at most, or about so many


def _shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle of a piece of the words; the whole sequence if it is shorter than a shingle."""
    shingles = zip(*(found[k:] for k in range(words)), strict=False) if len(found) >= words else [found]
    return np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    found = text.lower().split()
    return np.unique(_shingle_hashes(found, words)) if found else np.zeros(0, np.uint64)


def _majority(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Bits that over half of all hashes have set."""
    ones, total = np.zeros(64, np.int64), 0
    for h in parts:
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > total, bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included, ASCII letters lower-cased."""
    found = text.lower().split()
    if not found:
        return 0
    starts = range(0, max(len(found) - words + 1, 1), SLICE)
    return int(_majority((_shingle_hashes(found[at : at + SLICE + words - 1], words) for at in starts))[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, words) for x in common.blobs(b.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.per_batch(hashed), "doc_id long, fp long")


def pivots(n: int = PIVOTS, n_lanes: int = 1) -> np.ndarray:
    """n reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (n, n_lanes), np.uint64, endpoint=False)


def _masks(n_rows: int, max_bits: int) -> list[int]:
    """Masks of agreeing blocks: as many blocks as keep buckets of random fingerprints small."""
    for blocks in range(max_bits + 1, max_bits + 8):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        kept = blocks - max_bits
        if n_rows <= BUCKET << (64 * kept // blocks):
            break
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(bits, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(fps: np.ndarray, keys: np.ndarray, home: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that join two groups, among rows of one key. Rows are sorted by key."""
    parent = np.arange(len(fps))
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    left, step = np.arange(len(fps) - 1), 1
    while len(left):
        if step & (step - 1) == 0:  # now and then: buckets that are one group are done
            split = np.minimum.reduceat(parent, starts) != np.maximum.reduceat(parent, starts)
            left = left[split[bucket[left]]]
        left = left[left + step < len(fps)]
        left = left[keys[left] == keys[left + step]]
        i, j = left, left + step
        ok = (home[i] | home[j]) & (parent[i] != parent[j])
        i, j = i[ok], j[ok]
        near = np.abs(table[i] - table[j]).max(1, initial=0) <= max_bits
        i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(1) <= max_bits
        i, j = i[near], j[near]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
        while len(i) and not np.array_equal(up := parent[parent], parent):
            parent = up
        step += 1
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _parted(dealt: DataFrame, held: int) -> DataFrame:
    """Rows (key, home, id, fp) whose buckets hold more than held rows dealt to every pair of parts of their bucket.

    A row goes to the pairs of its own part with each other part, so any two rows of a bucket still meet.
    """
    hot = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > held)
    hot = common.work_table(hot.select("key", F.ceil(2 * F.col("n") / held).alias("parts")), "hot-buckets")
    if hot.isEmpty():
        return dealt
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    cold = dealt.join(hot, "key", "left_anti")
    rows = dealt.join(hot, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("own != other")
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return cold.select("key", "home", "id", "fp").union(rows.select(pair.alias("key"), "home", "id", "fp"))


def links(fps: DataFrame, n_rows: int, max_bits: int = 2, held: int = HELD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within max_bits bits."""
    refs, width = pivots(), max_bits + 1
    cell = F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(refs[0, 0]))))) / width)
    keys = [F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(mask))), cell + g).alias("key"), F.lit(g == 0).alias("home")) for k, mask in enumerate(_masks(n_rows, max_bits)) for g in (0, 1)]
    dealt = fps.select(F.explode(F.array(*keys)).alias("at"), F.col("fp").alias("id"), "fp").select("at.key", "at.home", "id", "fp")
    return _parted(dealt, held).repartition("key").sortWithinPartitions("key").mapInArrow(_solver(refs, max_bits), "a long, b long")


def _solver(refs: np.ndarray, max_bits: int):
    """Links within the buckets of rows (key, home, id, fp) that come sorted by key."""

    def solve(key: np.ndarray, home: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        table = np.stack([np.bitwise_count(fp ^ r).sum(1, dtype=np.int16) for r in refs], axis=1)
        a, b = _linked(fp, key, home, table, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def lanes_of(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.to_numpy().view(np.uint64)[:, None]
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                new = (b.column("key").to_numpy(), b.column("home").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), lanes_of(b.column("fp")))
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                cut = np.searchsorted(held[0], held[0][-1])  # the last key may go on in the next batch
                if cut:
                    yield solve(*(x[:cut] for x in held))
                    held = tuple(x[cut:] for x in held)
        if held is not None:
            yield solve(*held)

    return run


def _slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all the texts (id, text) fall into each slot of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for x in common.blobs(b.column("text")):
                np.add.at(n, _slot(shingle_set(x, words)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64), pa.int32()), pa.array([x.tobytes() for x in n.reshape(64, -1)], pa.binary())], names=["part", "n"])

    def total(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in t["n"].to_pylist())
        return pa.table({"part": t["part"].slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    out = np.zeros((64, (1 << SLOT_BITS) // 64), np.int64)
    for r in texts.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(total, "part int, n binary").collect():
        out[r.part] = np.frombuffer(r.n, np.int64)
    return out.ravel()


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """token, id, n (size of the set), pos (place in the order): the shingles of each text's set that come first by
    (count of the slot, hash).

    Of n shingles n - ceil(similarity n) + 1 are taken; sets so similar have one of them in common, whatever the
    counts. Sets without shingles share a token of their own.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_slot_counts(texts, words))

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, tokens, sizes = sent.value, [], []
        for x in common.blobs(b.column("text")):
            h = shingle_set(x, words)
            take = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
            tokens.append(h[np.lexsort((h, counts[_slot(h)]))[:take]] if len(h) else np.zeros(1, np.uint64))
            sizes.append(len(h))
        reps = np.array([len(t) for t in tokens])
        ids = np.repeat(b.column("id").to_numpy(), reps)
        cols = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(ids), pa.array(np.repeat(sizes, reps), pa.int64()), pa.array(common.ragged(np.zeros(len(reps), np.int64), reps), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["token", "id", "n", "pos"])

    return texts.mapInArrow(common.per_batch(first), "token long, id long, n long, pos long")


def _shingle_sets(texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """id and set (low halves of the hashes) of each asked id, in buckets of the id. Sets are shuffled once, texts never."""

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_set(x, words).astype("<u4")).tobytes() for x in common.blobs(b.column("text"))]
        return pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], names=["id", "set"])

    asked = common.work_table(asked, "asked")
    dealt = texts.mapInArrow(common.per_batch(sets), "id long, set binary").repartition(common.bucket_count(texts.sparkSession), "id")
    out = common.keyed_table(dealt.join(asked, "id", "left_semi").dropDuplicates(["id"]), "shingle_sets", "id")
    common.discard(asked)
    return out


def _verified(known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets (id, set) are so similar."""

    def similar(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(p, q, assume_unique=True))
            either = len(p) + len(q) - both
            ok.append(not either or both / either >= similarity)
        return b.select(["a", "b"]).filter(pa.array(ok))

    # a set that many links share is dealt to PARTS places
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") > PARTS).select("a", F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(PARTS))).otherwise(0).cast("int")
    pairs = common.work_table(pairs.join(hot, "a", "left").select("a", "b", part.alias("part")), "dealt-pairs")
    spread = pairs.join(known.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    hubs = pairs.select("a", "part").distinct().join(known.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = spread.join(hubs, ["a", "part"])
    out = common.work_table(both.select("a", "b", "x", "y").mapInArrow(common.per_batch(similar), "a long, b long"), "similar")
    common.discard(pairs)
    return out


def _print_links(texts: DataFrame, words: int, max_bits: int) -> DataFrame:
    """Links (a, b) of ids of texts (id, text) by fingerprint: classes of equal fingerprints by their least id, that id with every other of its class."""
    prints = fingerprints(texts.select(F.col("id").alias("doc_id"), "text"), words).withColumnRenamed("doc_id", "id").distinct()
    prints = common.work_table(prints, "text-prints")
    classes = common.work_table(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "print-classes")
    found = links(classes.select("fp"), classes.count(), max_bits).distinct()
    for end in ("a", "b"):  # a fingerprint may have very many links, a class very many texts
        named = classes.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_id"))
        found = common.spread_join(found, named, [end], "b" if end == "a" else "a")
    members = common.spread_join(prints, classes.filter("n > 1").select("fp", "least"), ["fp"], "id").filter("id != least")
    out = common.work_table(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).union(members.select("least", "id")), "print-links")
    common.discard(prints, classes)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends (node, root) are in different groups."""
    tops = pairs.select("a").distinct().join(roots.withColumnsRenamed({"node": "a", "root": "a_root"}), "a", "left").withColumn("a_root", F.coalesce("a_root", "a"))
    known = common.spread_join(pairs, tops, ["a"], "b").join(roots.withColumnsRenamed({"node": "b", "root": "b_root"}), "b", "left")
    return known.filter(F.col("a_root") != F.coalesce("b_root", "b")).select("a", "b")


def similar_links(texts: DataFrame, words: int, similarity: float, max_bits: int = 3) -> DataFrame:
    """Verified links (a, b) that connect all pairs of ids whose texts (id, text) have sets so similar.

    Links of fingerprints within max_bits bits are verified first; pairs that these join aren't compared again. The exact check: sets of n and m shingles that are so similar share at least s / (1 + s) (n + m), so their first common shingle
    stands at place n less that, or m less that, at most; a token pairs only rows for which this holds. Every
    set is compared with the hub of each token, the row where the token stands first (that with the fewest shingles
    of its own). Then, of the tokens whose sets are still in several groups, all pairs of two groups are compared; pairs
    of one group are joined already.
    """
    order = Window.partitionBy("token").orderBy("pos", "id")
    dealt = _prefixes(texts, words, similarity).select("*", F.first(F.struct("id", "n", "pos")).over(order).alias("hub"), F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("after"), F.count(F.lit(1)).over(Window.partitionBy("token")).alias("size"))
    several = F.coalesce(F.col("before") != F.col("id"), F.col("after") != F.col("id"), F.lit(False))
    shared = common.work_table(dealt.filter(several).drop("before", "after"), "shared-tokens")

    def viable(n: Column, i: Column, m: Column, j: Column) -> Column:
        common_ = similarity / (1 + similarity) * (n + m) - 1e-9
        return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (i <= n - common_) & (j <= m - common_) | (n == 0) & (m == 0)

    printed = _print_links(texts, words, max_bits)
    known = _shingle_sets(texts, shared.select("id").union(shared.select("hub.id")).union(printed.select("a")).union(printed.select("b")).distinct(), words)
    found = _verified(known, printed, similarity)
    common.discard(printed)
    near_hub = viable(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"))
    stars = common.work_table(shared.filter((F.col("hub.id") != F.col("id")) & near_hub).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    left = common.work_table(_apart(stars, components(found)), "stars-apart")
    found = found.union(_verified(known, left, similarity))
    common.discard(stars, left)

    roots = components(found).withColumnRenamed("node", "id")
    # of two rows the star is the only pair
    rows = common.work_table(shared.filter("size > 2").join(roots, "id", "left").select("token", "id", "n", "pos", F.col("hub.id").alias("hub"), F.coalesce("root", "id").alias("root")), "rooted-tokens")
    common.discard(shared)
    groups = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("token").agg(F.max(F.struct("size", "root")).alias("x"), F.count(F.lit(1)).alias("groups"))
    apart = common.work_table(rows.join(groups.filter("groups > 1").select("token", F.col("x.root").alias("most")), "token"), "tokens-apart")
    common.discard(rows)
    # one end at least is outside the token's largest group
    p, q = apart.filter("root != most").alias("p"), apart.alias("q")
    new = (F.col("p.root") != F.col("q.root")) & (F.col("p.id") != F.col("p.hub")) & (F.col("q.id") != F.col("q.hub"))
    once = (F.col("q.root") == F.col("q.most")) | (F.col("p.id") < F.col("q.id"))
    pairs = p.join(q, (F.col("p.token") == F.col("q.token")) & new & once & viable(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos")))
    pairs = common.work_table(pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct(), "pairs-apart")
    out = found.union(_verified(known, pairs, similarity))
    common.discard(apart, pairs, known)
    return out


def _components(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """prints (id, doc_id) with root and component_id, the least doc_id of all that links (a, b) reach."""
    roots = components(found)
    members = classes.join(roots, classes.id == roots.node).select("id", "root", "least_id")
    least = members.groupBy("root").agg(F.min("least_id").alias("linked_id"))
    linked = common.spread_join(members, least, ["root"], "id").select("id", "root", "linked_id")  # so may a component
    named = classes.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("linked_id")).alias("component_id"))
    return common.spread_join(prints, named, ["id"], "doc_id")  # a class may hold a third of all rows


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row a document: doc_id, fp, root, component_id (the least doc_id of all that links reach)."""
    prints = common.work_table(fingerprints(docs, words).withColumn("id", F.col("fp")), "fingerprints")
    classes = common.work_table(prints.groupBy("id").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    return _components(prints, classes, links(classes.select(F.col("id").alias("fp")), classes.count(), max_bits)).select("doc_id", "fp", "root", "component_id")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """docs without near copies: of each group that links of that similarity connect, the row of the least id.

    Fingerprints of the shingles within max_bits bits link first, by pivot tables as in near_duplicates; see similar_links.

    The similarity is that of the sets of word shingles (common over all), by hashes: 64 bits
    find pairs, their low halves compare them. The search misses no pair: see similar_links. Equal texts are one class from the start, by a 64-bit hash of the text. Texts without words are
    copies of each other. Columns that begin with __ are reserved.
    """
    names = docs.columns
    marked = docs.withColumn("__id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))

    ids = common.work_table(marked.select(F.col("__id").alias("id"), F.col("doc_id").cast("long").alias("doc_id")), "text-ids")
    classes = common.work_table(ids.groupBy("id").agg(F.min("doc_id").alias("least_id")), "text-classes")
    texts = marked.select(F.col("__id").alias("id"), F.col("text").cast("string").alias("text"))
    found = _components(ids, classes, similar_links(texts, words, similarity, max_bits))
    rows = found.groupBy("root", "doc_id", "id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("x"))
    kept = common.work_table(first.select(F.coalesce(F.col("x.doc_id").cast("string"), F.lit("")).alias("__kept"), F.col("x.id").alias("__id"), "x.n"), "kept-rows")
    named = marked.withColumn("__kept", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = named.join(kept.filter("n = 1"), ["__kept", "__id"], "left_semi")
    repeated = kept.filter("n > 1")  # rows alike in id and text; texts are compared by key for these alone
    if not repeated.isEmpty():
        out = out.union(named.join(repeated, ["__kept", "__id"], "left_semi").dropDuplicates(["__kept", "__id"]))
    return out.select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
