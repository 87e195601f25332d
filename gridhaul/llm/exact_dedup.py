"""Exact deduplication by a streaming query over document headers.

Texts are equal when they are identical after deleting ASCII white space. Headers (digest, stable id,
length, content locator) land in the shared folder; a Structured Streaming aggregation in update mode with
the RocksDB state store and no watermark keeps one state row a digest for ever: group size, best row and its
locator. Partial aggregation before the state's shuffle leaves one row a task and digest, so a hot digest
stays small. For each digest hit twice the full normalised bytes are compared; digests that different
bytes share are grouped again by the bytes themselves.

Null text counts as empty; all blank texts are one group. A null doc_id loses to any id. Of rows alike in
length and id, the first by row number stays, so one row of each group is kept. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gridhaul.llm import common

BLANK = b" \t\n\x0b\x0c\r"
#: State on disk, uploaded as changes; files take only the space that they fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
UPDATES = "digest binary, group_size long, best struct<n_points: long, inv_id: long, inv_row: long, doc_id: long, row_id: long, locator: string>, batch int"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def headers(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row a document: row_id, doc_id, n_points, locator, digest, text_sha256."""
    rows = _texts(docs).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").cast("long").alias("n_points"), F.input_file_name().alias("locator"), "text"
    )

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        sha = [hashlib.sha256(x.translate(None, BLANK)).digest() for x in common.blobs(b.column("text"))]
        cols = [b.column(c) for c in ("row_id", "doc_id", "n_points", "locator")]
        cols += [pa.array([x[:digest_bytes] for x in sha], pa.binary()), pa.array([x.hex() for x in sha], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["row_id", "doc_id", "n_points", "locator", "digest", "text_sha256"])

    return rows.mapInArrow(common.per_batch(digest), "row_id long, doc_id long, n_points long, locator string, digest binary, text_sha256 string")


def _best() -> list:
    # the bitwise complement reverses the order of ids without overflow; null is least
    rank = F.struct("n_points", F.bitwise_not("doc_id").alias("inv_id"), F.bitwise_not("row_id").alias("inv_row"), "doc_id", "row_id", "locator")
    return [F.count(F.lit(1)).alias("group_size"), F.max(rank).alias("best")]


def keyed_state(landing: str, schema, spark, files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over the landed headers; the last state of each digest."""
    updates, checkpoint = common.fresh_path(spark, "dedup-updates"), common.fresh_path(spark, "dedup-state")
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        spark.createDataFrame([], UPDATES).write.parquet(f"{updates}/part=none")  # there to read if no batch runs
        reader = spark.readStream.schema(schema)
        reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
        state = reader.parquet(landing).groupBy("digest").agg(*_best())
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{updates}/part={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(UPDATES).parquet(f"{updates}/part=*")


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "big")


def _hits(groups: DataFrame):
    """The bitmap of digests with hits, broadcast: a byte a hit."""
    hit = groups.filter("group_size > 1").select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("h"))
    return groups.sparkSession.sparkContext.broadcast(common.bitmap(hit, hit.count()))


def _members(docs: DataFrame, bits, digest_bytes: int) -> DataFrame:
    """Headers and normalised bytes of the documents whose digest the bitmap has."""
    rows = _texts(docs).select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.length("text").cast("long").alias("n_points"), F.input_file_name().alias("locator"), "text")
    names = ["row_id", "doc_id", "n_points", "locator", "digest", "norm"]

    def members(b: pa.RecordBatch) -> pa.RecordBatch:
        at, digests, norms = [], [], []
        for k, x in enumerate(common.blobs(b.column("text"))):
            norm = x.translate(None, BLANK)
            d = hashlib.sha256(norm).digest()[:digest_bytes]
            if common.in_bitmap(bits.value, _hash(d)):
                at.append(k)
                digests.append(d)
                norms.append(norm)
        taken = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c).take(taken) for c in names[:4]), pa.array(digests, pa.binary()), pa.array(norms, pa.binary())], names=names)

    return rows.mapInArrow(common.per_batch(members), "row_id long, doc_id long, n_points long, locator string, digest binary, norm binary")


def _collisions(found: DataFrame) -> DataFrame:
    """Digests that different normalised bytes share, of the members of digests with hits."""
    ends = found.select("digest", "norm").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return ends.filter(F.col("least") != F.col("most")).select("digest")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, files_per_trigger: int | None = None) -> DataFrame:
    """One row a document: row_id, doc_id, n_points, text_sha256, keep_id, keep_row, keep_locator, group_size, kept."""
    spark = docs.sparkSession
    landing = common.fresh_path(spark, "dedup-headers")
    (head := headers(docs, digest_bytes)).write.parquet(landing)
    landed = spark.read.schema(head.schema).parquet(landing)
    groups = keyed_state(landing, head.schema, spark, files_per_trigger)
    if groups.select("batch").distinct().count() > 1:  # the last update of a digest is its state
        groups = groups.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("x")).select("digest", "x.*")
    groups = groups.select("digest", "group_size", "best")
    found = _members(docs, _hits(groups), digest_bytes)
    bad = common.work_table(_collisions(found), "dedup-collisions")
    joined = landed.join(groups, "digest")
    if not bad.isEmpty():
        joined = landed.join(groups.join(bad, "digest", "left_anti"), "digest").unionByName(_by_bytes(found, bad))
    return joined.select(
        "row_id", "doc_id", "n_points", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"),
        F.col("best.locator").alias("keep_locator"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"),
    )


def _by_bytes(found: DataFrame, bad: DataFrame) -> DataFrame:
    """Members of colliding digests, grouped by the normalised bytes themselves."""
    rows = found.join(bad, "digest", "left_semi")
    groups = rows.groupBy(F.col("norm").alias("bytes")).agg(*_best())
    joined = rows.join(groups, rows.norm == groups.bytes)
    return joined.select("row_id", "doc_id", "n_points", "locator", "digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies: its columns, one row of each group (of rows alike in id and length the one whose text's hash is least).

    Documents whose digest has no hit stay where they are; only those of groups are shuffled. Columns that begin with __ are reserved.
    """
    names = docs.columns
    found = common.work_table(exact_dedup(docs).select("doc_id", "n_points", "text_sha256", "group_size", "kept"), "dedup-decisions")
    bits = _hits(found.filter("kept").select(F.unhex("text_sha256").alias("digest"), "group_size"))

    def marked(b: pa.RecordBatch) -> pa.RecordBatch:
        sha = [hashlib.sha256(x.translate(None, BLANK)).digest() for x in common.blobs(b.column("text"))]
        cols = [pa.array([x.hex() for x in sha], pa.string()), pa.array([common.in_bitmap(bits.value, _hash(x)) for x in sha], pa.bool_())]
        return pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*names, "__sha", "__hit"])

    rows = docs.mapInArrow(common.per_batch(marked), StructType([*docs.schema.fields, StructField("__sha", StringType()), StructField("__hit", BooleanType())]))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    grouped = rows.filter("__hit").withColumns({"__points": F.length(text).cast("long"), "__id": F.col("doc_id").cast("long"), "__order": F.xxhash64(text)})
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("n_points").alias("kept_points"), F.col("text_sha256").alias("kept_sha"))
    same = grouped["__id"].eqNullSafe(kept.kept_id) & (grouped["__points"] == kept.kept_points) & (grouped["__sha"] == kept.kept_sha)
    first = F.row_number().over(Window.partitionBy("__id", "__points", "__sha").orderBy("__order"))
    some = grouped.join(kept, same, "left_semi").withColumn("__n", first).filter("__n = 1")
    return rows.filter("NOT __hit").select(*names).unionByName(some.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
  first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM g
"""
