"""What the operators of this subpackage share: the shared folder, work tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(_LOCAL[app])
        base = _LOCAL[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps start from files, whichever executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def keyed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """A work table in buckets of the key, as many as shuffles have partitions: a join by the key shuffles the other side alone.

    df is best dealt by the key already (bucket_count).
    """
    spark, table, path = df.sparkSession, f"{name}_{uuid.uuid4().hex}", fresh_path(df.sparkSession, name)
    df.write.format("parquet").bucketBy(bucket_count(spark), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.work_path, out.table_name = path, table
    return out


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(*tables: DataFrame) -> None:
    """Delete work tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "table_name"):
            spark.sql(f"DROP TABLE IF EXISTS {t.table_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sampled(rows: DataFrame, limit: int, *key: str, hard: bool = True) -> DataFrame:
    """About limit rows whose hash of the key is least: rows are counted first, then a threshold on the hash picks them where
    they are, so no task gathers more than the sample. Rows of one key come together; of a key that very many rows share, twice limit
    stay at most, unless hard is off."""
    n = rows.count()
    if n <= limit:
        return rows
    mark = F.shiftrightunsigned(F.xxhash64(*key), 4)  # 60 bits: no table is so large that the threshold falls to nothing
    some = rows.filter(mark < (1 << 60) * limit // n)
    return some.orderBy(mark, F.xxhash64(*rows.columns)).limit(2 * limit) if hard else some


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits of a set of n non-negative hashes (column h): bit h mod size, at least eight bits a hash and 2^30 at most, so what
    is sent is one byte a hash and 128 MB at most. Beyond that more strangers pass; who tests against it decides exactly afterwards.
    """
    bits = 1 << max(15, min(30, (8 * n).bit_length()))
    at = F.col("h") % bits + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in rows:
        out[r.k - 1] = np.frombuffer(r.b, np.uint8)
    return out.ravel()


def in_bitmap(bits: np.ndarray, h: int) -> bool:
    at = h % (8 * len(bits))
    return bool(bits[at >> 3] >> (at & 7) & 1)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, parts: int = 64) -> DataFrame:
    """Inner join with rows of one key dealt to so many places by a hash of the column by; small goes where they are."""
    dealt = big.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    places = dealt.select(*keys, "__part").distinct().join(small, keys)
    return dealt.join(places, [*keys, "__part"]).drop("__part")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo modulus; a null id is in no fold."""
    return F.crc32(doc_id.cast("string")) % modulus


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that long texts fit in a Python worker: so many rows and bytes at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def blobs(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
