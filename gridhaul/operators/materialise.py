"""Tables that several branches of a plan, or rounds of a loop, read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that driver and executors share; lost executors lose nothing of it."""
    _folder(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """df kept there in buckets of a key, as many as shuffles have partitions: a join by the key shuffles the other side alone.

    dealt: df is in so many partitions by the key already.
    """
    spark, table = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).option("path", f"{_folder(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.bucketed_table = table
    return out


def dropped(df: DataFrame) -> None:
    """Delete what bucketed kept; nothing may read it any more."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE {df.bucketed_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/{df.bucketed_table}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
