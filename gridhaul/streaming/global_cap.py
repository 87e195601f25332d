"""The daily cap over all callers as a stream, behind their own limits.

Order across micro-batches is that of arrival, inside one it is time, then seq. What is kept from batch to batch is one number a day, written beside each
batch's decisions, never a day's requests: a micro-batch's sums go by minute, then inside minutes, and start from what its days have used before.
Decisions and numbers lie in folders named by the batch, and a batch that runs again, after a failure, writes the same over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.operators.limits import global_cap
from gridhaul.operators.materialise import materialised

TOTAL = "day long, total long"


def capped(per_day: int, out: str, totals: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls with callers' decisions (seq, now, elements, ok): those that passed get theirs in out (seq, day, elements, ok, used, batch)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        admitted = materialised(batch.filter("ok").select("seq", "now", "elements", "ok"))
        before = spark.read.schema(TOTAL).parquet(f"{totals}/batch={number - 1}") if number else spark.createDataFrame([], TOTAL)
        global_cap(admitted, per_day, before).write.mode("overwrite").parquet(f"{out}/batch={number}")
        days = admitted.groupBy(F.floor(F.col("now") / 86_400).alias("day")).agg(F.sum("elements").alias("total"))
        days.unionByName(before).groupBy("day").agg(F.sum("total").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return write
