"""An inverted index that follows inserts and deletes: every batch adds rows in proportion to what it changes, nothing is rebuilt.

A batch leaves four small tables in a folder of its number: postings of what came, ids of what went, and by how much token frequencies and shard sizes
changed. Deleted documents' tokens are looked up among the live postings of those ids alone. A reader sees the batches whose marker stands, which is
written last; a batch that was cut off is written anew in place, one that is complete isn't written again, so replays change nothing. A document that
goes and comes in one batch is replaced. compact() writes what is live as one batch of a new folder.

Ids that a batch inserts although they are live, or deletes although they aren't, raise and are ignored. Null ids or shards are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhaul.operators import fulltext
from gridhaul.operators.materialise import materialised

SCHEMAS = {
    "postings": "shard string, token string, id long, len int, tf long",
    "gone": "shard string, id long",
    "frequencies": "shard string, token string, n long",
    "sizes": "shard string, docs long, tokens long",
    "done": "marker string",
}


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def batches(self) -> list[int]:
        """The complete batches, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._exists(f"{self.path}/done/{n}/_SUCCESS"))

    def _table(self, name: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, batch long")
        paths = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(f"{SCHEMAS[name]}, batch long").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def live(self, batches: list[int] | None = None) -> DataFrame:
        """The postings of documents that came and haven't gone since."""
        of = self.batches() if batches is None else batches
        came, gone = self._table("postings", of), self._table("gone", of)
        later = gone.groupBy("shard", "id").agg(F.max("batch").alias("last"))
        return came.join(later, ["shard", "id"], "left").filter("last IS NULL OR last <= batch").drop("last", "batch")

    def frequencies(self) -> DataFrame:
        """shard, token, df, from the changes of all batches."""
        return self._table("frequencies", self.batches()).groupBy("shard", "token").agg(F.sum("n").alias("df")).filter("df > 0")

    def sizes(self) -> DataFrame:
        """shard, n_docs, mean_len."""
        changes = self._table("sizes", self.batches()).groupBy("shard").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n"))
        return changes.filter("n_docs > 0").select("shard", "n_docs", (F.col("n") / F.col("n_docs")).alias("mean_len"))

    def apply(self, batch: int, inserted: DataFrame, deleted: DataFrame | None = None) -> None:
        """One batch: inserted documents (shard, id, text) and deleted ones (shard, id)."""
        before = self.batches()
        if batch in before:
            return
        if before and batch < before[-1]:
            raise ValueError(f"batch {batch} comes after batch {before[-1]}")
        known = "shard IS NOT NULL AND id IS NOT NULL"
        new = materialised(fulltext.postings(inserted.filter(known).select("shard", F.col("id").cast("long").alias("id"), "text")))
        went = self.spark.createDataFrame([], SCHEMAS["gone"]) if deleted is None else deleted.filter(known).select("shard", F.col("id").cast("long").alias("id")).distinct()
        live = self.live(before)
        old = materialised(live.join(went, ["shard", "id"], "left_semi"))
        went = materialised(old.select("shard", "id").distinct())
        twice = new.select("shard", "id").distinct().join(live.select("shard", "id").distinct(), ["shard", "id"], "left_semi").join(went, ["shard", "id"], "left_anti").limit(5).collect()
        if twice:
            raise ValueError(f"ids that are there already: {', '.join(str(r.id) for r in twice)}")
        signed = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
        frequencies = signed.groupBy("shard", "token").agg(F.sum("sign").alias("n")).filter("n <> 0")
        docs = signed.select("shard", "id", "len", "sign").distinct()
        sizes = docs.groupBy("shard").agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("len")).alias("tokens"))
        self._write(batch, {"postings": new, "gone": went, "frequencies": frequencies, "sizes": sizes})

    def _write(self, batch: int, tables: dict[str, DataFrame]) -> None:
        marker = self.spark.range(1).select(F.lit(uuid.uuid4().hex).alias("marker"))
        for name, df in (tables | {"done": marker}).items():
            columns = [c.split(" ") for c in SCHEMAS[name].split(", ")]
            df.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns)).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def compact(self, path: str) -> TextIndex:
        """An index at another path that holds what is live as one batch, under the last batch's number."""
        out, of = TextIndex(self.spark, path), self.batches()
        if of:
            sizes = self._table("sizes", of).groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            tables = {"postings": self.live(of), "gone": self.spark.createDataFrame([], SCHEMAS["gone"]), "frequencies": self.frequencies().withColumnRenamed("df", "n"), "sizes": sizes}
            out._write(of[-1], tables)
        return out

    def ranked(self, asked: DataFrame, tiers: DataFrame) -> DataFrame:
        """fulltext.ranked by the kept postings, frequencies and sizes."""
        return fulltext.ranked(asked, self.live(), tiers, self.frequencies(), self.sizes())
