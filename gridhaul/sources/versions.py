"""Versions of a table: written beside each other, checked, then published by one swap of a pointer.

    path/data/<version>        the rows (Parquet)
    path/manifests/<version>   what was written: rows, digest, groups, schema, time, the version before
    path/CURRENT               the name of the version that readers get

A publication writes its files, reads them back and compares number and digest of the rows with what went in, then applies the guards. Only then the
pointer is replaced by a rename, which file systems with atomic renames do at once: a reader sees the old version or the new one. A load
that fails or is refused leaves the pointer alone; what it wrote is never read. Of two publications at one time the last swap stays, and both
versions can be pinned by name. Rows go by Spark; the driver handles the manifest and the pointer alone.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Refused(ValueError):
    """A publication that a guard holds back."""


class Versions:
    """Versions of a table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._conf, self._fs_pkg = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs
        self._root = self._fs_pkg.Path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._fs_pkg.Path("/".join([self.path, *names]))

    def _write(self, target: str, text: str) -> None:
        """text as a small file that is there whole or not at all."""
        self._fs.mkdirs(self._at(target).getParent())
        part = self._at(f"_part-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._fs_pkg, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._fs_pkg.FileContext.getFileContext(self._fs.makeQualified(self._root).toUri(), self._conf)
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._at(target)), options)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value

    def current(self) -> str | None:
        """The version that readers get; None before the first publication."""
        return self._read("CURRENT")

    def manifest(self, version: str | None = None) -> dict:
        """rows, digest, groups, schema, built_at and previous of a version (the current one)."""
        version = version or self.current()
        text = self._read(f"manifests/{version}") if version else None
        if text is None:
            raise LookupError(f"no version {version or ''} is published in {self.path}".replace("  ", " "))
        return json.loads(text)

    def read(self, version: str | None = None) -> DataFrame:
        """Rows of a version: the current one, or one pinned by name."""
        version = version or self.current()
        schema = StructType.fromJson(self.manifest(version)["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{version}")

    def publish(self, rows: DataFrame, groups: str | None = None, least: float = 0.5, force: bool = False) -> str:
        """Writes rows as a new version, checks it and makes it the current one; its name.

        groups: a column whose distinct values the manifest counts (states, tiles). Refused are no rows at all, fewer than the share `least` of the current
        version's rows or groups, and another schema, unless force is set. Rows equal to the current version's publish nothing: its name comes back.
        """
        version = f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        data, went_in = f"{self.path}/data/{version}", Observation()
        rows.observe(went_in, *_sums(rows)).write.parquet(data)
        back = self.spark.read.schema(rows.schema).parquet(data)
        found = back.agg(*_sums(back), *([F.count_distinct(F.coalesce(F.col(groups).cast("string"), F.lit("")))] if groups else [])).first()
        if (found[0], found[1]) != (went_in.get["n"], went_in.get["digest"]):
            raise Refused(f"{data} doesn't hold what was written")
        manifest = {"version": version, "rows": found[0], "digest": str(found[1]), "groups": found[2] if groups else None, "schema": json.loads(back.schema.json()), "built_at": f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}"}
        before = self.current()
        old = self.manifest(before) if before else None
        manifest["previous"] = before
        if old and all(old[k] == manifest[k] for k in ("rows", "digest", "schema")):
            return before
        if not force:
            self._guard(manifest, old, least)
        self._write(f"manifests/{version}", json.dumps(manifest))
        self._write("CURRENT", version)
        return version

    @staticmethod
    def _guard(new: dict, old: dict | None, least: float) -> None:
        if not new["rows"]:
            raise Refused("a version without rows")
        if old is None:
            return
        if new["schema"] != old["schema"]:
            raise Refused(f"columns {_names(new)} instead of {_names(old)}")
        for what in ("rows", "groups"):
            if (new[what] or 0) < least * (old[what] or 0):
                raise Refused(f"{new[what]} {what} instead of {old[what]}")


def _names(manifest: dict) -> str:
    return StructType.fromJson(manifest["schema"]).simpleString()


def _sums(rows: DataFrame) -> list:
    """Number of rows, and a sum of their hashes whatever their order."""
    names = [f"`{c}`" for c in sorted(rows.columns)]
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest")]
