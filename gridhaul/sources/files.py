"""File forms of address, segment and feature tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridhaul.functions import text as X

ADDRESS = "id long, normalized string, lat string, lon string, tier string"
FEATURE = "properties struct<number: string, street: string, city: string, postcode: string>, geometry struct<type: string, coordinates: array<double>>"


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Address rows of CSV files with a header; short rows and rows without numbers for a point are left out."""
    rows = spark.read.schema(ADDRESS).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})
    return rows.filter("normalized IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND tier IS NOT NULL")


def features(lines: DataFrame) -> DataFrame:
    """number, street, city, postcode, lat, lon of GeoJSON features, one a line (value); broken lines are left out."""
    f = lines.select(F.from_json("value", FEATURE, {"mode": "PERMISSIVE"}).alias("f")).filter("f.geometry IS NOT NULL AND size(f.geometry.coordinates) >= 2")
    text = [F.coalesce(F.trim(f"f.properties.{c}"), F.lit("")).alias(c) for c in ("number", "street", "city", "postcode")]
    return f.select(*text, F.element_at("f.geometry.coordinates", 2).alias("lat"), F.element_at("f.geometry.coordinates", 1).alias("lon")).filter("number <> '' AND street <> ''")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON files, compressed or not."""
    return features(spark.read.text(path))


def write_by_state(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """A folder a state; states that rows don't have are left as they are."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_mirror(rows: DataFrame, path: str) -> None:
    """A mirror of keys and ids, sorted within its files so that readers skip by key."""
    rows.repartition("state").sortWithinPartitions("state", "key", "id").write.mode("overwrite").partitionBy("state").parquet(path)


FOLDER_BITS = 3  # a folder holds so many tiles (2^bits) each way


def _folder(tile: str) -> Column:
    return F.shiftright(tile, FOLDER_BITS)


def write_tiles(edges: DataFrame, path: str) -> None:
    """Edges by the tile of their source, so that a corridor reads its tiles alone: a folder for 64 tiles, its rows sorted by tile."""
    placed = edges.withColumns({"f_tx": _folder("u_tx"), "f_ty": _folder("u_ty")})
    placed.repartition("f_tx", "f_ty").sortWithinPartitions("f_tx", "f_ty", "u_tx", "u_ty", "u_dense").write.mode("overwrite").partitionBy("f_tx", "f_ty").parquet(path)


def read_tiles(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """Edges as write_tiles leaves them; of these tiles (tx, ty) alone if given, so that other folders aren't read."""
    edges = spark.read.parquet(path)
    if tiles is None:
        return edges.drop("f_tx", "f_ty")
    wanted = tiles.select(_folder("tx").alias("f_tx"), _folder("ty").alias("f_ty"), F.col("tx").alias("u_tx"), F.col("ty").alias("u_ty")).distinct()
    return edges.join(wanted, ["f_tx", "f_ty", "u_tx", "u_ty"], "left_semi").drop("f_tx", "f_ty")


def read_mirror(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """state, key, id and what else a mirror holds; of one state if given."""
    rows = spark.read.parquet(path)
    return rows if state is None else rows.filter(F.col("state") == state)


def write_overlay(edges: DataFrame, path: str) -> None:
    """Motorway edges (u, v, seconds, decametres) as 32-bit numbers, sorted by source within their files."""
    rows = edges.select("u", "v", F.col("seconds").cast("int").alias("seconds"), F.col("decametres").cast("int").alias("decametres"))
    rows.repartition("u").sortWithinPartitions("u", "v").write.mode("overwrite").parquet(path)


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """u, v, seconds, metres of motorway edges."""
    return spark.read.parquet(path).select("u", "v", F.col("seconds").cast("double").alias("seconds"), (F.col("decametres") * 10.0).alias("metres"))


def changed_states(rows: DataFrame, stored: DataFrame, listed: DataFrame | None = None, override: bool = False) -> DataFrame:
    """rows of the states whose content differs from what is stored (state, digest); states alike are left out.

    The digest of a state is an order-free sum over its rows. listed (state): live shards that a whole reload must not touch
    unless override is set; one of them among the changed states raises.
    """
    now = state_digests(rows)
    changed = now.join(stored.withColumnRenamed("digest", "old"), "state", "left").filter(~F.col("digest").eqNullSafe(F.col("old"))).select("state")
    if listed is not None and not override and (hit := changed.join(listed, "state", "left_semi").limit(5).collect()):
        raise ValueError(f"live shards would be reloaded: {', '.join(sorted(r.state for r in hit))}")
    return rows.join(F.broadcast(changed), "state", "left_semi")  # a row a state; dealt by state, a few tasks would sort all rows


def state_digests(rows: DataFrame) -> DataFrame:
    """state and a digest of its rows whatever their order: their number and the sum of their hashes."""
    names = sorted(c for c in rows.columns if c != "state")
    sums = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("h"))
    return sums.select("state", F.concat_ws(":", F.col("n").cast("string"), F.col("h").cast("string")).alias("digest"))


def authority_addresses(rows: DataFrame) -> DataFrame:
    """id, state, number, street, city, zip, plus4, lat, lon (text) of an address authority's rows, by their header names.

    Full forms come before parts; a column that the file doesn't have counts as empty.
    """
    have = {c.lower(): c for c in rows.columns}

    def col(name: str):
        return F.col(have[name.lower()]).cast("string") if name.lower() in have else F.lit(None).cast("string")

    parts = F.array(*(F.trim(F.coalesce(col(c), F.lit(""))) for c in ("St_PreDir", "St_PreTyp", "St_Name", "St_PosTyp", "St_PosDir", "St_PosMod")))
    full = F.trim(F.coalesce(col("StNam_Full"), F.lit("")))
    street = F.when(full != "", full).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), " "))
    text = lambda *names: X.filled_or(*(col(n) for n in names))
    return rows.select(F.monotonically_increasing_id().alias("id"), text("State").alias("state"), text("AddNo_Full", "Add_Number").alias("number"), street.alias("street"), text("Inc_Muni", "Post_City", "Census_Plc").alias("city"), text("Zip_Code").alias("zip"), text("Plus_4").alias("plus4"), col("Latitude").alias("lat"), col("Longitude").alias("lon"))


def read_authority(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, as authority_addresses gives them."""
    return authority_addresses(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))


def table_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Cells of the rows (value) of tables written with bars; a dash is nothing, heads and rules are left out.

    Numbers lose signs of plus and percent.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.filter(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[-:|\s]+\|\s*$")).select(cells.alias("c"))
    rows = rows.filter((F.size("c") == len(columns)) & (F.get("c", F.lit(0)) != columns[0]))
    return rows.select(*(F.when(F.get("c", F.lit(k)) != "—", F.get("c", F.lit(k))).alias(c) for k, c in enumerate(columns)))


def number_of(cell):
    """The number of a table's cell, without its signs; null if it isn't one."""
    return F.regexp_replace(cell, "[+%]", "").try_cast("double")


def landing(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
