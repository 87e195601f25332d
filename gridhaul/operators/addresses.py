"""Loading, checking and merging address rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.functions import text as X
from gridhaul.functions.constants import SHARD_ORDER
from gridhaul.operators.numbering import numbered

STATES = tuple(SHARD_ORDER)
SPAN = 100_000  # numbers of a source's rows that one piece of a state spans


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def address_rows(raw: DataFrame, suffixes: dict[str, str] | None = None, states: tuple[str, ...] = STATES) -> DataFrame:
    """id, state, normalized, lat, lon of raw text rows; rows without number, street, a state of those accepted or a usable point go."""
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    state = F.upper(F.trim("state"))
    number, street = (X.stored_tokens(F.coalesce(F.col(c), F.lit("")), suffixes) for c in ("number", "street"))
    line = X.address_line(number, street, F.trim("city"), state, F.trim("zip"), F.trim("plus4"))
    rows = raw.select("id", state.alias("state"), number.alias("number"), street.alias("street"), line.alias("normalized"), lat.alias("lat"), lon.alias("lon"))
    good = F.col("state").isin(*states) & (F.length("number") > 0) & (F.length("street") > 0) & valid_point(F.col("lat"), F.col("lon"))
    return rows.filter(good).select("id", "state", "normalized", "lat", "lon")


def tagged_rows(nodes: DataFrame, default_state: Column | str) -> DataFrame:
    """id, state, normalized of map nodes (id, tags) with a house number and a street; the file's state where no tag has one."""
    tag = lambda k: F.col("tags")[f"addr:{k}"]
    state = F.coalesce(tag("state"), F.lit(default_state) if isinstance(default_state, str) else default_state)
    line = X.address_line(F.trim(F.lower(tag("housenumber"))), X.long_street(tag("street")), F.trim(F.coalesce(tag("city"), F.lit(""))), state, F.coalesce(F.trim(tag("postcode")), F.lit("")))
    return nodes.filter(tag("housenumber").isNotNull() & tag("street").isNotNull()).select("id", state.alias("state"), line.alias("normalized"))


def distinct_in_source(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Of rows of these sources alike in text, the first by seq."""
    first = F.row_number().over(Window.partitionBy("state", "source", "normalized").orderBy("seq"))
    return rows.withColumn("_n", F.when(F.col("source").isin(sources), first).otherwise(1)).filter("_n = 1").drop("_n")


def merge_sources(rows: DataFrame, order: list[str]) -> DataFrame:
    """Union by priority: of rows alike in text and 1e-4 degree cell (cut towards zero), that of the first source.

    rows: state, source, seq, normalized, lat, lon. Ids run within a state; points get seven decimals.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("source"))
    cell = [F.col(c) * 10000 for c in ("lat", "lon")]
    keyed = rows.withColumn("rank", rank).filter("rank > 0").withColumns({"cy": cell[0].cast("long"), "cx": cell[1].cast("long")})
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("state", "normalized", "cy", "cx").orderBy("rank", "seq"))).filter("_n = 1")
    first = numbered(first, ["state"], F.struct("rank", F.floor(F.col("seq") / SPAN).alias("at")), ["rank", "seq", "normalized"], "id")
    return first.select("state", F.col("id").cast("long").alias("id"), "normalized", F.format_string("%.7f", "lat").alias("lat"), F.format_string("%.7f", "lon").alias("lon"), "source", F.when(F.col("source") == "OSM", "interpolated").otherwise("rooftop").alias("tier"))
