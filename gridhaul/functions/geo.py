"""Geometry, tiles, rounding and display of distances and durations, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhaul.functions.constants import CELL_DEG, EARTH_M, FEET_A_METRE, METRES_A_MILE, SNAP_CELLS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))  # least would pass nulls over


def planar_separation(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_lat: Column) -> Column:
    """Metres between near points, longitudes shrunk at the latitude of the query."""
    dy, dx = (lat1 - lat2) * 111_000, (lon1 - lon2) * 111_000 * F.cos(F.radians(at_lat))
    return F.sqrt(dy * dy + dx * dx)


def tile_x(lon: Column) -> Column:
    return F.floor((lon + 180) / CELL_DEG).cast("int")


def tile_y(lat: Column) -> Column:
    return F.floor((lat + 90) / CELL_DEG).cast("int")


def pack_tile(tx: Column, ty: Column) -> Column:
    """Two signed 16-bit numbers as one unsigned 32-bit number."""
    return (F.shiftleft(tx.cast("long").bitwiseAND(0xFFFF), 16)).bitwiseOR(ty.cast("long").bitwiseAND(0xFFFF))


def unpack_tile(packed: Column) -> tuple[Column, Column]:
    def signed(x: Column) -> Column:
        return F.when(x >= 0x8000, x - 0x10000).otherwise(x).cast("int")

    return signed(F.shiftright(packed, 16).bitwiseAND(0xFFFF)), signed(packed.bitwiseAND(0xFFFF))


def snap_cell(value: Column, low: Column) -> Column:
    """Sub-cell of a tile, kept inside it; low is the tile's lower bound."""
    return F.greatest(F.lit(0), F.least(F.lit(SNAP_CELLS - 1), F.floor((value - low) / (CELL_DEG / SNAP_CELLS)).cast("int")))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, halves away from zero, by its product with the power of ten as databases do on doubles; F.round goes by the shortest decimal text
    instead, and builds it. Nothing here is a branch, so the product is computed once."""
    scale = float(10**digits)
    p = x * scale
    even, rest = F.rint(p), p - F.rint(p)  # a half that went towards zero goes on by one
    return (even + ((rest == 0.5) & (p > 0)).cast("double") - ((rest == -0.5) & (p < 0)).cast("double")) / scale


def quantise(x: Column, most: int = 65_535) -> Column:
    """Half-even to a whole number from 1 to most."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.rint(x).cast("long")))


def one_decimal(x: Column) -> Column:
    """x >= 0 to one decimal by its exact binary value, ties up: the product with 10 and its rounding error decide."""
    p = x * 10
    c = x * 134_217_729.0
    high = c - (c - x)
    error = (high * 10 - p) + (x - high) * 10
    f = F.floor(p)
    n = f + F.when((p - f > 0.5) | ((p - f == 0.5) & (error >= 0)), 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def _one_or_none(x: Column, unit: str) -> Column:
    return F.concat(F.when(x < 10, one_decimal(x)).otherwise(half_up(x).cast("string")), F.lit(unit))


def _imperial(metres: Column, miles: Column) -> Column:
    feet = metres * FEET_A_METRE
    return F.when(feet < 528, F.concat(half_up(feet).cast("string"), F.lit(" ft"))).otherwise(_one_or_none(miles, " mi"))


def format_distance(metres: Column, units: str = "imperial") -> Column:
    if units == "metric":
        return F.when(metres < 1000, F.concat(half_up(metres).cast("string"), F.lit(" m"))).otherwise(_one_or_none(metres / 1000, " km"))
    return _imperial(metres, metres / METRES_A_MILE)


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def _clock(seconds: Column, minutes: Column, hours: Column, rest: Column) -> Column:
    long_form = F.when(rest == 0, _counted(hours, "hour")).otherwise(F.concat(_counted(hours, "hour"), F.lit(" "), _counted(rest, "min")))
    short = _counted(F.greatest(F.lit(1), half_up(seconds)), "sec")
    return F.when(seconds < 60, short).when(minutes < 60, _counted(minutes, "min")).otherwise(long_form)


def format_duration(seconds: Column) -> Column:
    minutes = half_up(seconds / 60)
    return _clock(seconds, minutes, F.floor(minutes / 60), minutes % 60)


def with_texts(legs: DataFrame, metres: str, seconds: str) -> DataFrame:
    """legs with distance_text and duration_text, imperial. What texts share is computed beforehand, a step at a time: in one expression the generated
    code passes what the JVM compiles (8,000 bytes a method), and each row takes some twenty times as long."""
    shared = legs.withColumns({"_miles": F.col(metres) / METRES_A_MILE, "_minutes": half_up(F.col(seconds) / 60)})
    texts = shared.withColumns({"distance_text": _imperial(F.col(metres), F.col("_miles")), "_hours": F.floor(F.col("_minutes") / 60), "_rest": F.col("_minutes") % 60}).drop("_miles")
    return texts.withColumn("duration_text", _clock(F.col(seconds), F.col("_minutes"), F.col("_hours"), F.col("_rest"))).drop("_minutes", "_hours", "_rest")


def plain_number(x: Column) -> Column:
    """A double as text without exponent or trailing zeros: 37, 40.758."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", "")
