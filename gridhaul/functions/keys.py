"""Keys, hashes, time buckets and display of signals, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridhaul.functions.geo import plain_number


def address_cache_key(version: Column, normalized: Column) -> Column:
    return F.concat_ws(":", F.lit("geo4"), version, F.sha1(normalized))


def leg_cache_key(version: Column, origin: Column, dest: Column) -> Column:
    return F.concat_ws(":", F.lit("leg2"), version, origin.cast("string"), dest.cast("string"))


def caller_key(salt: str, ip: Column) -> Column:
    """A caller as 32 hex digits of a salted hash."""
    return F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 32)


def day_bucket(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def to_midnight(seconds: Column) -> Column:
    return 86400 - F.pmod(seconds, F.lit(86400))


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def md5_of_body(body: Column) -> Column:
    """The first word of a checksum file, if it is one."""
    first = F.element_at(F.split(F.trim(body), r"\s+"), 1)
    return F.when(F.length(first) == 32, F.lower(first))


def source_parts(source: Column) -> tuple[Column, Column]:
    """State and slug of a source path such as us/ca/alameda."""
    parts = F.split(source, "/")
    return F.upper(F.get(parts, F.lit(1))), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "-")


def shapefile_name(vintage: Column, fips: Column) -> Column:
    """Archive name of a state's lines; from 2026 on without the a_ part."""
    return F.concat(F.lit("tlgdb_"), vintage.cast("string"), F.when(vintage >= 2026, "_").otherwise("_a_"), fips, F.lit(".gdb.zip"))


def byte_size(n: Column) -> Column:
    """Bytes with the largest unit that leaves at least one."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None)
    for k, unit in enumerate(units):
        out = F.when(n >= (1024**k if k else 0), F.concat(F.format_string("%.1f", n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def miles(metres: Column) -> Column:
    """Miles for panels; nothing and zero are a dash."""
    return F.when(F.coalesce(metres, F.lit(0.0)) == 0, "—").otherwise(F.format_string("%.1f", metres / 1609.344))


def minutes(seconds: Column) -> Column:
    """Whole minutes for panels; nothing and zero are a dash."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "—").otherwise(F.format_string("%.0f", F.rint(seconds / 60)))


def thousands(n: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(n, 0)


def capped_list(items: Column, limit: int = 20) -> Column:
    """The first items of a list joined by blanks and how many more there are; a dash for none."""
    n = F.coalesce(F.size(items), F.lit(0))
    more = F.when(n > limit, F.concat(F.lit(" (+"), (n - limit).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(n > 0, F.concat(F.array_join(F.slice(items, 1, limit), " "), more)).otherwise("-")


def content_hash(*columns: Column) -> Column:
    """SHA-256 of a row's or plan's values, for tables and plans that are compared as a whole; null and empty text are one."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%+.1f%%", x))


def point_text(lat: Column, lon: Column) -> Column:
    return F.concat(plain_number(lat), F.lit(","), plain_number(lon))
