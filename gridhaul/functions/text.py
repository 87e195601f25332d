"""Address text, tags and keys, as columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridhaul.functions import constants as C


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def _abbreviate(token: Column, *dicts: dict[str, str]) -> Column:
    merged = {k: v for d in reversed(dicts) for k, v in d.items()}  # one map, one look; the first dictionary counts
    return F.coalesce(F.element_at(_map(merged), token), token)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row, however often an inner lambda uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize_query(text: Column) -> Column:
    """Lower-case words and digits, suffixes and directions abbreviated; blank text is empty."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))
    return F.array_join(F.transform(F.split(clean, " "), lambda t: _abbreviate(t, C.SUFFIX, C.LONG_DIRECTION)), " ")


def has_house_number(normalized: Column) -> Column:
    """Whether normalised text starts with a house number that isn't a lone postal code."""
    parts = F.split(normalized, " ")
    first, rest = F.element_at(parts, 1), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    lone_zip = first.rlike("^[0-9]{5}$") & F.forall(rest, lambda t: (F.length(t) <= 2) | t.rlike("^[0-9]+$"))
    return first.rlike(C.HOUSE_PATTERN) & ~lone_zip & (F.size(rest) > 0)


def query_street(raw: Column) -> Column:
    """A street as queries have it: all dots and commas gone, words abbreviated."""
    words = F.split(F.trim(F.lower(raw)), r"\s+")
    return F.array_join(F.filter(F.transform(words, lambda t: _abbreviate(F.regexp_replace(t, "[.,]", ""), C.SUFFIX, C.LONG_DIRECTION)), lambda t: t != ""), " ")


def last_zip(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(C.ZIP_PATTERN), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def parse_address(text: Column) -> Column:
    """Struct of number, street and zip; null without number and street."""
    number = F.regexp_extract(text, C.ADDRESS_PATTERN, 1).try_cast("long")
    street = query_street(F.regexp_extract(text, C.ADDRESS_PATTERN, 2))
    return F.when((number > 0) & (street != ""), F.struct(number.alias("number"), street.alias("street"), last_zip(text).alias("zip")))


def parse_state(text: Column) -> Column:
    """The right-most valid two-letter code, else the first state name contained, else the state of the first postal code."""
    codes = F.regexp_extract_all(F.upper(F.trim(text)), F.lit(C.STATE_CODE_PATTERN), 1)
    known = F.array(*(F.lit(c) for c in C.STATE_CODES))
    valid = F.filter(codes, lambda c: F.array_contains(known, c))
    all_names = F.array(*(F.lit(n) for n in C.STATE_NAMES))
    named = _once(F.lower(text), lambda low: F.filter(all_names, lambda n: F.contains(low, n)))
    names = F.element_at(_map(C.STATE_NAMES), F.get(named, F.lit(0)))
    first_zip = F.regexp_extract(text, C.ZIP_PATTERN, 1)
    prefix = F.substring(first_zip, 1, 3).try_cast("int")
    ranges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(s).alias("s")) for a, z, s in C.ZIP3))
    by_zip = _once(prefix, lambda p: F.get(F.filter(ranges, lambda r: p.between(r["a"], r["z"])), F.lit(0))["s"])
    return F.when(F.size(valid) > 0, F.element_at(valid, -1)).otherwise(F.coalesce(names, by_zip))


def stored_token(token: Column, extra: dict[str, str] | None = None) -> Column:
    """A token as loaders store it: dots and commas at its ends gone, abbreviated, lower case."""
    core = F.lower(F.regexp_replace(token, r"^[.,]+|[.,]+$", ""))
    return _abbreviate(core, C.SUFFIX | (extra or {}), C.DIRECTION)


def stored_tokens(text: Column, extra: dict[str, str] | None = None) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, lambda t: stored_token(t, extra)), " ")


def long_street(text: Column) -> Column:
    """Only long spellings are abbreviated."""
    words = F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, lambda t: _abbreviate(F.regexp_replace(t, r"^[.,]+|[.,]+$", ""), C.LONG_SUFFIX, C.LONG_DIRECTION)), " ")


def address_line(number: Column, street: Column, city: Column, state: Column, zip_: Column, plus4: Column | None = None) -> Column:
    """'number street, city, st zip-plus4' with what is empty left out."""

    def filled(x: Column) -> Column:
        return F.when(x != "", x)

    line = F.concat(F.concat_ws(" ", filled(number), filled(street)), F.lit(", "), F.concat_ws(", ", filled(F.lower(city)), filled(F.lower(state))))
    end = zip_ if plus4 is None else F.when((plus4 != "") & (plus4 != "0"), F.concat(zip_, F.lit("-"), plus4)).otherwise(zip_)
    return F.when(zip_ != "", F.concat(line, F.lit(" "), end)).otherwise(line)


def parse_maxspeed(text: Column) -> Column:
    """km/h of a speed tag; null if it isn't one. Only digits reach the cast: one that fails costs more than all the rest."""
    low = F.lower(text)
    number = F.nullif(F.regexp_extract(low, C.SPEED_PATTERN, 1), F.lit("")).try_cast("double")
    return number * F.when(F.contains(low, F.lit("mph")), C.MPH).otherwise(1.0)


def leading_int(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^(\d+)", 1).try_cast("long")


def split_multi(text: Column) -> Column:
    """The parts of a |-separated list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def coordinate(text: Column) -> Column:
    """Struct of lat and lon of a literal; null if it isn't one."""
    lat, lon = (F.regexp_extract(text, C.POINT_PATTERN, k).try_cast("double") for k in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def strict_coordinate(text: Column) -> Column:
    """Whether text is a literal without blanks, three digits before the point at most: such ends need no geocoder."""
    return text.rlike(C.STRICT_POINT_PATTERN)


def whole_limit(text: Column, default: int) -> Column:
    """A limit from text: default where nothing or no number is given, whole and at least 1."""
    number = F.floor(F.trim(text).try_cast("double"))
    return F.when(number.isNull(), default).otherwise(F.greatest(F.lit(1), number)).cast("int")


def request_parts(url: Column) -> tuple[Column, Column, Column]:
    """Origins, destinations and units of a request's query string; units are imperial unless metric is asked for."""
    part = {k: F.coalesce(F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(k))), F.lit("")) for k in ("origins", "destinations", "units")}
    return part["origins"], part["destinations"], F.when(F.lower(part["units"]) == "metric", "metric").otherwise("imperial")


def road_speed(highway: Column, maxspeed: Column) -> Column:
    """Posted speed, or that of the class; a speed of 0 counts as none."""
    posted = F.nullif(parse_maxspeed(maxspeed), F.lit(0.0))
    of_class = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(C.SPEED_KMH.items()))), highway), F.lit(C.DEFAULT_KMH)).cast("double")
    return F.coalesce(posted, of_class)


def filled_or(*columns: Column) -> Column:
    """The first column that is neither null nor empty, trimmed (blanks count as filled)."""
    return F.trim(F.coalesce(*(F.when(c != "", c) for c in columns), F.lit("")))


def row_key(*columns: Column) -> Column:
    """A content key of 128 bits: null and empty text are one; numbers by value."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def quarter_index(year_month: Column) -> Column:
    """Quarters since 2026 of 'YYYY-MM'."""
    year, month = F.substring(year_month, 1, 4).cast("int"), F.substring(year_month, 6, 2).cast("int")
    return (year - 2026) * 4 + F.floor((month - 1) / 3).cast("int")
