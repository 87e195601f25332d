"""Changes of upstream signals between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.operators.materialise import materialised


def compare(prev: DataFrame, cur: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """keys, prev, cur, change (new, removed, changed, unchanged)."""
    joined = prev.select(*keys, F.col(signal).alias("prev")).join(cur.select(*keys, F.col(signal).alias("cur")), keys, "full_outer")
    return joined.withColumn("change", change(F.col("prev"), F.col("cur")))


def change(prev: Column, cur: Column) -> Column:
    return F.when(prev.isNull() & cur.isNull(), "unknown").when(prev.isNull(), "new").when(cur.isNull(), "removed").when(prev != cur, "changed").otherwise("unchanged")


def merged(prev: DataFrame, cur: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """The next snapshot: what is known now, else what was known before."""
    joined = prev.select(*keys, F.col(signal).alias("p")).join(cur.select(*keys, F.col(signal).alias("c")), keys, "full_outer")
    return joined.select(*keys, F.coalesce("c", "p").alias(signal))


def top_changes(compared: DataFrame, by: str, n: int = 12) -> DataFrame:
    counts = compared.filter("change <> 'unchanged'").groupBy(by).agg(F.count(F.lit(1)).alias("changes"))
    return counts.orderBy(F.desc("changes"), by).limit(n)


def latest(runs: DataFrame) -> DataFrame:
    """Of each source's address runs with output, the last updated; the first of ties."""
    order = Window.partitionBy("source").orderBy(F.desc("updated"), "run")
    return runs.filter("layer = 'addresses' AND has_output AND source LIKE 'us/%'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def capped(compared: DataFrame, by: str, name: str, limit: int = 20) -> DataFrame:
    """by, n and the first names (in order) of what isn't unchanged, as a text of limit names and how many more there are.

    Only the first limit names of a group are gathered.
    """
    changed = compared.filter("change <> 'unchanged'")
    order = Window.partitionBy(by).orderBy(name)
    first = changed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    some = first.groupBy(by).agg(F.sort_array(F.collect_list(name)).alias("names"))
    rows = changed.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(some, by)
    more = F.when(F.col("n") > limit, F.concat(F.lit(" (+"), (F.col("n") - limit).cast("string"), F.lit(" more)"))).otherwise("")
    return rows.select(by, "n", F.concat(F.array_join("names", " "), more).alias("listed"))


def flatten(rows: DataFrame, nested: str, depth: int) -> DataFrame:
    """path (keys joined by /) and value of each leaf of a map nested depth deep, beside the other columns."""
    others = [c for c in rows.columns if c != nested]
    out = rows.select(*others, F.lit(None).cast("string").alias("path"), F.col(nested).alias("value"))
    for _ in range(depth):
        out = out.select(*others, "path", F.explode("value").alias("_key", "value")).select(*others, F.concat_ws("/", "path", "_key").alias("path"), "value")
    return out


def flatten_json(rows: DataFrame, text: str, max_depth: int = 1_000) -> DataFrame:
    """path and value (text) of each leaf of JSON however deep, beside the other columns: keys, and places in lists from 0, joined by /.

    A level a round, containers go on to the next. An empty map or list is a leaf, {} or []; JSON null is the leaf null; a whole text that is a single value has
    the path ''. Texts that are null or no JSON have no rows. Deeper than max_depth raises.
    """
    others = [c for c in rows.columns if c != text]
    names = [f"`{c}`" for c in others]
    level = rows.select(*names, F.lit(None).cast("string").alias("_path"), F.try_parse_json(text).alias("_v")).filter("_v IS NOT NULL")
    leaves: DataFrame | None = None
    for _ in range(max_depth):
        kind = F.schema_of_variant("_v")
        whole = F.to_json("_v")
        deep = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~whole.isin("{}", "[]")
        level = materialised(level.withColumn("_deep", deep))
        plain = F.coalesce(F.try_variant_get("_v", "$", "string"), F.when(F.is_variant_null("_v"), F.lit(None)).otherwise(F.to_json("_v")))
        done = level.filter("NOT _deep").select(*names, F.coalesce("_path", F.lit("")).alias("path"), plain.alias("value"))
        leaves = done if leaves is None else leaves.unionByName(done)
        level = level.filter("_deep")
        if level.isEmpty():
            return leaves
        inside = rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_in"))
        step = F.coalesce("_key", F.col("_pos").cast("string"))
        level = level.lateralJoin(inside).select(*names, F.concat_ws("/", "_path", step).alias("_path"), F.col("_in").alias("_v"))
    raise ValueError(f"JSON deeper than {max_depth}")


def attributed(runs: DataFrame, known: DataFrame) -> DataFrame:
    """state, slug, attribution, license of each source's latest run; known: slug_key, layer_attribution, attribution, license.

    What the layer says comes before what the whole source says; without either it is unknown.
    """
    parts = F.split("source", "/")
    slug = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/")
    rows = latest(runs).select(F.upper(F.get(parts, F.lit(1))).alias("state"), slug.alias("slug"), F.regexp_extract(slug, r"(\d+)$", 1).alias("slug_key"))
    return rows.join(known, "slug_key", "left").select("state", "slug", F.coalesce("layer_attribution", "attribution", F.lit("unknown")).alias("attribution"), F.coalesce("layer_attribution", "attribution").isNotNull().alias("has_attribution"), F.col("license").isNotNull().alias("has_license"))


def attribution_counts(found: DataFrame) -> DataFrame:
    """A row a state: sources, with_attribution, with_license."""
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("sources"), F.count_if("has_attribution").alias("with_attribution"), F.count_if("has_license").alias("with_license"))


def exit_code(compared: DataFrame, failed: int = 0) -> DataFrame:
    """One row: 1 if a source could not be asked, 3 if anything changed, else 0."""
    changed = F.coalesce(F.bool_or(F.col("change") != "unchanged"), F.lit(False))
    return compared.agg(F.when(F.lit(failed > 0), 1).when(changed, 3).otherwise(0).alias("code"))
