"""URL filters by a sort-merge range join: rules are prefixes of canonical keys, a sorted sweep holds the stack of active nested ones.

A host's canonical key has its labels in reverse, each followed by a dot, so a domain and all its subdomains are the interval of one prefix;
a path's key is a rule's host and the path, so the paths that a rule of that host allows or blocks are an interval too. Of two prefixes one
holds the other or they are apart, so at every place of the sorted order the active ones nest: a running sum of starts and
ends is the height of the stack, and what lies on its top is the last start at that height. Both sweeps are windows over ranges of the sorted keys,
each range taking what is open at its beginning from sums of the ranges before.

First the distinct hosts of the urls are swept against the hosts of rules: the top is the longest rule host that holds a host, and with it come the
shorter ones that hold that host. Then the distinct (rule host, path) pairs are swept against the rules themselves. Paths count up to the
longest rule path only, so a host that many urls share is swept once for each such beginning. The best rule of each (host,
beginning) returns to the urls, those of one host dealt to 64 places.

A rule (host, path) fits its host and subdomains if the url's path starts with the rule's; of those that fit, the longest wins (host and path
together, then the host); a rule given with both verdicts blocks. Without a rule the verdict is the default. An empty rule host fits
every host. Null urls and those without `://` have empty host and path. Host letters A-Z are lower-cased in urls and rules. Repeated rows
are judged one by one, null ids too; urls of any length do. Without rules every verdict is the default; an empty table gives no rows. Columns
besides page_id and url are ignored, whatever their names.

Only DataFrame functions: no Python, pandas, Arrow or RDD code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridhaul.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES = 64  # for the urls of one host
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
START, POINT, END = 0, 1, 2


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """host, path, verdict."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules or (("", "", ""),)))
    return spark.range(1).select(F.inline(rows)).filter(F.lit(bool(rules)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels in reverse, each followed by a dot; nothing for the empty host of a rule."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """key of each of the distinct points with top, the longest of the distinct prefixes that it begins with, or null."""
    spark = points.sparkSession
    raw = F.col("key").cast("binary")
    found = points.select(raw.alias("at"), F.lit(POINT).alias("kind"), F.lit(0).alias("step"), "key")
    found = found.unionByName(prefixes.select(raw.alias("at"), F.lit(START).alias("kind"), F.lit(1).alias("step"), "key"))
    found = found.unionByName(prefixes.select(F.concat(raw, F.unhex(F.lit("FF"))).alias("at"), F.lit(END).alias("kind"), F.lit(-1).alias("step"), "key"))  # no UTF-8 text holds this byte
    found = common.work_table(found.repartitionByRange(common.bucket_count(spark), "at", "kind").withColumn("range", F.spark_partition_id()), "url-events")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    opened = found.groupBy("range").agg(F.sum("step").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("open"))
    height = F.col("open") + F.sum("step").over(Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    stacked = found.join(F.broadcast(opened), "range").withColumn("height", height).filter(F.col("kind") != END)
    here = Window.partitionBy("range", "height").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("kind") == START, F.col("key"))
    tops = stacked.withColumn("near", F.last(start, ignorenulls=True).over(here)).filter((F.col("kind") == POINT) & (F.col("height") > 0))
    levels = stacked.groupBy("range", "height").agg(F.max_by(start, F.when(F.col("kind") == START, F.col("at"))).alias("last"))
    earlier = Window.partitionBy("height").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = levels.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).filter("height > 0").select("range", "height", "far")
    judged = tops.join(carried, ["range", "height"]).select("key", F.coalesce("near", "far").alias("top"))
    return points.select("key").join(judged, "key", "left")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path, or null) and verdict of every row."""
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    strict = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict")).alias("v"))
    strict = common.work_table(strict.select("host", "path", F.col("v.verdict").alias("verdict"), host_key(F.col("host")).alias("rule_host")), "url-rules")
    reach = strict.agg(F.coalesce(F.max(F.length("path")), F.lit(0))).first()[0]
    rule_hosts = strict.select("rule_host").distinct()
    # every rule host with those that hold it: the beginnings of its key that are rule hosts
    labels = F.split("inner", r"\.")
    starts = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    stacks = rule_hosts.select(F.col("rule_host").alias("inner")).select("inner", F.explode(F.array_distinct(F.array_append(starts, F.col("inner")))).alias("rule_host")).join(rule_hosts, "rule_host")

    dealt = urls.withColumns({"begins": F.substring("path", 1, reach), "place": F.pmod(F.xxhash64("page_id", "path"), F.lit(PLACES)).cast("int")})
    places = common.work_table(dealt.select("host", "begins", "place").distinct(), "url-places")
    sites = places.select("host", "begins").distinct()
    hosts = sites.select("host").distinct().withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    held = sweep(hosts.select("key"), rule_hosts.select(F.col("rule_host").alias("key"))).filter("top IS NOT NULL").join(hosts, "key").select("host", F.col("top").alias("inner"))
    probes = common.work_table(sites.join(held, "host").join(stacks, "inner").select("host", "begins", "rule_host"), "url-probes")
    key = F.concat("rule_host", F.lit("#"), "begins").alias("key")  # a host holds no #
    ruled = strict.select(F.concat("rule_host", F.lit("#"), "path").alias("top"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_n"), F.concat("host", "path").alias("rule"), "verdict").alias("best"))
    fits = sweep(probes.select(key).distinct(), ruled.select(F.col("top").alias("key"))).join(ruled, "top").select("key", "best")
    best = probes.select("host", "begins", key).join(fits, "key").groupBy("host", "begins").agg(F.max("best").alias("best"))
    answers = places.join(best, ["host", "begins"])
    out = dealt.join(answers, ["host", "begins", "place"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


ORACLE = f"""
WITH rules(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT n, rh || rp AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN f ON f.n = s.n AND k = 1
"""
