"""Content-hash synchronisation of a stored table with a newly arrived one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridhaul.functions import geo
from gridhaul.functions.constants import CHURN, ID_BLOCK, KEY_RATIO, ROWS_PER_STATEMENT, SHRINK
from gridhaul.functions.text import row_key
from gridhaul.operators.numbering import numbered

KEY = ("normalized", "lat", "lon", "tier")
PREFIX = 12  # letters of the text that one piece of a state shares when new rows are numbered


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", row_key(*(F.col(c) for c in KEY)))


def inserts(mirror: DataFrame, arrived: DataFrame, base: int = ID_BLOCK) -> DataFrame:
    """The first arrived row of every key that the mirror lacks, with new ids by key within the state."""
    fresh = arrived.groupBy("state", "key").agg(F.min_by(F.struct(*KEY), "id").alias("row")).join(mirror.select("state", "key").distinct(), ["state", "key"], "left_anti")
    fresh = numbered(fresh.select("state", "key", "row.*"), ["state"], F.substring("normalized", 1, PREFIX), list(KEY))
    return fresh.select("state", "key", *KEY, (F.lit(base) + F.col("rank")).alias("id"))


def deletes(mirror: DataFrame, arrived: DataFrame) -> DataFrame:
    """All ids of keys that are gone, and of keys that stay all but the least id."""
    ranked = mirror.withColumn("_n", F.row_number().over(Window.partitionBy("state", "key").orderBy("id")))
    marked = ranked.join(arrived.select("state", "key").distinct().withColumn("stays", F.lit(True)), ["state", "key"], "left")
    return marked.filter(F.col("stays").isNull() | (F.col("_n") > 1)).select("state", "id", "key", F.when(F.col("stays").isNull(), "gone").otherwise("duplicate").alias("reason"))


def apply(mirror: DataFrame, ins: DataFrame, dels: DataFrame) -> DataFrame:
    """The mirror after a plan; replaying it changes nothing."""
    columns = ["state", "id", "key", *KEY]
    kept = mirror.join(dels.select("state", "id"), ["state", "id"], "left_anti")
    new = ins.join(kept.select("state", "id"), ["state", "id"], "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))


def pages(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """The next page of rows by id: ids above the cursor, in order; the greatest id of a page is the next cursor, so a
    stopped export goes on where it was."""
    return rows.filter(F.col("id") > after).orderBy("id").limit(limit)


def resumed(mirror: DataFrame, ins: DataFrame, dels: DataFrame) -> DataFrame:
    """What is left of a plan that was cut off: state, inserts not yet stored, deletes still there."""
    todo = ins.join(mirror.select("state", "id"), ["state", "id"], "left_anti").groupBy("state").agg(F.count(F.lit(1)).alias("ins"))
    gone = dels.join(mirror.select("state", "id"), ["state", "id"], "left_semi").groupBy("state").agg(F.count(F.lit(1)).alias("del_ids"))
    return todo.join(gone, "state", "full_outer").fillna(0, ["ins", "del_ids"])


def plan(mirror: DataFrame, arrived: DataFrame, previous: DataFrame, ins_cost: int = 2, del_cost: int = 2) -> DataFrame:
    """A row a state: rows, inserts, deletes, churn, share of previous keys that the mirror has, forecast and gates."""
    count = F.count(F.lit(1))
    have = mirror.groupBy("state").agg(count.alias("rows_mirror"), F.max("id").alias("max_id"))
    new = inserts(mirror, arrived).groupBy("state").agg(count.alias("ins"))
    gone = deletes(mirror, arrived).groupBy("state").agg(count.alias("del_ids"))
    seen = previous.select("state", "key").distinct().join(mirror.select("state", "key").distinct().withColumn("hit", F.lit(1.0)), ["state", "key"], "left")
    ratio = seen.groupBy("state").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("key_ratio"))
    out = have
    for part in (new, gone, ratio):
        out = out.join(part, "state", "left")
    out = out.fillna(0, ["ins", "del_ids"])
    statements = F.ceil(F.col("ins") / ROWS_PER_STATEMENT) + F.ceil(F.col("del_ids") / ROWS_PER_STATEMENT)
    out = out.withColumns({"churn": (F.col("ins") + F.col("del_ids")) / F.col("rows_mirror"), "loss": (F.col("del_ids") - F.col("ins")) / F.col("rows_mirror"), "forecast": F.col("ins") * ins_cost + F.col("del_ids") * del_cost + statements})
    problems = [
        F.when(F.col("loss") > SHRINK, "shrink"), F.when(F.col("key_ratio") < KEY_RATIO, "key ratio"), F.when(F.col("key_ratio").isNull(), "no previous version"),
        F.when(F.col("churn") >= CHURN, "churn"), F.when(F.col("max_id") >= ID_BLOCK, "id block"),
    ]
    return out.withColumn("problems", F.concat_ws(", ", *problems))


def schedule(plans: DataFrame) -> DataFrame:
    """Plans by ascending forecast with the running total; a row a state, so one task sorts them."""
    order = Window.orderBy("forecast", "state")
    return plans.withColumn("cumulative", F.sum("forecast").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def jitter(ins: DataFrame, gone: DataFrame) -> DataFrame:
    """state, bucket, n: how far inserted rows moved from the nearest deleted row of the same text."""
    g = gone.select("state", "normalized", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    near = ins.join(g, ["state", "normalized"]).groupBy("state", "id").agg(F.min(geo.haversine(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))).alias("d"))
    bucket = F.when(F.col("d") < 1, "lt_1m").when(F.col("d") < 10, "1_10m").otherwise("gt_10m")
    return near.groupBy("state", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
