"""Request limits: a tier blocks once its use has reached the limit; admitted requests are charged in full.

Since charges are never negative and a tier that has reached its limit stays blocked for the rest of its window,
the sequential rule is three windows: requests of a second, elements of a day over those that pass, elements of
a day over all callers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decisions(requests: DataFrame, per_second: int, per_day: int, second: int = 1) -> DataFrame:
    """requests (seq, ip, now in seconds, elements) with ok, blocked_by, sec_used and day_used before the request.

    second is the length of the short window. A limit of 0 or less removes its tier.
    """
    r = requests.withColumns({"sec": F.floor(F.col("now") / second), "day": F.floor(F.col("now") / 86400)})
    in_sec = Window.partitionBy("ip", "day", "sec").orderBy("seq")
    r = r.withColumn("n", F.row_number().over(in_sec))
    passes = F.lit(True) if per_second <= 0 else F.col("n") <= per_second
    before = Window.partitionBy("ip", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("day_used", F.coalesce(F.sum(F.when(passes, F.col("elements")).otherwise(0)).over(before), F.lit(0)))
    day_ok = F.lit(True) if per_day <= 0 else F.col("day_used") < per_day
    ok = passes & day_ok
    # what the sequence charged to the day: sums stop growing once the limit is reached
    r = r.withColumn("ok", ok)
    charged = F.coalesce(F.sum(F.when(F.col("ok"), F.col("elements")).otherwise(0)).over(before), F.lit(0))
    sec_used = F.coalesce(F.sum(F.col("ok").cast("int")).over(in_sec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumns({"day_used": charged, "sec_used": sec_used})
    sec_full = F.lit(False) if per_second <= 0 else F.col("sec_used") >= per_second
    blocked = F.when(F.col("ok"), None).when(sec_full, "sec").otherwise("day")
    return r.select("seq", "ip", "now", "elements", "ok", blocked.alias("blocked_by"), "sec_used", "day_used")


def global_cap(admitted: DataFrame, per_day: int, before: DataFrame | None = None) -> DataFrame:
    """The cap over all callers, after their own limits: running sums by day, in two levels. before (day, total): what days have used already.

    A day is cut into minutes; sums before each minute come from one row a minute, sums inside it from a
    window of the minute, so no task holds a day's requests.
    """
    a = admitted.filter("ok").withColumns({"day": F.floor(F.col("now") / 86400), "minute": F.floor(F.col("now") / 60)})
    minutes = a.groupBy("day", "minute").agg(F.sum("elements").alias("n"))
    earlier = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select("day", "minute", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("day", "minute").orderBy("now", "seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("base") + F.coalesce(F.sum("elements").over(inside), F.lit(0))
    out = a.join(minutes, ["day", "minute"]).withColumn("used", used)
    if before is not None:
        out = out.join(before, "day", "left").withColumn("used", F.col("used") + F.coalesce("total", F.lit(0)))
    ok = F.lit(True) if per_day <= 0 else F.col("used") < per_day
    return out.select("seq", "day", "elements", ok.alias("ok"), F.when(ok, F.col("used")).otherwise(F.greatest(F.lit(per_day), F.least("used", F.lit(per_day)))).alias("used"))


def headers(found: DataFrame, per_second: int, per_day: int) -> DataFrame:
    """seq with what is left of each tier after the request, and the tighter tier (the short one on ties)."""
    sec = F.greatest(F.lit(0), per_second - F.col("sec_used") - F.col("ok").cast("int"))
    day = F.greatest(F.lit(0), per_day - F.col("day_used") - F.when(F.col("ok"), F.col("elements")).otherwise(0))
    reset = 86400 - F.col("now") % 86400
    tight = sec <= day
    return found.select("seq", sec.alias("remaining_second"), day.alias("remaining_day"), reset.alias("reset_day"), F.when(tight, per_second).otherwise(per_day).alias("limit"), F.least(sec, day).alias("remaining"), F.when(tight, 1).otherwise(reset).alias("reset"))
