"""Limits as streams over several micro-batches."""

from gridhaul.operators import limits
from gridhaul.sources.files import landing
from gridhaul.streaming.global_cap import capped
from gridhaul.streaming.limiter import limited

REQUEST, DAY = "seq long, ip long, now long, elements long", 86_400


def source(spark, batches):
    path = landing(spark, "requests")
    for rows in batches:
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_requests_get_decisions(spark):
    """A late request is charged to its own day while that lasts, refused as late afterwards; the day after next goes on undisturbed."""
    batches = [[(1, 7, 100, 5), (2, 8, 200, 1)], [(3, 7, DAY + 50, 1)], [(4, 7, 300, 6), (5, 7, 4 * DAY, 1)], [(6, 7, 400, 1), (7, 9, 500, 1), (8, 7, 4 * DAY + 9, 2)], [(9, 7, 4 * DAY + 20, 1), (10, 8, 600, 1)]]
    out, state = landing(spark, "out"), landing(spark, "state")
    limited(source(spark, batches), 0, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = {r.seq: (r.ok, r.blocked_by, r.day_used) for r in spark.read.parquet(out).collect()}
    assert found == {1: (True, None, 0), 2: (True, None, 0), 3: (True, None, 0), 4: (True, None, 5), 5: (True, None, 0), 6: (False, "late", 0), 7: (False, "late", 0), 8: (True, None, 1), 9: (True, None, 3), 10: (False, "late", 0)}


def test_cap_over_batches_equals_one_table(spark):
    """The cap over four micro-batches decides as over one table; a batch that runs again leaves one copy of its rows."""
    rows = [(k, k % 3, k * 7000, 1 + k % 5) for k in range(60)]
    out, totals, state = (landing(spark, x) for x in ("out", "totals", "state"))
    write, calls = capped(25, out, totals), []

    def twice(batch, number):
        calls.append(number)
        write(batch, number)
        write(batch, number)

    decided = limited(source(spark, [rows[:10], rows[10:11], rows[11:40], rows[40:]]), 0, 0)
    decided.writeStream.foreachBatch(twice).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    want = limits.global_cap(limits.decisions(spark.createDataFrame(rows, REQUEST), 0, 0), 25)
    keys = ["seq", "day", "elements", "ok", "used"]
    assert len(calls) >= 4 and sorted(map(tuple, spark.read.parquet(out).select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))
    assert not all(r.ok for r in want.collect())
