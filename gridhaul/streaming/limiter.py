"""The request limiter as a stateful stream: a caller's counters by day, dropped when the day is over.

Within a micro-batch a caller's requests are sorted by seq in the shuffle's group and walked in that order. Across micro-batches
order is that of arrival; a request that arrives late is charged to its own day until the watermark passes the end of that day, the short
window counts from the latest one seen. Later requests are refused as "late", with nothing used: every request gets a decision. A caller's days that
are over go when the caller comes again, so the state is one row a caller. (Timeouts by event time would drop late requests before they are seen,
those by the clock keep a stream over finished input running for ever.)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "seq long, ip long, now long, elements long, ok boolean, blocked_by string, sec_used long, day_used long"
STATE = "days string"  # JSON: day to short window, its use, the day's use


def limited(requests: DataFrame, per_second: int, per_day: int, second: int = 1, late: str = "1 day") -> DataFrame:
    """Decisions on a stream of requests (seq, ip, now in seconds, elements); late is how far the watermark lies behind the latest request."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = state.getCurrentWatermarkMs() // 86_400_000  # days before this one are over
        days = {int(d): c for d, c in json.loads(state.get[0]).items() if int(d) >= gone} if state.exists else {}
        rows = sorted(r for b in batches for r in zip(b["seq"].tolist(), b["now"].tolist(), b["elements"].tolist(), strict=True))
        out = []
        for seq, now, elements in rows:
            if now // 86_400 < gone:
                out.append((seq, int(key[0]), now, elements, False, "late", 0, 0))
                continue
            sec, sec_used, day_used = days.get(now // 86_400, (-1, 0, 0))
            if now // second != sec:
                sec, sec_used = now // second, 0
            blocked = "sec" if 0 < per_second <= sec_used else "day" if 0 < per_day <= day_used else None
            out.append((seq, int(key[0]), now, elements, blocked is None, blocked, sec_used, day_used))
            days[now // 86_400] = (sec, sec_used + 1, day_used + elements) if blocked is None else (sec, sec_used, day_used)
        if days:
            state.update((json.dumps(days),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    timed = requests.withColumn("at", F.timestamp_seconds("now")).withWatermark("at", late)
    return timed.groupBy("ip").applyInPandasWithState(decide, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
