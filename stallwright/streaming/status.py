"""Streaming variants: status changes of listings, deduplicated events, windowed counts.

Rows without a listing are heartbeats: they move the watermark on and come out nowhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "history_id bigint, listing bigint, old_status string, status string"


def status_changes(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """An entry where the status of a listing differs from the one before; the first entry has no old status.

    Entries wait in the state until the watermark has passed them and then are taken in the order of `recorded` and
    history_id, so the order in which they arrive doesn't matter as long as none is later than `late`. The state is
    the last status taken and the entries that wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heartbeat = pd.isna(key[0])
        last, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        for rows in batches if not state.hasTimedOut else ():
            waiting += [] if heartbeat else [[int(r.recorded.value), int(r.history_id), r.status] for r in rows.itertuples()]
        passed, out = state.getCurrentWatermarkMs(), []
        waiting.sort()
        ready = [x for x in waiting if x[0] // 1_000_000 < passed]
        for _, entry, status in ready:
            if last is None or status != last[0]:
                out.append((entry, key[0], None if last is None else last[0], status))
            last = [status]
        waiting = waiting[len(ready) :]
        if not heartbeat:
            state.update((json.dumps([last, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1_000_000, passed + 1))
        yield pd.DataFrame(out, columns=["history_id", "listing", "old_status", "status"])

    rows = stream.withWatermark("recorded", late).select("listing", "recorded", "history_id", "status")
    return rows.groupBy("listing").applyInPandasWithState(step, CHANGES, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(stream: DataFrame, key: str = "history_id", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("recorded", late).dropDuplicatesWithinWatermark([key]).where("listing IS NOT NULL")


def counts_by_window(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Entries for each status and window, emitted when the watermark has passed."""
    w = stream.withWatermark("recorded", late).groupBy(F.window("recorded", width), "status").agg(F.count("listing").alias("n"))
    return w.select(F.col("window.start").alias("start"), "status", "n").where("n > 0")
