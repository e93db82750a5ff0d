"""Volumes of a stream with late pushes: accepted until the volume is physically sealed, after that they open a new one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 24 * 3600 * 1000
MAINTAIN_ROWS, MAINTAIN_IDLE_S = 200, 60


def late_volumes(stream: DataFrame, key: str, ts: str, watermark: str = "1 hour") -> DataFrame:
    """(key, volume_no, event, at, n): 'push' per batch and key, 'sealed' when the watermark passes the last activity by a day.

    Unlike a session window, a push that comes after the idle time but before the seal resets the clock of its volume.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last, n = state.get if state.exists else (1, 0, 0)
        if state.hasTimedOut:
            yield pd.DataFrame({key: [who[0]], "volume_no": [number], "event": ["sealed"], "at": [pd.Timestamp(last, unit="ms")], "n": [n]})
            state.update((number + 1, 0, 0))
            return
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf[ts].max().timestamp() * 1000))
        state.update((number, last, n))
        state.setTimeoutTimestamp(max(last + IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [who[0]], "volume_no": [number], "event": ["push"], "at": [pd.Timestamp(last, unit="ms")], "n": [n]})

    return stream.withWatermark(ts, watermark).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, volume_no int, event string, at timestamp, n long", "volume_no int, last long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def maintenance_due(dirty_rows: int, idle_seconds: float) -> bool:
    """Compaction of an index runs when enough rows are dirty and nothing was written for a while."""
    return dirty_rows >= MAINTAIN_ROWS and idle_seconds >= MAINTAIN_IDLE_S
