"""Runs of a condition over a stream of values, with one small state per cell.

Values of a cell arrive in order of time across batches; within a batch any
order will do. A run is given out when a later step has ended it, or when its
cell has been silent for the time-out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_events(rows: DataFrame, cells: Sequence[str], min_duration: int = 1, timeout_ms: int | None = None) -> DataFrame:
    """Closed runs of a stream with the columns ``cells``, ``time`` (step) and ``holds``.

    With ``timeout_ms``, a cell that has been silent for so long has its open run given out.
    """
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cells)

    def frame(key: tuple, found: list[tuple[int, int]]) -> pd.DataFrame:
        kept = [(t, n) for t, n in found if n >= min_duration]
        data = {c: [k] * len(kept) for c, k in zip(cells, key, strict=True)}
        return pd.DataFrame({"time": [t for t, _ in kept], **data, "event_duration": [n for _, n in kept]})

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, length = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield frame(key, [(start, length)] if length else [])
            return
        found: list[tuple[int, int]] = []
        for t, holds in sorted((int(t), bool(h)) for b in batches for t, h in zip(b["time"], b["holds"].fillna(False), strict=True)):
            if length and (not holds or t != start + length):
                found.append((start, length))
                length = 0
            if holds:
                start, length = (start, length + 1) if length else (t, 1)
        state.update((start, length))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield frame(key, found)

    return rows.groupBy(*cells).applyInPandasWithState(
        run, f"time bigint, {keys}, event_duration bigint", "start bigint, length bigint", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
