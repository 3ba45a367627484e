"""Sessions: the page that a user is on, kept as state of a stream of moves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, page int, mode string, stopped boolean"


def step(page: int, mode: str, stopped: bool, action: str, value: int | None, n_pages: int) -> tuple[int, str, bool]:
    """A session's next state. Once search by vectors has failed, the rest of the session searches by words."""
    if stopped:
        return page, mode, True
    if action == "goto" and value is not None and 1 <= value <= n_pages:
        return value, mode, False
    if action == "next":
        return min(page + 1, n_pages), mode, False
    if action == "prev":
        return max(page - 1, 1), mode, False
    if action == "embed_failed":
        return page, "sparse", False
    return page, mode, action == "stop"


def sessions_stream(turns: DataFrame, n_pages: int) -> DataFrame:
    """turns(conv_id, turn, ts, action, value), a stream, to OUT: the state after each turn. A session ends after a day."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        page, mode, stopped = state.get if state.exists else (1, "hybrid", False)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["ts", "turn"]).itertuples():
            value = None if pd.isna(r.value) else int(r.value)
            page, mode, stopped = step(page, mode, stopped, r.action, value, n_pages)
            rows.append((key[0], r.turn, page, mode, stopped))
        state.update((page, mode, stopped))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "page", "mode", "stopped"])

    source = turns.withWatermark("ts", "1 hour").groupBy("conv_id")
    return source.applyInPandasWithState(run, OUT, "page int, mode string, stopped boolean", "append", GroupStateTimeout.EventTimeTimeout)


def acknowledged(commands: DataFrame, acks: DataFrame, within: str = "1 second") -> DataFrame:
    """commands(cmd_id, ts), acks(cmd_id, ack_ts), streams or tables: commands that were acknowledged in time; later
    acknowledgements match nothing."""
    from pyspark.sql import functions as F

    c = commands.withWatermark("ts", "10 seconds").alias("c")
    a = acks.withWatermark("ack_ts", "10 seconds").select(F.col("cmd_id").alias("ack_id"), "ack_ts").alias("a")
    on = F.expr(f"c.cmd_id = a.ack_id AND a.ack_ts >= c.ts AND a.ack_ts <= c.ts + INTERVAL {within}")
    return c.join(a, on).select("cmd_id", "ts", "ack_ts")
