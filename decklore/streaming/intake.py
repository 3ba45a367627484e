"""Question intake: rate limit, duplicates, bursts, queue order, sessions. Each rule has a batch form, which the streams are
tested against, and a streaming form on event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from decklore.functions.text import one_space

RATE_SECONDS, WAIT_SECONDS, QUEUE_SIZE, BURST_SECONDS = 30, 90, 20, 2
ACCEPTED = "user_id long, event_id long, ts timestamp"


def _accept(rows: pd.DataFrame, last: float, seconds: float) -> tuple[pd.DataFrame, float]:
    rows = rows.sort_values(["ts", "event_id"])
    keep = []
    for t in rows["ts"].astype("int64").to_numpy() / 1e9 if rows["ts"].dtype == "datetime64[ns]" else [x.timestamp() for x in rows["ts"]]:
        ok = t - last >= seconds
        keep.append(ok)
        last = t if ok else last
    return rows[keep], last


def rate_limited(events: DataFrame, seconds: float = RATE_SECONDS) -> DataFrame:
    """events(user_id, event_id, ts): at most one each ``seconds`` of a user; the others are dropped. A user is a group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _accept(rows, float("-inf"), seconds)[0][["user_id", "event_id", "ts"]]

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(run, ACCEPTED)


def rate_limited_stream(events: DataFrame, seconds: float = RATE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The same over a stream; a user's state is the time of the last accepted event and ends with its silence."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        frame = pd.concat(list(frames))
        kept, last = _accept(frame, last, seconds)
        state.update((float(last),))
        state.setTimeoutTimestamp(max(int(last * 1000 + seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield kept[["user_id", "event_id", "ts"]]

    source = events.select("user_id", "event_id", "ts").withWatermark("ts", delay)
    return source.groupBy("user_id").applyInPandasWithState(
        run, ACCEPTED, "last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def duplicate_counts(questions: DataFrame, text: str) -> DataFrame:
    """Questions with equal text, case and spaces aside: text_norm, dup_count, first_id."""
    norm = F.lower(one_space(F.col(text)))
    return questions.groupBy(norm.alias("text_norm")).agg(F.count(F.lit(1)).alias("dup_count"), F.min("id").alias("first_id"))


def distinct_stream(questions: DataFrame, delay: str = "90 seconds") -> DataFrame:
    """The first of equal texts within the delay."""
    return questions.withWatermark("ts", delay).withColumn("text_norm", F.lower(one_space(F.col("text")))).dropDuplicatesWithinWatermark(["text_norm"])


def bursts(events: DataFrame, keys: list[str], seconds: float = BURST_SECONDS) -> DataFrame:
    """Events of a key less than ``seconds`` apart as one: keys, first_ts, last_id, n. The last event wins."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    marked = events.withColumn("start", F.coalesce((gap >= seconds).cast("int"), F.lit(1)))
    marked = marked.withColumn("burst", F.sum("start").over(w))
    return marked.groupBy(*keys, "burst").agg(
        F.min("ts").alias("first_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count(F.lit(1)).alias("n")
    )


def bursts_stream(events: DataFrame, keys: list[str], seconds: int = BURST_SECONDS, delay: str = "10 seconds") -> DataFrame:
    window = F.session_window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", delay).groupBy(*keys, window).agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count(F.lit(1)).alias("n")
    )


def priority(dup_count: Column, age_seconds: Column, on_page: Column, w: tuple[float, float, float] = (1.0, 0.1, 5.0)) -> Column:
    return dup_count * w[0] + age_seconds * w[1] + F.when(on_page, w[2]).otherwise(0.0)


def queue(waiting: DataFrame, part: list[str], size: int = QUEUE_SIZE) -> DataFrame:
    """waiting(part, id, arrived, score): of each queue the ``size`` newest stay; they are served by score, then arrival."""
    newest = Window.partitionBy(*part).orderBy(F.desc("arrived"), F.desc("id"))
    served = Window.partitionBy(*part).orderBy(F.desc("score"), "arrived", "id")
    kept = waiting.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= size).drop("r")
    return kept.withColumn("pos", F.row_number().over(served))


#: Questions that wait while a page is read; with more than these one is answered at once, at the sentence's end.
MOST_WAITING, STACK_DEPTH = 3, 2
# What a robot in a state does with what arrives.
INTERRUPTS = [
    ("presenting", "navigate", "interrupt"),
    ("presenting", "question", "wait_for_page"),
    ("presenting", "meta", "apply"),
    ("answering", "question", "queue"),
    ("answering", "navigate", "interrupt"),
    ("answering", "meta", "queue"),
    ("navigating", "navigate", "wait_for_ack"),
    ("navigating", "question", "wait_for_ack"),
    ("navigating", "meta", "wait_for_ack"),
    ("paused", "navigate", "handle"),
    ("paused", "question", "handle"),
    ("paused", "meta", "handle"),
    ("escalated", "navigate", "queue"),
    ("escalated", "question", "queue"),
    ("escalated", "meta", "queue"),
]


def interrupts(arrivals: DataFrame) -> DataFrame:
    """arrivals(state, event, waiting) with what is done: a question waits for the page's end unless too many wait already.
    What no rule names is queued."""
    rules = arrivals.sparkSession.createDataFrame(INTERRUPTS, "state string, event string, rule string")
    many = (F.col("rule") == "wait_for_page") & (F.col("waiting") > MOST_WAITING)
    action = F.when(many, "interrupt").otherwise(F.coalesce("rule", F.lit("queue")))
    return arrivals.join(F.broadcast(rules), ["state", "event"], "left").withColumn("action", action).drop("rule")


def overdue(waiting: DataFrame, now: Column, seconds: float = WAIT_SECONDS) -> DataFrame:
    """waiting(id, arrived) with whether it has waited so long that its sender is told and it goes first."""
    age = now.cast("timestamp").cast("double") - F.col("arrived").cast("timestamp").cast("double")
    return waiting.withColumn("overdue", age > seconds)


def resume_stack(moves: DataFrame, depth: int = STACK_DEPTH) -> DataFrame:
    """moves(session, turn, state, page): the pages to come back to after each session's moves. A page is pushed only when
    navigation leaves a page that is being presented; the first page and the latest ones stay."""
    left = F.sort_array(F.collect_list(F.when(F.col("state") == "presenting", F.struct("turn", "page"))))
    pages = F.transform(left, lambda x: x["page"])
    kept = F.when(F.size(pages) <= depth, pages).otherwise(F.concat(F.slice(pages, 1, 1), F.slice(pages, F.size(pages) - depth + 2, depth - 1)))
    return moves.groupBy("session").agg(kept.alias("stack"))


def session_pages(turns: DataFrame, n_pages: int) -> DataFrame:
    """turns(conv_id, turn, move): the page after each turn, from page 1 on: moves add up, within 1..n_pages. A session is
    folded in order."""
    order = F.sort_array(F.collect_list(F.struct("turn", "move")))
    step = lambda s, t: F.struct(F.least(F.greatest(s["page"] + t["move"], F.lit(1)), F.lit(n_pages)).alias("page"))
    told = turns.groupBy("conv_id").agg(order.alias("all"))
    return told.select("conv_id", F.aggregate("all", F.struct(F.lit(1).alias("page")), step)["page"].alias("last_page"), F.size("all").alias("n_turns"))
