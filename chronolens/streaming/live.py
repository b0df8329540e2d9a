"""Live media: the commit frontier, feeds since a time, utterances as a stateful stream, rolling budgets.

The frontier is data, the time below which all coarse stages have committed; it
is not a streaming watermark, which drops late rows. Watermarks are used only to
bound state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import cut_step

COARSE = ("sample", "shot_boundary", "vad_stream", "asr", "ocr")


def frontier(stages: DataFrame, coarse: tuple[str, ...] = COARSE) -> DataFrame:
    """Per video the time up to which every coarse stage has worked (video_id, stage, last_t), and where any has got to."""
    c = F.col("stage").isin(*coarse)
    return stages.groupBy("video_id").agg(F.min(F.when(c, F.col("last_t"))).alias("watermark"), F.max("last_t").alias("stopped_at"))


def stage_clock(items: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per video and stage the latest time handled; a tick moves stages that have none left to the head (video_id, head)."""
    done = items.groupBy("video_id", "stage").agg(F.max("t").alias("last_t"))
    return done.join(ticks, "video_id", "left").select("video_id", "stage", F.greatest("last_t", "head").alias("last_t"))


def lag(clock: DataFrame, heads: DataFrame) -> DataFrame:
    """Per video the head, the frontier and each stage's lag."""
    own = clock.join(heads, "video_id")
    return own.groupBy("video_id", "head").agg(F.min("last_t").alias("watermark"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.col("head") - F.col("last_t"))))).alias("lag_by_stage"))


def live_id(key: Column, started: Column) -> Column:
    """Names a live recording by its key and the second it began, so that attaching again finds it."""
    return F.sha2(F.concat(F.lit("live:"), key, F.lit(":"), F.date_format(started, "yyyy-MM-dd'T'HH:mm:ssXXX")), 256)


def within_budget(spend: DataFrame, by: list[str], t: str, cost: str, cap: float, hour: int = 3600) -> DataFrame:
    """Rows with what the hour before them cost, and whether a call is allowed; a stage opens again as spending leaves the window."""
    from ..operators.windows import trailing_sum

    return trailing_sum(spend, by, t, cost, hour).withColumn("allowed", F.col("trailing") <= cap)


_STATE = "t0 double, t1 double, n long"


def utterance(open_: tuple | None, t: float, most: float, gap: float) -> tuple[tuple, tuple | None]:
    """(open utterance, closed one) after a sound at ``t``: a pause over ``gap`` or a length over ``most`` closes."""
    if open_ is None:
        return (t, t, 1), None
    t0, t1, n = open_
    if t - t1 > gap or t - t0 > most:
        return (t, t, 1), open_
    return (t0, t, n + 1), None


def utterances_of(times: list[float], most: float = 15.0, gap: float = 3.0) -> list[tuple]:
    open_, out = None, []
    for t in times:
        open_, closed = utterance(open_, t, most, gap)
        if closed:
            out.append(closed)
    return out + ([open_] if open_ else [])


def shot_step(state: tuple, t: float, d: float) -> tuple[tuple, tuple | None]:
    """(open shot, closed one) after a frame at ``t`` that differs by ``d`` from the one before.

    The open shot is (number, start, latest time, recent distances, frames since its cut); its number is its stable name.
    """
    number, t0, _, recent, since = state
    cut, recent, since = cut_step(recent, since, d)
    return ((number + 1, t, t, recent, since), (number, t0, t)) if cut else ((number, t0, t, recent, since), None)


def shots_by_tick(times: list[float], distances: list[float], tick: float) -> list[tuple[int, float, float, bool, float]]:
    """(number, start, end, closed, at): a closed shot once, the open one at each tick of stream time and at the end."""
    out: list[tuple[int, float, float, bool, float]] = []
    state, due = None, None
    for t, d in zip(times, distances):
        if state is None:
            state, due = (0, t, t, [d], 1), t + tick
            continue
        while t >= due:
            out.append((state[0], state[1], state[2], False, due))
            due += tick
        state, closed = shot_step(state, t, d)
        if closed:
            out.append((*closed, True, t))
    if state:
        out.append((state[0], state[1], state[2], False, times[-1]))
    return out


def latest_shots(upserts: DataFrame, by: list[str]) -> DataFrame:
    """The shots that a feed of upserts comes to: a closed one is final, else the last written counts."""
    return upserts.groupBy(*by, "number").agg(F.max_by(F.struct("t0", "t1", "closed"), F.struct("closed", "at")).alias("s")).select(*by, "number", "s.*")


def shots(stream: DataFrame, key: str = "video_id", t: str = "t", d: str = "d", ts: str = "ts", tick: float = 5.0) -> DataFrame:
    """Shots of a stream of frames (key, t, distance, event time) as upserts (key, number, t0, t1, closed, at): closed ones once, the open one a tick.

    Rows of a key must come in order of time over batches.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = state.get if state.exists else None
        open_, due = ((held[0], held[1], held[2], list(held[3]), held[4]), held[5]) if held else (None, 0.0)
        if state.hasTimedOut:
            out.append((k[0], open_[0], open_[1], open_[2], False, open_[2]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(t)
            for x, dist in zip(rows[t].astype(float), rows[d].astype(float)):
                if open_ is None:
                    open_, due = (0, x, x, [dist], 1), x + tick
                    continue
                while x >= due:
                    out.append((k[0], open_[0], open_[1], open_[2], False, due))
                    due += tick
                open_, closed = shot_step(open_, x, dist)
                if closed:
                    out.append((k[0], *closed, True, x))
            state.update((*open_, due))
            state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000 + tick * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "number", "t0", "t1", "closed", "at"])

    kept = "number long, t0 double, t1 double"
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {kept}, closed boolean, at double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, f"{kept}, recent array<double>, since long, due double", "append", GroupStateTimeout.EventTimeTimeout)


def anchored(rows: DataFrame, by: list[str], order: list[str], t: str, gap: float) -> DataFrame:
    """``rows`` with the clock anchored anew after each gap: session, since (seconds after its anchor), flush (the last row before a gap, or of all)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False))
    rows = rows.withColumn("session", F.sum(new.cast("long")).over(w)).withColumn("flush", F.coalesce(F.lead(t).over(w) - F.col(t) > gap, F.lit(True)))
    return rows.withColumn("since", F.col(t) - F.min(t).over(Window.partitionBy(*by, "session")))


def utterances(stream: DataFrame, key: str = "user_id", t: str = "t", ts: str = "ts", most: float = 15.0, gap: float = 3.0) -> DataFrame:
    """Utterances of a stream of sounds (key, t, event time): closed ones are emitted once; the last when event time passes its gap.

    Rows of a key must come in order of time over batches, as recordings do.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        open_ = state.get if state.exists else None
        if state.hasTimedOut:
            if open_:
                out.append((k[0], *open_))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(t)
            for x in rows[t]:
                open_, closed = utterance(open_, float(x), most, gap)
                if closed:
                    out.append((k[0], *closed))
            if open_:
                state.update(tuple(open_))
                at = int(rows[ts].max().timestamp() * 1000 + gap * 1000)
                state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "t0", "t1", "n"])

    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {_STATE}"
    return stream.groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def follow(rows: DataFrame, seen: DataFrame, since: DataFrame) -> DataFrame:
    """Rows (video_id, id, t0, t1) after each video's ``since``, without those already handed on."""
    new = rows.join(since, "video_id").where(F.col("t1") > F.col("since")).drop("since")
    return new.join(seen.select("id"), "id", "left_anti")
