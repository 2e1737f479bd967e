"""Operators over streams: windows, sessions, lag correction and keyed state in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrected(stream: DataFrame, lag_sec: float = 4.5, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event times less the display lag, with the watermark on the corrected time."""
    return stream.withColumn(time, F.col(time) - F.make_dt_interval(secs=F.lit(lag_sec))).withWatermark(time, late)


def tumbling(stream: DataFrame, by: list[Column], aggregates: list[Column], width: str = "60 seconds", time: str = "ts") -> DataFrame:
    return stream.groupBy(F.window(time, width), *by).agg(*aggregates)


def sliding(stream: DataFrame, by: list[Column], aggregates: list[Column], width: str, slide: str, time: str = "ts") -> DataFrame:
    return stream.groupBy(F.window(time, width, slide), *by).agg(*aggregates)


def sessions(stream: DataFrame, by: list[Column], aggregates: list[Column], gap: float, length: Column | None = None, time: str = "ts") -> DataFrame:
    """Islands of rows that lie at most gap seconds apart; length (seconds) keeps a row open for so long."""
    open_for = (length if length is not None else F.lit(0.0)) + gap
    return stream.groupBy(F.session_window(time, F.concat(open_for.cast("decimal(18,3)").cast("string"), F.lit(" seconds"))), *by).agg(*aggregates)


def thinned(stream: DataFrame, gap_sec: float, key: str = "program_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, ts) of rows at least gap after the row kept before them, with the last kept time as state.

    A key's rows are put in order within a micro-batch; a row older than the last kept one is dropped.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for pdf in batches for x in pdf[time]):
            at = t.timestamp()
            if last is None or at - last >= gap_sec:
                kept.append(t)
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})

    from pyspark.sql.streaming.state import GroupStateTimeout

    source = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time)).withWatermark(time, late)
    return source.groupBy(key).applyInPandasWithState(run, f"{key} string, {time} timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def without_repeats(stream: DataFrame, key: str = "program_id", time: str = "ts", text: str = "text", late: str = "10 minutes") -> DataFrame:
    """Rows whose text differs from the row before them in their key, with the last text as state."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(time, kind="stable")
        keep = []
        for value in pdf[text]:
            fresh = bool(value and value.strip()) and value != last
            keep.append(fresh)
            last = value if fresh else last
        state.update((last,))
        yield pdf[keep][[key, time, text]]

    from pyspark.sql.streaming.state import GroupStateTimeout

    source = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), text).withWatermark(time, late)
    return source.groupBy(key).applyInPandasWithState(run, f"{key} string, {time} timestamp, {text} string", "last string", "append", GroupStateTimeout.NoTimeout)


def strongest(stream: DataFrame, gap_sec: float, inclusive: bool = True, key: str = "program_id", time: str = "ts", rank: str = "rank", late: str = "10 minutes") -> DataFrame:
    """(key, ts, rank) of the rows that folds.keep_strongest() keeps, with the last kept row as state.

    That row is given once a row beyond the gap has come, or once the watermark says that none within it can come any more.
    A key's rows are put in order within a micro-batch.
    """
    gap = round(gap_sec * 1_000_000)

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out, last = [], tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append(last)
            state.remove()
        else:
            for t, r in sorted(((x.value // 1000, int(y)) for pdf in batches for x, y in zip(pdf[time], pdf[rank])), key=lambda row: row[0]):
                near = last is not None and t - last[0] < gap + inclusive
                if near and r <= last[1]:
                    continue
                if last is not None and not near:
                    out.append(last)
                last = (t, r)
            state.update(last)
            state.setTimeoutTimestamp(max((last[0] + gap) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(out), time: pd.to_datetime([t for t, _ in out], unit="us"), rank: [r for _, r in out]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    source = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), F.col(rank).cast("long").alias(rank)).withWatermark(time, late)
    return source.groupBy(key).applyInPandasWithState(run, f"{key} string, {time} timestamp, {rank} long", "t long, r long", "append", GroupStateTimeout.EventTimeTimeout)


def packed(stream: DataFrame, target: int, size: str = "tokens", key: str = "program_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, ts, size, batch) of every row, in batches as from folds.pack(), with the open batch and its room as state."""

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, room = state.get if state.exists else (-1, 0)
        pdf, numbers = pd.concat(list(batches)).sort_values(time, kind="stable"), []
        for n in pdf[size]:
            if batch < 0 or n > room:
                batch, room = batch + 1, target
            room -= int(n)
            numbers.append(batch)
        state.update((batch, room))
        yield pdf[[key, time, size]].assign(batch=numbers)

    from pyspark.sql.streaming.state import GroupStateTimeout

    source = stream.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), F.col(size).cast("long").alias(size)).withWatermark(time, late)
    return source.groupBy(key).applyInPandasWithState(run, f"{key} string, {time} timestamp, {size} long, batch long", "batch long, room long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what the source holds into Parquet; a second call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
