"""Ordered folds per key, the same over a table and over a stream: count windows, anchored rate limits, debounce, dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_limit(times: list[int], limit: int, width: int, start: int = -1, used: int = 0) -> tuple[list[bool], int, int]:
    """Which calls, in order of time, are allowed: a window starts at the first call after the last one ended.

    Denied calls count too. Returns the window's start and use as well, to go on from.
    """
    allowed = []
    for t in times:
        if start < 0 or t >= start + width:
            start, used = t, 0
        used += 1
        allowed.append(used <= limit)
    return allowed, start, used


def debounced(times: list[int], forced: list[bool], gap: int, last: int = -1) -> tuple[list[bool], int]:
    """Which changes pass: forced ones, and those at least gap after the last that passed."""
    passed = []
    for t, f in zip(times, forced, strict=True):
        ok = f or last < 0 or t - last >= gap
        last = t if ok else last
        passed.append(ok)
    return passed, last


def _sorted(batches: Iterator[pd.DataFrame], key: str, fold) -> Iterator[pd.DataFrame]:
    """Calls fold(state, rows) for the runs of one key in sorted batches; a key may reach over batches."""
    now, state = None, None
    for pdf in batches:
        cuts = [0, *(pdf.index[(pdf[key] != pdf[key].shift())][1:] - pdf.index[0]), len(pdf)] if len(pdf) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[a:b]
            if part[key].iloc[0] != now:
                now, state = part[key].iloc[0], None
            state, out = fold(state, part)
            yield out


def rate_limited(calls: DataFrame, key: str, id_col: str, time: str, limit: int, width: int, partitions: int) -> DataFrame:
    """(key, id, allowed) of calls; time in microseconds. One key is a stream of rows, never held whole."""

    def fold(state, part):
        allowed, start, used = anchored_limit(part[time].tolist(), limit, width, *(state or (-1, 0)))
        return (start, used), pd.DataFrame({key: part[key], id_col: part[id_col], "allowed": allowed})

    rows = calls.select(key, id_col, time).repartition(partitions, key).sortWithinPartitions(key, time, id_col)
    return rows.mapInPandas(lambda b: _sorted(b, key, fold), f"{key} long, {id_col} long, allowed boolean")


def debounce(changes: DataFrame, key: str, id_col: str, time: str, forced: str, gap: int, partitions: int) -> DataFrame:
    def fold(state, part):
        passed, last = debounced(part[time].tolist(), part[forced].tolist(), gap, -1 if state is None else state)
        return last, pd.DataFrame({key: part[key], id_col: part[id_col], "passed": passed})

    rows = changes.select(key, id_col, time, forced).repartition(partitions, key).sortWithinPartitions(key, time, id_col)
    return rows.mapInPandas(lambda b: _sorted(b, key, fold), f"{key} long, {id_col} long, passed boolean")


def stream_rate_limited(calls: DataFrame, key: str, id_col: str, time: str, limit: int, width: int) -> DataFrame:
    """rate_limited over a stream: the state of a key is its window's start and use."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        pdf = pd.concat(list(batches)).sort_values([time, id_col])
        allowed, start, used = anchored_limit(pdf[time].tolist(), limit, width, *(state.get if state.exists else (-1, 0)))
        state.update((start, used))
        yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "allowed": allowed})

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} long, {id_col} long, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def stream_deduplicated(records: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Replays of deterministic ids within the delay are dropped."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def count_windows(turns: DataFrame, key: str, position: str, size: int) -> DataFrame:
    """Full windows of size turns each, by position from 0: (key, window, first, last, n)."""
    rows = turns.withColumn("window", F.floor(F.col(position) / size))
    found = rows.groupBy(key, "window").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    return found.filter(F.col("n") == size)
