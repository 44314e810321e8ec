"""Structured Streaming counterparts of the stateful mechanisms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Sliding-window admission: only admitted hits count against the limit."""
    out, held = [], list(held)
    for t in times:
        held = [h for h in held if t - h < window]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def rate_limit(events: DataFrame, key: str, ts: str, event: str, limit: int, seconds: float) -> DataFrame:
    """Batch form: (key, event, admitted) in time order of each key; a key's hits are sequential by meaning."""
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_t", event])
        return pd.DataFrame({key: rows[key], event: rows[event], "admitted": admit(rows["_t"].tolist(), [], limit, seconds)[0]})

    x = events.select(key, event, F.col(ts).cast("timestamp").cast("double").alias("_t"))
    return x.groupBy(key).applyInPandas(one, f"`{key}` {types[key]}, `{event}` {types[event]}, admitted boolean")


def rate_limit_stream(events: DataFrame, key: str, ts: str, event: str, limit: int, seconds: float) -> DataFrame:
    """Streaming form: the admitted hits of the last window are the state; it times out when the window has passed."""
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def one(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_t", event])
        ok, held = admit(rows["_t"].tolist(), held, limit, seconds)
        state.update((held,))
        state.setTimeoutDuration(int(seconds * 1000) + 1)
        yield pd.DataFrame({key: rows[key], event: rows[event], "admitted": ok})

    x = events.select(key, event, F.col(ts).cast("timestamp").cast("double").alias("_t"))
    return x.groupBy(key).applyInPandasWithState(one, f"`{key}` {types[key]}, `{event}` {types[event]}, admitted boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(events: DataFrame, keys: list[str], ts: str, within: str = "7 days") -> DataFrame:
    """Idempotent append: each key once within the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def flag_overlay(flags: DataFrame, ledger: DataFrame) -> DataFrame:
    """Running count of flags a slot over a static ledger (claim_id, slot)."""
    return flags.join(ledger.select("claim_id", "slot"), "claim_id").groupBy("slot").agg(F.count("*").alias("n_flags"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Tumbling counts with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
