"""Streaming twins of the keyed operators: admission, key-value state, exactly-once
queues and decayed rates, with state per key.

Each works on micro-batches of one key's rows, sorted by their order column, and
continues from the state that the batch before left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _all(frames: Iterator[pd.DataFrame], order: str | list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def _admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, out = state.get if state.exists else (-1, False)
    rows, status = _all(frames, "arrival"), []
    for idx in rows["idx"]:
        fits = last < 0 or idx <= last + 1
        status.append("accepted" if fits else "dropped" if out else "resend")
        last, out = (int(idx), False) if fits else (last, True)
    state.update((last, out))
    yield pd.DataFrame({"uid": key[0], "arrival": rows["arrival"], "idx": rows["idx"], "status": status})


def admission(wal: DataFrame) -> DataFrame:
    """``uid, arrival, idx, status`` of a stream of ``uid, arrival long, idx long``."""
    return wal.groupBy("uid").applyInPandasWithState(
        _admit, "uid long, arrival long, idx long, status string", "last long, out boolean", "append", GroupStateTimeout.NoTimeout
    )


def _kv(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, pointer = state.get if state.exists else (-1, -1)
    for row in _all(frames, "idx").itertuples():
        if row.idx > seen:
            seen, pointer = int(row.idx), int(row.idx) if row.op == "put" else -1
    state.update((seen, pointer))
    yield pd.DataFrame({"key": [key[0]], "seen": [seen], "idx": [pointer if pointer >= 0 else None]})


def kv_state(commands: DataFrame) -> DataFrame:
    """``key, seen, idx`` updates: the pointer after the last command seen, null after a delete."""
    return commands.groupBy("key").applyInPandasWithState(
        _kv, "key long, seen long, idx long", "seen long, pointer long", "update", GroupStateTimeout.NoTimeout
    )


def _enqueue(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    following, pending = state.get if state.exists else (1, [])
    held, out = dict(p.split(":", 1) for p in pending), []
    held = {int(k): int(v) for k, v in held.items()}
    for row in _all(frames, "arrival").itertuples():
        if row.seqno >= following and row.seqno not in held:
            held[int(row.seqno)] = int(row.arrival)
        while following in held:
            out.append((key[0], following, held.pop(following), int(row.arrival)))
            following += 1
    state.update((following, [f"{k}:{v}" for k, v in sorted(held.items())]))
    yield pd.DataFrame(out, columns=["producer", "seqno", "arrival", "enqueued_at"])


def exactly_once(deliveries: DataFrame) -> DataFrame:
    """Messages in producer order: duplicates go, early ones wait for what is missing."""
    return deliveries.groupBy("producer").applyInPandasWithState(
        _enqueue, "producer long, seqno long, arrival long, enqueued_at long", "following long, pending array<string>", "append", GroupStateTimeout.NoTimeout
    )


def leaky_rate(events: DataFrame, tau_ms: float) -> DataFrame:
    """``key, value, rate`` updates of a leaky integrator (``key, idx, t double ms, amount``)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v = state.get if state.exists else (None, 0.0)
        for row in _all(frames, "idx").itertuples():
            if t is not None and row.t > t:
                v *= math.exp((t - row.t) / tau_ms)
            t = row.t if t is None else max(t, row.t)
            v += row.amount
        state.update((t, v))
        yield pd.DataFrame({"key": [key[0]], "value": [v], "rate": [v / tau_ms * 1000]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, value double, rate double", "t double, v double", "update", GroupStateTimeout.NoTimeout)


def debounce(events: DataFrame, seconds: int) -> DataFrame:
    """Rows of ``key, idx, ts`` more than ``seconds`` after the last one let through (the
    rate limit of resends), as :func:`tideline.operators.logops.debounce` gives them for rows
    that arrive in order. A key's state stays, as only event time decides."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, keep = _all(frames, ["ts", "idx"]), []
        for us in rows["ts"].astype("datetime64[us]").astype("int64"):
            keep.append(last is None or us > last + seconds * 1_000_000)
            last = int(us) if keep[-1] else last
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "idx": rows["idx"][keep], "ts": rows["ts"][keep]})

    return events.groupBy("key").applyInPandasWithState(
        step, "key long, idx long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout
    )


def per_second(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Operations a second over event time, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("ops")).select(F.col("window.start").alias("second"), "ops")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A consumer's sessions: one that stays silent for ``gap`` is taken to be down."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("key", s).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("up"), F.col("session_window.end").alias("down"), "n")
