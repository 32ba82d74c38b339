"""Limits, lockouts and caches over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limits(requests: DataFrame, most: int = 10, period: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Windows of each user in which the limit is passed, as they close. Rows later than
    ``late`` are dropped by the watermark."""
    w = F.window("ts", period, slide) if slide else F.window("ts", period)
    g = requests.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "user_id", "n", (F.col("n") > most).alias("limited"))


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions, ended by a gap without requests."""
    g = requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def lockouts(attempts: DataFrame, most: int = 5, lock_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """``(key, ts, refused)`` of each login attempt of ``key, ts, ok``.

    The first failure opens a window; from ``most`` failures on, attempts within ``lock_s``
    seconds of it are refused; a success clears it. State is two numbers a key and goes
    when the watermark passes the window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, since = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            t = int(ts.timestamp() * 1000)
            if fails and t - since > lock_s * 1000:
                fails = 0
            refused = fails >= most
            if not refused:
                fails, since = (0, 0) if ok else (fails + 1, since if fails else t)
            out.append(refused)
        state.update((fails, since))
        if fails:
            state.setTimeoutTimestamp(max(since + lock_s * 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "refused": out})

    rows = attempts.withWatermark("ts", late).select("key", "ts", "ok")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, refused boolean", "fails long, since long", "append", GroupStateTimeout.EventTimeTimeout)


def cache(requests: DataFrame, ttl: int = 3600, late: str = "10 minutes") -> DataFrame:
    """``(key, ts, hit)`` of each request of ``key, ts``: whether the key was set at most
    ``ttl`` seconds ago. A hit doesn't renew it; state goes with the watermark. The number
    of keys isn't bounded, as evicting the least used needs an order over all keys.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts in rows["ts"]:
            t = int(ts.timestamp() * 1000)
            hit = at is not None and t - at <= ttl * 1000
            at = at if hit else t
            out.append(hit)
        state.update((at,))
        state.setTimeoutTimestamp(max(at + ttl * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "hit": out})

    rows = requests.withWatermark("ts", late).select("key", "ts")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, hit boolean", "at long", "append", GroupStateTimeout.EventTimeTimeout)
