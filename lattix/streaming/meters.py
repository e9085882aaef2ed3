"""Streaming forms: the monthly spend meter, claims of tasks, and the ledger over a stream of commits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def spend_meter(episodes: DataFrame, cap: float) -> DataFrame:
    """(month, actor, n_episodes, spent, reached) whenever an actor's month changes; episodes have started, actor and cost_usd.

    The state of an actor's calendar month is its number of episodes and what they cost, in millionths. Once the cap is reached, the
    month's row is the last: episodes after it are counted no more, as the lane has stopped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, spent, stopped = state.get if state.exists else (0, 0, False)
        before = n
        for cost in pd.concat(list(frames)).sort_values(["started", "micros"], kind="stable")["micros"]:
            if stopped:
                break
            n, spent = n + 1, spent + int(cost)
            stopped = spent >= round(cap * 1_000_000)
        state.update((n, spent, stopped))
        if n > before:
            yield pd.DataFrame([(key[0], key[1], n, spent / 1_000_000, stopped)], columns=["month", "actor", "n_episodes", "spent", "reached"])

    own = episodes.select(F.date_format("started", "yyyy-MM").alias("month"), "actor", "started", F.coalesce(F.round(F.col("cost_usd").cast("decimal(28,6)") * 1_000_000), F.lit(0)).cast("long").alias("micros"))
    return own.groupBy("month", "actor").applyInPandasWithState(step, "month string, actor string, n_episodes long, spent double, reached boolean", "n long, spent long, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(first, past, user_id, n_events): runs of a user's events without a longer gap."""
    seen = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return seen.select(F.col("s.start").alias("first"), F.col("s.end").alias("past"), "user_id", "n_events")


def claims(stream: DataFrame) -> DataFrame:
    """(task, actor, granted) for each claim or release in a stream of (task, actor, action, seq); who claims first holds the task until they release it.

    The state of a task is its holder.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for actor, action in zip(rows["actor"], rows["action"], strict=True):
            if action == "claim":
                granted = holder in (None, actor)
                holder = actor if granted else holder
            else:
                granted = holder == actor
                holder = None if granted else holder
            out.append((key[0], actor, granted))
        state.update((holder,))
        yield pd.DataFrame(out, columns=["task", "actor", "granted"])

    return stream.groupBy("task").applyInPandasWithState(step, "task string, actor string, granted boolean", "holder string", "append", GroupStateTimeout.NoTimeout)


def ledger_stream(commits: DataFrame) -> DataFrame:
    """(ledger, seq, prev, hash) of a stream of (ledger, seq, body), chained as the batch ledger is; the state of a ledger is its head."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else "0" * 64
        out = []
        for seq, body in pd.concat(list(frames)).sort_values("seq")[["seq", "body"]].itertuples(index=False):
            prev, head = head, hashlib.sha256((head + body).encode()).hexdigest()
            out.append((key[0], seq, prev, head))
        state.update((head,))
        yield pd.DataFrame(out, columns=["ledger", "seq", "prev", "hash"])

    return commits.groupBy("ledger").applyInPandasWithState(step, "ledger string, seq long, prev string, hash string", "head string", "append", GroupStateTimeout.NoTimeout)
