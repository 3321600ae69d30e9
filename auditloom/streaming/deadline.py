"""Absence of a confirm within the grace time, on a stream."""

from __future__ import annotations

from bisect import bisect_left
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from auditloom.streaming.groups import GROUP, NO_KEY, GroupState, group_of


class _Deadlines(StatefulProcessor):
    """The open arms and the confirms of a group of keys: {key: {(time, id)}} and {key: {time}}."""

    def __init__(self, key_name, id_name, ts, grace_us):
        self.key_name, self.id_name, self.ts, self.grace_us = key_name, id_name, ts, grace_us

    def init(self, handle) -> None:
        self.state = GroupState(handle, "deadlines")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        arms, confirms = self.state.load() or ({}, {})
        names = [None] * len(part) if key[0] == NO_KEY else part[self.key_name].tolist()
        marks = [part[c].tolist() for c in (self.ts, self.id_name, "no_id", "is_arm", "is_confirm")]
        for name, at, arm_id, no_id, is_arm, is_confirm in zip(names, *marks):
            if is_arm:
                arms.setdefault(name, set()).add((at, None if no_id else arm_id))
            if is_confirm:
                confirms.setdefault(name, set()).add(at)
        done = []
        for name in set(names) & arms.keys() & confirms.keys():
            ordered = sorted(confirms[name])
            for at, arm_id in list(arms[name]):
                n = bisect_left(ordered, at)
                if n < len(ordered) and ordered[n] <= at + self.grace_us:
                    done.append((name, arm_id, at, ordered[n]))
                    arms[name].remove((at, arm_id))
        # An arm that is still to come is not older than the watermark.
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        self._save(arms, {name: {at for at in ats if at >= horizon} for name, ats in confirms.items()})
        if done:
            yield self._rows(done, "confirmed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arms, confirms = self.state.load()
        self.state.expired()
        # The timer is that of the first arm; all that are due by now come out with it.
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        late = [(name, arm_id, at, None) for name, held in arms.items() for at, arm_id in held if self._timer(at) <= limit]
        for name, arm_id, at, _ in late:
            arms[name].remove((at, arm_id))
        self._save(arms, confirms)
        if late:
            yield self._rows(late, "rollback")

    def close(self) -> None:
        pass

    def _timer(self, at):
        # One millisecond past the deadline: a confirm at the deadline itself counts.
        return (at + self.grace_us) // 1000 + 1

    def _save(self, arms, confirms):
        arms, confirms = ({name: held for name, held in part.items() if held} for part in (arms, confirms))
        first = min((at for held in arms.values() for at, _ in held), default=None)
        self.state.save((arms, confirms) if arms or confirms else None, None if first is None else self._timer(first))

    def _rows(self, done, outcome):
        return pd.DataFrame(
            {
                self.id_name: pd.array([i for _, i, _, _ in done], dtype="Int64"),
                self.key_name: [name for name, _, _, _ in done],
                "due_us": [at + self.grace_us for _, _, at, _ in done],
                "confirm_us": pd.array([c for _, _, _, c in done], dtype="Int64"),
                "outcome": [outcome] * len(done),
            }
        )


def deadline_stream(
    df: DataFrame,
    key: str,
    row_id: str,
    ts: str,
    is_arm: Column,
    is_confirm: Column,
    grace_us: int,
    delay: str = "0 seconds",
) -> DataFrame:
    """Streaming twin of `deadline_absence`.

    A confirmed arm comes out with the confirm, an unconfirmed one once the watermark
    has passed its deadline. `row_id` and `ts` are BIGINT. Needs the RocksDB state store. Keys are worked on by
    group (`group_of`), a call for each group and batch.
    """
    kept = (
        df.withColumns({"is_arm": F.coalesce(is_arm, F.lit(False)), "is_confirm": F.coalesce(is_confirm, F.lit(False))})
        .where("is_arm OR is_confirm")
        .select(
            key, F.coalesce(row_id, F.lit(0).cast("long")).alias(row_id), F.col(row_id).isNull().alias("no_id"), ts, "is_arm", "is_confirm",
            group_of(key).alias(GROUP),
        )
        .withColumn("event_time", F.timestamp_micros(ts))
        .withWatermark("event_time", delay)
    )
    out = T.StructType(
        [
            T.StructField(row_id, T.LongType()),
            T.StructField(key, df.schema[key].dataType),
            T.StructField("due_us", T.LongType()),
            T.StructField("confirm_us", T.LongType()),
            T.StructField("outcome", T.StringType()),
        ]
    )
    return kept.groupBy(GROUP).transformWithStateInPandas(
        statefulProcessor=_Deadlines(key, row_id, ts, grace_us),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
    )
