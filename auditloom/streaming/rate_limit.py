"""Token bucket per key on a stream."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from auditloom.operators.admission import MICROS, bucket_step, bucket_units
from auditloom.streaming.groups import GROUP, NO_KEY, GroupState, group_of


class _Buckets(StatefulProcessor):
    """The buckets of a group of keys: {key: (units, time of the last row)}."""

    def __init__(self, key, ts, sort_by, token, cap, refill):
        self.key, self.ts, self.sort_by = key, ts, sort_by
        self.token, self.cap, self.refill = token, cap, refill

    def init(self, handle) -> None:
        self.state = GroupState(handle, "buckets")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The rows of one group in one micro-batch; its size is set by the trigger.
        part = pd.concat(list(rows), ignore_index=True).sort_values(self.sort_by)
        buckets = self.state.load() or {}
        keys = [None] * len(part) if key[0] == NO_KEY else part[self.key].tolist()
        allowed, retry = [], []
        for name, at in zip(keys, part[self.ts].tolist()):
            units, last = buckets.get(name) or (self.cap, at)
            # A row behind the last one is taken at the last one's time.
            ok, wait, units = bucket_step(units, at - last, self.token, self.cap, self.refill)
            buckets[name] = units, max(last, at)
            allowed.append(ok)
            retry.append(wait)
        timer = None
        if self.refill > 0:
            # From then on a bucket is full, which is the state of a new key.
            now = timerValues.getCurrentWatermarkInMs()
            buckets = {name: held for name, held in buckets.items() if self._full(held[1]) > now}
            timer = max((self._full(last) for _, last in buckets.values()), default=None)
        self.state.save(buckets or None, timer)
        yield part.assign(allowed=allowed, retry_after=pd.Series(retry, index=part.index, dtype="int32"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer of the last bucket that fills up.
        self.state.expired()
        self.state.save(None, None)
        return iter(())

    def close(self) -> None:
        pass

    def _full(self, last):
        return (last + -(-self.cap // self.refill)) // 1000 + 1


def rate_limit_stream(
    df: DataFrame,
    key: str,
    ts: str,
    order: str,
    tokens_per_period: int = 30,
    period_us: int = 60 * MICROS,
    burst: int = 10,
    delay: str = "0 seconds",
) -> DataFrame:
    """Streaming twin of `rate_limit_label`: every row comes out with its label.

    `ts` is BIGINT microseconds; `delay` is how far rows may be out of order. A key that
    stayed idle until its bucket is full again loses its state, without any effect on results.
    Needs the RocksDB state store. Keys are worked on by group (`group_of`), a call for each group and batch.
    """
    token, cap, refill = bucket_units(tokens_per_period, period_us, burst)
    # Pandas makes floats of integers with nulls among them, so nulls go by a mark of their own.
    marks = {f.name: f"null_of_{f.name}" for f in df.schema.fields if isinstance(f.dataType, T.LongType) and f.name not in (key, ts)}
    marked = df.withColumns({m: F.col(c).isNull() for c, m in marks.items()} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in marks})
    out = T.StructType(
        [
            *marked.schema.fields,
            T.StructField("allowed", T.BooleanType()),
            T.StructField("retry_after", T.IntegerType()),
        ]
    )
    timed = marked.withColumn("event_time", F.timestamp_micros(ts)).withWatermark("event_time", delay)
    sort_by = [ts, *([marks[order]] if order in marks else []), order]
    labelled = timed.withColumn(GROUP, group_of(key)).groupBy(GROUP).transformWithStateInPandas(
        statefulProcessor=_Buckets(key, ts, sort_by, token, cap, refill),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
    )
    columns = [F.when(~F.col(marks[c]), F.col(c)).alias(c) if c in marks else F.col(c) for c in df.columns]
    return labelled.select(*columns, "allowed", "retry_after")
