"""Token bucket and concurrency cap per key, exact and in event-time order.

Both are folds: a row's fate depends on the rows before it. Keys below `hot_rows`
are folded in one sorted pass over their partition, with the state carried
from Arrow batch to Arrow batch. A hotter key is cut into slices of equal size that are
folded side by side, once the state at the start of each slice is known.

Token bucket. One token is `period_us` units and a microsecond refills
`tokens_per_period` units, so every step is exact in integers. The start states
come in two steps. A bucket that pays out fractions, and so never denies, has a state
that goes through a slice as `min(hi, max(lo, x + d))`; these triples compose. The
real bucket is ahead of it by less than one token, and that lead goes through a
slice as a monotone map of a circle of one token length (`_lead_map`), which
composes as well.

Concurrency cap. The state is the end times of at most `limit` running rows. Every slice of a hot key is folded side by
side, first as if nothing ran at its start, then from the end states that its predecessor reached, until all of those have
been tried: slices forget their start state, or have a few in turn. The true states are then read off from slice to slice
(`_with_states`). Only a key whose slices do not settle in TRIALS folds is folded on in one task from there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom.functions.skew import HOT_ROWS, PIECES_PER_LIMIT, Hot, hot_keys, join_slices, running_sliced, with_slices
from auditloom.functions.sizing import small_side
from auditloom.session import settle

NO_REFILL_RETRY = 60
#: End of an interval that is still running.
NEVER = 2**63 - 1
MICROS = 1_000_000


def bucket_units(tokens_per_period: int, period_us: int, burst: int) -> tuple[int, int, int]:
    """(units per token, capacity, refill per microsecond)."""
    return period_us, max(1, burst) * period_us, max(0, tokens_per_period)


def bucket_step(units: int, gap_us: int, token: int, cap: int, refill: int) -> tuple[bool, int, int]:
    """One request: (allowed, retry_after, units left)."""
    level = units + gap_us * refill if gap_us > 0 else units
    if level > cap:
        level = cap
    if level >= token:
        return True, 0, level - token
    if refill <= 0:
        return False, NO_REFILL_RETRY, level
    per_second = refill * MICROS
    return False, max(1, -(-(token - level) // per_second)), level


def rate_limit_label(
    df: DataFrame,
    key: str,
    ts: str,
    order: str,
    tokens_per_period: int = 30,
    period_us: int = 60 * MICROS,
    burst: int = 10,
    when: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Add `allowed` and `retry_after` (seconds) by a token bucket per key.

    `ts` is BIGINT microseconds and not null. Rows of a key are taken in order of
    (`ts`, `order`); a new key starts with a full bucket. With `when`, a BOOLEAN
    column, only rows where it is true meet the bucket; the others get nulls.
    `hot` is a ready answer of `functions.skew.hot_keys`. What passes between the slices of a hot key, one
    row for the clipped shift and a few for the lead map of each, goes through one task, streamed.
    """
    token, cap, refill = bucket_units(tokens_per_period, period_us, burst)
    hot = hot_keys(df, key, hot_rows) if hot is None else hot
    rows, any_hot = with_slices(df, key, [ts, order], hot)
    rows = rows.withColumn("_counts", _counts(when))
    if any_hot:
        meeting = rows.where("_hot AND _counts").select(key, "_slice", ts, order)
        starts = settle(_bucket_starts(meeting, key, ts, order, token, cap, refill))
        rows = join_slices(rows, small_side(starts), key)
    else:
        rows = rows.withColumns({"_units": F.lit(None).cast("long"), "_last": F.lit(None).cast("long")})
    out = T.StructType(
        [
            *df.schema.fields,
            T.StructField("allowed", T.BooleanType()),
            T.StructField("retry_after", T.IntegerType()),
        ]
    )
    kept = df.columns

    def fold(batches):
        group, units, last = None, cap, None
        for batch in batches:
            times, counts = batch.column(ts).to_pylist(), batch.column("_counts").to_pylist()
            allowed, retry = [None] * len(times), [None] * len(times)
            for k, piece, at, to in _runs(batch, key):
                if group != (k, piece):
                    group = (k, piece)
                    units, last = batch.column("_units")[at].as_py(), batch.column("_last")[at].as_py()
                    if units is None:
                        units, last = cap, times[at]
                for i in range(at, to):
                    if counts[i]:
                        now = times[i]
                        allowed[i], retry[i], units = bucket_step(units, now - last, token, cap, refill)
                        if now > last:
                            last = now
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(allowed, pa.bool_()), pa.array(retry, pa.int32())],
                names=[*kept, "allowed", "retry_after"],
            )

    return _sorted(rows.drop("_hot"), key, [ts, order]).mapInArrow(fold, out)


def _counts(when: str | None):
    return F.lit(True) if when is None else F.coalesce(F.col(when), F.lit(False))


def _sorted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.repartition(key, "_slice").sortWithinPartitions(key, "_slice", *order)


def _runs(batch, key: str):
    """(key, slice, from, to) of the runs of one group in a sorted batch."""
    if batch.num_rows == 0:
        return
    ks, ps = batch.column(key), batch.column("_slice")
    codes = ks.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    pieces = ps.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (pieces[1:] != pieces[:-1])) + 1
    for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield ks[at].as_py(), ps[at].as_py(), at, to


FLUSH_ROWS = 10_000


def _packed(rows, schema):
    arrays = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _per_group(batches, key, columns, begin, each, finish, schema):
    """Fold every (key, slice) of sorted batches to the rows `finish` lists for it."""
    group, state, done = None, None, []
    for batch in batches:
        values = list(zip(*[batch.column(c).to_pylist() for c in columns]))
        for k, piece, at, to in _runs(batch, key):
            if group != (k, piece):
                if group is not None:
                    done += [(*group, *row) for row in finish(state)]
                if len(done) >= FLUSH_ROWS:
                    yield _packed(done, schema)
                    done = []
                group, state = (k, piece), begin(values[at])
            state = each(state, values[at:to])
    if group is not None:
        done += [(*group, *row) for row in finish(state)]
    yield _packed(done, schema)


def _bucket_starts(hot, key, ts, order, token, cap, refill) -> DataFrame:
    """`(key, _slice, _units, _last)`: bucket level and time before each hot slice."""
    hot = hot.select(key, "_slice", ts, order)
    key_field = T.StructField(key, hot.schema[key].dataType)
    long = T.LongType()

    def table(*names_types):
        return T.StructType(
            [key_field, T.StructField("_slice", long)]
            + [T.StructField(n, t) for n, t in names_types]
        )

    # Step 1: the fractional bucket goes through each slice as a clipped shift.
    summary = table(("first", long), ("last", long), ("d", long), ("lo", long), ("hi", long))

    def shift_through(batches):
        def begin(row):
            return [row[0], row[0], 0, 0, cap]

        def each(state, group_rows):
            first, last, d, lo, hi = state
            for (at,) in group_rows:
                gain = max(0, at - last) * refill
                last = max(last, at)
                d = d + gain - token
                lo = max(0, min(cap, lo + gain) - token)
                hi = max(0, min(cap, hi + gain) - token)
            return [first, last, d, lo, hi]

        def finish(state):
            first, last, d, lo, hi = state
            # Beyond the capacity a shift changes nothing more.
            return [(first, last, max(-cap, min(cap, d)), lo, hi)]

        return _per_group(batches, key, [ts], begin, each, finish, to_arrow_schema(summary))

    shifts = _sorted(hot, key, [ts, order]).mapInArrow(shift_through, summary)

    def chain_shifts(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_slice")
        level, last, before, prior = cap, None, [], []
        for row in part.itertuples(index=False):
            first, end, d, lo, hi = row[2:]
            before.append(level)
            prior.append(first if last is None else last)
            gain = 0 if last is None else max(0, first - last) * refill
            level = min(hi, max(lo, min(cap, level + gain) + d))
            last = end if last is None else max(last, end)
        part = part[[key, "_slice"]].copy()
        part["_level"], part["_last"] = before, prior
        return part

    levels = settle(
        shifts.groupBy(key).applyInPandas(chain_shifts, table(("_level", long), ("_last", long)))
    )

    # Step 2: the real bucket's lead over the fractional one, for any lead at the
    # start, one row per piece of the map.
    leads = table(
        ("_level", long), ("_last", long), ("arc", long), ("value", long), ("slope", long)
    )

    def lead_through(batches):
        def begin(row):
            return row[1], row[2], _LeadMap(token, cap, refill, row[1], row[2])

        def each(state, group_rows):
            for at, _, _ in group_rows:
                state[2].add(at)
            return state

        def finish(state):
            level, last, lead_map = state
            return [(level, last, *piece) for piece in lead_map.pieces()]

        return _per_group(
            batches, key, [ts, "_level", "_last"], begin, each, finish, to_arrow_schema(leads)
        )

    with_levels = join_slices(hot, small_side(levels), key)
    maps = _sorted(with_levels, key, [ts, order]).mapInArrow(lead_through, leads)
    starts = table(("_units", long), ("_last", long))

    def chain_leads(batches):
        # A map can have a piece per row of one token interval, so the pieces are
        # streamed and only the one that holds the lead is kept.
        schema = to_arrow_schema(starts)
        names = (key, "_slice", "_level", "_last", "arc", "value", "slope")
        group, lead, held, final = None, 0, None, None
        for batch in batches:
            found = []
            for k, piece, level, last, *arc in zip(*[batch.column(n).to_pylist() for n in names]):
                if group != (k, piece):
                    if group is None or group[0] != k:
                        lead = 0
                    else:
                        # Leads before the first piece belong to the last one, around the circle.
                        lead = image_of(lead, held if held[0] <= lead else final, token)
                    group, held = (k, piece), None
                    found.append((k, piece, level + lead, last))
                if held is None or arc[0] <= lead:
                    held = arc
                final = arc
            yield _packed(found, schema)

    ordered = maps.repartition(key).sortWithinPartitions(key, "_slice", "arc")
    return ordered.mapInArrow(chain_leads, starts)


class _LeadMap:
    """How the lead of the real bucket, 0 <= lead < token, passes through a slice.

    The fractional bucket at level c pays min(level, token). Where it comes up
    short, the real one either pays a whole token or nothing, which turns the lead back by
    the shortfall on a circle of length `token`. Near the top the lead is cut to the
    room left. Turning and cutting keep the circular order, so the image is kept
    as pieces in that order: a piece is [low, length, origin, slope], covering
    `length` start leads from `origin` on, moved (slope 1) or merged (slope 0).
    """

    def __init__(self, token, cap, refill, level, last):
        self.token, self.cap, self.refill = token, cap, refill
        self.level, self.last = level, last
        self.turned = 0
        self.line = deque([[0, token, 0, 1]])

    def add(self, at):
        gain = max(0, at - self.last) * self.refill
        self.last = max(self.last, at)
        level = min(self.cap, self.level + gain)
        self.cut(self.cap - level)
        if level >= self.token:
            self.level = level - self.token
        else:
            self.turn(self.token - level)
            self.level = 0

    def cut(self, room):
        """Leads above `room` become `room`."""
        if room >= self.token - 1:
            return
        top = room + self.turned
        merged, origin = 0, None
        while self.line:
            low, length, start, slope = self.line[-1]
            if low > top:
                self.line.pop()
                merged, origin = merged + length, start
            elif slope and low + length - 1 > top:
                keep = top - low + 1
                self.line[-1][1] = keep
                merged, origin = merged + length - keep, (start + keep) % self.token
                break
            else:
                break
        if merged:
            self.line.append([top, merged, origin, 0])

    def turn(self, shortfall):
        """Leads below `shortfall` gain the rest of a token, the others lose it."""
        edge = shortfall + self.turned
        while self.line:
            low, length, start, slope = self.line[0]
            if low >= edge:
                break
            if slope and low + length > edge:
                moved = edge - low
                self.line[0] = [edge, length - moved, (start + moved) % self.token, 1]
                self._append([low + self.token, moved, start, 1])
                break
            self.line.popleft()
            self._append([low + self.token, length, start, slope])
        self.turned = edge

    def _append(self, piece):
        if self.line and piece[3]:
            low, length, start, slope = self.line[-1]
            if slope and low + length == piece[0] and (start + length) % self.token == piece[2]:
                self.line[-1][1] += piece[1]
                return
        self.line.append(piece)

    def pieces(self):
        """(origin, image of the origin, slope) by rising origin."""
        return sorted((start, low - self.turned, slope) for low, _, start, slope in self.line)


def image_of(lead: int, piece: tuple, token: int) -> int:
    """Image of a start lead that lies in `piece`."""
    origin, value, slope = piece
    return (value + slope * ((lead - origin) % token)) % token


def concurrency_admit(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    order: str,
    limit: int = 3,
    retry_after: int = 5,
    when: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Add `admitted` and `retry_after`: at most `limit` admitted rows of a key run at once.

    Rows are taken in order of (`start`, `order`), times are BIGINT microseconds. An
    interval that ends at a row's start has freed its slot; a rejected row holds none; a null end
    means still running. With `when`, a BOOLEAN column, only rows where it is true ask for a slot.
    `hot` is a ready answer of `functions.skew.hot_keys`.
    """
    limit = max(1, limit)
    hot = hot_keys(df, key, hot_rows) if hot is None else hot
    rows, any_hot = with_slices(df.withColumn("_counts", _counts(when)), key, [start, order], hot)
    if any_hot:
        rows = _with_states(rows, key, start, end, order, limit)
    else:
        rows = rows.withColumn("_state", F.lit(None).cast("array<bigint>"))
    out = T.StructType(
        [
            *df.schema.fields,
            T.StructField("admitted", T.BooleanType()),
            T.StructField("retry_after", T.IntegerType()),
        ]
    )
    kept = df.columns

    def fold(batches):
        group, running = None, []
        for batch in batches:
            begins, ends, counts = (batch.column(c).to_pylist() for c in (start, end, "_counts"))
            admitted = [False if c else None for c in counts]
            for k, piece, at, to in _runs(batch, key):
                if group != (k, piece):
                    group, running = (k, piece), batch.column("_state")[at].as_py() or []
                for i in take_slots(begins, ends, [i for i in range(at, to) if counts[i]], running, limit):
                    admitted[i] = True
            retry = [None if ok is None else 0 if ok else retry_after for ok in admitted]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(admitted, pa.bool_()), pa.array(retry, pa.int32())],
                names=[*kept, "admitted", "retry_after"],
            )

    return _sorted(rows.drop("_hot"), key, [start, order]).mapInArrow(fold, out)


def take_slots(begins: list, ends: list, asking: list[int], running: list, limit: int) -> list[int]:
    """The rows among `asking` that are admitted; `running`, a heap of end times, is brought up to date."""
    taken, n = [], 0
    while n < len(asking):
        i = asking[n]
        while running and running[0] <= begins[i]:
            heappop(running)
        if len(running) < limit:
            taken.append(i)
            heappush(running, NEVER if ends[i] is None else ends[i])
            n += 1
        else:
            # Every row before the first slot is free is rejected.
            n = bisect_left(asking, running[0], n + 1, key=begins.__getitem__)
    return taken


#: Rounds of folds of the slices that are not settled, at most.
TRIALS = 4


def _fold_slices(asks: DataFrame, key: str, start: str, end: str, order: str, limit: int) -> DataFrame:
    """Settled `key`, `_slice`, `_state`, `_end`: the end times that run on after a slice folded from `_state`."""
    out = T.StructType([asks.schema[key], *T.StructType.fromDDL("_slice bigint, _state array<bigint>, _end array<bigint>").fields])
    schema = to_arrow_schema(out)

    def fold(batches):
        group, first, running, done = None, [], [], []
        for batch in batches:
            begins, ends = batch.column(start).to_pylist(), batch.column(end).to_pylist()
            for k, piece, at, to in _runs(batch, key):
                if group != (k, piece):
                    if group is not None:
                        done.append((*group, first, sorted(running)))
                    first = batch.column("_state")[at].as_py()
                    group, running = (k, piece), sorted(first)
                take_slots(begins, ends, range(at, to), running, limit)
            if len(done) > FLUSH_ROWS:
                yield _packed(done, schema)
                done = []
        if group is not None:
            done.append((*group, first, sorted(running)))
        yield _packed(done, schema)

    return settle(_sorted(asks, key, [start, order]).mapInArrow(fold, out))


def _with_states(rows: DataFrame, key: str, start: str, end: str, order: str, limit: int) -> DataFrame:
    """Add `_state`, the end times that run at the start of the row's slice; `_slice` becomes that of the first slice of a piece.

    Rounds of trials: every slice from no running row, then from what a trial of the slice before it left running at its start, or from what still
    runs there of the last true state that is known, which meets rows that run on across many slices. A round folds a slice once. After each
    the true states are read off. A piece is one slice, or the slices from one without an answer to the next one in which the key idles, so that its
    end state is sure. Pieces of PIECES_PER_LIMIT slices, as many rows as a key may have without slices, are left at that; the
    slices of longer ones take part in the next round, up to TRIALS.
    """
    asks = settle(rows.where("_hot AND _counts").select(key, "_slice", start, end, order))
    along = Window.partitionBy(key).orderBy("_slice")
    until = F.coalesce(F.col(end), F.lit(NEVER))
    after_all = running_sliced(
        asks.withColumn("_hot", F.lit(True)), True, key, order=[F.col(start), F.col(order)], local=F.max(until),
        frame=(Window.unboundedPreceding, -1), total=F.max(until), carried=F.max("_total"), combine=F.greatest, out="_until",
    )
    idles = F.bool_or(F.coalesce(F.col(start) >= F.col("_until"), F.lit(True)))
    slices = after_all.groupBy(key, "_slice").agg(F.min(start).alias("_first"), idles.alias("_idles"))
    slices = settle(slices.withColumns({"_next": F.lead("_slice").over(along), "_next_first": F.lead("_first").over(along)}))
    todo, trials = slices.select(key, "_slice", F.array().cast("array<bigint>").alias("_state")), None
    for _ in range(TRIALS):
        folded = _fold_slices(join_slices(asks, todo, key).where("_state IS NOT NULL"), key, start, end, order, limit)
        trials = folded if trials is None else trials.unionByName(folded)
        pieces = _true_states(trials, slices, key)
        size = F.count(F.lit(1)).over(Window.partitionBy(key, "_piece"))
        long = pieces.where("NOT _sure").withColumn("_size", size).where(F.col("_size") > PIECES_PER_LIMIT).drop("_piece", "_size", "_sure")
        before = join_slices(folded, slices, key).where("_next IS NOT NULL")
        left = F.filter("_end", lambda e: e > F.col("_next_first"))
        handed_on = before.select(key, F.col("_next").alias("_slice"), left.alias("_state"), F.lit(0).alias("_from_true"))
        still = F.filter("_state", lambda e: e > F.col("_first"))
        known = join_slices(long, slices.select(key, "_slice", "_first"), key).select(key, "_slice", still.alias("_state"), F.lit(1).alias("_from_true"))
        starts = join_slices(handed_on, long.select(key, "_slice", F.lit(True).alias("_long")), key).where("_long").drop("_long").unionByName(known)
        pick = F.max(F.struct("_from_true", "_state"))["_state"].alias("_state")
        todo = settle(_untried(starts, trials, key).groupBy(key, "_slice").agg(pick))
        if not todo.limit(1).count():
            break
    hot = join_slices(rows.where("_hot"), pieces.drop("_sure"), key).withColumn("_slice", F.coalesce("_piece", "_slice")).drop("_piece")
    return rows.where("NOT _hot").withColumn("_state", F.lit(None).cast("array<bigint>")).unionByName(hot)


def _untried(starts: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    known = trials.select(F.col(key).alias("_known_key"), F.col("_slice").alias("_known_slice"), F.col("_state").alias("_known_state"))
    same = (
        F.col(key).eqNullSafe(F.col("_known_key")) & (F.col("_slice") == F.col("_known_slice")) & (F.col("_state") == F.col("_known_state"))
    )
    return starts.join(known, same, "left_anti")


def _true_states(trials: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """Settled `key`, `_slice`, `_piece`, `_state`, `_sure`: read off from slice to slice, one small row per slice and trial.

    `_sure` is false where a piece has no trial from its true start state, so that it may hold several slices.
    """
    out = T.StructType([slices.schema[key], *T.StructType.fromDDL("_slice bigint, _piece bigint, _state array<bigint>, _sure boolean").fields])
    schema = to_arrow_schema(out)

    def walk(table: pa.Table) -> pa.Table:
        ends, seen = {}, {}
        for r in table.to_pylist():
            ends[r["_slice"], tuple(r["_state"])] = r["_end"]
            seen[r["_slice"]] = (r["_first"], r["_idles"], r["_end"])
        found, state, piece, begin = [], (), None, ()
        for at in sorted(seen):
            first, idles, any_end = seen[at]
            if state is not None:
                state = tuple(e for e in state if e > first)
                piece, begin = at, state
                state = ends.get((at, state))
                sure = state is not None
            # Behind a moment without any row, the start state does not matter.
            state = any_end if state is None and idles else state
            found.append((table[key][0].as_py(), at, piece, list(begin), sure))
        return pa.Table.from_batches([_packed(found, schema)])

    tried = join_slices(trials, slices.select(key, "_slice", "_first", "_idles"), key)
    return settle(tried.groupBy(key).applyInArrow(walk, out))


def throttle_label(
    df: DataFrame,
    key: str,
    ts: str,
    end: str,
    order: str,
    tokens_per_period: int = 30,
    period_us: int = 60 * MICROS,
    burst: int = 10,
    limit: int = 3,
    slot_retry: int = 5,
    when: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """`rate_limit_label`, then `concurrency_admit` of the rows it allows, in one fold.

    Adds `rate_allowed`, `rate_retry_after`, `slot_admitted` and `slot_retry_after`. Both limits have the same
    key and order, so one shuffle serves both; only with hot keys the two run one after the other. All
    columns of `df` go through the fold: hand in a narrow table.
    """
    hot = hot_keys(df, key, hot_rows) if hot is None else hot
    names = {"allowed": "rate_allowed", "retry_after": "rate_retry_after"}
    if hot:
        limited = rate_limit_label(df, key, ts, order, tokens_per_period, period_us, burst, when, hot=hot)
        admitted = concurrency_admit(
            limited.withColumnsRenamed(names), key, ts, end, order, limit, slot_retry, "rate_allowed", hot=hot
        )
        return admitted.withColumnsRenamed({"admitted": "slot_admitted", "retry_after": "slot_retry_after"})
    token, cap, refill = bucket_units(tokens_per_period, period_us, burst)
    limit, kept = max(1, limit), df.columns
    added = {"rate_allowed": pa.bool_(), "rate_retry_after": pa.int32(), "slot_admitted": pa.bool_(), "slot_retry_after": pa.int32()}
    kinds = (T.BooleanType(), T.IntegerType()) * 2
    out = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])

    def fold(batches):
        group, units, last, running = None, cap, None, []
        for batch in batches:
            times, ends, counts = (batch.column(c).to_pylist() for c in (ts, end, "_counts"))
            allowed, wait = [None] * len(times), [None] * len(times)
            admitted, slot_wait = [None] * len(times), [None] * len(times)
            for k, piece, at, to in _runs(batch, key):
                if group != (k, piece):
                    group, units, last, running = (k, piece), cap, None, []
                asking = []
                for i in range(at, to):
                    if counts[i]:
                        now = times[i]
                        gap = 0 if last is None else now - last
                        allowed[i], wait[i], units = bucket_step(units, gap, token, cap, refill)
                        last = now if last is None or now > last else last
                        if allowed[i]:
                            asking.append(i)
                            admitted[i], slot_wait[i] = False, slot_retry
                for i in take_slots(times, ends, asking, running, limit):
                    admitted[i], slot_wait[i] = True, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(v, k) for v, k in zip((allowed, wait, admitted, slot_wait), added.values())],
                names=[*kept, *added],
            )

    rows, _ = with_slices(df.withColumn("_counts", _counts(when)), key, [ts, order], hot)
    return _sorted(rows.drop("_hot"), key, [ts, order]).mapInArrow(fold, out)
