"""Keyed state over time that built-in windows and joins can express.

Times are BIGINT microseconds. Every per-key window goes through slices of equal size
for keys above `hot_rows`; `hot` takes a ready answer of `functions.skew.hot_keys`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.skew import HOT_ROWS, Hot, running

FIRST, HERE = Window.unboundedPreceding, Window.currentRow


def concurrency_profile(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Active intervals [start, end) per key after each change point: `(key, t_us, active)`.

    Starts and ends at the same instant are netted, and combined before the shuffle. An
    interval with a null end is still running: it counts from its start on.
    """
    points = (
        df.select(
            key,
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("t_us"), F.lit(1).cast("long").alias("_d")),
                    F.struct(
                        F.when(F.col(end).isNotNull(), F.greatest(start, end)).alias("t_us"),
                        F.lit(-1).cast("long").alias("_d"),
                    ),
                )
            ).alias("_p"),
        )
        .select(key, "_p.*")
        .where(F.col("t_us").isNotNull())
        .groupBy(key, "t_us")
        .agg(F.sum("_d").alias("_delta"))
    )
    return running(
        points,
        key,
        ["t_us"],
        order=[F.col("t_us")],
        local=F.sum("_delta"),
        frame=(FIRST, HERE),
        total=F.sum("_delta"),
        carried=F.sum("_total"),
        combine=lambda local, carry: local + F.coalesce(carry, F.lit(0).cast("long")),
        out="active",
        hot_rows=hot_rows,
        hot=hot,
    ).drop("_delta")


def concurrency_peak(profile: DataFrame, key: str) -> DataFrame:
    """Highest concurrency per key and the first time it was reached."""
    return profile.groupBy(key).agg(
        F.max("active").alias("peak"),
        F.min_by("t_us", F.struct(-F.col("active"), F.col("t_us"))).alias("peak_us"),
    )


def deadline_absence(
    df: DataFrame,
    key: str,
    ts: str,
    is_arm: Column,
    is_confirm: Column,
    grace_us: int,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Every arm row with `due_us`, `confirm_us` and `outcome` (confirmed, rollback).

    An arm is confirmed by a confirm of its key in [arm, arm + grace], and each arm
    is judged on its own. The next confirm is a running minimum from the end of
    the key backwards, so there is no self join.
    """
    kept = df.withColumns({"_arm": is_arm, "_confirm": is_confirm}).where("_arm OR _confirm")
    confirm_ts = F.when(F.col("_confirm"), F.col(ts))
    looked = running(
        kept,
        key,
        [ts, "_confirm"],  # at the same instant confirms come after the arms they confirm
        order=[F.col(ts).desc(), F.col("_confirm").desc()],
        local=F.min(confirm_ts),
        frame=(FIRST, HERE),
        total=F.min(confirm_ts),
        carried=F.min("_total"),
        combine=F.coalesce,
        out="confirm_us",
        reverse=True,
        hot_rows=hot_rows,
        hot=hot,
    )
    due = F.col(ts) + F.lit(grace_us)
    in_time = F.coalesce(F.col("confirm_us") <= F.col("due_us"), F.lit(False))
    return (
        looked.where("_arm")
        .withColumn("due_us", due)
        .withColumns(
            {
                "outcome": F.when(in_time, F.lit("confirmed")).otherwise(F.lit("rollback")),
                "confirm_us": F.when(in_time, F.col("confirm_us")),
            }
        )
        .drop("_arm", "_confirm")
    )


def orphan_sweep(
    starts: DataFrame, ends: DataFrame, name: str, prefix: str | None = None
) -> DataFrame:
    """Started items without an end. `prefix` limits the sweep to its own names.

    Ends are reduced to distinct names before the join.
    """
    mine = starts if prefix is None else starts.where(F.col(name).startswith(prefix))
    done = ends if prefix is None else ends.where(F.col(name).startswith(prefix))
    return mine.join(done.select(name).distinct(), name, "left_anti")


def orphan_pairs(left: DataFrame, right: DataFrame, name: str, sides: tuple[str, str]) -> DataFrame:
    """Names present on one side only, with the side they are missing from."""
    marked = left.select(name, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(name, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    missing = F.when(F.col("_l") == 0, F.lit(sides[0])).otherwise(F.lit(sides[1]))
    return (
        marked.groupBy(name)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .where(F.col("_l") + F.col("_r") < 2)
        .select(name, missing.alias("missing_from"))
    )


def early_retry(
    df: DataFrame,
    key: str,
    ts: str,
    order: str,
    allowed: str = "allowed",
    retry_after: str = "retry_after",
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Add `denied_us`, `wait_left_us` and `early`: sent before the key's previous
    denial had run out of its retry_after."""
    denial = F.when(
        ~F.col(allowed), F.struct(F.col(ts).alias("at"), F.col(retry_after).alias("wait"))
    )
    sequence = F.struct(ts, order)
    looked = running(
        df,
        key,
        [ts, order],
        order=[F.col(ts), F.col(order)],
        local=F.last(denial, ignorenulls=True),
        frame=(FIRST, -1),
        total=F.max_by(denial, F.when(~F.col(allowed), sequence)),
        carried=F.last("_total", ignorenulls=True),
        combine=lambda local, carry: F.coalesce(local, carry),
        out="_denial",
        hot_rows=hot_rows,
        hot=hot,
    )
    until = F.col("_denial.at") + F.col("_denial.wait") * F.lit(1_000_000).cast("long")
    left = F.greatest(until - F.col(ts), F.lit(0).cast("long"))
    return looked.withColumns(
        {
            "denied_us": F.col("_denial.at"),
            "wait_left_us": F.coalesce(left, F.lit(0).cast("long")),
        }
    ).withColumn("early", F.col("wait_left_us") > 0).drop("_denial")
