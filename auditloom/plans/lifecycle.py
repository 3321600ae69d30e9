"""A request log from validation to status, as one DataFrame job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.sizing import small_table
from auditloom.functions.skew import HOT_ROWS, Hot, hot_keys
from auditloom.operators.admission import rate_limit_label, throttle_label
from auditloom.operators.requests import (
    grant_derive,
    profile_resolve,
    request_validate,
    status_classify,
)

# Resource profile and timeouts in seconds per image.
PROFILES = (
    ("base", "2g", "2", 60, 600),
    ("heavy", "4g", "4", 300, 1800),
)
PROFILE_SCHEMA = "name string, memory string, cpus string, timeout_default int, timeout_cap int"
DAY_US = 86_400_000_000


def profile_table(spark) -> DataFrame:
    return small_table(spark, PROFILES, PROFILE_SCHEMA)


def request_lifecycle(
    requests: DataFrame,
    profiles: DataFrame,
    host_cpus: int,
    key: str = "k",
    tokens_per_period: int = 30,
    period_us: int = 60_000_000,
    burst: int = 10,
    limit: int = 3,
    ip_key: str | None = None,
    ip_tokens_per_period: int = 0,
    ip_burst: int = 20,
    carry: tuple[str, ...] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
    hot_ips: Hot | None = None,
) -> DataFrame:
    """Validate, resolve and grant every request, then throttle and classify it.

    Reads request_id, the key, ts_us, end_us, is_corrupt, auth_ok, bad_base64 and
    the request fields. Only requests past authentication and schema meet
    the bucket, only those it allows ask for a slot. With `ip_key` and a positive
    `ip_tokens_per_period`, every readable request meets a bucket of its address
    first. The folds get identifiers, times and flags alone; one shuffle serves both
    limits of a key. The result has request_id, status, error, retry_after and the columns in `carry`, which go through
    the folds too. Without `carry` it has all columns, joined back by request_id, which must then be unique.
    """
    checked = grant_derive(profile_resolve(request_validate(requests), profiles, host_cpus))
    readable = ~F.coalesce("is_corrupt", F.lit(False))
    flags = [c for c in ("is_corrupt", "token_set", "auth_ok", "valid", "bad_base64") if c in checked.columns]
    own = list(dict.fromkeys(["request_id", key, "ts_us", "end_us", *flags, *(carry or ())]))
    accepted = readable & F.coalesce("auth_ok", F.lit(True)) & F.col("valid")
    if ip_key is not None and ip_tokens_per_period > 0:
        hot_ips = hot_keys(requests, ip_key, hot_rows) if hot_ips is None else hot_ips
        checked_ip = checked.select(*dict.fromkeys([*own, ip_key]), readable.alias("_readable"))
        narrow = rate_limit_label(
            checked_ip, ip_key, "ts_us", "request_id", ip_tokens_per_period, period_us, ip_burst, when="_readable", hot=hot_ips
        ).withColumnsRenamed({"allowed": "ip_allowed", "retry_after": "ip_retry_after"}).drop("_readable")
        accepted = accepted & F.coalesce("ip_allowed", F.lit(True))
    else:
        narrow = checked.select(*own)
    hot = hot_keys(requests, key, hot_rows) if hot is None else hot
    throttled = throttle_label(
        narrow.withColumn("_accepted", accepted), key, "ts_us", "end_us", "request_id",
        tokens_per_period, period_us, burst, limit, when="_accepted", hot=hot,
    )
    judged = status_classify(throttled.drop("_accepted"))
    if carry is not None:
        return judged.select("request_id", *[c for c in carry if c != "request_id"], "status", "error", "retry_after")
    labels = [c for c in judged.columns if c not in checked.columns]
    return checked.join(judged.select("request_id", *labels), "request_id")
