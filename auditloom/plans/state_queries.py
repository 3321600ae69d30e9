"""Registered queries over keyed state, with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.skew import hot_keys
from auditloom.operators import admission, state
from auditloom.plans.lifecycle import DAY_US
from auditloom.plans.request_queries import bucket_sql, slots_sql
from auditloom.plans.views import table, view, with_views

# The events are hours apart, so the test limits are per day.
PER_DAY, BURST, LIMIT = 2, 2, 2


def rate_limit_label(spark, sf, hot=None):
    rows = view(spark, sf, "requests_v").select("request_id", "k", "ts_us")
    return admission.rate_limit_label(rows, "k", "ts_us", "request_id", PER_DAY, DAY_US, BURST, hot=hot)


BUCKET_BASE = f"WITH RECURSIVE {with_views('requests_v')}, {bucket_sql('requests_v', DAY_US, BURST * DAY_US, PER_DAY)}"
RATE_LIMIT_LABEL = f"{BUCKET_BASE} SELECT request_id, k, ts_us, allowed, retry_after FROM labelled"


def early_retry(spark, sf):
    # One count of the keys serves both operators.
    hot = hot_keys(view(spark, sf, "requests_v"), "k")
    labelled = rate_limit_label(spark, sf, hot)
    return state.early_retry(labelled, "k", "ts_us", "request_id", hot=hot).select(
        "request_id", "denied_us", "wait_left_us", "early"
    )


EARLY_RETRY = f"""{BUCKET_BASE}, looked AS (SELECT *, last_value(CASE WHEN NOT allowed THEN ts_us END IGNORE NULLS) OVER w AS denied_us,
  last_value(CASE WHEN NOT allowed THEN retry_after END IGNORE NULLS) OVER w AS wait_s FROM labelled
  WINDOW w AS (PARTITION BY k ORDER BY ts_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
waits AS (SELECT request_id, denied_us,
  coalesce(greatest(denied_us + CAST(wait_s AS BIGINT) * 1000000 - ts_us, 0), 0) AS wait_left_us FROM looked)
SELECT request_id, denied_us, wait_left_us, wait_left_us > 0 AS early FROM waits"""


def concurrency_admit(spark, sf):
    rows = view(spark, sf, "requests_v").select("request_id", "k", "ts_us", "end_us")
    admitted = admission.concurrency_admit(rows, "k", "ts_us", "end_us", "request_id", LIMIT)
    return admitted.select("request_id", "admitted", "retry_after")


CONCURRENCY_ADMIT = f"""WITH RECURSIVE {with_views('requests_v')}, {slots_sql('requests_v', LIMIT)}
SELECT request_id, admitted, CASE WHEN admitted THEN 0 ELSE 5 END AS retry_after FROM slots"""


def concurrency_profile(spark, sf):
    rows = view(spark, sf, "requests_v").select("k", "ts_us", "end_us")
    return state.concurrency_profile(rows, "k", "ts_us", "end_us")


PROFILE_BASE = f"""WITH {with_views('requests_v')}, points AS (
 SELECT k, ts_us AS t_us, 1 AS d FROM requests_v UNION ALL SELECT k, end_us, -1 FROM requests_v WHERE end_us IS NOT NULL),
netted AS (SELECT k, t_us, sum(d) AS d FROM points GROUP BY k, t_us),
profile AS (SELECT k, t_us, CAST(sum(d) OVER (PARTITION BY k ORDER BY t_us) AS BIGINT) AS active FROM netted)"""
CONCURRENCY_PROFILE = f"{PROFILE_BASE} SELECT k, t_us, active FROM profile"


def concurrency_peak(spark, sf):
    return state.concurrency_peak(concurrency_profile(spark, sf), "k")


CONCURRENCY_PEAK = f"""{PROFILE_BASE}, tops AS (SELECT *, max(active) OVER (PARTITION BY k) AS peak FROM profile)
SELECT k, peak, min(t_us) AS peak_us FROM tops WHERE active = peak GROUP BY k, peak"""


def _visits(spark, sf):
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.expr(micros).alias("ts_us"), "event_type"
    )


def deadline_absence(spark, sf):
    judged = state.deadline_absence(
        _visits(spark, sf), "user_id", "ts_us",
        F.col("event_type") == "signup", F.col("event_type") == "purchase", DAY_US,
    )
    return judged.select("event_id", "user_id", "due_us", "confirm_us", "outcome")


DEADLINE_ABSENCE = f"""SELECT a.event_id, a.user_id, epoch_us(a.ts) + {DAY_US} AS due_us,
 min(epoch_us(c.ts)) AS confirm_us, CASE WHEN count(c.event_id) > 0 THEN 'confirmed' ELSE 'rollback' END AS outcome
FROM events a LEFT JOIN events c ON c.user_id = a.user_id AND c.event_type = 'purchase'
 AND epoch_us(c.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + {DAY_US}
WHERE a.event_type = 'signup' GROUP BY a.event_id, a.user_id, a.ts"""


def run_timeouts(spark, sf):
    """Started runs whose finish does not come within their effective hour."""
    visits = _visits(spark, sf)
    return state.deadline_absence(
        visits, "user_id", "ts_us",
        F.col("event_type").isin("click", "view"), F.col("event_type") == "error", DAY_US // 4,
    ).where(F.col("outcome") == "rollback").select("event_id", "user_id", "due_us")


RUN_TIMEOUTS = f"""SELECT event_id, user_id, epoch_us(ts) + {DAY_US // 4} AS due_us FROM events a
WHERE event_type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = a.user_id
 AND c.event_type = 'error' AND epoch_us(c.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + {DAY_US // 4})"""


def orphan_sweep(spark, sf):
    starts = table(spark, sf, "part").select(F.concat(F.lit("run-"), "p_partkey").alias("name"), "p_brand")
    ends = table(spark, sf, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1995-01-01 00:00:00'").select(
        F.concat(F.lit("run-"), "l_partkey").alias("name")
    )
    return state.orphan_sweep(starts, ends, "name", "run-1")


ORPHAN_SWEEP = """SELECT concat('run-', p_partkey) AS name, p_brand FROM part p
WHERE starts_with(concat('run-', p_partkey), 'run-1') AND NOT EXISTS (SELECT 1 FROM lineitem l
 WHERE l.l_partkey = p.p_partkey AND l.l_shipdate < TIMESTAMP '1995-01-01 00:00:00')"""


def orphan_pairs(spark, sf):
    workdirs = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("name"))
    containers = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"))
    return state.orphan_pairs(workdirs, containers, "name", ("workdirs", "containers"))


ORPHAN_PAIRS = """WITH w AS (SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderstatus <> 'F'),
c AS (SELECT c_custkey AS name FROM customer WHERE c_acctbal > 0)
SELECT coalesce(w.name, c.name) AS name, CASE WHEN w.name IS NULL THEN 'workdirs' ELSE 'containers' END AS missing_from
FROM w FULL JOIN c ON w.name = c.name WHERE w.name IS NULL OR c.name IS NULL"""

# The hot ways: one key above the limit, in slices, next to keys that stay whole.
HOT_LIMIT = 1000


def hot_rate_limit(spark, sf):
    rows = view(spark, sf, "hot_requests_v").select("request_id", "k", "ts_us")
    return admission.rate_limit_label(rows, "k", "ts_us", "request_id", PER_DAY, DAY_US, BURST, hot_rows=HOT_LIMIT)


HOT_BASE = f"{with_views('requests_v', 'hot_requests_v')}"
HOT_BUCKET = f"WITH RECURSIVE {HOT_BASE}, {bucket_sql('hot_requests_v', DAY_US, BURST * DAY_US, PER_DAY)}"
HOT_RATE_LIMIT = f"{HOT_BUCKET} SELECT request_id, k, ts_us, allowed, retry_after FROM labelled"


def hot_early_retry(spark, sf):
    labelled = hot_rate_limit(spark, sf)
    return state.early_retry(labelled, "k", "ts_us", "request_id", hot_rows=HOT_LIMIT).select(
        "request_id", "denied_us", "wait_left_us", "early"
    )


HOT_EARLY_RETRY = HOT_BUCKET + EARLY_RETRY.removeprefix(BUCKET_BASE)


def hot_concurrency_admit(spark, sf):
    rows = view(spark, sf, "hot_requests_v").select("request_id", "k", "ts_us", "end_us")
    admitted = admission.concurrency_admit(rows, "k", "ts_us", "end_us", "request_id", LIMIT, hot_rows=HOT_LIMIT)
    return admitted.select("request_id", "admitted", "retry_after")


HOT_CONCURRENCY_ADMIT = f"""WITH RECURSIVE {HOT_BASE}, {slots_sql('hot_requests_v', LIMIT)}
SELECT request_id, admitted, CASE WHEN admitted THEN 0 ELSE 5 END AS retry_after FROM slots"""


def hot_concurrency_profile(spark, sf):
    rows = view(spark, sf, "hot_requests_v").select("k", "ts_us", "end_us")
    return state.concurrency_profile(rows, "k", "ts_us", "end_us", hot_rows=HOT_LIMIT)


HOT_CONCURRENCY_PROFILE = CONCURRENCY_PROFILE.replace(with_views("requests_v"), HOT_BASE).replace(
    "FROM requests_v UNION", "FROM hot_requests_v UNION"
).replace("-1 FROM requests_v", "-1 FROM hot_requests_v")


def hot_deadline(spark, sf):
    visits = _visits(spark, sf).withColumns(
        {"user_id": F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.col("user_id")), "ts_us": F.col("ts_us") - F.col("ts_us") % 3_600_000_000}
    )
    judged = state.deadline_absence(
        visits, "user_id", "ts_us",
        F.col("event_type") == "signup", F.col("event_type") == "purchase", DAY_US // 8, hot_rows=HOT_LIMIT,
    )
    return judged.select("event_id", "due_us", "confirm_us", "outcome")


HOT_DEADLINE = f"""WITH v AS (SELECT event_id, event_type, CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS u,
  epoch_us(ts) - epoch_us(ts) % 3600000000 AS t FROM events)
SELECT a.event_id, a.t + {DAY_US // 8} AS due_us, min(c.t) AS confirm_us,
 CASE WHEN count(c.event_id) > 0 THEN 'confirmed' ELSE 'rollback' END AS outcome
FROM v a LEFT JOIN v c ON c.u = a.u AND c.event_type = 'purchase' AND c.t BETWEEN a.t AND a.t + {DAY_US // 8}
WHERE a.event_type = 'signup' GROUP BY a.event_id, a.t"""

QUERIES = {
    "hot_rate_limit": (hot_rate_limit, HOT_RATE_LIMIT),
    "hot_early_retry": (hot_early_retry, HOT_EARLY_RETRY),
    "hot_concurrency_admit": (hot_concurrency_admit, HOT_CONCURRENCY_ADMIT),
    "hot_concurrency_profile": (hot_concurrency_profile, HOT_CONCURRENCY_PROFILE),
    "hot_deadline": (hot_deadline, HOT_DEADLINE),
    "rate_limit_label": (rate_limit_label, RATE_LIMIT_LABEL),
    "early_retry": (early_retry, EARLY_RETRY),
    "concurrency_admit": (concurrency_admit, CONCURRENCY_ADMIT),
    "concurrency_profile": (concurrency_profile, CONCURRENCY_PROFILE),
    "concurrency_peak": (concurrency_peak, CONCURRENCY_PEAK),
    "deadline_absence": (deadline_absence, DEADLINE_ABSENCE),
    "run_timeouts": (run_timeouts, RUN_TIMEOUTS),
    "orphan_sweep": (orphan_sweep, ORPHAN_SWEEP),
    "orphan_pairs": (orphan_pairs, ORPHAN_PAIRS),
}
