"""Registered streaming queries: the events as a stream of several micro-batches, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators.logs import STAMP, exec_log_parse, exec_log_write
from auditloom.plans.lifecycle import DAY_US
from auditloom.plans.request_queries import EXEC_LOG_PARSE
from auditloom.plans.state_queries import BURST, PER_DAY, RATE_LIMIT_LABEL
from auditloom.plans.views import view, view_sql
from auditloom.session import run_folder
from auditloom.sources.files import read_log, write_log
from auditloom.streaming.deadline import deadline_stream
from auditloom.streaming.rate_limit import rate_limit_stream
from auditloom.streaming.run import read_stream, run_available

MICROS_EXPR = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


ROWS_PER_FILE = 1_000_000


def _events(spark, sf):
    """The events as they would arrive: files in order of time, one per micro-batch.

    All tasks write the rows to a folder per batch first, so that the one task that makes a batch's file reads its own rows alone.
    """
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("_us", F.expr(MICROS_EXPR))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_us").alias("lo"), F.max("_us").alias("hi")).first()
    parts = 4 + ends.n // ROWS_PER_FILE
    width = (ends.hi - ends.lo) // parts + 1
    home = run_folder(spark, "event-files")
    dealt = rows.where("_us IS NOT NULL").withColumn("_part", ((F.col("_us") - ends.lo) / width).cast("int")).drop("_us")
    dealt.write.partitionBy("_part").parquet(f"{home}/dealt")
    folder, staged = f"{home}/rows", spark.read.schema(dealt.schema).parquet(f"{home}/dealt")
    for n in range(parts):
        staged.where(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return read_stream(spark, folder, max_files=1)


def rate_limit_stream_query(spark, sf):
    requests = _events(spark, sf).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("k"), F.expr(MICROS_EXPR).alias("ts_us")
    )
    labelled = rate_limit_stream(requests, "k", "ts_us", "request_id", PER_DAY, DAY_US, BURST)
    return run_available(labelled, "rate-limit")


def deadline_stream_query(spark, sf):
    visits = _events(spark, sf).select(
        "event_id", "user_id", F.expr(MICROS_EXPR).alias("ts_us"), "event_type"
    )
    judged = deadline_stream(
        visits, "user_id", "event_id", "ts_us",
        F.col("event_type") == "signup", F.col("event_type") == "purchase", DAY_US,
    )
    return run_available(judged, "deadline")


# An arm whose deadline lies past the last arm or confirm is still open and does not come out.
DEADLINE_STREAM = f"""WITH judged AS (SELECT a.event_id, a.user_id, epoch_us(a.ts) + {DAY_US} AS due_us,
 min(epoch_us(c.ts)) AS confirm_us, CASE WHEN count(c.event_id) > 0 THEN 'confirmed' ELSE 'rollback' END AS outcome
FROM events a LEFT JOIN events c ON c.user_id = a.user_id AND c.event_type = 'purchase'
 AND epoch_us(c.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + {DAY_US}
WHERE a.event_type = 'signup' GROUP BY a.event_id, a.user_id, a.ts)
SELECT * FROM judged WHERE outcome = 'confirmed' OR due_us // 1000 + 1 <= (
 SELECT max(epoch_us(ts)) // 1000 FROM events WHERE event_type IN ('signup', 'purchase'))"""


def exec_log_stream(spark, sf):
    _events(spark, sf).createOrReplaceTempView("auditloom_event_stream")
    lines = spark.sql(view_sql("log_v", "spark").replace("FROM events", "FROM auditloom_event_stream"))
    parsed = exec_log_parse(lines).select(
        "line_no", F.unix_millis("log_ts").alias("log_ms"), "level", "kind", "image", "network", "raw",
        "granted", "timeout", "n_files", "cmd", "target",
    )
    return run_available(parsed, "exec-log")


def log_write_stream(spark, sf):
    """Typed log rows written as lines of text, read back as a stream of text files and parsed again."""
    fields = ["level", "kind", "image", "network", "raw", "granted", "timeout", "n_files", "cmd", "target"]
    lines = view(spark, sf, "log_v")
    parsed = exec_log_parse(lines).withColumn("message", F.regexp_extract("line", STAMP, 3))
    folder = run_folder(spark, "log-write") + "/rows"
    write_log(exec_log_write(parsed.drop("line")), folder)
    again = exec_log_parse(read_log(spark, folder, stream=True)).select(F.unix_millis("log_ts").alias("log_ms"), *fields)
    return run_available(again, "log-write")


LOG_WRITE_STREAM = f"SELECT * EXCLUDE (line_no) FROM ({EXEC_LOG_PARSE})"

QUERIES = {
    "log_write_stream": (log_write_stream, LOG_WRITE_STREAM),
    "rate_limit_stream": (rate_limit_stream_query, RATE_LIMIT_LABEL),
    "deadline_stream": (deadline_stream_query, DEADLINE_STREAM),
    "exec_log_stream": (exec_log_stream, EXEC_LOG_PARSE),
}
