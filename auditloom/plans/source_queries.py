"""Registered queries that go through files: written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators.content import file_inventory
from auditloom.operators.logs import exec_log_parse
from auditloom.operators.requests import request_parse
from auditloom.operators.text import json_project
from auditloom.plans.request_queries import BODY_FIELDS
from auditloom.plans.views import table, view, with_views
from auditloom.session import run_folder
from auditloom.sources.files import (
    read_bodies,
    read_corpus,
    read_log,
    read_settings,
    read_templates,
    write_responses,
    write_table,
)


def log_file(spark, sf):
    folder = run_folder(spark, "log-file") + "/rows"
    view(spark, sf, "log_v").select("line").write.text(folder)
    parsed = exec_log_parse(read_log(spark, folder))
    return parsed.groupBy("level", "kind", "image", "network").agg(
        F.count("*").alias("n"), F.sum("timeout").alias("timeout_s"), F.sum("n_files").alias("n_files")
    )


LOG_FILE = f"""WITH {with_views("log_v")}, parts AS (SELECT
 nullif(regexp_extract(line, '^[0-9-]{{10}} [0-9:,]{{12}} ([A-Z]+) ', 1), '') AS level,
 CASE WHEN contains(line, ' INFO exec ') THEN 'exec' WHEN contains(line, 'timeout after') THEN 'timeout_kill'
  WHEN contains(line, 'not fully removed') THEN 'partial_cleanup' WHEN contains(line, 'LEAK') THEN 'leak'
  ELSE 'other' END AS kind,
 nullif(regexp_extract(line, 'image=(\\S+)', 1), '') AS image, nullif(regexp_extract(line, 'network=(\\S+)', 1), '') AS network,
 TRY_CAST(regexp_extract(line, 'timeout(?:=| after )([0-9]+)s', 1) AS INTEGER) AS timeout,
 TRY_CAST(regexp_extract(line, 'files=([0-9]+)', 1) AS INTEGER) AS n_files FROM log_v)
SELECT level, kind, image, network, count(*) AS n, CAST(sum(timeout) AS BIGINT) AS timeout_s,
 CAST(sum(n_files) AS BIGINT) AS n_files FROM parts GROUP BY ALL"""


def body_file(spark, sf):
    folder = run_folder(spark, "body-file") + "/rows"
    view(spark, sf, "bodies_v").select("body").write.text(folder)
    parsed = request_parse(read_bodies(spark, folder), "body")
    return parsed.groupBy("network", "image", "raw", "is_corrupt").agg(
        F.count("*").alias("n"), F.sum("timeout").alias("timeout_s")
    )


BODY_FILE = f"""{BODY_FIELDS}
SELECT network, image, raw, is_corrupt, count(*) AS n, CAST(sum(timeout) AS BIGINT) AS timeout_s FROM fields GROUP BY ALL"""


def response_file(spark, sf):
    folder = run_folder(spark, "response-file") + "/rows"
    rows = view(spark, sf, "requests_v").select("request_id", "exit_code", "stdout", "stderr", "timed_out")
    write_responses(rows, folder)
    return json_project(
        read_bodies(spark, folder), "body",
        {"request_id": "bigint", "exit_code": "int", "stdout": "string", "stderr": "string", "timed_out": "boolean"},
        {},
    ).drop("body", "file")


RESPONSE_FILE = f"""WITH {with_views("requests_v")}
SELECT request_id, exit_code, stdout, stderr, timed_out FROM requests_v"""

def corpus_file(spark, sf):
    """Each benchmark item as a file of its own, read back as a corpus with size and hash."""
    folder = run_folder(spark, "corpus-file") + "/rows"
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(folder)
    files = file_inventory(read_corpus(spark, folder, "*.txt"), "path", "body")
    return files.select(F.regexp_extract("path", r"item_id=([0-9]+)/", 1).cast("long").alias("item_id"), "size", "sha256")


CORPUS_FILE = """SELECT item_id, CAST(strlen(text) + 1 AS BIGINT) AS size, sha256(concat(text, chr(10))) AS sha256 FROM benchmark"""


def corpus_file_empty(spark, sf):
    """The same next to a file of zero bytes."""
    folder = run_folder(spark, "corpus-file-empty") + "/rows"
    table(spark, sf, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(folder)
    table(spark, sf, "benchmark").where("false").select("text").coalesce(1).write.text(f"{folder}/item_id=999999999")
    files = file_inventory(read_corpus(spark, folder, "*.txt"), "path", "body")
    return files.select(F.regexp_extract("path", r"item_id=([0-9]+)/", 1).cast("long").alias("item_id"), "size", "sha256")


CORPUS_FILE_EMPTY = CORPUS_FILE + " UNION ALL SELECT 999999999, 0, sha256('')"


def template_tree(spark, sf):
    """A template per supplier, in a folder of its own."""
    folder = run_folder(spark, "template-tree") + "/rows"
    key = F.col("s_suppkey")
    severity = F.when(key % 4 == 0, "Critical").when(key % 4 == 1, "high").when(key % 4 == 2, "low").otherwise("")
    text = F.concat(
        F.lit("id: t"), key, F.lit("\ninfo:\n  severity: "), severity, F.lit("\n  tags: cve, , nation"), F.col("s_nationkey"), F.lit(" ,x\n")
    )
    # A folder is some milliseconds of work, so all tasks make some, and each moves its own to their place.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf, "supplier").select(key.alias("key"), text.alias("value")).repartition(width, "key")
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("key").text(folder)
    return read_templates(spark, folder, "*.txt").select(
        F.regexp_extract("path", r"key=([0-9]+)/", 1).cast("long").alias("key"), "severity", F.array_join("tags", ",").alias("tags")
    )


TEMPLATE_TREE = """SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' END AS severity,
 concat('cve,nation', s_nationkey, ',x') AS tags FROM supplier"""


def settings_file(spark, sf):
    folder = run_folder(spark, "settings-file") + "/rows"
    key = F.col("c_custkey")
    line = F.when(key % 5 == 0, F.concat(F.lit("# "), key)).otherwise(F.concat(F.lit("  KEY_"), key, F.lit("="), "c_name", F.lit("=x")))
    table(spark, sf, "customer").select(line.alias("value")).write.text(folder)
    return read_settings(spark, folder).select("key", "value")


SETTINGS_FILE = """SELECT concat('KEY_', c_custkey) AS key, concat(c_name, '=x') AS value FROM customer WHERE c_custkey % 5 <> 0"""


def partitioned_table(spark, sf):
    folder = run_folder(spark, "partitioned-table") + "/rows"
    write_table(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), folder, ["o_orderstatus"])
    return spark.read.parquet(folder).select("o_orderkey", "o_custkey", "o_orderstatus")


PARTITIONED_TABLE = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"

QUERIES = {
    "corpus_file": (corpus_file, CORPUS_FILE),
    "corpus_file_empty": (corpus_file_empty, CORPUS_FILE_EMPTY),
    "template_tree": (template_tree, TEMPLATE_TREE),
    "settings_file": (settings_file, SETTINGS_FILE),
    "partitioned_table": (partitioned_table, PARTITIONED_TABLE),
    "log_file": (log_file, LOG_FILE),
    "body_file": (body_file, BODY_FILE),
    "response_file": (response_file, RESPONSE_FILE),
}
