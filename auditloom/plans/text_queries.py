"""Registered queries over text, JSON and checks, with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.sizing import small_table
from auditloom.operators import text
from auditloom.plans.views import table, view, with_views


def json_project(spark, sf):
    return text.json_project(
        view(spark, sf, "responses_v"), "body",
        {"ok": "boolean", "exit_code": "int", "stdout": "string", "k": "int"},
        {"stdout": ""}, paths={"k": "$.props.k"},
    ).drop("body")


JSON_PROJECT = f"""WITH {with_views("responses_v")}, typed AS (
 SELECT request_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM responses_v)
SELECT request_id, CAST(json_extract_string(j, '$.ok') AS BOOLEAN) AS ok,
 CAST(json_extract_string(j, '$.exit_code') AS INTEGER) AS exit_code,
 CASE WHEN json_type(j, '$.stdout') = 'VARCHAR' THEN json_extract_string(j, '$.stdout') ELSE '' END AS stdout,
 CAST(json_extract_string(j, '$.props.k') AS INTEGER) AS k FROM typed"""


def stream_rows(spark, sf):
    rows = view(spark, sf, "requests_v").select("request_id", "stdout", "stderr")
    return text.stream_rows(rows)


STREAM_ROWS = f"""WITH {with_views("requests_v")}
SELECT request_id, 'stdout' AS stream, stdout AS text FROM requests_v WHERE stdout <> ''
UNION ALL SELECT request_id, 'stderr', stderr FROM requests_v WHERE stderr <> ''"""

LINES = """split AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
trimmed AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM split),
lines AS (SELECT doc_id, unnest(p) AS line, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS line_no FROM trimmed)"""

MARKER, AFTER, KEEP = "token", 2, 3


def marker_context(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text.marker_context(docs, "text", "the", AFTER)


CONTEXT = f"""{LINES}, seen AS (SELECT *, max(CASE WHEN contains(line, '%s') THEN line_no END)
  OVER (PARTITION BY doc_id ORDER BY line_no) AS last_hit FROM lines),
context AS (SELECT doc_id, line_no, line FROM seen WHERE line_no - last_hit <= {AFTER})"""
MARKER_CONTEXT = f"WITH {CONTEXT % 'the'} SELECT doc_id, line_no, line FROM context"


def marker_context_head(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text.marker_context(docs, "text", "the", AFTER, limit=KEEP)


MARKER_CONTEXT_HEAD = f"""WITH {CONTEXT % 'the'} SELECT doc_id, line_no, line FROM context
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= {KEEP}"""


def marker_tail(spark, sf):
    return text.marker_tail(table(spark, sf, "documents").select("doc_id", "text"), "text", MARKER)


MARKER_TAIL = f"""WITH {LINES}, seen AS (SELECT *, min(CASE WHEN contains(line, '{MARKER}') THEN line_no END)
  OVER (PARTITION BY doc_id) AS first_hit FROM lines)
SELECT doc_id, line_no, line FROM seen WHERE line_no >= first_hit"""


def head_lines(spark, sf):
    heads = text.head_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", 5)
    return heads.withColumn("packed", text.strip_space(F.col("line")))


HEAD_LINES = f"""WITH {LINES} SELECT doc_id, line_no, line, regexp_replace(line, '[ \\t\\n\\r\\f\\x0B]', '', 'g') AS packed
FROM lines WHERE line_no <= 5"""


def probe_parse(spark, sf):
    return text.probe_parse(view(spark, sf, "probes_v"), "out")


PROBES = f"""{with_views("probes_v")}, probe_lines AS (SELECT run, unnest(string_split(out, chr(10))) AS line FROM probes_v),
labelled AS (SELECT run, regexp_extract(line, '^([A-Za-z][A-Za-z0-9]*)(_rc)?=(.*)$', ['key', 'bare', 'value']) AS p
 FROM probe_lines),
probes AS (SELECT run, p.key AS key, p.value AS value,
 TRY_CAST(CASE WHEN p.bare = '_rc' THEN regexp_extract(p.value, '^([0-9]+)', 1)
  ELSE regexp_extract(p.value, '^rc([0-9]+)', 1) END AS INTEGER) AS rc,
 TRY_CAST(regexp_extract(p.value, '(?:^|\\s)t([0-9]+)$', 1) AS INTEGER) AS t FROM labelled WHERE p.key <> '')"""
PROBE_PARSE = f"WITH {PROBES} SELECT run, key, value, rc, t FROM probes"

# What a sound egress probe shows.
PROBE_CHECKS = [
    ("dedicated subnet", "IP", "prefix", "172.31.255."),
    ("public dns", "PUBDNS", "eq", "OK"),
    ("public ip", "PUBIP", "eq", "0"),
    ("peer blocked", "PEER", "eq", "28"),
    ("metadata blocked", "META", "eq", "28"),
    ("private ranges blocked", "RFC1918", "eq", "28"),
    ("mesh dns blocked", "MAGICDNS", "eq", "9"),
]
CHECK_SCHEMA = "name string, key string, operator string, expected string"


def _probe_results(spark, sf):
    probes = view(spark, sf, "probes_v")
    observed = text.probe_parse(probes, "out").select(
        "run", "key", F.coalesce(F.col("rc").cast("string"), "value").alias("value")
    )
    checks = small_table(spark, PROBE_CHECKS, CHECK_SCHEMA)
    return text.expectation_suite(checks, observed, run="run", runs=probes)


def expectation_suite(spark, sf):
    return _probe_results(spark, sf)


RESULTS = f"""{PROBES}, checks(name, key, operator, expected) AS (VALUES {", ".join(map(str, PROBE_CHECKS))}),
observed AS (SELECT run, key, max(coalesce(CAST(rc AS VARCHAR), value)) AS value FROM probes GROUP BY run, key),
results AS (SELECT r.run, c.name, c.key, o.value, CASE WHEN o.value IS NOT NULL
  AND CASE c.operator WHEN 'eq' THEN o.value = expected ELSE starts_with(o.value, expected) END
  THEN 'PASS' ELSE 'FAIL' END AS result
 FROM probes_v r CROSS JOIN checks c LEFT JOIN observed o ON o.run = r.run AND o.key = c.key)"""
EXPECTATION_SUITE = f"WITH {RESULTS} SELECT run, name, key, value, result FROM results"


def expectation_gate(spark, sf):
    return text.gate(_probe_results(spark, sf), by="run")


EXPECTATION_GATE = f"""WITH {RESULTS} SELECT run, count(*) AS checks, count(*) FILTER (result = 'FAIL') AS fails,
 count(*) FILTER (result = 'FAIL') = 0 AS passed FROM results GROUP BY run"""

METRIC_CHECKS = [
    ("has open orders", "open_orders", "ge", "1"),
    ("few suppliers", "suppliers", "le", "5"),
    ("no negative price", "min_price_sign", "ne", "-1"),
    ("names differ", "first_customer", "ne_key", "first_supplier"),
    ("same name", "first_customer", "ne_key", "first_customer"),
    ("customer named", "first_customer", "non_empty", None),
    ("never measured", "latency", "eq", "1"),
]


def metric_suite(spark, sf):
    """Checks over measures of the given tables."""
    measures = [
        table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").cast("string").alias("value"))
        .select(F.lit("open_orders").alias("key"), "value"),
        table(spark, sf, "supplier").agg(F.count("*").cast("string").alias("value"))
        .select(F.lit("suppliers").alias("key"), "value"),
        table(spark, sf, "lineitem").agg(F.signum(F.min("l_extendedprice")).cast("int").cast("string").alias("value"))
        .select(F.lit("min_price_sign").alias("key"), "value"),
        table(spark, sf, "customer").agg(F.min("c_name").alias("value"))
        .select(F.lit("first_customer").alias("key"), "value"),
        table(spark, sf, "supplier").agg(F.min("s_name").alias("value"))
        .select(F.lit("first_supplier").alias("key"), "value"),
    ]
    observed = measures[0]
    for measure in measures[1:]:
        observed = observed.unionByName(measure)
    return text.expectation_suite(small_table(spark, METRIC_CHECKS, CHECK_SCHEMA), observed)


METRIC_SUITE = """WITH observed(key, value) AS (
 SELECT 'open_orders', CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR) FROM orders
 UNION ALL SELECT 'suppliers', CAST(count(*) AS VARCHAR) FROM supplier
 UNION ALL SELECT 'min_price_sign', CAST(CAST(sign(min(l_extendedprice)) AS INTEGER) AS VARCHAR) FROM lineitem
 UNION ALL SELECT 'first_customer', min(c_name) FROM customer
 UNION ALL SELECT 'first_supplier', min(s_name) FROM supplier),
checks(name, key, operator, expected) AS (VALUES ('has open orders', 'open_orders', 'ge', '1'),
 ('few suppliers', 'suppliers', 'le', '5'), ('no negative price', 'min_price_sign', 'ne', '-1'),
 ('names differ', 'first_customer', 'ne_key', 'first_supplier'), ('same name', 'first_customer', 'ne_key', 'first_customer'),
 ('customer named', 'first_customer', 'non_empty', NULL), ('never measured', 'latency', 'eq', '1'))
SELECT c.name, c.key, o.value, CASE WHEN coalesce(CASE operator
  WHEN 'ge' THEN TRY_CAST(o.value AS DOUBLE) >= TRY_CAST(expected AS DOUBLE)
  WHEN 'le' THEN TRY_CAST(o.value AS DOUBLE) <= TRY_CAST(expected AS DOUBLE)
  WHEN 'ne' THEN o.value <> expected WHEN 'eq' THEN o.value = expected WHEN 'non_empty' THEN o.value <> ''
  WHEN 'ne_key' THEN o.value <> '' AND o.value <> (SELECT value FROM observed x WHERE x.key = expected) END, false)
 THEN 'PASS' ELSE 'FAIL' END AS result
FROM checks c LEFT JOIN observed o ON o.key = c.key"""

QUERIES = {
    "json_project": (json_project, JSON_PROJECT),
    "stream_rows": (stream_rows, STREAM_ROWS),
    "marker_context": (marker_context, MARKER_CONTEXT),
    "marker_context_head": (marker_context_head, MARKER_CONTEXT_HEAD),
    "marker_tail": (marker_tail, MARKER_TAIL),
    "head_lines": (head_lines, HEAD_LINES),
    "probe_parse": (probe_parse, PROBE_PARSE),
    "expectation_suite": (expectation_suite, EXPECTATION_SUITE),
    "expectation_gate": (expectation_gate, EXPECTATION_GATE),
    "metric_suite": (metric_suite, METRIC_SUITE),
}
