"""Registered queries over requests, responses and logs, with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.sizing import small_table
from auditloom.operators import logs, requests
from auditloom.plans.lifecycle import DAY_US, profile_table, request_lifecycle
from auditloom.plans.views import table, view, with_views

HOST_CPUS = 3
CAP = 511


def request_parse(spark, sf):
    parsed = requests.request_parse(view(spark, sf, "bodies_v"), "body")
    return parsed.select(
        "request_id", "is_corrupt", "command", "network", "timeout", "raw", "image",
        F.coalesce(F.array_size("files"), F.lit(0)).alias("n_files"),
        F.get("files", F.lit(0))["name"].alias("first_name"),
        F.array_join("type_errors", ",").alias("type_errors"),
    )


BODY_FIELDS = f"""
WITH {with_views("bodies_v")}, typed AS (
 SELECT request_id, body, json_valid(body) AS is_json,
  CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM bodies_v),
kinds AS (SELECT *, json_type(j) AS tj, json_type(j, '$.command') AS tc, json_type(j, '$.network') AS tn,
  json_type(j, '$.timeout') AS tt, json_type(j, '$.raw') AS tr, json_type(j, '$.image') AS ti,
  json_type(j, '$.files') AS tf, json_extract_string(j, '$.timeout') AS xt,
  lower(json_extract_string(j, '$.raw')) AS xr, json_extract_string(j, '$.image') AS xi FROM typed),
fields AS (SELECT request_id, NOT is_json AS is_corrupt, tj, tc, tt, tr, tf,
  CASE WHEN tc = 'VARCHAR' THEN json_extract_string(j, '$.command') END AS command,
  CASE WHEN tn IS NULL THEN 'none' WHEN tn = 'VARCHAR' THEN json_extract_string(j, '$.network') END AS network,
  CASE WHEN tt IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(xt AS DOUBLE) = floor(CAST(xt AS DOUBLE))
    THEN CAST(CAST(xt AS DOUBLE) AS INTEGER)
   WHEN tt = 'VARCHAR' THEN TRY_CAST(xt AS INTEGER) END AS timeout,
  CASE WHEN tr IS NULL THEN false WHEN xr IN ('1', 'on', 't', 'true', 'y', 'yes') THEN true
   WHEN xr IN ('0', 'off', 'f', 'false', 'n', 'no') THEN false END AS raw,
  CASE WHEN ti = 'VARCHAR' AND xi IN ('base', 'heavy') THEN xi ELSE 'base' END AS image,
  CASE WHEN tf = 'ARRAY' THEN CAST(json_array_length(j, '$.files') AS INTEGER) ELSE 0 END AS n_files,
  list_transform(CAST(json_extract(j, '$.files[*].name') AS VARCHAR[]), lambda n: trim(n, '"')) AS names
 FROM kinds)
"""

TYPE_ERRORS = """concat_ws(',', CASE WHEN NOT is_corrupt AND tj <> 'OBJECT' THEN 'body_type' END,
  CASE WHEN tc IS NOT NULL AND tc <> 'VARCHAR' THEN 'command_type' END,
  CASE WHEN tt IS NOT NULL AND tt <> 'NULL' AND timeout IS NULL THEN 'timeout_type' END,
  CASE WHEN tr IS NOT NULL AND raw IS NULL THEN 'raw_type' END,
  CASE WHEN tf IS NOT NULL AND tf NOT IN ('ARRAY', 'NULL') THEN 'files_type' END)"""

REQUEST_PARSE = f"""{BODY_FIELDS}
SELECT request_id, is_corrupt, command, network, timeout, raw, image, n_files,
 names[1] AS first_name, {TYPE_ERRORS} AS type_errors FROM fields"""


def request_validate(spark, sf):
    parsed = requests.request_parse(view(spark, sf, "bodies_v"), "body")
    return requests.request_validate(parsed).select(
        "request_id", F.array_join("violations", ",").alias("violations"), "valid"
    )


REQUEST_VALIDATE = f"""{BODY_FIELDS}, ruled AS (SELECT request_id, {TYPE_ERRORS} AS type_errors,
 concat_ws(',', CASE WHEN length(coalesce(command, '')) < 1 THEN 'command_empty' END,
  CASE WHEN network IS NULL OR network NOT IN ('none', 'egress') THEN 'network_unknown' END,
  CASE WHEN timeout < 5 OR timeout > 1800 THEN 'timeout_range' END,
  CASE WHEN len(list_filter(names, lambda n: n IN ('.', '..') OR NOT regexp_matches(n, '^[A-Za-z0-9._-]+\\n?$'))) > 0
   THEN 'file_name' END,
  CASE WHEN len(list_filter(names, lambda n: length(n) NOT BETWEEN 1 AND 255)) > 0 THEN 'file_name_length' END) AS broken
 FROM fields)
SELECT request_id, concat_ws(',', nullif(type_errors, ''), nullif(broken, '')) AS violations,
 type_errors = '' AND broken = '' AS valid FROM ruled"""


def profile_resolve(spark, sf):
    resolved = requests.profile_resolve(view(spark, sf, "requests_v"), profile_table(spark), HOST_CPUS)
    return resolved.select("request_id", "image_eff", "memory", "cpus_eff", "timeout_eff")


PROFILES_SQL = """profiles(name, memory, cpus, timeout_default, timeout_cap) AS (
 VALUES ('base', '2g', '2', 60, 600), ('heavy', '4g', '4', 300, 1800))"""

PROFILE_RESOLVE = f"""WITH {with_views("requests_v")}, {PROFILES_SQL}
SELECT request_id, p.name AS image_eff, p.memory,
 CASE WHEN CAST(p.cpus AS DECIMAL(18, 3)) > {HOST_CPUS} THEN '{HOST_CPUS}' ELSE p.cpus END AS cpus_eff,
 greatest(5, least(coalesce(timeout, p.timeout_default), p.timeout_cap)) AS timeout_eff
FROM requests_v r JOIN profiles p
 ON p.name = CASE WHEN r.image IN (SELECT name FROM profiles) THEN r.image ELSE 'base' END"""


def grant_derive(spark, sf):
    granted = requests.grant_derive(
        view(spark, sf, "requests_v"), dns="1.1.1.1", symbol_cache="/srv/symbols"
    )
    return granted.select("request_id", "network_eff", "raw_granted", "dns", "symbol_mount")


GRANT_DERIVE = f"""WITH {with_views("requests_v")}
SELECT request_id, CASE WHEN network = 'none' THEN 'none' ELSE 'egress-net' END AS network_eff,
 raw AND network = 'egress' AS raw_granted,
 CASE WHEN network = 'egress' THEN '1.1.1.1' END AS dns,
 CASE WHEN image = 'heavy' THEN '/srv/symbols' END AS symbol_mount
FROM requests_v"""


def _requests_with_files(spark, sf):
    # At most three attachments per request, so a group stays small.
    return (
        view(spark, sf, "files_v")
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "b64"))).alias("_files"))
        .select(
            "request_id",
            F.transform("_files", lambda f: F.struct(f["name"].alias("name"), f["b64"].alias("b64"))).alias(
                "files"
            ),
        )
    )


def files_decode(spark, sf):
    files, _ = requests.files_decode(_requests_with_files(spark, sf), "request_id")
    return files.select("request_id", "name", "size", "sha256", F.col("body").cast("string").alias("body"))


FILES_BASE = f"""WITH {with_views("files_v")}, judged AS (
 SELECT *, regexp_full_match(b64, '(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') AS fine
 FROM files_v), bad AS (SELECT DISTINCT request_id FROM judged WHERE NOT fine)"""

FILES_DECODE = f"""{FILES_BASE}, kept AS (
 SELECT *, row_number() OVER (PARTITION BY request_id, name ORDER BY pos DESC) AS rn FROM judged
 WHERE request_id NOT IN (SELECT request_id FROM bad))
SELECT request_id, name, CAST(octet_length(from_base64(b64)) AS INTEGER) AS size,
 sha256(from_base64(b64)) AS sha256, decode(from_base64(b64)) AS body
FROM kept WHERE rn = 1"""


def files_bad_requests(spark, sf):
    _, bad = requests.files_decode(_requests_with_files(spark, sf), "request_id")
    return bad


FILES_BAD_REQUESTS = f"{FILES_BASE} SELECT request_id FROM bad"


def output_cap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("out"))
    return requests.output_cap(docs, "out", CAP).select("doc_id", "out_text", "out_truncated")


OUTPUT_CAP = f"""WITH cut AS (SELECT doc_id, text, list_max(list_filter(range(0, {CAP + 1}),
  lambda n: strlen(left(text, n)) <= {CAP})) AS n FROM documents)
SELECT doc_id, concat(left(text, n),
  CASE WHEN strlen(text) > {CAP} AND strlen(left(text, n)) < {CAP} THEN chr(65533) ELSE '' END) AS out_text,
 strlen(text) > {CAP} AS out_truncated FROM cut"""


def outcome_label(spark, sf):
    return requests.outcome_label(view(spark, sf, "requests_v"), "SCAN-DONE").select(
        "request_id", "exit_code_eff", "ok", "success"
    )


OUTCOME_LABEL = f"""WITH {with_views("requests_v")}
SELECT request_id, coalesce(exit_code, -1) AS exit_code_eff,
 NOT timed_out AND coalesce(exit_code, -1) = 0 AS ok,
 NOT timed_out AND coalesce(exit_code, -1) = 0 AND stdout <> '' AND contains(stdout, 'SCAN-DONE') AS success
FROM requests_v"""


def _lifecycle(spark, sf, carry):
    return request_lifecycle(
        view(spark, sf, "requests_v"), profile_table(spark), HOST_CPUS,
        tokens_per_period=2, period_us=DAY_US, burst=2, limit=2, carry=carry,
    )


def status_classify(spark, sf):
    return _lifecycle(spark, sf, ("image_eff", "timeout_eff"))


def status_ip_limit(spark, sf):
    """The same with a bucket per address in front, four users to an address."""
    requests_v = view(spark, sf, "requests_v").withColumn("ip", F.expr("k div 4"))
    judged = request_lifecycle(
        requests_v, profile_table(spark), HOST_CPUS, tokens_per_period=2, period_us=DAY_US, burst=2, limit=2,
        ip_key="ip", ip_tokens_per_period=9, ip_burst=5, carry=(),
    )
    return judged


def status_counts(spark, sf):
    return (
        _lifecycle(spark, sf, ("image_eff",))
        .groupBy("status", "image_eff")
        .agg(F.count("*").alias("n"), F.sum("retry_after").alias("wait_s"))
    )


def bucket_sql(source: str, token: int, cap: int, refill: int, key: str = "k", tag: str = "") -> str:
    """Recursive CTEs that walk every key of `source(key, request_id, ts_us)` row by row."""
    full = -(-cap // max(1, refill))
    return f"""numbered{tag} AS (SELECT {key} AS k, request_id, ts_us,
  row_number() OVER (PARTITION BY {key} ORDER BY ts_us, request_id) AS rn FROM {source}),
bucket{tag} AS (
 SELECT rn, k, request_id, ts_us, CAST({cap} AS BIGINT) AS level FROM numbered{tag} WHERE rn = 1
 UNION ALL
 SELECT n.rn, n.k, n.request_id, n.ts_us,
  least({cap}, b.level - CASE WHEN b.level >= {token} THEN {token} ELSE 0 END
   + least(n.ts_us - b.ts_us, {full}) * {refill})
 FROM bucket{tag} b JOIN numbered{tag} n ON n.k = b.k AND n.rn = b.rn + 1),
labelled{tag} AS (SELECT k, request_id, ts_us, level >= {token} AS allowed,
  CAST(CASE WHEN level >= {token} THEN 0
   ELSE greatest(1, ({token} - level + {refill * 1_000_000} - 1) // {refill * 1_000_000}) END AS INTEGER) AS retry_after
 FROM bucket{tag})"""


def slots_sql(source: str, limit: int) -> str:
    """Recursive CTEs for the concurrency cap over `source(k, request_id, ts_us, end_us)`."""
    return f"""queued AS (SELECT k, request_id, ts_us, coalesce(end_us, 9223372036854775807) AS end_us,
  row_number() OVER (PARTITION BY k ORDER BY ts_us, request_id) AS rn FROM {source}),
slots AS (
 SELECT rn, k, request_id, true AS admitted, [end_us] AS ends FROM queued WHERE rn = 1
 UNION ALL
 SELECT q.rn, q.k, q.request_id, len(list_filter(s.ends, lambda e: e > q.ts_us)) < {limit},
  CASE WHEN len(list_filter(s.ends, lambda e: e > q.ts_us)) < {limit}
   THEN list_append(list_filter(s.ends, lambda e: e > q.ts_us), q.end_us)
   ELSE list_filter(s.ends, lambda e: e > q.ts_us) END
 FROM slots s JOIN queued q ON q.k = s.k AND q.rn = s.rn + 1)"""


CHECKED = f"""{with_views("requests_v")}, {PROFILES_SQL},
checked AS (SELECT r.*, r.k // 4 AS ip, p.name AS image_eff,
  greatest(5, least(coalesce(timeout, p.timeout_default), p.timeout_cap)) AS timeout_eff,
  command <> '' AND network IN ('none', 'egress') AND coalesce(timeout BETWEEN 5 AND 1800, true) AS valid
 FROM requests_v r JOIN profiles p
  ON p.name = CASE WHEN r.image IN (SELECT name FROM profiles) THEN r.image ELSE 'base' END)"""

THROTTLED = f"""{bucket_sql("accepted", DAY_US, 2 * DAY_US, 2)},
passed AS (SELECT a.* FROM accepted a JOIN labelled l USING (request_id) WHERE l.allowed),
{slots_sql("passed", 2)}"""

STATUS_BASE = f"""WITH RECURSIVE {CHECKED},
accepted AS (SELECT * FROM checked WHERE NOT is_corrupt AND auth_ok AND valid), {THROTTLED},
verdicts AS (SELECT c.request_id, c.image_eff, c.timeout_eff,
  CASE WHEN is_corrupt THEN 422 WHEN NOT auth_ok THEN 401 WHEN NOT valid THEN 422
   WHEN NOT l.allowed THEN 429 WHEN NOT s.admitted THEN 429 WHEN bad_base64 THEN 400 ELSE 200 END AS status,
  CASE WHEN is_corrupt THEN 'malformed' WHEN NOT auth_ok THEN 'unauthorized' WHEN NOT valid THEN 'schema'
   WHEN NOT l.allowed THEN 'rate_limited' WHEN NOT s.admitted THEN 'concurrency_limited'
   WHEN bad_base64 THEN 'bad_base64' END AS error,
  CASE WHEN NOT l.allowed THEN l.retry_after WHEN NOT s.admitted THEN 5 END AS retry_after
 FROM checked c LEFT JOIN labelled l USING (request_id) LEFT JOIN slots s USING (request_id))"""

STATUS_IP_LIMIT = f"""WITH RECURSIVE {CHECKED}, readable AS (SELECT * FROM checked WHERE NOT is_corrupt),
{bucket_sql("readable", DAY_US, 5 * DAY_US, 9, key="ip", tag="_ip")},
accepted AS (SELECT r.* FROM readable r JOIN labelled_ip i USING (request_id) WHERE i.allowed AND auth_ok AND valid),
{THROTTLED}
SELECT c.request_id,
 CASE WHEN is_corrupt THEN 422 WHEN NOT i.allowed THEN 429 WHEN NOT auth_ok THEN 401 WHEN NOT valid THEN 422
  WHEN NOT l.allowed THEN 429 WHEN NOT s.admitted THEN 429 WHEN bad_base64 THEN 400 ELSE 200 END AS status,
 CASE WHEN is_corrupt THEN 'malformed' WHEN NOT i.allowed THEN 'rate_limited' WHEN NOT auth_ok THEN 'unauthorized'
  WHEN NOT valid THEN 'schema' WHEN NOT l.allowed THEN 'rate_limited' WHEN NOT s.admitted THEN 'concurrency_limited'
  WHEN bad_base64 THEN 'bad_base64' END AS error,
 CASE WHEN NOT i.allowed THEN i.retry_after WHEN NOT auth_ok OR NOT valid THEN NULL
  WHEN NOT l.allowed THEN l.retry_after WHEN NOT s.admitted THEN 5 END AS retry_after
FROM checked c LEFT JOIN labelled_ip i USING (request_id) LEFT JOIN labelled l USING (request_id)
 LEFT JOIN slots s USING (request_id)"""

STATUS_CLASSIFY = f"""{STATUS_BASE}
SELECT request_id, status, error, retry_after, image_eff, timeout_eff FROM verdicts"""

STATUS_COUNTS = f"""{STATUS_BASE}
SELECT status, image_eff, count(*) AS n, CAST(sum(retry_after) AS BIGINT) AS wait_s
FROM verdicts GROUP BY status, image_eff"""


def exec_log_parse(spark, sf):
    return logs.exec_log_parse(view(spark, sf, "log_v")).select(
        "line_no", F.unix_millis("log_ts").alias("log_ms"), "level", "kind", "image", "network", "raw",
        "granted", "timeout", "n_files", "cmd", "target",
    )


EXEC_LOG_PARSE = f"""WITH {with_views("log_v")}, split AS (SELECT line_no, line,
  regexp_extract(line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}},\\d{{3}}) ([A-Z]+) (.*)$', ['stamp', 'level', 'msg']) AS p
 FROM log_v), parts AS (SELECT line_no, p.stamp AS stamp, p.level AS level,
  regexp_extract(p.msg, '^exec image=(\\S+) network=(\\S+) raw=(\\S+)\\(granted=([A-Za-z]+)\\) timeout=(\\d+)s files=(\\d+) cmd=''(.*)''$',
   ['image', 'network', 'raw', 'granted', 'timeout', 'files', 'cmd']) AS e,
  regexp_extract(p.msg, '^timeout after (\\d+)s; killing container (\\S+)$', ['s', 'c']) AS t,
  regexp_extract(p.msg, '^workdir (.+) not fully removed; using root-container cleanup$', 1) AS cleanup,
  regexp_extract(p.msg, '^workdir LEAK: could not remove (.+)$', 1) AS leak FROM split)
SELECT line_no, CASE WHEN stamp <> '' THEN epoch_ms(strptime(stamp, '%Y-%m-%d %H:%M:%S,%g')) END AS log_ms,
 nullif(level, '') AS level,
 CASE WHEN e.image <> '' THEN 'exec' WHEN t.s <> '' THEN 'timeout_kill' WHEN cleanup <> '' THEN 'partial_cleanup'
  WHEN leak <> '' THEN 'leak' ELSE 'other' END AS kind,
 nullif(e.image, '') AS image, nullif(e.network, '') AS network,
 CASE WHEN e.raw <> '' THEN e.raw = 'True' END AS raw, CASE WHEN e.granted <> '' THEN e.granted = 'True' END AS granted,
 CAST(coalesce(nullif(e.timeout, ''), nullif(t.s, '')) AS INTEGER) AS timeout,
 CAST(nullif(e.files, '') AS INTEGER) AS n_files, nullif(e.cmd, '') AS cmd,
 coalesce(nullif(t.c, ''), nullif(cleanup, ''), nullif(leak, '')) AS target
FROM parts"""


def secret_scan(spark, sf):
    found = logs.secret_scan(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "pattern", "hits", F.array_join("matches", "|").alias("matches"))


SECRET_SCAN = """WITH patterns(pattern, regex) AS (VALUES
 ('bearer_header', 'Authorization: Bearer [A-Za-z0-9._~+/=-]+'), ('token_assignment', 'token = "[^"]+"')),
found AS (SELECT doc_id, pattern, regexp_extract_all(text, regex) AS m FROM documents, patterns)
SELECT doc_id, pattern, CAST(len(m) AS INTEGER) AS hits, array_to_string(m, '|') AS matches
FROM found WHERE len(m) > 0"""


def secret_redact(spark, sf):
    return logs.secret_redact(table(spark, sf, "documents").select("doc_id", "text"), "text")


SECRET_REDACT = """SELECT doc_id, regexp_replace(regexp_replace(text, 'Authorization: Bearer [A-Za-z0-9._~+/=-]+',
 '[redacted]', 'g'), 'token = "[^"]+"', '[redacted]', 'g') AS text FROM documents"""


# Planted secrets: a short one, one with punctuation, one inside other characters, one with a space.
PLANTED = ["a1b2c3d4e5f", "p.q/r+s=t", "Zz-_long-token-0123456789", "two words"]


def _planted(spark, sf):
    """Documents, some of them with a secret after, between or inside other text."""
    secret = F.element_at(F.array(*[F.lit(x) for x in PLANTED]), (F.col("doc_id") % 4 + 1).cast("int"))
    text = (
        F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" key: "), secret, F.lit(".")))
        .when(F.col("doc_id") % 9 == 1, F.concat(F.lit("curl 'x"), secret, F.lit("y' "), F.col("text")))
        .when(F.col("doc_id") % 9 == 2, F.concat(F.col("text"), F.lit("\n"), secret))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("text"))


PLANTED_SQL = f"""planted AS (SELECT doc_id, source, CASE doc_id % 9 WHEN 0 THEN concat(text, ' key: ', secret, '.')
  WHEN 1 THEN concat('curl ''x', secret, 'y'' ', text) WHEN 2 THEN concat(text, chr(10), secret) ELSE text END AS text
 FROM (SELECT *, {PLANTED!r}[doc_id % 4 + 1] AS secret FROM documents))"""


def known_secret_scan(spark, sf):
    """By hash: the words of the texts against hashes of planted secrets and of token assignments elsewhere."""
    docs = _planted(spark, sf)
    words = F.regexp_extract_all("text", F.lit('token = "([^"]+)"'), F.lit(1))
    assigned = docs.where(F.col("source") != "src0").select(F.explode(words).alias("w"))
    known = assigned.unionByName(small_table(spark, [(x,) for x in PLANTED], "w string"))
    return logs.known_secret_scan(docs, "doc_id", "text", known.select(F.sha2("w", 256).alias("sha256")))


WORD_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, unnest(regexp_extract_all(text, '{w}')) AS w FROM planted"
    for w in (word.replace("'", "''") for word in logs.WORD_PATTERNS)
)
KNOWN_SECRET_SCAN = f"""WITH {PLANTED_SQL}, known AS (SELECT DISTINCT sha256(w) AS sha256 FROM (
  SELECT unnest(regexp_extract_all(text, 'token = "([^"]+)"', 1)) AS w FROM planted WHERE source <> 'src0'
  UNION ALL SELECT unnest({PLANTED!r})))
SELECT DISTINCT doc_id, sha256(w) AS sha256 FROM ({WORD_RUNS}) WHERE sha256(w) IN (SELECT sha256 FROM known)"""


def known_secret_values(spark, sf):
    """By value: anything goes, wherever it stands."""
    known = small_table(spark, [(x,) for x in PLANTED], "secret string")
    return logs.known_secret_scan(_planted(spark, sf), "doc_id", "text", known)


VALUES_SQL = """SELECT doc_id, sha256(secret) AS sha256 FROM planted JOIN known ON contains(text, secret)"""
KNOWN_SECRET_VALUES = f"WITH {PLANTED_SQL}, known AS (SELECT unnest({PLANTED!r}) AS secret) {VALUES_SQL}"


def known_secret_table(spark, sf):
    """By value, the long-list way: a secret per customer next to the planted ones."""
    names = table(spark, sf, "customer").select(F.concat(F.lit("key-"), F.md5(F.col("c_custkey").cast("string"))).alias("secret"))
    known = names.unionByName(small_table(spark, [(x,) for x in PLANTED], "secret string"))
    docs = _planted(spark, sf).withColumn("text", F.concat("text", F.lit(" key-"), F.md5((F.col("doc_id") * 3).cast("string")), F.lit("z")))
    return logs.known_secret_scan(docs, "doc_id", "text", known)


KNOWN_SECRET_TABLE = f"""WITH {PLANTED_SQL.replace("planted AS", "first_planted AS")},
planted AS (SELECT doc_id, concat(text, ' key-', md5(CAST(doc_id * 3 AS VARCHAR)), 'z') AS text FROM first_planted),
known AS (SELECT concat('key-', md5(CAST(c_custkey AS VARCHAR))) AS secret FROM customer UNION ALL SELECT unnest({PLANTED!r})) {VALUES_SQL}"""

QUERIES = {
    "request_parse": (request_parse, REQUEST_PARSE),
    "request_validate": (request_validate, REQUEST_VALIDATE),
    "profile_resolve": (profile_resolve, PROFILE_RESOLVE),
    "grant_derive": (grant_derive, GRANT_DERIVE),
    "files_decode": (files_decode, FILES_DECODE),
    "files_bad_requests": (files_bad_requests, FILES_BAD_REQUESTS),
    "output_cap": (output_cap, OUTPUT_CAP),
    "outcome_label": (outcome_label, OUTCOME_LABEL),
    "status_classify": (status_classify, STATUS_CLASSIFY),
    "status_counts": (status_counts, STATUS_COUNTS),
    "status_ip_limit": (status_ip_limit, STATUS_IP_LIMIT),
    "exec_log_parse": (exec_log_parse, EXEC_LOG_PARSE),
    "secret_scan": (secret_scan, SECRET_SCAN),
    "secret_redact": (secret_redact, SECRET_REDACT),
    "known_secret_scan": (known_secret_scan, KNOWN_SECRET_SCAN),
    "known_secret_values": (known_secret_values, KNOWN_SECRET_VALUES),
    "known_secret_table": (known_secret_table, KNOWN_SECRET_TABLE),
}
