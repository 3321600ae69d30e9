"""Derived tables the registered queries run on.

Each view is one SQL text over the given tables. It runs in Spark and in DuckDB;
the few dialect differences are placeholders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {
        "{US}": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
        "{TS}": "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')",
        "{B64}": r"regexp_replace(base64(encode(text, 'UTF-8')), '[\r\n]', '')",
        "{IDIV}": "div",
    },
    "duckdb": {
        "{US}": "epoch_us(ts)",
        "{TS}": "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')",
        "{B64}": "base64(encode(text))",
        "{IDIV}": "//",
    },
}

VIEWS = {
    # One request with its response per event.
    "requests_v": """
SELECT event_id AS request_id, user_id AS k, {US} AS ts_us,
 CASE WHEN event_id % 50 = 0 THEN '' ELSE concat('tool ', event_type) END AS command,
 CASE WHEN event_id % 41 = 0 THEN 'bridge'
  WHEN event_type IN ('purchase', 'error') THEN 'egress' ELSE 'none' END AS network,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS timeout,
 CASE event_id % 4 WHEN 0 THEN 'heavy' WHEN 1 THEN 'base' WHEN 2 THEN NULL ELSE 'gpu' END AS image,
 event_id % 3 = 0 AS raw, event_id % 29 <> 0 AS auth_ok,
 event_id % 23 = 0 AS bad_base64, event_id % 97 = 0 AS is_corrupt,
 event_id % 11 = 0 AS timed_out,
 CASE WHEN event_id % 11 = 0 THEN 137 WHEN event_id % 7 = 0 THEN 1
  WHEN event_id % 31 = 0 THEN NULL ELSE 0 END AS exit_code,
 CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('SCAN-DONE ', props) END AS stdout,
 CASE WHEN event_id % 9 = 0 THEN concat('warn ', event_type) ELSE '' END AS stderr,
 CASE WHEN event_id % 211 = 0 THEN NULL ELSE {US} + CAST(floor(value * 1000) AS BIGINT) * 3600000 END AS end_us
FROM events""",
    # The same requests with one key that holds a fifth of them, half of those in daily bursts.
    "hot_requests_v": """
SELECT request_id, CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS k,
 CASE WHEN k % 10 = 0 THEN ts_us - ts_us % 86400000000 ELSE ts_us END AS ts_us,
 CASE WHEN end_us IS NULL AND k % 5 = 0 THEN ts_us ELSE end_us END AS end_us FROM requests_v""",
    # Commands that name one host, several, or none.
    "commands_v": """
SELECT event_id AS command_id, CASE event_id % 8
 WHEN 0 THEN concat('nmap -sS -Pn -F ', h1) WHEN 1 THEN concat('curl -o page.html https://', h1, '/a/b.txt http://', h2, ':8080/?q=x.y')
 WHEN 2 THEN concat('hydra -l root -P /srv/words.lst ', h1, ' ssh') WHEN 3 THEN 'ls -la /tmp/notes.txt'
 WHEN 4 THEN concat('ssh admin@', upper(h1), ' | tee run.log') WHEN 5 THEN concat('nmap 10.1.', CAST(user_id % 4 AS STRING), '.7/24 ', h2)
 WHEN 6 THEN concat('whatweb "', h1, '" ', h2) ELSE concat('dig ', h1, ' @10.1.1.7') END AS command,
 CASE event_id % 8 WHEN 3 THEN '' WHEN 1 THEN concat(h1, ' ', h2) WHEN 5 THEN concat('10.1.', CAST(user_id % 4 AS STRING), '.7 ', h2)
 WHEN 6 THEN CASE WHEN h1 = h2 THEN h1 ELSE concat(h1, ' ', h2) END WHEN 7 THEN concat(h1, ' 10.1.1.7') ELSE h1 END AS named
FROM (SELECT event_id, user_id, concat('h', CAST(event_id % 300 AS STRING), '.example', CAST(event_id % 7 AS STRING), '.com') AS h1,
 concat('h', CAST(user_id % 300 AS STRING), '.example', CAST(user_id % 7 AS STRING), '.com') AS h2 FROM events) AS hosts""",
    # The same requests as JSON bodies, some ill-typed, some cut off.
    "bodies_v": """
SELECT event_id AS request_id,
 CASE WHEN event_id % 97 = 0 THEN concat('{"command":"tool ', event_type)
 WHEN event_id % 101 = 0 THEN concat('["', event_type, '"]')
 ELSE concat('{"command":',
  CASE WHEN event_id % 50 = 0 THEN '""' WHEN event_id % 53 = 0 THEN '7'
   ELSE concat('"tool ', event_type, '"') END,
  CASE WHEN event_id % 41 = 0 THEN ',"network":"bridge"' WHEN event_id % 43 = 0 THEN ',"network":null'
   WHEN event_type IN ('purchase', 'error') THEN ',"network":"egress"' ELSE '' END,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"timeout":null'
   WHEN 2 THEN concat(',"timeout":"', CAST(CAST(floor(value * 10) AS INT) AS STRING), '"')
   WHEN 3 THEN concat(',"timeout":', CAST(CAST(floor(value * 10) AS INT) AS STRING), '.0')
   WHEN 4 THEN ',"timeout":"soon"'
   ELSE concat(',"timeout":', CAST(CAST(floor(value * 10) AS INT) AS STRING)) END,
  CASE event_id % 6 WHEN 0 THEN ',"image":"heavy"' WHEN 1 THEN ',"image":5'
   WHEN 2 THEN ',"image":["heavy"]' WHEN 3 THEN '' WHEN 4 THEN ',"image":"gpu"' ELSE ',"image":null' END,
  CASE event_id % 4 WHEN 0 THEN ',"raw":true' WHEN 1 THEN ',"raw":"yes"' WHEN 2 THEN '' ELSE ',"raw":0' END,
  CASE event_id % 10 WHEN 0 THEN ',"files":[{"name":"a.txt","b64":"aGk="}]'
   WHEN 1 THEN ',"files":[{"name":"../x","b64":""},{"name":"b.txt","b64":"aGk="}]'
   WHEN 2 THEN ',"files":null' ELSE '' END,
  ',"extra":1}') END AS body
FROM events""",
    # The responses as JSON.
    "responses_v": """
SELECT event_id AS request_id,
 CASE WHEN event_id % 89 = 0 THEN 'not json'
 ELSE concat('{"ok":', CASE WHEN event_id % 7 = 0 THEN 'false' ELSE 'true' END,
  ',"exit_code":', CAST(event_id % 3 AS STRING),
  CASE event_id % 6 WHEN 0 THEN ',"stdout":null' WHEN 1 THEN ',"stdout":false' WHEN 2 THEN ''
   ELSE concat(',"stdout":"', event_type, ' ', CAST(event_id AS STRING), '"') END,
  CASE WHEN event_id % 4 = 0 THEN ',"stderr":""' WHEN event_id % 4 = 1 THEN ''
   ELSE concat(',"stderr":"warn ', event_type, '"') END,
  ',"props":', props, '}') END AS body
FROM events""",
    # One network flow per event.
    "flows_v": """
SELECT event_id AS flow_id, {US} AS ts_us,
 CASE WHEN user_id % 4 = 0 THEN 167772160 ELSE 2887778048 END + user_id % 256 AS src_ip,
 CASE event_id % 8 WHEN 0 THEN 1681915904 + ((event_id * 2654435761) % 4294967296) % 4194304
  WHEN 1 THEN 167772160 + ((event_id * 2654435761) % 4294967296) % 16777216
  WHEN 2 THEN 2886729728 + ((event_id * 2654435761) % 4294967296) % 1048576
  WHEN 3 THEN 3232235520 + ((event_id * 2654435761) % 4294967296) % 65536
  WHEN 4 THEN 2851995648 + ((event_id * 2654435761) % 4294967296) % 65536
  ELSE ((event_id * 2654435761) % 4294967296) END AS dst_ip,
 CASE event_type WHEN 'error' THEN 'eth0' ELSE 'wg0' END AS out_iface,
 CAST(floor(value * 10) AS BIGINT) + 40 AS size, event_id % 2 = 0 AS df,
 user_id % 5 AS site
FROM events""",
    # Changes of the tunnel switch, one row per hundredth event of each site.
    "toggles_v": """
SELECT event_id AS change_id, {US} AS ts_us, user_id % 5 AS site,
 CASE CAST(floor(event_id / 100) AS BIGINT) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'disable' END AS action
FROM events WHERE event_type = 'error' AND user_id % 9 = 0""",
    # Service log lines.
    "log_v": """
SELECT event_id AS line_no,
 CASE WHEN event_id % 37 = 0
  THEN concat({TS}, ' WARNING timeout after ', CAST(5 + event_id % 595 AS STRING), 's; killing container c-', CAST(event_id AS STRING))
 WHEN event_id % 61 = 0
  THEN concat({TS}, ' WARNING workdir /w/', CAST(event_id AS STRING), ' not fully removed; using root-container cleanup')
 WHEN event_id % 67 = 0
  THEN concat({TS}, ' ERROR workdir LEAK: could not remove /w/', CAST(event_id AS STRING))
 WHEN event_id % 71 = 0 THEN concat('Traceback ', event_type)
 ELSE concat({TS}, ' INFO exec image=', CASE WHEN event_id % 4 = 0 THEN 'heavy' ELSE 'base' END,
  ' network=', CASE WHEN event_type = 'error' THEN 'egress' ELSE 'none' END,
  ' raw=', CASE WHEN event_id % 3 = 0 THEN 'True' ELSE 'False' END,
  '(granted=', CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'True' ELSE 'False' END,
  ') timeout=', CAST(5 + event_id % 595 AS STRING), 's files=', CAST(event_id % 4 AS STRING),
  ' cmd=''tool ', event_type, '''') END AS line
FROM events""",
    # Request attachments, up to three per request; every 17th text is damaged.
    "files_v": """
SELECT doc_id {IDIV} 3 AS request_id, doc_id % 3 AS pos,
 CASE WHEN doc_id % 5 = 0 THEN 'sample.bin' ELSE concat(source, '.txt') END AS name,
 CASE WHEN doc_id % 17 = 0 THEN concat({B64}, '!') ELSE {B64} END AS b64
FROM documents""",
    # Output of one probe run per event.
    "probes_v": """
SELECT event_id AS run,
 concat('start ', event_type, '\\nIP=172.31.255.', CAST(user_id % 256 AS STRING),
  '\\nPUBDNS=', CASE WHEN event_id % 9 = 0 THEN 'FAIL' ELSE 'OK' END,
  '\\nPUBIP=rc0 t', CAST(event_id % 4 AS STRING),
  CASE WHEN event_id % 6 = 0 THEN '\\nPEER=rc280 t6' ELSE '\\nPEER=rc28 t6' END,
  CASE WHEN event_id % 2 = 0 THEN '\\nMETA=rc28 t6' ELSE '\\nMETA_rc=28 t6' END,
  CASE WHEN event_id % 7 = 0 THEN '\\nRFC1918=rc0 t1' ELSE '\\nRFC1918=rc28 t6' END,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE '\\nMAGICDNS_rc=9' END) AS out
FROM events""",
}


def view_sql(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for mark, value in DIALECT[dialect].items():
        text = text.replace(mark, value)
    # A line break inside a literal is written the same way in both dialects.
    return text.replace("\\n", "\n")


def with_views(*names: str) -> str:
    """`WITH` list of the views for an oracle text."""
    return ", ".join(f"{name} AS ({view_sql(name, 'duckdb')})" for name in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCE = {"files_v": "documents"}
DEPENDS = {"hot_requests_v": ("requests_v",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE.get(name, "events")
    scan = f"FROM parquet.`{sf_dir}/{source}.parquet`"
    text = view_sql(name, "spark")
    for inner in DEPENDS.get(name, ()):
        text = text.replace(f"FROM {inner}", f"FROM ({view_sql(inner, 'spark')}) AS {inner}")
    return spark.sql(text.replace(f"FROM {source}", scan))
