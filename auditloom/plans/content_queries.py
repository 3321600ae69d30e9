"""Registered queries over files and texts, with their SQL answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.functions.sizing import small_table
from auditloom.operators import content
from auditloom.plans.views import table


def _files(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"),
        F.encode("text", "UTF-8").alias("body"),
    )


FILES = """files AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, encode(text) AS body FROM documents)"""


def file_inventory(spark, sf):
    return content.file_inventory(_files(spark, sf), "path", "body")


INVENTORY = f"{FILES}, inventory AS (SELECT path, octet_length(body) AS size, sha256(body) AS sha256 FROM files)"
FILE_INVENTORY = f"WITH {INVENTORY} SELECT path, size, sha256 FROM inventory"


def duplicate_groups(spark, sf):
    return content.duplicate_groups(file_inventory(spark, sf), "path")


DUPLICATE_GROUPS = f"""WITH {INVENTORY}
SELECT sha256, size, count(*) AS copies, min(path) AS first_path, (count(*) - 1) * size AS spare_bytes
FROM inventory GROUP BY sha256, size HAVING count(*) > 1"""

GLOBS = ["src1/*", "*.en", "src?/*.de", "src10/1?.*"]


def glob_counts(spark, sf):
    return content.glob_counts(_files(spark, sf).select("path"), "path", GLOBS)


GLOB_COUNTS = f"""WITH {FILES}, globs("glob") AS (VALUES {", ".join(f"('{g}')" for g in GLOBS)})
SELECT "glob", count(*) AS files FROM files JOIN globs ON path GLOB "glob" GROUP BY 1"""


def pinned_hash_verify(spark, sf):
    docs = table(spark, sf, "documents")
    digest = F.sha2("text", 256)
    pins = docs.where("lang <> 'es'").select(
        F.col("doc_id"),
        F.when(F.col("source") == "src1", F.upper(digest))
        .when(F.col("source") == "src2", F.sha2(F.concat(F.lit("x"), F.col("text")), 256))
        .when(F.col("source") == "src3", F.lit(""))
        .otherwise(digest)
        .alias("pinned"),
    )
    found = docs.where("source <> 'src4'").select("doc_id", digest.alias("sha256"))
    return content.pinned_hash_verify(found, pins, "doc_id")


PINNED_HASH_VERIFY = """WITH pins AS (SELECT doc_id, CASE source WHEN 'src1' THEN sha256(text)
  WHEN 'src2' THEN sha256(concat('x', text)) WHEN 'src3' THEN NULL ELSE sha256(text) END AS pinned
 FROM documents WHERE lang <> 'es'),
found AS (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE source <> 'src4'),
judged AS (SELECT coalesce(p.doc_id, f.doc_id) AS doc_id, CASE WHEN pinned IS NULL THEN 'missing_pin'
  WHEN sha256 IS NULL THEN 'missing_file' WHEN sha256 = pinned THEN 'match' ELSE 'drift' END AS status
 FROM pins p FULL JOIN found f ON p.doc_id = f.doc_id)
SELECT doc_id, status, status <> 'match' AS failed FROM judged"""


def file_type_tag(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.encode("html", "UTF-8").alias("body")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.encode("text", "UTF-8").alias("body")
    )
    return content.file_type_tag(pages.unionByName(docs), "body").select("id", "file_type")


FILE_TYPE_TAG = f"""WITH bodies AS (SELECT concat('p', page_id) AS id, hex(encode(html)) AS body FROM pages
 UNION ALL SELECT concat('d', doc_id), hex(encode(text)) FROM documents)
SELECT id, CASE {" ".join(f"WHEN starts_with(body, '{p}') THEN '{k}'" for k, p in content.MAGIC)} ELSE 'data' END AS file_type
FROM bodies"""


def printable_strings(spark, sf):
    return content.printable_strings(table(spark, sf, "documents").select("doc_id", "text"), "text")


PRINTABLE_STRINGS = """WITH runs AS (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7E\\t]{8,}')[1:50] AS r FROM documents)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, r[pos] AS string FROM (
 SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS pos FROM runs)"""

RULES = [
    ("secret", "token = ", 1),
    ("markup", "###", 2), ("markup", "%%%", 2), ("markup", "&&&", 2), ("markup", "$$$", 2),
    ("license", "Copyright", 2), ("license", "License", 2),
    ("contact", "@", 2), ("contact", ".com", 2),
]
HITS = "CAST((length(text) - length(replace(text, literal, ''))) // length(literal) AS INTEGER)"
RULE_VERDICTS = f"""counted AS (SELECT doc_id, rule, needed, {HITS} AS n FROM documents, rules WHERE contains(text, literal))
SELECT doc_id, rule, CAST(count(*) AS INTEGER) AS matched, CAST(sum(n) AS INTEGER) AS hits FROM counted
GROUP BY doc_id, rule, needed HAVING count(*) >= needed"""


def pattern_rules(spark, sf):
    rules = small_table(spark, RULES, "rule string, literal string, needed int")
    return content.pattern_rules(table(spark, sf, "documents"), "doc_id", "text", rules)


PATTERN_RULES = f"""WITH rules(rule, literal, needed) AS (VALUES {", ".join(map(str, RULES))}), {RULE_VERDICTS}"""


def pattern_rules_table(spark, sf):
    """The long-list way: the long words of each benchmark item, five of them needed."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))))
    rules = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item-"), "item_id").alias("rule"), words.alias("literal"), F.lit(5).alias("needed")
    )
    return content.pattern_rules(table(spark, sf, "documents"), "doc_id", "text", rules)


PATTERN_RULES_TABLE = f"""WITH rules AS (SELECT DISTINCT concat('item-', item_id) AS rule,
  unnest(regexp_extract_all(text, '[A-Za-z]{{7,}}')) AS literal, 5 AS needed FROM benchmark), {RULE_VERDICTS}"""



def pattern_rules_any_id(spark, sf):
    """The long-list way over rows without an id and rows that share one."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))))
    rules = table(spark, sf, "benchmark").select(F.lit("any").alias("rule"), words.alias("literal"), F.lit(3).alias("needed"))
    items = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 != 0, F.expr("doc_id div 4")).alias("item"), "text")
    return content.pattern_rules(items, "item", "text", rules)


PATTERN_RULES_ANY_ID = """WITH lits AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark),
hits AS (SELECT doc_id, (length(text) - length(replace(text, w, ''))) // length(w) AS n FROM documents JOIN lits ON contains(text, w)),
held AS (SELECT doc_id, count(*) AS matched, sum(n) AS hits FROM hits GROUP BY doc_id HAVING count(*) >= 3)
SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id // 4 END AS item, 'any' AS rule, CAST(matched AS INTEGER) AS matched, CAST(hits AS INTEGER) AS hits FROM held"""


def pattern_rules_mixed(spark, sf):
    """A thousand patterns of all kinds, words of the benchmark items turned into texts, regular expressions and hex; six conditions."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))))
    listed = table(spark, sf, "benchmark").select(words.alias("w")).distinct().withColumn("i", F.row_number().over(Window.orderBy("w"))).where("i <= 990")
    spaced = F.trim(F.regexp_replace(F.hex(F.encode("w", "UTF-8")), "(..)", "$1 "))
    pattern = (
        F.when(F.col("i") % 4 == 0, F.col("w"))
        .when(F.col("i") % 4 == 1, F.concat(F.substring("w", 1, 4), F.lit("[a-z]{2,}s")))
        .when(F.col("i") % 4 == 2, F.concat(F.lit("[A-Z]?"), F.substring("w", 2, 30), F.lit(" +[a-z]+")))
        .otherwise(F.concat(F.substring(spaced, 1, 6), F.lit("?? "), F.substring(spaced, 10, 100)))
    )
    kind = F.when(F.col("i") % 4 == 0, "text").when(F.col("i") % 4 == 3, "hex").otherwise("regex")
    mixed = listed.select(F.concat(F.lit("r"), F.col("i") % 60).alias("rule"), kind.alias("kind"), pattern.alias("pattern"), (F.col("i") % 6 + 1).alias("needed"))
    loose = small_table(spark, LOOSE_RULES, "rule string, kind string, pattern string, needed int")
    return content.pattern_rules(table(spark, sf, "documents"), "doc_id", "text", mixed.unionByName(loose))


#: Patterns that no text is sure to be part of, and a hex pattern with a jump and alternatives; each with its SQL form.
LOOSE_RULES = [
    ("digits", "regex", "[0-9]{5,}", 2), ("digits", "regex", "cat|dog|tree", 2), ("jump", "hex", "74 68 [1-3] (61 | 65) ?? 74", 1), ("open", "hex", "?? 3? 3?", 1)
]
LOOSE_SQL = [("digits", "regex", "[0-9]{5,}", 2), ("digits", "regex", "cat|dog|tree", 2), ("jump", "hex", "74 68 (.. ){1,3}(61 |65 ).. 74 ", 1), ("open", "hex", ".. 3. 3. ", 1)]
PATTERN_RULES_MIXED = rf"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{6,}}')) AS w FROM benchmark),
listed AS (SELECT w, row_number() OVER (ORDER BY w) AS i, regexp_replace(hex(encode(w)), '(..)', '\1 ', 'g') AS h FROM words QUALIFY i <= 990),
rules AS (SELECT concat('r', i % 60) AS rule, CASE i % 4 WHEN 0 THEN 'text' WHEN 3 THEN 'hex' ELSE 'regex' END AS kind,
  CASE i % 4 WHEN 0 THEN w WHEN 1 THEN concat(w[1:4], '[a-z]{{2,}}s') WHEN 2 THEN concat('[A-Z]?', w[2:], ' +[a-z]+')
   ELSE concat(h[1:6], '.. ', h[10:]) END AS pattern, CAST(i % 6 + 1 AS INTEGER) AS needed FROM listed
 UNION ALL VALUES {", ".join(map(str, LOOSE_SQL))}),
docs AS (SELECT doc_id, text, regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g') AS h FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, rule, needed, CASE kind WHEN 'text' THEN (length(text) - length(replace(text, pattern, ''))) // length(pattern)
  WHEN 'regex' THEN len(regexp_extract_all(text, pattern)) ELSE len(regexp_extract_all(h, pattern)) END AS n FROM docs, rules)
SELECT doc_id, rule, CAST(count(*) FILTER (WHERE n > 0) AS INTEGER) AS matched, CAST(sum(n) AS INTEGER) AS hits
FROM hits GROUP BY doc_id, rule, needed HAVING count(*) FILTER (WHERE n > 0) >= needed"""

SIGNATURES = ["<a", "<li", "<script", "</p>", "é"]


def signature_scan(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    return content.signature_scan(pages, "page_id", "body", SIGNATURES)


SIGNATURE_SCAN = f"""WITH sigs(signature) AS (VALUES {", ".join(f"('{s}')" for s in SIGNATURES)}),
parts AS (SELECT page_id, signature, string_split(html, signature) AS p FROM pages, sigs),
pieces AS (SELECT page_id, signature, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM parts)
SELECT page_id, signature, CAST(sum(strlen(piece)) OVER (PARTITION BY page_id, signature ORDER BY i)
 + (i - 1) * strlen(signature) AS BIGINT) AS "offset" FROM pieces QUALIFY i < n"""



def signature_table(spark, sf):
    """Binary signatures from a table: two or three bytes, some with half a byte or a whole one left open."""
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(F.encode("html", "UTF-8"), F.unhex(F.sha2(F.col("html"), 256))).alias("body")
    )
    key = F.col("p_partkey")
    bytes_ = F.unhex(F.lpad(F.hex(key * 40503 % 65536), 4, "0"))
    mask = F.when(key % 3 == 0, F.unhex(F.lit("FFF0"))).when(key % 3 == 1, F.unhex(F.lit("0FFF")))
    parts = table(spark, sf, "part").where("p_partkey <= 300").select(F.concat(F.lit("p"), key).alias("signature"), bytes_.alias("bytes"), mask.alias("mask"))
    fixed = small_table(spark, BINARY_SIGNATURES, "signature string, hex string, open string").select(
        "signature", F.unhex("hex").alias("bytes"), F.unhex("open").alias("mask")
    )
    return content.signature_table_scan(pages, "page_id", "body", parts.unionByName(fixed))


BINARY_SIGNATURES = [("gzip", "1F8B", None), ("tag", "3C003E", "FF00FF"), ("word", "2061206E", "FFDFFFDF"), ("any", "0022", "00FF")]
#: Per fixed signature, its bytes in hex with a blank behind each, as a pattern.
FIXED_PATTERNS = [("gzip", 2, "1F 8B "), ("tag", 3, "3C .. 3E "), ("word", 4, "20 [46]1 20 [46]E "), ("any", 2, ".. 22 ")]
SIGNATURE_TABLE = rf"""WITH keyed AS (SELECT p_partkey AS k, lpad(printf('%X', p_partkey * 40503 % 65536), 4, '0') AS h FROM part WHERE p_partkey <= 300),
sigs AS (SELECT concat('p', k) AS signature, 2 AS n, CASE k % 3 WHEN 0 THEN concat(h[1:2], ' ', h[3], '. ')
  WHEN 1 THEN concat('.', h[2], ' ', h[3:4], ' ') ELSE concat(h[1:2], ' ', h[3:4], ' ') END AS pattern FROM keyed
 UNION ALL VALUES {", ".join(map(str, FIXED_PATTERNS))}),
bodies AS (SELECT page_id, regexp_replace(concat(hex(encode(html)), upper(sha256(html))), '(..)', '\1 ', 'g') AS body FROM pages WHERE html IS NOT NULL),
parts AS (SELECT page_id, signature, n, regexp_split_to_array(body, pattern) AS p FROM bodies JOIN sigs ON regexp_matches(body, pattern)),
pieces AS (SELECT page_id, signature, n, len(p) AS m, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM parts)
SELECT page_id, signature, CAST(sum(length(piece) // 3) OVER (PARTITION BY page_id, signature ORDER BY i)
 + (i - 1) * n AS BIGINT) AS "offset" FROM pieces QUALIFY i < m"""

KEYWORDS = {
    "script": "<script",
    "link": "href=\"",
    "iframe": "<iframe",
    "handler": "\\bon[a-z]+=",
    "style": "style",
    "entity": "&[a-z]+;",
}


def keyword_profile(spark, sf):
    return content.keyword_profile(table(spark, sf, "pages"), "page_id", "html", KEYWORDS)


def _count(regex):
    return f"CAST(len(regexp_extract_all(html, '{regex}')) AS INTEGER)"


KEYWORD_PROFILE = " UNION ALL ".join(
    f"SELECT page_id, '{name}' AS keyword, {_count(regex)} AS n FROM pages" for name, regex in KEYWORDS.items()
)


def keyword_flags(spark, sf):
    return content.keyword_flags(
        table(spark, sf, "pages"), "page_id", "html", KEYWORDS, ["iframe", "handler"]
    )


KEYWORD_FLAGS = f"""WITH wide AS (SELECT page_id, {", ".join(f"{_count(r)} AS {n}" for n, r in KEYWORDS.items())} FROM pages)
SELECT *, iframe > 0 OR handler > 0 AS suspicious FROM wide"""


def _findings(spark, sf):
    event = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.when(event == "error", "critical").when(event == "purchase", "high").when(event == "signup", "medium")
        .otherwise("low").alias("severity"),
        F.array(event, F.concat(F.lit("u"), F.col("user_id") % 7)).alias("tags"),
        F.when(F.col("value") < 5, 200).when(F.col("value") < 10, 301).when(F.col("value") < 20, 404)
        .otherwise(500).alias("status"),
    )


FINDINGS = """findings AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
  WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, [event_type, concat('u', user_id % 7)] AS tags,
 CASE WHEN value < 5 THEN 200 WHEN value < 10 THEN 301 WHEN value < 20 THEN 404 ELSE 500 END AS status FROM events)"""


def findings_filter(spark, sf):
    kept = content.findings_filter(
        _findings(spark, sf), ["critical", "high", "medium"], ["error", "u3", "u5"], [200, 301, 500]
    )
    return kept.select("event_id", "severity", F.array_join("tags", ",").alias("tags"), "status")


KEPT = """severity IN ('critical', 'high', 'medium')
 AND list_has_any(tags, ['error', 'u3', 'u5']) AND status IN (200, 301, 500)"""
FINDINGS_FILTER = f"""WITH {FINDINGS} SELECT event_id, severity, array_to_string(tags, ',') AS tags, status
FROM findings WHERE {KEPT}"""


def severity_counts(spark, sf):
    return content.severity_counts(
        content.findings_filter(_findings(spark, sf), tags=["error", "u3", "u5"])
    )


SEVERITY_COUNTS = f"""WITH {FINDINGS} SELECT severity, count(*) AS findings FROM findings
WHERE list_has_any(tags, ['error', 'u3', 'u5']) GROUP BY severity"""

QUERIES = {
    "file_inventory": (file_inventory, FILE_INVENTORY),
    "duplicate_groups": (duplicate_groups, DUPLICATE_GROUPS),
    "glob_counts": (glob_counts, GLOB_COUNTS),
    "pinned_hash_verify": (pinned_hash_verify, PINNED_HASH_VERIFY),
    "file_type_tag": (file_type_tag, FILE_TYPE_TAG),
    "printable_strings": (printable_strings, PRINTABLE_STRINGS),
    "pattern_rules": (pattern_rules, PATTERN_RULES),
    "pattern_rules_table": (pattern_rules_table, PATTERN_RULES_TABLE),
    "pattern_rules_any_id": (pattern_rules_any_id, PATTERN_RULES_ANY_ID),
    "pattern_rules_mixed": (pattern_rules_mixed, PATTERN_RULES_MIXED),
    "signature_scan": (signature_scan, SIGNATURE_SCAN),
    "signature_table": (signature_table, SIGNATURE_TABLE),
    "keyword_profile": (keyword_profile, KEYWORD_PROFILE),
    "keyword_flags": (keyword_flags, KEYWORD_FLAGS),
    "findings_filter": (findings_filter, FINDINGS_FILTER),
    "severity_counts": (severity_counts, SEVERITY_COUNTS),
}
