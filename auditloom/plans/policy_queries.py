"""Registered queries over flows and policy, with their SQL answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions.net import IPV4_PATTERN, block_size, ip_to_long
from auditloom.functions.sizing import small_table
from auditloom.operators import policy
from auditloom.plans.views import table, view, with_views

SUBNET = policy.range_of(policy.SOURCE_SUBNET)

BLOCKS_SQL = """blocks(stage, seq, cidr, lo, hi) AS (VALUES
 ('raw', 1, '100.64.0.0/10', 1681915904, 1686110207), ('forward', 1, '100.64.0.0/10', 1681915904, 1686110207),
 ('forward', 2, '10.0.0.0/8', 167772160, 184549375), ('forward', 3, '172.16.0.0/12', 2886729728, 2887778303),
 ('forward', 4, '192.168.0.0/16', 3232235520, 3232301055), ('forward', 5, '169.254.0.0/16', 2851995648, 2852061183))"""


def cidr_match(spark, sf):
    forward = policy.block_list(spark).where("stage = 'forward'").select("cidr", "prefix_len", "lo", "hi")
    flows = view(spark, sf, "flows_v").select("flow_id", "dst_ip")
    return policy.cidr_match(flows, "dst_ip", forward).select("flow_id", "dst_ip", "cidr")


CIDR_MATCH = f"""WITH {with_views("flows_v")}, {BLOCKS_SQL}
SELECT flow_id, dst_ip, cidr FROM flows_v JOIN blocks ON dst_ip BETWEEN lo AND hi WHERE stage = 'forward'"""


def cidr_match_table(spark, sf):
    """The long-list way: one network of 16 or 20 bits per customer as the list."""
    cidrs = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, 16).otherwise(20).cast("int").alias("prefix_len"),
        (F.col("c_custkey") * 2654435761 % 16777216 * 256).alias("_base"),
    )
    size = block_size(F.col("prefix_len"))
    base = F.col("_base")
    lo = base - base % size
    listed = (
        cidrs.select("prefix_len", lo.alias("lo"), (lo + size - 1).alias("hi"))
        .distinct()
        .withColumn("cidr", F.concat_ws("/", "lo", "prefix_len"))
    )
    flows = view(spark, sf, "flows_v").select("flow_id", "dst_ip")
    return policy.cidr_match(flows, "dst_ip", listed).select("flow_id", "cidr")


CIDR_MATCH_TABLE = f"""WITH {with_views("flows_v")}, nets AS (
 SELECT CASE WHEN c_custkey % 3 = 0 THEN 16 ELSE 20 END AS prefix_len,
  (c_custkey * 2654435761 % 16777216) * 256 AS base FROM customer),
listed AS (SELECT DISTINCT prefix_len, base - base % (1 << (32 - prefix_len)) AS lo FROM nets)
SELECT flow_id, concat(lo, '/', prefix_len) AS cidr FROM flows_v
 JOIN listed ON dst_ip BETWEEN lo AND lo + (1 << (32 - prefix_len)) - 1"""


def cidr_match_mixed(spark, sf):
    """Ranges of any shape: unaligned, single addresses, turned around, without an end, wide ones."""
    key = F.col("c_custkey")
    lo = key * 2654435761 % 4294967296
    ranges = table(spark, sf, "customer").select(
        key.alias("range_id"),
        F.when(key % 11 != 0, lo).alias("lo"),
        F.when(key % 13 != 0, lo + F.when(key % 7 == 0, 0).when(key % 5 == 0, -9).otherwise(key * 7919 % 40000000)).alias("hi"),
    )
    flows = view(spark, sf, "flows_v").select("flow_id", "dst_ip")
    return policy.cidr_match(flows, "dst_ip", ranges).select("flow_id", "range_id")


CIDR_MATCH_MIXED = f"""WITH {with_views("flows_v")}, bases AS (
 SELECT c_custkey AS k, c_custkey * 2654435761 % 4294967296 AS b FROM customer),
ranges AS (SELECT k AS range_id, CASE WHEN k % 11 <> 0 THEN b END AS lo,
  CASE WHEN k % 13 <> 0 THEN b + CASE WHEN k % 7 = 0 THEN 0 WHEN k % 5 = 0 THEN -9 ELSE k * 7919 % 40000000 END END AS hi FROM bases)
SELECT flow_id, range_id FROM flows_v JOIN ranges ON dst_ip BETWEEN lo AND hi"""


def cidr_first_match_table(spark, sf):
    """The narrowest of the ranges that hold an address, the ranges of any shape as above."""
    key = F.col("c_custkey")
    lo = key * 2654435761 % 4294967296
    ranges = table(spark, sf, "customer").select(
        key.alias("range_id"), lo.alias("lo"), (lo + F.when(key % 7 == 0, 0).otherwise(key * 7919 % 40000000)).alias("hi")
    )
    flows = view(spark, sf, "flows_v").select("flow_id", "dst_ip")
    return policy.cidr_first_match(flows, "dst_ip", ranges, F.col("hi") - F.col("lo")).select("flow_id", "range_id")


CIDR_FIRST_MATCH_TABLE = f"""WITH {with_views("flows_v")}, ranges AS (SELECT c_custkey AS range_id, c_custkey * 2654435761 % 4294967296 AS lo,
  c_custkey * 2654435761 % 4294967296 + CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 7919 % 40000000 END AS hi FROM customer)
SELECT flow_id, range_id FROM flows_v LEFT JOIN ranges ON dst_ip BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY hi - lo, range_id) = 1"""


def cidr_match_text(spark, sf):
    """Addresses written in documents, tagged with the networks of those in every other document."""
    found = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(IPV4_PATTERN), F.lit(0))).alias("ip")
    )
    addresses = found.withColumn("ip_num", ip_to_long(F.col("ip")))
    nets = (
        addresses.where("doc_id % 2 = 0 AND ip_num IS NOT NULL")
        .select((F.col("ip_num") - F.col("ip_num") % 1048576).alias("lo"))
        .distinct()
        .select("lo", (F.col("lo") + 1048575).alias("hi"), F.concat_ws("/", "lo", F.lit(12)).alias("cidr"))
    )
    tagged = policy.cidr_match(addresses, "ip_num", nets)
    return tagged.groupBy("doc_id", "ip", "ip_num", "cidr").agg(F.count("*").alias("n"))


CIDR_MATCH_TEXT = """WITH found AS (
 SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')) AS ip FROM documents),
parts AS (SELECT doc_id, ip, list_transform(string_split(ip, '.'), lambda o: CAST(o AS BIGINT)) AS o FROM found),
numbered AS (SELECT doc_id, ip, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS ip_num FROM parts
 WHERE o[1] < 256 AND o[2] < 256 AND o[3] < 256 AND o[4] < 256),
nets AS (SELECT DISTINCT ip_num - ip_num % 1048576 AS lo FROM numbered WHERE doc_id % 2 = 0)
SELECT doc_id, ip, ip_num, concat(lo, '/12') AS cidr, count(*) AS n FROM numbered JOIN nets ON ip_num BETWEEN lo AND lo + 1048575
GROUP BY ALL"""


def toggle_asof(spark, sf):
    flows = view(spark, sf, "flows_v").select("flow_id", "ts_us", "site")
    return policy.toggle_asof(flows, view(spark, sf, "toggles_v"), "ts_us", "site", "change_id").select(
        "flow_id", "kill_switch"
    )


TOGGLED = f"""{with_views("flows_v", "toggles_v")}, settings AS (
 SELECT site, ts_us, max_by(action, change_id) = 'up' AS switched FROM toggles_v WHERE action <> 'down' GROUP BY site, ts_us),
switched AS (SELECT f.*, coalesce(s.switched, false) AS kill_switch
 FROM flows_v f ASOF LEFT JOIN settings s ON f.site = s.site AND f.ts_us >= s.ts_us)"""
TOGGLE_ASOF = f"WITH {TOGGLED} SELECT flow_id, kill_switch FROM switched"


def toggle_asof_table(spark, sf):
    """The long-list way: a change per error or purchase."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
    changes = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select(
        F.col("event_id").alias("change_id"), F.expr(micros).alias("ts_us"), (F.col("user_id") % 5).alias("site"),
        F.when(F.col("event_id") % 3 == 0, "up").when(F.col("event_id") % 3 == 1, "disable").otherwise("down").alias("action"),
    )
    flows = view(spark, sf, "flows_v").select("flow_id", "ts_us", "site")
    return policy.toggle_asof(flows, changes, "ts_us", "site", "change_id", hot_rows=1000).select("flow_id", "kill_switch")


TOGGLE_ASOF_TABLE = f"""WITH {with_views("flows_v")}, changes AS (SELECT event_id AS change_id, epoch_us(ts) AS ts_us, user_id % 5 AS site,
  CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'disable' ELSE 'down' END AS action
 FROM events WHERE event_type IN ('error', 'purchase')),
settings AS (SELECT site, ts_us, max_by(action, change_id) = 'up' AS switched FROM changes WHERE action <> 'down' GROUP BY site, ts_us)
SELECT flow_id, coalesce(s.switched, false) AS kill_switch
FROM flows_v f ASOF LEFT JOIN settings s ON f.site = s.site AND f.ts_us >= s.ts_us"""


def egress_verdict(spark, sf):
    switched = policy.toggle_asof(
        view(spark, sf, "flows_v"), view(spark, sf, "toggles_v"), "ts_us", "site", "change_id"
    )
    judged = policy.egress_verdict(switched, policy.block_list(spark), SUBNET, F.col("kill_switch"))
    return judged.select("flow_id", "verdict", "stage", "rule")


EGRESS_VERDICT = f"""WITH {TOGGLED}, {BLOCKS_SQL}, hits AS (
 SELECT flow_id, 1 AS step, -seq AS pos, stage, cidr AS rule FROM switched JOIN blocks ON dst_ip BETWEEN lo AND hi
  WHERE stage = 'raw' AND src_ip BETWEEN {SUBNET[0]} AND {SUBNET[1]}
 UNION ALL SELECT flow_id, 2, 0, 'killswitch', 'killswitch' FROM switched
  WHERE kill_switch AND out_iface <> 'wg0' AND src_ip BETWEEN {SUBNET[0]} AND {SUBNET[1]}
 UNION ALL SELECT flow_id, 3, -seq, stage, cidr FROM switched JOIN blocks ON dst_ip BETWEEN lo AND hi
  WHERE stage = 'forward' AND src_ip BETWEEN {SUBNET[0]} AND {SUBNET[1]}),
first AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY step, pos) = 1)
SELECT s.flow_id, CASE WHEN f.stage IS NULL THEN 'accept' ELSE 'drop' END AS verdict, f.stage, f.rule
FROM switched s LEFT JOIN first f USING (flow_id)"""



def egress_verdict_table(spark, sf):
    """The long-list way: a block of either stage per customer."""
    key = F.col("c_custkey")
    base = key * 2654435761 % 4294967296
    blocks = table(spark, sf, "customer").select(
        F.when(key % 4 == 0, "raw").otherwise("forward").alias("stage"), key.cast("int").alias("seq"),
        F.concat(F.lit("b"), key).alias("cidr"), base.alias("lo"), (base + key * 7919 % 9000000).alias("hi"),
    )
    judged = policy.egress_verdict(view(spark, sf, "flows_v"), blocks, SUBNET, F.col("flow_id") % 10 == 0)
    return judged.select("flow_id", "verdict", "stage", "rule")


EGRESS_VERDICT_TABLE = f"""WITH {with_views("flows_v")}, switched AS (SELECT *, flow_id % 10 = 0 AS kill_switch FROM flows_v),
blocks AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'raw' ELSE 'forward' END AS stage, c_custkey AS seq, concat('b', c_custkey) AS cidr,
  c_custkey * 2654435761 % 4294967296 AS lo, c_custkey * 2654435761 % 4294967296 + c_custkey * 7919 % 9000000 AS hi FROM customer),
hits AS""" + EGRESS_VERDICT.partition("hits AS")[2]

RULE_ROWS = [(policy.RULE_PREF, *SUBNET, policy.TUNNEL_TABLE), (32766, 0, 4294967295, "main")]
ROUTE_ROWS = [
    ("51820", 0, 0, 4294967295, "wg0"),
    ("main", 0, 0, 4294967295, "eth0"),
    ("main", 8, 167772160, 184549375, "lan0"),
    ("main", 10, 1681915904, 1686110207, "mesh0"),
]
RULE_SCHEMA = "pref int, src_lo bigint, src_hi bigint, table_name string"
ROUTE_SCHEMA = "table_name string, prefix_len int, lo bigint, hi bigint, via string"


def policy_route(spark, sf):
    rules = small_table(spark, RULE_ROWS, RULE_SCHEMA)
    routes = small_table(spark, ROUTE_ROWS, ROUTE_SCHEMA)
    return policy.policy_route(view(spark, sf, "flows_v"), rules, routes).select(
        "flow_id", "table_name", "via"
    )


POLICY_ROUTE = f"""WITH {with_views("flows_v")},
rules(pref, src_lo, src_hi, table_name) AS (VALUES {", ".join(map(str, RULE_ROWS))}),
routes(table_name, prefix_len, lo, hi, via) AS (VALUES {", ".join(map(str, ROUTE_ROWS))})
SELECT flow_id, r.table_name, via FROM flows_v JOIN rules r ON src_ip BETWEEN src_lo AND src_hi
 JOIN routes t ON t.table_name = r.table_name AND dst_ip BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY pref, prefix_len DESC) = 1"""


def policy_route_table(spark, sf):
    """The long-list way: fifty source rules, a table each, a route per customer, a default below them."""
    key = F.col("c_custkey")
    length = F.when(key % 3 == 0, 2).when(key % 3 == 1, 4).otherwise(6).cast("int")
    size = block_size(length)
    base = key * 2654435761 % 4294967296
    lo = base - base % size
    routes = table(spark, sf, "customer").select(
        F.concat(F.lit("t"), key % 50).alias("table_name"), length.alias("prefix_len"), lo.alias("lo"), (lo + size - 1).alias("hi"),
        F.concat(F.lit("via"), key).alias("via"),
    ).unionByName(small_table(spark, ROUTE_ROWS[1:2], ROUTE_SCHEMA))
    rules = spark.range(50).select(
        (F.col("id") + 100).cast("int").alias("pref"), (F.col("id") * 5 + SUBNET[0]).alias("src_lo"),
        (F.col("id") * 5 + SUBNET[0] + 9).alias("src_hi"), F.concat(F.lit("t"), "id").alias("table_name"),
    ).unionByName(small_table(spark, RULE_ROWS[1:], RULE_SCHEMA))
    return policy.policy_route(view(spark, sf, "flows_v"), rules, routes).select("flow_id", "table_name", "via")


POLICY_ROUTE_TABLE = f"""WITH {with_views("flows_v")}, sized AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 6 END AS prefix_len,
  c_custkey * 2654435761 % 4294967296 AS base FROM customer),
routes AS (SELECT concat('t', k % 50) AS table_name, prefix_len, base - base % (1::BIGINT << (32 - prefix_len)) AS lo, concat('via', k) AS via FROM sized
 UNION ALL SELECT 'main', 0, 0, 'eth0'),
rules AS (SELECT id + 100 AS pref, id * 5 + {SUBNET[0]} AS src_lo, id * 5 + {SUBNET[0] + 9} AS src_hi, concat('t', id) AS table_name FROM range(50) r(id)
 UNION ALL SELECT 32766, 0, 4294967295, 'main')
SELECT flow_id, r.table_name, via FROM flows_v JOIN rules r ON src_ip BETWEEN src_lo AND src_hi
 JOIN routes t ON t.table_name = r.table_name AND dst_ip BETWEEN lo AND lo + (1::BIGINT << (32 - prefix_len)) - 1
QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY pref, prefix_len DESC, via) = 1"""


def ruleset_reconcile(spark, sf):
    part = table(spark, sf, "part")
    mark = F.when(F.col("p_size") % 5 == 0, F.lit("other")).otherwise(F.lit("mine")).alias("mark")
    desired = part.where("p_size < 40").select(
        F.col("p_brand").alias("chain"), F.col("p_size").alias("port"), mark
    ).distinct()
    actual = part.where("p_size > 8").select(
        F.col("p_brand").alias("chain"), (F.col("p_size") + 1).alias("port"), mark
    )
    return policy.ruleset_reconcile(desired, actual, ["chain", "port"], "mine")


RULESET_RECONCILE = """WITH marked AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'other' ELSE 'mine' END AS mark FROM part),
want AS (SELECT DISTINCT p_brand AS chain, p_size AS port FROM marked WHERE p_size < 40 AND mark = 'mine'),
have AS (SELECT p_brand AS chain, p_size + 1 AS port, count(*) AS copies FROM marked
 WHERE p_size > 8 AND mark = 'mine' GROUP BY ALL)
SELECT coalesce(w.chain, h.chain) AS chain, coalesce(w.port, h.port) AS port, coalesce(copies, 0) AS copies,
 CASE WHEN h.chain IS NULL THEN 'add' WHEN w.chain IS NULL THEN 'remove' WHEN copies > 1 THEN 'drop_duplicates'
  ELSE 'keep' END AS action
FROM want w FULL JOIN have h ON w.chain = h.chain AND w.port = h.port"""


def mtu_drop_profile(spark, sf):
    limits = small_table(spark, [("wg0", 400), ("tun9", 1500)], "path string, mtu bigint")
    return policy.mtu_drop_profile(view(spark, sf, "flows_v"), limits, "out_iface")


MTU_DROP_PROFILE = f"""WITH {with_views("flows_v")}, limits(path, mtu) AS (VALUES ('wg0', 400::BIGINT), ('tun9', 1500::BIGINT)),
counted AS (SELECT out_iface AS path, mtu, count(*) AS packets, count(*) FILTER (size > mtu) AS large,
  count(*) FILTER (size > mtu AND df) AS dropped, max(size) FILTER (NOT coalesce(size > mtu AND df, false)) AS largest_passed
 FROM flows_v LEFT JOIN limits ON out_iface = path GROUP BY out_iface, mtu)
SELECT *, dropped / packets AS drop_share, dropped > 0 AND dropped = large AND packets > large AS black_hole FROM counted"""


def scope_check(spark, sf):
    domains = table(spark, sf, "pages").where(F.col("url").startswith("http:")).select(
        F.regexp_extract("url", r"([a-z0-9-]+\.[a-z0-9-]+\.[a-z]+)(?:[/:?#]|$)", 1).alias("domain")
    ).distinct()
    return policy.scope_check(table(spark, sf, "pages").select("page_id", "url"), "url", domains).select(
        "page_id", "host", "in_scope"
    )


SCOPE_CHECK = """WITH domains AS (
 SELECT DISTINCT regexp_extract(url, '([a-z0-9-]+\\.[a-z0-9-]+\\.[a-z]+)(?:[/:?#]|$)', 1) AS domain FROM pages WHERE starts_with(url, 'http:')),
hosts AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, EXISTS (SELECT 1 FROM domains d WHERE host = d.domain OR ends_with(host, concat('.', d.domain))) AS in_scope
FROM hosts"""

def _commands(spark, sf, allowed):
    checked = policy.scope_check(view(spark, sf, "commands_v"), "command", allowed)
    return checked.select("command_id", F.array_join("hosts", " ").alias("hosts"), "host", "in_scope")


def scope_check_commands(spark, sf):
    """Commands with URLs, bare names and addresses, or several of them."""
    domains = [("example1.com",), ("h4.example4.com",), ("Example2.com",), ("10.1.1.7",), ("h30.example2.com",)]
    return _commands(spark, sf, small_table(spark, domains, "domain string"))


def scope_check_table(spark, sf):
    """The long-list way: a domain per customer."""
    key = F.col("c_custkey")
    domains = table(spark, sf, "customer").select(
        F.concat(F.lit("h"), key % 300, F.lit(".example"), key % 7, F.lit(".com")).alias("domain")
    )
    return _commands(spark, sf, domains)


def _commands_sql(domains):
    return f"""WITH {with_views("commands_v")}, domains AS ({domains}),
named AS (SELECT command_id, CASE WHEN named = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(named, ' ') END AS hosts FROM commands_v),
hosts AS (SELECT DISTINCT unnest(hosts) AS host FROM named),
fine AS (SELECT host FROM hosts WHERE EXISTS (SELECT 1 FROM domains d WHERE host = d.domain
 OR (ends_with(host, concat('.', d.domain)) AND NOT regexp_matches(host, '^[0-9.]+$')))),
bad AS (SELECT DISTINCT command_id FROM (SELECT command_id, unnest(hosts) AS host FROM named) WHERE host NOT IN (SELECT host FROM fine))
SELECT command_id, array_to_string(list_distinct_in_order, ' ') AS hosts, list_distinct_in_order[1] AS host,
 len(list_distinct_in_order) > 0 AND command_id NOT IN (SELECT command_id FROM bad) AS in_scope
FROM (SELECT command_id, list_filter(hosts, lambda h, i: list_position(hosts, h) = i) AS list_distinct_in_order FROM named)"""


SCOPE_CHECK_COMMANDS = _commands_sql(
    "SELECT unnest(['example1.com', 'h4.example4.com', 'example2.com', '10.1.1.7', 'h30.example2.com']) AS domain"
)
SCOPE_CHECK_TABLE = _commands_sql(
    "SELECT DISTINCT concat('h', c_custkey % 300, '.example', c_custkey % 7, '.com') AS domain FROM customer"
)

QUERIES = {
    "cidr_first_match_table": (cidr_first_match_table, CIDR_FIRST_MATCH_TABLE),
    "cidr_match_mixed": (cidr_match_mixed, CIDR_MATCH_MIXED),
    "toggle_asof_table": (toggle_asof_table, TOGGLE_ASOF_TABLE),
    "egress_verdict_table": (egress_verdict_table, EGRESS_VERDICT_TABLE),
    "policy_route_table": (policy_route_table, POLICY_ROUTE_TABLE),
    "scope_check_commands": (scope_check_commands, SCOPE_CHECK_COMMANDS),
    "scope_check_table": (scope_check_table, SCOPE_CHECK_TABLE),
    "cidr_match": (cidr_match, CIDR_MATCH),
    "cidr_match_table": (cidr_match_table, CIDR_MATCH_TABLE),
    "cidr_match_text": (cidr_match_text, CIDR_MATCH_TEXT),
    "egress_verdict": (egress_verdict, EGRESS_VERDICT),
    "toggle_asof": (toggle_asof, TOGGLE_ASOF),
    "policy_route": (policy_route, POLICY_ROUTE),
    "ruleset_reconcile": (ruleset_reconcile, RULESET_RECONCILE),
    "mtu_drop_profile": (mtu_drop_profile, MTU_DROP_PROFILE),
    "scope_check": (scope_check, SCOPE_CHECK),
}
