"""Policy edges, and the long-list ways against the short ones."""

import ipaddress
import random

from pyspark.sql import functions as F

from auditloom.functions import net
from auditloom.functions import ranges as address_ranges
from auditloom.functions import sizing, skew
from auditloom.functions.net import ip_to_long
from auditloom.functions.sizing import small_table
from auditloom.operators import policy

SUBNET = (2887778048, 2887778303)


def num(ip):
    return int(ipaddress.ip_address(ip))


def test_ip_to_long(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "1.2.3.4.5", "a.b.c.d", "1.2.3.4\n", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", ip_to_long(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [num("1.2.3.4"), num("255.255.255.255"), 0] + [None] * 7


def test_block_bounds(spark):
    for r in policy.block_list(spark).collect():
        net = ipaddress.ip_network(r.cidr)
        assert (r.lo, r.hi, r.prefix_len) == (int(net[0]), int(net[-1]), net.prefixlen)


def test_cidr_match_short_and_long(spark):
    rng = random.Random(1)
    nets = {ipaddress.ip_network((rng.randrange(2**32) >> (32 - n) << (32 - n), n)) for n in (0, 1, 4, 8, 12, 16) for _ in range(25)}
    nets |= {ipaddress.ip_network("10.0.0.7/32")}
    ips = [rng.randrange(2**32) for _ in range(200)] + [num("10.0.0.7")]
    cidrs = policy.with_bounds(spark.createDataFrame([(str(n),) for n in nets], "cidr string"))
    df = spark.createDataFrame([(i,) for i in ips], "ip long")
    want = sorted((i, str(n)) for i in ips for n in nets if int(n[0]) <= i <= int(n[-1]))
    assert len(nets) > policy.RANGE_JOIN_BLOCKS
    assert sorted((r.ip, r.cidr) for r in policy.cidr_match(df, "ip", cidrs).collect()) == want
    few = cidrs.limit(10)
    kept = {r.cidr for r in few.collect()}
    got = sorted((r.ip, r.cidr) for r in policy.cidr_match(df, "ip", cidrs.where(F.col("cidr").isin(*kept))).collect())
    assert got == [w for w in want if w[1] in kept]


def test_verdict_order(spark):
    rows = [
        (1, "172.31.255.9", "100.64.1.1", "eth0"),
        (2, "10.0.0.1", "100.64.1.1", "eth0"),
        (3, "172.31.255.9", "10.1.1.1", "eth0"),
        (4, "172.31.255.9", "10.1.1.1", "wg0"),
        (5, "172.31.255.9", "8.8.8.8", "eth0"),
        (6, "172.31.255.9", "8.8.8.8", "wg0"),
    ]
    df = spark.createDataFrame([(i, num(s), num(d), o) for i, s, d, o in rows], "i int, src_ip long, dst_ip long, out_iface string")
    want = {1: ("drop", "raw"), 2: ("accept", None), 3: ("drop", "killswitch"), 4: ("drop", "forward"), 5: ("drop", "killswitch"), 6: ("accept", None)}
    got = policy.egress_verdict(df, policy.block_list(spark), SUBNET, True).collect()
    assert {r.i: (r.verdict, r.stage) for r in got} == want
    off = policy.egress_verdict(df, policy.block_list(spark), SUBNET, False).collect()
    assert {r.i: r.stage for r in off} == {1: "raw", 2: None, 3: "forward", 4: "forward", 5: None, 6: None}


def many_blocks(spark, rng, n):
    rows = []
    for stage in ("raw", "forward"):
        for seq in range(n):
            length = rng.choice([2, 4, 8])
            base = rng.randrange(2**32) >> (32 - length) << (32 - length)
            rows.append((stage, seq, str(ipaddress.ip_network((base, length)))))
    return policy.with_bounds(small_table(spark, rows, "stage string, seq int, cidr string"))


def test_verdict_long_list_equals_short(spark, monkeypatch):
    rng = random.Random(2)
    blocks = many_blocks(spark, rng, 20)
    flows = [(i, SUBNET[0] + rng.randrange(0, 300), rng.randrange(2**32), rng.choice(["wg0", "eth0"])) for i in range(300)]
    df = spark.createDataFrame(flows, "i int, src_ip long, dst_ip long, out_iface string")
    short = {r.i: tuple(r) for r in policy.egress_verdict(df, blocks, SUBNET, True).collect()}
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=5: sizing.policy_rows(t, min(n, 5)))
    long = {r.i: tuple(r) for r in policy.egress_verdict(df, blocks, SUBNET, True).collect()}
    assert short == long and len({v[-1] for v in short.values()}) > 5


def test_route_long_list_equals_short(spark, monkeypatch):
    rng = random.Random(3)
    rules = small_table(
        spark, [(1000, SUBNET[0], SUBNET[1], "t1"), (2000, 0, 2**32 - 1, "t2"), (3000, 0, 2**32 - 1, "t3")],
        "pref int, src_lo bigint, src_hi bigint, table_name string",
    )
    routes = []
    for table, lengths in (("t1", [1, 4]), ("t2", [2, 6]), ("t3", [0])):
        for length in lengths:
            for _ in range(4 if length else 1):
                base = rng.randrange(2**32) >> (32 - length) << (32 - length) if length else 0
                routes.append((table, length, base, base + 2 ** (32 - length) - 1, f"{table}-{length}"))
    routes = sorted(set(routes))
    route_df = small_table(spark, routes, "table_name string, prefix_len int, lo bigint, hi bigint, via string")
    flows = [(i, SUBNET[0] + rng.randrange(0, 500), rng.randrange(2**32)) for i in range(300)]
    df = spark.createDataFrame(flows, "i int, src_ip long, dst_ip long")
    want = {}
    for i, src, dst in flows:
        for _, lo, hi, table in [(1000, *SUBNET, "t1"), (2000, 0, 2**32, "t2"), (3000, 0, 2**32, "t3")]:
            hits = [r for r in routes if r[0] == table and r[2] <= dst <= r[3]] if lo <= src <= hi else []
            if hits:
                want[i] = (table, max(hits, key=lambda r: r[1])[4])
                break
    assert {r.i: (r.table_name, r.via) for r in policy.policy_route(df, rules, route_df).collect()} == want
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=5: sizing.policy_rows(t, min(n, 5)))
    assert {r.i: (r.table_name, r.via) for r in policy.policy_route(df, rules, route_df).collect()} == want


def test_reconcile(spark):
    desired = spark.createDataFrame([("a", 1, "m"), ("b", None, "m"), ("c", 3, "x")], "chain string, port int, mark string")
    actual = spark.createDataFrame(
        [("b", None, "m"), ("b", None, "m"), ("d", 4, "m"), ("e", 5, "x"), ("d", 4, "m")], "chain string, port int, mark string"
    )
    got = policy.ruleset_reconcile(desired, actual, ["chain", "port"], "m").collect()
    assert {(r.chain, r.port): (r.copies, r.action) for r in got} == {
        ("a", 1): (0, "add"), ("b", None): (2, "drop_duplicates"), ("d", 4): (2, "remove")
    }


def test_mtu_black_hole(spark):
    flows = spark.createDataFrame(
        [("wg0", 100, True), ("wg0", 1452, True), ("wg0", 1500, True), ("eth0", 1452, True), ("eth0", 1600, False)],
        "path string, size long, df boolean",
    )
    limits = small_table(spark, [("wg0", 1420), ("eth0", 1500)], "path string, mtu bigint")
    got = {r.path: (r.packets, r.dropped, r.largest_passed, r.black_hole) for r in policy.mtu_drop_profile(flows, limits, "path").collect()}
    assert got == {"wg0": (3, 2, 100, True), "eth0": (2, 0, 1600, False)}


def test_scope_short_and_long(spark, monkeypatch):
    rows = [
        (1, "curl https://a.example.com/x"), (2, "nmap http://example.com:80"), (3, "https://notexample.com"),
        (4, "no url"), (5, "https://A.B.Example.com?q"), (6, "https://other.org/https://example.com"),
    ]
    df = spark.createDataFrame(rows, "i int, command string")
    allowed = spark.createDataFrame([("Example.com",), ("x.net",)], "domain string")
    want = {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}
    assert {r.i: r.in_scope for r in policy.scope_check(df, "command", allowed).collect()} == want
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=1: sizing.policy_rows(t, 1))
    assert {r.i: r.in_scope for r in policy.scope_check(df, "command", allowed).collect()} == want


def test_joins_broadcast_small_sides_only(spark):
    df = spark.range(1000).withColumnRenamed("id", "ip")
    cidrs = policy.with_bounds(spark.createDataFrame([("0.0.0.0/24",)], "cidr string"))
    plan = policy.cidr_match(df, "ip", cidrs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan
    hinted = sizing.small_side(spark.range(400), 300)
    assert "ResolvedHint" not in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in sizing.small_side(spark.range(400), 500)._jdf.queryExecution().analyzed().toString()


def test_ranges_of_any_shape_short_and_long(spark):
    rng = random.Random(5)
    top = 2**32 - 1
    ranges = [(0, top), (5, 5), (top, top), (0, 0), (7, 3), (None, 9), (9, None), (None, None), (-5, 4), (top - 3, top + 9), (2**40, 2**41)]
    ranges += [(a, a + rng.choice([0, 1, 2, 1000, 10**6, 10**9])) for a in (rng.randrange(2**32) for _ in range(60))]
    ips = [0, 1, 4, 5, 6, top, top - 3, None, -2, top + 1] + [rng.randrange(2**32) for _ in range(60)]
    ips += [a for a, _ in ranges[11:]] + [b for _, b in ranges[11:]]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip long")
    listed = [(n, lo, hi) for n, (lo, hi) in enumerate(ranges)]
    table = spark.createDataFrame(listed, "n int, lo long, hi long")
    want = sorted(
        (i, n) for i, ip in enumerate(ips) for n, lo, hi in listed
        if None not in (ip, lo, hi) and lo <= ip <= hi and 0 <= ip <= top
    )
    assert len(ranges) > policy.RANGE_JOIN_BLOCKS
    assert sorted((r.i, r.n) for r in policy.cidr_match(df, "ip", table).collect()) == want
    few = table.where("n < 40")
    assert sorted((r.i, r.n) for r in policy.cidr_match(df, "ip", few).collect()) == [w for w in want if w[1] < 40]


def test_ranges_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    ranges = [(n, a, a + rng.randrange(10**8)) for n, a in enumerate(rng.randrange(2**32) for _ in range(80))]
    ips = [rng.randrange(2**32) for _ in range(50)] * 3 + [ranges[0][1]] * 300
    df = spark.createDataFrame(list(enumerate(ips)), "i int, ip long")
    table = spark.createDataFrame(ranges, "n int, lo long, hi long")
    want = sorted((i, n) for i, ip in enumerate(ips) for n, lo, hi in ranges if lo <= ip <= min(hi, 2**32 - 1))
    monkeypatch.setattr(policy, "is_small", lambda side: False)
    monkeypatch.setattr(policy, "spread_join", lambda rows, side, key: skew.spread_join(rows, side, key, hot_rows=100))
    assert sorted((r.i, r.n) for r in policy.cidr_match(df, "ip", table).collect()) == want


def test_no_rule_and_no_route(spark):
    flows = spark.createDataFrame([(1, 5, 6)], "i int, src_ip long, dst_ip long")
    rules = spark.createDataFrame([], "pref int, src_lo long, src_hi long, table_name string")
    routes = spark.createDataFrame([], "table_name string, prefix_len int, lo long, hi long, via string")
    assert [(r.table_name, r.via) for r in policy.policy_route(flows, rules, routes).collect()] == [(None, None)]


def test_rules_of_a_source_end_at_a_default_route(spark, monkeypatch):
    """300 tables with a default route each make one candidate a flow, not 300."""
    rules = spark.createDataFrame([(n, 0, 2**32 - 1, f"t{n}") for n in range(300)], "pref int, src_lo long, src_hi long, table_name string")
    routes = spark.createDataFrame([(f"t{n}", 0, 0, 2**32 - 1, f"v{n}") for n in range(300)], "table_name string, prefix_len int, lo long, hi long, via string")
    flows = spark.createDataFrame([(i, i % 7, i) for i in range(100)], "i int, src_ip long, dst_ip long")
    got = policy.policy_route(flows, rules, routes)
    assert {(r.table_name, r.via) for r in got.collect()} == {("t0", "v0")} and got.count() == 100


def test_paths_without_an_mtu_stay(spark):
    flows = spark.createDataFrame([("x", 100, True), (None, 9000, True)], "path string, size long, df boolean")
    limits = small_table(spark, [("wg0", 1420)], "path string, mtu bigint")
    got = {(r.path, r.mtu, r.packets, r.dropped, r.black_hole) for r in policy.mtu_drop_profile(flows, limits, "path").collect()}
    assert got == {("x", None, 1, 0, False), (None, None, 1, 0, False)}


def test_all_targets_of_a_command(spark, monkeypatch):
    rows = [
        ("curl http://ok.com http://evil.com", ["ok.com", "evil.com"], False), ("nmap -Pn ok.com", ["ok.com"], True),
        ("nmap -sS -Pn -F 10.0.0.1/24 a.ok.com", ["10.0.0.1", "a.ok.com"], True), ("ssh root@OK.com:22", ["ok.com"], True),
        ("curl -o out.html https://ok.com/a.txt?x=evil.com", ["ok.com"], True), ("cat /etc/hosts.conf notes.txt", [], False),
        ("hydra -l x evil.org ssh", ["evil.org"], False), ("dig a.ok.com ok.com", ["a.ok.com", "ok.com"], True), (None, [], False),
        ("ping 10.0.0.2", ["10.0.0.2"], False), ("ping 110.0.0.1", ["110.0.0.1"], False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, c string")
    allowed = spark.createDataFrame([("ok.com",), ("10.0.0.1",), ("0.0.1",), (None,)], "domain string")
    want = {i: (hosts, fine) for i, (_, hosts, fine) in enumerate(rows)}
    assert {r.i: (r.hosts, r.in_scope) for r in policy.scope_check(df, "c", allowed).collect()} == want
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=1: sizing.policy_rows(t, 1))
    assert {r.i: (r.hosts, r.in_scope) for r in policy.scope_check(df, "c", allowed).collect()} == want


def random_ranges(rng, n):
    """Nested, overlapping, touching, equal, single, turned-around and open ranges."""
    out = []
    for i in range(n):
        lo = rng.randrange(2**32) if i % 4 else rng.choice([0, 256, 2**31, 2**32 - 512])
        hi = lo + rng.choice([0, 1, 255, 2**16, 2**24, 2**30, 2**32]) - (5 if i % 17 == 0 else 0)
        out.append((i, None if i % 29 == 0 else lo, None if i % 31 == 0 else hi, rng.randrange(20)))
    return out


def test_first_match_equals_a_scan(spark, monkeypatch):
    rng = random.Random(4)
    ranges = random_ranges(rng, 400)
    ips = [rng.randrange(2**32) for _ in range(300)] + [0, 255, 256, 2**31, 2**32 - 1, 2**32, -1, None, 256, 256]
    cidrs = spark.createDataFrame(ranges, "rule int, lo long, hi long, pref int")
    df = spark.createDataFrame(list(enumerate(ips)), "i int, ip long")

    def first(ip):
        held = [(p, r) for r, lo, hi, p in ranges if None not in (lo, hi, ip) and 0 <= ip < 2**32 and lo <= ip <= hi]
        return min(held)[1] if held else None

    want = [(i, ip, first(ip)) for i, ip in enumerate(ips)]
    for side in (address_ranges.small_side, lambda blocks: blocks):  # blocks broadcast, and shuffled
        monkeypatch.setattr(address_ranges, "small_side", side)
        got = policy.cidr_first_match(df, "ip", cidrs, F.col("pref")).select("i", "ip", "rule").orderBy("i").collect()
        assert [tuple(r) for r in got] == want
    none = policy.cidr_first_match(df, "ip", cidrs.where("false"), F.col("pref"))
    assert none.count() == len(ips) and none.where("rule IS NOT NULL").count() == 0


def test_first_match_asks_once_per_address(spark):
    """The plan has no probe per prefix length on the side of the flows: rows are not multiplied."""
    cidrs = spark.createDataFrame(random_ranges(random.Random(5), 300), "rule int, lo long, hi long, pref int")
    df = spark.range(1000).select((F.col("id") * 4294967).alias("ip"))
    plan = policy.cidr_first_match(df, "ip", cidrs, F.col("pref"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan


def test_routes_without_a_gateway_short_and_long(spark, monkeypatch):
    rules = spark.createDataFrame([(1, 0, 99, "a"), (2, 0, 2**32 - 1, "b")], "pref int, src_lo long, src_hi long, table_name string")
    routes = spark.createDataFrame(
        [("a", 32, 7, 7, None), ("a", 32, 7, 7, "x"), ("a", 31, 6, 7, "y"), ("b", 0, 0, 2**32 - 1, None)],
        "table_name string, prefix_len int, lo long, hi long, via string",
    )
    df = spark.createDataFrame([(5, 7), (5, 6), (5, 9), (200, 7), (5, None), (None, 7)], "src_ip long, dst_ip long")
    want = {(5, 7): ("a", None), (5, 6): ("a", "y"), (5, 9): ("b", None), (200, 7): ("b", None), (5, None): (None, None), (None, 7): (None, None)}
    for rows in (sizing.POLICY_ROWS, 1):
        monkeypatch.setattr(policy, "policy_rows", lambda t, n=rows: sizing.policy_rows(t, rows))
        got = {(r.src_ip, r.dst_ip): (r.table_name, r.via) for r in policy.policy_route(df, rules, routes).collect()}
        assert got == want


def test_long_chains_of_tables(spark, monkeypatch):
    """Forty tables for a source, the only route in the last one: asked in turns of 1, 2, 4, ... tables."""
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=0: None)
    rules = spark.createDataFrame([(i, 0, 99, f"t{i:02}") for i in range(40)], "pref int, src_lo long, src_hi long, table_name string")
    routes = spark.createDataFrame(
        [(f"t{i:02}", 24, i * 256, i * 256 + 255, f"v{i}") for i in range(40)], "table_name string, prefix_len int, lo long, hi long, via string"
    )
    df = spark.range(41).select((F.col("id") % 9).alias("src_ip"), (F.col("id") * 256 + 1).alias("dst_ip"))
    got = {r.dst_ip: r.via for r in policy.policy_route(df, rules, routes).collect()}
    assert got == {i * 256 + 1: f"v{i}" if i < 40 else None for i in range(41)}


def test_hot_values_are_dealt_by_number(spark):
    """Equal rows, null keys and columns of any type, on both sides of the limit."""
    rows = spark.range(0, 2000, 1, 3).select(
        F.when(F.col("id") < 900, "hot").when(F.col("id") < 1500, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.create_map(F.lit("a"), F.lit(1)).alias("m"),
    )
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3)], "k string, v int")
    want = {"hot": (900, 1), None: (600, None), **{f"k{i}": (len([j for j in range(1500, 2000) if j % 7 == i]), {1: 2, 3: 3}.get(i)) for i in range(7)}}
    for limit in (10**6, 100):
        joined = skew.spread_join(rows, side, "k", hot_rows=limit)
        got = joined.groupBy("k").agg(F.count("*"), F.max("v"), F.count_distinct("v")).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == want and all(r[3] <= 1 for r in got)
        assert joined.columns == ["k", "m", "v"]


def _busy_flows(spark):
    """Half of the flows in one small block that many ranges hold, one address very often, nulls and no addresses among them."""
    rows = [(i, 168_000_000 + i % 7 if i % 2 else i * 2_654_435_761 % 2**32) for i in range(600)]
    rows += [(1000, None), (1001, -1), (1002, 2**32), (1003, 168_000_003), (1003, 168_000_003)]
    lists = [(n, 167_772_160 + n, 168_000_000 + n * 3) for n in range(90)] + [(100, 5, None), (101, 9, 3), (1, 167_772_160, 184_549_375)]
    want = sorted((i, n) for i, ip in rows if ip is not None and 0 <= ip < 2**32 for n, lo, hi in lists if hi is not None and lo <= ip <= hi)
    return spark.createDataFrame(rows, "i long, ip long"), spark.createDataFrame(lists, "n long, lo long, hi long"), want


def test_long_range_lists_are_neither_broadcast_nor_gathered(spark, monkeypatch):
    """Blocks past the broadcast limit, most pairs in a few blocks: dealt to several tasks, no list per address."""
    flows, ranges, want = _busy_flows(spark)
    monkeypatch.setattr(policy, "is_small", lambda *a: False)
    for most in (policy.PAIRS_PER_TASK, 50):
        monkeypatch.setattr(policy, "PAIRS_PER_TASK", most)
        met = policy.cidr_match(flows, "ip", ranges)
        assert met.columns == ["i", "ip", "n", "lo", "hi"]
        assert sorted((r.i, r.n) for r in met.collect()) == want
        assert "collect_list" not in met._jdf.queryExecution().optimizedPlan().toString()
        assert "merge" in met._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_of_one_file_are_cut_by_many_tasks(spark, monkeypatch):
    """A list in one file is dealt out before its ranges become blocks; flattened past the broadcast limit it says the same."""
    from auditloom.functions import ranges as module

    flows, ranges, want = _busy_flows(spark)
    one = ranges.coalesce(1)
    monkeypatch.setattr(module, "RANGES_PER_TASK", 10)
    dealt, parts = module.dealt_ranges(one)
    assert parts == 10 and dealt.rdd.getNumPartitions() == 10 and sorted(dealt.collect(), key=str) == sorted(one.collect(), key=str)
    first = {i: min(n for j, n in want if j == i) for i, _ in want}
    for side in (module.small_side, lambda blocks: blocks):
        monkeypatch.setattr(module, "small_side", side)
        got = policy.cidr_first_match(flows, "ip", one, F.col("n"))
        assert all(r.n == first.get(r.i) for r in got.collect()) and got.count() == flows.count()


def test_ranges_of_all_sizes_meet_in_few_cells(spark, monkeypatch):
    """Four probes per address at most past the broadcast limit, 65 cells per range, grids of tasks for busy cells; ends out of the space, repeated rows."""
    rng = random.Random(31)
    starts = [rng.choice([rng.randrange(2**32), 168_000_000 + rng.randrange(4000)]) for _ in range(160)]
    lists = [(n, a, a + rng.randrange(2 ** (n % 34))) for n, a in enumerate(starts)]
    lists += [(200, -5, 3), (201, 2**32 - 2, 2**40), (202, 0, 2**32 - 1), (203, None, 5), (204, 9, 8), (205, -9, -1), (206, 2**32, 2**33), *[(207, 168_000_000, 168_000_000)] * 40]
    ips = [rng.choice([rng.randrange(2**32), 168_000_000 + rng.randrange(4000), 168_000_000, 0, 2**32 - 1]) for _ in range(300)] + [None, -1, 2**32]
    held = {(n, lo, hi) for n, lo, hi in lists if None not in (lo, hi)}
    want = sorted((i, n) for i, ip in enumerate(ips) if ip is not None and 0 <= ip < 2**32 for n, lo, hi in lists if (n, lo, hi) in held and lo <= ip <= hi)
    flows = spark.createDataFrame(list(enumerate(ips)), "i int, ip long")
    ranges = spark.createDataFrame(lists, "n int, lo long, hi long").repartition(3)
    cells = net.covering_cells(ranges).groupBy("n", "lo", "hi").count()
    assert cells.where("n < 207 AND count > 65").count() == 0 and cells.count() == len([1 for n, lo, hi in held if n not in (204, 205, 206)])
    monkeypatch.setattr(policy, "is_small", lambda *a: False)
    probes, asked = policy._probes, []
    monkeypatch.setattr(policy, "_probes", lambda df, ip_col, bits: asked.append(len(bits)) or probes(df, ip_col, bits))
    for most in (policy.PAIRS_PER_TASK, 700, 20):
        monkeypatch.setattr(policy, "PAIRS_PER_TASK", most)
        met = policy.cidr_match(flows, "ip", ranges)
        assert met.columns == ["i", "ip", "n", "lo", "hi"] and sorted((r.i, r.n) for r in met.collect()) == want
    assert asked and max(asked) <= 4
