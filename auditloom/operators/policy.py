"""Network policy over flow tables: blocks, verdicts, switches, routes, scope."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.net import LAST_ADDRESS, aligned_blocks, cidr_bounds, covering_cells, network_of
from auditloom.functions.ranges import dealt_ranges, flattened, looked_up
from auditloom.functions.sizing import BROADCAST_ROWS, is_small, policy_rows, small_side, small_table
from auditloom.functions.skew import HOT_ROWS, Hot, running, spread_join
from auditloom.session import settle

# Fixed values of the egress policy.
SOURCE_SUBNET = "172.31.255.0/24"
TUNNEL_IFACE = "wg0"
FORWARD_BLOCKS = (
    "100.64.0.0/10",
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "169.254.0.0/16",
)
RAW_BLOCKS = ("100.64.0.0/10",)
RULE_PREF, TUNNEL_TABLE = 1000, "51820"

RANGE_JOIN_BLOCKS = 64


def range_of(cidr: str) -> tuple[int, int]:
    """First and last address of one block."""
    net = ip_network(cidr)
    return int(net[0]), int(net[-1])


def block_list(spark, raw=RAW_BLOCKS, forward=FORWARD_BLOCKS) -> DataFrame:
    """Blocks as rows (stage, seq, cidr, prefix_len, lo, hi)."""
    rows = [("raw", i, c) for i, c in enumerate(raw, 1)]
    rows += [("forward", i, c) for i, c in enumerate(forward, 1)]
    return with_bounds(small_table(spark, rows, "stage string, seq int, cidr string"))


def with_bounds(cidrs: DataFrame, col: str = "cidr") -> DataFrame:
    length, lo, hi = cidr_bounds(F.col(col))
    return cidrs.withColumns({"prefix_len": length, "lo": lo, "hi": hi})


def cidr_match(df: DataFrame, ip_col: str, cidrs: DataFrame) -> DataFrame:
    """Rows of `df` joined to every range that holds the address.

    `cidrs` has lo and hi, of any alignment, and other columns of its own; a range without both ends
    holds nothing, and neither does any range hold what is no IPv4 number. A short list is a broadcast
    range join. A longer one is cut into aligned blocks and met by an equi join on (host bits, network),
    at most 33 probes per address however long the list. With blocks too many to broadcast, ranges are laid over cells of a few sizes
    (`covering_cells`) and met there, so that no more than four probes per address are shuffled; both sides are dealt
    by cell, a cell of many pairs to several tasks; pairs leave the join as they are found.
    """
    if policy_rows(cidrs.select("lo"), RANGE_JOIN_BLOCKS) is not None:
        ip = F.col(ip_col)
        held = ip.between(F.col("lo"), F.col("hi")) & ip.between(0, LAST_ADDRESS)
        return df.join(F.broadcast(cidrs), held)
    listed = dealt_ranges(cidrs)[0]
    cut = aligned_blocks(listed)
    # A long list has its blocks counted before they are written, a list of more ranges than may be broadcast not even cut.
    if listed.count() <= BROADCAST_ROWS and cut.count() <= BROADCAST_ROWS:
        blocks = settle(cut)
        if is_small(blocks):
            bits = [r["_bits"] for r in blocks.select("_bits").distinct().collect()]  # 33 values at most
            return _probe(df, ip_col, F.broadcast(blocks), bits)
    return _spread_probe(df, ip_col, listed)


def cidr_first_match(df: DataFrame, ip_col: str, cidrs: DataFrame, rank: Column) -> DataFrame:
    """All rows of `df` with the other columns of the one range of `cidrs` that holds the address and has the smallest `rank`.

    Null where no range does. `cidrs` has lo and hi, as in `cidr_match`; ties go by the other columns in order. The
    list is flattened to ranges that do not overlap, of which each distinct address meets one.
    """
    others = [c for c in cidrs.columns if c not in ("lo", "hi")]
    flat = flattened(cidrs, F.lit(0), rank, F.struct(*others))
    ip = F.col(ip_col)
    asked = df.where(ip.between(0, LAST_ADDRESS)).select(ip.cast("long").alias("_at"), F.lit(0).alias("_group")).distinct()
    met = looked_up(asked, flat).select(F.col("_at").alias(ip_col), F.col("_value").alias("_first"))
    return spread_join(df, met, ip_col).select(*df.columns, *[F.col(f"_first.{c}") for c in others])


def _probes(df: DataFrame, ip_col: str, bits: list[int]) -> DataFrame:
    listed = F.array(*[F.lit(n) for n in sorted(bits)]).cast("array<int>")
    ip = F.col(ip_col)
    probes = df.where(ip.between(0, LAST_ADDRESS)).withColumn("_p_bits", F.explode(listed))
    return probes.withColumn("_p_net", network_of(ip, F.col("_p_bits")))


def _same_block() -> Column:
    return (F.col("_p_bits") == F.col("_bits")) & (F.col("_p_net") == F.col("_net"))


def _probe(df: DataFrame, ip_col: str, blocks: DataFrame, bits: list[int]) -> DataFrame:
    return _probes(df, ip_col, bits).join(blocks, _same_block()).drop("_p_bits", "_p_net", "_bits", "_net")


#: Pairs of a probe and a range that one cell may bring to a task.
PAIRS_PER_TASK = 500_000_000


def _spread_probe(df: DataFrame, ip_col: str, ranges: DataFrame) -> DataFrame:
    """Addresses and ranges met in cells, with both sides shuffled.

    A cell of many pairs is dealt to a grid of tasks: its probes and its ranges are parted by number and copied for the
    parts of the other side, into parts of about equal length, which makes the fewest copies.
    The plan's estimate does not know of the rows that a list makes, so the merge join is asked for.
    """
    rows = df.where(F.col(ip_col).between(0, LAST_ADDRESS))
    cells = covering_cells(ranges)
    held = settle(cells.groupBy("_bits", "_net").agg(F.count(F.lit(1)).alias("_held")))
    bits = [r["_bits"] for r in held.select("_bits").distinct().collect()]
    # Only cells that would have too many pairs with all addresses in them are looked at.
    many = small_side(settle(held.where(F.col("_held") * F.lit(rows.count()) > PAIRS_PER_TASK)))
    asked = _probes(rows.select(ip_col), ip_col, bits).join(many, _same_block()).groupBy("_bits", "_net", "_held").agg(F.count(F.lit(1)).alias("_asked"))
    pairs = F.col("_asked") * F.col("_held")
    tasks = F.ceil(pairs / PAIRS_PER_TASK)
    across = F.greatest(F.lit(1), F.least(F.col("_asked"), tasks, F.round(F.sqrt(tasks * F.col("_asked") / F.col("_held"))).cast("long")))
    grid = asked.where(pairs > PAIRS_PER_TASK).withColumn("_across", across).withColumn("_down", F.least(F.col("_held"), F.ceil(tasks / F.col("_across"))))
    busy = settle(grid.select(F.col("_bits").alias("_b_bits"), F.col("_net").alias("_b_net"), *[F.col(c).cast("int").alias(c) for c in ("_across", "_down")]))
    if not busy.limit(1).count():
        probes, same = _probes(rows, ip_col, bits), _same_block()
    else:
        busy = small_side(busy)

        def parted(side: DataFrame, bits_col: str, net_col: str) -> DataFrame:
            same = (F.col(bits_col) == F.col("_b_bits")) & (F.col(net_col) == F.col("_b_net"))
            sizes = {c: F.coalesce(c, F.lit(1)) for c in ("_across", "_down")}
            return side.join(busy, same, "left").withColumns(sizes).drop("_b_bits", "_b_net")

        def counted(upto: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(upto) - 1))

        number = F.monotonically_increasing_id()
        probes = parted(_probes(rows.withColumn("_number", number), ip_col, bits), "_p_bits", "_p_net").withColumn("_copy", counted("_down"))
        probes = probes.withColumn("_p_salt", (F.pmod("_number", "_across") * F.col("_down") + F.col("_copy")).cast("int"))
        probes = probes.drop("_number", "_across", "_down", "_copy")
        cells = parted(covering_cells(ranges.withColumn("_number", number)), "_bits", "_net").withColumn("_copy", counted("_across"))
        cells = cells.withColumn("_salt", (F.col("_copy") * F.col("_down") + F.pmod("_number", "_down")).cast("int"))
        cells = cells.drop("_number", "_across", "_down", "_copy")
        same = _same_block() & (F.col("_p_salt") == F.col("_salt"))
    joined = probes.join(cells.hint("merge"), same & probes[ip_col].between(cells["lo"], cells["hi"]))
    return joined.drop("_p_bits", "_p_net", "_p_salt", "_bits", "_net", "_salt")


def _within(ip: Column, lo: int, hi: int) -> Column:
    return ip.between(F.lit(lo).cast("long"), F.lit(hi).cast("long"))


def egress_verdict(
    df: DataFrame,
    blocks: DataFrame,
    subnet: tuple[int, int],
    kill_switch: Column | bool = False,
    tunnel: str = TUNNEL_IFACE,
) -> DataFrame:
    """Add verdict, stage and rule: the first policy rule a flow meets.

    Reads src_ip, dst_ip, out_iface. Order: raw blocks, kill switch, forward
    blocks; rules are put on top as they are added, so within a stage the last
    listed block comes first. Only flows from `subnet` are subject to any rule.
    """
    enabled = F.lit(kill_switch) if isinstance(kill_switch, bool) else kill_switch
    scoped = _within(F.col("src_ip"), *subnet)
    off_tunnel = F.coalesce(enabled, F.lit(False)) & (F.col("out_iface") != tunnel)

    def verdict(stage: str, rule) -> Column:
        return F.struct(
            F.lit("drop").alias("verdict"),
            F.lit(stage).alias("stage"),
            (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        )

    passed = F.struct(
        F.lit("accept").alias("verdict"),
        F.lit(None).cast("string").alias("stage"),
        F.lit(None).cast("string").alias("rule"),
    )
    rules = policy_rows(blocks.select("stage", "seq", "cidr", "lo", "hi"))
    columns = df.columns
    if rules is not None:
        rows, hit = df, {}
        for stage in ("raw", "forward"):
            chain = sorted((r for r in rules if r["stage"] == stage), key=lambda r: -r["seq"])
            tests = [
                F.when(_within(F.col("dst_ip"), r["lo"], r["hi"]), F.lit(r["cidr"])) for r in chain
            ]
            hit[stage] = F.coalesce(*tests) if tests else F.lit(None).cast("string")
    else:
        # A long list: each stage flattened to ranges with their first block, one of which each distinct address meets.
        stages = ("raw", "forward")
        flat = flattened(blocks, F.col("stage"), -F.col("seq"), F.col("cidr"))
        addresses = df.where(scoped).select("dst_ip").where(F.col("dst_ip").between(0, LAST_ADDRESS)).distinct()
        asked = addresses.select(F.col("dst_ip").alias("_at"), F.explode(F.array(*[F.lit(s) for s in stages])).alias("_group"))
        first = {s: F.max(F.when(F.col("_group") == s, F.col("_value"))).alias(f"_{s}") for s in stages}
        per_address = looked_up(asked, flat).groupBy(F.col("_at").alias("dst_ip")).agg(*first.values())
        rows = spread_join(df, per_address, "dst_ip")
        hit = {s: F.col(f"_{s}") for s in stages}
    chosen = (
        F.when(~scoped, passed)
        .when(hit["raw"].isNotNull(), verdict("raw", hit["raw"]))
        .when(off_tunnel, verdict("killswitch", "killswitch"))
        .when(hit["forward"].isNotNull(), verdict("forward", hit["forward"]))
        .otherwise(passed)
    )
    return rows.select(*columns, chosen.alias("_verdict")).select(*columns, "_verdict.*")


def toggle_asof(
    flows: DataFrame,
    changes: DataFrame,
    ts: str,
    scope: str,
    change_order: str,
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Add `kill_switch`: the switch state of the flow's scope at its time.

    `up` turns it on, `disable` off, `down` leaves it, and it starts off; of changes at one
    instant the last by `change_order` counts. A short list of changes is a broadcast join of their
    periods. A longer one runs along with the flows: one row per flow and change, the
    last change carried on in order of time, a busy scope cut into slices.
    """
    effective = (
        changes.where(F.col("action").isin("up", "disable") & F.col(scope).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(scope).alias("_scope"), F.col(ts).alias("_from"))
        .agg(F.max_by(F.col("action") == "up", F.col(change_order)).alias("_on"))
    )
    columns, at = flows.columns, F.col(ts)
    if policy_rows(effective) is not None:
        periods = effective.withColumn("_to", F.lead("_from").over(Window.partitionBy("_scope").orderBy("_from")))
        held = (
            (F.col(scope) == F.col("_scope")) & (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
        )
        joined = flows.join(F.broadcast(periods), held, "left")
        return joined.select(*columns, F.coalesce("_on", F.lit(False)).alias("kill_switch"))
    marks = effective.select(F.col("_scope").alias(scope), F.col("_from").alias(ts), "_on")
    both = flows.withColumn("_is_flow", F.lit(True)).unionByName(
        marks.withColumn("_is_flow", F.lit(False)), allowMissingColumns=True
    )
    first, here = Window.unboundedPreceding, Window.currentRow
    carried = running(
        both,
        scope,
        [ts, "_is_flow"],  # a change counts from its own instant on
        hot_rows=hot_rows,
        hot=hot,
        order=[at, F.col("_is_flow")],
        local=F.last("_on", ignorenulls=True),
        frame=(first, here),
        total=F.max_by("_on", F.when(F.col("_on").isNotNull(), at)),
        carried=F.last("_total", ignorenulls=True),
        combine=F.coalesce,
        out="_state",
    )
    return carried.where("_is_flow").select(*columns, F.coalesce("_state", F.lit(False)).alias("kill_switch"))


def policy_route(df: DataFrame, rules: DataFrame, routes: DataFrame) -> DataFrame:
    """Add table_name and via: the route of the first source rule that has one.

    `rules` has pref, src_lo, src_hi, table_name; `routes` has table_name,
    prefix_len, lo, hi, via. Rules are tried by rising pref, and inside a table
    the longest prefix wins. Reads src_ip and dst_ip. Without a rule or a route both columns are null.
    """
    paths = rules.join(routes, "table_name").select(
        "pref", "table_name", "src_lo", "src_hi", "prefix_len", "lo", "hi", "via"
    )
    short = policy_rows(paths)
    path_type = "struct<table_name: string, via: string>"
    if short is not None:
        ordered = sorted(short, key=lambda p: (p["pref"], -p["prefix_len"], p["via"] is not None, p["via"] or ""))
        tests = [
            F.when(
                _within(F.col("src_ip"), p["src_lo"], p["src_hi"])
                & _within(F.col("dst_ip"), p["lo"], p["hi"]),
                F.struct(F.lit(p["table_name"]).alias("table_name"), F.lit(p["via"]).alias("via")),
            )
            for p in ordered
        ]
        path = F.coalesce(*tests) if tests else F.lit(None).cast(path_type)
        return df.withColumn("_path", path).select(*df.columns, "_path.*")
    # Many routes: the rules of each source first, no further than the first table with a default route.
    sources = df.select("src_ip").distinct()
    ruled = cidr_match(sources, "src_ip", rules.select("pref", "table_name", F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi")))
    defaults = (
        routes.where((F.col("lo") <= 0) & (F.col("hi") >= LAST_ADDRESS))
        .select(F.col("table_name").alias("_default_table"))
        .distinct()
    )
    last = F.min(F.when(F.col("_default_table").isNotNull(), F.col("pref"))).over(Window.partitionBy("src_ip"))
    reached = (
        ruled.select("src_ip", "pref", "table_name")
        .join(small_side(defaults), F.col("table_name") == F.col("_default_table"), "left")
        .withColumn("_last", last)
        .where(F.col("_last").isNull() | (F.col("pref") <= F.col("_last")))
        .select("src_ip", "pref", "table_name")
    )
    # Each source has its tables in order. Pairs ask their next tables, twice as many each time, until one has a route.
    chains = reached.groupBy("src_ip").agg(F.array_sort(F.collect_list(F.struct("pref", "table_name"))).alias("_chain"))
    found_route = F.struct("table_name", "via")
    flat = flattened(routes, F.col("table_name"), -F.col("prefix_len"), found_route)
    pairs = df.select("src_ip", "dst_ip").where(F.col("dst_ip").between(0, LAST_ADDRESS)).distinct()
    open_pairs = settle(spread_join(pairs, chains, "src_ip").where("_chain IS NOT NULL"))
    paths, begin, width = [], 0, 1
    while open_pairs.where(F.size("_chain") > begin).limit(1).count():
        asked = open_pairs.select("src_ip", "dst_ip", F.posexplode(F.slice("_chain", begin + 1, width)).alias("_turn", "_rule"))
        asked = asked.select("src_ip", F.col("dst_ip").alias("_at"), "_turn", F.col("_rule.table_name").alias("_group"))
        hits = looked_up(asked, flat, ties=("src_ip",)).where("_value IS NOT NULL")
        path = F.min_by("_value", "_turn").alias("_path")
        paths.append(settle(hits.groupBy("src_ip", F.col("_at").alias("dst_ip")).agg(path)))
        open_pairs = settle(open_pairs.join(paths[-1], ["src_ip", "dst_ip"], "left_anti"))
        begin, width = begin + width, width * 2
    pair = F.concat_ws(">", "src_ip", "dst_ip")
    none = F.lit(None).cast(path_type)
    if not paths:
        return df.withColumn("_path", none).select(*df.columns, "_path.*")
    best = reduce(DataFrame.unionByName, paths).select(pair.alias("_pair"), F.col("_path").cast(path_type))
    return spread_join(df.withColumn("_pair", pair), best, "_pair").select(*df.columns, "_path.*")


def ruleset_reconcile(
    desired: DataFrame, actual: DataFrame, keys: list[str], mark: str
) -> DataFrame:
    """Action per rule so that `actual` becomes `desired`: add, keep, remove, drop_duplicates.

    Only rules carrying `mark` are touched. `copies` counts the rule in `actual`;
    a removal takes every copy. Both sides go through one grouping, which is
    combined before its shuffle and treats a null key as a value.
    """
    want = desired.where(F.col("mark") == mark).select(
        *keys, F.lit(1).alias("_wanted"), F.lit(0).alias("_copy")
    )
    have = actual.where(F.col("mark") == mark).select(
        *keys, F.lit(0).alias("_wanted"), F.lit(1).alias("_copy")
    )
    action = (
        F.when(F.col("copies") == 0, F.lit("add"))
        .when(F.col("_wanted") == 0, F.lit("remove"))
        .when(F.col("copies") > 1, F.lit("drop_duplicates"))
        .otherwise(F.lit("keep"))
    )
    return (
        want.unionByName(have)
        .groupBy(*keys)
        .agg(F.sum("_wanted").alias("_wanted"), F.sum("_copy").alias("copies"))
        .select(*keys, "copies", action.alias("action"))
    )


def mtu_drop_profile(df: DataFrame, mtu_by_path: DataFrame, path: str) -> DataFrame:
    """Per path: packets, drops (size over the MTU with DF set), share, pattern.

    `mtu_by_path` has path, mtu. `black_hole` means that small packets pass while
    every large one is dropped. A path without an MTU has a row with null MTU and no drops.
    """
    limits = mtu_by_path.select(F.col("path").alias("_path"), "mtu")
    joined = df.join(small_side(limits), F.col(path) == F.col("_path"), "left")
    large = F.coalesce(F.col("size") > F.col("mtu"), F.lit(False))
    dropped = large & F.coalesce(F.col("df"), F.lit(False))
    return (
        joined.groupBy(F.col(path).alias("path"), "mtu")
        .agg(
            F.count("*").alias("packets"),
            F.count_if(large).alias("large"),
            F.count_if(dropped).alias("dropped"),
            F.max(F.when(~dropped, F.col("size"))).alias("largest_passed"),
        )
        .withColumns(
            {
                "drop_share": F.col("dropped") / F.col("packets"),
                "black_hole": (F.col("dropped") > 0)
                & (F.col("dropped") == F.col("large"))
                & (F.col("packets") > F.col("large")),
            }
        )
    )


# Last labels of file names that are no top-level domains.
FILE_SUFFIXES = ("conf", "csv", "gnmap", "gz", "htm", "html", "json", "log", "lst", "nmap", "pcap", "txt", "xml", "yaml", "yml")
URL = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s'\"<>|;]+"
ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
HOST_NAME = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*"
BARE_TARGET = rf"(?<![\w./-])(?:{ADDRESS}|{HOST_NAME})(?![\w.-])"


def target_hosts(text: Column) -> Column:
    """All hosts a command names, lower case, URLs first: hosts of URLs, then bare names and addresses.

    A bare name has two labels or more and does not end like a file (FILE_SUFFIXES); names behind
    a slash are paths. Where a name could be either, as with `.sh`, it counts as a host.
    """
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    of_urls = F.transform(urls, lambda u: F.try_parse_url(u, F.lit("HOST")))
    bare = F.regexp_extract_all(F.regexp_replace(text, URL, " "), F.lit(BARE_TARGET), F.lit(0))
    named = F.filter(bare, lambda h: ~F.lower(F.substring_index(h, ".", -1)).isin(*FILE_SUFFIXES))
    return F.array_distinct(F.transform(F.array_compact(F.concat(of_urls, named)), F.lower))


def _suffixes(host: Column) -> Column:
    """The host and every domain above it; an address stands for itself alone."""
    labels = F.split(host, r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(host.rlike(rf"^{ADDRESS}\z"), F.array(host)).otherwise(above)


def scope_check(df: DataFrame, col: str, allowed: DataFrame) -> DataFrame:
    """Add `hosts`, `host` (the first) and `in_scope`: every target is an allowed domain or below one.

    A text without a target is not in scope. A short list is tested inside the row; for a
    long one the suffixes of the distinct hosts are looked up with an equi join, and rows meet the
    verdict on their set of hosts.
    """
    listed = df.withColumn("hosts", F.coalesce(target_hosts(F.col(col)), F.array().cast("array<string>")))
    hosted = listed.withColumn("host", F.get("hosts", F.lit(0)))
    some = F.size("hosts") > 0
    domains = allowed.select(F.lower("domain").alias("_suffix")).where("_suffix IS NOT NULL").distinct()
    short = policy_rows(domains)
    if short is not None:
        known = F.array(*[F.lit(r["_suffix"]) for r in short]).cast("array<string>")
        return hosted.withColumn("in_scope", some & F.forall("hosts", lambda h: F.arrays_overlap(_suffixes(h), known)))
    sets = hosted.where(some).select("hosts").distinct()
    fine = (
        sets.select(F.explode("hosts").alias("_host"))
        .distinct()
        .withColumn("_suffix", F.explode(_suffixes(F.col("_host"))))
        .join(small_side(domains), "_suffix", "left_semi")
        .select("_host")
        .distinct()
        .withColumn("_fine", F.lit(True))
    )
    judged = (
        sets.withColumn("_host", F.explode("hosts"))
        .join(fine, "_host", "left")
        .groupBy(F.array_join("hosts", " ").alias("_set"))
        .agg(F.bool_and(F.coalesce("_fine", F.lit(False))).alias("in_scope"))
    )
    rows = spread_join(hosted.withColumn("_set", F.array_join("hosts", " ")), judged, "_set")
    return rows.select(*hosted.columns, F.coalesce("in_scope", F.lit(False)).alias("in_scope"))
