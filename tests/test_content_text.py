"""Content and text operators on small rows, against Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditloom.functions import bytescan, patterns, sizing
from auditloom.functions.sizing import small_table
from auditloom.operators import content, logs, text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def test_inventory_duplicates_and_pins(spark):
    df = spark.createDataFrame([("b", bytearray(b"x")), ("a", bytearray(b"x")), ("c", bytearray(b""))], "path string, body binary")
    inventory = content.file_inventory(df, "path", "body")
    assert {r.path: (r.size, r.sha256) for r in inventory.collect()}["c"] == (0, hashlib.sha256(b"").hexdigest())
    group = content.duplicate_groups(inventory, "path").collect()
    assert [(r.copies, r.first_path, r.spare_bytes) for r in group] == [(2, "a", 1)]
    pins = spark.createDataFrame(
        [("a", hashlib.sha256(b"x").hexdigest().upper()), ("b", "0" * 64), ("d", "1"), ("e", " ")], "path string, pinned string"
    )
    got = {r.path: r.status for r in content.pinned_hash_verify(inventory, pins, "path").collect()}
    assert got == {"a": "match", "b": "drift", "c": "missing_pin", "d": "missing_file", "e": "missing_pin"}


def test_file_type(spark):
    bodies = {b"\x7fELF..": "elf", b"MZ": "pe", b"%PDF-1.7": "pdf", b"PK\x03\x04": "zip", b"plain": "data", b"": "data", b"#!/bin/sh": "script"}
    df = spark.createDataFrame([(bytearray(b),) for b in bodies], "body binary")
    assert {bytes(r.body): r.file_type for r in content.file_type_tag(df, "body").collect()} == bodies


def test_strings(spark):
    source = "short\x00" + "longer one\x01" + "é".join(["12345678", "1234567", "123456789\t"])
    got = content.printable_strings(docs(spark, source, ""), "t").orderBy("pos").collect()
    assert [r.string for r in got] == re.findall(r"[\x20-\x7E\t]{8,}", source)
    many = "\n".join(f"string {i:04d}" for i in range(60))
    assert content.printable_strings(docs(spark, many), "t").count() == 50
    assert content.printable_strings(docs(spark, many), "t", limit=None).count() == 60


def test_pattern_rules_short_and_long(spark, monkeypatch):
    rng = random.Random(8)
    words = ["aa", "ab", "aab", "ba", "é€", "a.b", "$$"]
    texts = ["".join(rng.choice("aab.é€$") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    rules = [("any", w, 1) for w in words] + [("all", w, 2) for w in ("aa", "ba")] + [("some", w, 3) for w in words]
    want = set()
    for i, t in enumerate(texts):
        for rule, needed in (("any", 1), ("all", 2), ("some", 3)):
            counts = [t.count(w) for r, w, _ in rules if r == rule]
            matched = sum(c > 0 for c in counts)
            if matched >= needed:
                want.add((i, rule, matched, sum(counts)))
    rule_df = small_table(spark, rules, "rule string, literal string, needed int")
    assert {tuple(r) for r in content.pattern_rules(docs(spark, *texts), "i", "t", rule_df).collect()} == want
    monkeypatch.setattr(content, "policy_rows", lambda t, n: sizing.policy_rows(t, 3))
    assert {tuple(r) for r in content.pattern_rules(docs(spark, *texts), "i", "t", rule_df).collect()} == want


def test_signatures(spark):
    bodies = [b"aaaa", b"", None, b"xaa\xffaa", "éé".encode()]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "i int, body binary")
    got = {(r.i, r.signature, r.offset) for r in content.signature_scan(df, "i", "body", ["aa", "é"]).collect()}
    assert got == {(0, "aa", 0), (0, "aa", 2), (3, "aa", 1), (3, "aa", 4), (4, "é", 0), (4, "é", 2)}


def test_keywords_and_findings(spark):
    words = {"js": "/JavaScript", "open": "/OpenAction"}
    df = docs(spark, "/JavaScript x /JavaScript", "none")
    long = {(r.i, r.keyword): r.n for r in content.keyword_profile(df, "i", "t", words).collect()}
    assert long == {(0, "js"): 2, (0, "open"): 0, (1, "js"): 0, (1, "open"): 0}
    wide = {r.i: (r.js, r.suspicious) for r in content.keyword_flags(df, "i", "t", words, ["js"]).collect()}
    assert wide == {0: (2, True), 1: (0, False)}
    found = spark.createDataFrame(
        [(1, "critical", ["cve"], 200), (2, "low", ["cve"], 200), (3, "high", ["x"], 404), (4, "high", ["x", "exposure"], 500)],
        "i int, severity string, tags array<string>, status int",
    )
    kept = content.findings_filter(found, ["critical", "high"], ["cve", "exposure"])
    assert {r.i for r in kept.collect()} == {1, 4}
    assert {r.i for r in content.findings_filter(found, statuses=[200, 404]).collect()} == {1, 2, 3}
    assert {r.severity: r.findings for r in content.severity_counts(kept).collect()} == {"critical": 1, "high": 1}


def grep_context(lines, marker, after):
    keep, last = [], None
    for n, line in enumerate(lines, 1):
        if marker in line:
            last = n
        if last is not None and n - last <= after:
            keep.append((n, line))
    return keep


def test_context_tail_head(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["x", "hit", "a hit b", ""]) for _ in range(rng.randrange(0, 25))) + rng.choice(["", "\n"]) for _ in range(150)]

    def lines(t):
        parts = t.split("\n")
        return parts[:-1] if parts[-1] == "" else parts

    df = docs(spark, *texts)
    for after in (0, 1, 3):
        got = text.marker_context(df, "t", "hit", after).collect()
        want = {(i, n, x) for i, t in enumerate(texts) for n, x in grep_context(lines(t), "hit", after)}
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = {tuple(r) for r in text.marker_context(df, "t", "hit", 2, limit=4).collect()}
    assert got == {(i, n, x) for i, t in enumerate(texts) for n, x in grep_context(lines(t), "hit", 2)[:4]}
    tails = {tuple(r) for r in text.marker_tail(df, "t", "hit").collect()}
    want = set()
    for i, t in enumerate(texts):
        first = next((n for n, x in enumerate(lines(t)) if "hit" in x), None)
        if first is not None:
            want |= {(i, n + 1, x) for n, x in enumerate(lines(t)) if n >= first}
    assert tails == want
    heads = {tuple(r) for r in text.head_lines(df, "t", 3).collect()}
    assert heads == {(i, n + 1, x) for i, t in enumerate(texts) for n, x in enumerate(lines(t)[:3])}


def test_json_defaults(spark):
    bodies = ['{"stdout":null}', '{"stdout":false}', "{}", '{"stdout":"x","ok":true}', "broken", '{"stdout":"false"}']
    got = text.json_project(docs(spark, *bodies), "t", {"ok": "boolean", "stdout": "string"}, {"stdout": ""}).orderBy("i").collect()
    assert [r.stdout for r in got] == ["", "", "", "x", "", "false"]
    assert [r.ok for r in got] == [None, None, None, True, None, None]


def test_probe_lines_and_expectations(spark):
    out = "noise\nIP=172.31.255.2\nPUBDNS=OK\nPUBIP=rc0 t1\nPEER=rc280 t6\nMETA_rc=28 t6\nMAGICDNS=rc9\n=x"
    probes = text.probe_parse(docs(spark, out, "nothing"), "t")
    got = {r.key: (r.value, r.rc, r.t) for r in probes.collect()}
    assert got == {
        "IP": ("172.31.255.2", None, None), "PUBDNS": ("OK", None, None), "PUBIP": ("rc0 t1", 0, 1),
        "PEER": ("rc280 t6", 280, 6), "META": ("28 t6", 28, 6), "MAGICDNS": ("rc9", 9, None),
    }
    observed = probes.select("i", "key", F.coalesce(F.col("rc").cast("string"), "value").alias("value"))
    checks = small_table(
        spark,
        [("a", "IP", "prefix", "172.31.255."), ("b", "PEER", "eq", "28"), ("c", "META", "eq", "28"), ("d", "GONE", "ne", "1"),
         ("e", "IP", "ne_key", "PUBDNS"), ("f", "GONE", "empty", None), ("g", "IP", "non_empty", None), ("h", "META", "ge", "28"), ("i", "META", "le", "27")],
        "name string, key string, operator string, expected string",
    )
    runs = docs(spark, out, "nothing").select("i")
    results = text.expectation_suite(checks, observed, run="i", runs=runs)
    first = {r.name: r.result for r in results.where("i = 0").collect()}
    assert first == dict(zip("abcdefghi", ["PASS", "FAIL", "PASS", "FAIL", "PASS", "FAIL", "PASS", "PASS", "FAIL"]))
    assert {r.result for r in results.where("i = 1").collect()} == {"FAIL"}
    gates = {r.i: (r.checks, r.fails, r.passed) for r in text.gate(results, "i").collect()}
    assert gates == {0: (9, 4, False), 1: (9, 9, False)}
    whole = text.gate(text.expectation_suite(checks.where("name IN ('a', 'c')"), observed)).collect()
    assert [(r.checks, r.fails, r.passed) for r in whole] == [(2, 0, True)]


def test_strip_space(spark):
    assert docs(spark, " 1.2.\t3.4 \r\n").select(text.strip_space(F.col("t")).alias("t")).first().t == "1.2.3.4"


def test_log_lines(spark):
    lines = [
        "2024-05-06 07:08:09,123 INFO exec image=base network=egress raw=True(granted=True) timeout=60s files=2 cmd='echo \\'a\\' \\\\n\\n'",
        "2024-05-06 07:08:09,123 INFO exec image=heavy network=none raw=False(granted=False) timeout=300s files=0 cmd=\"it's\"",
        "2024-05-06 07:08:09,123 WARNING timeout after 5s; killing container c-1",
        "2024-05-06 07:08:09,123 WARNING workdir /w/x y not fully removed; using root-container cleanup",
        "2024-05-06 07:08:09,123 ERROR workdir LEAK: could not remove /w/x",
        "2024-13-06 07:08:09,123 INFO hello",
        "free text",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    rows = logs.exec_log_parse(df).orderBy("i").collect()
    assert [r.kind for r in rows] == ["exec", "exec", "timeout_kill", "partial_cleanup", "leak", "other", "other"]
    assert rows[0].cmd == "echo 'a' \\n\n" and rows[1].cmd == "it's"
    assert (rows[0].raw, rows[0].granted, rows[0].timeout, rows[0].n_files) == (True, True, 60, 2)
    assert (rows[2].timeout, rows[2].target, rows[3].target, rows[4].target) == (5, "c-1", "/w/x y", "/w/x")
    assert rows[5].log_ts is None and rows[5].level == "INFO" and rows[6].level is None
    assert rows[0].log_ts.microsecond == 123000


def test_secrets(spark):
    key = "0123456789abcdef0123"
    df = docs(spark, f'token = "{key}" and Authorization: Bearer ab.c-1', "clean", f"bare {key} twice {key}")
    found = {(r.i, r.pattern): r.hits for r in logs.secret_scan(df, "t").collect()}
    assert found == {(0, "bearer_header"): 1, (0, "token_assignment"): 1}
    redacted = {r.i: r.t for r in logs.secret_redact(df, "t").collect()}
    assert redacted[0] == "[redacted] and [redacted]" and redacted[1] == "clean"
    known = spark.createDataFrame([(hashlib.sha256(key.encode()).hexdigest(),)], "sha256 string")
    assert sorted(r.i for r in logs.known_secret_scan(df, "i", "t", known).collect()) == [0, 2]


def test_rules_without_needs_and_empty_literals(spark, monkeypatch):
    rule_df = spark.createDataFrame(
        [("any", "abc", 0), ("any", "zz", 0), ("blank", "", 1), ("mixed", "", 1), ("mixed", "b c", 1), ("none", None, 0), ("wide", "\u00e9t\u00e9 ##", 1)],
        "rule string, literal string, needed int",
    )
    df = docs(spark, "abcabc b c", "zz", "", "un \u00e9t\u00e9 ## ici", "ab cd")
    want = {
        (0, "any", 1, 2), (1, "any", 1, 1), (2, "any", 0, 0), (3, "any", 0, 0), (4, "any", 0, 0), (0, "mixed", 1, 1), (4, "mixed", 1, 1),
        (3, "wide", 1, 1), *((i, "none", 0, 0) for i in range(5)),
    }
    assert {tuple(r) for r in content.pattern_rules(df, "i", "t", rule_df).collect()} == want
    monkeypatch.setattr(content, "policy_rows", lambda t, n: sizing.policy_rows(t, 0))
    assert {tuple(r) for r in content.pattern_rules(df, "i", "t", rule_df).collect()} == want


def test_long_rule_lists_equal_short_ones(spark, monkeypatch):
    rng = random.Random(8)
    signs = ["a", "b", "ab", "\u00e9", "-", " ", "#", "1"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    literals = {"".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(40)}
    rule_df = spark.createDataFrame([(f"r{i % 7}", x, 1 + i % 3) for i, x in enumerate(sorted(literals))], "rule string, literal string, needed int")
    df = docs(spark, *texts)
    short = {tuple(r) for r in content.pattern_rules(df, "i", "t", rule_df).collect()}
    monkeypatch.setattr(content, "policy_rows", lambda t, n: sizing.policy_rows(t, 3))
    assert {tuple(r) for r in content.pattern_rules(df, "i", "t", rule_df).collect()} == short and len(short) > 20


def test_signatures_in_random_bytes(spark):
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab\xff\x00.") for _ in range(rng.randrange(0, 2000))) for _ in range(12)] + [b"ab" * 3000]
    wanted = ["ab", "a", "..", "", "\u00ff"]
    want = set()
    for i, body in enumerate(bodies):
        for s in wanted:
            needle, at = s.encode(), 0
            while needle and (at := body.find(needle, at)) >= 0:
                want.add((i, s, at))
                at += len(needle)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, body binary")
    got = [(r.i, r.signature, r.offset) for r in content.signature_scan(df, "i", "body", wanted).collect()]
    assert len(got) == len(want) and set(got) == want
    assert content.signature_scan(df, "i", "body", [""]).count() == 0


def test_expectations_meet_in_a_join(spark):
    observed = spark.createDataFrame([(1, "a", "x"), (1, "a", "z"), (2, "b", "5"), (1, "c", None)], "run int, key string, value string")
    schema = "name string, key string, operator string, expected string"
    many = [(f"n{i}", "a" if i % 2 else "b", "eq", "x" if i % 3 else "5") for i in range(300)]
    checks = spark.createDataFrame(many, schema)
    results = text.expectation_suite(checks, observed, run="run")
    seen = {1: {"a": {"x", "z"}}, 2: {"b": {"5"}}}
    want = {(r, n, k, max(seen[r].get(k, {None}), key=lambda v: v or ""), "PASS" if e in seen[r].get(k, ()) else "FAIL") for r in seen for n, k, _, e in many}
    assert {tuple(r) for r in results.collect()} == want and results.count() == 600
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    empty = spark.createDataFrame([], schema)
    assert text.expectation_suite(empty, observed, run="run").count() == 0
    assert text.expectation_suite(empty, observed).columns == ["name", "key", "value", "result"]
    alone = text.expectation_suite(checks.limit(1), observed.where("false"))
    assert [r.result for r in alone.collect()] == ["FAIL"]


def test_pieces_by_a_bit_set(spark, monkeypatch):
    """Every piece of the list is let by, few others; the long way with it finds what the broadcast finds."""
    known = [f"{i:08x}" for i in range(5000)]
    listed = spark.createDataFrame([(k,) for k in known], "_piece string")
    test = content._piece_test(listed)
    assert listed.where(test(F.col("_piece"))).count() == 5000
    others = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("p"))
    assert others.where(test(F.col("p"))).count() < 10_000
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdé-+ ", k=rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(20, ""), (21, None)], "i int, t string")
    rules = spark.createDataFrame([(f"r{i % 50}", w, 1) for i, w in enumerate(words)], "rule string, literal string, needed int")
    want = Counter(map(tuple, content.pattern_rules(df, "i", "t", rules).collect()))
    monkeypatch.setattr(content, "is_small", lambda side: False)
    monkeypatch.setattr(content, "MAX_BITS", 1024)  # a list too long for the bits still loses nothing
    assert want and Counter(map(tuple, content.pattern_rules(df, "i", "t", rules).collect())) == want


def judge_slowly(checks, observed, runs):
    for run in runs:
        values = {}
        for r, k, v in observed:
            if r == run and k is not None:
                values.setdefault(k, []).append(v)
        largest = {k: max((v for v in vs if v is not None), default=None) for k, vs in values.items()}
        for name, key, operator, expected in checks:
            mine, other = largest.get(key), largest.get(expected)
            seen = [v for v in values.get(key, []) if v is not None]
            passes = {
                "eq": expected in seen,
                "ne": any(v != expected for v in seen),
                "prefix": any(v.startswith(expected) for v in seen),
                "empty": "" in seen,
                "non_empty": any(seen),
                "ne_key": bool(mine) and other is not None and mine != other,
            }[operator]
            yield run, name, key, mine, "PASS" if passes else "FAIL"


@pytest.mark.parametrize("copies", [1, 40])
def test_expectations_as_division(spark, copies):
    """Null runs, repeated names, keys without an observation, pairs of keys; short and long lists."""
    kinds = [("eq", "1"), ("ne", "1"), ("prefix", "1"), ("empty", "x"), ("non_empty", "x"), ("ne_key", "b"), ("ne_key", "gone")]
    checks = [(f"n{i % 5}", k, o, e) for i in range(copies) for k in ("a", "b", "gone") for o, e in kinds]
    observed = [(1, "a", "1"), (1, "a", "12"), (1, "b", "12"), (None, "a", "2"), (None, "b", ""), (None, "b", "1"), (2, "a", None), (2, None, "1")]
    observed += [(3, "a", "7")] * 50
    runs = [1, None, 2, 3, 4]
    got = text.expectation_suite(
        spark.createDataFrame(checks, "name string, key string, operator string, expected string"),
        spark.createDataFrame(observed, "run int, key string, value string"),
        run="run",
        runs=spark.createDataFrame([(r,) for r in runs], "run int"),
    )
    assert Counter(map(tuple, got.collect())) == Counter(judge_slowly(checks, observed, runs))


def scan_slowly(body, value, mask):
    mask = (mask or b"\xff" * len(value))[: len(value)].ljust(len(value), b"\xff")
    at = 0
    while value and at + len(value) <= len(body):
        if all(b & m == v & m for b, v, m in zip(body[at : at + len(value)], value, mask)):
            yield at
            at += len(value)
        else:
            at += 1


def test_binary_signatures_with_masks(spark, monkeypatch):
    """Nulls, empty bodies, whole and half bytes left open, no byte fixed, names twice; pieces across segments, passes over parts."""
    rng = random.Random(11)
    bodies = [bytes(rng.choice(b"ab\xff\x00\x1f\x8b") for _ in range(rng.randrange(0, 400))) for _ in range(20)] + [b"", None, b"\x00" * 300]
    sigs = [("gzip", b"\x1f\x8b", None), ("zeros", b"\x00" * 6, None), ("gap", b"a?b", b"\xff\x00\xff"), ("half", b"\x1f\x80", b"\xff\xf0"),
            ("open", b"\x00\x00", b"\x00\x00"), ("short", b"ab\xff", b"\x0f"), ("gzip", b"ab", None), ("none", None, None), ("blank", b"", b"\xff")]
    sigs += [(f"r{i}", bytes(rng.choice(b"ab\xff\x00\x1f\x8b") for _ in range(rng.randrange(1, 7))), None) for i in range(300)]
    want = sorted((i, n, at) for i, b in enumerate(bodies) for n, v, m in set(sigs) for at in scan_slowly(b or b"", v or b"", m))
    df = spark.createDataFrame([(i, b and bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "i int, body binary")
    table = spark.createDataFrame([(n, v and bytearray(v), m and bytearray(m)) for n, v, m in sigs], "signature string, bytes binary, mask binary")
    assert sorted(tuple(r) for r in content.signature_table_scan(df, "i", "body", table).collect()) == want
    monkeypatch.setattr(content, "SIGNATURES_AT_ONCE", 50)
    assert sorted(tuple(r) for r in content.signature_table_scan(df, "i", "body", table).collect()) == want
    assert content.signature_table_scan(df, "i", "body", table.where("false")).count() == 0


def test_signatures_across_segments(monkeypatch):
    monkeypatch.setattr(bytescan, "SEGMENT", 7)
    rng = random.Random(12)
    body = bytes(rng.choice(b"ab") for _ in range(200))
    rows = [(v, v, m) for v, m in ((b"abba", None), (b"a", None), (b"aabbab", b"\xff\x00\xff\xff"), (b"xx", b"\x00\x00"))]
    want = sorted((n, at) for n, v, m in rows for at in scan_slowly(body, v, m))
    assert sorted(bytescan.Signatures(rows).occurrences(body)) == want


@pytest.mark.parametrize("n", [11, 301])
def test_rows_without_an_id_and_repeated_ids(spark, n):
    """The same rows on both sides of RULE_LITERALS_IN_PLAN."""
    rows = [(1, "secret0007 here"), (None, "a secret0007"), (2, "secret0001 secret0001"), (2, "secret0001 secret0002"), (2, "nothing"), (None, None)]
    rows += [(3, "secret0003")] * 3 + [(None, "a secret0007")] * 2
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    rules = spark.createDataFrame([("r", f"secret{k:04}", 1) for k in range(n)], "rule string, literal string, needed int")
    got = sorted((r.i or 0, r.matched, r.hits) for r in content.pattern_rules(df, "i", "t", rules).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 2), (2, 2, 2)] + [(3, 1, 1)] * 3 + [(0, 1, 1)] * 3)
    known = spark.createDataFrame([(f"secret{k:04}",) for k in range(n)], "secret string")
    found = logs.known_secret_scan(df, "i", "t", known).collect()
    assert sorted(r.i or 0 for r in found) == [0, 0, 0, 1, 2, 2, 2, 3, 3, 3]


MIXED = [
    ("a", "text", "ab", 2), ("a", "text", "$$", 2), ("a", "regex", "b+a[^a]", 2), ("b", "regex", "a*", 1), ("b", "regex", "x|é", 1), ("c", "hex", "61 62", 1),
    ("c", "hex", "C3 ?9 [0-2] 61", 1), ("d", "hex", "(24 | 61 61) 2E", 1), ("d", "regex", r"a\.b", 1), ("e", "regex", "", 1), ("e", "regex", None, 1), ("f", "text", "", 0),
]


def test_patterns_of_all_kinds(spark, monkeypatch):
    rng = random.Random(14)
    texts = ["".join(rng.choice("aabb.é€$x") for _ in range(rng.randrange(0, 50))) for _ in range(120)] + ["", None]

    def count(kind, pattern, t):
        if not pattern or t is None:
            return 0
        if kind == "text":
            return t.count(pattern)
        if kind == "hex":
            t, pattern = t.encode().decode("latin-1"), patterns.hex_regex(pattern)
        return sum(m.group(0) != "" for m in re.finditer(pattern, t))

    want = set()
    for i, t in enumerate(texts):
        for rule in "abcdef":
            mine = [r for r in MIXED if r[0] == rule]
            counts = [count(k, p, t) for _, k, p, _ in mine]
            matched = sum(c > 0 for c in counts)
            if matched >= mine[0][3]:
                want.add((i, rule, matched, sum(counts)))
    rule_df = spark.createDataFrame(MIXED, "rule string, kind string, pattern string, needed int")
    assert {tuple(r) for r in content.pattern_rules(docs(spark, *texts), "i", "t", rule_df).collect()} == want
    monkeypatch.setattr(content, "policy_rows", lambda t, n: sizing.policy_rows(t, 0))
    monkeypatch.setattr(content, "RULE_LITERALS_IN_PLAN", 1)
    assert {tuple(r) for r in content.pattern_rules(docs(spark, *texts), "i", "t", rule_df).collect()} == want


def test_every_match_holds_the_required_literal():
    """Random patterns of all parts against random texts; and patterns whose literal is known."""
    rng = random.Random(15)
    parts = ["a", "b", "ab", ".", "[ab]", "[]a]", "[^a]", "(ab)", "(?:a|b)", r"\.", r"\x61", r"\d", "^", r"\b", "(?=a)", "c"]
    counts = ["", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,}", "*?", "+?"]
    seen = 0
    for _ in range(3000):
        regex = "".join(p + (rng.choice(counts) if p not in ("^", r"\b", "(?=a)", "ab") else "") for p in rng.choices(parts, k=rng.randrange(1, 6)))
        literal = patterns.required_literal(regex)
        text = "".join(rng.choice("aabbc.]1") for _ in range(30))
        for match in re.finditer(regex, text):
            seen += literal is not None
            assert literal is None or literal in match.group(0), (regex, literal, match)
    assert seen > 500
    known = {"abc+d?ef": "abc", "a|b": None, r"(foo)?bar\.baz[0-9]{2,}q": "bar.baz", "(?i)abc": None, r"a\Qb\Ec": None, "[a-z]*": None, r"\x{41}b": None}
    assert {p: patterns.required_literal(p) for p in known} == known
    for bad in ("4", "4G", "41 [", "zz"):
        with pytest.raises(ValueError):
            patterns.hex_regex(bad)


def test_log_lines_written_and_read_again(spark):
    """Commands quoted as Python does, and the same rows after the way there and back."""
    commands = ["ls", "it's", 'say "x"', "both ' and \"", "a\\b\n\r\t\x00\x7f", "é€ \xa0​\U0001f600\U000e0001", "", " x ", "'", '"', "\\'", "x\u0085y", "ab" * 2000]
    rows = [(i, "exec", c, None, True, i % 2 == 0) for i, c in enumerate(commands)] + [(90, "leak", None, "/w/ a", None, None), (91, "timeout_kill", None, "c-1", None, None),
            (92, "partial_cleanup", None, "/w", None, None)]
    df = spark.createDataFrame(rows, "i int, kind string, cmd string, target string, raw boolean, granted boolean").withColumns(
        {"log_ts": F.expr("timestamp_micros(1700000000123000 + i)"), "level": F.lit("INFO"), "image": F.when(F.col("kind") == "exec", "base"),
         "network": F.when(F.col("kind") == "exec", "none"), "timeout": F.when(F.col("kind").isin("exec", "timeout_kill"), 60), "n_files": F.when(F.col("kind") == "exec", 2)}
    )
    lines = logs.exec_log_write(df)
    for r in lines.where("kind = 'exec'").collect():
        assert r.line.split(" cmd=", 1)[1] == repr(r.cmd)
        assert r.line.startswith("2023-11-14 22:13:20,123 INFO exec image=base network=none raw=True(granted=")
    names = ["i", "kind", "cmd", "target", "raw", "granted", "level", "image", "network", "timeout", "n_files"]
    again = logs.exec_log_parse(lines.select("i", "line")).select(names).orderBy("i").collect()
    assert again == df.select(names).orderBy("i").collect()
    bare = spark.createDataFrame([("other", "free text")], "kind string, message string").selectExpr(
        "*", "CAST(NULL AS TIMESTAMP) log_ts", "CAST(NULL AS STRING) level", *[f"CAST(NULL AS STRING) {c}" for c in ("image", "network", "cmd", "target")],
        "CAST(NULL AS BOOLEAN) raw", "CAST(NULL AS BOOLEAN) granted", "CAST(NULL AS INT) timeout", "CAST(NULL AS INT) n_files",
    )
    assert logs.exec_log_write(bare).first().line == "free text"


def test_occurrences_leave_a_worker_in_small_batches(monkeypatch):
    """Bodies full of one byte: a worker holds a few of the occurrences at a time."""
    import pyarrow as pa

    monkeypatch.setattr(content, "PLACES_AT_ONCE", 7)
    arrow = pa.schema([("_id", pa.int64()), ("signature", pa.string()), ("offset", pa.int64())])
    bodies = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([b"a" * 30, None, b"ba"], pa.binary())], names=["_id", "_body"])
    out = list(content._found_places([bodies], [("x", b"a", None)], arrow))
    assert max(b.num_rows for b in out) == 7
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(5, "x", n) for n in range(30)] + [(7, "x", 1)]


def test_patterns_run_only_where_their_literal_stands(spark, monkeypatch):
    """A text with the piece of a literal and not the literal is not searched."""
    monkeypatch.setattr(content, "RULE_LITERALS_IN_PLAN", 1)
    rules = spark.createDataFrame([("r", "regex", "abcd[a-z]{2,}s", 1), ("t", "regex", "[A-Z]?bcdxy +z", 1)], "rule string, kind string, pattern string, needed int")
    items = spark.createDataFrame([(1, "abcdxxs abcdees"), (2, "abc d"), (3, "bcdx y z Abcdxy  z"), (4, None)], "i long, body string")
    hits = content._pattern_hits(items.selectExpr("CAST(i AS string) AS _key", "body AS _text"), content.compiled_rules(rules).select("kind", "regex", "literal"))
    assert "contains" in hits._jdf.queryExecution().optimizedPlan().toString().lower()
    got = content.pattern_rules(items, "i", "body", rules).collect()
    assert sorted(map(tuple, got)) == [(1, "r", 1, 2), (3, "t", 1, 1)]


def test_a_longer_list_gives_no_more_candidates_by_chance(spark, monkeypatch):
    """Keys in hex next to a short secret: a text with another key meets none of the list."""
    secrets = [f"key-{hashlib.md5(str(k).encode()).hexdigest()}" for k in range(3000)] + ["two words"]
    texts = [f"x {hashlib.md5(str(k).encode()).hexdigest()} words" for k in range(5000, 5400)] + [f"y{secrets[7]}z {secrets[8]}", "has two words"]
    candidates, met = content._candidates, []

    def counted(*args):
        found = candidates(*args)
        met.append(found.count())
        return found

    monkeypatch.setattr(content, "_candidates", counted)
    known = spark.createDataFrame([(s,) for s in secrets], "secret string")
    got = {tuple(r) for r in logs.known_secret_scan(docs(spark, *texts), "i", "t", known).collect()}
    assert got == {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in ((400, secrets[7]), (400, secrets[8]), (401, "two words"))}
    assert met == [3]


def test_every_piece_of_a_literal_is_met_at_any_place(monkeypatch):
    """Texts cut into segments, empty ones and neighbours whose ends make up a literal together."""
    import numpy as np
    import pyarrow as pa

    from auditloom.functions import textpieces

    monkeypatch.setattr(textpieces, "SEGMENT", 7)
    rng = random.Random(16)
    literals = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(n)) for n in (1, 2, 3, 4, 7, 8, 15, 16, 17, 40)]
    texts = [b"", b"zz" + literals[-1][:20], literals[-1][20:], b"", *(b"q" * rng.randrange(9) + x + b"q" * rng.randrange(9) for x in literals), b""]
    column = pa.array([b"cut off", *texts], pa.binary()).slice(1)
    rows, widths, pieces = textpieces.literal_pieces(*textpieces.flat(pa.array(literals, pa.binary())))
    assert [int((rows == i).sum()) for i in range(len(literals))] == [1, 1, 2, 1, 2, 1, 2, 1, 2, 3]
    full = np.full(128, 255, np.uint8)
    met = {(int(r), int(p)) for rs, ps in textpieces.held_pieces(*textpieces.flat(column), list(textpieces.WIDTHS), full) for r, p in zip(rs, ps)}
    for i, literal in enumerate(literals):
        mine = {int(p) for p in pieces[rows == i]}
        width = int(widths[rows == i][0])
        parts = {literal[min(k, len(literal) - width) :][:width] for k in range(0, len(literal), width)}
        for n, text in enumerate(texts):
            assert sum((n, p) in met for p in mine) == sum(part in text for part in parts), (i, n)


def test_a_list_of_kinds_is_judged_in_place(spark, monkeypatch):
    """Only the rows are dealt out; null and repeated ids, null texts, rules that always hold, and the same answers by joins."""
    monkeypatch.setattr(content, "RULE_LITERALS_IN_PLAN", 3)
    monkeypatch.setattr(content, "PAIRS_AT_ONCE", 5)  # many batches per batch
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(30)]
    listed = [(f"r{i % 7}", ("text", "regex", "hex")[i % 3], w if i % 3 == 0 else w + "[a-c]*" if i % 3 == 1 else w.encode().hex(" "), i % 4) for i, w in enumerate(words)]
    listed += [("loose", "regex", "a|é", 1), ("loose", "regex", "b*", 2), ("open", "hex", "?? 6?", 1), ("none", None, None, 0), (None, "text", words[0], 1), ("unset", "text", "a", None)]
    rules = spark.createDataFrame(listed, "rule string, kind string, pattern string, needed int")
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)] + ["", None, "aa"]
    df = spark.createDataFrame([(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)] * 2, "i int, t string")
    here = content.pattern_rules(df, "i", "t", rules)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = Counter(map(tuple, here.collect()))
    monkeypatch.setattr(content, "PATTERNS_IN_TASKS", 0)
    joined = content.pattern_rules(df, "i", "t", rules)
    assert got == Counter(map(tuple, joined.collect())) and len(got) > 100
    assert here.schema.simpleString() == joined.schema.simpleString()
    monkeypatch.setattr(content, "RULE_LITERALS_IN_PLAN", 256)
    assert got == Counter(map(tuple, content.pattern_rules(df, "i", "t", rules.where("needed IS NOT NULL AND rule IS NOT NULL").unionByName(rules.where("rule IS NULL").fillna("~", ["rule"]))).replace("~", None, ["rule"]).collect()))


def test_patterns_counted_by_a_worker_match_as_in_spark(spark):
    """Random sequences, alternatives and hex patterns over texts with characters of several bytes; the others are left to Spark."""
    rng = random.Random(22)
    signs, counts = ["a", "b", "ab", " ", r"\.", "[ab]", "[a-c]", "[A-C ]"], ["", "", "", "", "?", "*", "+", "{2}", "{0,2}", "{1,}", "*?", "+?", "{1,3}?"]
    tokens = ["61", "62", "6?", "?1", "??", "C3", "A9", "(61 | 62 ??)", "[1]", "[1-2]", "[0-]"]
    listed = {("regex", "|".join("".join(rng.choice(signs) + rng.choice(counts) for _ in range(rng.randint(1, 5))) for _ in range(rng.choice([1, 1, 1, 2])))) for _ in range(250)}
    listed |= {("hex", patterns.hex_regex(" ".join(rng.choices(tokens, k=rng.randint(1, 5))))) for _ in range(150)}
    texts = ["".join(rng.choice("aaabbbcAB. é€\U0001f600") for _ in range(rng.randrange(60))) for _ in range(12)] + [""]
    known = [(k, r, t, count(t.encode())) for k, r in sorted(listed) if (count := patterns.counter(k, r)) for t in texts]
    assert len(known) > 250 * len(texts) and sum(n for *_, n in known) > 5000
    df = spark.createDataFrame(known, "kind string, regex string, _text string, n int").withColumn("_bytes", content._bytes(F.col("_text")))
    view = F.when(F.col("kind") == "hex", F.col("_bytes")).otherwise(F.col("_text"))
    assert df.where(content._count(F.col("kind"), view, F.col("regex")) != F.col("n")).collect() == []
    for other in ("a.b", "[^a]b", r"\da", "é?", "(a)b", "(?i)ab", "a++", "^a", "a*", r"\x61", "a{,2}b", "[a&&b]"):
        assert patterns.counter("regex", other) is None
    assert patterns.counter("hex", patterns.hex_regex("[0-2]")) is None
