"""Edge rows of requests, files and output, and agreement with Python's own decoders."""

import base64
import binascii
import random

from pyspark.sql import functions as F

from auditloom.operators import logs
from auditloom.functions.codec import is_strict_base64
from auditloom.functions.sizing import small_table
from auditloom.operators import requests as rq
from auditloom.plans.lifecycle import profile_table


def parsed(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    rows = rq.request_validate(rq.request_parse(df, "body")).orderBy("i").collect()
    return rows


def test_parse_image_and_timeout(spark):
    rows = parsed(
        spark, '{"command":"x","image":5}', '{"command":"x","image":[]}', '{"command":"x"}',
        '{"command":"x","timeout":"60"}', '{"command":"x","timeout":5.0}', '{"command":"x","timeout":"x"}',
        '{"command":"x","timeout":5.5}', '{"command', '{"command":"x","image":"heavy","unknown":1}',
        '{"command":"x","timeout":null,"files":null}', '[1]', '{"command":"x","raw":null}',
        '{"command":"x","network":null}', '{"command":"x","files":[5]}', '{"command":" "}',
    )
    assert [r.image for r in rows[:3]] == ["base"] * 3
    assert [r.timeout for r in rows[3:7]] == [60, 5, None, None]
    assert rows[5].violations == ["timeout_type"] and rows[6].violations == ["timeout_type"]
    assert rows[7].is_corrupt and not any(r.is_corrupt for r in rows[:7])
    assert rows[8].image == "heavy" and rows[8].valid
    assert rows[9].valid and rows[9].network == "none" and rows[9].raw is False
    assert "body_type" in rows[10].violations and not rows[10].is_corrupt
    assert rows[11].violations == ["raw_type"]
    assert rows[12].violations == ["network_unknown"]
    assert set(rows[13].violations) == {"file_name", "file_name_length", "file_body"}
    assert rows[14].valid


def test_validate_timeout_and_names(spark):
    names = [".", "..", "a/b", "a\\b", "", "a" * 256, "a.txt\n", "a" * 255, "ok-1_2.bin", "a b", "a\n\n", "a\r"]
    rows = [(i, "x", "none", None, [(n, "")]) for i, n in enumerate(names)]
    rows += [(100 + t, "x", "none", t, []) for t in (4, 5, 1800, 1801)]
    df = spark.createDataFrame(
        rows, "i int, command string, network string, timeout int, files array<struct<name string, b64 string>>"
    )
    got = {r.i: r.valid for r in rq.request_validate(df).collect()}
    assert [got[i] for i in range(len(names))] == [False] * 6 + [True] * 3 + [False] * 3
    assert [got[100 + t] for t in (4, 5, 1800, 1801)] == [False, True, True, False]


def test_profile_clamps(spark):
    rows = [(1, "base", 601), (2, "heavy", 601), (3, None, None), (4, "heavy", None), (5, "gpu", 2), (6, "heavy", 1801)]
    df = spark.createDataFrame(rows, "i int, image string, timeout int")
    got = {r.i: r for r in rq.profile_resolve(df, profile_table(spark), 3).collect()}
    assert [got[i].timeout_eff for i in range(1, 7)] == [600, 601, 60, 300, 5, 1800]
    assert got[2].cpus_eff == "3" and got[1].cpus_eff == "2" and got[5].image_eff == "base"
    odd = small_table(
        spark, [("base", "2g", "lots", 60, 600)],
        "name string, memory string, cpus string, timeout_default int, timeout_cap int",
    )
    assert {r.cpus_eff for r in rq.profile_resolve(df, odd, 3).collect()} == {"lots"}


def test_grants(spark):
    rows = [("none", True, "heavy"), ("egress", True, "base"), ("egress", False, "heavy"), ("bridge", True, "base")]
    df = spark.createDataFrame(rows, "network string, raw boolean, image string")
    got = rq.grant_derive(df, "net", "1.1.1.1", "/sym").collect()
    assert [r.raw_granted for r in got] == [False, True, False, False]
    assert [r.dns for r in got] == [None, "1.1.1.1", "1.1.1.1", None]
    assert [r.symbol_mount for r in got] == ["/sym", None, "/sym", None]
    assert [r.dns for r in rq.grant_derive(df).collect()] == [None] * 4


def test_strict_base64_agrees_with_python(spark):
    rng = random.Random(5)
    alphabet = "AQgw+/9z=\n -_é"
    texts = ["aGVs bG8=", "aGVsbG8", "!!!", "aGVsbG8==", "", "aGVsbG9=", "aGk=\n", "===="]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 13))) for _ in range(3000)]
    texts += [base64.b64encode(rng.randbytes(rng.randrange(0, 20))).decode() for _ in range(300)]

    def fine(text):
        try:
            base64.b64decode(text, validate=True)
            return True
        except (binascii.Error, ValueError):
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.ok for r in df.select("i", is_strict_base64(F.col("t")).alias("ok")).collect()}
    assert all(got[i] == fine(t) for i, t in enumerate(texts))


def test_files_last_name_wins_and_bad_request(spark):
    one, two = (base64.b64encode(b).decode() for b in (b"one", b"two"))
    rows = [
        (1, [("a", one), ("b", one), ("a", two)]),
        (2, [("a", one), ("c", "!!!")]),
        (3, None),
        (4, [("e", "")]),
        (5, []),
    ]
    df = spark.createDataFrame(rows, "i int, files array<struct<name string, b64 string>>")
    files, bad = rq.files_decode(df, "i")
    got = {(r.i, r.name): (bytes(r.body), r.size, r.pos) for r in files.collect()}
    assert got == {(1, "a"): (b"two", 3, 2), (1, "b"): (b"one", 3, 1), (4, "e"): (b"", 0, 0)}
    assert [r.i for r in bad.collect()] == [2]


def test_output_cap_agrees_with_python(spark):
    rng = random.Random(9)
    bodies = ["aé".encode(), b"", b"abc", "€uro".encode(), b"\xff\xfea", b"\xf0\x9f\x98"]
    bodies += [rng.randbytes(rng.randrange(0, 40)) for _ in range(500)]
    bodies += [("é€😀x" * 9).encode()[: rng.randrange(1, 70)] for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, out binary")
    for cap in (1, 2, 17, 1_048_576):
        for r in rq.output_cap(df, "out", cap).collect():
            assert r.out_text == bodies[r.i][:cap].decode("utf-8", errors="replace")
            assert r.out_truncated == (len(bodies[r.i]) > cap)


def test_outcome_needs_marker(spark):
    rows = [(0, False, ""), (0, False, "DONE"), (0, False, "other"), (0, True, "DONE"), (1, False, "DONE"), (None, False, "DONE")]
    df = spark.createDataFrame(rows, "exit_code int, timed_out boolean, stdout string")
    got = [(r.ok, r.success, r.exit_code_eff) for r in rq.outcome_label(df, "DONE").collect()]
    assert got == [
        (True, False, 0), (True, True, 0), (True, False, 0), (False, False, 0), (False, False, 1), (False, False, -1)
    ]


def test_status_precedence(spark):
    names = [
        "is_corrupt", "ip_allowed", "token_set", "auth_ok", "valid", "rate_allowed", "slot_admitted", "bad_base64"
    ]
    bad = [True, False, False, False, False, False, False, True]
    codes = [422, 429, 503, 401, 422, 429, 429, 400]
    rows = []
    for first in range(len(names)):
        row = [bad[i] if i >= first else not bad[i] for i in range(len(names))]
        rows.append((first, *row))
    rows.append((99, *[not b for b in bad]))
    schema = "i int, " + ", ".join(f"{n} boolean" for n in names) + ", ip_retry_after int, rate_retry_after int, slot_retry_after int"
    df = spark.createDataFrame([(*r, 3, 7, 5) for r in rows], schema)
    got = {r.i: (r.status, r.retry_after) for r in rq.status_classify(df).collect()}
    assert [got[i][0] for i in range(len(names))] == codes
    assert got[99] == (200, None)
    assert (got[1][1], got[5][1], got[6][1], got[0][1]) == (3, 7, 5, None)
    assert rq.status_classify(df.select("i", "auth_ok")).where("i = 3").first().status == 401


def test_commands_come_back_from_their_repr(spark):
    rng = random.Random(4)
    signs = ["a", " ", "'", '"', "\\", "\n", "\r", "\t", "\x1b", "\x00", "\u200b", "\u00e9", "\U0001f600", "\U000e0001", "x41", "\\n", "\x7f", "\xad"]
    commands = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    line = "2024-01-01 00:00:00,000 INFO exec image=base network=none raw=False(granted=False) timeout=60s files=0 cmd="
    df = spark.createDataFrame([(i, line + repr(c)) for i, c in enumerate(commands)], "i int, line string")
    got = {r.i: r.cmd for r in logs.exec_log_parse(df).collect()}
    assert got == dict(enumerate(commands))


def test_known_secrets_of_any_shape(spark):
    import hashlib

    secrets = ["s3cr3t", "p.q/r+s=t", "with space", "x", "longer-token_0123456789"]
    texts = ["key s3cr3t.", "(p.q/r+s=t)", "a with space b", "no such thing", "say 'longer-token_0123456789', yes", "ab3s3cr3tz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sha = {s: hashlib.sha256(s.encode()).hexdigest() for s in secrets}
    values = spark.createDataFrame([(s,) for s in [*secrets, ""]], "secret string")
    got = {tuple(r) for r in logs.known_secret_scan(df, "i", "t", values).collect()}
    assert got == {(i, sha[s]) for i, t in enumerate(texts) for s in secrets if s in t}
    for columns in ([(sha[s],) for s in secrets], [(sha[s], len(s)) for s in secrets]):
        hashes = spark.createDataFrame(columns, "sha256 string" + (", length int" if len(columns[0]) == 2 else ""))
        got = {tuple(r) for r in logs.known_secret_scan(df, "i", "t", hashes).collect()}
        assert got == {(0, sha["s3cr3t"]), (1, sha["p.q/r+s=t"]), (4, sha["longer-token_0123456789"])}


def test_status_counts_move_narrow_rows_only(spark, sf_dir):
    from auditloom.plans.request_queries import status_counts

    plan = status_counts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line or "MapInArrow" in line]
    assert moved and not any(name in line for line in moved for name in ("command", "stdout", "stderr", "props", "memory"))
    assert plan.count("MapInArrow") == 1
