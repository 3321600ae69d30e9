import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm.files import open_input
from auditloom.llm.warc import (
    RECORD_SCHEMA,
    chunked,
    dechunked,
    page_records,
    parse_records,
    read_archives,
    reassemble,
    resolve_revisits,
    write_archives,
)
from auditloom.session import run_folder
from tests.llm.odd import prose

PAGES = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(8)
    long_html, shared = prose(rng, 9000), prose(rng, 50)
    rows = [
        (1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, None, None), (4, "", ""), (5, "http://a/5", shared),
        (9, "http://a/ x\r\nWARC-Type: y", shared), (7, "http://é/7", shared), (8, "u", long_html), (12, "u", long_html),
        (13, "u", "é" * 5000), (14, "u", "x" * 99), (15, "u", "x" * 99), (16, "u", "x" * 100), (17, "u", "x" * 100),
        (5, "http://a/5", shared), (None, "u", shared), (None, "u", "y" * 200), (None, "u", "y" * 200), (20, "u", "\r\n\r\n0\r\n\r\n" * 40),
    ]
    return rows + [(100 + i, f"http://b/{i}", prose(rng, rng.randrange(1, 3000))) for i in range(20)]


def brute_force(rows):
    ids = defaultdict(list)
    for page_id, _, html in rows:
        ids[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        known = [i for i in ids[html or ""] if i is not None]
        first = min(known) if known else None
        again = len(data) >= 100 and page_id != first
        out.append(
            (page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, "ok")
        )
    return out


@pytest.mark.parametrize("segment_bytes, file_bytes", [(16_384, 64_000_000), (500, 3_000)])
def test_round_trip_equals_brute_force(spark, segment_bytes, file_bytes):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("x"), "payload": F.lit(1), "first_id": F.lit(0)})
    files = write_archives(pages.repartition(3), run_folder(spark, "test-warc"), segment_bytes, file_bytes)
    records = read_archives(spark, files)
    got = resolve_revisits(records).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_force(rows))
    contents = Counter(bytes(r.content).decode() for r in records.where("record_type = 'response'").collect())
    want = Counter(r[2] or "" for r, b in zip(rows, brute_force(rows)) if b[3] == "response")
    assert contents == want
    if file_bytes == 3_000:
        assert files.count() > 10


def test_archives_are_standard_files(spark):
    files = write_archives(spark.createDataFrame(page_rows(), PAGES).coalesce(1), run_folder(spark, "test-warc"), 700)
    kinds, numbers, ids = Counter(), defaultdict(list), set()
    for row in files.collect():
        with open_input(row.file) as raw:
            data = raw.read()
        records = list(parse_records(io.BytesIO(gzip.decompress(data))))
        assert len(records) == row.records
        for headers, block in records:
            kinds[headers["warc-type"]] += 1
            assert headers["warc-record-id"] not in ids
            ids.add(headers["warc-record-id"])
            origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
            if "warc-segment-number" in headers:
                numbers[origin].append((int(headers["warc-segment-number"]), len(block), headers.get("warc-segment-total-length")))
    assert set(kinds) == {"response", "revisit", "continuation"}
    for parts in numbers.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1)) and len(parts) > 1
        assert [p[2] for p in parts[:-1]] == [None] * (len(parts) - 1)
        assert int(parts[-1][2]) == sum(p[1] for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunked_framing_round_trip(payload, size):
    framed = chunked(payload, size)
    assert dechunked(framed) == payload
    assert dechunked(framed[:-1]) is None
    assert dechunked(b"zz\r\n" + framed) is None


def segments(spark, change):
    """The parts of one segmented page, changed."""
    rows = []
    for data in page_records(1, "u", b"payload " * 300, "d", None, 600):
        ((headers, block),) = parse_records(io.BytesIO(data))
        rows.append(
            [
                int(headers["x-page-id"]) if "x-page-id" in headers else None, headers["warc-record-id"],
                headers.get("warc-segment-origin-id", headers["warc-record-id"]), headers["warc-type"],
                int(headers["warc-segment-number"]),
                int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None, None, "ok", block,
            ]
        )
    change(rows)
    random.Random(1).shuffle(rows)
    (row,) = reassemble(spark.createDataFrame([tuple(r) for r in rows], RECORD_SCHEMA)).collect()
    return row.status, row.content


def test_damaged_groups_are_told(spark):
    assert segments(spark, lambda rows: None) == ("ok", bytearray(b"payload " * 300))
    assert segments(spark, lambda rows: rows.pop(1)) == ("missing segment", None)
    assert segments(spark, lambda rows: rows.pop()) == ("missing segment", None)
    assert segments(spark, lambda rows: rows.append(list(rows[1]))) == ("missing segment", None)

    def shorten(rows):
        rows[1][8] = rows[1][8][:-1]

    assert segments(spark, shorten) == ("length mismatch", None)

    def garble(rows):
        rows[1][8] = b"\xff" * len(rows[1][8])

    assert segments(spark, garble)[0] in ("broken framing", "ok")


def test_empty_table_and_unresolved_revisit(spark):
    empty = write_archives(spark.createDataFrame([], PAGES), run_folder(spark, "test-warc"))
    assert empty.count() == 0 and resolve_revisits(read_archives(spark, empty)).count() == 0
    lone = spark.createDataFrame([(2, "r", "r", "revisit", None, None, "d", "ok", None)], RECORD_SCHEMA)
    assert [r.status for r in resolve_revisits(lone).collect()] == ["unresolved"]
