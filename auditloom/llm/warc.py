"""WARC archives: write pages as segmented, chunked records, read them back whole.

A payload of at least `REVISIT_BYTES` that equals an earlier one becomes a revisit
record. A block longer than the segment size is cut: the first record carries
segment number 1, continuation records name it as their origin, the last one states
the total length. Reading groups the continuations by origin identifier, orders them by
segment number, verifies numbers and total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import lean
from auditloom.llm.files import open_input, open_output, task_file
from auditloom.session import settle

REVISIT_BYTES = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_BYTES = 64_000_000

# The record format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD_SCHEMA = (
    "page_id bigint, record_id string, origin_id string, record_type string, segment int, total_length bigint, "
    "payload_digest string, status string, content binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or unfinished."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        digits = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            return None
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(parts) if body.endswith(b"\r\n\r\n") else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, framing undone if it has any; None if broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in headers if value is not None)]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def page_records(page_id, url, payload: bytes | None, digest: str, first_id, segment_bytes: int):
    """The records of a page: one response, cut into segments where it is long, or one revisit."""

    def new_id():
        return f"<urn:uuid:{uuid.uuid4()}>"

    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    own = [("WARC-Target-URI", target), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    record_id = new_id()
    if payload is None:
        yield record(
            [
                ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *own, ("WARC-Profile", REVISIT_PROFILE),
                ("X-Refers-To-Page-ID", first_id),
            ],
            b"",
        )
        return
    block = HTTP_HEAD + chunked(payload)
    segments = range(0, len(block), segment_bytes)
    for number, at in enumerate(segments, 1):
        piece = block[at : at + segment_bytes]
        first = number == 1
        headers = [
            ("WARC-Type", "response" if first else "continuation"),
            ("WARC-Record-ID", record_id if first else new_id()),
            ("WARC-Segment-Origin-ID", None if first else record_id),
            ("WARC-Segment-Number", number if len(segments) > 1 else None),
            ("WARC-Segment-Total-Length", len(block) if number == len(segments) > 1 else None),
        ]
        yield record(headers + own if first else headers, piece)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `payload`, `digest`, `first_id`: the payload is null and `first_id` set where an equal one is archived.

    Digests are counted first, so a payload that most pages share is one row of
    the side that the pages join.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    long_enough = F.octet_length("payload") >= REVISIT_BYTES
    firsts = settle(
        rows.where(long_enough)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("f_digest"), "first_id")
    )
    again = F.col("f_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(firsts, F.col("digest") == F.col("f_digest"), "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest",
        F.when(again, F.col("first_id")).alias("first_id"),
    )


def write_archives(
    pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, **columns
) -> DataFrame:
    """Write `.warc.gz` files below `folder`; return their list (`file`, `records`), kept as Parquet beside them.

    Of equal payloads of at least REVISIT_BYTES, the page with the smallest id is the
    response, the others revisit it; pages without an id revisit a page that has one,
    and are responses if none has. Rows that repeat the smallest id are responses each.
    A null html is an empty payload; a null url leaves the target out; control
    characters in it are escaped. Long payloads are cut into segments, which may
    run over into the next file. An empty table writes no file. Other columns are not read.
    """
    spark = pages.sparkSession

    def write(batches):
        out, name, n, size = None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first_id"))):
                for data in page_records(*(v.as_py() for v in row), segment_bytes):
                    if out is None:
                        name, n, size = task_file(folder, ".warc.gz"), 0, 0
                        out = open_output(name)
                    packed = gzip.compress(data, 3, mtime=0)
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    mark_revisits(pages, **columns).mapInArrow(lean(write), "file string, records bigint").write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def parse_records(stream):
    """(headers with lower-case names, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def read_records(files: DataFrame, segmented: bool) -> DataFrame:
    """Records of the listed files by RECORD_SCHEMA.

    `segmented` asks for the records that are part of a segmented block, `content` being
    their piece; otherwise for whole records, `content` being the payload, with the framing undone.
    """

    def whole_number(text):
        return None if text is None else int(text)

    def read(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with open_input(file) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse_records(stream):
                        kind, part = headers.get("warc-type"), "warc-segment-number" in headers
                        if part != segmented or kind not in ("response", "revisit", "continuation"):
                            continue
                        content, status = block, "ok"
                        if not part:
                            content = payload_of(block) if kind == "response" else None
                            status = "broken framing" if kind == "response" and content is None else "ok"
                        rows.append(
                            (
                                whole_number(headers.get("x-page-id")), headers["warc-record-id"],
                                headers.get("warc-segment-origin-id", headers["warc-record-id"]), kind,
                                whole_number(headers.get("warc-segment-number")),
                                whole_number(headers.get("warc-segment-total-length")),
                                headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, status, content,
                            )
                        )
                        held += len(block) + 500
                        if held > 8_000_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    # A row is a whole file's work, so each gets a task whatever the size of the rows.
    return files.select("file").repartition(max(1, files.count())).mapInArrow(lean(read), RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per origin: `page_id`, `record_id`, `record_type`, `payload_digest`, `status`, `content`.

    Segments are grouped by origin identifier (one group is one block, as large as its
    page) and ordered by number. `status` tells `missing segment` (numbers not 1 to n once each, or no
    last one), `length mismatch` (not the stated total), `broken framing`, or `ok`; only then is there content.
    """
    segment = F.struct("segment", "total_length", "page_id", "record_type", "payload_digest", "content")
    groups = parts.groupBy("origin_id").agg(F.sort_array(F.collect_list(segment)).alias("segments"))

    def join(batches):
        for batch in batches:
            for origin, segments in zip(batch.column("origin_id"), batch.column("segments")):
                yield _batch([_joined(origin.as_py(), segments.as_py())])

    return groups.mapInArrow(lean(join), RECORD_SCHEMA).drop("segment", "total_length", "origin_id")


def _joined(origin: str, segments: list[dict]) -> tuple:
    first, last = segments[0], segments[-1]
    block, content, status = b"".join(s["content"] for s in segments), None, "ok"
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or last["total_length"] is None:
        status = "missing segment"
    elif last["total_length"] != len(block):
        status = "length mismatch"
    else:
        content = payload_of(block)
        status = "broken framing" if content is None else "ok"
    return (first["page_id"], origin, origin, "response", None, None, first["payload_digest"], status, content)


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The pages of the listed archives: `page_id`, `record_id`, `record_type`, `payload_digest`, `status`, `content`.

    Whole records are decoded where they are read; only segments are shuffled.
    """
    whole = read_records(files, segmented=False).drop("segment", "total_length", "origin_id")
    return whole.unionByName(reassemble(read_records(files, segmented=True)))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per page: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`, `status`.

    Digests of responses are taken from their payload and held against the header. A revisit gets
    size and `refers_to` from the response with its digest; without one its status is `unresolved`.
    """
    stated = F.col("payload_digest")
    actual = F.sha2("content", 256)
    narrow = settle(
        records.select(
            "page_id", "record_type", F.coalesce(actual, stated).alias("payload_digest"),
            F.octet_length("content").cast("long").alias("payload_bytes"),
            F.when(actual != stated, F.lit("digest mismatch")).otherwise(F.col("status")).alias("status"),
        )
    )
    responses = settle(
        narrow.where("record_type = 'response' AND status = 'ok'")
        .groupBy(F.col("payload_digest").alias("r_digest"))
        .agg(F.min("page_id").alias("r_page"), F.max("payload_bytes").alias("r_bytes"))
    )
    revisit = F.col("record_type") == "revisit"
    joined = narrow.join(responses, revisit & (F.col("payload_digest") == F.col("r_digest")), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(revisit, F.col("r_page")).alias("refers_to"),
        F.when(revisit & F.col("r_digest").isNull(), F.lit("unresolved")).otherwise(F.col("status")).alias("status"),
    )
