import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditloom.llm import token_stream
from auditloom.llm.queries import QUERIES, TOKENIZER
from auditloom.llm.token_stream import PieceEncoder, SequenceFile, read_index, read_token_stream, write_token_stream
from auditloom.session import run_folder
from tests.llm.odd import frame, odd_rows

PATH = public_tokenizers.path(TOKENIZER)
PLAIN = Tokenizer.from_file(PATH)
ENCODER = PieceEncoder(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sD1 \n\t\r\x0b\x1c\x85\xa0 .é漢<|>#")), max_size=40))
def test_pieces_encode_as_the_whole(text):
    assert ENCODER.encode(text).tolist() == plain_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_whole(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text).tolist() == plain_ids(text)


def test_special_strings_and_forgetting(monkeypatch):
    monkeypatch.setattr(token_stream, "MEMO_PIECES", 3)
    own = PieceEncoder(PATH)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|> y", " lead", "trail ", "it's we'll", "a b c d e f g", "a b"):
        assert own.encode(text).tolist() == plain_ids(text)


def brute_force(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    start, out = 0, []
    for row in sorted(rows, key=key):
        ids = np.array([*plain_ids(row[1]), 2], "<u4")
        out.append((row[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sequence, batch", [(2048, 512), (8, 4)])
def test_files_equal_brute_force(spark, monkeypatch, sequence, batch):
    monkeypatch.setattr(token_stream, "BATCH_SEQUENCES", batch)
    rows = list({r[0]: r for r in odd_rows()}.values())
    folder = run_folder(spark, "test-stream")
    write_token_stream(frame(spark, rows, clash=True), folder, PATH, sequence=sequence)
    if batch == 512:
        got = sorted((tuple(r) for r in read_token_stream(spark, folder).collect()), key=lambda r: r[1])
        assert got == brute_force(rows)
    flat = []
    for name in [r.file for r in read_index(spark, folder).groupBy("part", "file").count().orderBy("part").collect()]:
        with pa.memory_map(name.removeprefix("file:")) as source:
            for part in pa.ipc.open_stream(source):
                assert part.schema.field("ids").type == pa.list_(pa.uint16(), sequence)
                ids, mask = part.column("ids").values.to_numpy(), part.column("mask").values.to_numpy(zero_copy_only=False)
                flat += ids[mask].tolist()
    want = [i for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*plain_ids(row[1]), 2]]
    assert flat == want


def test_sequences_are_views_of_the_file(spark):
    folder = run_folder(spark, "test-stream")
    write_token_stream(frame(spark, odd_rows()).coalesce(1), folder, PATH, sequence=16)
    name = read_index(spark, folder).first().file
    opened = SequenceFile(name)
    before = pa.total_allocated_bytes()
    ids, mask = opened[len(opened) - 2]
    assert pa.total_allocated_bytes() == before and not ids.flags.owndata
    assert len(ids) == len(mask) == 16 and mask.true_count == 16
    assert opened.masked() == read_index(spark, folder).where(f"file = '{name}'").groupBy().sum("n_tokens").first()[0]


def test_repeated_and_missing_ids(spark):
    rows = odd_rows()
    folder = run_folder(spark, "test-stream")
    write_token_stream(frame(spark, rows), folder, PATH)
    got = sorted((tuple(r) for r in read_token_stream(spark, folder).collect()), key=lambda r: r[1])
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute_force(rows))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_empty_table(spark):
    folder = run_folder(spark, "test-stream")
    assert write_token_stream(frame(spark, []), folder, PATH).count() == 0
    assert read_token_stream(spark, folder).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op8_token_stream"][0](spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == brute_force([tuple(r) for r in docs])
