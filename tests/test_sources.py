"""Files in and out."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditloom import session
from auditloom.operators.content import file_inventory, findings_filter, glob_counts
from auditloom.operators.requests import request_parse
from auditloom.sources import files


def write(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(body.encode() if isinstance(body, str) else body)


def test_bodies_and_responses(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    write(folder, "in.jsonl", '{"command":"x","timeout":"9"}\nbroken\n')
    rows = request_parse(files.read_bodies(spark, folder), "body").orderBy("is_corrupt").collect()
    assert [(r.command, r.timeout, r.is_corrupt) for r in rows] == [("x", 9, False), (None, None, True)]
    out = tempfile.mkdtemp(prefix="run-") + "/out"
    files.write_responses(spark.createDataFrame([(1, None)], "id int, stdout string"), out)
    assert json.loads(files.read_bodies(spark, out).first().body) == {"id": 1, "stdout": None}
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_responses(spark.createDataFrame([(1, None)], "id int, stdout string"), out)


def test_corpus(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    write(folder, "a/one.bin", b"\x00\x01")
    write(folder, "a/b/two.bin", b"\xff")
    write(folder, "a/three.txt", "text")
    corpus = files.read_corpus(spark, folder, "*.bin")
    inventory = file_inventory(corpus, "path", "body")
    assert {os.path.basename(r.path): r.size for r in inventory.collect()} == {"one.bin": 2, "two.bin": 1}
    write(folder, "a/empty +%41 \u00e9.bin", b"")
    write(folder, "a/empty.txt", b"")
    inventory = file_inventory(files.read_corpus(spark, folder, "*.bin"), "path", "body")
    assert {os.path.basename(r.path): r.size for r in inventory.collect()} == {"one.bin": 2, "two.bin": 1, "empty +%41 \u00e9.bin": 0}
    none = tempfile.mkdtemp(prefix="run-")
    write(none, "only.bin", b"")
    assert [(r.length, bytes(r.body)) for r in files.read_corpus(spark, none).collect()] == [(0, b"")]
    counts = glob_counts(files.read_corpus(spark, folder, "*[!y].???").where("length > 0"), "path", ["*.bin", "*/a/b/*", "*.gone"])
    assert {r.glob: r.files for r in counts.collect()} == {"*.bin": 2, "*/a/b/*": 1}


def test_templates(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    write(folder, "cves/a.yaml", "id: a\ninfo:\n  severity: Critical\n  tags: cve, exposure ,\n")
    write(folder, "misc/b.yaml", "id: b\ninfo:\n  severity: low\n")
    write(folder, "misc/readme.md", "severity: high\n")
    got = {os.path.basename(r.path): (r.severity, r.tags) for r in files.read_templates(spark, folder).collect()}
    assert got == {"a.yaml": ("critical", ["cve", "exposure"]), "b.yaml": ("low", [])}
    kept = findings_filter(files.read_templates(spark, folder), ["critical", "high"], ["cve"])
    assert kept.count() == 1


def test_settings_and_log(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    write(folder, "egress.env", "VPN=1\n# note\nIFACE=wg0\nURL=a=b\n")
    got = {r.key: r.value for r in files.read_settings(spark, folder).collect()}
    assert got == {"VPN": "1", "IFACE": "wg0", "URL": "a=b"}
    assert files.read_log(spark, folder).count() == 4


def test_partitioned_table(spark):
    out = tempfile.mkdtemp(prefix="run-") + "/out"
    files.write_table(spark.range(10).withColumn("half", F.col("id") % 2), out, ["half"])
    assert spark.read.parquet(out).where("half = 1").count() == 5


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_partitions_are_all_read_back_and_pruned(spark):
    out = f"{session.run_folder(spark, 'partitions')}/rows"
    rows = [(i, "FOP"[i % 3]) for i in range(30)]
    files.write_table(spark.createDataFrame(rows, "id long, status string"), out, ["status"])
    back = spark.read.parquet(out)
    assert sorted((r.id, r.status) for r in back.collect()) == rows
    pruned = back.where("status <> 'P'")
    assert "PartitionFilters: [isnotnull(status" in pruned._jdf.queryExecution().executedPlan().toString()
    assert len(pruned.inputFiles()) >= 1 and pruned.count() == 20


def test_template_folders_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    from auditloom.plans import source_queries

    monkeypatch.setattr(source_queries, "run_folder", lambda spark, name: str(tmp_path / name))
    (tmp_path / "in").mkdir()
    spark.range(1, 41).selectExpr("id AS s_suppkey", "id % 3 AS s_nationkey").coalesce(1).write.parquet(str(tmp_path / "in" / "supplier.parquet"))
    got = {r.key: (r.severity, r.tags) for r in source_queries.template_tree(spark, str(tmp_path / "in")).collect()}
    assert got == {k: (("critical", "high", "low", None)[k % 4], f"cve,nation{k % 3},x") for k in range(1, 41)}
    files = list((tmp_path / "template-tree" / "rows").glob("key=*/part-*.txt"))
    assert len(files) == 40 and len({f.name[:10] for f in files}) > 1
