"""Run registered queries next to their SQL answers: python tests/oracle_check.py [sf_dir] [name ...]"""

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, float):
        return format(value, ".9g")
    return str(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)
    return hashlib.sha256("\x1e".join(lines).encode("utf-8", "replace")).hexdigest(), lines


KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
}


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if df.columns else "no columns"
    answer = con.sql(sql)
    names, types = answer.columns, [str(t) for t in answer.types]
    expected = answer.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [
        (n, spark_types[n], t) for n, t in zip(names, types) if KIND.get(spark_types[n], "?") != t
    ]
    if wrong:
        return f"types {wrong}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    mine, my_lines = digest(df.columns, rows)
    theirs, their_lines = digest(names, expected)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(my_lines, their_lines) if a != b]
        return f"{len(bad)} rows differ, e.g. {bad[0][0][:400]!r} / {bad[0][1][:400]!r}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from auditloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = []
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - begin:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(len(failed), "failed", failed)
