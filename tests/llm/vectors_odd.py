"""Vectors with everything that may be odd."""

import random

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = "id long, vector string, dim int, block int, part int, query long, asks boolean, _n int, score double, rank int, positives string, numbers int"


def odd_vectors(seed=1, n=300, dim=8):
    """Nulls anywhere, empty, zero, broken and huge vectors, a group of copies, repeated rows and ids, another length."""
    rng = random.Random(seed)

    def unit():
        return [rng.gauss(0, 1) for _ in range(dim)]

    hot = unit()
    rows = [(i, unit() if i % 3 else hot, rng.randrange(3)) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (1000, None, 1), (1020, [], 1), (1040, [0.0] * dim, 1), (1060, [None, *unit()[1:]], 1), (1080, [nan, *unit()[1:]], 2),
        (1100, [inf, *unit()[1:]], 2), (None, unit(), 1), (None, hot, None), (1150, unit(), None), (1200, [1e30] * dim, 0),
        (1250, [-1e30] * dim, 0), (1300, [1e-30] * dim, 1), (-100, unit(), 1), (-7, hot, 0), (2**62, unit(), 2),
    ]
    rows += [(2000 + 10 * i, [1.0 + i, -2.0, 0.5 * i], i % 2) for i in range(30)]
    rows += [rows[4], rows[4], rows[0], rows[20]]
    return rows


def vectors_frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return df


def usable_rows(rows, zero):
    """Rows that take part, one per id, components as the float column holds them."""
    import numpy as np

    out = {}
    for i, vector, label in rows:
        if i is None or not vector or any(x is None or not np.isfinite(x) for x in vector):
            continue
        exact = [float(np.float32(x)) for x in vector]
        if zero or any(exact):
            out.setdefault(i, (i, exact, label))
    return list(out.values())
