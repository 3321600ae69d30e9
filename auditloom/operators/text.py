"""Text, JSON and checks over observed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.sizing import BROADCAST_BYTES, BROADCAST_ROWS, is_small, policy_rows, small_table
from auditloom.session import settle


def json_project(
    df: DataFrame,
    json_col: str,
    fields: dict[str, str],
    defaults: dict,
    paths: dict[str, str] | None = None,
) -> DataFrame:
    """Read `fields` (name to type) from a JSON column, one column each.

    `paths` names the place of a field that is not at the top. A field in `defaults` takes its default where it is missing, null or false,
    also when the whole text is not JSON.
    """
    parsed = df.withColumn("_v", F.try_parse_json(json_col))
    columns = {}
    for name, kind in fields.items():
        path = (paths or {}).get(name, f"$.{name}")
        value = F.try_variant_get("_v", path, kind)
        if name in defaults:
            is_false = F.coalesce(
                (F.schema_of_variant(F.try_variant_get("_v", path, "variant")) == "BOOLEAN")
                & ~F.try_variant_get("_v", path, "boolean"),
                F.lit(False),
            )
            value = F.coalesce(F.when(~is_false, value), F.lit(defaults[name]).cast(kind))
        columns[name] = value
    return parsed.withColumns(columns).drop("_v")


def stream_rows(df: DataFrame, streams: tuple[str, ...] = ("stdout", "stderr")) -> DataFrame:
    """One row per non-empty stream column: the other columns, stream, text."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("stream"), F.col(s).alias("text")) for s in streams]
    )
    kept = F.filter(entries, lambda e: F.coalesce(e["text"], F.lit("")) != "")
    others = [c for c in df.columns if c not in streams]
    return df.select(*others, F.inline(kept))


def _lines(text: Column) -> Column:
    """Lines without the empty piece after a final line break."""
    parts = F.split(text, "\n")
    ends_open = F.element_at(parts, -1) == ""
    return F.when(ends_open, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _emit(df: DataFrame, col: str, lines: Column, positions: Column) -> DataFrame:
    others = [c for c in df.columns if c != col]
    picked = F.transform(
        positions, lambda p: F.struct((p + 1).alias("line_no"), F.get(lines, p).alias("line"))
    )
    return df.select(*others, F.inline(picked))


def marker_context(
    df: DataFrame, col: str, marker: str, after: int, limit: int | None = None
) -> DataFrame:
    """Lines holding `marker` and `after` lines behind each, overlaps once.

    Every hit reaches at most to the line before the next hit, so the ranges are
    disjoint and the work stays linear in the text, inside the row.
    """
    prepared = df.withColumn("_lines", _lines(F.col(col)))
    hits = F.filter(
        F.transform("_lines", lambda line, i: F.when(F.contains(line, F.lit(marker)), i)),
        lambda i: i.isNotNull(),
    )
    prepared = prepared.withColumn("_hits", hits).where(F.size("_hits") > 0)
    final = F.size("_lines") - 1
    ranges = F.transform(
        "_hits",
        lambda h, i: F.sequence(
            h, F.least(h + after, F.coalesce(F.get("_hits", i + 1) - 1, final), final)
        ),
    )
    positions = F.flatten(ranges)
    if limit is not None:
        positions = F.slice(positions, 1, limit)
    rows = _emit(prepared, col, F.col("_lines"), positions)
    return rows.drop("_lines", "_hits")


def marker_tail(df: DataFrame, col: str, marker: str) -> DataFrame:
    """Lines from the first one holding `marker` to the end."""
    prepared = df.withColumn("_lines", _lines(F.col(col))).withColumn(
        "_first",
        F.array_position(F.transform("_lines", lambda line: F.contains(line, F.lit(marker))), True) - 1,
    )
    found = prepared.where(F.col("_first") >= 0)
    positions = F.sequence(F.col("_first").cast("int"), F.size("_lines") - 1)
    return _emit(found, col, F.col("_lines"), positions).drop("_lines", "_first")


def head_lines(df: DataFrame, col: str, n: int) -> DataFrame:
    """First `n` lines of each row's text, in order."""
    prepared = df.withColumn("_lines", F.slice(_lines(F.col(col)), 1, n)).where(F.size("_lines") > 0)
    positions = F.sequence(F.lit(0), F.size("_lines") - 1)
    return _emit(prepared, col, F.col("_lines"), positions).drop("_lines")


def strip_space(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]", "")


# KEY=value, KEY=rcN tM and KEY_rc=N tM lines of a probe run.
PROBE_KEY = r"^[A-Za-z][A-Za-z0-9]*(_rc)?\z"
PROBE_RC = r"^(?:rc)([0-9]+)"
PROBE_BARE_RC = r"^([0-9]+)"
PROBE_SECONDS = r"(?:^|\s)t([0-9]+)\z"


def _number(digits: Column) -> Column:
    # Most values hold no number, and a failed cast is slow.
    return F.when(digits != "", digits.try_cast("int"))


def probe_parse(df: DataFrame, col: str) -> DataFrame:
    """Labelled lines of a probe run as rows: key, value, rc, t.

    `rc` and `t` are null where the line carries none. Other lines are skipped.
    """
    others = [c for c in df.columns if c != col]
    lines = df.select(*others, F.explode(_lines(F.col(col))).alias("_line"))
    at = F.instr("_line", "=")
    parts = lines.where(at > 1).select(
        *others,
        F.substring_index("_line", "=", 1).alias("_label"),
        F.expr("substring(_line, instr(_line, '=') + 1)").alias("value"),
    )
    bare = F.col("_label").endswith("_rc")
    rc = F.when(bare, F.regexp_extract("value", PROBE_BARE_RC, 1)).when(
        F.col("value").startswith("rc"), F.regexp_extract("value", PROBE_RC, 1)
    )
    seconds = F.when(F.contains("value", F.lit("t")), F.regexp_extract("value", PROBE_SECONDS, 1))
    return parts.where(F.col("_label").rlike(PROBE_KEY)).select(
        *others,
        F.when(bare, F.expr("substring(_label, 1, length(_label) - 3)"))
        .otherwise(F.col("_label"))
        .alias("key"),
        "value",
        _number(rc).alias("rc"),
        _number(seconds).alias("t"),
    )


def expectation_suite(
    expectations: DataFrame,
    observed: DataFrame,
    run: str | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """PASS or FAIL per expectation, and per run if `run` names its column.

    `expectations` has name, key, operator, expected; `observed` has key, value.
    Operators: eq, prefix, ge, le, empty, non_empty, ne (each passes if any
    observation of the key does) and ne_key (non-empty and different from the value
    of the key named in `expected`). A key that was never observed fails; `runs`
    adds runs without any observation. `value` is the largest observed one.

    Each expectation is judged by itself, also where names repeat. A grid of all runs and expectations, which is as large as the result,
    meets two narrow tables in equi joins on (run, number of the expectation): what passes, and the largest value per watched key (a
    top-1 window, cut down before its shuffle). Nothing is gathered per run, so a run may hold any share of the observations and
    there may be any number of expectations. A null run is a run of its own. Without expectations the result is empty. The
    expectations are numbered when the plan is built, a long list in a table written for it.
    """
    group = run or "_run"
    fields = ["name", "key", "operator", "expected"]
    short = policy_rows(expectations.select(*fields))
    if short is not None:
        schema = T.StructType([*expectations.select(*fields).schema.fields, T.StructField("_check", T.LongType())])
        checks = small_table(expectations.sparkSession, [(*r, i) for i, r in enumerate(short)], schema)
    else:
        checks = settle(expectations.select(*fields, F.monotonically_increasing_id().alias("_check")))
    # Watched keys are up to twice as many as the expectations.
    fits = short is not None or is_small(checks, BROADCAST_ROWS // 2, BROADCAST_BYTES // 2)
    near = F.broadcast if fits else (lambda side: side)
    pairs = checks.where("operator = 'ne_key'").select("_check", "key", F.col("expected").alias("_other"))
    has_pairs = policy_rows(pairs, 0) is None if short is None else any(r["operator"] == "ne_key" for r in short)
    watched = checks.select("key")
    if has_pairs:
        watched = watched.unionByName(pairs.select(F.col("_other").alias("key")))
    named = observed if run else observed.withColumn(group, F.lit(0))
    seen = named.select(group, "key", "value").join(near(watched.distinct()), "key", "left_semi")

    value, expected = F.col("value"), F.col("expected")
    numbers = value.try_cast("double"), expected.try_cast("double")
    tests = {
        "eq": value == expected,
        "ne": value != expected,
        "prefix": value.startswith(expected),
        "ge": numbers[0] >= numbers[1],
        "le": numbers[0] <= numbers[1],
        "empty": value == "",
        "non_empty": value != "",
    }
    holds = F.coalesce(*[F.when(F.col("operator") == name, test) for name, test in tests.items()], F.lit(False))
    passed = seen.join(near(checks), "key").where(holds).select(group, "_check")

    largest = Window.partitionBy(group, "key").orderBy(F.desc_nulls_last("value"))
    top = seen.withColumn("_rank", F.row_number().over(largest)).where("_rank = 1").select(group, "key", "value")
    if has_pairs:
        mine = top.join(near(pairs), "key").select(group, "_check", "_other", F.col("value").alias("_mine"))
        others = top.select(F.col(group).alias("_group"), F.col("key").alias("_other"), "value")
        met = mine.join(others, mine[group].eqNullSafe(others["_group"]) & (mine["_other"] == others["_other"]))
        passed = passed.unionByName(met.where("_mine != '' AND _mine != value").select(group, "_check"))
    values = top.join(near(checks.select("_check", "key")), "key").select(F.col(group).alias("_group"), F.col("_check").alias("_at"), "value")
    passes = passed.distinct().select(F.col(group).alias("_in"), F.col("_check").alias("_passed"))

    if run:
        runs_of = [source.select(run) for source in (observed, runs) if source is not None]
        all_runs = reduce(DataFrame.unionByName, runs_of).distinct()
    else:
        all_runs = small_table(observed.sparkSession, [(0,)], "_run int")
    grid = all_runs.crossJoin(near(checks.select("_check")))  # the result has a row for each run and check
    filled = grid.join(values, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_check") == F.col("_at")), "left").join(
        passes, F.col(group).eqNullSafe(F.col("_in")) & (F.col("_check") == F.col("_passed")), "left"
    )
    result = F.when(F.col("_passed").isNotNull(), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("result")
    named_checks = near(checks.select("_check", "name", "key"))
    return filled.join(named_checks, "_check").select(*([run] if run else []), "name", "key", "value", result)


def gate(results: DataFrame, by: str | None = None) -> DataFrame:
    """Number of checks and failures, and whether everything passed."""
    grouped = results.groupBy(by) if by else results.groupBy()
    return grouped.agg(
        F.count("*").alias("checks"), F.count_if(F.col("result") == "FAIL").alias("fails")
    ).withColumn("passed", F.col("fails") == 0)
