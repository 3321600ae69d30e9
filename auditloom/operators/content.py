"""Triage of file and text corpora: hashes, types, strings, rules, signatures."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom.functions import textpieces
from auditloom.functions.bytescan import Signatures
from auditloom.functions.patterns import compiled, counter
from auditloom.functions.sizing import is_small, policy_rows, small_side
from auditloom.functions.skew import spread_join
from auditloom.session import settle

# Leading bytes (hex) of common file types, most specific first.
MAGIC = (
    ("elf", "7F454C46"),
    ("pe", "4D5A"),
    ("pdf", "255044462D"),
    ("ole", "D0CF11E0A1B11AE1"),
    ("zip", "504B0304"),
    ("gzip", "1F8B"),
    ("png", "89504E470D0A1A0A"),
    ("jpeg", "FFD8FF"),
    ("gif", "47494638"),
    ("html", "3C21444F43545950452068746D6C"),
    ("html", "3C21646F63747970652068746D6C"),
    ("html", "3C68746D6C"),
    ("html", "3C48544D4C"),
    ("xml", "3C3F786D6C"),
    ("script", "2321"),
)
STRING_MIN, STRING_LIMIT = 8, 50
PRINTABLE = r"[\x20-\x7E\t]"


def file_inventory(df: DataFrame, path: str, body: str) -> DataFrame:
    """Path, size and SHA-256 of every file; one narrow pass over the bodies."""
    return df.select(
        path, F.octet_length(body).cast("long").alias("size"), F.sha2(F.col(body), 256).alias("sha256")
    )


def duplicate_groups(inventory: DataFrame, path: str) -> DataFrame:
    """Groups of files with the same content: copies, first path, bytes that could go.

    Counted before the shuffle, so a body that fills a third of the corpus
    arrives as one row per task.
    """
    return (
        inventory.groupBy("sha256", "size")
        .agg(F.count("*").alias("copies"), F.min(path).alias("first_path"))
        .where(F.col("copies") > 1)
        .withColumn("spare_bytes", (F.col("copies") - 1) * F.col("size"))
    )


def glob_counts(df: DataFrame, path: str, globs: list[str]) -> DataFrame:
    """Number of files per glob (`*` any run of characters, `?` one)."""
    matches = []
    for glob in globs:
        regex = "".join(
            ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/ " else "\\" + c
            for c in glob
        )
        matches.append(F.when(F.col(path).rlike(f"(?s)^{regex}\\z"), F.lit(glob)))
    return (
        df.select(F.explode(F.array_compact(F.array(*matches))).alias("glob"))
        .groupBy("glob")
        .agg(F.count("*").alias("files"))
    )


def pinned_hash_verify(inventory: DataFrame, pins: DataFrame, name: str) -> DataFrame:
    """Compare `inventory.sha256` with `pins.pinned`: match, drift, missing_file, missing_pin."""
    pin = F.nullif(F.trim("pinned"), F.lit(""))
    status = (
        F.when(F.col("_in_pins").isNull() | F.col("_pin").isNull(), F.lit("missing_pin"))
        .when(F.col("sha256").isNull(), F.lit("missing_file"))
        .when(F.lower("_pin") == F.col("sha256"), F.lit("match"))
        .otherwise(F.lit("drift"))
    )
    marked = pins.select(name, pin.alias("_pin"), F.lit(True).alias("_in_pins"))
    return (
        inventory.select(name, "sha256")
        .join(marked, name, "full_outer")
        .select(name, status.alias("status"))
        .withColumn("failed", F.col("status") != "match")
    )


def file_type_tag(df: DataFrame, body: str, signatures=MAGIC, default: str = "data") -> DataFrame:
    """Add `file_type`: the first signature, in list order, the body starts with."""
    longest = max(len(prefix) for _, prefix in signatures) // 2
    head = F.hex(F.substring(F.col(body), 1, longest))
    tests = [F.when(head.startswith(prefix), F.lit(kind)) for kind, prefix in signatures]
    return df.withColumn("file_type", F.coalesce(*tests, F.lit(default)))


def printable_strings(
    df: DataFrame, col: str, n: int = STRING_MIN, limit: int | None = STRING_LIMIT
) -> DataFrame:
    """Runs of at least `n` printable characters, the first `limit` per item, in order."""
    runs = F.regexp_extract_all(F.col(col), F.lit(f"{PRINTABLE}{{{n},}}"), F.lit(0))
    if limit is not None:
        runs = F.slice(runs, 1, limit)
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(runs).alias("pos", "string"))


RULE_LITERALS_IN_PLAN = 256


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules as rows rule, kind, regex, literal, needed: what is counted, and a text that every match holds (null if none is sure)."""
    named = "pattern" if "pattern" in rules.columns else "literal"
    kind = F.col("kind") if "kind" in rules.columns else F.lit("text")
    listed = rules.select("rule", F.coalesce(kind, F.lit("text")).alias("kind"), F.nullif(named, F.lit("")).alias("regex"), "needed")
    if "kind" not in rules.columns:
        return listed.withColumn("literal", F.col("regex")).distinct()

    def compile_all(batches):
        for batch in batches:
            kinds, patterns = batch.column("kind").to_pylist(), batch.column("regex").to_pylist()
            done = [compiled(k, p) if p is not None else (None, None) for k, p in zip(kinds, patterns)]
            columns = {n: batch.column(n) for n in ("rule", "kind", "needed")}
            columns |= {"regex": pa.array([d[0] for d in done], pa.string()), "literal": pa.array([d[1] for d in done], pa.string())}
            yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema.fields})

    schema = T.StructType([*listed.schema.fields, T.StructField("literal", T.StringType())])
    return settle(listed.distinct().mapInArrow(compile_all, schema)).distinct()


def pattern_rules(df: DataFrame, row_id: str, col: str, rules: DataFrame) -> DataFrame:
    """Rules that hold per item: `(id, rule, matched, hits)`.

    `rules` has one row per pattern: rule, literal or pattern, needed and, if wanted, kind: `text` (as it stands), `regex`, or `hex` (bytes of the text in UTF-8,
    see `hex_regex`). A rule holds when at least `needed` of its distinct patterns occur ("any" is 1, "all" is their number);
    with `needed` 0 it holds for every item. `hits` adds up the occurrences, which do not overlap and are not empty. Empty and null
    patterns are left out: they never match.

    A short rule set becomes column expressions, one pass and no shuffle. A longer one looks for a piece of a text that every match of a pattern
    holds (`required_literal`) among the pieces of the texts (`_candidates`), and counts a pattern where its piece is. Patterns
    without such a text are counted in every item, RULE_LITERALS_IN_PLAN in a pass. Rows are told apart by what they hold: ids may be null or repeat, and
    rows with equal id and text each have their own answer. A list with kinds that the tasks can hold goes to them with the job (`_rules_in_place`).
    """
    listed = compiled_rules(rules)
    short = policy_rows(listed, RULE_LITERALS_IN_PLAN)
    if short is not None:
        patterns = sorted({(r["kind"], r["regex"]) for r in short if r["regex"] is not None})
        views = df.select(row_id, F.col(col).alias("_text"), *([_bytes(F.col(col)).alias("_bytes")] if any(k == "hex" for k, _ in patterns) else []))
        counted = views.select(
            row_id, *[_count(F.lit(kind), _view(kind), F.lit(regex), kind).alias(f"_n{i}") for i, (kind, regex) in enumerate(patterns)]
        )
        by_rule: dict = {}
        for r in short:
            names = by_rule.setdefault((r["rule"], r["needed"]), [])
            if r["regex"] is not None:
                names.append(f"_n{patterns.index((r['kind'], r['regex']))}")
        verdicts = [
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(needed).cast("int").alias("needed"),
                sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names), F.lit(0)).alias("matched"),
                sum((F.col(n) for n in names), F.lit(0)).alias("hits"),
            )
            for (rule, needed), names in sorted(by_rule.items())
        ]
        if not verdicts:
            return counted.select(row_id, F.lit("").alias("rule"), F.lit(0).alias("matched"), F.lit(0).alias("hits")).where("false")
        return (
            counted.select(row_id, F.inline(F.array(*verdicts)))
            .where(F.col("matched") >= F.col("needed"))
            .select(row_id, "rule", "matched", "hits")
        )
    listed = settle(listed)
    # Pieces of regular expressions and hex patterns are short and stand in many texts: too many pairs to write down.
    if "kind" in rules.columns and is_small(listed) and listed.limit(PATTERNS_IN_TASKS + 1).count() <= PATTERNS_IN_TASKS:
        return _rules_in_place(df, row_id, col, listed)
    keyed = df.select(F.col(row_id), _row_key(F.col(row_id), F.col(col)).alias("_key"), F.col(col).alias("_text"))
    hits = _pattern_hits(keyed.select("_key", "_text"), listed.where("regex IS NOT NULL").select("kind", "regex", "literal").distinct())
    needs = listed.select("rule", "needed", F.col("kind").alias("_kind"), F.col("regex").alias("_regex"))
    counted = hits.join(small_side(needs), ["_kind", "_regex"]).select("_key", "rule", "needed", "_n")
    always = listed.where("needed <= 0").select("rule", "needed").distinct()
    if policy_rows(always, 0) is None:  # rules that hold for every item, of which each then has a row
        every = keyed.select("_key").distinct().crossJoin(small_side(always)).withColumn("_n", F.lit(0))
        counted = counted.unionByName(every)
    held = (
        counted.groupBy("_key", "rule", "needed")
        .agg(F.count_if(F.col("_n") > 0).cast("int").alias("matched"), F.sum("_n").cast("int").alias("hits"))
        .where(F.col("matched") >= F.col("needed"))
    )
    answers = held.groupBy("_key").agg(F.collect_list(F.struct("rule", "matched", "hits")).alias("_held"))
    # One row per text and id that any rule holds for; equal rows meet it by number, so that none is lost or merged.
    return spread_join(keyed.select(row_id, "_key"), settle(answers), "_key").where("_held IS NOT NULL").select(row_id, F.inline("_held"))


def _row_key(row_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart that differ in id or text; null is not empty."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("="), text), F.lit(""))).cast("binary"))


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, each as a character."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _view(kind: str) -> Column:
    return F.col("_bytes" if kind == "hex" else "_text")


def _count(kind: Column, text: Column, regex: Column, known: str | None = None) -> Column:
    """Occurrences of a pattern that are not empty; `known` is the kind where it is the same for all rows."""
    found = F.filter(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: m != "")
    matches = F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0))
    if known is not None:
        return _occurrences(text, regex) if known == "text" else matches
    return F.when(kind == "text", _occurrences(text, regex)).otherwise(matches)


#: Patterns of a list that goes to the tasks with the job, and pairs of a text and a pattern or rule that leave a worker at once.
PATTERNS_IN_TASKS, PAIRS_AT_ONCE = 100_000, 100_000


def _rules_in_place(df: DataFrame, row_id: str, col: str, listed: DataFrame) -> DataFrame:
    """`pattern_rules` with all work on a text done in its row: its candidates, the counts of their patterns and the rules that hold.

    Nothing but the rows is written down, once, as they are dealt to as many tasks as are set: searching costs far more than the bytes tell.
    """
    spark = df.sparkSession
    named = listed.where("regex IS NOT NULL").select(F.col("kind").alias("_kind"), F.col("regex").alias("_regex"), F.col("literal").alias("_literal")).distinct()
    patterns = named.collect()
    number = {(p["_kind"], p["_regex"]): i for i, p in enumerate(patterns)}
    rules = listed.where("needed IS NOT NULL").collect()
    rows = df.select(F.col(row_id).alias("_id"), F.col(col).alias("_text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    # The pieces of all kinds are sought in the bytes of the text.
    literal = F.when(F.col("_kind") == "hex", F.encode("_literal", "ISO-8859-1")).otherwise(F.encode("_literal", "UTF-8"))
    anchors = _anchors(named.where("_literal IS NOT NULL").select("_kind", "_regex", literal.alias("_literal"))).collect()
    pieces = np.array([a["_piece"] for a in anchors], np.int64).view(np.uint64)
    numbers = np.array([number[a["_kind"], a["_regex"]] for a in anchors], np.int64)
    index = textpieces.PieceIndex(pieces, numbers, sorted({a["_width"] for a in anchors}), _n_bits(max(len(anchors), 1), MAX_BITS))
    fields = "_counts array<struct<_p int, _n int>>, _wanted array<struct<_p int, _kind string, _regex string, _literal string>>"
    searched = T.StructType([rows.schema["_id"], rows.schema["_text"], *T.StructType.fromDDL(fields).fields])
    search = _Search([tuple(p) for p in patterns], index, to_arrow_schema(searched))
    sought = rows.select("_id", F.col("_text").cast("binary").alias("_text"))
    texts = sought.mapInArrow(search.batches, searched).withColumn("_bytes", _bytes(F.col("_text")))

    def view(p: Column) -> Column:
        return F.when(p["_kind"] == "hex", F.col("_bytes")).otherwise(F.col("_text"))

    held = F.filter("_wanted", lambda p: p["_literal"].isNull() | F.contains(view(p), p["_literal"]))
    counts = F.transform(held, lambda p: F.struct(p["_p"].alias("_p"), _count(p["_kind"], view(p), p["_regex"]).alias("_n")))
    counted = texts.select("_id", F.concat("_counts", F.filter(counts, lambda c: c["_n"] > 0)).alias("_counts"))
    verdicts = T.StructType([rows.schema["_id"], listed.schema["rule"], *T.StructType.fromDDL("matched int, hits int").fields])
    judge = _Judge(rules, number, to_arrow_schema(verdicts))
    return counted.mapInArrow(judge.verdicts, verdicts).withColumnRenamed("_id", row_id)


class _Search:
    """Rows of (id, bytes of a text) to (id, text, counts of patterns that occur, patterns that Spark has to count); a text that none of those is left for comes out null."""

    def __init__(self, patterns: list[tuple], index: textpieces.PieceIndex, arrow: pa.Schema):
        self.patterns, self.index, self.arrow = patterns, index, arrow
        self.loose = [i for i, (_, _, literal) in enumerate(patterns) if literal is None]

    def batches(self, batches):
        for batch in batches:
            bodies = batch.column(1)
            row, p = self.index.held(bodies.fill_null(b""))
            pairs = np.unique(row * max(len(self.patterns), 1) + p)
            row, p = np.divmod(pairs, max(len(self.patterns), 1))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            counts, wanted, texts, held = [], [], [], 0
            for i, body in enumerate(bodies):
                found, left = [], []
                if body.is_valid:
                    body = body.as_py()
                    for k in [*self.loose, *p[ends[i] : ends[i + 1]].tolist()]:
                        kind, regex, literal = self.patterns[k]
                        count = counter(kind, regex)
                        if count is None:
                            left.append((k, kind, regex, literal))
                        elif n := count(body):
                            found.append((k, n))
                counts.append(found), wanted.append(left), texts.append(body if left else None)
                held += len(found) + len(left) + 1
                if held > PAIRS_AT_ONCE or i + 1 == batch.num_rows:
                    yield self._packed(batch.column(0).slice(i + 1 - len(counts), len(counts)), texts, counts, wanted)
                    counts, wanted, texts, held = [], [], [], 0

    def _packed(self, ids: pa.Array, texts: list, counts: list, wanted: list) -> pa.RecordBatch:
        columns = [ids, pa.array(texts, pa.binary()).cast(self.arrow.field(1).type)]
        for rows, field in zip((counts, wanted), list(self.arrow)[2:]):
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            parts = list(zip(*(x for r in rows for x in r))) or [()] * field.type.value_type.num_fields
            kinds = list(field.type.value_type)
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, kinds)], fields=kinds)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), values).cast(field.type))
        return pa.RecordBatch.from_arrays(columns, names=self.arrow.names)


class _Judge:
    """The rules that hold for rows of (id, array of (number of a pattern, occurrences))."""

    def __init__(self, rules: list, number: dict, arrow: pa.Schema):
        names = sorted({(r["rule"], r["needed"]) for r in rules}, key=repr)
        place = {name: i for i, name in enumerate(names)}
        self.arrow, self.names = arrow, pa.array([n for n, _ in names], arrow.field(1).type)
        self.needed = np.array([n for _, n in names], np.int64)
        self.always = np.nonzero(self.needed <= 0)[0]
        uses = sorted({(number[r["kind"], r["regex"]], place[r["rule"], r["needed"]]) for r in rules if r["regex"] is not None})
        self.rules = np.array([rule for _, rule in uses], np.int64)
        self.starts = np.searchsorted([p for p, _ in uses], np.arange(len(number) + 1))

    def verdicts(self, batches):
        for batch in batches:
            # Rows times rules that hold for all of them are bounded here.
            step = max(1, PAIRS_AT_ONCE // max(1, len(self.always)))
            for at in range(0, batch.num_rows, step):
                yield self._judged(batch.slice(at, step))

    def _judged(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = batch.column(1)
        row = np.repeat(np.arange(batch.num_rows), counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = counts.flatten()
        p, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        uses = self.starts[p + 1] - self.starts[p]
        nth = np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
        rule = self.rules[np.repeat(self.starts[p], uses) + nth]
        many = max(len(self.needed), 1)
        every = (np.arange(batch.num_rows)[:, None] * many + self.always).ravel()
        pairs, place = np.unique(np.concatenate([np.repeat(row, uses) * many + rule, every]), return_inverse=True)
        place = place[: len(rule)]
        matched = np.bincount(place, minlength=len(pairs))
        hits = np.zeros(len(pairs), np.int64)
        np.add.at(hits, place, np.repeat(n, uses))
        holds = matched >= self.needed[pairs % many] if len(pairs) else np.zeros(0, bool)
        pairs = pairs[holds]
        columns = [batch.column(0).take(pa.array(pairs // many)), self.names.take(pa.array(pairs % many))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(matched[holds], pa.int32()), pa.array(hits[holds], pa.int32())], names=self.arrow.names)


def _pattern_hits(keyed: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences of each pattern per distinct row: `(_key, _kind, _regex, _n)`, none without one."""
    named = patterns.select(F.col("kind").alias("_kind"), F.col("regex").alias("_regex"), F.col("literal").alias("_literal"))
    out = "_key string, _kind string, _regex string, _n int"
    parts = [keyed.sparkSession.createDataFrame([], out)]
    with_bytes = keyed.withColumn("_bytes", _bytes(F.col("_text")))
    found = []
    for is_hex in (False, True):
        listed = named.where((F.col("_kind") == "hex") == is_hex).where("_literal IS NOT NULL")
        if listed.limit(1).count():
            found.append(_candidates(with_bytes, "_key", "_bytes" if is_hex else "_text", listed))
    if found:
        wanted = reduce(DataFrame.unionByName, found).groupBy("_key").agg(F.collect_set(F.struct("_kind", "_regex", "_literal")).alias("_wanted"))
        # Searching costs far more than the bytes tell, so the texts stay in as many partitions as are set.
        width = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = keyed.repartition(width, "_key").join(wanted, "_key").withColumn("_bytes", _bytes(F.col("_text")))

        def view(p: Column) -> Column:
            return F.when(p["_kind"] == "hex", F.col("_bytes")).otherwise(F.col("_text"))

        def counted(p: Column) -> Column:
            return F.struct(p["_kind"].alias("_kind"), p["_regex"].alias("_regex"), _count(p["_kind"], view(p), p["_regex"]).alias("_n"))

        # The piece stands in most texts that lack the rest of its literal; looking for that costs far less than the pattern.
        held = F.filter("_wanted", lambda p: F.contains(view(p), p["_literal"]))
        # Rows with equal keys find the same, which counts once here.
        parts.append(texts.select("_key", F.inline(F.transform(held, counted))).where("_n > 0").distinct())
    loose = sorted((r["_kind"], r["_regex"]) for r in named.where("_literal IS NULL").collect())
    for at in range(0, len(loose), RULE_LITERALS_IN_PLAN):
        some = loose[at : at + RULE_LITERALS_IN_PLAN]
        rows = F.array(
            *[F.struct(F.lit(k).alias("_kind"), F.lit(r).alias("_regex"), _count(F.lit(k), _view(k), F.lit(r), k).alias("_n")) for k, r in some]
        )
        parts.append(with_bytes.select("_key", F.inline(rows)).where("_n > 0").distinct())
    return reduce(DataFrame.unionByName, parts)


def _occurrences(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a literal; a text without it costs one search."""
    removed = F.char_length(text) - F.char_length(F.replace(text, literal, F.lit("")))
    return F.when(F.contains(text, literal), (removed / F.char_length(literal)).cast("int")).otherwise(0)


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, also where `body` uses it inside of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _anchors(patterns: DataFrame) -> DataFrame:
    """`(_kind, _regex, _literal, _width, _piece)`: for each pattern the hash of the piece of its literal that the fewest patterns share.

    The pieces cover the literal side by side, so that two literals of one length that differ have one in which they do.
    """
    schema = T.StructType([*patterns.schema.fields, *T.StructType.fromDDL("_width int, _piece bigint").fields])
    arrow = to_arrow_schema(schema)

    def cut(batches):
        for batch in batches:
            rows, widths, pieces = textpieces.literal_pieces(*textpieces.flat(batch.column("_literal")))
            columns = [c.take(pa.array(rows)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(widths, pa.int32()), pa.array(pieces.view(np.int64))], names=arrow.names)

    pieces = patterns.mapInArrow(cut, schema)
    shared = settle(pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_shared")).where("_shared > 1"))
    rarest = F.min(F.struct(F.coalesce("_shared", F.lit(1)).alias("n"), "_piece", "_width")).alias("_best")
    best = pieces.join(small_side(shared), "_piece", "left").groupBy(*patterns.columns).agg(rarest)
    return best.select(*patterns.columns, "_best._width", "_best._piece")


def _candidates(df: DataFrame, row_id: str, col: str, patterns: DataFrame) -> DataFrame:
    """`(id, _kind, _regex, _literal)` where the text has the piece of the pattern's literal; a row per distinct pair.

    A text that holds a literal holds every piece of its bytes, at whatever place, so all places are hashed, once per width in
    use. Only pieces that a bit set of the literals' pieces lets by become rows, to meet the literals in a join. Pieces of long literals are so long that a longer list
    does not make a text meet more of them by chance.
    """
    anchors = settle(_anchors(patterns))
    widths = sorted(r["_width"] for r in anchors.select("_width").distinct().collect())
    if not widths:
        return df.select(row_id, *[F.lit("").alias(c) for c in patterns.columns]).where("false")
    side = anchors.drop("_width")
    bits = _piece_bits(side)
    schema = T.StructType([df.schema[row_id], *T.StructType.fromDDL("_piece bigint").fields])
    arrow = to_arrow_schema(schema)

    def held(batches):
        for batch in batches:
            for rows, pieces in textpieces.held_pieces(*textpieces.flat(batch.column(1)), widths, bits):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pieces.view(np.int64))], names=arrow.names)

    rows = df.where(F.col(col).isNotNull()).select(row_id, F.col(col).cast("binary")).mapInArrow(held, schema)
    return rows.join(F.broadcast(side) if is_small(side) else side, "_piece").select(row_id, *patterns.columns).distinct()


#: Bits per piece of a list, and the most of a bit set: 16 MiB, which go out to the tasks. A longer list lets more pieces by, and loses none.
BITS_PER_PIECE, MAX_BITS = 16, 1 << 27


def _n_bits(pieces: int, most: int) -> int:
    return min(most, max(1024, 1 << (pieces * BITS_PER_PIECE - 1).bit_length()))


def _bit_words(places: DataFrame, bits: int) -> np.ndarray:
    """The bits at the `at` of all rows as 64-bit words. The driver holds these alone, a fixed size whatever the length of the list."""
    words = places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    table = np.zeros(bits // 64, dtype="<i8")
    arrow = words.groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    table[arrow.column("word").to_numpy()] = arrow.column("held").to_numpy()
    return table


def _piece_bits(anchors: DataFrame) -> np.ndarray:
    """A bit set of the hashes `_piece`, as bytes: each sets the bits that `textpieces.places` names."""
    listed = anchors.select("_piece").distinct()
    bits = _n_bits(listed.count(), MAX_BITS)
    at = F.array(*[F.shiftrightunsigned("_piece", shift).bitwiseAND(F.lit(bits - 1).cast("long")) for shift in textpieces.SHIFTS])
    return _bit_words(listed.select(F.explode(at).alias("at")), bits).view(np.uint8)


#: The most bits of a bit set that is held in the plan: 1 MiB.
MAX_PLAN_BITS = 1 << 23


def _piece_test(anchors: DataFrame):
    """A test for a piece inside of a row: false for nearly all that are not among the pieces of `anchors`, true for all that are.

    Each piece sets the bit that its hash names. Long lists of literals have their own bit set (`_piece_bits`).
    """
    listed = anchors.select("_piece").distinct()
    bits = _n_bits(listed.count(), min(MAX_BITS, MAX_PLAN_BITS))

    def place(piece: Column) -> Column:
        return F.xxhash64(piece).bitwiseAND(F.lit(bits - 1))

    table = _bit_words(listed.select(place(F.col("_piece")).alias("at")), bits)
    # One literal of the plan, folded from a text: an array column of as many literals would be a tree of them.
    held = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")

    def test(piece: Column) -> Column:
        word = F.get(held, F.shiftright(place(piece), 6).cast("int"))
        return F.call_function("bit_get", word, place(piece).bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


SIGNATURES_AT_ONCE = 100_000


def signature_scan(df: DataFrame, row_id: str, body: str, signatures: list[str]) -> DataFrame:
    """Byte offset of every non-overlapping occurrence of a text's UTF-8 bytes: `(id, signature, offset)`.

    `body` is a binary column. An empty signature occurs nowhere. Bodies stay where they are; see `signature_table_scan`.
    """
    return _scan(df, row_id, body, [(s, s.encode("utf-8"), None) for s in dict.fromkeys(signatures)], "string")


def signature_table_scan(df: DataFrame, row_id: str, body: str, signatures: DataFrame) -> DataFrame:
    """Byte offset of every non-overlapping occurrence of each signature: `(id, signature, offset)`, a row each.

    `signatures` has signature (a name), bytes (binary) and, if wanted, mask (binary): a byte of the body fits where it agrees with `bytes` in
    the bits of the mask. A mask that is null or shorter has all bits set for the rest; a signature that is null or empty occurs
    nowhere. An index of pieces of up to four bytes finds candidates, all bytes decide. The index goes to the tasks with the
    job, SIGNATURES_AT_ONCE signatures at a time; a longer table takes more passes over the bodies, which are not shuffled.
    """
    mask = F.col("mask") if "mask" in signatures.columns else F.lit(None).cast("binary")
    listed = signatures.select("signature", F.col("bytes").alias("_bytes"), mask.alias("_mask")).where(F.octet_length("_bytes") > 0)
    listed = listed.distinct()
    kind = signatures.schema["signature"].dataType.simpleString()
    count = listed.count()
    if count <= SIGNATURES_AT_ONCE:
        return _scan(df, row_id, body, [(r[0], bytes(r[1]), r[2] and bytes(r[2])) for r in listed.collect()], kind)
    parts = settle(listed.repartitionByRange(-(-count * 2 // SIGNATURES_AT_ONCE), "signature", "_bytes", "_mask").withColumn("_part", F.spark_partition_id()))
    scans = []
    for r in parts.select("_part").distinct().collect():
        rows = parts.where(F.col("_part") == r["_part"]).drop("_part").collect()
        scans.append(_scan(df, row_id, body, [(x[0], bytes(x[1]), x[2] and bytes(x[2])) for x in rows], kind))
    return reduce(DataFrame.unionByName, scans)


def _scan(df: DataFrame, row_id: str, body: str, signatures: list[tuple], kind: str) -> DataFrame:
    rows = df.select(F.col(row_id).alias("_id"), F.col(body).cast("binary").alias("_body"))
    schema = T.StructType([rows.schema["_id"], *T.StructType.fromDDL(f"signature {kind}, offset bigint").fields])
    arrow = to_arrow_schema(schema)

    return rows.mapInArrow(lambda batches: _found_places(batches, signatures, arrow), schema).withColumnRenamed("_id", row_id)


#: Occurrences that a worker holds before it hands them on.
PLACES_AT_ONCE = 50_000


def _found_places(batches, signatures: list[tuple], arrow: pa.Schema):
    """Batches of (id, signature, offset), each of PLACES_AT_ONCE rows at most, however many occurrences a batch of bodies has."""
    known = Signatures(signatures)
    for batch in batches:
        owners, names, offsets = [], [], []

        def packed() -> pa.RecordBatch:
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(names, arrow.field(1).type), pa.array(offsets, pa.int64())]
            for held in (owners, names, offsets):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, names=arrow.names)

        for i, value in enumerate(batch.column(1)):
            for name, at in known.occurrences(value.as_buffer() or b""):
                owners.append(i), names.append(name), offsets.append(at)
                if len(owners) == PLACES_AT_ONCE:
                    yield packed()
        if owners:
            yield packed()


def keyword_profile(df: DataFrame, row_id: str, col: str, keywords: dict[str, str]) -> DataFrame:
    """Long table `(id, keyword, n)` of every watch keyword, zero counts included.

    `keywords` maps a name to a pattern.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("keyword"), F.regexp_count(F.col(col), F.lit(regex)).alias("n"))
            for name, regex in keywords.items()
        ]
    )
    return df.select(row_id, F.inline(entries))


def keyword_flags(
    df: DataFrame, row_id: str, col: str, keywords: dict[str, str], suspicious: list[str]
) -> DataFrame:
    """Wide table with one count per keyword and `suspicious`, true if a listed one occurs."""
    counts = {
        name: F.regexp_count(F.col(col), F.lit(regex)) for name, regex in keywords.items()
    }
    wide = df.select(row_id, *[c.alias(name) for name, c in counts.items()])
    flag = F.greatest(*[F.col(name) for name in suspicious], F.lit(0)) > 0
    return wide.withColumn("suspicious", flag)


def findings_filter(
    df: DataFrame,
    severities: list[str] | None = None,
    tags: list[str] | None = None,
    statuses: list[int] | None = None,
) -> DataFrame:
    """Findings that meet every given condition: severity, any tag, status code."""
    kept = df
    if severities is not None:
        kept = kept.where(F.col("severity").isin(*severities))
    if statuses is not None:
        kept = kept.where(F.col("status").isin(*statuses))
    if tags is not None:
        wanted = F.array(*[F.lit(t) for t in tags])
        kept = kept.where(F.arrays_overlap("tags", wanted))
    return kept


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))
