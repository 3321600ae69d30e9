"""Service log lines and secrets in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.sizing import policy_rows, small_side
from auditloom.operators.content import pattern_rules

# The formats of the service's log lines.
STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}) ([A-Z]+) (.*)$"
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
EXEC = (
    r"^exec image=(\S+) network=(\S+) raw=(True|False)\(granted=(True|False)\)"
    r" timeout=([0-9]+)s files=([0-9]+) cmd=(.*)$"
)
TIMEOUT_KILL = r"^timeout after ([0-9]+)s; killing container (\S+)$"
PARTIAL_CLEANUP = r"^workdir (.+) not fully removed; using root-container cleanup$"
LEAK = r"^workdir LEAK: could not remove (.+)$"

FOUND = "\x01"

# The carriers of a bearer token, as name and pattern.
SECRET_PATTERNS = (
    ("bearer_header", r"Authorization: Bearer [A-Za-z0-9._~+/=-]+"),
    ("token_assignment", r'token = "[^"]+"'),
)
MASK = "[redacted]"


# The escapes of a Python `repr`.
ESCAPED = r"\\(?:x[0-9a-f]{2}|u[0-9a-f]{4}|U[0-9a-f]{8}|[\s\S])|[^\\]+"
SHORT_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _unquote(quoted: Column) -> Column:
    """Inside of a quoted command with its escapes undone, as Python's `repr` wrote them.

    Lone surrogates, which no text in UTF-8 can hold, become U+FFFD.
    """
    inner = F.regexp_extract(quoted, r"(?s)^(['\"])(.*)\1$", 2)

    def plain(piece: Column) -> Column:
        kind, rest = F.substring(piece, 2, 1), F.substring(piece, 3, 8)
        code = F.decode(F.unhex(F.lpad(rest, 8, "0")), "UTF-32")
        short = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SHORT_ESCAPES.items()], kind)
        return (
            F.when(~piece.startswith("\\"), piece)
            .when(kind.isin("x", "u", "U") & (F.char_length(piece) > 2), code)
            .otherwise(short)
        )

    pieces = F.regexp_extract_all(inner, F.lit(ESCAPED), F.lit(0))
    return F.when(F.contains(inner, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(inner)


#: What Python's `repr` escapes besides backslash and quote: anything but the blank that has no visible form.
UNSEEN = r"[\p{C}\p{Z}&&[^ ]]"


def _quote(text: Column) -> Column:
    """A text as Python's `repr` writes it."""

    def escaped(sign: Column) -> Column:
        code = F.lower(F.hex(F.encode(sign, "UTF-32")))
        short = [F.when(sign == v, F.lit("\\" + k)) for k, v in SHORT_ESCAPES.items()]
        wide = (
            F.when(code < "00000100", F.concat(F.lit("\\x"), F.right(code, F.lit(2))))
            .when(code < "00010000", F.concat(F.lit("\\u"), F.right(code, F.lit(4))))
            .otherwise(F.concat(F.lit("\\U"), code))
        )
        return F.when(sign.rlike(f"^{UNSEEN}\\z"), F.coalesce(*short, wide)).otherwise(sign)

    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    pieces = F.regexp_extract_all(doubled, F.lit(f"{UNSEEN}|[\\s\\S&&[^\\p{{C}}\\p{{Z}}]| ]+"), F.lit(0))
    seen = F.when(doubled.rlike(UNSEEN), F.array_join(F.transform(pieces, escaped), "")).otherwise(doubled)
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), seen, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(seen, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def exec_log_write(df: DataFrame, line: str = "line") -> DataFrame:
    """Add the log line of typed rows, the way back of `exec_log_parse`; works on tables and streams.

    Reads the columns that `exec_log_parse` adds, and `message` for rows of any other kind, empty without it. A row without
    `log_ts` or `level` is its message alone; a field that is null is written as `None`, as the service would.
    """

    def said(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    def flag(name: str) -> Column:
        return F.coalesce(F.when(F.col(name), F.lit("True")).otherwise(F.when(~F.col(name), F.lit("False"))), F.lit("None"))

    other = F.coalesce("message", F.lit("")) if "message" in df.columns else F.lit("")
    execution = F.concat(
        F.lit("exec image="), said(F.col("image")), F.lit(" network="), said(F.col("network")), F.lit(" raw="), flag("raw"),
        F.lit("(granted="), flag("granted"), F.lit(") timeout="), said(F.col("timeout")), F.lit("s files="), said(F.col("n_files")),
        F.lit(" cmd="), F.coalesce(_quote(F.col("cmd")), F.lit("None")),
    )
    message = (
        F.when(F.col("kind") == "exec", execution)
        .when(F.col("kind") == "timeout_kill", F.concat(F.lit("timeout after "), said(F.col("timeout")), F.lit("s; killing container "), said(F.col("target"))))
        .when(F.col("kind") == "partial_cleanup", F.concat(F.lit("workdir "), said(F.col("target")), F.lit(" not fully removed; using root-container cleanup")))
        .when(F.col("kind") == "leak", F.concat(F.lit("workdir LEAK: could not remove "), said(F.col("target"))))
        .otherwise(other)
    )
    stamp = F.concat(F.date_format("log_ts", STAMP_FORMAT), F.lit(" "), F.col("level"), F.lit(" "))
    return df.withColumn(line, F.concat(F.coalesce(stamp, F.lit("")), message))


def exec_log_parse(df: DataFrame, line: str = "line") -> DataFrame:
    """Split log lines into typed columns; works on tables and streams.

    Adds log_ts, level, kind (exec, timeout_kill, partial_cleanup, leak, other)
    and the fields of the kind; fields of other kinds are null.
    """
    stamped = df.withColumns(
        {
            "log_ts": F.try_to_timestamp(F.regexp_extract(line, STAMP, 1), F.lit(STAMP_FORMAT)),
            "level": F.nullif(F.regexp_extract(line, STAMP, 2), F.lit("")),
            "_message": F.regexp_extract(line, STAMP, 3),
        }
    )
    message = F.col("_message")
    # Each format is matched once: its groups are set apart by a mark and split.
    formats = {"exec": (EXEC, 7), "timeout_kill": (TIMEOUT_KILL, 2), "partial_cleanup": (PARTIAL_CLEANUP, 1), "leak": (LEAK, 1)}
    starts = {"exec": "exec ", "timeout_kill": "timeout ", "partial_cleanup": "workdir ", "leak": "workdir LEAK"}

    def groups(kind: str) -> Column:
        regex, count = formats[kind]
        marked = F.regexp_replace(
            message, regex, FOUND + FOUND.join(f"${g}" for g in range(1, count + 1))
        )
        return F.when(message.startswith(starts[kind]), F.split(marked, FOUND, count + 1))

    matched = stamped.withColumns({f"_{kind}": groups(kind) for kind in formats})
    kinds = matched.withColumn(
        "kind",
        F.coalesce(
            *[F.when(F.size(f"_{kind}") == count + 1, F.lit(kind)) for kind, (_, count) in formats.items()],
            F.lit("other"),
        ),
    )

    def part(kind: str, group: int) -> Column:
        return F.when(F.col("kind") == kind, F.get(f"_{kind}", F.lit(group)))

    added = {
        "image": part("exec", 1),
        "network": part("exec", 2),
        "raw": part("exec", 3) == "True",
        "granted": part("exec", 4) == "True",
        "timeout": F.coalesce(part("exec", 5), part("timeout_kill", 1)).try_cast("int"),
        "n_files": part("exec", 6).try_cast("int"),
        "cmd": _unquote(part("exec", 7)),
        "target": F.coalesce(part("timeout_kill", 2), part("partial_cleanup", 1), part("leak", 1)),
    }
    return kinds.withColumns(added).drop("_message", *[f"_{kind}" for kind in formats])


def secret_scan(df: DataFrame, col: str, patterns=SECRET_PATTERNS) -> DataFrame:
    """One row per input row and pattern that occurs in `col`: count and matches.

    Each pattern is one pass over the text inside the row; nothing is shuffled.
    """
    hits = F.array(
        *[
            F.struct(
                F.lit(name).alias("pattern"),
                F.regexp_extract_all(F.col(col), F.lit(regex), F.lit(0)).alias("matches"),
            )
            for name, regex in patterns
        ]
    )
    found = F.filter(hits, lambda h: F.size(h["matches"]) > 0)
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.inline(found)).withColumn("hits", F.size("matches"))


def secret_redact(df: DataFrame, col: str, patterns=SECRET_PATTERNS, mask: str = MASK) -> DataFrame:
    """Copy of `df` with every match in `col` replaced."""
    text = F.col(col)
    for _, regex in patterns:
        text = F.regexp_replace(text, regex, mask)
    return df.withColumn(col, text)


#: What a word may consist of where only hashes are known: runs of token characters, and runs of
#: anything but white space, quotes, brackets and separators, also without punctuation at their ends.
WORD_PATTERNS = (
    r"[A-Za-z0-9_-]+",
    r"[^\s'\"`,;<>(){}\[\]]+",
    r"[A-Za-z0-9_](?:[^\s'\"`,;<>(){}\[\]]*[A-Za-z0-9_])?",
)


def known_secret_scan(
    df: DataFrame, row_id: str, col: str, known: DataFrame, words: tuple[str, ...] = WORD_PATTERNS
) -> DataFrame:
    """Rows of `df` whose text holds a known secret: `(id, sha256)`.

    With a column `secret` in `known`, every occurrence of a value counts, whatever its length or
    characters and wherever in a word it stands; empty values are left out. With `sha256` alone the secrets never
    enter the plan: the words of the text, by the patterns in `words`, are hashed and looked up.
    That finds a secret of any length that stands as such a word, and not one that holds white
    space, quotes, brackets or separators or is joined to other characters; widen `words` for those. An optional
    column `length` in `known` spares hashing words of other lengths.
    """
    if "secret" in known.columns:
        rules = known.where(F.col("secret") != "").select(
            F.sha2("secret", 256).alias("rule"), F.col("secret").alias("literal"), F.lit(1).alias("needed")
        )
        return pattern_rules(df, row_id, col, rules).select(row_id, F.col("rule").alias("sha256"))
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.col(col), F.lit(w), F.lit(0)) for w in words])))
    if "length" in known.columns:
        lengths = policy_rows(known.select("length").distinct())
        if lengths is not None:
            listed = [r["length"] for r in lengths]
            found = F.filter(found, lambda w: F.char_length(w).isin(*listed))
    hashed = df.select(row_id, F.explode(found).alias("_word")).select(row_id, F.sha2("_word", 256).alias("sha256"))
    return hashed.join(small_side(known.select("sha256").distinct()), "sha256").select(row_id, "sha256")
