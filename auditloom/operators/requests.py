"""Requests and responses: parse, validate, resolve, decode, label, classify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.codec import is_strict_base64, utf8_text
from auditloom.functions.sizing import policy_rows, small_side

# Fixed values of the request contract.
IMAGES = ("base", "heavy")
DEFAULT_IMAGE = "base"
NETWORKS = ("none", "egress")
TIMEOUT_MIN, TIMEOUT_MAX = 5, 1800
NAME_MAX = 255
# A line break is allowed at the very end, as the contract's pattern does.
NAME_PATTERN = r"^[A-Za-z0-9._-]+\n?\z"
OUTPUT_CAP = 1_048_576
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")


def request_parse(df: DataFrame, json_col: str, images: tuple[str, ...] = IMAGES) -> DataFrame:
    """Type the JSON bodies in `json_col` field by field, with defaults.

    Adds command, network, timeout, raw, image, files, `type_errors` (fields of
    the wrong type) and `is_corrupt` (not JSON at all). Whole numbers may come
    as text or with a zero fraction, flags as the usual yes/no words. An image
    of any type that is not a known name becomes the default. JSON is read strictly: a body
    with a repeated key, or with NaN or Infinity for a number, is corrupt.
    """
    fields = ("command", "network", "timeout", "raw", "image", "files")
    # One step per layer, so that a field is taken out of the body only once.
    parsed = df.withColumn("_v", F.try_parse_json(json_col)).withColumns(
        {
            "is_corrupt": F.col("_v").isNull(),
            "_object": F.col("_v").isNotNull() & F.col(json_col).rlike(r"^[ \t\n\r]*\{"),
            **{f"_{f}": F.try_variant_get("_v", f"$.{f}", "variant") for f in fields},
        }
    )
    kinds = parsed.withColumns({f"_{f}_kind": F.schema_of_variant(f"_{f}") for f in fields[:-1]})

    def kind(name: str) -> Column:
        return F.col(f"_{name}_kind")

    def read(name: str, as_type: str) -> Column:
        return F.try_variant_get(f"_{name}", "$", as_type)

    def text(name: str) -> Column:
        return F.when(kind(name) == "STRING", read(name, "string"))

    number = kind("timeout").isin("BIGINT", "DOUBLE", "BOOLEAN") | kind("timeout").startswith(
        "DECIMAL"
    )
    as_double = read("timeout", "double")
    digits = F.regexp_extract(text("timeout"), r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*\z", 1)
    timeout = F.when(
        number, F.when(as_double == F.floor(as_double), read("timeout", "int"))
    ).when(digits != "", digits.try_cast("int"))
    word = F.lower(read("raw", "string"))
    raw = (
        F.when(F.col("_raw").isNull(), F.lit(False))
        .when(kind("raw") == "BOOLEAN", read("raw", "boolean"))
        .when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
    )
    typed = kinds.withColumns(
        {
            "command": text("command"),
            "network": F.when(F.col("_network").isNull(), F.lit("none")).otherwise(text("network")),
            "timeout": timeout,
            "raw": raw,
            "image": F.when(text("image").isin(*images), text("image")).otherwise(
                F.lit(DEFAULT_IMAGE)
            ),
            "_entries": read("files", "array<variant>"),
        }
    )

    def entry_text(entry: Column, name: str) -> Column:
        part = F.try_variant_get(entry, f"$.{name}", "variant")
        return F.when(
            F.schema_of_variant(part) == "STRING",
            F.try_variant_get(entry, f"$.{name}", "string"),
        )

    files = F.transform(
        "_entries",
        lambda e: F.struct(entry_text(e, "name").alias("name"), entry_text(e, "b64").alias("b64")),
    )
    errors = named_when(
        {
            "body_type": ~F.col("is_corrupt") & ~F.col("_object"),
            "command_type": kind("command") != "STRING",
            "timeout_type": (kind("timeout") != "VOID") & F.col("timeout").isNull(),
            "raw_type": F.col("_raw").isNotNull() & F.col("raw").isNull(),
            "files_type": F.col("_files").isNotNull()
            & ~F.is_variant_null("_files")
            & F.col("_entries").isNull(),
        }
    )
    added = ["is_corrupt", "command", "network", "timeout", "raw", "image"]
    return typed.select(
        *[c for c in df.columns if c not in (*added, "files", "type_errors")],
        *added,
        files.alias("files"),
        errors.alias("type_errors"),
    )


def named_when(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a null rule does not hold."""
    none = F.array().cast("array<string>")
    return F.concat(
        *[F.when(hit, F.array(F.lit(name))).otherwise(none) for name, hit in rules.items()]
    )


def request_validate(df: DataFrame) -> DataFrame:
    """Add `violations`, the names of broken rules, and `valid`."""
    command, network, timeout = F.col("command"), F.col("network"), F.col("timeout")
    rules = {
        "command_empty": F.coalesce(F.length(command), F.lit(0)) < 1,
        "network_unknown": ~F.coalesce(network.isin(*NETWORKS), F.lit(False)),
        "timeout_range": ~timeout.between(TIMEOUT_MIN, TIMEOUT_MAX),
    }
    if "files" in df.columns:

        def unsafe(name: Column) -> Column:
            return ~F.coalesce(
                name.rlike(NAME_PATTERN) & ~name.isin(".", ".."), F.lit(False)
            )

        def badly_sized(name: Column) -> Column:
            return ~F.coalesce(F.length(name).between(1, NAME_MAX), F.lit(False))

        rules["file_name"] = F.exists("files", lambda f: unsafe(f["name"]))
        rules["file_name_length"] = F.exists("files", lambda f: badly_sized(f["name"]))
        rules["file_body"] = F.exists("files", lambda f: f["b64"].isNull())
    found = named_when(rules)
    if "type_errors" in df.columns:
        found = F.concat(F.col("type_errors"), found)
    return df.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)


def profile_resolve(df: DataFrame, profiles: DataFrame, host_cpus: int) -> DataFrame:
    """Attach the image's profile; unknown images get the default one.

    `profiles` has name, memory, cpus STRING, timeout_default, timeout_cap.
    """
    short = policy_rows(profiles.select("name"))
    if short is not None:
        known = F.col("image").isin(*[row["name"] for row in short])
        image = F.when(known, F.col("image")).otherwise(F.lit(DEFAULT_IMAGE))
        marked, side = df.withColumn("image_eff", image), F.broadcast(profiles)
    else:
        names = profiles.select(F.col("name").alias("_known"))
        marked = (
            df.join(small_side(names), F.col("image") == F.col("_known"), "left")
            .withColumn("image_eff", F.coalesce("_known", F.lit(DEFAULT_IMAGE)))
            .drop("_known")
        )
        side = small_side(profiles)
    joined = marked.join(side, F.col("image_eff") == F.col("name"), "left").drop("name")
    asked = F.coalesce(F.col("timeout"), F.col("timeout_default"))
    too_many = F.col("cpus").try_cast("decimal(18,3)") > F.lit(host_cpus)
    return joined.withColumns(
        {
            "timeout_eff": F.greatest(F.lit(TIMEOUT_MIN), F.least(asked, F.col("timeout_cap"))),
            "cpus_eff": F.when(too_many, F.lit(str(host_cpus))).otherwise(F.col("cpus")),
        }
    )


def grant_derive(
    df: DataFrame, egress_network: str = "egress-net", dns: str = "", symbol_cache: str = ""
) -> DataFrame:
    """Add what a request is granted: network, raw sockets, DNS, symbol mount."""
    on_egress = F.coalesce(F.col("network") == "egress", F.lit(False))
    image = F.col("image_eff") if "image_eff" in df.columns else F.col("image")
    return df.withColumns(
        {
            "network_eff": F.when(F.col("network") == "none", F.lit("none")).otherwise(
                F.lit(egress_network)
            ),
            "raw_granted": F.coalesce(F.col("raw"), F.lit(False)) & on_egress,
            "dns": F.when(on_egress & F.lit(dns != ""), F.lit(dns)),
            "symbol_mount": F.when(
                (image == "heavy") & F.lit(symbol_cache != ""), F.lit(symbol_cache)
            ),
        }
    )


def files_decode(df: DataFrame, request_id: str) -> tuple[DataFrame, DataFrame]:
    """Decode `files ARRAY<STRUCT<name, b64>>`.

    Returns the surviving files (one row per request and name, body, size,
    sha256) and the ids of requests with a damaged file. A request is judged as
    a whole and a later file replaces an earlier one of the same name; both are
    settled inside the row, so nothing is shuffled.
    """
    any_bad = F.exists("files", lambda f: ~is_strict_base64(f["b64"]))
    flagged = df.withColumn("_bad", F.coalesce(any_bad, F.lit(False)))
    bad = flagged.where("_bad").select(request_id)
    named = flagged.where(~F.col("_bad")).withColumn(
        "_latest_first", F.reverse(F.transform("files", lambda f: f["name"]))
    )
    numbered = F.transform(
        "files", lambda f, i: F.struct(i.alias("pos"), f["name"].alias("name"), f["b64"].alias("b64"))
    )
    survivors = F.filter(
        numbered,
        lambda f: f["pos"] == F.size("_latest_first") - F.array_position("_latest_first", f["name"]),
    )
    files = (
        named.select(request_id, F.inline(survivors))
        .withColumn("body", F.unbase64("b64"))
        .drop("b64")
        .withColumns({"size": F.octet_length("body"), "sha256": F.sha2("body", 256)})
    )
    return files, bad


def output_cap(df: DataFrame, col: str, cap: int = OUTPUT_CAP) -> DataFrame:
    """Keep the first `cap` bytes of a binary column as text.

    Adds `<col>_text`, bytes that are no UTF-8 replaced, and `<col>_truncated`.
    """
    return df.withColumns(
        {
            f"{col}_text": utf8_text(F.substring(F.col(col), 1, cap)),
            f"{col}_truncated": F.octet_length(col) > cap,
        }
    )


def outcome_label(df: DataFrame, marker: str | Column) -> DataFrame:
    """Add exit_code_eff, ok, and success, which also needs the marker in stdout."""
    wanted = F.lit(marker) if isinstance(marker, str) else marker
    stdout = F.coalesce(F.col("stdout"), F.lit(""))
    return (
        df.withColumn("exit_code_eff", F.coalesce(F.col("exit_code"), F.lit(-1)))
        .withColumn("ok", ~F.col("timed_out") & (F.col("exit_code_eff") == 0))
        .withColumn(
            "success",
            F.col("ok") & (stdout != "") & F.coalesce(F.contains(stdout, wanted), F.lit(False)),
        )
    )


def status_classify(df: DataFrame) -> DataFrame:
    """Add status, error and retry_after by fixed precedence.

    Reads whichever of these columns exist: is_corrupt, ip_allowed,
    ip_retry_after, token_set, auth_ok, valid, rate_allowed, rate_retry_after,
    slot_admitted, slot_retry_after, bad_base64. A missing column, or a null in
    one, means that check did not reject the row.
    """

    present = df.columns

    def is_value(name: str, value: bool) -> Column:
        if name not in present:
            return F.lit(False)
        return F.coalesce(F.col(name) == F.lit(value), F.lit(False))

    def retry(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("int")

    no_retry = F.lit(None).cast("int")
    checks = [
        (is_value("is_corrupt", True), 422, "malformed", no_retry),
        (is_value("ip_allowed", False), 429, "rate_limited", retry("ip_retry_after")),
        (is_value("token_set", False), 503, "token_not_configured", no_retry),
        (is_value("auth_ok", False), 401, "unauthorized", no_retry),
        (is_value("valid", False), 422, "schema", no_retry),
        (is_value("rate_allowed", False), 429, "rate_limited", retry("rate_retry_after")),
        (is_value("slot_admitted", False), 429, "concurrency_limited", retry("slot_retry_after")),
        (is_value("bad_base64", True), 400, "bad_base64", no_retry),
    ]
    verdict = F.coalesce(
        *[
            F.when(
                hit,
                F.struct(
                    F.lit(code).alias("status"),
                    F.lit(error).alias("error"),
                    wait.cast("int").alias("retry_after"),
                ),
            )
            for hit, code, error, wait in checks
        ],
        F.struct(
            F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("error"),
            no_retry.alias("retry_after"),
        ),
    )
    kept = [c for c in present if c not in ("status", "error", "retry_after")]
    return df.select(*kept, verdict.alias("_verdict")).select(*kept, "_verdict.*")
