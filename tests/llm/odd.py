"""Documents with everything that may be odd, and small generators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "digest string, keep_id long, kept boolean, bucket int, shard int, slot int, epoch int, block int, size long, root long, "
    "node long, spans string, text_hash long, row_no long, score double, lang_pred string, component_id long, digest_rank int"
)

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which you".split()


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, blank, tiny and long texts, copies with other spaces, near copies, repeated rows and ids."""
    rng = random.Random(seed)
    long_text = prose(rng, 30_000)
    passage = prose(rng, 60)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [
        None, "", " ", "\n\t \x0b\x0c\r", "a", "One two.", "one  two.", "Ünïcode ß İ 漢字   x\x1cy", "1234 5678 !!", long_text,
        long_text, passage, f"{prose(rng, 40)} {passage} {prose(rng, 30)}", f"{passage} {passage}", base, " ".join(near),
        base.upper(), base.replace(" ", "\n"), "tab\tline\nline\r\nline  double   spaces \n  lead", "<|endoftext|> # $ % <b>",
        "\n".join(["same line here"] * 30), "é combining", "\U0001f600 emoji \U0001f600",
    ]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    rows = [
        (i * 7 % 97, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "é", None]), None if i % 5 else 7)
        for i, text in enumerate(texts)
    ]
    rows += [rows[9], rows[9], rows[12], (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (None, base, None, None, None)]
    rows += [(rows[14][0], "the same id with another text", "en", "b", 2), (-5, "a negative id", "en", "b", None), (2**40, base, "en", "b", 1)]
    return rows


def frame(spark, rows, clash: bool = False):
    """Documents of several partitions, optionally with columns whose names operators use inside."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            docs = docs.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    return docs


def words_of(text):
    return text.encode().split() if text else []
