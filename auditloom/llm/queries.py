"""Registered queries of the corpus operators: name to (query, SQL answer or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.llm.common import table
from auditloom.llm.exact_dedup import exact_dedup_labels
from auditloom.llm.hard_negatives import mine_hard_negatives
from auditloom.llm.hnsw import nearest_neighbours
from auditloom.llm.language_id import fit_language_model, held_out, identify_languages
from auditloom.llm.merkle import merkle_manifest
from auditloom.llm.minhash import near_duplicate_labels
from auditloom.llm.mixing import FILLS, mix_totals
from auditloom.llm.packing import pack_by_length
from auditloom.llm.quality import quality_labels
from auditloom.llm.sharding import interleave_shards
from auditloom.llm.substring import removal_labels
from auditloom.llm.token_stream import read_token_stream, write_token_stream
from auditloom.llm.warc import read_archives, resolve_revisits, write_archives
from auditloom.session import run_folder

WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER = "byte_bpe_50k.json"


def op1_exact_dedup(spark, sf_dir):
    labels = exact_dedup_labels(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return labels.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_DEDUP = r"""WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""


def op2_length_buckets(spark, sf_dir):
    return pack_by_length(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _length_buckets_sql(buckets=8, max_length=2048, token_budget=32_768, seed="pack"):
    """The dynamic program round by round: d<k> has, for every length, the least padding with k buckets."""
    rounds = [
        """, d1 AS (SELECT j, len * n - s AS cost, 0 AS prev FROM h)"""
    ] + [
        f""", d{k} AS (SELECT b.j, min(a.cost + b.len * (b.n - p.n) - (b.s - p.s)) AS cost,
  arg_min(p.j, (a.cost + b.len * (b.n - p.n) - (b.s - p.s)) * 100000 + p.j) AS prev
 FROM h b JOIN h p ON p.j < b.j JOIN d{k - 1} a ON a.j = p.j GROUP BY b.j)"""
        for k in range(2, buckets + 1)
    ]
    walk = [f", b{buckets} AS (SELECT least({buckets}, max(j)) AS k, max(j) AS j FROM h)"]
    for k in range(buckets, 1, -1):
        walk.append(
            f""", b{k - 1} AS (SELECT b.k, CASE WHEN b.k < {k} THEN b.j ELSE d.prev END AS j
 FROM b{k} b LEFT JOIN d{k} d ON d.j = b.j)"""
        )
    ends = " UNION ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return rf"""WITH docs AS (SELECT doc_id,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents),
items AS (SELECT doc_id, p.piece, p.piece * {max_length} AS start, least(n_tokens - p.piece * {max_length}, {max_length}) AS length
 FROM docs, (SELECT unnest(range(0, (SELECT (max(n_tokens) - 1) // {max_length} + 1 FROM docs))) AS piece) p
 WHERE p.piece <= (n_tokens - 1) // {max_length}),
c AS (SELECT length AS len, count(*) AS n FROM items GROUP BY 1),
h AS (SELECT row_number() OVER w AS j, len, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(n * len) OVER w AS BIGINT) AS s
 FROM c WINDOW w AS (ORDER BY len)){''.join(rounds)}{''.join(walk)},
bounds AS (SELECT len AS bucket, lag(len, 1, 0) OVER (ORDER BY len) AS above FROM h WHERE j IN ({ends})),
r AS (SELECT i.*, b.bucket, row_number() OVER (PARTITION BY b.bucket
  ORDER BY md5(concat('{seed}', ':', doc_id, ':', piece)), doc_id, piece) - 1 AS place
 FROM items i JOIN bounds b ON i.length > b.above AND i.length <= b.bucket)
SELECT doc_id, piece, start, CAST(length AS BIGINT) AS length, bucket, place // ({token_budget} // bucket) AS batch,
 place % ({token_budget} // bucket) AS slot, bucket - length AS padding FROM r"""


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs, learn=~held_out())
    judged = identify_languages(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_warc_segments(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write_archives(pages, run_folder(spark, "warc"))
    return resolve_revisits(read_archives(spark, files))


WARC_SEGMENTS = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again,
 min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN again THEN first END AS refers_to, 'ok' AS status FROM f"""


def op5_quality_rules(spark, sf_dir):
    return quality_labels(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUALITY_RULES = rf"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM spots),
covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM covered GROUP BY 1),
split AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, source, line, regexp_extract_all(line, '{WORD}') AS ws FROM split),
worded AS (SELECT *, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
  'abcdefghijklmnopqrstuvwxyz000000000') AS k FROM lines WHERE len(ws) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY 1),
frequent AS (SELECT source, k FROM worded GROUP BY ALL HAVING count(DISTINCT doc_id) > 50),
lost AS (SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded w JOIN frequent f
  ON w.k = f.k AND w.source IS NOT DISTINCT FROM f.source GROUP BY 1),
base AS (SELECT doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n, 0) AS n_line_words_removed
 FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_words - n_line_words_removed) * 100 < n_words * 30 AS kept FROM failed"""


def op6_repeated_passages(spark, sf_dir):
    return removal_labels(table(spark, sf_dir, "documents").select("doc_id", "text"))


REPEATED_PASSAGES = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
wins AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS n FROM spots),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM wins WHERE n > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
 FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def op7_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_labels(docs, shingle_words=3, percent=85).drop("text_hash")


def op8_token_stream(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = run_folder(spark, "token-stream")
    write_token_stream(docs, folder, public_tokenizers.path(TOKENIZER))
    return read_token_stream(spark, folder)


def op9_interleave_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave_shards(rows, carry=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 of the texts, byte by byte over a table made by its rule.
CRC_SQL = r"""steps AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n)
 UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8),
hexed AS (SELECT doc_id, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ',')[:-2] AS h FROM documents),
bytes AS (SELECT doc_id, list_transform(h, lambda x: CAST(concat('0x', x) AS BIGINT)) AS b FROM hexed),
crcs AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
 FROM bytes, crc_table)"""
INTERLEAVE_SHARDS = f"""WITH RECURSIVE {CRC_SQL},
ranked AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5(concat('shard:', doc_id)) AS k,
  row_number() OVER (PARTITION BY source ORDER BY md5(concat('shard:', doc_id)), doc_id) - 1 AS r,
  count(*) OVER (PARTITION BY source) AS n FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2 * n), source NULLS LAST, k, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard,
 CAST(place - (place * 8 // total * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crcs USING (doc_id)"""


def op10_mix_sources(spark, sf_dir):
    return mix_totals(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


MIX_BASE = r"""WITH docs AS (SELECT doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(concat('mix', ':', coalesce(source, ''), ':', doc_id)) AS k FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY 1),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3) + 1] AS weight,
  source_size * 2 AS room FROM sums),
left_over AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM sums) AS budget,
  coalesce(sum(room) OVER f, 0) AS filled,
  (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER f, 0) AS weight_left FROM weighed
 WINDOW f AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(room::DOUBLE,
  (SELECT max((budget - filled::DOUBLE) / weight_left::DOUBLE) FROM left_over) * weight) AS target FROM left_over),
placed AS (SELECT doc_id, source, size, k, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs),
epochs AS (SELECT p.*, source_size, target, epoch, epoch * source_size + before + size <= target AS fits
 FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS epoch)),
gaps0 AS (SELECT source, max(target) - coalesce(sum(CASE WHEN fits THEN size END), 0) AS gap FROM epochs GROUP BY source),
rest0 AS (SELECT doc_id, source, size, k FROM epochs WHERE NOT fits AND epoch = floor(target / nullif(source_size, 0)) AND size > 0)"""
MIX_FILL = """, spare{n} AS (SELECT r.*, gap, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= gap AS filling
 FROM rest{m} r JOIN gaps{m} g ON r.source IS NOT DISTINCT FROM g.source WHERE size <= gap),
gaps{n} AS (SELECT source, max(gap) - coalesce(sum(CASE WHEN filling THEN size END), 0) AS gap FROM spare{n} GROUP BY source),
rest{n} AS (SELECT doc_id, source, size, k FROM spare{n} WHERE NOT filling)"""
MIX_SOURCES = (
    MIX_BASE
    + "".join(MIX_FILL.format(n=n, m=n - 1) for n in range(1, FILLS + 1))
    + """, taken AS (SELECT doc_id FROM epochs WHERE fits"""
    + "".join(f" UNION ALL SELECT doc_id FROM spare{n} WHERE filling" for n in range(1, FILLS + 1))
    + """),
times AS (SELECT doc_id, count(*) AS n FROM taken GROUP BY doc_id)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN times USING (doc_id)"""
)


def op11_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


#: The exact answer; the graphs find all of it on tables of the size that the driver compares.
NEAREST_NEIGHBOURS = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
 FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
 FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_breaks = F.replace("text", F.lit("\n"), F.lit(""))
    return merkle_manifest(docs, F.when(tampered, without_breaks).otherwise(F.col("text")))


def _field_sql(value):
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', {value}), '-')"


def _leaf_sql(text):
    return "sha256(concat(" + ", ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _tree_sql(name, leaves):
    """Nodes of all levels of the trees whose leaves have grp, pos, n, d."""
    return f"""{name} AS (SELECT 0 AS level, grp, pos, n, d FROM {leaves} UNION ALL
 SELECT level + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, grp, pos // 3, n)"""


def _steps_sql(name, tree, leaves):
    """Siblings before and after each leaf's node at every level."""
    return f"""{name} AS (SELECT l.key, t.level, coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (WHERE t.pos < l.pos // p.step), '') AS lft,
  coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (WHERE t.pos > l.pos // p.step), '') AS rgt
 FROM {leaves} l JOIN powers p ON true JOIN {tree} t ON t.level = p.level AND t.grp = l.grp AND t.n > 1 AND t.pos // 3 = l.pos // (p.step * 3)
 GROUP BY l.key, t.level)"""


MERKLE_MANIFEST = f"""WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n)
 UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8),
crcs AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 AS tampered
 FROM (SELECT DISTINCT doc_id FROM documents) d, crc_table),
powers AS (SELECT n AS level, CAST(power(3, n) AS BIGINT) AS step FROM range(25) r(n)),
made AS (SELECT doc_id, source, {_leaf_sql("text")} AS d,
  CASE WHEN tampered THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS found
 FROM documents JOIN crcs USING (doc_id)),
leaves AS (SELECT *, row_number() OVER () AS key, coalesce(concat('=' || source), '') AS grp,
  row_number() OVER (PARTITION BY source ORDER BY doc_id, d) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM made),
{_tree_sql("trees", "leaves")},
subs AS (SELECT grp AS key, d, '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1),
{_tree_sql("crown", "subs")}, {_steps_sql("low_path", "trees", "leaves")}, {_steps_sql("high_path", "crown", "subs")},
path AS (SELECT l.key, row_number() OVER (PARTITION BY l.key ORDER BY part, level) AS spot, lft, rgt FROM (
  SELECT key, 0 AS part, level, lft, rgt FROM low_path UNION ALL
  SELECT l.key, 1, h.level, lft, rgt FROM leaves l JOIN high_path h ON h.key = l.grp) l),
fold AS (SELECT key, 0 AS spot, found AS d FROM leaves UNION ALL
 SELECT f.key, f.spot + 1, sha256(concat(lft, d, rgt)) FROM fold f JOIN path p ON p.key = f.key AND p.spot = f.spot + 1),
proofs AS (SELECT key, string_agg(concat(lft, rgt), '' ORDER BY spot) AS proof FROM path GROUP BY key)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, c.d AS root, sha256(coalesce(proof, '')) AS proof_sha256,
 f.d AS folded_root, f.d = c.d AS verified
FROM leaves l JOIN subs s ON s.key = l.grp JOIN crown c ON c.n = 1
 LEFT JOIN proofs p ON p.key = l.key JOIN (SELECT key, arg_max(d, spot) AS d FROM fold GROUP BY key) f ON f.key = l.key"""


QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, EXACT_DEDUP),
    "op2_length_buckets": (op2_length_buckets, _length_buckets_sql()),
    "op3_language_id": (op3_language_id, None),
    "op4_warc_segments": (op4_warc_segments, WARC_SEGMENTS),
    "op5_quality_rules": (op5_quality_rules, QUALITY_RULES),
    "op6_repeated_passages": (op6_repeated_passages, REPEATED_PASSAGES),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_token_stream": (op8_token_stream, None),
    "op9_interleave_shards": (op9_interleave_shards, INTERLEAVE_SHARDS),
    "op10_mix_sources": (op10_mix_sources, MIX_SOURCES),
    "op11_nearest_neighbours": (op11_nearest_neighbours, NEAREST_NEIGHBOURS),
    "op12_hard_negatives": (op12_hard_negatives, HARD_NEGATIVES),
    "op13_merkle_manifest": (op13_merkle_manifest, MERKLE_MANIFEST),
}
