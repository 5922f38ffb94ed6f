"""The registered queries opN_<name>, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat, exact_dedup, langid, line_dedup, packing, pii, piece_codec, quality, shards, simhash, spelling, topk, whitening
from ledgerline.llm.common import documents, pii_key

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(given.unionByName(more))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(documents(spark, sf_dir), PIECE_TOKENIZER)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), PIECE_TOKENIZER)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace_entities(documents(spark, sf_dir), key=pii_key(spark))
    return done.select("doc_id", "text", "lang", "source", F.size("pii").cast("long").alias("n_entities"), F.array_join("pii", ",").alias("kinds"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = shards.layout(16)
    placed = shards.shard_slots(documents(spark, sf_dir), tree, shards.grow(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, sha256(norm) AS text_sha256, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP5_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM s),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('<turn >' || chr(10) || chr(10) || '</turn>' || chr(10)) + length(regexp_replace(role || text, '([\\<>])', '..', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP6_SQL = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM g q JOIN g c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: CRC32 of a hex column h, four bits at a time, the low ones of a byte first.
_CRC = """xor(list_reduce(list_transform(string_split(regexp_replace(h, '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT), lambda a, b: xor(
  [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, b) & 15) + 1]::BIGINT,
  a >> 4), 4294967295::BIGINT), 4294967295)"""

OP11_SQL = (
    """
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h, count(*) AS n FROM d GROUP BY doc_id, run),
r AS (SELECT run, n, """
    + _CRC
    + """ AS crc FROM c),
m AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM r),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
v AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.further = f.word)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON f.word = t.word AND t.further IS NULL
"""
)

#: The clock of a child of the tree for a row: its number's name is its path.
_CLOCK = "-ln((('0x' || substr(md5(d.key || '/' || c.name), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / c.weight"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT 16 AS shards, i AS shard, i // 8 AS region, i // 4 % 2 AS rack FROM range(16) x(i) UNION ALL SELECT 17, i, CASE WHEN i = 16 THEN 2 ELSE i // 8 END, CASE WHEN i = 16 THEN 0 ELSE i // 4 % 2 END FROM range(17) x(i)),
l1 AS (SELECT shards, region, region || '' AS name, count(*)::DOUBLE AS weight FROM s GROUP BY ALL),
l2 AS (SELECT shards, region, rack, region || '/' || rack AS name, count(*)::DOUBLE AS weight FROM s GROUP BY ALL),
l3 AS (SELECT shards, region, rack, shard, region || '/' || rack || '/' || shard AS name, 1.0::DOUBLE AS weight FROM s),
p1 AS (SELECT d.row, c.shards, d.key, first(c.region ORDER BY {_CLOCK}, c.region) AS region FROM d CROSS JOIN l1 c GROUP BY ALL),
p2 AS (SELECT d.row, d.shards, d.key, d.region, first(c.rack ORDER BY {_CLOCK}, c.rack) AS rack FROM p1 d JOIN l2 c USING (shards, region) GROUP BY ALL),
p3 AS (SELECT d.row, d.shards, first(c.shard ORDER BY {_CLOCK}, c.shard) AS shard FROM p2 d JOIN l3 c USING (shards, region, rack) GROUP BY ALL),
r AS (SELECT d.doc_id, d.size::BIGINT AS size, {_CRC} AS text_crc32, a.shard::INT AS shard, b.shard::INT AS grown_shard FROM d JOIN p3 a ON a.row = d.row AND a.shards = 16 JOIN p3 b ON b.row = d.row AND b.shards = 17)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, grown_shard FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_best_fit_packing, op3_quality_classifier, op4_chat_prefix_tree, op5_line_dedup, op6_exact_top_k, op7_piece_codec, op8_language_id, op9_pii_surrogates, op10_simhash_near_dedup,
        op11_spelling_variants, op12_embedding_whitening, op13_hash_tree_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_chat_prefix_tree": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op13_hash_tree_sharding": OP13_SQL}
