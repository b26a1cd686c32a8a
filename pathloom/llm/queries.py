"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pathloom.llm import alignment, decontaminate, langid, merkle, minhash, mixing, neighbours, packing, sharding, suffix, tokenfile, toxicity, warc
from pathloom.llm.registry import ORACLES, QUERIES, query
from pathloom.llm.scratch import Scratch

__all__ = ["ORACLES", "QUERIES"]

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(key: str, divisor: int) -> Column:
    """CRC-32 of a key as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = remainder("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    found = langid.predict(docs, model, ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    pieces = packing.cut_pieces(table(spark, sf, "documents"), WORD_TOKENIZER, scratch)
    placed = packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN size >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""


@query("op1_warc", WARC_SQL)
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "archive")
    warc.write_warc(table(spark, sf, "pages"), scratch.root)
    found = warc.read_warc(spark, scratch.root).where(F.col("record_type").isin("response", "revisit"))
    revisit = F.col("record_type") == "revisit"
    return found.select(
        warc.page_id_of("record_id").alias("page_id"),
        F.when(revisit, F.col("headers")["x-payload-length"].cast("long")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        warc.page_id_of("refers_to").alias("refers_to"),
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS span, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM iw),
dw AS (
  SELECT doc_id, span, p, array_to_string(list_slice(w, p, p + span - 1), ' ') AS win
  FROM (SELECT doc_id, span, w, unnest(range(1, len(w) - span + 2)) AS p FROM d, spans WHERE len(w) >= span)),
hit AS (SELECT doc_id, item_id, dw.span, p FROM dw JOIN iw ON dw.win = iw.win AND dw.span = iw.span),
cov AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + span)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op4_decontaminate", DECONTAMINATION_SQL)
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf, "labels"), "toxic", learn=~held)
    found = toxicity.score(docs, model, ["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix.repeated_spans(table(spark, sf, "documents"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    tokenfile.write_ids(table(spark, sf, "documents"), scratch.root, WORD_TOKENIZER)
    found = tokenfile.read_ids(spark, scratch.root)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]

SHARDING_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(92) || 'N')), 1, 8)) AS BIGINT) % {sharding.SIZE} AS slot
  FROM documents),
t AS (SELECT unnest(range(0, {sharding.SIZE})) AS slot, CAST(unnest(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',')) AS INT) AS shard)
SELECT doc_id, d.slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 3, '0') AS shard_name FROM d JOIN t ON d.slot = t.slot
"""


@query("op10_sharding", SHARDING_SQL)
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op12_source_mix")
def op12_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.mix(table(spark, sf, "documents"), share=1.5, limit=2.0, weights=(3, 1, 2))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def _crc_table() -> list[int]:
    """Table of CRC-32, for SQL without such a function."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars + 1)")} AS other,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: xor(a >> 8, {_crc_table()}[(xor(a, x) & 255) + 1])), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS changed,
    row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
tree(lang, lvl, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subs AS (SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tree WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, i, subroot, count(*) OVER () FROM subs
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
low(rid, lang, lvl, height, i, cur, sib) AS (
  SELECT rid, l.lang, 0, height, l.i, changed, '' FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT rid, p.lang, p.lvl + 1, height, p.i // 2,
    sha256(CASE WHEN p.i % 2 = 0 THEN cur || coalesce(t.h, '') ELSE t.h || cur END), sib || coalesce(t.h, '')
  FROM low p LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lvl = p.lvl AND t.i = xor(p.i, 1) WHERE p.lvl < height),
high(rid, lvl, i, cur, sib) AS (
  SELECT rid, 0, s.i, cur, sib FROM low p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang WHERE p.lvl = p.height
  UNION ALL
  SELECT rid, p.lvl + 1, p.i // 2, sha256(CASE WHEN p.i % 2 = 0 THEN cur || coalesce(t.h, '') ELSE t.h || cur END), sib || coalesce(t.h, '')
  FROM high p LEFT JOIN top t ON t.lvl = p.lvl AND t.i = xor(p.i, 1) WHERE p.lvl < (SELECT max(lvl) FROM top)),
r AS (SELECT h AS root, lvl FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r JOIN high p ON p.rid = l.rid AND p.lvl = r.lvl
"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = (remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    other = merkle.leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names))
    found = merkle.manifest(table(spark, sf, "documents"), names, "doc_id", "lang", F.when(changed, other))
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.align(table(spark, sf, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
