"""One query for each operator, over its whole table, with its production parameters.

``oracle_sql`` covers what SQL can express; the other queries are tested
against brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    chunked_bpe,
    hard_negatives,
    jpeg_media,
    minhash_dedup,
    packing,
    quality_rules,
    source_mixing,
    suffix_dedup,
    token_alignment,
    token_counts,
    token_store,
    url_filter,
)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = minhash_dedup.near_duplicates(docs, shingle=3, percent=85, bands=24)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


#: The rules that the url query is asked for.
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max(bad).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "template", "purity"
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


#: Bytes from which on op5 notes a repeated passage, about fifty words; it removes from 400 on.
PASSAGE = 256


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, noted=PASSAGE)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.col("n_noted").alias("n_repeated"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [f"(-7L, {turn}L, '{role}', '</s>[INST] ok [/INST]')" for turn, role in enumerate(("user", "assistant"))]
    extra = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(conv_id, turn, role, text)")
    examples = chat_format.chat_examples(talks.unionByName(extra))
    loss = F.struct("example", chat_format.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("text"))
    by_talk = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.sort_array(F.collect_list(loss)).alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = chat_format.parse_example(F.col("last"))
    by_talk = by_talk.withColumn("turns", turns).withColumn("loss", F.expr("array_join(transform(loss, x -> x.text), '')"))
    told = F.expr("array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')")
    return by_talk.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return token_store.read_store(spark, path)


def op10_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_payloads(jpeg_media.media(table(spark, sf_dir, "documents")))


def op11_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.json")
    coded = chunked_bpe.decode(chunked_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict:
    ops = (
        op1_minhash_dedup, op2_token_counts, op3_url_filter, op4_source_mixing, op5_suffix_dedup,
        op6_chat_format, op7_packing, op8_quality_rules, op9_token_store, op10_jpeg_media,
        op11_bpe_coding, op12_token_alignment, op13_hard_negatives,
    )
    return {op.__name__: op for op in ops}


_SHOWN = """CASE WHEN role = 'assistant' THEN ' ' || esc || '</s>'
    ELSE '[INST] ' || replace(role_esc, chr(10), '~5') || chr(10) || esc || ' [/INST]' END"""
_ESCAPED = "replace(replace(replace(replace(replace({0}, '~', '~0'), '</s>', '~1'), '<s>', '~2'), '[INST]', '~3'), '[/INST]', '~4')"

OP6_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_ESCAPED.format("text")} AS esc, {_ESCAPED.format("role")} AS role_esc,
    row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n
    FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(length({_SHOWN})) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, max(n) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto + 3) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


OP13_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS code FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.id AS anchor_id, o.id, a.label = o.label AS same, CAST(list_inner_product(a.code, o.code) AS BIGINT) AS score
    FROM v a JOIN v o ON a.id % 100 = 0 AND a.id <> o.id),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT pos.anchor_id, pos.id AS positive_id, CAST(row_number() OVER w AS INT) AS "rank", n.id AS negative_id, pos.score AS positive_score, n.score AS negative_score
FROM pos JOIN p n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 30 * pos.score <= 100 * n.score AND 100 * n.score <= 90 * pos.score
WINDOW w AS (PARTITION BY pos.anchor_id, pos.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict:
    return {"op6_chat_format": OP6_SQL, "op13_hard_negatives": OP13_SQL}
