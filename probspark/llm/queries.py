"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probspark.llm.common import fresh_path, held_out, stored
from probspark.llm.mixing import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of the whole text, counted in the JVM (null: 0)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.quality import quality_scores

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.toxicity import toxicity_scores

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.jaccard_join import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.mixing import mix_sources

    return mix_sources(with_word_counts(_table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.sharding import shuffle_into_shards

    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shuffle_into_shards(stored(docs, "shard-rows"), 24, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.alignment import align_tokenizers

    rows, _ = align_tokenizers(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return rows


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.token_files import read_token_files, write_token_files

    folder = fresh_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probspark.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_token_files": op12_token_files,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op7_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY norm)""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(norm, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (
            SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source) USING (lang, source)),
        p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
            FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
        q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
            FROM n GROUP BY lang, term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, f::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, encode(item)) AS rank FROM rows)
        WHERE part = 'pair' OR rank <= 50""",
}
