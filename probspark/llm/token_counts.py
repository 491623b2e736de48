"""Token counts through a digest cache.

A text's digest (SHA-256 of its normalised content) and the tokenizer's version
digest (SHA-256 of its file) are looked up in a stored table of counts.  Only
distinct misses are encoded, and their counts are appended to the table; a later run
over the same contents encodes nothing.  Copies meet as one row a task before the
shuffle, so a text that fills a third of the corpus is encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import by_bytes
from probspark.llm.token_ids import encoder
from probspark.llm.words import pieces

CACHE_SCHEMA = "digest string, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_bytes, n_tokens, over_limit``.

    Normalising leaves text as it is but for null, which counts as empty (0 tokens).
    Special tokens' strings are handled as the library does by default.  A text of any length is
    encoded whole; a null ``doc_id`` is carried.  Repeated rows
    give a row each; other columns are not read; an empty table gives no rows.
    ``cache_path`` is a Parquet folder, made if missing; the file at
    ``tokenizer_path`` must be on every executor.
    """
    version = tokenizer_version(tokenizer_path)
    texts = by_bytes(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    misses = texts.select("digest", "text").dropDuplicates(["digest"])
    if (cached := _cached(docs, cache_path, version)) is not None:
        misses = texts.select("digest", "text").join(cached.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, keep_space=True)
        for batch in batches:
            for piece in pieces(batch):
                counts = pa.array(tokens.counts(piece.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("digest"), pa.repeat(pa.scalar(version), len(piece)), counts], ["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counted = _cached(docs, cache_path, version)
    rows = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(counted, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(docs: DataFrame, path: str, version: str) -> DataFrame | None:
    """Stored counts of this tokenizer version, one row per digest (two runs may have appended the same one)."""
    try:
        table = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return table.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
