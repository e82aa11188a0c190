"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, merkle, mixing, quality, sharding, simhash, suffix, tokens, trie, urls, vectors, warc
from .ship import with_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document; learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return vectors.vector_classes(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shard counts at most one apart."""
    docs = _table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    thin = docs.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"))
    return sharding.shard_rows(thin, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page."""
    records = warc.archived(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    classes = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return classes.select("doc_id", hexed, "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes take from each document."""
    return suffix.without_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url, by rule or by template."""
    judged = urls.url_verdicts(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """What the token files of all documents hold of each document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.tokenized(_table(spark, sf_dir, "documents"), tokenizer)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.contaminated_pairs(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, per source."""
    return audit.filter_audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the copy that was
    received still leads to the root."""
    docs = _table(spark, sf_dir, "documents")
    return merkle.merkle_manifest(docs, merkle.without_line_breaks(docs)).drop("path")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document and the row that stays."""
    return trie.exact_groups(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        f.__name__: with_package(f)
        for f in (
            op1_quality_classifier,
            op2_source_mixing,
            op3_embedding_near_dedup,
            op4_sharding,
            op5_warc_archive,
            op6_simhash_near_dedup,
            op7_suffix_dedup,
            op8_url_filter,
            op9_token_files,
            op10_benchmark_decontamination,
            op11_filter_audit,
            op12_merkle_manifest,
            op13_exact_dedup,
            pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
