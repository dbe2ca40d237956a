"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washkit.llm import chat_format, hash_forest, minhash, packing, pu_quality, sharding, site_style, spelling, suffix_dedup, turn_repair, url_reputation, warc, winnow
from washkit.llm.common import table
from washkit.llm.sql import SQL

#: Rules of the URL filter: (verdict, host and path prefix).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal size; equal texts stay together."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1,024 words, no two of one source or of one near-duplicate cluster in a sequence."""
    docs = table(spark, sf_dir, "documents")
    near = minhash.near_duplicates(docs, percent=80)
    return packing.pack(docs, clusters=near.select(F.col("doc_id").alias("id"), F.col("component_id").alias("cluster")))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules, else its host's reputation. A page's outcome is bad
    where the label of the same id says low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), URL_RULES)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return site_style.main_text(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated 400-byte string covers."""
    return suffix_dedup.report(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), min_bytes=400))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every 50th one."""
    vectors = table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return pu_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, those of items without an id included."""
    return winnow.report(winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), null_items=True))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own marks, formatted and read back."""
    own = spark.sql(r"""SELECT * FROM VALUES (-7L, 0L, 'user', '\\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', '\\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_conversations(rows), in_order=True)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, their faults counted and repaired at least cost."""
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.report(turn_repair.repair(rows, there_col="there"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variant_groups(spelling.word_counts(spelling.damaged_runs(table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sharding, op2_best_fit_packing, op3_url_reputation, op4_warc, op5_site_style_text, op6_suffix_dedup, op7_minhash_dedup,
    op8_hash_prefix_forest, op9_pu_quality, op10_winnowing, op11_chat_format, op12_turn_repair, op13_spelling_variants, pipeline)}

__all__ = ["REGISTRY", "SQL"]
