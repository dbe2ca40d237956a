"""The training-corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washkit.llm import minhash, packing, pu_quality, suffix_dedup, winnow
from washkit.llm.common import digest, stored, stored_alone, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated passage that the suffix-array stage removes: below the length of 50 short words.
PASSAGE = 200
#: Jaccard similarity of 5-word shingles, in percent, from which the near-duplicate stage links two documents.
NEAR = 80


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns and ``digest``: decisions come back by id and text, so rows with a null id or a
    repeated one go by their own texts."""
    return _columns(docs).withColumn("digest", digest("text"))


def _by_row(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` of :func:`_keyed` joined with the rows of ``found`` (of_id, key, ...), one for each id and text."""
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("key")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts. Rows with a null id go by their
    own score, and so do rows that share an id."""
    docs = _keyed(docs)
    scores = pu_quality.quality_scores(docs, table(spark, sf_dir, "labels"), key_col="digest")
    good = scores.where("predicted = 1").select(F.col("doc_id").alias("of_id"), "key").distinct()
    return _by_row(docs, good, "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the least id; of rows that repeat
    an id and a text one stays. Rows of one id with different texts are different documents. Rows
    with a null id stay."""
    docs = stored(_keyed(docs).withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    found = minhash.near_duplicates(docs, id_col="row", percent=NEAR).where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "row")
    wordless = F.col("n_shingles") == 0
    first = (
        found.join(docs.select("row", "doc_id", "digest"), "row")
        .groupBy(F.when(~wordless, F.col("component_id")).alias("c"), F.when(wordless, F.col("doc_id")).alias("i"), F.when(wordless, F.col("digest")).alias("d"))
        .agg(F.min(F.struct("doc_id", "digest", "row")).alias("least")).select("least.row")
    )
    return docs.join(first, "row", "left_semi").select(*COLUMNS).unionByName(docs.where("row IS NULL").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; those of which nothing is left go. A cut inside a
    character drops that character's rest; documents without repeated passages are unchanged."""
    docs = _keyed(docs)
    found = suffix_dedup.repeated_spans(docs, min_bytes=PASSAGE, key_col="digest", whole_chars=True).where(F.size("spans") > 0)
    cut = found.select(F.col("doc_id").alias("of_id"), "key", F.col("kept").cast("string").alias("left")).dropDuplicates(["of_id", "key"])
    joined = _by_row(docs, cut, "left")
    out = joined.withColumn("text", F.coalesce("left", "text")).withColumn("n_chars", F.when(F.col("left").isNotNull(), F.length("left").cast("long")).otherwise(F.col("n_chars")))
    return out.where("left IS NULL OR trim(left) <> ''").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window, of items without an id neither."""
    docs = _keyed(docs)
    found = winnow.contamination(docs, table(spark, sf_dir, "benchmark"), key_col="digest", null_items=True)
    bad = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("of_id"), "key").distinct()
    return _by_row(docs, bad, "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(_columns(docs))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", sequences),
]

#: The quality and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``. What a stage writes on its way goes as soon as its
    result is written; the stages' results stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored_alone(partial(stage, spark, docs, sf_dir), spark, name.replace(" ", "-"))
    return docs
