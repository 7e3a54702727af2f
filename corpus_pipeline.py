"""The corpus pipeline: five stages over documents, each written as a table that the next one reads.

A stage sets the session's Arrow batches to BATCH_ROWS rows, if they are larger.

Every stage takes (spark, docs, sf_dir).  Nulls in any column, repeated rows and further columns pass through;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import decontaminate, langid, mixing, neardup, pii
from graphlake.llm.common import Scratch, table

#: Share of a text's n-grams that its language must hold; texts of clean prose hold nine tenths.
LEAST_SCORE = 0.3

#: Rows that go to a Python worker at once: texts can be long, and the executor's memory holds a few batches beside its heap.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language: null or letterless texts, and n-grams that none holds.

    Where no row has a language label nothing can be learned, and only null and letterless texts go.
    """
    _small_batches(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    named = docs.toDF(*(f"_gl_{c}" for c in docs.columns))
    kept = langid.predict(named, model, "_gl_text").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"_gl_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group; of rows with one doc_id and one text one stays.

    A null doc_id is an id that comes after all others.  Where an id repeats with several texts, each is judged for itself.
    """
    _small_batches(spark)
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half or more of a benchmark item.  Other texts of the same id, null or not, stay."""
    _small_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data and the terms that disclose it; n_chars follows the text.  All rows stay."""
    _small_batches(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training corpus in its order: doc_id, source, tokens, epoch, block, slot and the redacted text; every document comes once or more."""
    return mixing.mix(docs, texts=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Hash-based sketches, tiling and redaction have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
