"""A corpus pipeline: language, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of docs, and only decide on rows and texts; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm.common import materialize, words_column
from heliospark.llm.decontaminate import without_contaminated
from heliospark.llm.jaccard_join import one_of_each
from heliospark.llm.language_id import identify_languages
from heliospark.llm.packing import pack_documents
from heliospark.llm.substring_dedup import remove_repeats

#: Words in a shingle and percent that near copies share; op3's 4 and 85 bind that query alone.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; a null lang becomes the predicted one.

    Null and empty texts and texts without letters are rejected. Repeated rows and null doc_ids stay; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_row"))
    found = identify_languages(rows, keep=["_row"]).where(~F.col("rejected"))
    return found.select(*[F.coalesce("_row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of the least doc_id, null last; of repeated rows, one.

    Rows of one doc_id but different texts are different rows. Null and empty texts are in no group and stay; an empty table stays empty.
    """
    return one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur twice or more out of the texts, all their copies; a text of which nothing is left goes. n_chars follows.

    Null and empty texts and texts shorter than a window stay as they are, rows with null doc_ids too; repeated rows repeat each other. An empty table stays empty.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    cut = remove_repeats(rows, keep=["_row"]).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return cut.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of some benchmark item, be their doc_id shared or null.

    Null and empty texts hold none; repeated rows go or stay together. With an empty table, or benchmark, nothing goes.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, by words, into sequences of the permitted lengths.

    A null or empty text is one empty piece; each repeated row has pieces of its own; an empty table gives no rows.
    """
    return pack_documents(docs.select("doc_id", F.size(words_column(F.col("text"))).alias("n_tokens")))


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("benchmark_decontamination", benchmark_passages), ("best_fit_packing", packing)]

#: Learnt models and packing have no SQL: tests/llm/test_stages.py holds each stage against a slow version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
