"""From raw documents to a mixed corpus: language, near duplicates, benchmark passages, secrets, source shares.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of docs (the last one returns the
mix), and works on all rows that the stage before kept. run() writes each stage as Parquet into the shared
folder and reads it again. Null texts and texts without letters leave in the first stage; repeated rows are one
document from the second on; of documents with one id and different texts all stay; columns beside doc_id, text, lang, source
and n_chars, whatever their names, pass through unchanged up to the last stage, which returns the mix (how often
each document is taken) without the texts. Ties, empty and very long texts and empty tables are as in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, langid, mixing, neardup, secrets
from quillmill.llm.common import cut, fresh_path, join_if_small, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is identified."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that with the smallest id; documents without id stay."""
    classes = cut(neardup.near_duplicates(docs.select("doc_id", "text")).filter(F.col("doc_id").isNotNull()), "classes")
    sha, once = unused(docs, "text_sha256", "once")
    marks = classes.groupBy("doc_id", F.col("text_sha256").alias(sha)).agg(F.any_value("is_first").alias(once), F.count("*").alias("n"))
    marks = cut(marks.filter(~F.col(once) | (F.col("n") > 1)).drop("n"), "marks")  # what goes, and what is there more than once
    said = F.upper(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    marked = join_if_small(docs.withColumn(sha, said), marks, ["doc_id", sha], "left", 96 * marks.count())
    alone, repeated = marked.filter(F.col(once).isNull()), marked.filter(F.col(once)).dropDuplicates(["doc_id", sha])
    return alone.unionByName(repeated).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, items.select("item_id", "text"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    return secrets.redact(docs, fresh_path(spark, "secret_ledger"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_passages), ("secret scan", secret_spans), ("source mixing", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: Learned decisions and sampling are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
