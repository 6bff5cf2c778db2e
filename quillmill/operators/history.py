"""The log of filed documents and what derives from it: filters, statistics, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.sources import versions


def of_folder(log: DataFrame, folder: str) -> DataFrame:
    """Entries filed in a folder."""
    return log.filter(F.col("target_folder") == folder)


def with_text(log: DataFrame) -> DataFrame:
    return log.filter(F.coalesce(F.col("extracted_text"), F.lit("")) != "")


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The last entries, newest first."""
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def of_relative_path(log: DataFrame, relative_path: str, limit: int = 10) -> DataFrame:
    return newest(log.filter(F.col("target_relative_path") == relative_path), limit)


def children_by_usage(stats: DataFrame, parent: str) -> DataFrame:
    """Folders directly below another one, the most used first."""
    return stats.filter(T.parent(F.col("path")) == parent).orderBy(F.desc("usage_count"), "path")


def counts(log: DataFrame) -> DataFrame:
    """entries, folders, with_text of a log."""
    return log.agg(F.count("*").alias("entries"), F.countDistinct("target_folder").alias("folders"), F.count_if(F.col("extracted_text").isNotNull()).alias("with_text"))


def token_usage(log: DataFrame, tokens: Column, by: str = "target_folder_name") -> DataFrame:
    return log.groupBy(by).agg(F.sum(tokens).alias("tokens"))


def in_task_order(tasks: DataFrame, priority: Column, since: str, key: str) -> DataFrame:
    """Tasks as a worker takes them: the smallest priority number first, then the oldest."""
    return tasks.withColumn("priority", priority).orderBy("priority", since, key)


def with_overlap(log: DataFrame, keywords: list[str]) -> DataFrame:
    """Entries that share a keyword, whatever its case."""
    return log.filter(F.arrays_overlap(F.transform("keywords", lambda k: F.lower(F.trim(k))), F.array(*[F.lit(k.lower()) for k in keywords])))


def relative_path_like(stats: DataFrame, pattern: str, limit: int) -> DataFrame:
    return stats.filter(F.col("relative_path").ilike(f"%{pattern}%")).orderBy(F.desc("usage_count"), "path").limit(limit)


def folder_stats(log: DataFrame) -> DataFrame:
    """One row a folder: how often and when used; its relative path is the first that was logged."""
    first = F.min_by("target_relative_path", F.when(F.col("target_relative_path").isNotNull(), F.struct("created_at", "id")))
    return log.groupBy(F.col("target_folder").alias("path")).agg(F.count("*").alias("usage_count"), F.max("created_at").alias("last_used"), F.min("created_at").alias("created_at"), first.alias("relative_path"))


def named_stats(log: DataFrame) -> DataFrame:
    """path, name (the first that was logged) and usage_count of every folder."""
    return log.groupBy(F.col("target_folder").alias("path")).agg(F.min_by("target_folder_name", "id").alias("name"), F.count("*").alias("usage_count"))


def folder_keywords(log: DataFrame) -> DataFrame:
    """The set of keywords of each folder name, lower-cased and sorted."""
    each = log.select("target_folder_name", F.explode("keywords").alias("k")).select("target_folder_name", F.lower(F.trim("k")).alias("k")).filter("k != ''")
    return each.groupBy("target_folder_name").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keywords"))


def counts_by(log: DataFrame, column: str) -> DataFrame:
    return log.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, *newest: Column) -> DataFrame:
    """Last write wins: one row a key."""
    order = Window.partitionBy(key).orderBy(*newest)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def learned_fields(events: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Per key the last non-empty value of each field, and the number of events."""
    last = [F.max_by(f, F.when(F.coalesce(F.col(f) != "", F.lit(False)), F.struct(*order))).alias(f) for f in fields]
    named = events.withColumn(key, F.trim(key)).filter(F.col(key) != "")
    return named.groupBy(key).agg(*last, F.count("*").alias("usage_count"))


def last_used(log: DataFrame, limit: int = 20) -> DataFrame:
    """Folders by latest use."""
    return log.groupBy("target_folder").agg(F.max(F.struct("created_at", "id")).alias("at")).orderBy(F.desc("at")).limit(limit).select("target_folder", F.col("at.created_at").alias("last_used"))


def newest_first(log: DataFrame) -> DataFrame:
    """Every entry with its number n in the order newest first: ranges of the order are written once, numbered apart, and start after what the ranges before them hold."""
    spark = log.sparkSession
    newest, last = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit((1 << 63) - 1)), -F.col("id")
    path = versions.shared_folder(spark, "ordered")  # a range partitioning that is computed twice may cut elsewhere
    log.repartitionByRange(newest, last).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # one row a range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(newest, last))
    return rows.join(F.broadcast(starts), "_part").withColumn("n", F.col("_start") + at).drop("_part", "_start")
