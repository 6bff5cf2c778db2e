"""Subfolders proposed below a folder that is chosen already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import filing


def for_parents(parents: DataFrame, stats: DataFrame, folders: DataFrame, most: int = 3) -> DataFrame:
    """parent, folder, confidence, reason, place of at most `most` subfolders for each of parents(parent).

    First the learned ones of stats(path, usage_count), by usage, that still exist (at the same path or by name); of folders(path)
    so many existing ones as are lacking, in the order of their paths, but those named already. Only the first 2 * `most` learned
    ones are looked at, and an existing one that is named already isn't replaced by the next.
    """
    wanted = parents.select("parent").distinct()
    by_use = Window.partitionBy("parent").orderBy(F.desc("usage_count"), "path")
    known = stats.withColumn("parent", T.parent(F.col("path"))).join(wanted, "parent", "left_semi")
    known = known.withColumn("n", F.row_number().over(by_use)).filter(F.col("n") <= 2 * most).select("parent", "path", "usage_count", "n")
    there = filing.resolve_folders(known.select(F.col("path").alias("id"), F.col("path").alias("folder")).distinct(), folders)
    learned = known.join(there.select(F.col("id").alias("path"), F.col("path").alias("folder")), "path")
    learned = learned.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy("n"))).filter(F.col("place") <= most)
    reason = F.concat(F.lit("Gelernt ("), F.col("usage_count").cast("string"), F.lit("x verwendet)"))
    learned = learned.select("parent", "folder", F.least(F.col("usage_count") / 50, F.lit(0.8)).alias("confidence"), reason.alias("reason"), "place")

    has = learned.groupBy("parent").agg(F.count("*").cast("int").alias("has"))
    path = F.col("path")
    children = folders.select(T.parent(path).alias("parent"), path.alias("folder")).filter(~T.basename(path).startswith(".")).join(wanted, "parent", "left_semi")
    children = children.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy("folder"))).filter(F.col("nth") <= most)
    lacking = children.join(has, "parent", "left").filter(F.col("nth") <= most - F.coalesce("has", F.lit(0)))
    new = lacking.join(learned.select("parent", "folder"), ["parent", "folder"], "left_anti")
    nth = F.coalesce("has", F.lit(0)) + F.row_number().over(Window.partitionBy("parent").orderBy("nth"))
    existing = new.select("parent", "folder", F.lit(0.2).alias("confidence"), F.lit("Existierender Unterordner").alias("reason"), nth.alias("place"))
    return learned.unionByName(existing)
