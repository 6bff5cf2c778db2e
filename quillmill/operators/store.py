"""Tables that change: appended logs, caches that are replaced by key, undo plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append(rows: DataFrame, path: str) -> None:
    """Entries join a log; what derives from the log (folder statistics, learned fields) is computed when it is read."""
    rows.write.mode("append").parquet(path)


def replaced(cache: DataFrame, rows: DataFrame, key: str, ties: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """The cache with rows in place of the entries that have their key; of rows with one key the last (by `seq`) counts, of several the first by `ties`, columns that go.

    With `value`, a row without it (or without `seq`) takes none away: the last row that has both gives it, the highest `seq` of the key stays.
    """
    of, order = Window.partitionBy(key), [F.desc("seq"), *ties]
    if value is not None:
        told = F.col(value).isNotNull() & F.col("seq").isNotNull()
        rows = rows.withColumn("told", told).withColumn("highest", F.max("seq").over(of))
        order = [F.desc("told"), *order]
    last = rows.withColumn("n", F.row_number().over(of.orderBy(*order))).filter("n = 1").drop("n", *ties)
    if value is not None:
        last = last.withColumn(value, F.when(F.col("told"), F.col(value))).withColumn("seq", F.col("highest")).drop("told", "highest")
    return cache.join(last.select(key), key, "left_anti").unionByName(last)


def without(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The cache without the entries of some keys."""
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def readable(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of cache(path, mtime, ...) whose file is unchanged, or isn't there at all."""
    now = files.select("path", F.col("mtime").alias("now"))
    return cache.join(now, "path", "left").filter("now IS NULL OR now = mtime").drop("now")


def states(cache: DataFrame, model_answers: Column) -> DataFrame:
    """How many entries are analysed, wait for analysis, and have model answers."""
    return cache.agg(F.count_if("analysed").alias("cached"), F.count_if(~F.col("analysed")).alias("pending"), F.count_if(F.col("analysed") & model_answers).alias("with_model"))


def undo_plan(actions: DataFrame, existing: DataFrame, most: int = 20) -> DataFrame:
    """The last actions(seq, source, target), newest first, as moves back; `missing` where the file is no longer there."""
    last = actions.orderBy(F.desc("seq")).limit(most).select("seq", F.col("target").alias("path"), F.col("source").alias("back_to"))
    return last.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").select("seq", "path", "back_to", F.col("there").isNull().alias("missing"))


def read_generations(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """A log whose parts were written under older schemas, in the schema declared now: absent columns are null, narrower types are widened, unknown columns left out.

    A value that can't be read in the present type is null.
    """
    now = StructType.fromDDL(schema)
    found = None
    for path in paths:
        part = spark.read.parquet(path)
        have = {c.lower(): c for c in part.columns}
        cast = [(F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in now]
        found = part.select(*cast) if found is None else found.unionByName(part.select(*cast))
    return found if found is not None else spark.createDataFrame([], now)
