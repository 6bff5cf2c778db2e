"""Incremental analysis: what is new or changed, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.functions import text as T


def analysed(docs: DataFrame) -> DataFrame:
    """doc_id, categories, newest date and company of docs(doc_id, text); works on batches and streams alike."""
    text = F.col("text")
    return docs.select("doc_id", F.array_join(T.categories(text), ",").alias("keywords"), F.get(T.dates(text), F.lit(0)).alias("newest"), T.company(text).alias("company"))


def valid_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache entries (path, mtime, ...) whose file is unchanged."""
    return cache.join(files.select("path", "mtime"), ["path", "mtime"], "left_semi")


def to_analyse(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without an entry of the same mtime."""
    return files.join(cache.select("path", "mtime"), ["path", "mtime"], "left_anti")


def moved(cache: DataFrame, renames: DataFrame) -> DataFrame:
    """Entries under their new path after renames(path, new_path) or renames(path, new_path, new_mtime), with the mtime of the moved file.

    An entry that was under the new path before gives way, as its file does, unless it moves itself.
    """
    joined = cache.join(renames, "path", "left")
    if "new_mtime" in renames.columns:
        joined = joined.withColumn("mtime", F.coalesce("new_mtime", "mtime")).drop("new_mtime")
    arrived = joined.filter("new_path IS NOT NULL").withColumn("path", F.col("new_path")).drop("new_path")
    stayed = joined.filter("new_path IS NULL").drop("new_path").join(renames.select(F.col("new_path").alias("path")).distinct(), "path", "left_anti")
    return stayed.unionByName(arrived)


def index_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Analyse all that has arrived and append it; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, no: int) -> None:
        analysed(batch).write.mode("overwrite").parquet(f"{out}/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
