"""Two streams in a row: analysis of files, then a model's answers for what was analysed; one row a file and state at the end.

Each stage writes its batches to folders of their own, `<stage>/batch=<number>`, with overwrite: a batch that runs again after a crash takes the place of what
it left. The second stage reads the folders of the first as a stream. Results are merged when they are read: of rows
with one (path, mtime) the last batch counts, so a batch seen twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.functions import text as T
from quillmill.operators import gated, models

ANALYSED = "path string, mtime long, text string, priority int, keywords array<string>, day string, company string, error string"
ANSWERED = "path string, mtime long, name string, confidence double"


def analyse(files: DataFrame) -> DataFrame:
    """The columns of ANALYSED of files(path, mtime, text, priority), the most urgent first; files without text get an error and stay."""
    text = F.col("text")
    day = F.date_format(F.get(T.dates(text), F.lit(0)), "yyyy-MM-dd")
    rows = files.select("path", F.col("mtime").cast("long").alias("mtime"), "text", F.col("priority").cast("int").alias("priority"), F.coalesce(T.categories(text), F.array().cast("array<string>")).alias("keywords"), day.alias("day"), T.company(text).alias("company"))
    return rows.withColumn("error", F.when(text.isNull(), "kein Text")).orderBy("priority", "mtime", "path")


def start_analysis(stream: DataFrame, root: str, there: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """First stage over stream(path, mtime, text, priority). `there` gives of a batch the files that still exist (all if None)."""

    def write(batch: DataFrame, no: int) -> None:
        analyse(batch if there is None else there(batch)).write.mode("overwrite").parquet(f"{root}/analysed/batch={no}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_analysis").trigger(availableNow=True).start()


def start_answers(spark: SparkSession, root: str, provider: models.Provider, there: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Second stage: name and confidence from the model for what the first stage has analysed, once for each distinct prompt of a batch; without an answer no row."""

    def write(batch: DataFrame, no: int) -> None:
        rows = (batch if there is None else there(batch)).filter("error IS NULL")
        file_day = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")
        prompt = models.filename_prompt(F.col("text"), T.basename(F.col("path")), F.col("keywords"), F.col("day"), None, file_day)
        rows = rows.orderBy("priority", "mtime", "path").select("path", "mtime", prompt.alias("prompt"))
        found = rows.join(gated.asked_once(rows, provider), "prompt").filter("answer IS NOT NULL")
        answer = F.col("answer")
        out = found.select("path", "mtime", T.answer_field(answer, "DATEINAME:", True).alias("name"), T.answer_confidence(answer).alias("confidence"))
        out.filter("name IS NOT NULL").write.mode("overwrite").parquet(f"{root}/answered/batch={no}")

    stream = spark.readStream.schema(ANALYSED).parquet(f"{root}/analysed")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_answers").trigger(availableNow=True).start()


def _merged(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, batch long").parquet(folder)
    newest = F.row_number().over(Window.partitionBy("path", "mtime").orderBy(F.desc("batch"), *[F.col(c) for c in rows.columns if c not in ("path", "mtime", "batch")]))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n", "batch")


def results(spark: SparkSession, root: str) -> DataFrame:
    """One row for each (path, mtime) analysed, with the model's name and confidence where there is an answer."""
    found = _merged(spark, f"{root}/analysed", ANALYSED)
    return found.join(_merged(spark, f"{root}/answered", ANSWERED), ["path", "mtime"], "left")
