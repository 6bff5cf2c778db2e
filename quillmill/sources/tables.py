"""Readers, and views that give the document operators realistic inputs from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, modified, length and content of the PDF files of a folder, whatever the case of their suffix."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", recursive).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, text: one German business letter an order, with five kinds of content and four kinds of date."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Rechnung", "Vertrag", "Police", "Kontoauszug", "Gehaltsabrechnung", "Mitteilung")]), (k % 6 + 1).cast("int"))
    months = F.array(*[F.lit(x) for x in ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")])
    day = F.col("o_orderdate")
    when = (
        F.when(k % 4 == 0, F.date_format(day, "dd.MM.yyyy")).when(k % 4 == 1, F.date_format(day, "d/M/yy")).when(k % 4 == 2, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(day, "d"), F.lit(". "), F.element_at(months, F.month(day)), F.lit(" "), F.date_format(day, "yyyy")))
    )
    sender = F.element_at(F.array(*[F.lit(x) for x in ("Muster Bau GmbH", "Firma: Nordlicht", "Stadtwerke")]), (k % 3 + 1).cast("int"))
    text = F.concat(kind, F.lit(" Nr "), k.cast("string"), F.lit(" vom "), when, F.lit(" an "), F.col("c_name"), F.lit("\n"), sender, F.lit("\nBetrag "), F.col("o_orderpriority"))
    name = F.concat(F.when(k % 5 == 0, F.lit("2024-05-06_")).otherwise(F.lit("scan ")), k.cast("string"), F.when(k % 2 == 0, F.lit(".pdf")).otherwise(F.lit(".PDF")))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("doc_id"), name.alias("filename"), text.alias("text"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of filed documents, from events."""
    e = table(spark, sf_dir, "events")
    number = (F.col("user_id") % 7).cast("string")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("scan_"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("original_filename"),
        F.concat(F.lit("/archiv/"), F.col("event_type"), F.lit("/"), number).alias("target_folder"), F.concat_ws("_", "event_type", number).alias("target_folder_name"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("Archiv/"), F.col("event_type"))).alias("target_relative_path"),
        F.array(F.col("event_type"), F.concat(F.lit("K"), (F.col("event_id") % 5).cast("string"))).alias("keywords"),
        F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("extracted_text"), F.col("ts").alias("created_at"), "value",
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, parent, root: regions, their nations and market segments as a tree."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.concat(F.lit("/akten/"), F.col("r_name")).alias("path"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    mid = joined.select(F.concat(F.lit("/akten/"), F.col("r_name"), F.lit("/"), F.col("n_name")).alias("path"))
    return top.unionByName(mid)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: the folders that exist now of those in the log: numbers 5 and 6 moved (5 twice, 6 of one kind only), the others stayed."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("n")).distinct()
    kind, n = F.col("event_type"), F.col("n").cast("string")
    moved = F.array(F.concat(F.lit("/neu/"), kind, F.lit("_5")), F.concat(F.lit("/neu/alt/"), kind, F.lit("_5")))
    there = F.when(F.col("n") < 5, F.array(F.concat(F.lit("/archiv/"), kind, F.lit("/"), n))).when(F.col("n") == 5, moved).when(kind == "click", F.array(F.lit("/neu/Click_6")))
    return e.select(F.explode(there).alias("path"))
