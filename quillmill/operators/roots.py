"""Folders below ordered roots: ancestor joins, relative paths in three forms, and the tree in its order.

A path's ancestors are listed, so that roots are found by an equi-join; the first root by position counts.
Paths are absolute; slashes at their end and doubled ones don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def joined(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def ancestors(path: Column) -> Column:
    """The path itself and all above it, down from `/`."""
    names = parts(path)
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: joined(F.slice(names, F.lit(1), n)))


def name(path: Column) -> Column:
    """The last name; empty for `/`."""
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def first_root(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """folders(path, ...) with root, the first of roots(pos, root) that is the path or above it (null if none is), and rest, the names below it."""
    known = roots.select(joined(parts(F.col("root"))).alias("above"), "pos").groupBy("above").agg(F.min("pos").alias("pos"))
    each = folders.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    found = each.join(known, "above").groupBy("path").agg(F.min_by("above", "pos").alias("root"))
    below = parts(F.col("path"))
    return folders.join(found, "path", "left").withColumn("rest", F.when(F.col("root").isNotNull(), F.slice(below, F.size(parts(F.col("root"))) + 1, F.greatest(F.size(below), F.lit(1)))))


def with_relative(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """folders(path, ...) with root and relative: the root's name and the names below it (as suggestions and the file manager show it); without a root the folder's own name."""
    found = first_root(folders, roots)
    shown = F.array_join(F.array_compact(F.concat(F.array(F.nullif(name(F.col("root")), F.lit(""))), "rest")), "/")
    return found.withColumn("relative", F.when(F.col("root").isNull(), name(F.col("path"))).otherwise(shown)).drop("rest")


def with_relative_to_parent(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """folders(path, ...) with relative: the names below the parent of the first root whose parent is above the path or the path (then `.`), as the tree shows it; else the folder's own name."""
    above = roots.select("pos", joined(F.slice(parts(F.col("root")), F.lit(1), F.greatest(F.size(parts(F.col("root"))) - 1, F.lit(0)))).alias("root"))
    found = first_root(folders, above)
    shown = F.when(F.size("rest") == 0, ".").otherwise(F.array_join("rest", "/"))
    return found.withColumn("relative", F.when(F.col("root").isNull(), name(F.col("path"))).otherwise(shown)).drop("rest", "root")


def tree(folders: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """root, path, name, parent, depth, sort_key of the folders below each of roots(pos, root), itself at depth 0; a folder with a hidden name below the root goes with all below it.

    A folder counts once for every root that it is under. Ordered by sort_key the rows are the tree in pre-order: a folder before its subfolders, these by
    name. `most` bounds the depth.
    """
    named = roots.select(joined(parts(F.col("root"))).alias("above"), "pos").groupBy("above").agg(F.min("pos").alias("pos"))
    each = folders.select(joined(parts(F.col("path"))).alias("path")).distinct().select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    rows = each.join(named, "above").withColumn("rest", F.slice(parts(F.col("path")), F.size(parts(F.col("above"))) + 1, F.greatest(F.size(parts(F.col("path"))), F.lit(1))))
    rows = rows.filter(~F.exists("rest", lambda p: F.startswith(p, F.lit(".")))).withColumn("depth", F.size("rest"))
    rows = rows if most is None else rows.filter(F.col("depth") <= most)
    key = F.struct("pos", F.col("above").alias("root"), F.col("rest").alias("names"))
    up = joined(F.slice(parts(F.col("path")), F.lit(1), F.greatest(F.size(parts(F.col("path"))) - 1, F.lit(0))))
    return rows.select(F.col("above").alias("root"), "path", name(F.col("path")).alias("name"), up.alias("parent"), "depth", key.alias("sort_key"))


def subfolders(folders: DataFrame, parent: str) -> DataFrame:
    """path, name of the visible folders directly below another one, by name."""
    up = joined(F.slice(parts(F.col("path")), F.lit(1), F.greatest(F.size(parts(F.col("path"))) - 1, F.lit(0))))
    rows = folders.select("path", name(F.col("path")).alias("name")).filter((up == "/" + parent.strip("/")) & ~F.startswith("name", F.lit(".")) & (F.col("name") != ""))
    return rows.orderBy("name")


def existing(listed: DataFrame, folders: DataFrame) -> DataFrame:
    """Of a list of folders those that are there."""
    return listed.join(folders.select("path").distinct(), "path", "left_semi")


def file_counts(folders: DataFrame, files: DataFrame) -> DataFrame:
    """path, n: PDF files directly in each folder, of files(path); 0 where there are none."""
    pdf = files.filter(F.endswith(F.lower("path"), F.lit(".pdf")))
    n = pdf.select(joined(F.slice(parts(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return folders.join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
