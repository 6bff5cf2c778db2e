"""Names, matches and plans of file actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import containment


def resolve_folders(learned: DataFrame, folders: DataFrame) -> DataFrame:
    """learned(id, folder) with the path that exists: the same path, else the last path with that name; others are dropped."""
    by_path = folders.select(F.col("path").alias("folder"), F.col("path").alias("same"))
    by_name = folders.groupBy(F.lower(T.basename(F.col("path"))).alias("name")).agg(F.max("path").alias("named"))
    joined = learned.withColumn("name", F.lower(T.basename(F.col("folder")))).join(by_path, "folder", "left").join(by_name, "name", "left")
    return joined.select("id", "folder", F.coalesce("same", "named").alias("path")).filter(F.col("path").isNotNull())


def resolve_learned(learned: DataFrame, folders: DataFrame) -> DataFrame:
    """learned(name, path) with the folder that exists now: the same path, else the last path whose own name is `name` in any case; others go."""
    by_path = folders.select("path", F.col("path").alias("same")).distinct()
    by_name = folders.groupBy(F.lower(T.basename(F.col("path"))).alias("low")).agg(F.max("path").alias("named"))
    joined = learned.withColumn("low", F.lower("name")).join(by_path, "path", "left").join(by_name, "low", "left")
    return joined.select("name", "path", F.coalesce("same", "named").alias("resolved")).filter("resolved IS NOT NULL")


def lookup_correspondent(names: DataFrame, known: DataFrame) -> DataFrame:
    """names(name) with the known(kid, korrespondent) that they equal without blanks around, else the first that contains them or that they contain, in any case; blank names have none."""
    asked = names.select("name", F.trim("name").alias("text")).filter("text != ''")
    first = known.filter("korrespondent != ''").groupBy("korrespondent").agg(F.min("kid").alias("kid"))
    same = asked.join(first.withColumnRenamed("korrespondent", "text"), "text", "left")
    hit, miss = same.filter("kid IS NOT NULL"), same.filter("kid IS NULL").select("name", F.lower("text").alias("text"))
    fuzzy = miss.join(containment.first_match(miss, first.select(F.col("kid").alias("pos"), F.lower("korrespondent").alias("name"))), "text")
    return hit.select("name", "kid", F.lit("exact").alias("how")).unionByName(fuzzy.select("name", F.col("pos").alias("kid"), F.lit("fuzzy").alias("how")))


def match_answers(answers: DataFrame, folders: DataFrame) -> DataFrame:
    """answers(id, answer) with the folder of folders(pos, name) that it equals, else equals in other case, else the first that contains it or that it contains; null if none.

    Where folders have a path, it is that of the first folder with the name found. A blank answer has no folder.
    """
    same = folders.groupBy(F.col("name").alias("answer")).agg(F.min("pos").alias("pos0"))
    lower = folders.groupBy(F.lower("name").alias("low")).agg(F.min_by("name", "pos").alias("by_case"))
    asked = answers.withColumn("low", F.lower("answer")).join(same.filter("answer != ''"), "answer", "left").join(lower.filter("low != ''"), "low", "left")
    open_answers = asked.filter("pos0 IS NULL AND by_case IS NULL AND trim(low) != ''").select(F.col("low").alias("text")).distinct()
    partly = containment.first_match(open_answers, folders.select("pos", F.lower("name").alias("name")))
    partly = partly.join(folders.groupBy("pos").agg(F.min("name").alias("by_part")), "pos").select(F.col("text").alias("low"), "by_part")
    found = F.when(F.col("pos0").isNotNull(), F.col("answer")).otherwise(F.coalesce("by_case", "by_part"))
    how = F.when(F.col("pos0").isNotNull(), "exact").when(F.col("by_case").isNotNull(), "case").when(F.col("by_part").isNotNull(), "part")
    out = asked.join(partly, "low", "left").select("id", "answer", found.alias("folder"), how.alias("how"))
    if "path" not in folders.columns:
        return out
    return out.join(folders.groupBy(F.col("name").alias("folder")).agg(F.min_by("path", "pos").alias("path")), "folder", "left").select("id", "answer", "folder", "how", "path")


#: Suffix of a path's last name (none where the name begins with its only dot), and the number at the end of a stem.
_SUFFIX, _NUMBER = r"((?<=[^/])\.[^./]+)?\z", r" \(([1-9][0-9]{0,8})\)\z"


def unique_paths(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """moves(source, target) with a target of its own: ` (n)` with the next free n where a file or an earlier source has it.

    Numbered names that exist, or that are another move's own target, are not free.
    """
    files = existing.select(F.col("path").alias("target")).distinct()
    names = files.union(moves.select("target")).distinct().withColumn("suffix", F.regexp_extract("target", _SUFFIX, 1))
    names = names.withColumn("stem", F.expr("substring(target, 1, length(target) - length(suffix))")).withColumn("number", F.regexp_extract("stem", _NUMBER, 1))
    used = names.filter("number != ''").select(F.concat(F.regexp_replace("stem", _NUMBER, ""), "suffix").alias("target"), F.col("number").cast("long").alias("number"))
    # So many free numbers lie below each number used; the k-th free number is k and the used ones with fewer than k below.
    by = Window.partitionBy("target")
    used = used.select("target", F.lit(None).alias("source"), (F.col("number") - F.row_number().over(by.orderBy("number"))).alias("k"), F.lit(1).alias("used"))
    nth = F.row_number().over(by.orderBy("source")) - 1 + F.coalesce("taken", F.lit(0))
    asked = moves.join(files.withColumn("taken", F.lit(1)), "target", "left").select("target", "source", nth.cast("long").alias("k"), F.lit(0).alias("used"))
    both = asked.unionByName(used.select("target", F.col("source").cast(moves.schema["source"].dataType).alias("source"), "k", "used"))
    below = F.sum("used").over(by.orderBy("k", "used").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("n", F.col("k") + below).filter("used = 0").withColumn("suffix", F.regexp_extract("target", _SUFFIX, 1))
    stem = F.expr("substring(target, 1, length(target) - length(suffix))")
    return found.select("source", F.when(F.col("k") == 0, F.col("target")).otherwise(F.concat(stem, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), "suffix")).alias("target"))


def split_plan(files: DataFrame) -> DataFrame:
    """files(stem, pages): one output a page."""
    return files.select("stem", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page")).withColumn("output", F.concat("stem", F.lit("_Seite_"), F.col("page").cast("string"), F.lit(".pdf")))


def split_chosen(files: DataFrame) -> DataFrame:
    """files(stem, pages, chosen): one output a chosen page (all if chosen is null), with an error where a page isn't there.

    A file with an invalid page gives one row with the error and no output.
    """
    chosen = F.coalesce("chosen", F.sequence(F.lit(1), F.col("pages").cast("int")))
    checked = files.select("stem", chosen.alias("chosen"), F.filter(chosen, lambda p: (p < 1) | (p > F.col("pages"))).alias("invalid"))
    error = F.when(F.size("invalid") > 0, F.concat(F.lit("Ungültige Seitenzahlen: ["), F.array_join(F.col("invalid").cast("array<string>"), ", "), F.lit("]")))
    each = checked.withColumn("error", error).select("stem", "error", F.explode(F.when(error.isNull(), F.col("chosen")).otherwise(F.array(F.lit(None).cast("int")))).alias("page"))
    return each.withColumn("output", F.concat("stem", F.lit("_Seite_"), F.col("page").cast("string"), F.lit(".pdf")))


def copy_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """files(source): a copy beside each, named _kopie, then _kopie_2 and on, with the first number that is free."""
    parts = files.select("source", F.regexp_extract("source", _SUFFIX, 1).alias("suffix")).withColumn("stem", F.expr("substring(source, 1, length(source) - length(suffix))"))
    told = existing.select("path", F.regexp_extract("path", _SUFFIX, 1).alias("suffix")).withColumn("rest", F.expr("substring(path, 1, length(path) - length(suffix))"))
    number = F.regexp_extract("rest", r"_kopie(?:_([1-9][0-9]{0,8}))?\z", 1)
    told = told.filter(F.col("rest").rlike(r"_kopie(_[1-9][0-9]{0,8})?\z")).select(F.regexp_replace("rest", r"_kopie(_[1-9][0-9]{0,8})?\z", "").alias("stem"), "suffix", F.when(number == "", 1).otherwise(number.cast("int")).alias("n")).distinct()
    # The first gap: the least number k that isn't used, where 1 to k - 1 are.
    run = told.withColumn("k", F.row_number().over(Window.partitionBy("stem", "suffix").orderBy("n"))).filter("n = k").groupBy("stem", "suffix").agg((F.max("k") + 1).alias("free"))
    free = F.coalesce("free", F.lit(1))
    name = F.concat("stem", F.lit("_kopie"), F.when(free > 1, F.concat(F.lit("_"), free.cast("string"))).otherwise(""), "suffix")
    return parts.join(run, ["stem", "suffix"], "left").select("source", name.alias("target"))


def hybrid_names(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Ranked names of docs(doc_id, filename, day, kind): by date 0.7, date and category 0.75, else category 0.6, in this order.

    The name of model(doc_id, name, confidence) comes first above 0.7, else last.
    """
    base = F.replace(F.replace("filename", F.lit(".pdf"), F.lit("")), F.lit(".PDF"), F.lit(""))
    option = lambda no, name, c: F.struct(F.lit(no).alias("no"), name.alias("name"), F.lit(c).alias("confidence"), F.lit("local").alias("source"))
    joined = F.when(F.col("day").isNull(), F.concat("kind", F.lit("_"), base, F.lit(".pdf")))
    options = F.array(option(1, F.concat("day", F.lit("_"), base, F.lit(".pdf")), 0.7), option(2, F.concat("day", F.lit("_"), "kind", F.lit(".pdf")), 0.75), option(3, joined, 0.6))
    local = docs.select("doc_id", F.explode(options).alias("o")).select("doc_id", "o.*").filter("name IS NOT NULL")
    said = model.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").filter("name != ''")
    said = said.select("doc_id", F.when(F.col("confidence") > 0.7, 0).otherwise(4).alias("no"), "name", "confidence", F.lit("llm").alias("source"))
    both = local.unionByName(said)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("no"))).drop("no")


def batch_renames(docs: DataFrame, names: DataFrame, existing: DataFrame) -> DataFrame:
    """doc_id, new_name, status of what a batch does to docs(doc_id, folder, filename): the first model name above 0.5, with `.pdf` and made unique in its folder.

    Skipped is what has no such name, or has it already; an error is a file that isn't among existing(path), and a name with a slash.
    """
    first = names.filter("source = 'llm' AND confidence > 0.5").groupBy("doc_id").agg(F.min_by("name", "place").alias("said"))
    here = existing.select(F.col("path").alias("at")).distinct().withColumn("there", F.lit(True))
    joined = docs.join(first, "doc_id", "left").withColumn("at", F.concat("folder", F.lit("/"), "filename")).join(here, "at", "left")
    status = F.when(F.col("said").isNull() | (F.col("said") == F.col("filename")), "skipped").when(F.col("there").isNull() | F.contains("said", F.lit("/")), "error").otherwise("renamed")
    told = joined.withColumn("status", status)
    moves = told.filter("status = 'renamed'").select(F.col("doc_id").alias("source"), F.concat("folder", F.lit("/"), T.with_pdf(F.col("said"))).alias("target"))
    placed = unique_paths(moves, existing).select(F.col("source").alias("doc_id"), T.basename(F.col("target")).alias("new_name"))
    return told.join(placed, "doc_id", "left").select("doc_id", "new_name", "status")


def merge_plan(lists: DataFrame, pages: DataFrame, parts: int | None = None) -> DataFrame:
    """lists(output, sources) and pages(source, page): the page numbers of each output, sources in their order; in so many parts, so that one doesn't grow with the tables."""
    dealt = lambda df, key: df if parts is None else df.repartition(parts, key)
    wanted = lists.select("output", F.posexplode("sources").alias("pos", "source"))
    each = dealt(dealt(wanted, "source").join(dealt(pages, "source"), "source"), "output")
    return each.select("output", "source", "page", F.row_number().over(Window.partitionBy("output").orderBy("pos", "page")).alias("new_page"))


def merge_checked(lists: DataFrame, pages: DataFrame) -> DataFrame:
    """merge_plan with an error, and no pages, for each output without sources or with one (the first is named) that isn't there."""
    wanted = lists.select("output", F.posexplode("sources").alias("pos", "source"))
    gone = wanted.join(pages.select("source").distinct(), "source", "left_anti").groupBy("output").agg(F.min_by("source", "pos").alias("gone"))
    empty = F.coalesce(F.size("sources"), F.lit(0)) <= 0
    error = F.when(empty, F.lit("Es müssen mindestens zwei PDF-Quelldateien angegeben werden.")).when(F.col("gone").isNotNull(), F.concat(F.lit("Quelldatei nicht gefunden: "), "gone"))
    told = lists.join(gone, "output", "left").select("output", "sources", error.alias("error"))
    plan = merge_plan(told.filter("error IS NULL"), pages).withColumn("error", F.lit(None).cast("string"))
    return plan.unionByName(told.filter("error IS NOT NULL").select("output", "error"), allowMissingColumns=True)


def rename_candidates(docs: DataFrame, most: int = 6, learned: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, filename, text) with ranked names: by rule 0.6 (unless it is the present name), category and number 0.4, date and category 0.5, date 0.3.

    Of learned(doc_id, name, place) the first three of each document join them at 0.7; of equal names the rule's stays.
    """
    # Columns of their own, so each rule runs once a document.
    read = docs.select("doc_id", "text", "filename", F.get(T.categories(F.col("text")), F.lit(0)).alias("kind"), F.get(T.dates(F.col("text")), F.lit(0)).alias("newest"))
    read = read.select("doc_id", T.capitalised(F.col("kind")).alias("kind"), F.date_format("newest", "yyyy-MM-dd").alias("day"), T.number_in_stem(F.col("filename")).alias("number"), F.nullif(T.with_pdf(T.suggested_name(F.col("text"), F.col("filename"), F.col("kind"), F.col("newest"))), F.col("filename")).alias("rule"))
    option = lambda no, name, c: F.struct(F.lit(no).alias("no"), name.alias("name"), F.lit(c).alias("confidence"))
    options = F.array(
        option(0, F.col("rule"), 0.6), option(1, F.concat("day", F.lit(".pdf")), 0.3),
        option(2, F.concat("day", F.lit(" "), "kind", F.lit(".pdf")), 0.5), option(3, F.concat("kind", F.lit(" Nr"), "number", F.lit(".pdf")), 0.4),
    )
    each = read.select("doc_id", F.explode(options).alias("o")).select("doc_id", "o.*").filter("name IS NOT NULL")
    if learned is not None:
        top = learned.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "name"))).filter("n <= 3")
        each = each.unionByName(top.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", (F.col("n") + 3).alias("no"), "name", F.lit(0.7).alias("confidence")))
    once = each.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("no"))).filter("n = 1")
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "no")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("doc_id", "name", "confidence", "rank")
