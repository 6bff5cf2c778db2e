"""One query an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import batch_index as batch
from quillmill.operators import filing, gated, history, metadata, model_store, models, roots, search, search_index, similarity, store, subfolders
from quillmill.sources import tables, versions, xmp
from quillmill.sources.tables import table
from quillmill.streaming import indexing

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _each_letter(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.letters(spark, sf_dir).select("doc_id", *[c().alias(n) for n, c in columns.items()])

    return run


@query
def scan_newest_first(spark, d):
    return history.newest_first(tables.history(spark, d)).select("target_folder", "id", "created_at", "n")


@query
def entries_for_folder(spark, d):
    return history.of_folder(tables.history(spark, d), "/archiv/click/3").select("id", "original_filename")


@query
def entries_with_text(spark, d):
    return history.with_text(tables.history(spark, d)).select("id", "extracted_text")


@query
def keyword_overlap(spark, d):
    return history.with_overlap(tables.history(spark, d), ["PURCHASE", "k2"]).select("id", "target_folder")


@query
def rename_by_keywords(spark, d):
    return history.newest(history.with_overlap(tables.history(spark, d), ["error"]), 5).select("id", "created_at")


@query
def history_by_relative_path(spark, d):
    return history.of_relative_path(tables.history(spark, d), "Archiv/view").select("id", "created_at")


@query
def folder_stats(spark, d):
    return history.folder_stats(tables.history(spark, d))


@query
def relative_path_ilike(spark, d):
    return history.relative_path_like(history.folder_stats(tables.history(spark, d)), "IV/C", 10).select("path", "relative_path", "usage_count")


@query
def most_used_folders(spark, d):
    return history.folder_stats(tables.history(spark, d)).orderBy(F.desc("usage_count"), "path").limit(5).select("path", "usage_count")


@query
def learned_folder_names(spark, d):
    return history.counts_by(tables.history(spark, d), "target_folder_name")


@query
def learned_relative_paths(spark, d):
    return history.counts_by(tables.history(spark, d), "target_relative_path")


@query
def folder_keywords(spark, d):
    return history.folder_keywords(tables.history(spark, d))


@query
def table_counts(spark, d):
    return history.counts(tables.history(spark, d))


@query
def last_used(spark, d):
    return history.last_used(tables.history(spark, d))


@query
def token_usage(spark, d):
    return history.token_usage(tables.history(spark, d), F.get_json_object("extracted_text", "$.k").cast("long"))


@query
def korrespondent_upsert(spark, d):
    e = table(spark, d, "events").select(
        F.concat(F.lit(" user "), (F.col("user_id") % 50).cast("string")).alias("korrespondent"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("kategorie"),
        F.when(F.col("event_id") % 3 == 0, F.lit("EUR")).alias("waehrung"), "ts", "event_id",
    )
    return history.learned_fields(e, "korrespondent", ["kategorie", "waehrung"], ["ts", "event_id"])


@query
def index_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file_path"), F.col("o_orderkey").alias("seq"), F.coalesce("o_orderpriority", F.lit("")).alias("keywords"))
    return history.latest(o, "file_path", F.desc("seq"))


QUERIES |= {
    "extract_dates": _each_letter(dates=lambda: F.array_join(F.transform(T.dates(F.col("text")), lambda x: x.cast("string")), ",")),
    "extract_keywords": _each_letter(keywords=lambda: F.array_join(T.categories(F.col("text")), ",")),
    "extract_company": _each_letter(company=lambda: T.company(F.col("text"))),
    "suggest_filename_rule": _each_letter(name=lambda: T.with_pdf(T.suggested_name(F.col("text"), F.col("filename")))),
    "sanitize_filename": _each_letter(name=lambda: T.sanitised(F.concat(F.lit("Größe: Müller/"), F.repeat(F.lit("x"), (F.col("doc_id") % 90).cast("int")), F.col("filename")))),
    "truncate_text": _each_letter(text=lambda: T.truncated(F.col("text"), 60)),
    "classification_prompt": _each_letter(prompt=lambda: T.classification_prompt(F.col("text"), F.array(F.lit("Bank"), F.lit("Strom")))),
    "stem_number": _each_letter(stem=lambda: T.stem(F.col("filename")), number=lambda: T.number_in_stem(F.col("filename"))),
    "year_from_string": _each_letter(year=lambda: T.year_in(F.col("filename"))),
    "title_from_name": _each_letter(title=lambda: T.title_of(F.col("filename"))),
    "pdf_suffix": _each_letter(name=lambda: T.with_pdf(F.col("filename"))),
    "tax_year": _each_letter(year=lambda: T.tax_year(F.get(T.dates(F.col("text")), F.lit(0)).cast("string"))),
}


@query
def extract_dates_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(T.dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates"))


@query
def parse_response(spark, d):
    answer = F.concat(F.lit("DATEINAME: "), F.col("filename"), F.lit("\nKONFIDENZ: "), F.when(F.col("doc_id") % 3 == 0, "hoch").otherwise(F.concat((F.col("doc_id") % 100).cast("string"), F.lit("%"))), F.lit("\nKATEGORIE: Bank\n BETRAG: 7\nORDNER: KEINE\nBETRAG: "), F.when(F.col("doc_id") % 2 == 0, "UNBEKANNT").otherwise("12,50"), F.lit("\nKATEGORIE: "), F.col("doc_id").cast("string"))
    a = tables.letters(spark, d).select("doc_id", answer.alias("a"))
    return a.select("doc_id", T.answer_field(F.col("a"), "DATEINAME:", True).alias("filename"), T.answer_confidence(F.col("a")).alias("confidence"), T.answer_field(F.col("a"), "KATEGORIE:").alias("subject"), T.answer_field(F.col("a"), "BETRAG:").alias("betrag"), T.answer_field(F.col("a"), "ORDNER:", True).alias("folder"), F.size(T.answer_metadata(F.col("a"))).cast("long").alias("n_fields"))


@query
def strip_fences(spark, d):
    fenced = F.concat(F.when(F.col("doc_id") % 2 == 0, "```text\n").otherwise(""), F.col("filename"), F.when(F.col("doc_id") % 2 == 0, "\n```").otherwise(""))
    return tables.letters(spark, d).select("doc_id", T.without_fences(fenced).alias("answer"))


@query
def human_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * 1280).alias("size"))


@query
def path_parts(spark, d):
    p = F.col("target_folder")
    full = F.concat(p, F.lit("/"), F.col("original_filename"))
    return tables.history(spark, d).select("id", T.basename(full).alias("name"), T.stem(T.basename(full)).alias("stem"), T.suffix(full).alias("suffix"), T.parent(full).alias("parent"))


@query
def display_name(spark, d):
    full = F.concat(F.col("target_folder"), F.lit("/a/very/long/way/to/the/file/"), F.col("original_filename"))
    return tables.history(spark, d).select("id", T.short_path(full).alias("shown"), T.percent(F.col("value") / 1000).alias("percent"))


@query
def json_roundtrip(spark, d):
    parsed = F.from_json("extracted_text", "k long")
    return tables.history(spark, d).select("id", F.to_json(parsed).alias("json"), parsed["k"].alias("k"))


@query
def pdfs_per_folder(spark, d):
    f = tables.folders(spark, d)
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return roots.file_counts(f, c.select(F.concat_ws("/", F.lit("/akten"), "r_name", "n_name", F.concat("c_custkey", F.when(F.col("c_custkey") % 5 == 0, ".txt").when(F.col("c_custkey") % 2 == 0, ".PDF").otherwise(".pdf"))).alias("path")))


@query
def folder_depth(spark, d):
    tops = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("/akten/"), "r_name").alias("root"))
    return roots.tree(tables.folders(spark, d), tops, 5).select("path", F.col("depth").cast("long").alias("depth"), "name", "parent")


def _documents_of(spark, d):
    """A path for every customer below a nation, some hidden, some with odd slashes, and roots that overlap."""
    c, nation, region = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("c_custkey")
    sub = F.when(k % 9 == 0, F.lit("/.alt/")).when(k % 5 == 0, F.lit("//")).otherwise(F.lit("/"))
    joined = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    paths = joined.select(F.concat(F.when(k % 7 == 0, F.lit("/weg/")).otherwise(F.lit("/akten/")), "r_name", F.lit("/"), "n_name", sub, F.col("c_mktsegment"), F.when(k % 4 == 0, F.lit("/")).otherwise("")).alias("path")).distinct()
    tops = nation.filter("n_nationkey % 3 = 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("/akten/"), "r_name", F.lit("/"), "n_name").alias("root"))
    return paths.unionByName(tables.folders(spark, d)), tops.unionByName(region.select((F.col("r_regionkey") * 6 + 10).alias("pos"), F.concat(F.lit("/akten/"), "r_name", F.lit("/")).alias("root")))


@query
def root_prefix_join(spark, d):
    return roots.with_relative(*_documents_of(spark, d)).select("path", "relative", "root")


@query
def relative_to_root_parent(spark, d):
    return roots.with_relative_to_parent(*_documents_of(spark, d)).select("path", "relative")


@query
def folder_tree(spark, d):
    """The tree in pre-order; `place` is a row's number within its root."""
    rows = roots.tree(*_documents_of(spark, d))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("sort_key"))).select("root", "path", "depth", "place")


@query
def resolve_folder(spark, d):
    learned = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/alt/"), F.lower("n_name"))).when(F.col("c_custkey") % 3 == 1, F.lit("/akten/ASIA")).otherwise("/weg").alias("folder"))
    return filing.resolve_folders(learned, tables.folders(spark, d))


@query
def korrespondent_lookup(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("kid"), F.col("s_name").alias("korrespondent"))
    s = F.col("s_suppkey")
    names = table(spark, d, "supplier").select(F.when(s % 4 == 0, F.concat(F.lit("  "), "s_name", F.lit(" "))).when(s % 4 == 1, F.concat(F.lower("s_name"), F.lit(" GmbH"))).when(s % 4 == 2, F.substring("s_name", -3, 3)).when(s % 8 == 3, F.lit("  ")).otherwise(F.concat(F.lit("unbekannt "), s.cast("string"))).alias("name")).distinct()
    return filing.lookup_correspondent(names, known)


@query
def tfidf_vocabulary(spark, d):
    return similarity.vocabulary(similarity.terms(table(spark, d, "documents")))


def _log(spark, d):
    """The log as suggestions read it, and who asks: every id divisible by 20, each against all other rows."""
    h = tables.history(spark, d).select("id", F.col("target_folder_name").alias("folder"), F.col("target_folder").alias("path"), F.col("extracted_text").alias("text"), "keywords")
    return h, h.filter("id % 20 = 0").select(F.col("id").alias("query"))


@query
def suggest_by_text(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), "text")
    found = similarity.by_text(docs, docs.filter("id % 20 = 0").select(F.col("id").alias("query")))
    return similarity.ranked(found, 5, "score").select("query", "folder", F.round("score", 6).alias("score"), "rank")


def _by_keywords(spark, d, k):
    h, q = _log(spark, d)
    return similarity.resolved(similarity.by_keywords(h, q), h, tables.archive(spark, d), similarity.keyword_reason(), k)


@query
def suggest_by_keywords(spark, d):
    return _by_keywords(spark, d, 5).select("query", "folder", "name", F.round("confidence", 6).alias("confidence"), "rank")


@query
def suggest_by_frequency(spark, d):
    found = similarity.frequent(history.named_stats(tables.history(spark, d)), tables.archive(spark, d))
    return found.select("folder", "confidence", "reason", "place", "nth")


def _suggest(spark, d, k):
    h, q = _log(spark, d)
    text = similarity.resolved(similarity.by_text(h, q), h, tables.archive(spark, d), similarity.text_reason(), k)
    often = similarity.frequent(history.named_stats(tables.history(spark, d)), tables.archive(spark, d), k)
    return similarity.suggested(q, text, _by_keywords(spark, d, k), often, k)


@query
def suggest(spark, d):
    return _suggest(spark, d, 5).select("query", "folder", F.round("confidence", 6).alias("confidence"), "reason", "rank")


@query
def suggest_with_subfolders(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    tops = kinds.select(F.ascii("event_type").alias("pos"), F.concat(F.lit("/archiv/"), "event_type").alias("root")).unionByName(spark.range(1).select(F.lit(0).alias("pos"), F.lit("/neu/alt").alias("root"))).unionByName(spark.range(1).select(F.lit(500).alias("pos"), F.lit("/neu").alias("root")))
    return similarity.with_relative_paths(_suggest(spark, d, 10), tops).select("query", "folder", "relative", F.round("confidence", 6).alias("confidence"), "rank")


@query
def model_learned(spark, d):
    """A stored model after three batches and a compaction: that of one fit over all documents."""
    return model_store.load(spark, _learned(spark, d))[0].select("term", "total", "df", F.round("idf", 9).alias("idf"))


@query
def suggest_with_stored_model(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("folder"))
    model, learned = model_store.load(spark, _learned(spark, d), listed=True)
    found = similarity.by_stored_text(docs, docs.filter("id % 20 = 0").select(F.col("id").alias("query")), model, learned)
    return similarity.ranked(found, 5, "score").select("query", "folder", F.round("score", 6).alias("score"), "rank")


def _learned(spark, d):
    root = versions.shared_folder(spark, "model")
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    for k in range(3):
        model_store.learn(spark, root, docs.filter(F.pmod("id", F.lit(3)) == k))
        if k == 1:
            model_store.compact(spark, root)
    return root


@query
def merge_hybrid(spark, d):
    c = table(spark, d, "customer")
    local = c.filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("query"), F.col("c_mktsegment").alias("folder"), ((F.col("c_custkey") % 100) / 100).alias("confidence"))
    model = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("query"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("NEU").alias("folder"), F.lit(0.9).alias("confidence"))
    return similarity.merged_with_model(local, model).select("query", "folder", F.round("confidence", 6).alias("confidence"), "source")


@query
def rename_suggestions(spark, d):
    letters = tables.letters(spark, d)
    learned = letters.filter("doc_id % 4 = 0").select("doc_id", F.posexplode(F.array(F.lit("Gelernt.pdf"), F.concat(F.lit("Akte "), F.col("doc_id").cast("string"), F.lit(".pdf")))).alias("place", "name"))
    return filing.rename_candidates(letters, 6, learned)


@query
def unique_path(spark, d):
    p = table(spark, d, "part")
    moves = p.select(F.col("p_partkey").alias("source"), F.concat(F.lit("/ziel/"), F.col("p_brand"), F.lit(".pdf")).alias("target"))
    name = lambda more: F.concat(F.lit("/ziel/"), "p_brand", F.lit(more))
    existing = p.filter("p_brand LIKE '%1' OR p_brand LIKE '%2'").select(F.explode(F.when(F.col("p_brand").endswith("1"), F.array(name(".pdf"))).otherwise(F.array(name(" (1).pdf"), name(" (3).pdf")))).alias("path")).distinct()
    return filing.unique_paths(moves, existing)


@query
def split_plan(spark, d):
    return filing.split_plan(table(spark, d, "part").select(F.col("p_name").alias("stem"), (F.col("p_size") % 5 + 1).alias("pages"), "p_partkey")).select("output", "page")


#: Rows of a table that meet in one part of a merge plan.
MERGED = 250_000


@query
def merge_plan(spark, d):
    li = table(spark, d, "lineitem")
    parts = max(1, -(-li.count() // MERGED))  # from the files' footers
    named = li.select(F.col("l_orderkey").alias("output"), "l_linenumber", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source"))
    lists = named.repartition(parts, "output").groupBy("output").agg(F.transform(F.sort_array(F.collect_set(F.struct("l_linenumber", F.col("source").alias("s"))), asc=False), lambda x: x["s"]).alias("sources"))
    pages = named.select("source").repartition(parts, "source").groupBy("source").agg(F.lit(2).alias("n")).select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return filing.merge_plan(lists, pages, parts).select("output", "source", "page", "new_page")


@query
def cache_validity(spark, d):
    o = table(spark, d, "orders")
    cache = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    files = o.filter("o_orderkey % 7 != 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")).alias("mtime"))
    return indexing.valid_entries(cache, files).select("path")


@query
def precache_todo(spark, d):
    o = table(spark, d, "orders")
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return indexing.to_analyse(files, files.filter("path % 3 = 0")).select("path")


@query
def cache_migrate(spark, d):
    o = table(spark, d, "orders")
    renames = o.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("path"), (-F.col("o_orderkey")).alias("new_path"))
    return indexing.moved(o.select(F.col("o_orderkey").alias("path"), "o_orderpriority"), renames)


@query
def batch_index(spark, d):
    return indexing.analysed(tables.letters(spark, d))


@query
def fts_single(spark, d):
    return search.search(table(spark, d, "documents"), "doc_id", ["text"], "licens").select("id", F.round("rank", 6).alias("rank"))


@query
def fts_and(spark, d):
    return search.search(table(spark, d, "pages"), "page_id", ["url", "html"], "div th").select("id", F.round("rank", 6).alias("rank"))


@query
def fts_phrase_prefix(spark, d):
    return search.search(table(spark, d, "documents"), "doc_id", ["text"], "mit-li").select("id", F.round("rank", 6).alias("rank"))


def _indexed(spark, d):
    """An index of all documents: written, half of it replaced, a seventh deleted, some of that put back, merged."""
    root = versions.shared_folder(spark, "index")
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("source", F.lit(""))).alias("about"))
    key = F.col("doc_id")
    search_index.upsert(spark, root, docs.withColumn("text", F.concat(F.lit("Lizenz alt "), F.coalesce("text", F.lit("")))), "doc_id", ["text", "about"])
    search_index.upsert(spark, root, docs.filter(key % 2 == 0), "doc_id", ["text", "about"])
    search_index.delete(spark, root, docs.filter(key % 7 == 0), "doc_id")
    search_index.upsert(spark, root, docs.filter(key % 28 == 0), "doc_id", ["text", "about"])
    search_index.merge(spark, root)
    return root


@query
def index_search(spark, d):
    return search_index.find(spark, _indexed(spark, d), "licens").select("id", F.round("rank", 6).alias("rank"))


@query
def index_search_terms(spark, d):
    return search_index.find(spark, _indexed(spark, d), "lizenz de").select("id", F.round("rank", 6).alias("rank"))


@query
def index_phrase(spark, d):
    return search_index.find(spark, _indexed(spark, d), "lizenz-al").select("id", F.round("rank", 6).alias("rank"))


@query
def index_count(spark, d):
    return spark.range(1).select(F.lit(search_index.count(spark, _indexed(spark, d))).cast("long").alias("n"))


@query
def match_folder_answer(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    k = F.col("c_custkey")
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("pos"))
    answer = F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, F.lower("name")).when(k % 4 == 2, F.substring("name", 2, 4)).when(k % 3 == 0, F.concat(F.lit("Ordner "), "name")).when(k % 3 == 1, F.lit(" ")).otherwise(F.lit("?"))
    return filing.match_answers(customer.select(k.alias("id"), answer.alias("answer")), nation.withColumn("path", F.concat(F.lit("/akten/"), "name")))


@query
def metadata_precedence(spark, d):
    k, names = F.col("c_custkey"), ["korrespondent", "betrag", "subject"]
    c = table(spark, d, "customer")
    analysis = c.select(k.alias("id"), F.col("c_mktsegment").alias("korrespondent"), k.cast("string").alias("betrag"), F.lit("").alias("subject"))
    model = c.filter("c_custkey % 2 = 0").select(k.alias("id"), F.lit("").alias("korrespondent"), F.concat(F.lit("m"), k).alias("betrag"), F.lit("Modell").alias("subject"))
    stored = c.filter("c_custkey % 5 = 0").select(k.alias("id"), F.lit("").alias("korrespondent"), F.lit("").alias("betrag"), F.when(k % 10 == 0, "PDF").otherwise("").alias("subject"))
    learned = spark.createDataFrame([("BUILDING", "", "gelernt"), ("MACHINERY", "7", "")], "korrespondent string, betrag string, subject string")
    return metadata.precedence(analysis, model, learned, stored, "id", names)


@query
def settings_folder_list(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_id") % 4 == 0, "remove").otherwise("add")
    return metadata.folder_list(e.select(F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("folder"), action.alias("action")))


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("path"), F.unix_timestamp("o_orderdate").alias("mtime"), F.col("o_orderpriority").alias("answer"), (F.col("o_orderkey") % 4 != 1).alias("analysed"))


@query
def children_by_usage(spark, d):
    return history.children_by_usage(history.folder_stats(tables.history(spark, d)), "/archiv/click").select("path", "usage_count")


@query
def rename_history_by_folder(spark, d):
    return history.newest(history.of_folder(tables.history(spark, d), "/archiv/view/2"), 5).select("id", "original_filename", "created_at")


@query
def correspondents_by_usage(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user "), (F.col("user_id") % 50).cast("string")).alias("korrespondent"), F.col("event_type").alias("kategorie"), "ts", "event_id")
    return history.learned_fields(e, "korrespondent", ["kategorie"], ["ts", "event_id"]).orderBy(F.desc("usage_count"), "korrespondent").select("korrespondent", "usage_count")


@query
def task_order(spark, d):
    return history.in_task_order(table(spark, d, "events").select("event_id", "event_type", "ts"), F.length("event_type"), "ts", "event_id").select("event_id", "priority", "ts")


@query
def subfolders_by_name(spark, d):
    return roots.subfolders(tables.folders(spark, d), "/akten/ASIA")


@query
def existing_roots(spark, d):
    named = table(spark, d, "nation").select(F.concat(F.lit("/akten/"), F.col("n_name")).alias("path")).unionByName(table(spark, d, "region").select(F.concat(F.lit("/akten/"), F.col("r_name")).alias("path")))
    return roots.existing(named, tables.folders(spark, d))


@query
def cache_get(spark, d):
    cache = _orders(spark, d)
    files = cache.filter("path % 7 != 0").select("path", (F.col("mtime") + F.when(F.col("path") % 5 == 0, 1).otherwise(0)).alias("mtime"))
    return store.readable(cache, files).select("path", "answer")


@query
def cache_stats(spark, d):
    return store.states(_orders(spark, d), F.col("answer").startswith("1"))


@query
def cache_with_model_answers(spark, d):
    return _orders(spark, d).filter("analysed AND answer LIKE '1%'").select("path", "answer")


@query
def cache_replace(spark, d):
    cache = _orders(spark, d).select("path", "answer", F.lit(0).cast("long").alias("seq"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("answer"), F.col("l_linenumber").cast("long").alias("seq"), *place)
    return store.replaced(cache, rows, "path", ("file", "row"), "answer")


@query
def cache_clear_entries(spark, d):
    cache = _orders(spark, d)
    return store.without(cache, cache.filter("answer LIKE '5%'"), "path").select("path")


@query
def cache_move(spark, d):
    cache = _orders(spark, d).select("path", "mtime", "answer")
    renames = cache.filter("path % 4 = 0").select("path", (F.col("path") + 1).alias("new_path"), (F.col("mtime") + 60).alias("new_mtime"))
    return indexing.moved(cache, renames)


@query
def undo_plan(spark, d):
    o = table(spark, d, "orders")
    name = F.col("o_orderkey").cast("string")
    actions = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("/ein/"), name).alias("source"), F.concat(F.lit("/aus/"), name).alias("target"))
    return store.undo_plan(actions, actions.filter("seq % 3 != 0").select(F.col("target").alias("path")))


@query
def split_invalid(spark, d):
    size = F.col("p_size") % 5 + 1
    chosen = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(2), F.lit(1))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit(0), F.lit(1), F.lit(9)))
    files = table(spark, d, "part").select(F.col("p_name").alias("stem"), size.alias("pages"), chosen.alias("chosen"))
    return filing.split_chosen(files)


@query
def merge_errors(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("q"), k.cast("string"))
    lists = table(spark, d, "part").select(k.alias("output"), F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(name, F.lit("weg"), F.lit("fort"))).otherwise(F.array(name, F.lit("q1"))).alias("sources"))
    pages = table(spark, d, "part").select(name.alias("source"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    return filing.merge_checked(lists, pages).select("output", "source", "page", "new_page", "error")


@query
def suggest_subfolder_for_parent(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stats = c.filter("n_nationkey % 3 = 0").groupBy(F.concat_ws("/", F.lit("/akten"), "r_name", "n_name").alias("path")).agg(F.count("*").alias("usage_count"))
    parents = table(spark, d, "region").select(F.concat(F.lit("/akten/"), "r_name").alias("parent"))
    return subfolders.for_parents(parents, stats, tables.folders(spark, d)).select("parent", "folder", F.round("confidence", 6).alias("confidence"), "reason", "place")


def _prompted(spark, d):
    day = F.when(F.col("doc_id") % 2 == 0, F.date_format(F.get(T.dates(F.col("text")), F.lit(0)), "yyyy-MM-dd"))
    prompt = models.filename_prompt(F.col("text"), F.col("filename"), T.categories(F.col("text")), day, F.lit("/akten"), None, models.owner_section("Ada Muster", "A. Muster, ", "Muster GmbH"))
    return tables.letters(spark, d).select("doc_id", prompt.alias("prompt"))


@query
def filename_prompt(spark, d):
    return _prompted(spark, d)


@query
def model_filenames(spark, d):
    said = models.answered(_prompted(spark, d), "prompt", models.Stub(75))
    return said.select("doc_id", T.answer_field(F.col("answer"), "DATEINAME:", True).alias("name"), T.answer_confidence(F.col("answer")).alias("confidence"))


class _FirstFolder:
    """Names the folder on the last line of the list whose number of letters fits the prompt, by rule, as `models.Stub` does."""

    def is_available(self) -> bool:
        return True

    def answers(self, prompts):
        listed = [[x[2:] for x in p.split("\n\n")[0].split("\n")[1:]] for p in prompts]
        return [f"ORDNER: {x[len(p) % len(x)].lower()}\nBEGRÜNDUNG: passt\nKONFIDENZ: {len(p) % 100}" for p, x in zip(prompts, listed)]


@query
def suggest_folders_gated(spark, d):
    """Customers by their segment and nation: two thirds have a local suggestion, a third of these a sure one; the others are asked, once for each distinct prompt."""
    c, k = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    day = F.when(k % 2 == 0, F.lit("2024-05-06"))
    docs = c.select(k.alias("query"), F.col("c_mktsegment").alias("text"), F.when(k % 4 == 0, F.array(F.lit("bank"), F.lit("gas"))).alias("keywords"), day.alias("day"))
    folders = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name"), F.concat(F.lit("/akten/"), "r_name").alias("path"))
    local = c.filter("c_custkey % 3 != 0").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(k.alias("query"), F.concat(F.lit("/akten/"), "r_name").alias("folder"), F.when(k % 3 == 1, 0.9).otherwise(0.4).alias("confidence"), F.lit("Ähnliche Schlüsselwörter").alias("reason"))
    found = gated.suggest_folders(docs, local, folders, _FirstFolder())
    return found.select("query", "folder", F.round("confidence", 6).alias("confidence"), "reason", "source", "rank")


class _Clerk:
    """Tells category, correspondent, amount and year from the lines of a letter, by rule, as `models.Stub` does."""

    def is_available(self):
        return True

    def answers(self, prompts):
        out = []
        for prompt in prompts:
            letter = prompt.split("Text:\n")[1].split("\n")
            words = letter[0].split(" ")
            out.append(f"DATEINAME: x.pdf\nKATEGORIE: {words[0]}\nKORRESPONDENT: {letter[1]}\nBETRAG: {letter[2].split(' ')[1]}\nSTEUERJAHR: KEINE\nZUSAMMENFASSUNG: Nr {words[2]}\nKONFIDENZ: 90")
        return out


@query
def batch_index_job(spark, d):
    """All letters, of which each 11th can't be read and each 7th is empty, indexed in one job; returns what the index holds."""
    k = F.col("doc_id")
    path = F.concat(F.lit("/ein/"), (k % 10).cast("string"), F.lit("/"), "filename")
    text = F.when(k % 11 != 0, F.when(k % 7 == 0, "").otherwise(F.col("text")))
    files = tables.letters(spark, d).select(path.alias("path"), (k * 1000).cast("double").alias("mtime"), text.alias("text"))
    known = spark.createDataFrame([(1, "Nordlicht", "energie"), (2, "Muster Bau", ""), (3, "Muster", "bau")], "kid int, korrespondent string, kategorie string")
    root = versions.shared_folder(spark, "index")
    batch.index_files(spark, root, files, _Clerk(), known)
    return search_index.documents(spark, root).drop("id")


@query
def xmp_packets(spark, d):
    """Every order as a file that holds its metadata: each 3rd with an older packet before the one that counts, each 5th with a dictionary, each 7th cut within its packet."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    o = table(spark, d, "orders")
    amount, year = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format(day, "yyyy")
    title = F.concat(F.lit("Auftrag <"), k.cast("string"), F.lit("> & Ö\U0001f600"))
    new = xmp.packet(title=title, subject=F.col("o_orderpriority"), description=F.when(k % 2 == 0, F.concat("o_orderstatus", F.lit("\n\"€\""))), keywords=F.lit("a, b"), betrag=amount, steuerjahr=year)
    old = F.when(k % 3 == 0, xmp.packet(title=F.lit("alt"), waehrung=F.lit("USD"))).otherwise("")
    entries = F.when(k % 5 == 0, xmp.dictionary(korrespondent=F.concat(F.lit("Ä-"), k.cast("string")), betrag=F.lit("0.01"))).otherwise("")
    content = F.concat(F.lit("%PDF-1.7\n"), old, F.lit("\n"), F.when(k % 7 == 0, F.substring(new, 1, 500)).otherwise(new), F.lit("\n"), entries, F.lit("\n%%EOF"))
    files = o.select(k.cast("string").alias("path"), F.encode(content, "UTF-8").alias("content"))
    return xmp.read(files)


@query
def copy_names(spark, d):
    p = table(spark, d, "part")
    source = F.concat(F.lit("/ziel/"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    k = F.col("p_partkey")
    copies = p.select(k, F.explode(F.when(k % 4 == 1, F.array(F.lit(1))).when(k % 4 == 2, F.array(F.lit(1), F.lit(2), F.lit(3))).when(k % 4 == 3, F.array(F.lit(2)))).alias("n"))
    existing = copies.select(F.concat(F.lit("/ziel/"), F.col("p_partkey").cast("string"), F.lit("_kopie"), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".pdf")).alias("path"))
    return filing.copy_plan(p.select(source.alias("source")), existing)


def _hybrid(spark, d):
    docs = tables.letters(spark, d).select("doc_id", "filename", F.get(T.categories(F.col("text")), F.lit(0)).alias("kind"), F.when(F.col("doc_id") % 2 == 0, F.date_format(F.get(T.dates(F.col("text")), F.lit(0)), "yyyy-MM-dd")).alias("day"))
    key = F.floor(F.col("doc_id") / 40).cast("string")
    name = F.when(F.col("doc_id") % 9 == 0, F.col("filename")).when(F.col("doc_id") % 13 == 0, F.concat(F.lit("ab/"), key)).otherwise(F.concat(F.lit("modell_"), key, F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise("")))
    model = docs.filter("doc_id % 3 = 0").select("doc_id", name.alias("name"), (F.col("doc_id") % 100 / 100).alias("confidence"))
    return docs, filing.hybrid_names(docs, model)


@query
def hybrid_filenames(spark, d):
    return _hybrid(spark, d)[1]


def _batch(spark, d):
    docs, names = _hybrid(spark, d)
    docs = docs.withColumn("folder", F.lit("/ein"))
    files = docs.filter("doc_id % 11 != 0").select(F.concat(F.lit("/ein/"), "filename").alias("path"))
    taken = docs.select(F.floor(F.col("doc_id") / 40).alias("k")).filter("k % 4 = 0").select(F.concat(F.lit("/ein/modell_"), F.col("k").cast("string"), F.lit(".pdf")).alias("path")).distinct()
    return filing.batch_renames(docs, names, files.unionByName(taken))


@query
def batch_rename(spark, d):
    return _batch(spark, d)


@query
def batch_outcome(spark, d):
    return _batch(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query
def model_gate(spark, d):
    best = table(spark, d, "customer").filter("c_custkey % 3 != 0").groupBy((F.col("c_custkey") % 40).alias("query")).agg(F.max(F.col("c_custkey") % 100 / 100).alias("top"))
    asked = table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("query")).distinct()
    return models.needs_model(best, asked)


QUERIES |= {
    "remove_invalid": _each_letter(name=lambda: T.without_invalid(F.concat(F.lit('a<b>:"/c'), F.col("filename"), F.lit("|?*\\d")))),
    "mtime_day": lambda spark, d: table(spark, d, "orders").select("o_orderkey", T.mtime_day(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400).alias("day")),
}
