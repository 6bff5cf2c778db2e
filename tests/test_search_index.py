"""The stored index against the search without one, after inserts, replacements, deletions, merges and torn writes."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import search, search_index
from quillmill.sources import versions

DOCS = "id long, title string, text string"


@pytest.fixture
def root(spark, tmp_path):
    return f"file://{tmp_path}/index"


def ranks(df):
    return [(r["id"], round(r["rank"], 9)) for r in df.collect()]


def same(spark, root, docs, *queries):
    for q in queries:
        assert ranks(search_index.find(spark, root, q)) == ranks(search.search(spark.createDataFrame(docs, DOCS), "id", ["title", "text"], q, least=2)), q


def test_folding_is_one_rule(spark):
    rows = [(1, "Dvořák", "Łódź źle"), (2, "Müller", "Müller"), (3, "Čapek İstanbul", "ế ß ø"), (4, None, "")]
    df = spark.createDataFrame(rows, DOCS)
    for query, want in (("Dvořák", [1]), ("dvorak", [1]), ("Łódź", [1]), ("Müller", [2]), ("Müller", [2]), ("muller", [2]), ("capek", [3]), ("istan", [3]), ("e", [3]), ("ß", [3]), ("lodz", [])):
        assert [r["id"] for r in search.search(df, "id", ["title", "text"], query).collect()] == want, query
    for word in ("Dvořák", "ŁÓDŹ", "Müller", "Ångström", "İstanbul"):
        assert spark.range(1).select(T.folded_tokens(F.lit(word))).first()[0] == [T.folded(word)]


def test_index_equals_search(spark, root):
    docs = {i: (i, f"Akte {i}", " ".join(f"w{j * i % 11} Bank-Konto Müller" for j in range(i % 5))) for i in range(40)}
    words = ["w1 konto", "bank-kon", "muller w3", "akte 1"]
    same(spark, root + "0", [], "a", "", '"')

    def put(rows):
        docs.update({r[0]: r for r in rows})
        search_index.upsert(spark, root, spark.createDataFrame(rows, DOCS), "id", ["title", "text"])
        same(spark, root, list(docs.values()), *words)

    put(list(docs.values()))
    put([(i, "neu", f"w1 Rechnung {i}") for i in range(5, 12)] + [(100, None, "w1 konto")])
    gone = [(1,), (7,), (100,), (12345,)]
    search_index.delete(spark, root, spark.createDataFrame(gone, "id long"))
    for (i,) in gone:
        docs.pop(i, None)
    same(spark, root, list(docs.values()), *words)
    assert search_index.count(spark, root) == len(docs)
    put([(7, "wieder da", "w1")])
    before = len(versions.latest(spark, root)[1]["segments"])
    search_index.merge(spark, root, factor=1)
    assert 1 < len(versions.latest(spark, root)[1]["segments"]) < before
    same(spark, root, list(docs.values()), *words)
    put([(5, "noch einmal", "konto w1"), (7, "", "")])
    search_index.merge(spark, root, everything=True)
    assert len(versions.latest(spark, root)[1]["segments"]) == 1
    same(spark, root, list(docs.values()), *words)
    found = search_index.results(spark, root, "konto w1", "text").collect()
    assert [r["id"] for r in found] == [i for i, _ in ranks(search_index.find(spark, root, "konto w1"))]
    assert ">>>" in found[0]["snippet"] and found[0]["title"] == docs[found[0]["id"]][1]


def test_query_reads_only_its_folders(spark, root):
    search_index.upsert(spark, root, spark.createDataFrame([(i, f"Titel {i}", f"wort{i} anderes") for i in range(20)], DOCS), "id", ["text"], ["title"])
    plan = search_index.find(spark, root, "wort1")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(lead" in plan.replace("PartitionFilters: [isnotnull(lead#", "PartitionFilters: [isnotnull(lead#") and "StartsWith(token,wort1)" in plan
    assert "/docs" not in plan


def test_latest_of_one_change(spark, root):
    rows = spark.createDataFrame([(1, 1, "alt"), (1, 3, "neu"), (1, 2, "mitte"), (None, 9, "ohne")], "id long, seq long, text string")
    search_index.upsert(spark, root, rows, "id", ["text"], newest=[-F.col("seq")])
    assert [ranks(search_index.find(spark, root, q)) != [] for q in ("neu", "alt", "mitte", "ohne")] == [True, False, False, False]


def test_empty_and_torn(spark, root):
    assert search_index.find(spark, root, "wort").collect() == [] and search_index.count(spark, root) == 0
    search_index.upsert(spark, root, spark.createDataFrame([], DOCS), "id", ["title", "text"])
    assert search_index.find(spark, root, "wort").collect() == []
    search_index.upsert(spark, root, spark.createDataFrame([(1, "wort", "")], DOCS), "id", ["title", "text"])
    number, state = versions.latest(spark, root)
    spark.createDataFrame([(2, "wort", "")], DOCS).write.parquet(versions.new_part(root))  # a part that no version lists
    fs, path = versions._at(spark, f"{root}/versions/_half")
    fs.create(path, False).close()
    assert versions.latest(spark, root) == (number, state) and ranks(search_index.find(spark, root, "wort"))
    with pytest.raises(RuntimeError):
        versions.commit(spark, root, number - 1, {})
    with pytest.raises(ValueError):
        search_index.upsert(spark, root, spark.createDataFrame([(2, "x", "y")], DOCS), "id", ["text"])


def test_snippet_takes_the_best_window(spark):
    said = "konto " + "a " * 40 + "konto bank " + "b " * 40
    show = lambda text, q, n=6: spark.createDataFrame([(text,)], "t string").select(search.snippet(F.col("t"), q, n)).first()[0]
    assert show(said, "bank konto") == "...a a a >>>konto<<< >>>bank<<< b..."
    assert show(said, "konto") == ">>>konto<<< a a a a a..."
    assert show("eins zwei", "drei") == "eins zwei" and show(None, "x") == "" and show("a b c d e f g h konto", "konto") == "...d e f g h >>>konto<<<".replace("d e f g h", "f g h")
