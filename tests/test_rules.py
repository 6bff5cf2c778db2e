"""Rules on literal cases, search ranks, and the stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import filing, search, similarity
from quillmill.streaming import indexing


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, want", [
    ("Rechnung vom 15.01.2025, fällig 3.2.24", ["2025-01-15", "2024-02-03"]), ("1/12/98 und 01/12/1989", ["1998-12-01"]), ("2024-02-31 und 2024-2-9", ["2024-02-09"]),
    ("15. Januar 2025; 4. MÄRZ 1985; 1.Mai2020", ["2025-01-15", "2020-05-01", "1985-03-04"]), ("115.01.2025", ["2025-01-15"]), ("1.1.49 2.2.50 3.3.95", ["2049-01-01", "1995-03-03"]),
    ("70.23.22.57", []), ("12.05.202", []), ("kein Datum", []), ("", []),
])
def test_dates(spark, text, want):
    assert one(spark, text, T.dates) == [datetime.date.fromisoformat(x) for x in want]


@pytest.mark.parametrize("text, want", [("Abrechnung der Datenbank", ["rechnung", "bank"]), ("Police", ["versicherung"]), ("Gehaltsabrechnung netto", ["rechnung", "gehalt"]), ("nichts", [])])
def test_categories(spark, text, want):
    assert one(spark, text, T.categories) == want


@pytest.mark.parametrize("name, want", [("Müller & Söhne: Rechnung 1/2", "Mueller_&_Soehne__Rechnung_1_2.pdf"), ("Größe.PDF", "Groesse.PDF"), ("a" * 90 + ".pdf", "a" * 80 + ".pdf"), ("x?y", "x_y.pdf")])
def test_sanitised(spark, name, want):
    assert one(spark, name, T.sanitised) == want


@pytest.mark.parametrize("n, want", [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (1048576, "1.0 MB"), (5 * 1024**4, "5.0 TB")])
def test_human_size(spark, n, want):
    assert spark.createDataFrame([(n,)], "x long").select(T.human_size(F.col("x")).alias("y")).first()["y"] == want


def test_answer(spark):
    answer = "DATEINAME: a b.pdf\nKONFIDENZ: 85%\nKATEGORIE: Rechnung\nBETRAG: UNBEKANNT\nSTEUERJAHR: 2024"
    assert one(spark, answer, T.answer_metadata) == {"subject": "Rechnung", "steuerjahr": "2024"}
    assert one(spark, answer, T.answer_confidence) == 0.85
    assert one(spark, "KONFIDENZ: hoch", T.answer_confidence) == 0.5
    assert one(spark, "nichts", T.answer_confidence) == 0.0


def test_tfidf_scores(spark):
    training = spark.createDataFrame([(1, "konto iban bank konto", "Bank"), (2, "bank überweisung iban", "Bank"), (3, "strom verbrauch kwh strom", "Strom"), (4, "strom rechnung konto", "Strom")], "doc_id long, text string, folder string")
    counted = similarity.terms(training)
    model = similarity.fit(counted)
    assert model.count() == 18
    asked = similarity.vectors(similarity.terms(spark.createDataFrame([(9, "konto bank strom")], "doc_id long, text string")), model)
    similar = similarity.cosine(asked, similarity.vectors(counted, model))
    assert {r["id"]: round(r["similarity"], 6) for r in similar.collect()} == {1: 0.526405, 2: 0.220977, 3: 0.332726, 4: 0.441953}
    rows = similarity.vectors(counted, model).join(training.select(F.col("doc_id").alias("id"), "folder"), "id")
    rows = rows.select("id", F.col("id").cast("string").alias("text"), "folder", F.lit(1).cast("long").alias("n"), F.col("id").alias("first"), F.lit((1 << 63) - 1).alias("second"), "nos", "ws")
    found = similarity.folder_scores(asked.select("id", F.lit("9").alias("text"), F.lit("neu").alias("own"), "nos", "ws"), rows)
    assert [(r["folder"], round(r["score"], 6), r["first"]) for r in found.orderBy("folder").collect()] == [("Bank", 0.480591, 1), ("Strom", 0.425569, 3)]


ROWS = [(1, "/x/Müller-Rechnung.pdf", "Rechnung Strom", "Die Rechnung der Stadtwerke München 2024"), (2, "/x/b.pdf", "Vertrag", "Rechnungsnummer 12 und Rechnung 13 foo-bar baz"), (3, "/x/c.pdf", "Bank", "Kontoauszug muller"), (4, "/x/d.pdf", "x", "straße Strasse nichts"), (5, "/x/e.pdf", "y", "leer")]


@pytest.mark.parametrize("query, want", [
    ("rechn", [(1, -0.4842684527), (2, -0.4128822665)]), ("Müller", [(3, -0.3810053267), (1, -0.2862802455)]), ("rechnung strom", [(1, -1.4189993502)]),
    ("foo-b", [(2, -0.9347308975)]), ("strasse", [(4, -1.1789985537)]), ("-", []), ("- rechn", []), ('a"b', []), (" ", []),
])
def test_search(spark, query, want):
    docs = spark.createDataFrame(ROWS, "doc_id long, a string, b string, c string")
    got = search.search(docs, "doc_id", ["a", "b", "c"], query).collect()
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert [r["rank"] for r in got] == pytest.approx([x for _, x in want], abs=1e-9)


def test_unique_paths(spark):
    moves = spark.createDataFrame([("s1", "a.pdf"), ("s2", "a.pdf"), ("s3", "b.pdf")], "source string, target string")
    got = filing.unique_paths(moves, spark.createDataFrame([("a.pdf",)], "path string"))
    assert {r["source"]: r["target"] for r in got.collect()} == {"s1": "a (1).pdf", "s2": "a (2).pdf", "s3": "b.pdf"}


def test_unique_paths_pass_over_numbered_names(spark):
    moves = [(f"s{i:02}", t) for i, t in enumerate(["a.pdf", "a.pdf", "a.pdf", "b.pdf", "b.pdf", "b (1).pdf", "/x.y/c", "/x.y/c", "b (1).pdf", "d.pdf", "d.pdf"])]
    files = ["a.pdf", "a (1).pdf", "a (3).pdf", "b (2).pdf", "d (1).pdf"]
    got = filing.unique_paths(spark.createDataFrame(moves, "source string, target string"), spark.createDataFrame([(f,) for f in files], "path string"))
    got = {r["source"]: r["target"] for r in got.collect()}
    assert [got[s] for s, _ in moves] == ["a (2).pdf", "a (4).pdf", "a (5).pdf", "b.pdf", "b (3).pdf", "b (1).pdf", "/x.y/c", "/x.y/c (1)", "b (1) (1).pdf", "d.pdf", "d (2).pdf"]


def test_learned_names_rank_first(spark):
    docs = spark.createDataFrame([(1, "scan 123.pdf", "Rechnung Nr 123 vom 3.2.2024")], "doc_id long, filename string, text string")
    learned = spark.createDataFrame([(1, f"gelernt {i}.pdf", i) for i in range(5)] + [(2, "fremd.pdf", 0)], "doc_id long, name string, place int")
    rules = [r["name"] for r in filing.rename_candidates(docs).orderBy("rank").collect()]
    got = [(r["name"], r["confidence"]) for r in filing.rename_candidates(docs, 6, learned).orderBy("rank").collect()]
    assert got[:3] == [(f"gelernt {i}.pdf", 0.7) for i in range(3)] and [n for n, _ in got[3:]] == rules[:3]


def test_stream_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Rechnung vom 3.2.24 Muster GmbH"), (2, None)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        indexing.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["doc_id"]: (r["keywords"], str(r["newest"]), r["company"]) for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/*")).collect()}
    assert got[1] == ("rechnung", "2024-02-03", "Muster")
    assert 2 in got
