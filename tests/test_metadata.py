"""Metadata, settings, PDF readers, snippets and folder answers on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import filing, metadata, search
from quillmill.sources import pdf


def test_precedence(spark):
    fields = ["korrespondent", "betrag", "subject"]
    kind = "id long, korrespondent string, betrag string, subject string"
    analysis = spark.createDataFrame([(1, "A", "1", "x"), (2, None, "2", ""), (3, "B", None, "z"), (4, "A", "4", "w")], kind)
    model = spark.createDataFrame([(2, "A", "", "m"), (3, None, "30", None)], kind)
    stored = spark.createDataFrame([(4, "S", None, None), (1, "", "", "")], kind)
    learned = spark.createDataFrame([("A", "99", None)], "korrespondent string, betrag string, subject string")
    got = {r["id"]: tuple(r)[1:] for r in metadata.precedence(analysis, model, learned, stored, "id", fields).collect()}
    assert got == {1: ("A", "99", "x", "merged"), 2: ("A", "99", "m", "merged"), 3: ("B", "30", "z", "merged"), 4: ("S", None, None, "stored")}


def test_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", "Titel", ""), ("b.pdf", "", None)], "path string, title string, betrag string")
    metadata.write_sidecars(rows, str(tmp_path / "side"))
    got = metadata.read_sidecars(spark, str(tmp_path / "side")).collect()
    assert [(r["path"], r["title"], r["betrag"]) for r in got] == [("a.pdf", "Titel", None)]


def test_settings(spark):
    changes = spark.createDataFrame([(1, "theme", "light"), (2, "theme", "dark"), (3, "language", "de")], "seq long, key string, value string")
    assert {r["key"]: r["value"] for r in metadata.settings(changes).collect()} == {"theme": "dark", "language": "de"}
    folders = spark.createDataFrame([(1, "a", "add"), (2, "b", "add"), (3, "a", "add"), (4, "b", "remove"), (5, "c", "remove"), (6, "b", "add")], "seq long, folder string, action string")
    assert {r["folder"]: r["since"] for r in metadata.folder_list(folders).collect()} == {"a": 1, "b": 6}


def test_match_answers(spark):
    folders = spark.createDataFrame([(0, "Strom und Gas"), (1, "bank"), (2, "Bank"), (3, "Gas")], "pos int, name string")
    asked = spark.createDataFrame([(1, "Bank"), (2, "BANK"), (3, "gas und wasser"), (4, "strom"), (5, "nichts"), (6, None)], "id long, answer string")
    got = {r["id"]: (r["folder"], r["how"]) for r in filing.match_answers(asked, folders).collect()}
    assert got == {1: ("Bank", "exact"), 2: ("bank", "case"), 3: ("Gas", "part"), 4: ("Strom und Gas", "part"), 5: (None, None), 6: (None, None)}


@pytest.mark.parametrize("text, query, want", [
    ("eins zwei drei vier", "drei", "eins zwei >>>drei<<< vier"), ("a b c d e f g h", "f", "...d e >>>f<<< g..."), ("Müllers Haus", "muller", ">>>Müllers<<< Haus"), ("a b c d e", "x", "a b c d..."), (None, "x", ""),
])
def test_snippet(spark, text, query, want):
    row = spark.createDataFrame([(text,)], "x string").select(search.snippet(F.col("x"), query, 4).alias("y"))
    assert row.first()["y"] == want


def test_pdf_readers(spark):
    files = spark.createDataFrame([("/x/a.pdf", 3, bytearray(b"a|b")), ("/x/b.pdf", 1, bytearray(b" ")), ("/x/c.pdf", 0, None), ("/x/d.pdf", 2, bytearray(b"!!"))], "path string, length long, content binary")

    def pages(content):
        if content == b"!!":
            raise ValueError
        return content.decode().split("|")

    got = {r["path"]: (r["text"], r["by_ocr"]) for r in pdf.texts(files, pages, lambda content, n: f"read {n}").collect()}
    assert got == {"/x/a.pdf": ("a\nb", False), "/x/b.pdf": ("read 5", True), "/x/c.pdf": ("", False), "/x/d.pdf": ("read 5", True)}
    told = {r["filename"]: (r["title"], r["page_count"], r["file_size"]) for r in pdf.information(files, lambda c: {"title": "T", "page_count": len(pages(c))}).collect()}
    assert told == {"a.pdf": ("T", "2", 3), "b.pdf": ("T", "1", 1), "c.pdf": (None, None, 0), "d.pdf": (None, None, 2)}


def test_with_learned(spark):
    docs = spark.createDataFrame([(1, "A", "own"), (2, "B", "own"), (3, None, "own")], "id long, korrespondent string, kategorie string")
    learned = spark.createDataFrame([("A", "learned"), ("B", "")], "korrespondent string, kategorie string")
    assert {r["id"]: r["kategorie"] for r in metadata.with_learned(docs, learned, "korrespondent", ["kategorie"]).collect()} == {1: "learned", 2: "own", 3: "own"}
