"""Models behind the interface: null prompts, failing calls, models that aren't available."""

from quillmill.operators import models, subfolders


def test_answers(spark):
    class Failing(models.Stub):
        def answers(self, prompts):
            if any("schlecht" in p for p in prompts):
                raise RuntimeError("no answer")
            return models.Stub.answers(self, prompts)

    class Absent(models.Stub):
        def is_available(self):
            return False

    docs = spark.createDataFrame([(1, "gut"), (2, None), (3, "schlecht"), (4, ""), (2**53 + 1, "gut"), (None, "gut")], "id long, p string").coalesce(1)
    said = {r["id"]: r["answer"] for r in models.answered(docs, "p", Failing(), batch=1).collect()}
    assert said[1].startswith("DATEINAME: dokument_") and said[1].endswith("KONFIDENZ: 80")
    assert said[2] is None and said[3] is None and said[4] is not None and 2**53 + 1 in said
    assert [r["answer"] for r in models.answered(docs, "p", Absent()).collect()] == [None] * 6
    assert models.answered(docs.limit(0), "p", models.Stub()).collect() == []


def test_owner_section():
    assert models.owner_section("", "x", "y") == ""
    assert models.owner_section("A", " b ,, ", "C") == 'Besitzer der Dokumente, nie der Korrespondent: "A", "b", "C"\n'


def test_subfolders_resolve_by_name_and_skip_dots(spark):
    parents = spark.createDataFrame([("/a",), ("/leer",)], "parent string")
    stats = spark.createDataFrame([("/a/weg", 9), ("/a/Rechnung", 100), ("/b/x", 50)], "path string, usage_count long")
    folders = spark.createDataFrame([("/a",), ("/neu/rechnung",), ("/a/.git",), ("/a/k",), ("/a/l",), ("/a/m",)], "path string")
    got = sorted(subfolders.for_parents(parents, stats, folders).collect(), key=lambda r: r["place"])
    assert [(r["parent"], r["folder"], r["confidence"], r["place"]) for r in got] == [("/a", "/neu/rechnung", 0.8, 1), ("/a", "/a/k", 0.2, 2), ("/a", "/a/l", 0.2, 3)]
