"""Gated models, the journal of file actions, two-stage streams and logs of several generations."""

import collections
import os
import shutil
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmill.operators import gated, journal, store
from quillmill.streaming import stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this file


class Counting:
    """Writes down every prompt that it is asked."""

    def __init__(self, log, answer):
        self.log, self.answer = log, answer

    def is_available(self):
        return True

    def answers(self, prompts):
        with open(self.log, "a") as out:
            out.write("".join(f"{hash(p)}\n" for p in prompts))
        return [self.answer] * len(prompts)


def asked(path):
    return len(open(path).read().split()) if os.path.exists(path) else 0


FOLDERS = "pos int, name string, path string"
LOCAL = "query long, folder string, confidence double, reason string"


def test_gate_asks_only_who_needs_it(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Rechnung" if i < 6 else f"Text {i}", ["bank"], None) for i in range(8)] + [(9, None, None, "2024-01-02")], "query long, text string, keywords array<string>, day string")
    local = spark.createDataFrame([(0, "/a/Bank", 0.9, "nah"), (1, "/a/Bank", 0.5, "nah"), (2, "/a/Gas", 0.3, "nah"), (2, "/a/Bank", 0.2, "fern")], LOCAL)
    folders = spark.createDataFrame([(1, "Gas", "/a/Gas"), (0, "Bank", "/a/Bank"), (2, "Bank", "/b/Bank")], FOLDERS)
    log = str(tmp_path / "asked")
    model = Counting(log, "ORDNER: bank\nBEGRÜNDUNG: weil\nKONFIDENZ: 80")
    out = gated.suggest_folders(docs, local, folders, model)
    for _ in range(2):
        got = {(r["query"], r["rank"]): (r["folder"], round(r["confidence"], 6), r["reason"], r["source"]) for r in out.collect()}
    assert asked(log) == 4  # Rechnung, Text 6, Text 7 and the document without text; once each though the result was computed twice
    assert got[0, 1] == ("/a/Bank", 0.9, "nah", "local") and (0, 2) not in got
    assert got[1, 1] == ("/a/Bank", 0.62, "nah + LLM bestätigt", "hybrid")
    assert got[2, 1] == ("/a/Bank", 0.44, "fern + LLM bestätigt", "hybrid") and got[2, 2] == ("/a/Gas", 0.3, "nah", "local")
    assert got[9, 1] == ("/a/Bank", 0.8, "weil", "llm") and {q for q, _ in got} == {*range(8), 9}
    assert gated.suggest_folders(docs, local, folders, model, use_model=False).count() == 4 and asked(log) == 4
    assert gated.suggest_folders(docs, local, folders, Counting(log, "ORDNER: fremd"), use_model=True).count() == 4
    assert gated.suggest_folders(docs, local, folders.limit(0), model).count() == 4


class Disk:
    def __init__(self, stop_at=None):
        self.stop_at = stop_at

    def exists(self, path):
        return os.path.exists(path)

    def move(self, source, target):
        os.rename(source, target)
        with open(os.path.dirname(target) + "/.moves", "a") as out:
            out.write(source + "\n")
        if self.stop_at and source.endswith(self.stop_at):
            os._exit(1)  # the worker dies after the file was moved, before it could say so

    def copy(self, source, target):
        shutil.copy(source, target)

    def delete(self, path):
        os.remove(path)


ACTIONS = "seq long, kind string, source string, target string"


def test_journal_survives_a_crash(spark, tmp_path):
    root, there = f"file://{tmp_path}/journal", tmp_path / "files"
    there.mkdir()
    for i in range(12):
        (there / f"s{i}").write_text(str(i))
    (there / "taken").write_text("x")
    p = lambda n: str(there / n)
    rows = [(i, "move", p(f"s{i}"), p(f"t{i}")) for i in range(8)] + [(8, "copy", p("s8"), p("c8")), (9, "delete", p("s9"), None), (10, "move", p("nie"), p("t10")), (11, "move", p("s11"), p("taken")), (11, "move", p("s11"), p("taken"))]
    plan = journal.planned(spark.createDataFrame(rows, ACTIONS))
    with pytest.raises(Exception):
        journal.execute(spark, root, plan, Disk(stop_at="s3"))
    assert journal.outcomes(spark, root).count() == 0 and not (there / "s3").exists()
    journal.execute(spark, root, plan, Disk())
    got = {r["seq"]: (r["status"], r["error"]) for r in journal.outcomes(spark, root).collect()}
    assert {i: got[i][0] for i in range(10)} == {**dict.fromkeys(range(8), "renamed"), 8: "copied", 9: "deleted"}
    assert got[10] == ("error", f"Datei nicht gefunden: {p('nie')}") and got[11] == ("error", f"Ziel existiert: {p('taken')}")
    assert {r["status"]: r["n"] for r in journal.counted(spark, root).collect()} == {"renamed": 8, "copied": 1, "deleted": 1, "error": 2}
    moved = collections.Counter((there / ".moves").read_text().split())
    assert set(moved.values()) == {1} and len(moved) == 8
    journal.execute(spark, root, plan, Disk())  # nothing is left to do
    assert journal.outcomes(spark, root).count() == 12
    back = journal.undo_actions(spark, root, 3)
    assert [r["source"] for r in back.orderBy("seq").collect()] == [p("t7"), p("t6"), p("t5")]
    journal.execute(spark, root, journal.planned(back), Disk())
    assert all((there / f"s{i}").read_text() == str(i) for i in (5, 6, 7)) and (there / "t4").exists()


FILES = "path string, mtime long, text string, priority int"


def test_two_stages_give_each_file_one_row(spark, tmp_path, monkeypatch):
    root, inbox = f"file://{tmp_path}/out", str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, FILES).write.mode("append").parquet(inbox)
    put([("/x/a.pdf", 100, "Rechnung vom 3.2.24 Muster GmbH", 10), ("/x/b.pdf", 200, "Vertrag", 1), ("/x/weg.pdf", 1, "fort", 1), ("/x/leer.pdf", 5, None, 1)])
    stream = spark.readStream.schema(FILES).parquet(inbox)
    there = lambda df: df.filter("path != '/x/weg.pdf'")
    log = str(tmp_path / "asked")
    model = Counting(log, "DATEINAME: neu.pdf\nKONFIDENZ: 70")

    stages.start_analysis(stream, root, there).awaitTermination()
    inner = gated.asked_once

    def breaks(rows, provider):
        inner(rows, provider)
        raise OSError("killed between the stages")

    monkeypatch.setattr(gated, "asked_once", breaks)
    with pytest.raises(Exception):
        stages.start_answers(spark, root, model, there).awaitTermination()
    monkeypatch.undo()
    put([("/x/a.pdf", 150, "Rechnung neu", 1), ("/x/b.pdf", 200, "Vertrag", 1)])  # a changed file, and one that comes twice
    for _ in range(2):
        stages.start_analysis(stream, root, there).awaitTermination()
        stages.start_answers(spark, root, model, there).awaitTermination()
    got = {(r["path"], r["mtime"]): (r["keywords"], r["day"], r["name"], r["confidence"], r["error"]) for r in stages.results(spark, root).collect()}
    assert stages.results(spark, root).count() == len(got) == 4
    assert got["/x/a.pdf", 100] == (["rechnung"], "2024-02-03", "neu.pdf", 0.7, None) and got["/x/a.pdf", 150][2] == "neu.pdf"
    assert got["/x/b.pdf", 200][:1] == (["vertrag"],) and got["/x/leer.pdf", 5] == ([], None, None, None, "kein Text")


def test_analysis_takes_the_urgent_first(spark):
    rows = [("/c", 3, "x", 10), ("/b", 2, "x", 1), ("/a", 1, "x", 10), ("/d", 9, "x", 1)]
    assert [r["path"] for r in stages.analyse(spark.createDataFrame(rows, FILES)).collect()] == ["/b", "/d", "/a", "/c"]


def test_logs_of_three_generations(spark, tmp_path):
    paths = [str(tmp_path / f"g{i}") for i in range(3)]
    spark.createDataFrame([(1, "/a")], "id int, target_folder string").write.parquet(paths[0])
    spark.createDataFrame([(2, "/a", "A/b", "7")], "id long, target_folder string, target_relative_path string, confidence string").write.parquet(paths[1])
    spark.createDataFrame([("x", "/b", 0.5, 3)], "extra string, TARGET_FOLDER string, confidence double, id long").write.parquet(paths[2])
    schema = "id long, target_folder string, target_relative_path string, confidence double"
    got = store.read_generations(spark, paths, schema)
    assert got.schema.simpleString() == "struct<id:bigint,target_folder:string,target_relative_path:string,confidence:double>"
    assert sorted(tuple(r) for r in got.collect()) == [(1, "/a", None, None), (2, "/a", "A/b", 7.0), (3, "/b", None, 0.5)]
    assert got.groupBy("target_folder").count().filter("count = 2").count() == 1
    assert store.read_generations(spark, [], schema).count() == 0 and got.filter(F.col("id").isNull()).count() == 0
