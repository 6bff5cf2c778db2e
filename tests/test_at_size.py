"""What shows only with several files, many rows or skew: ties, and work that must not grow faster than the input."""

import datetime
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import model_store, search_index, similarity
from quillmill.plans.oracles import ORACLES
from quillmill.plans.queries import QUERIES
from quillmill.sources import versions


def test_of_equal_numbers_the_first_in_the_table_stays(spark, tmp_path):
    os.makedirs(tmp_path / "lineitem.parquet")
    day = datetime.datetime(2024, 5, 6)
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3], "o_orderdate": [day] * 3, "o_orderpriority": ["a", "b", "c"]}), tmp_path / "orders.parquet")
    row = lambda k, n, flag: {"l_orderkey": k, "l_linenumber": n, "l_returnflag": flag}
    parts = [[row(1, 2, "N"), row(2, 1, "A"), row(1, 2, "R")], [row(1, 2, "R"), row(1, 1, "A"), row(2, 1, "R")] + [row(k, 7, "R") for k in range(10, 5000)]]
    for i, rows in enumerate(parts):  # Spark reads the larger file first
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    got = {r["path"]: (r["answer"], r["seq"]) for r in QUERIES["cache_replace"](spark, str(tmp_path)).filter("path < 10").collect()}
    assert got == {1: ("N", 2), 2: ("A", 1), 3: ("c", 0)}


def test_a_row_without_answer_takes_none_away(spark, tmp_path):
    """SQL's arg_max passes over rows that lack either value, its max doesn't."""
    day = datetime.datetime(2024, 5, 6)
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3, 4, 5], "o_orderdate": [day] * 5, "o_orderpriority": list("abcde")}), tmp_path / "orders.parquet")
    rows = [(1, 1, "N"), (1, 2, None), (2, 1, None), (3, None, "A"), (3, None, "R"), (4, 5, "A"), (4, None, "R"), (4, 5, "N")]
    lines = {"l_orderkey": [r[0] for r in rows], "l_linenumber": pa.array([r[1] for r in rows], pa.int32()), "l_returnflag": [r[2] for r in rows]}
    pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet")
    got = {r["path"]: (r["answer"], r["seq"]) for r in QUERIES["cache_replace"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute("SET threads = 1")
        for name in ("orders", "lineitem"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        want = {path: (answer, seq) for path, answer, seq in db.execute(ORACLES["cache_replace"]).fetchall()}
    assert got == want == {1: ("N", 2), 2: (None, 1), 3: (None, None), 4: ("A", 5), 5: ("e", 0)}


def planned(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_terms_are_counted_within_their_row(spark):
    docs = spark.createDataFrame([(1, "konto bank konto bank"), (2, ""), (3, None), (4, "strom")], "doc_id long, text string")
    counted = similarity.terms(docs)
    assert "Exchange" not in planned(spark, counted)
    assert sorted(map(tuple, counted.collect())) == [(1, "bank", 2), (1, "bank konto", 1), (1, "konto", 2), (1, "konto bank", 2), (4, "strom", 1)]
    twice = similarity.terms(docs.union(spark.createDataFrame([(1, "bank gas")], docs.schema)))
    assert sorted(map(tuple, twice.filter("id = 1").collect())) == [(1, "bank", 3), (1, "bank gas", 1), (1, "bank konto", 1), (1, "gas", 1), (1, "konto", 2), (1, "konto bank", 2)]


def test_a_vector_is_joined_once_for_each_set_of_queries(spark, monkeypatch):
    """Below the threshold where candidates pay, many blocks of queries meet a vector that was shuffled once."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "CHUNK", 20)
    monkeypatch.setattr(similarity, "candidates", lambda *_: 1 / 0)
    rng = np.random.default_rng(3)
    rows = [(i, sorted(rng.choice(30, 6, replace=False).tolist()), rng.random(6).tolist()) for i in range(70)] + [(70, [], [])]
    v = spark.createDataFrame(rows, "id long, nos array<int>, ws array<double>")
    got = {(r["query"], r["id"]): r["similarity"] for r in similarity.cosine(v.filter("id % 5 = 0"), v, 0.1).collect()}
    of = [dict(zip(nos, ws)) for _, nos, ws in rows]
    want = {(i, j): s for i in range(0, 71, 5) for j in range(71) if (s := sum(w * of[j].get(t, 0) for t, w in of[i].items())) > 0.1}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_vectors_meet_without_a_shuffle(spark, monkeypatch):
    """Neither queries nor vectors are shuffled once for each pack that they meet, whether the packs are joined as a product or by a broadcast."""
    monkeypatch.setattr(similarity, "CHUNK", 20)
    monkeypatch.setattr(similarity, "SET", 4)
    rng = np.random.default_rng(5)
    rows = [(i, sorted(rng.choice(30, 6, replace=False).tolist()), rng.random(6).tolist()) for i in range(70)]
    v = spark.createDataFrame(rows, "id long, nos array<int>, ws array<double>")
    of = [dict(zip(nos, ws)) for _, nos, ws in rows]
    want = {(i, j): s for i in range(0, 70, 5) for j in range(70) if (s := sum(w * of[j].get(t, 0) for t, w in of[i].items())) > 0.1}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most, kind in ((before, "NestedLoop"), ("-1", "CartesianProduct")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            met = similarity.cosine(v.filter("id % 5 = 0"), v, 0.1)
            assert "hashpartitioning" not in planned(spark, met) and kind in planned(spark, met)
            got = {(r["query"], r["id"]): r["similarity"] for r in met.collect()}
            assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_vector_is_made_within_its_row(spark):
    docs = spark.createDataFrame([(1, "konto bank konto bank"), (2, ""), (3, None), (4, "strom"), (5, "konto bank konto bank"), (6, "gas nichts")], "id long, text string")
    listed, counted = similarity.tokens(docs, "id"), similarity.terms(docs, "id")
    model = similarity.fit(counted.filter("term != 'gas' AND term != 'nichts' AND term != 'gas nichts'"))
    made = similarity.row_vectors(listed, model)
    assert "Exchange" not in planned(spark, made)
    got, want = ({r["id"]: (r["nos"], [round(w, 12) for w in r["ws"]]) for r in df.collect()} for df in (made, similarity.vectors(counted, model)))
    assert got == want and got.keys() == {1, 4, 5}
    tids = {r["id"]: r["tid"] for r in made.collect()}
    assert tids[1] == tids[5] != tids[4]


def test_only_terms_that_can_be_common_are_added_up(spark, tmp_path, monkeypatch):
    """The sum over batches, not the order within one, decides; and few terms leave their task when a model is read."""
    root = f"file://{tmp_path}/model"
    for k in range(2):  # `immer` leads no batch
        said = " ".join(["immer"] * 6 + [f"mal{k}"] * 9 + [f"selten{k}{i}" for i in range(40)])
        model_store.learn(spark, root, spark.createDataFrame([(k, said)], "id long, text string"))
    joined = []
    monkeypatch.setattr(model_store.F, "broadcast", lambda df: joined.append(df.count()) or df)
    some = {r["term"]: r["total"] for r in model_store.load(spark, root, 3)[0].collect()}
    monkeypatch.undo()
    assert some == {"immer": 12, "immer immer": 10, "mal0": 9} and joined and joined[0] < 10
    monkeypatch.setattr(model_store, "FEW", 0)
    assert some == {r["term"]: r["total"] for r in model_store.load(spark, root, 3)[0].collect()}


def test_postings_are_grouped_within_their_row(spark):
    words = spark.createDataFrame([(1, 4, ["b", "a", "b"], ["b"]), (2, 0, [], [])], "id long, length long, t0 array<string>, t1 array<string>")
    grouped = search_index._positions(words, ["text", "about"])
    assert "Exchange" not in planned(spark, grouped)
    got = {r["id"]: [(x["token"], x["col"], x["positions"]) for x in r["runs"] or []] for r in grouped.collect()}
    assert got == {1: [("a", "text", [1]), ("b", "about", [0]), ("b", "text", [0, 2])], 2: []}


def test_a_name_is_made_once(spark):
    letters = spark.createDataFrame([("Rechnung von Muster Bau GmbH am 1.2.2024", "a.pdf"), (None, "2024-05-06_x.pdf")], "text string, filename string")
    named = letters.select(T.with_pdf(T.suggested_name(F.col("text"), F.col("filename"))).alias("name"))
    assert planned(spark, named).split("== Physical Plan ==")[-1].count("|OHG|") == 1
    assert [r["name"] for r in named.collect()] == ["Rechnung Muster Bau 2024-02.pdf", "2024-05-06 Dokument.pdf"]


def test_postings_of_a_larger_change_take_more_tasks(spark, tmp_path, monkeypatch):
    """The tasks on both sides of the postings' shuffle grow in number with the words, so that what one holds doesn't."""
    root, before = f"file://{tmp_path}/index", spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = spark.createDataFrame([(i, f"immer nr {i} wort{i % 7}", "") for i in range(400)], "id long, text string, about string")
    monkeypatch.setattr(search_index, "WORDS", 300)
    search_index.upsert(spark, root, docs.filter("id < 300"), "id", ["text", "about"])
    search_index.upsert(spark, root, docs.filter("id >= 200"), "id", ["text", "about"])
    for merged in (False, True):
        if merged:
            search_index.merge(spark, root, everything=True)
        for s in versions.latest(spark, root)[1]["segments"]:
            files = spark.read.parquet(f"{s['path']}/postings").groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).alias("task")).count().collect()
            assert len(files) >= s["length"] / 300 / 2 and max(r["count"] for r in files) < 600
        assert len(search_index.find(spark, root, "immer", limit=1000).collect()) == 400
        assert {r["id"] for r in search_index.find(spark, root, "wort3 250").collect()} == ({250} if 250 % 7 == 3 else set())
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_a_merge_plan_is_made_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    rows = [{"l_orderkey": k, "l_linenumber": n} for k in range(100) for n in range(1, k % 4 + 2)]
    pq.write_table(pa.Table.from_pylist(rows + rows[:30]), tmp_path / "lineitem.parquet")
    monkeypatch.setattr("quillmill.plans.queries.MERGED", 20)
    plan = QUERIES["merge_plan"](spark, str(tmp_path))
    assert set(re.findall(r"hashpartitioning\([^,]+, (\d+)\)", planned(spark, plan))) == {str(-(-(len(rows) + 30) // 20))}
    want = {(k, f"{k}-{n}", page, 2 * (k % 4 + 1 - n) + page) for k in range(100) for n in range(1, k % 4 + 2) for page in (1, 2)}
    assert sorted(map(tuple, plan.collect())) == sorted(want)


def test_a_date_is_split_once(spark):
    texts = spark.createDataFrame([("am 1.2.2024, 03/04/51, 2023-12-31, 31.2.2020 und 1.1.1950",), ("",), (None,)], "text string")
    found = texts.select(T.numeric_dates(F.col("text")).alias("days"))
    assert planned(spark, found).split("== Physical Plan ==")[-1].count("[./-]") == 1
    assert [[str(d) for d in r["days"]] for r in found.collect()] == [["2024-02-01", "2023-12-31"], [], []]


def test_rows_of_unique_ids_are_indexed_without_grouping(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"Größe {i}", None) for i in range(30)], "id long, text string, about string")
    given, change = [], search_index._change
    monkeypatch.setattr(search_index, "_change", lambda s, root, docs, *rest: given.append(planned(s, docs)) or change(s, root, docs, *rest))
    for unique in (True, False):
        search_index.upsert(spark, f"file://{tmp_path}/{unique}", docs, "id", ["text", "about"], unique=unique)
    assert "Exchange" not in given[0] and "Exchange" in given[1]
    one, two = (sorted(map(tuple, search_index.documents(spark, f"file://{tmp_path}/{u}").collect())) for u in (True, False))
    assert one == two and one[3] == (3, "Größe 3", "")
    assert search_index.find(spark, f"file://{tmp_path}/True", "grosse 7").count() == search_index.find(spark, f"file://{tmp_path}/False", "grosse 7").count()
