"""Containment joins and folders below roots, against brute force."""

import itertools
import random
from pathlib import PurePosixPath as Path

from pyspark.sql import functions as F

from quillmill.operators import containment, filing, roots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_match_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    known = [(i, word(rng.choice([1, 2, 3, 4, 5, 7, 9]))) for i in range(60)] + [(60, ""), (61, "gmbh und co"), (62, "gmbh und co")]
    asked = [word(rng.choice([1, 2, 4, 5, 6, 10, 14])) for _ in range(80)] + ["", "die gmbh und co kg", "mbh un", "zzz", None]
    want = {}
    for a in asked:
        found = [i for i, k in known if a and k and (a in k or k in a)]
        if found:
            want[a] = min(found)
    got = containment.first_match(spark.createDataFrame([(a,) for a in asked], "text string"), spark.createDataFrame(known, "pos int, name string"))
    assert {r["text"]: r["pos"] for r in got.collect()} == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_correspondents(spark):
    known = spark.createDataFrame([(1, "ista"), (2, "Stadtwerke München"), (3, "ISTA"), (4, "")], "kid long, korrespondent string")
    names = ["ista", " ista ", "Ista", "ista GmbH", "münchen", "", "   ", None, "xyz", "ISTA"]
    got = filing.lookup_correspondent(spark.createDataFrame([(n,) for n in names], "name string"), known)
    assert {r["name"]: (r["kid"], r["how"]) for r in got.collect()} == {"ista": (1, "exact"), " ista ": (1, "exact"), "ISTA": (3, "exact"), "Ista": (1, "fuzzy"), "ista GmbH": (1, "fuzzy"), "münchen": (2, "fuzzy")}
    assert "NestedLoop" not in plan(got)


def test_answers_give_the_path(spark):
    folders = spark.createDataFrame([(0, "Bank", "/a/Bank"), (1, "Steuer 2024", "/a/Steuer 2024"), (2, "steuer", "/b/steuer"), (3, "Bank", "/b/Bank")], "pos int, name string, path string")
    answers = [(1, "Bank"), (2, "BANK"), (3, "Steuer"), (4, "2024"), (5, "Die Bank AG"), (6, ""), (7, None), (8, " "), (9, "Gas")]
    got = filing.match_answers(spark.createDataFrame(answers, "id long, answer string"), folders)
    assert {r["id"]: (r["folder"], r["how"], r["path"]) for r in got.collect()} == {
        1: ("Bank", "exact", "/a/Bank"), 2: ("Bank", "case", "/a/Bank"), 3: ("steuer", "case", "/b/steuer"), 4: ("Steuer 2024", "part", "/a/Steuer 2024"), 5: ("Bank", "part", "/a/Bank"),
        **{i: (None, None, None) for i in (6, 7, 8, 9)},
    }


def test_relative_paths(spark):
    tops = ["/akten/Steuer", "/akten", "/akten/Bank/", "/x//y"]
    paths = ["/akten/Steuer/2024/Banken", "/akten/Steuer", "/akten/Steuerung/a", "/akten", "/akten/Bank/Giro", "/x/y/z", "/x/y/", "/x", "/fremd/ort", "/akten//Steuer/", "/"]
    df, known = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(list(enumerate(tops)), "pos int, root string")

    def below(p, top):
        try:
            return str(Path(p).relative_to(Path(top)))
        except ValueError:
            return None

    def relative(p):
        for top in tops:
            if (rest := below(p, top)) is not None:
                return Path(top).name if rest == "." else f"{Path(top).name}/{rest}"
        return Path(p).name

    def to_parent(p):
        return next((rest for top in tops if (rest := below(p, Path(top).parent)) is not None), Path(p).name)

    got = roots.with_relative(df, known)
    assert {r["path"]: r["relative"] for r in got.collect()} == {p: relative(p) for p in paths}
    assert {r["path"]: r["relative"] for r in roots.with_relative_to_parent(df, known).collect()} == {p: to_parent(p) for p in paths}
    assert "NestedLoop" not in plan(got)
    nested = spark.createDataFrame([(0, "/"), (1, "/akten")], "pos int, root string")
    assert {r["relative"] for r in roots.with_relative(df.filter("path = '/akten'"), nested).collect()} == {"akten"}


def test_tree_is_in_pre_order(spark):
    names = ["b", "a", "a b", ".git", "c"]
    every = ["/r/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)] + ["/r", "/s", "/s/x", "/other"]
    random.Random(1).shuffle(every)
    got = roots.tree(spark.createDataFrame([(p,) for p in every], "path string"), spark.createDataFrame([(1, "/r/"), (0, "/s")], "pos int, root string"), 2).orderBy("sort_key").collect()

    def walk(path, depth):
        kids = sorted(Path(p).name for p in every if str(Path(p).parent) == path and not Path(p).name.startswith("."))
        return [(path, depth)] + ([x for k in kids for x in walk(f"{path}/{k}", depth + 1)] if depth < 2 else [])

    assert [(r["path"], r["depth"]) for r in got] == walk("/s", 0) + walk("/r", 0)
    assert all(r["name"] == Path(r["path"]).name and r["parent"] == str(Path(r["path"]).parent) for r in got)
    assert roots.tree(spark.createDataFrame([], "path string"), spark.createDataFrame([(0, "/r")], "pos int, root string")).collect() == []
    assert [r["x"] for r in spark.createDataFrame([("/a/b/",)], "p string").select(F.to_json(roots.ancestors(F.col("p"))).alias("x")).collect()] == ['["/","/a","/a/b"]']
