"""Prefix trie, centroid clustering and the trie self-join of fingerprints against brute force and SQL, with odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("quillmill.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillmill.llm import lloyd, prefix_trie, queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_centroid_clusters"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got and got == sorted((tuple(dict(zip(want.columns, r))[c] for c in columns) for r in want.fetchall()), key=str)


def trie(rows):
    own = collections.defaultdict(list)
    for i, t, r, x in rows:
        if i is not None:
            own[i].append((t is not None, t or 0, r or "", x or ""))
    own = {i: [x[2:] for x in sorted(v)] for i, v in own.items()}
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for i, v in own.items():
        h = zlib.crc32(str(i).encode()) % 9
        said = own.get(i - int(math.fmod(i, 5)), [])[:h] + v[h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append((i, len(said)))
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    sha = lambda m, d: hashlib.sha256(",".join(str(i) for i, n in sorted(m) if n == d).encode()).hexdigest()
    return sorted(((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(m, len(p))) for p, m in members.items()), key=str)


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_trie_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rng = random.Random(block)
    ids = rng.sample(range(-20, 120), 60)
    rows = [(i, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", "x", "é", "yy", None])) for i in ids for t in range(rng.choice([1, 2, 5, 9, 14]))]
    rows += [(i, t, "user", "same") for i in range(200, 290) for t in range(9)]  # one large group of copies
    rows += [(300, 0, "user", "x" * 300_000), (300, 0, "user", "x" * 300_000), (301, None, None, None), (None, 0, "user", "gone")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"Depth": F.lit(1), "block": F.lit("x"), "key": F.lit(0)})
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, block=block).collect()), key=str)
    assert got == trie(rows)


def test_trie_of_little(spark):
    of = lambda rows: sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    assert of([]) == of([(None, 1, "user", "x")]) == []
    for rows in ([(7, 0, "user", "x")], [(3, None, None, None)], [(0, 1, "user", "x"), (0, 0, "user", "y")]):
        assert of(rows) == trie(rows)


def test_cover_trees_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(120):
        n, d, k, s = rng.integers(1, 150), rng.integers(1, 6), rng.integers(1, 20), int(rng.choice([1, 3, 50, 1 << 20, 1 << 40, 1 << 61]))
        rows, centroids = rng.integers(-s, s + 1, (n, d)), rng.integers(-s, s + 1, (k, d))
        if trial % 3 == 0:
            centroids = rows[rng.integers(0, n, k)]
        tree = lloyd.cover_tree(rows, leaf=int(rng.choice([1, 2, 8])))
        assert sorted(map(tuple, tree.rows)) == sorted(map(tuple, rows))
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in centroids] for p in tree.rows]
        assert list(lloyd.nearest(tree, centroids)) == [min(range(k), key=lambda j: (x[j], j)) for x in far]
        for i in range(len(tree.start)):  # covering, and separated children
            own = tree.rows[tree.start[i] : tree.stop[i]].astype(float)
            assert lloyd.lengths(own - own[0]).max() <= tree.radius[i] * (1 + 1e-12)
            first = tree.rows[tree.start[tree.low[i] : tree.high[i]]].astype(float)
            assert all(lloyd.lengths(first[j + 1 :] - first[j]).min(initial=np.inf) > tree.radius[i] / lloyd.BASE * (1 - 1e-12) for j in range(len(first)))


def clusters(rows, k, rounds, dims, grid):
    kept = [(i, [math.floor(grid * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * grid) < 2.0**62 for x in v)]
    kept.sort(key=lambda r: ((r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else ""), r[1]))
    centroids = [v for _, v in kept[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)].append(v)
        for c, vs in own.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs)]
    most = (1 << 63) - 1
    out = [(i, near(v), far(v, centroids[near(v)]), v) for i, v in kept]
    inertia = collections.Counter()
    for _, c, x, _ in out:
        inertia[c] += min(x, most)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(x, most), min(inertia[c], most), min(sum(inertia.values()), most), sha[c]) for i, c, x, _ in out), key=str)


@pytest.mark.parametrize("shard", [1024, 5])
def test_clusters_against_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    spread = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(150)]
    spread += [(1000 + i, [0.5, 0.25, -0.125, 1.0]) for i in range(70)] + [(5, [9.0] * 4), (5, [9.0] * 4), (None, [1.0] * 4), (None, [-1.0] * 4)]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf")] * 4), (2006, [1e300] * 4), (2007, [0.0] * 5)]
    for rows in (spread + odd, spread[:3] + odd, [*spread, (3000, [1e15] * 4), (3001, [-1e15, 3e14, 1e15, 7.0])], odd, []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "Cluster": F.lit("x"), "distance": F.lit(0)})
        got = lloyd.cluster(df, k=12, rounds=3, dims=4, shard=shard).collect()
        assert sorted((tuple(r) for r in got), key=str) == clusters(rows, 12, 3, 4, 256)


def fingerprint(spark, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    said = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(x,) for x in said], "s string").select(F.xxhash64("s")).collect()] if said else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(fps):
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    fps = sorted(top)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                top[find(x)] = find(y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("stretch", [1 << 20, 3, 1])
def test_fingerprints_as_spark_hashes(spark, stretch, monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", stretch)
    for text in ("a b c d e", "A b", "", " \t", "x", "one  two\tthree\nfour one two three", "É b c Ü\x0bd\x0ce\x1cf", "w " * 50):
        assert simhash.fingerprint(text.encode()) == fingerprint(spark, text), text


@pytest.mark.parametrize("most", [10_000, 40])
def test_links_against_all_pairs(spark, most):
    rng = np.random.default_rng(most)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 40, np.uint64)} | {0, (1 << 64) - 1}
    for b in sorted(fps)[:10]:
        for _ in range(20):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                b ^= 1 << int(bit)
            fps.add(b)
    fps |= {x | 5 << 40 for x in range(150)}  # a dense region
    want = components(fps)
    top = {f: f for f in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    found = simhash.links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long"), most=most).collect()
    for a, b in ((a % (1 << 64), b % (1 << 64)) for a, b in found):
        assert want[a] == want[b]
        top[find(a)] = find(b)
    assert len({find(f) for f in fps}) == len(set(want.values()))


def test_simhash_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    text = rows[0][1] + " and so on and so on"
    rows += [(9001, None), (None, ""), (9003, " \n"), (9004, "hello"), (9005, text), (9006, text + " end"), (9006, text), (9006, text), (None, "hello"), (None, "all alone here now"), (9007, "ab " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "Component": F.lit("x"), "fingerprint": F.lit(0)})
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label, first = components(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    want = sorted(((i, f"{f:016x}", first.get(label[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df, most=50).collect()), key=str) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
