"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are five consecutive words. A shingle weighs (1 + ln tf) * (1/2 + 1/2 idf / most idf), where idf is the
logarithm of documents over document frequency. Frequencies of all documents are gathered in a count sketch of
fixed size, merged in a tree; a sketch blurs only frequencies relative to the corpus, by the same amount at
every size, and idf is capped at RARE for that reason. Weights depend on a shingle alone (and its tf), so
sampling and similarity agree on them.

Improved consistent weighted sampling draws, for each of BANDS * ROWS functions, one (shingle, level) of a
document, such that two documents draw the same with a probability equal to their weighted Jaccard similarity.
A band is the hash of ROWS draws. Texts are candidates if they share a band and at least LEAST of their draws; a pair at
similarity 0.8 is one with a probability of 0.9997. Candidates are verified on their whole texts.

Identical texts are one unit. First, the units of a band meet its leader. Then, in bands that still hold units of
two classes, all pairs of units of different classes are candidates, in blocks of at most BLOCK_UNITS units and
BLOCK_BYTES of text: a task holds two blocks, passes over pairs that an earlier band has as well or that links have
joined meanwhile, and returns only links. So no pair is lost, no group is gathered whole and no pairs are emitted; the
comparisons of a band grow with the square of its units of other classes only, and most of them see the draws alone.
Links make classes by repeated exchange of least labels.

Defined cases: null text is empty; texts of fewer than five words are one shingle of all their words;
texts without words are alike only if they are identical; a null id has no class; of repeated rows all have
one class; rows of one id with different texts are different documents; very long texts are hashed in stretches and
compared whole; ties (equal ids) have the same class_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import add_columns, cut, join_if_small, tree_sum
from quillmill.llm.decontaminate import _TABLE

_B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
WORDS = 5
#: Counters of the frequency sketch; an idf is at most that of a shingle in this share of the documents.
SLOTS, RARE = 1 << 20, 1e-3
BANDS, ROWS = 16, 4
#: The least share of equal draws of a candidate pair: four standard deviations below 0.8.
LEAST = 0.6
STRETCH = 1 << 20
#: Bits of a shingle's id, and texts that are hashed at once.
BITS, TEXTS = 52, 1 << 12
#: A block of a band's units, of which a task holds two.
BLOCK_UNITS, BLOCK_BYTES = 256, 16 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([one, np.full(1 << 16, b, np.uint64)])) for b in (_B, inverse))


_UP, _DOWN = _powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _D
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word; words of more than 65,536 bytes are hashed one by one."""
    out = np.zeros(len(starts), np.uint64)
    block = 1 << 15
    for base in range(0, len(data), block):
        a, b = np.searchsorted(starts, [base, base + block])
        if a == b:
            continue
        near = np.flatnonzero(lengths[a:b] <= block) + a
        if len(near):
            end = int((starts[near] + lengths[near]).max())
            total = np.concatenate([[np.uint64(0)], np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * _UP[: end - base])])
            s = starts[near] - base
            out[near] = (total[s + lengths[near]] - total[s]) * _DOWN[s]
        for i in np.flatnonzero(lengths[a:b] > block) + a:
            digest = hashlib.sha256(data[starts[i] : starts[i] + lengths[i]].tobytes()).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
    return mixed(out + lengths.astype(np.uint64) * _D)


def shingles(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches of texts i to j: bounds of each text's shingles, the distinct shingles (sorted in each text) and their tf."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j - i < TEXTS and (j == i or size + len(texts[j]) < STRETCH):
            size += len(texts[j]) + 1
            j += 1
        lengths = np.fromiter((len(x) + 1 for x in texts[i:j]), dtype=np.int64, count=j - i)
        data = np.frombuffer(b" ".join(texts[i:j]).translate(_TABLE) + b" ", dtype=np.uint8)
        is_word = data != 32
        edges = np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        with np.errstate(over="ignore"):
            word = word_hashes(data, starts, ends - starts)
            of = np.searchsorted(np.cumsum(lengths), starts, side="right")
            n_words = np.bincount(of, minlength=j - i)
            begin = np.cumsum(n_words) - n_words
            if len(word) >= WORDS:
                n = len(word) - WORDS + 1
                run = sum(word[k : k + n] * _UP[k + 1] for k in range(WORDS))
                at = np.flatnonzero(of[:n] == of[WORDS - 1 :])
                ids, text = run[at], of[at]
            else:
                ids, text = word[:0], of[:0]
            short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
            brief = np.array([sum(word[begin[d] + k] * _UP[k + 1] for k in range(n_words[d])) + np.uint64(n_words[d]) for d in short], dtype=np.uint64)
            ids, text = mixed(np.concatenate([ids, brief])), np.concatenate([text, short])
        key = np.sort(text.astype(np.uint64) << np.uint64(BITS) | ids >> np.uint64(64 - BITS))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(key)))
        key = key[new]
        bounds = np.searchsorted(key, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(BITS))
        yield i, j, bounds, key & np.uint64((1 << BITS) - 1), tf
        i = j


class Weights:
    """Weights of shingles from the sketch of their document frequencies."""

    def __init__(self, counts: np.ndarray, n_docs: int):
        noise = counts.sum() / SLOTS
        most = max(1e-9, np.log(min(max(n_docs, 2), 1 / RARE)))
        idf = np.log(max(1, n_docs) / np.clip(counts - noise, 1, max(1, n_docs)))
        self.by_slot = (0.5 + 0.5 * np.clip(idf / most, 0, 1)).astype(np.float32)

    def of(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = self.by_slot[(ids % np.uint64(SLOTS)).astype(np.int64)]
        return np.where(tf == 1, w, w * (1 + np.log(tf))).astype(np.float32)


def learn_weights(texts: DataFrame) -> Weights:
    """One pass over all texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.float64)
        for frame in frames:
            for *_, ids, _ in shingles(list(frame["text"])):
                total += np.bincount((ids % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        chunks = total.astype("<f4").reshape(16, -1)
        yield pd.DataFrame({"chunk": np.arange(16), "part": TaskContext.get().partitionId(), "data": [c.tobytes() for c in chunks]})

    parts = texts.select("text").mapInPandas(count, "chunk int, part long, data binary")
    chunks = {r["chunk"]: np.frombuffer(r["data"], "<f4") for r in tree_sum(parts, "<f4").collect()}  # the sketch: SLOTS numbers
    counts = np.concatenate([chunks[k] for k in sorted(chunks)]).astype(np.float64) if chunks else np.zeros(SLOTS)
    return Weights(counts, texts.count())


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / n, by Newton's method."""
    q = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * q) + q**4
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-300) * 0.5, 1e-9)
    return x


_R = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def signature(ids: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands (texts x BANDS) and draws (texts x BANDS * ROWS, 16 bits each) of each text that has shingles."""
    full = np.flatnonzero(np.diff(bounds))
    starts, counts = bounds[full], np.diff(bounds)[full]
    log_w = np.log(weight)
    odd = np.flatnonzero(log_w != 0)
    bands, draws = np.zeros((len(full), BANDS), np.uint64), np.zeros((len(full), BANDS * ROWS), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            x = mixed(ids + np.uint64(k + 1) * _B)
            bits = x.view(np.uint16).reshape(-1, 4)
            r, beta = _R[bits[:, 0]], bits[:, 1].astype(np.float32) * np.float32(1 / 65536)
            value = _LOG_C[bits[:, 2]] - r * (1 - beta)
            level = np.floor(log_w[odd] / r[odd] + beta[odd])
            value[odd] -= r[odd] * level
            least = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == np.repeat(least, counts))
            drawn = hits[np.searchsorted(hits, starts)]
            at = np.searchsorted(odd, drawn)
            at[at == len(odd)] = 0
            lifted = np.where(odd[at] == drawn, level[at], 0) if len(odd) else np.zeros(len(drawn))
            draw = mixed(ids[drawn] * _C + lifted.astype(np.int64).astype(np.uint64) + np.uint64(k))
            draws[:, k] = draw & np.uint64(0xFFFF)
            bands[:, k // ROWS] = mixed(bands[:, k // ROWS] + draw)
    return bands, draws


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two texts, each as (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    shared = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def weighted(texts: list[bytes], weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for i, j, bounds, ids, tf in shingles(texts):
        w = weights.of(ids, tf)
        out += [(ids[a:b], w[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def classes(links: DataFrame) -> DataFrame:
    """unit, class: the least unit of each connected component of links(a, b), for units that have a link."""
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "both")
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("class")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("class").alias("near"))
        step = labels.join(near, "u").select("u", "class", F.least("class", "near").alias("low"))
        jump = labels.select(F.col("u").alias("low"), F.col("class").alias("jumped"))
        after = cut(step.join(jump, "low").select("u", "class", F.least("low", "jumped").alias("next")), "labels")
        changed = after.filter(F.col("next") != F.col("class")).limit(1).count()
        labels = after.select("u", F.col("next").alias("class"))
        if not changed:
            return labels.withColumnRenamed("u", "unit")


def _draws(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def verify(pairs: DataFrame, units: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """a, b, similarity of those pairs(a, b) that share LEAST of their draws; units(unit, draws), texts(unit, text)."""

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = (_draws(frame["draws_a"]) == _draws(frame["draws_b"])).mean(axis=1) >= LEAST
                yield frame.loc[near, ["a", "b"]]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = sorted({*frame["text_a"], *frame["text_b"]})
            known = dict(zip(said, weighted(said, weights.value)))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": [similarity(known[x], known[y]) for x, y in zip(frame["text_a"], frame["text_b"])]})

    of = lambda c: units.select(F.col("unit").alias(c), F.col("draws").alias(f"draws_{c}"))
    said = lambda c: texts.select(F.col("unit").alias(c), F.col("text").alias(f"text_{c}"))
    near = cut(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(likely, "a long, b long"), "likely")
    return near.join(said("a"), "a").join(said("b"), "b").mapInPandas(compare, "a long, b long, similarity double")


def links_of_block(frame: pd.DataFrame, known: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links between units of different classes of one pair of blocks that are not joined by other links of it."""
    unit, own, block = frame["unit"].to_numpy(), frame["class"].to_numpy(), frame["block"].to_numpy()
    draws, bands = _draws(frame["draws"]), np.array(frame["bands"].tolist())
    no, across = int(frame["no"].iloc[0]), frame["i"].iloc[0] != frame["j"].iloc[0]
    names, of = np.unique(own, return_inverse=True)
    top = np.arange(len(names))
    out = []
    for x in range(len(unit) - 1):
        mine = top[of[x + 1 :]]
        at = np.flatnonzero((mine != top[of[x]]) & ((block[x + 1 :] != block[x]) | (not across)))
        if len(at):
            share = (draws[x + 1 + at] == draws[x]).mean(axis=1)
            at, share = at[share >= LEAST], share[share >= LEAST]
        if len(at):
            first = (bands[x + 1 + at] == bands[x]).argmax(axis=1) == no
            at = at[first][np.argsort(-share[first], kind="stable")]
        for y in at + x + 1:
            if top[of[x]] != top[of[y]] and similarity(known[x], known[y]) >= threshold:
                top[top == top[of[y]]] = top[of[x]]
                out.append((int(unit[x]), int(unit[y])))
    return out


def block_links(rows: DataFrame, weights, threshold: float) -> DataFrame:
    """a, b of the links within blocks; rows(band, no, unit, class, block, i, j, draws, bands, text), i and j being a pair of blocks."""
    key = ["band", "i", "j"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(frame: pd.DataFrame) -> pd.DataFrame:
            said = sorted(set(frame["text"]))
            known = dict(zip(said, weighted(said, weights.value)))
            found = [x for _, own in frame.groupby(key, sort=False) for x in links_of_block(own, [known[t] for t in own["text"]], threshold)]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (frame[key] == frame[key].iloc[-1]).all(axis=1)  # the last pair of blocks may go on in the next frame
            if not last.all():
                yield done(frame[~last])
            held = frame[last]
        if held is not None:
            yield done(held)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), class_size, text_sha256, is_first (one text of each class) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    weights = spark.sparkContext.broadcast(learn_weights(texts))

    def sign(batch: dict[str, list]) -> dict[str, list]:
        said = batch["text"]
        bands, draws = [None] * len(said), [None] * len(said)
        for i, _, bounds, ids, tf in shingles(said):
            if len(ids):
                marks, drawn = signature(ids, weights.value.of(ids, tf), bounds)
                for d, m, x in zip(np.flatnonzero(np.diff(bounds)) + i, marks.view(np.int64), drawn):
                    bands[d], draws[d] = m, x.tobytes()
        return {"tx": [hashlib.sha256(x).digest() for x in said], "n_bytes": [len(x) for x in said], "bands": bands, "draws": draws}

    signed = cut(add_columns(texts, sign, "tx binary, n_bytes long, bands array<long>, draws binary", ["text"]), "signed")
    named = signed.filter(F.col("doc_id").isNotNull()).groupBy("tx")
    units = named.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("n_bytes", "bands", "draws")])
    units = cut(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    banded = units.select("unit", "n_bytes", F.posexplode("bands").alias("no", "band")).select("unit", "n_bytes", "no", F.xxhash64("no", "band").alias("band"))
    shared = banded.groupBy("band").agg(F.min("unit").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("band", "leader")
    groups = cut(banded.join(shared, "band"), "groups")
    wanted = groups.select("unit").distinct().join(units.select("unit", "tx", F.col("first_id").alias("doc_id")), "unit")
    wanted = cut(wanted, "wanted")
    n_wanted = wanted.count()
    some = join_if_small(texts.withColumn("tx", F.unhex(F.sha2("text", 256))), wanted, ["doc_id", "tx"], "inner", 64 * n_wanted)
    some = cut(some.groupBy("unit").agg(F.any_value("text").alias("text")), "candidates")
    drawn = units.join(wanted.select("unit"), "unit", "left_semi").select("unit", "draws", "bands")

    pairs = groups.filter("leader != unit").select(F.col("leader").alias("a"), F.col("unit").alias("b")).distinct()
    links = verify(pairs, drawn, some, weights).filter(F.col("similarity") >= threshold).select("a", "b")
    of = classes(links)
    labelled = cut(groups.join(of, "unit", "left").withColumn("class", F.coalesce("class", "unit")), "labelled")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_UNITS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    still_open = labelled.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), blocks).filter("low != high").select("band", "blocks")
    rows = labelled.join(still_open, "band").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("band", "no", "unit", "class", "block", "i", "j").join(drawn, "unit").join(some, "unit")
    more = cut(block_links(rows, weights, threshold), "more")

    label = of.withColumnRenamed("unit", "u")
    joined = more.join(label.select(F.col("u").alias("a"), F.col("class").alias("x")), "a", "left").join(label.select(F.col("u").alias("b"), F.col("class").alias("y")), "b", "left")
    joined = joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    last = classes(joined).select(F.col("unit").alias("class"), F.col("class").alias("root"))
    members = of.select("unit", "class").unionByName(last.select(F.col("class").alias("unit"), "class")).distinct()
    root = members.join(last, "class", "left").select("unit", F.coalesce("root", "class").alias("root"))
    # Only texts that are repeated or linked need an entry; every other document is a class of its own.
    known = units.select("unit", "tx", "first_id", "n").join(root, "unit", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "unit"))
    known = cut(known, "known")
    first = known.groupBy("root").agg(F.min(F.struct("first_id", "tx")).alias("first"), F.sum("n").alias("class_size"))
    entries = known.join(first, "root").select("tx", F.col("first.first_id").alias("class_id"), "class_size", (F.col("tx") == F.col("first.tx")).alias("is_first"))
    entries = cut(entries, "entries")
    out = join_if_small(signed.select("doc_id", "tx"), entries, ["tx"], "left", 64 * entries.count())
    has_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.when(has_id, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(has_id, F.coalesce("class_size", F.lit(1))).alias("class_size"),
        F.hex("tx").alias("text_sha256"), (has_id & F.coalesce(F.col("is_first") & (F.col("doc_id") == F.col("class_id")), F.lit(True))).alias("is_first"),
    )
