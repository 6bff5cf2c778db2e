"""Language-model scores of whole documents: a gated recurrent network, trained and run in numpy.

Counts of every token of all training documents are gathered first. The commonest words are the network's
vocabulary, in classes of equal size by frequency: the output is P(class) * P(word in class). All other words
are one symbol of the network, and share its probability by their smoothed counts, so the score is a
probability of the very text. Training is truncated backpropagation (windows of `window` steps; the state goes
on from window to window, and starts anew with each document) on every training document: each task trains on its
documents, one after another in parallel streams, from common parameters, and the parameters are averaged, weighted by
tokens, through a tree of sums; `rounds` times.

Scoring carries each document's state across windows to its end, so length costs time but no memory. Counts
of words beyond the `listed` commonest are joined by word. Words of more than LISTED_BYTES are listed by their
hash, which bounds the table and lets no common long word (a ruled line) gather in one key.

Defined cases: null text is empty (its only token is the end); documents without id are held out; repeated
rows are separate rows; without training documents every word is unknown and the network untrained; very long texts
are scored window by window; ties in frequency are ordered by the word's bytes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import cut, slices, tree_sum

#: Capitals as small letters, all else as it is. Splitting on white space then leaves the words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a document as a token: no word holds white space.
END = b"\n"
#: Longer words are listed by a prefix and their digest, which bounds the table that tasks hold.
LISTED_BYTES = 64
LOG10 = float(np.log(10))
#: A task's first steps of training take a quarter of the streams: small steps early, wide ones once the parameters have settled.
WARM = 200
#: The columns of a scored part of a text.
ROW = ["doc_id", "tx", "held_out", "word", "times", "rows", "tokens", "known", "base", "score"]


def tokens(text: bytes) -> list[bytes]:
    """The words; one of more than LISTED_BYTES is named by its first bytes and its SHA-256, behind a byte that no word has."""
    words = text.translate(_LOWER).split()
    if max(map(len, words), default=0) > LISTED_BYTES:
        words = [w if len(w) <= LISTED_BYTES else w[:24] + b"\n" + hashlib.sha256(w).digest() for w in words]
    return words


def _rows(n: int, columns: int) -> np.ndarray:
    """An array of n rows that don't lie a power of two apart, where they would push each other out of a cache when they are transposed."""
    return np.empty((n, columns + 16), np.float32)[:, :columns]


class Network:
    """A GRU of `hidden` units with a class-factored softmax over `n_classes` * `size` words."""

    def __init__(self, n_classes: int, size: int, hidden: int, counts: np.ndarray | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        v, h = n_classes * size, hidden
        self.n_classes, self.size, self.hidden = n_classes, size, hidden
        self.shapes = {"embed": (v, h), "in": (h, 3 * h), "bias": (3 * h,), "rec": (h, 3 * h), "class": (h, n_classes), "class_bias": (n_classes,), "word": (n_classes, h, size), "word_bias": (n_classes, size)}
        self.p = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}
        for k, scale in (("embed", 0.5), ("in", 0.5 / np.sqrt(h)), ("rec", 0.5 / np.sqrt(h)), ("class", 0.1), ("word", 0.1)):
            self.p[k] = rng.normal(0, scale, self.shapes[k]).astype(np.float32)
        share = (np.zeros(v) if counts is None else counts.astype(np.float64)).reshape(n_classes, size) + 0.1
        self.p["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.p["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].astype(np.float32).reshape(s)
            at += n
        return self

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None, going_on: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (steps x columns x hidden) after each of the inputs (steps x columns); where going_on is 0 the state starts anew."""
        # Units are the first axis within a step, so every operation runs along a whole row of columns, and a step's arrays are small enough for the caches.
        n, p = self.hidden, self.p
        table = p["embed"] @ p["in"] + p["bias"]
        rec, h = np.ascontiguousarray(p["rec"].T), np.ascontiguousarray(h.T)
        out = np.empty((*inputs.shape, n), np.float32)
        for t in range(len(inputs)):
            if going_on is not None:
                h = h * going_on[t]
            x, u = np.ascontiguousarray(table.take(inputs[t], axis=0).T), rec @ h
            gates, new = x[: 2 * n], x[2 * n :]
            gates += u[: 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:n], gates[n:]
            new += r * u[2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, new, u[2 * n :]))
            h = np.subtract(h, new, out=_rows(n, h.shape[1]))
            h *= z
            h += new
            out[t] = h.T
        return out

    def log_p(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target after each state."""
        p, of = self.p, targets // self.size
        out = self._log_softmax_at(h @ p["class"] + p["class_bias"], of)
        order, parts = self._by_class(of)
        h, within, found = h.take(order, axis=0), (targets % self.size).take(order), np.empty(len(of))
        for c, a, b in parts:
            found[a:b] = self._log_softmax_at(h[a:b] @ p["word"][c] + p["word_bias"][c], within[a:b])
        out[order] += found
        return out

    @staticmethod
    def _log_softmax_at(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        mine = scores.ravel().take(np.arange(len(at)) * scores.shape[1] + at)
        if len(scores) and scores.max() > 80:  # else the exponentials can't overflow
            top = scores.max(axis=1)
            scores, mine = scores - top[:, None], mine - top
        return (mine - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))).astype(np.float64)

    @staticmethod
    def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and each class with its place there."""
        order = np.argsort(of.astype(np.uint16), kind="stable")
        of = of.take(order)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        return order, [(int(of[a]), a, b) for a, b in zip(cuts, cuts[1:]) if a < b]

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, going_on: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradient of the mean loss over one window (backpropagation stops at its start and where a document starts), and the last state."""
        n, p, kept = self.hidden, self.p, []
        states = self.states(inputs, h0, kept, going_on)
        g = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}
        h, y = states.reshape(-1, n), targets.ravel()
        of, scale = y // self.size, np.float32(1 / max(1, len(y)))

        def soft(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
            if scores.max() > 80:  # else the exponentials can't overflow
                scores = scores - scores.max(axis=1, keepdims=True)
            e = np.exp(scores, out=scores)
            e *= scale / (e @ np.ones(e.shape[1], np.float32))[:, None]
            e.ravel()[np.arange(len(at)) * e.shape[1] + at] -= scale
            return e

        d = soft(h @ p["class"] + p["class_bias"], of)
        ones = np.ones(len(y), np.float32)
        g["class"], g["class_bias"], dh = h.T @ d, ones @ d, d @ p["class"].T
        order, parts = self._by_class(of)
        h, within, d_words = h.take(order, axis=0), (y % self.size).take(order), np.empty((len(y), n), np.float32)
        for c, a, b in parts:
            d = soft(h[a:b] @ p["word"][c] + p["word_bias"][c], within[a:b])
            g["word"][c], g["word_bias"][c] = h[a:b].T @ d, ones[a:b] @ d
            d_words[a:b] = d @ p["word"][c].T
        back = np.empty(len(y), np.int64)
        back[order] = np.arange(len(y))
        dh += d_words.take(back, axis=0)
        d_states = np.ascontiguousarray(dh.reshape(*inputs.shape, n).transpose(0, 2, 1))
        flat, d_x, d_u = np.empty((*inputs.shape, 3 * n), np.float32), *(_rows(3 * n, inputs.shape[1]) for _ in range(2))
        carry, rec = np.zeros((n, inputs.shape[1]), np.float32), np.ascontiguousarray(p["rec"])
        for t in range(len(inputs) - 1, -1, -1):
            prev, z, r, new, un = kept[t]
            dh = d_states[t]
            dh += carry
            held = 1 - z
            d_new = d_x[2 * n :]
            np.multiply(dh, held, out=d_new)
            held *= z
            held *= dh
            dh *= z
            np.multiply(held, prev - new, out=d_x[:n])
            new *= new
            np.subtract(1, new, out=new)
            d_new *= new
            np.multiply(d_new, r, out=d_u[2 * n :])
            un *= d_u[2 * n :]
            np.subtract(1, r, out=r)
            np.multiply(un, r, out=d_x[n : 2 * n])
            d_u[: 2 * n] = d_x[: 2 * n]
            g["rec"] += prev @ d_u.T
            dh += rec @ d_u
            carry = dh * going_on[t]
            flat[t] = d_x.T
        # Inputs that are the same word share their sum, from which all that stands before the recurrence follows.
        at, flat = inputs.ravel(), flat.reshape(-1, 3 * n)
        order = np.argsort(at.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else at, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1])
        words, sums = at[order][cuts], np.add.reduceat(flat.take(order, axis=0), cuts, axis=0)
        g["bias"], g["in"], g["embed"][words] = sums.sum(axis=0), p["embed"][words].T @ sums, sums @ p["in"].T
        return g, states[-1]


def windows(coded: list[np.ndarray], columns: int, steps: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which document, inputs, targets, going_on, live) by windows: whole documents one after another in columns of like length, the long first."""
    order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
    held = [(0, c, []) for c in range(min(columns, len(coded)))]
    for i in order:
        n, c, mine = held[0]
        heapq.heapreplace(held, (n + len(coded[i]), c, [*mine, i]))
    held.sort(key=lambda x: (-x[0], x[1]))
    docs = [i for *_, mine in held for i in mine]
    sizes = np.array([len(coded[i]) for i in docs])
    flat, of = np.concatenate([coded[i] for i in docs]), np.repeat(docs, sizes)
    starts = np.zeros(len(flat), bool)
    starts[np.cumsum(sizes) - sizes] = True
    lengths = np.array([n for n, *_ in held])
    begin = np.cumsum(lengths) - lengths
    for t in range(0, int(lengths[0]), steps):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        step = t + np.arange(min(steps, int(lengths[0]) - t))[:, None]
        live = step < lengths[:n]
        at = np.where(live, begin[:n] + step, begin[:n])
        yield of[at], np.where(starts[at], end, flat[at - 1]), flat[at], (~starts[at]).astype(np.float32), live


def streams(coded: list[np.ndarray], columns: int, steps: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(inputs, targets, going_on, first) by windows: all documents one after another, in `columns` streams of equal length.

    A stream's last window is as long as the others, filled up from the beginning of all documents.
    """
    flat = np.concatenate(coded)
    starts = np.zeros(len(flat), bool)
    starts[np.cumsum([0, *map(len, coded[:-1])])] = True
    columns = max(1, min(columns, len(flat) // (4 * steps)))
    length = -(-len(flat) // (columns * steps)) * steps
    at = (np.arange(columns)[None, :] * length + np.arange(length)[:, None]) % len(flat)
    for t in range(0, length, steps):
        now = at[t : t + steps]
        yield np.where(starts[now], end, flat[now - 1]), flat[now], (~starts[now]).astype(np.float32), t == 0


class Moments:
    """What Adam remembers from step to step, for as long as a task trains."""

    def __init__(self, net: Network):
        self.m, self.v = ({k: np.zeros(s, np.float32) for k, s in net.shapes.items()} for _ in range(2))
        self.turn = 0


def train(net: Network, coded: list[np.ndarray], end: int, steps: int, columns: int = 1024, rate: float = 0.02, moments: Moments | None = None) -> int:
    """One pass of Adam over the documents; the number of tokens."""
    if not coded:
        return 0
    moments, state = moments or Moments(net), None
    m, v, turn = moments.m, moments.v, moments.turn
    columns = columns if turn >= WARM else columns // 4
    for inputs, targets, going_on, first in streams(coded, columns, steps, end):
        state = np.zeros((inputs.shape[1], net.hidden), np.float32) if first else state
        g, state = net.gradient(inputs, targets, going_on, state)
        turn += 1
        for k in net.shapes:
            x = np.clip(g[k], -1, 1)
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            net.p[k] -= (rate / (1 + turn / 2000) / (1 - 0.9**turn)) * m[k] / (np.sqrt(v[k] * (1 / (1 - 0.99**turn))) + 1e-6)
    moments.turn = turn
    return sum(map(len, coded))


def score_texts(net: Network, coded: list[np.ndarray], end: int, steps: int = 32, columns: int = 512) -> np.ndarray:
    """log10 probability of each sequence of symbols; the state goes on from window to window."""
    out, state = np.zeros(len(coded)), np.zeros((min(columns, len(coded)), net.hidden), np.float32)
    for docs, inputs, targets, going_on, live in windows(coded, columns, steps, end) if coded else ():
        states = net.states(inputs, state[: inputs.shape[1]], None, going_on)
        state = states[-1]
        out += np.bincount(docs[live], weights=net.log_p(states[live], targets[live]), minlength=len(out))
    return out / LOG10


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), n over all texts; a task hands on its counts whenever it holds 200,000 words."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        table = lambda: pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
        for frame in frames:
            for text in frame["text"]:
                total.update(tokens(text))
                if len(total) > 200_000:
                    yield table()
                    total.clear()
        yield table()

    return texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def log_likelihood(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10, n_classes: int = 32, class_size: int = 32,
    hidden: int = 16, window: int = 16, rounds: int = 1, listed: int = 250_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(held_out_of)) == 0, F.lit(True))
    # An id travels as text: pandas makes floats of whole numbers beside nulls.
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    training = texts.filter(~F.col("held_out"))
    counts = cut(count_words(training), "counts")
    n_ends = training.select("doc_id").count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_ends, n_distinct + (n_ends > 0)

    # The listed words, commonest first; the network's vocabulary are the first of them, the rest word and the end.
    # Frequencies in steps of 1/1024 octave: the lowest one from which on there are at most `listed` words.
    step = F.floor(F.log2("n") * 1024)
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)  # at most 65,536 rows
    room, least = listed, 1 << 30
    for at, n_here in steps:
        room -= n_here
        if room < 0:
            break
        least = at
    common = [(bytes(r["word"]), r["n"]) for r in counts.filter(step >= least).collect()]  # at most `listed` words of LISTED_BYTES
    common.sort(key=lambda x: (-x[1], x[0]))
    n_vocabulary = min(len(common), n_classes * class_size - 2)
    inside = sum(n for _, n in common[:n_vocabulary])
    ranked = sorted([*range(n_vocabulary), -1, -2], key=lambda i: -(common[i][1] if i >= 0 else n_words - inside if i == -1 else n_ends))
    symbol = {i: s for s, i in enumerate(ranked)}
    of_rank = np.array([symbol[i] for i in range(n_vocabulary)] + [symbol[-1]] * (len(common) - n_vocabulary) + [symbol[-1]], dtype=np.int64)
    rest, end = symbol[-1], symbol[-2]
    frequency = np.zeros(n_classes * class_size)
    for i, s in symbol.items():
        frequency[s] = common[i][1] if i >= 0 else n_words - inside if i == -1 else n_ends
    index = {w: i for i, (w, _) in enumerate(common)}
    log_count = np.log10(np.array([n for _, n in common] + [0]) + 0.1)
    log_base = np.log10(total + 0.1 * (distinct + 1))
    log_rest = np.log10(n_words - inside + 0.1 * (n_distinct - n_vocabulary + 1))
    shared = spark.sparkContext.broadcast((index, of_rank, log_count))
    net = Network(n_classes, class_size, hidden, frequency)

    def coded(text: bytes) -> tuple[list[bytes], np.ndarray]:
        words, index = tokens(text), shared.value[0]
        return words, np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(net.flat())

        def fit(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            mine, n = Network(n_classes, class_size, hidden).load(now.value), 0
            moments = Moments(mine)
            for frame in slices(frames):
                n += train(mine, [np.append(shared.value[1][coded(x)[1]], end) for x in frame["text"]], end, window, moments=moments)
            if n:
                data = np.append(mine.flat().astype(np.float64) * n, n)
                parts = [data[a : a + 65_536].tobytes() for a in range(0, len(data), 65_536)]
                yield pd.DataFrame({"chunk": np.arange(len(parts)), "part": TaskContext.get().partitionId(), "data": parts})

        added = tree_sum(training.select("text").mapInPandas(fit, "chunk int, part long, data binary"), "<f8").collect()  # the parameters
        if added:
            data = np.concatenate([np.frombuffer(r["data"], "<f8") for r in sorted(added, key=lambda r: r["chunk"])])
            net.load(data[:-1] / data[-1])
    model = spark.sparkContext.broadcast(net.flat())

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(n_classes, class_size, hidden).load(model.value)
        for frame in slices(frames, most=6 << 20):
            said = [coded(x) for x in frame["text"]]
            of_rank, log_count = shared.value[1:]
            model_score = score_texts(net, [np.append(of_rank[at], end) for _, at in said], end)
            head, word, times, row_of = [], [], [], []
            for i, (tx, (words, at)) in enumerate(zip(frame["tx"], said)):
                listed_at, unlisted = at[at >= 0], Counter([words[j] for j in np.flatnonzero(at < 0).tolist()])
                base = float(log_count[listed_at].sum()) + float(np.log10(n_ends + 0.1)) - (len(words) + 1) * log_base
                other = listed_at[listed_at >= n_vocabulary]
                scored = float(model_score[i]) + float(log_count[other].sum()) - (len(words) - len(listed_at) + len(other)) * log_rest
                head.append((len(words) + 1, len(listed_at) + (n_ends > 0), base, scored))
                word += [b"\n%d %d" % (tx, i), *unlisted.keys()]
                times += [0, *unlisted.values()]
                row_of += [i] * (len(unlisted) + 1)
            for a in range(0, len(row_of), 100_000):
                of = np.array(row_of[a : a + 100_000])
                is_head = np.append(True, of[1:] != of[:-1]) if not a else np.append(of[0] != row_of[a - 1], of[1:] != of[:-1])
                parts = np.where(is_head[:, None], np.array(head)[of], 0)
                yield frame[["doc_id", "tx", "held_out"]].iloc[of].reset_index(drop=True).assign(
                    word=word[a : a + 100_000], times=times[a : a + 100_000], rows=is_head.astype(np.int32), tokens=parts[:, 0].astype(np.int64),
                    known=parts[:, 1].astype(np.int64), base=parts[:, 2], score=parts[:, 3],
                )[ROW]

    told = texts.withColumn("tx", F.xxhash64("text")).mapInPandas(score, "doc_id string, tx long, held_out boolean, word binary, times long, rows int, tokens long, known long, base double, score double")
    with_counts = told.join(counts, "word", "left")
    one = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    of_doc = with_counts.groupBy("doc_id", "tx", "held_out").agg(
        F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum(F.col("known") + known).alias("known"), F.sum(F.col("base") + one).alias("base"), F.sum(F.col("score") + one).alias("score")
    )
    # Repeated rows were added up; they are dealt out again.
    each = of_doc.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    part = lambda c: (F.col(c) / F.col("rows")).cast("long")
    return each.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", part("tokens").alias("n_tokens"), part("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"))
