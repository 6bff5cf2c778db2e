"""Language identification with unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum,
by a forward algorithm over its characters, of the products of piece probabilities of all its segmentations;
a text's is the product over its words (runs of letters, in lower case, marked at their start). The
probabilities are learned by expectation maximisation over the same lattice.

Learning uses a sample of labelled rows: a share drawn by a hash of doc_id so that about `train_docs` rows are
expected, with all their words; that bounds the fit only. Prediction reads every text whole.

Defined cases: a null text, and one without letters, is `und` with score 0; without labelled rows every
text is; a null doc_id counts as held out; repeated rows are separate; words are cut after PIECE_RUN
characters; ties go to the first language by name; very long texts are blocks of their own; an empty table gives an
empty result; ids pass as they are; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import add_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_RUN = 32
#: Runs of letters, and of signs like ², ½ and Ⅷ, which are word characters but no letters.
WORDS = re.compile(r"[^\W\d_]+")
#: Texts are scored in blocks of about so many characters.
BLOCK_CHARS = 4_000_000
#: Words that go through the lattice at once.
GROUP = 4_096
_P = np.uint64(0x9E3779B97F4A7C15)
#: The probability of a character that is no piece of its own.
FLOOR = 1e-7


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, in lower case; the mark of a word's start counts as a character.

    Words are runs of letters, so a piece that holds anything else is in no segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.vocab_size())}
    return sorted(p for p in pieces if p and (p == "▁" or p.lstrip("▁").isalpha()) and "▁" not in p[1:])


def piece_hash(piece: str) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in piece:
            h = (h + np.uint64(ord(c) + 1)) * _P
    return h


class Lattice:
    """Forward sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[str]):
        hashes = np.array([piece_hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.pieces = hashes[order], [pieces[i] for i in order]
        self.longest = max(map(len, pieces), default=1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; len(pieces) if none."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, len(self.hashes)) if len(self.hashes) else np.zeros(len(h), dtype=np.int64)

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in words, matrix of code points) by length."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths):
            for where in np.array_split(np.flatnonzero(lengths == n), 1 + (lengths == n).sum() // GROUP):
                yield where, np.frombuffer("".join([words[i] for i in where]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(where), n).astype(np.uint64)

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece of each word) over all stretches of up to `longest` characters."""
        n = codes.shape[1]
        for i in range(n):
            h = np.zeros(len(codes), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h + codes[:, j - 1] + np.uint64(1)) * _P
                yield i, j, self.find(h)

    def forward(self, codes: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        """f[j]: words x languages, the sum over segmentations of the first j characters. p: pieces + 1 x languages; its last row is 0."""
        f = [np.ones((len(codes), p.shape[1]))] + [np.zeros((len(codes), p.shape[1])) for _ in range(codes.shape[1])]
        for i, j, piece in self.arcs(codes):
            f[j] += f[i] * (np.where((piece == len(self.pieces))[:, None], FLOOR, p[piece]) if j == i + 1 else p[piece])
        return f

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        for where, codes in self.groups(words):
            out[where] = np.log(self.forward(codes, p)[-1])
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x languages); counts: words x languages."""
        total = np.zeros((len(self.pieces) + 1, p.shape[1]))
        for where, codes in self.groups(words):
            f, arcs = self.forward(codes, p), list(self.arcs(codes))
            b = [np.zeros_like(f[0]) for _ in f[:-1]] + [np.ones_like(f[0])]
            share = counts[where] / f[-1]
            for i, j, piece in reversed(arcs):
                q = np.where((piece == len(self.pieces))[:, None], FLOOR, p[piece]) if j == i + 1 else p[piece]
                np.add.at(total, piece, f[i] * q * b[j] * share)
                b[i] += q * b[j]
        return total[:-1]


def fit(words: list[str], counts: np.ndarray, pieces: list[str], rounds: int = 4) -> tuple[Lattice, np.ndarray]:
    """The lattice over pieces that occur, and pieces + 1 x languages probabilities."""
    lattice = Lattice(pieces)
    n = len(pieces)
    p = np.vstack([np.full((n, counts.shape[1]), 1 / max(1, n)), np.zeros((1, counts.shape[1]))])
    for _ in range(rounds):
        seen = lattice.expected(words, counts, p)
        keep = seen.sum(axis=1) > 1e-3
        lattice = Lattice([x for x, k in zip(lattice.pieces, keep) if k])
        seen = seen[keep] + 0.01
        p = np.vstack([seen / seen.sum(axis=0), np.zeros((1, counts.shape[1]))])
    return lattice, p


def split_words(text: str) -> list[str]:
    out = []
    for w in WORDS.findall(text.lower()):
        if not w.isalpha():
            out += split_words("".join(c if c.isalpha() else " " for c in w))
            continue
        w = "▁" + w
        out += [w] if len(w) <= PIECE_RUN else [w[i : i + PIECE_RUN] for i in range(0, len(w), PIECE_RUN)]
    return out


def bucket(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, train_docs: int, vocabulary: str) -> tuple[list[str], Lattice | None, np.ndarray | None]:
    labelled = docs.filter((bucket(5) != 0) & F.col("lang").isNotNull())
    n = labelled.select("doc_id").count()
    share = min(1.0, train_docs / max(1, n))
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                words = pd.Series([w for t in texts if t for w in split_words(t)], dtype=object).value_counts()
                yield pd.DataFrame({"lang": lang, "word": words.index.astype(object), "n": words.to_numpy(dtype="int64")})

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.toPandas()  # of about train_docs texts
    if top.empty:
        return [], None, None
    langs = sorted(top["lang"].unique())
    of, words = pd.factorize(top["word"])
    counts = np.zeros((len(words), len(langs)))
    counts[of, np.searchsorted(langs, top["lang"])] = top["n"]
    del top
    pieces = load_pieces(vocabulary)
    return langs, *fit(list(words), counts, pieces)


def predict_block(texts: list[str | None], langs: list[str], lattice: Lattice, p: np.ndarray) -> list[tuple[str, float]]:
    said = [split_words(t) if t else [] for t in texts]
    sizes = np.array([len(ws) for ws in said])
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not langs or not sizes.sum():
        return out
    codes, words = pd.factorize(np.array([w for ws in said for w in ws], dtype=object))
    per_word = lattice.log_likelihood(list(words), p)
    full = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    total = np.add.reduceat(per_word[codes], starts, axis=0)
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    for i, b, s in zip(full, best, score):
        out[i] = (langs[b], float(s))
    return out


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is a range of its own."""
    start = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if chars and chars + n > most:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def identify(docs: DataFrame, train_docs: int = 6_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, train_docs, vocabulary))

    def predict(batch: dict[str, list]) -> dict[str, list]:
        said = [x for a, b in blocks(batch["text"]) for x in predict_block(batch["text"][a:b], *model.value)]
        return {"lang_pred": [x[0] for x in said], "score": [x[1] for x in said]}

    held_out = F.coalesce(bucket(5) == 0, F.lit(True))
    return add_columns(docs.select("doc_id", "text", held_out.alias("held_out")), predict, "lang_pred string, score double", ["text"])


def keep_identified(docs: DataFrame, least_score: float = 0.5, train_docs: int = 6_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...), with all their columns, in which a language is identified with that score."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(learn(known, train_docs, vocabulary))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            said = [x for a, b in blocks(texts) for x in predict_block(texts[a:b], *model.value)]
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in said], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


__all__ = ["identify", "keep_identified", "fit", "Lattice", "split_words", "predict_block", "load_pieces"]
