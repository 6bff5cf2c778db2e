"""Full-text search: prefix terms, all of which must match, ranked by BM25 over all columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import folded, folded_tokens

K1, B = 1.2, 0.75
#: Live search starts with so many characters.
LEAST = 2


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id, length (of the document over all columns), col, pos, token."""
    lists = [folded_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)]
    sized = docs.select(F.col(id_col).alias("id"), *lists).withColumn("length", sum(F.size(f"t{i}") for i in range(len(columns))))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"t{i}").alias("tokens")) for i, c in enumerate(columns)])).alias("x")
    return sized.select("id", "length", each).select("id", "length", F.col("x.col").alias("col"), F.posexplode("x.tokens").alias("pos", "token"))


def parse(query: str, least: int = 1) -> list[list[str]] | None:
    """Each blank-separated term as its tokens, the last of which is a prefix; None if the query can't match or has under `least` characters."""
    if len(query.strip()) < max(least, 1) or '"' in query:
        return None
    out = [re.findall(r"[^\W_]+", term) for term in folded(query).split()]
    return out if all(out) else None


def snippet(text: Column, query: str, words: int = 30) -> Column:
    """The window of words with most different terms of the query (then most hits, then the first), hits as >>>word<<<, what is cut as `...`.

    A hit starts with a term's first token. Windows begin at a hit; the shown one is moved back by half its length, as far as all its hits stay in it.
    Without a hit it is the first words. Words are runs without white space and are joined by one space.
    """
    starts = [phrase[0] for phrase in parse(query) or []]
    said = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    which = lambda w: F.filter(F.array(*[F.lit(i) for i in range(len(starts))]), lambda i: F.exists(folded_tokens(w), lambda t: F.startswith(t, F.get(F.array(*[F.lit(s) for s in starts]), i))))
    marked = F.transform(said, lambda w: F.struct(w.alias("w"), (which(w) if starts else F.array().cast("array<int>")).alias("terms")))
    hits = F.filter(F.transform(marked, lambda x, i: F.struct((i + 1).alias("at"), x["terms"].alias("terms"))), lambda x: F.size(x["terms"]) > 0)
    # Each hit with the hits of the window that it begins.
    inside = lambda h: F.filter(hits, lambda o: (o["at"] >= h["at"]) & (o["at"] < h["at"] + words))
    last = lambda h: F.array_max(F.transform(inside(h), lambda o: o["at"]))
    rated = F.transform(hits, lambda h: F.struct(F.size(F.array_distinct(F.flatten(F.transform(inside(h), lambda o: o["terms"])))).alias("terms"), F.size(inside(h)).alias("hits"), (-h["at"]).alias("at"), last(h).alias("last")))
    best = F.array_max(rated)
    before = F.least(F.lit(words // 2), words - 1 - (best["last"] + best["at"]))  # so many words before the first hit leave room for the last
    begin = F.greatest(F.lit(1), F.coalesce(-best["at"] - before, F.lit(1))).cast("int")
    shown = F.array_join(F.transform(F.slice(marked, begin, F.lit(words)), lambda x: F.when(F.size(x["terms"]) > 0, F.concat(F.lit(">>>"), x["w"], F.lit("<<<"))).otherwise(x["w"])), " ")
    return F.concat(F.when(begin > 1, "...").otherwise(""), shown, F.when(F.size(said) >= begin + words, "...").otherwise(""))


def wanted_tokens(token: Column, phrases: list[list[str]]) -> Column:
    """Tokens that a phrase needs: its words, and all that start with its last one."""
    wanted = F.lit(False)
    for phrase in phrases:
        for word in phrase[:-1]:
            wanted |= token == word
        wanted |= token.startswith(phrase[-1])
    return wanted


def phrase_hits(tokens: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """id, length, phrase (its number), f (how often it is there) from tokens(id, length, col, pos, token)."""
    hits = None
    for no, phrase in enumerate(phrases):
        found = tokens.filter(F.col("token").startswith(phrase[-1]) if len(phrase) == 1 else F.col("token") == phrase[0]).select("id", "length", "col", "pos")
        for k, word in enumerate(phrase[1:], 1):
            near = tokens.filter(F.col("token").startswith(word) if k == len(phrase) - 1 else F.col("token") == word).select("id", "col", (F.col("pos") - k).alias("pos"))
            found = found.join(near, ["id", "col", "pos"], "left_semi")
        one = found.groupBy("id", "length").agg(F.count("*").alias("f")).withColumn("phrase", F.lit(no))
        hits = one if hits is None else hits.unionByName(one)
    return hits


def ranked(hits: DataFrame, corpus: DataFrame, phrases: list[list[str]], limit: int) -> DataFrame:
    """id, rank of the documents with all phrases; corpus(n, mean): one row with the number of documents and their mean length."""
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # one row a phrase
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    scored = hits.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(corpus))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = scored.groupBy("id").agg(F.sum(part).alias("s"), F.count("*").alias("matched")).filter(F.col("matched") == len(phrases))
    return found.select("id", (-F.col("s")).alias("rank")).orderBy("rank", "id").limit(limit)


def nothing(docs: DataFrame, id_col: str = "id") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("rank")).limit(0)


def search(docs: DataFrame, id_col: str, columns: list[str], query: str, limit: int = 50, least: int = 1) -> DataFrame:
    """id, rank (smaller is better): phrases with a prefix at their end, joined by AND, of a table without a stored index. Postings of other tokens never leave their task."""
    phrases = parse(query, least)
    if phrases is None:
        return nothing(docs, id_col)
    tokens = postings(docs, id_col, columns).filter(wanted_tokens(F.col("token"), phrases))
    corpus = docs.select(sum(F.size(folded_tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("mean"))
    return ranked(phrase_hits(tokens, phrases), corpus, phrases, limit)
