"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is a run of item words (a short item is one window). To lie in a document, all of a window's words
must; so its rarest word, by document frequency over the whole corpus, is the one necessary prefix token.
A document is scanned once; only words that are some window's prefix token give candidates. A candidate
must leave room for the window before and after (position and length bounds) and is then compared word for word.

The benchmark is taken in blocks of at most BLOCK_WORDS words, each a bounded table on the executors. A document goes
through the blocks one after another where it was read, so no text is shuffled. Between two blocks the documents are written with what
was found so far, so a task holds one block's table however many there are; document frequencies are counted for FREQUENCY_BLOCKS blocks in one pass.

Defined cases: a null or wordless text has no words, no hits and the digest of the empty string; very long texts are
scanned whole; null, empty and wordless items have no window; repeated documents are separate rows, repeated items
count by their distinct item_id (null ids are left out of n_items and the digest); ties in rarity go to the first word
by bytes, then by place; empty tables give no rows or no hits; ids pass as they are; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import add_columns, cut

#: At most so many item words are broadcast at once (items are whole: one of more words has a block of its own).
BLOCK_WORDS = 200_000
#: Blocks whose words' frequencies are counted together.
FREQUENCY_BLOCKS = 16
#: Bytes of words as they are, capitals in lower case, all others as a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Index:
    """The windows of a block by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], window: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        self.places: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for item, ws in items:
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                run = ws[i : i + n]
                self.items[b" ".join(run)].add(item)
                rarest = min(range(n), key=lambda k: (frequency.get(run[k], 0), run[k], k))
                self.places[run[rarest]].add((rarest, n))
        self.items, self.places = dict(self.items), dict(self.places)

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged runs of hit words, and the items."""
        places, spans, items = self.places, [], set()
        for i in [i for i, w in enumerate(ws) if w in places]:
            for offset, n in places[ws[i]]:
                start = i - offset
                if start >= 0 and start + n <= len(ws) and (found := self.items.get(b" ".join(ws[start : start + n]))):
                    spans.append((start, start + n))
                    items |= found
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a (bounded) vocabulary is; over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                total.update(shared.value.intersection(words(text)))
        yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

    counted = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.toLocalIterator()}


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> Iterator[Index]:
    """The windows of the benchmark, in blocks of items of at most block_words words (a longer item is a block of its own)."""

    def read(batch: dict[str, list]) -> dict[str, list]:
        return {"words": [b" ".join(words(x)) for x in batch["text"]], "n": [len(words(x)) for x in batch["text"]]}

    sized = cut(add_columns(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), read, "words binary, n long", ["text"]).filter("n > 0").distinct(), "items")
    total, most = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n_blocks = -(-total // max(1, block_words - most)) if block_words > most else sized.count()
    block_of = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    items_of = lambda chosen: [(r["item"], bytes(r["words"]).split()) for r in sized.filter(chosen).toLocalIterator()]
    for first in range(0, n_blocks, FREQUENCY_BLOCKS):
        vocabulary: set[bytes] = set()
        for block in range(first, min(first + FREQUENCY_BLOCKS, n_blocks)):
            vocabulary.update(w for _, ws in items_of(block_of == block) for w in ws)
        frequency = document_frequency(docs, vocabulary)
        for block in range(first, min(first + FREQUENCY_BLOCKS, n_blocks)):
            yield Index(items_of(block_of == block), frequency, window)


def _spans(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in found]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs(doc_id, text) against benchmark(item_id, text)."""
    docs = docs.select("doc_id", "text")
    found = before_this = None
    for index in indexes(docs, benchmark, window, block_words):
        if found is not None:
            found = cut(found, "hits")
            before_this.unpersist()
        shared = before_this = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batch: dict[str, list], shared=shared) -> dict[str, list]:
            """Hits of this block, after those of the blocks before."""
            out: dict[str, list] = {"n_words": [], "spans": [], "items": []}
            before = zip(batch.get("spans") or [[]] * len(batch["text"]), batch.get("items") or [[]] * len(batch["text"]))
            for text, (old_spans, old_items) in zip(batch["text"], before):
                ws = words(text)
                spans, items = shared.value.find(ws)
                out["n_words"].append(len(ws))
                out["spans"].append(_spans(merged([*spans, *((s["start"], s["end"]) for s in old_spans)])))
                out["items"].append(sorted(items.union(old_items), key=lambda x: (x is None, x)))
            return out

        added = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
        if found is None:
            found = add_columns(docs.withColumn("said", F.col("text")), scan, added, ["text"]).withColumnRenamed("said", "text")
        else:
            found = add_columns(found.withColumn("said", F.col("text")), scan, added, ["text", "n_words", "spans", "items"]).withColumnRenamed("said", "text")
    if found is None:
        count = lambda batch: {"n_words": [len(words(x)) for x in batch["text"]], "spans": [[]] * len(batch["text"]), "items": [[]] * len(batch["text"])}
        found = add_columns(docs, count, "n_words long, spans array<struct<start:long,end:long>>, items array<string>", ["text"])
    named = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs(text, ...), with all their columns, that hold no window of benchmark(item_id, text)."""
    kept, before_this = docs, None
    for index in indexes(docs.select("text"), benchmark, window, block_words):
        if before_this is not None:
            kept = cut(kept, "clean")
            before_this.unpersist()
        shared = before_this = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.find(words(x))[0] for x in batch.column("text").to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(keep, docs.schema)
    return kept
