"""Exact substring dedup over all documents with suffix arrays of content-addressed shards.

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller id. Strings that
are equal must meet in one shard, so shards are cut by content: each window of `width` bytes belongs to the
smallest hash of its `mark`-byte substrings (its anchor), and the run of windows with one anchor is a piece of
text. Of identical texts only the one with the smallest id takes part; the others go whole. Then four steps:

1. Anchors of all documents, packed as arrays by hash range, show which occur in two documents or more.
2. Pieces under such anchors are cut from the texts, equal ones merged where they are cut, and packed by shard.
3. Each shard of distinct pieces gets a suffix array by induced sorting, to the depth of a window, and its permuted common prefixes;
   neighbours that agree on `width` bytes are one string, whose owner is the smallest id among them. Pieces none of whose
   windows has the hash of another window of the shard stay out of it: each of their windows is in them alone.
4. Owners go back to the places where pieces were cut; what a smaller id owns is removed.

Anchors with more than `hot` pieces in many contexts (a short common phrase) are dealt out window by window, so
no shard gathers them. Hashes only propose and place; every match is compared symbol by symbol.

Defined cases: null text is empty; a null id takes part neither as owner nor as copy; rows of equal id
don't remove each other's bytes; repeated rows are separate rows; texts shorter than `width` stay; very long texts
are hashed in stretches and compared whole; ties in the hash of an anchor go to the same piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from quillmill.llm.common import add_columns, cut, join_if_small
from quillmill.llm.suffixes import common_prefixes, suffix_array

_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))
#: Texts are hashed in stretches of about so many bytes.
STRETCH = 1 << 20
#: A piece has at most so many windows.
LONGEST = 64
FOUND = np.dtype([("key", "<u4"), ("start", "<u4"), ("n", "u1"), ("look", "u1")])
#: Set in n where an anchor is to be dealt out window by window; looks are eight bits of a piece, so many kinds at least.
CROWDED, LOOKS = 128, 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position."""
    step, length, power = (data.astype(np.uint64) + np.uint64(1)) * _C, 1, _B
    out, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                if out is None:
                    out = step
                else:
                    n = len(step) - done
                    out = out[:n] * power + step[done:]
                done += length
            if done == size:
                return mixed(out)
            step = step[:-length] * power + step[length:]
            power, length = power * power, length * 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    length, y = 1, x
    while length * 2 <= size:
        y, length = np.minimum(y[:-length], y[length:]), length * 2
    n = len(x) - size + 1
    return np.minimum(y[:n], y[size - length : size - length + n])


def anchors(texts: list[bytes], width: int, mark: int) -> tuple[np.ndarray, ...]:
    """(number of the text, anchor, first window, windows, look) of all pieces."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STRETCH):
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
        if len(data) >= width:
            lengths = np.fromiter(map(len, texts[i:j]), dtype=np.int64, count=j - i)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hashes = rolling(data, mark)
            least = sliding_min(hashes, width - mark + 1)
            text = np.repeat(np.arange(j - i), lengths)[: len(least)]
            at = np.arange(len(least))
            inside = at - begin[text] + width <= lengths[text]
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
            first = np.flatnonzero(new)
            first = first[inside[first]]
            last = np.append(np.flatnonzero(new)[1:], len(least))[np.searchsorted(np.flatnonzero(new), first)]
            n = np.minimum(last, begin[text[first]] + lengths[text[first]] - width + 1) - first
            parts = -(-n // LONGEST)
            which = np.repeat(np.arange(len(first)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = first[which] + nth * LONGEST
            count = np.minimum(LONGEST, n[which] - nth * LONGEST)
            look = (hashes[start] + hashes[start + count - 1 + width - mark]) & np.uint64(255)
            out.append((text[start] + i, mixed(least[start]), start - begin[text[start]], count, look))
        i = j
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(ids: np.ndarray, found: np.ndarray) -> bytes:
    """Pieces ordered by document as one compressed block."""
    cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    docs, counts = ids[cuts], np.diff(np.append(cuts, len(ids)))
    start = np.diff(found["start"].astype(np.int64), prepend=0).astype("<i4")
    raw = np.array([len(docs), len(ids)], "<i8").tobytes() + docs.astype("<i8").tobytes() + counts.astype("<i4").tobytes() + start.tobytes() + found["n"].tobytes() + found["look"].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw) + b"|" + found["key"].tobytes()


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    reader = zstandard.ZstdDecompressor().decompressobj()
    raw = reader.decompress(block)
    keys = reader.unused_data[1:]
    n_docs, n = np.frombuffer(raw, "<i8", 2)
    at = 16
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    counts = np.frombuffer(raw, "<i4", n_docs, at := at + 8 * n_docs)
    start = np.frombuffer(raw, "<i4", n, at := at + 4 * n_docs)
    found = np.empty(n, FOUND)
    found["start"], found["n"], found["key"] = np.cumsum(start, dtype=np.int64), np.frombuffer(raw, "u1", n, at + 4 * n), np.frombuffer(keys, "<u4")
    found["look"] = np.frombuffer(raw, "u1", n, at + 5 * n)
    return np.repeat(docs, counts), found


def repeated_anchors(docs: DataFrame, width: int, mark: int, n_ranges: int, n_buckets: int, hot: int) -> DataFrame:
    """bucket (of doc_id), range, n, found (packed): the pieces whose anchor is in two documents or more."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text, anchor, start, n, look = anchors(list(frame["text"]), width, mark)
            ids, part = frame["doc_id"].to_numpy()[text], ((anchor >> np.uint64(32)) % np.uint64(n_ranges)).astype(np.int64)
            found = np.empty(len(text), FOUND)
            found["key"], found["start"], found["n"], found["look"] = anchor & np.uint64(0xFFFFFFFF), start, n, look
            order = np.argsort(part, kind="stable")
            part, ids, found = part[order], ids[order], found[order]
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            bounds = list(zip(np.concatenate([[0], cuts]), np.append(cuts, len(part)))) if len(part) else []
            yield pd.DataFrame({"range": [int(part[a]) for a, _ in bounds], "block": [_packed(ids[a:b], found[a:b]) for a, b in bounds]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = [_unpacked(b) for b in frame["block"]]
        ids, found = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        order = np.argsort(found["key"], kind="stable")
        ids, found = ids[order], found[order]
        cuts = np.concatenate([[0], np.flatnonzero(found["key"][1:] != found["key"][:-1]) + 1])
        shared = np.repeat(np.minimum.reduceat(ids, cuts) < np.maximum.reduceat(ids, cuts), np.diff(np.append(cuts, len(ids))))
        size = np.diff(np.append(cuts, len(ids)))
        for c in np.flatnonzero(size > hot):
            if len(np.unique(found["look"][cuts[c] : cuts[c] + size[c]])) >= LOOKS:
                found["n"][cuts[c] : cuts[c] + size[c]] |= CROWDED
        ids, found = ids[shared], found[shared]
        bucket = ids % n_buckets
        order = np.lexsort((ids, bucket))
        ids, found, bucket = ids[order], found[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1]) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(ids))[: len(cuts)]
        return pd.DataFrame({"bucket": bucket[cuts], "range": frame["range"].iloc[0], "n": ends - cuts, "found": [_packed(ids[a:b], found[a:b]) for a, b in zip(cuts, ends)]})

    packed = docs.mapInPandas(pack, "range long, block binary")
    return packed.groupBy("range").applyInPandas(meet, "bucket long, range long, n long, found binary")


def _pressed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _back(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


@F.pandas_udf(BinaryType())
def _press(texts: pd.Series) -> pd.Series:
    return texts.map(_pressed)


def _shard_rows(pieces: list[bytes], shard: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, txs: np.ndarray) -> Iterator[tuple]:
    """(shard, pieces, places): distinct pieces with smallest and largest id, and where each occurs."""
    order = np.argsort(shard, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        at, known = order[a:b], {}
        of = np.fromiter((known.setdefault(pieces[i], len(known)) for i in at), dtype=np.int64, count=b - a)
        least, most = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(least, of, ids[doc[at]])
        np.maximum.at(most, of, ids[doc[at]])
        sizes = np.fromiter(map(len, known), dtype=np.uint8, count=len(known))
        docs, local = np.unique(doc[at], return_inverse=True)
        packed = np.array([len(known)], "<i8").tobytes() + least.tobytes() + most.tobytes() + sizes.tobytes() + b"".join(known)
        head = np.array([len(docs), b - a], "<i8").tobytes() + ids[docs].tobytes() + txs[docs].tobytes()
        places = head + of.astype("<u4").tobytes() + local.astype("<u4").tobytes() + start[at].astype("<u4").tobytes()
        yield int(shard[order[a]]), _pressed(packed), _pressed(places)


def cut_pieces(docs: DataFrame, found: DataFrame, width: int, n_shards: int, n_buckets: int) -> DataFrame:
    """uid, shard, pieces, places of docs(doc_id, tx, text), a bucket at a time; text is compressed."""

    def pieces(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out, shards, doc, start = [], [], [], []
        docs = docs.sort_values("doc_id", kind="stable").reset_index(drop=True)
        ids, txs = docs["doc_id"].to_numpy(np.int64), docs["tx"].to_numpy(np.int64)
        texts = [_back(x) for x in docs["text"]]
        for which, block in zip(found["range"], found["found"]):
            of, rows = _unpacked(block)
            low, high = np.searchsorted(ids, of, side="left").tolist(), np.searchsorted(ids, of, side="right").tolist()
            shard = (mixed(rows["key"].astype(np.uint64) | np.uint64(int(which) << 32)) % np.uint64(n_shards)).tolist()
            for a, b, at, first, n in zip(low, high, shard, rows["start"].tolist(), rows["n"].tolist()):
                single = n & CROWDED
                for i in range(a, b):
                    text = texts[i]
                    for k in range(n & ~CROWDED if single else 1):
                        piece = text[first + k : first + k + width] if single else text[first : first + n + width - 1]
                        if len(piece) >= width:
                            out.append(piece)
                            shards.append(zlib.crc32(piece) % n_shards if single else at)
                            doc.append(i)
                            start.append(first + k)
        rows = list(_shard_rows(out, np.array(shards, np.int64), np.array(doc, np.int64), np.array(start, np.int64), ids, txs)) if out else []
        result = pd.DataFrame(rows, columns=["shard", "pieces", "places"])
        result.insert(0, "uid", uuid.uuid4().hex)
        return result

    bucketed = docs.withColumn("bucket", F.pmod("doc_id", F.lit(n_buckets)))
    return bucketed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(pieces, "uid string, shard long, pieces binary, places binary")


def owners_of(pieces: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece the smallest id that holds each of its windows, from one suffix array over all pieces."""
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    t = np.frombuffer(b"\x00".join(pieces) + b"\x00\x00", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    stops = np.cumsum(lengths + 1) - 1
    t[stops], t[-1] = 1, 0
    ends = np.append(np.repeat(stops, lengths + 1), len(t) - 1)
    array = suffix_array(t, 258, width).astype(np.int64)
    agree = common_prefixes(t, array, ends, width)
    whole = array[ends[array] - array >= width]
    cuts = np.flatnonzero(agree[whole] < width)
    of = np.append(np.repeat(np.arange(len(pieces)), lengths + 1), 0)
    owner = np.empty(len(t), dtype=np.int64)
    if len(whole):
        owner[whole] = np.repeat(np.minimum.reduceat(least[of[whole]], cuts), np.diff(np.append(cuts, len(whole))))
    return [owner[stop - n : stop - width + 1] for stop, n in zip(stops, lengths)]


RUN = np.dtype([("piece", "<u4"), ("a", "u1"), ("b", "u1"), ("owner", "<i8")])


def alone(pieces: list[bytes], width: int) -> np.ndarray:
    """True where no window of a piece has the hash of another window, so that none can be in another piece."""
    windows = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) - width + 1
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(pieces)), windows)
    hashes = rolling(np.frombuffer(b"".join(pieces), dtype=np.uint8), width)[np.arange(len(of)) + of * (width - 1)]
    ordered = np.sort(hashes)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.ones(len(pieces), dtype=bool)
    twice = again[np.minimum(np.searchsorted(again, hashes), len(again) - 1)] == hashes
    return ~np.logical_or.reduceat(twice, first)


def runs_of(pieces: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one owner, by piece, and where each piece's begin. Only pieces that can share a window go into the suffix array."""
    some = np.flatnonzero(~alone(pieces, width))
    owners = owners_of([pieces[i] for i in some], least[some], width) if len(some) else []
    windows = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) - width + 1
    n = np.ones(len(pieces), dtype=np.int64)
    n[some] = windows[some]
    # One entry for a piece that stands alone, one for each window of the others.
    of = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    owner, end = least[of], windows[of]
    among = np.zeros(len(pieces), dtype=bool)
    among[some] = True
    if len(some):
        owner[among[of]], end[among[of]] = np.concatenate(owners), at[among[of]] + 1
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (owner[1:] != owner[:-1])))
    runs = np.empty(len(new), RUN)
    runs["piece"], runs["a"], runs["owner"] = of[new], at[new], owner[new]
    runs["b"] = end[np.append(new[1:], len(of)) - 1]
    return runs, np.searchsorted(of[new], np.arange(len(pieces) + 1))


def find_owners(packed: DataFrame, width: int) -> DataFrame:
    """uid, shard, runs: windows a to b of pieces that a smaller id than the largest of their places owns."""

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        parts = []
        for block in frame["pieces"]:
            raw = _back(block)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            least, most = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
            ends = 8 + 17 * n + np.cumsum(np.frombuffer(raw, "u1", n, 8 + 16 * n), dtype=np.int64)
            starts = np.concatenate([[8 + 17 * n], ends[:-1]])
            of = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.int64, count=n)
            parts.append((of, least, most))
        least = np.full(len(known), np.iinfo(np.int64).max)
        for of, low, _ in parts:
            np.minimum.at(least, of, low)
        runs, begin = runs_of(list(known), least, width)
        replies = []
        for of, _, most in parts:
            n = begin[of + 1] - begin[of]
            which = np.repeat(np.arange(len(of)), n)
            reply = runs[np.arange(len(which)) + np.repeat(begin[of] - np.cumsum(n) + n, n)]
            reply["piece"] = which
            replies.append(_pressed(reply[reply["owner"] < most[which]].tobytes()))
        return pd.DataFrame({"uid": frame["uid"], "shard": frame["shard"], "runs": replies})

    return packed.select("uid", "shard", "pieces").groupBy("shard").applyInPandas(shard, "uid string, shard long, runs binary")


def spans_of(answered: DataFrame, width: int) -> DataFrame:
    """doc_id, tx, start, end of what is removed, from (places, runs)."""

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for places, runs in zip(frame["places"], frame["runs"]):
                raw, runs = _back(places), np.frombuffer(_back(runs), RUN)
                n_docs, n = (int(x) for x in np.frombuffer(raw, "<i8", 2))
                ids, txs = np.frombuffer(raw, "<i8", n_docs, 16), np.frombuffer(raw, "<i8", n_docs, 16 + 8 * n_docs)
                of, doc, start = (np.frombuffer(raw, "<u4", n, 16 + 16 * n_docs + 4 * n * k).astype(np.int64) for k in range(3))
                order = np.argsort(of, kind="stable")
                low, high = np.searchsorted(of[order], runs["piece"], side="left"), np.searchsorted(of[order], runs["piece"], side="right")
                run = np.repeat(np.arange(len(runs)), high - low)
                at = order[np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[run]]
                gone = runs["owner"][run] < ids[doc[at]]
                run, at = run[gone], at[gone]
                out.append(pd.DataFrame({"doc_id": ids[doc[at]], "tx": txs[doc[at]], "start": start[at] + runs["a"][run], "end": start[at] + runs["b"][run] - 1 + width}))
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": [], "tx": [], "start": [], "end": []}, dtype="int64")

    return answered.select("places", "runs").mapInPandas(spans, "doc_id long, tx long, start long, end long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@F.pandas_udf(SPANS)
def _merge(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in found])] for found in spans])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, mark: int = 16,
    range_bytes: int = 64 << 20, shard_bytes: int = 4 << 20, hot: int = 100_000, with_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the text that is left) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("tx", F.xxhash64("text"))
    takes_part = texts.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    keys = cut(takes_part.select("doc_id", "tx", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha")), "keys")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = max(tasks, -(-total // range_bytes))

    least = keys.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    copies = cut(keys.join(least, "sha").filter(F.col("doc_id") > F.col("least")).select("doc_id", "tx", "n").distinct(), "copies")
    n_copies = copies.count()
    first = join_if_small(takes_part, copies.select("doc_id", "tx"), ["doc_id", "tx"], "left_anti", 24 * n_copies)
    n_buckets = max(tasks, -(-total // shard_bytes)) | 1
    found = cut(repeated_anchors(first, width, mark, n_ranges, n_buckets, hot), "found")
    n_found = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_shards = max(tasks, -(-n_found * (width + 20) // shard_bytes))
    packed = cut(cut_pieces(first.withColumn("text", _press("text")), found, width, n_shards, n_buckets), "pieces")

    answered = packed.select("uid", "shard", "places").join(find_owners(packed, width), ["uid", "shard"])
    gone = spans_of(answered, width).groupBy("doc_id", "tx").agg(F.collect_list(F.struct("start", "end")).alias("gone")).withColumn("gone", _merge("gone"))
    whole = copies.select("doc_id", "tx", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))).alias("gone"))
    gone = cut(gone.unionByName(whole), "gone")
    size = gone.agg(F.coalesce(F.sum(24 + 16 * F.size("gone")), F.lit(0))).first()[0]
    marked = join_if_small(texts, gone, ["doc_id", "tx"], "left", size)

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text

    def strip(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for text, found in zip(batch["text"], batch["gone"]):
            spans = merged([(s["start"], s["end"]) for s in found]) if found is not None else []
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            row = (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans])
            rows.append((*row, kept) if with_text else row)
        return dict(zip(names, zip(*rows) if rows else [[]] * len(names)))

    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * with_text
    return add_columns(marked.select("doc_id", "text", "gone"), strip, added, ["text", "gone"])
