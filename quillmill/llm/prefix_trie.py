"""Conversation prefix trie: every distinct beginning of the conversations, with what it has below it.

Each turn is a 128-bit digest of its role and text; a conversation is the string of its turns' digests. Distinct
conversations are sorted by ranges into blocks. LCP[i], the turns that conversation i shares with the one before it, gives
the trie as a Cartesian tree: the maximal run of conversations around i with no smaller LCP inside is a branching node of
depth LCP[i]. Its ends are i's nearest smaller values on both sides:

* every block finds them for its own entries with a stack, and reports only the entries that it can't close: the distinct
  minima towards either end, with sums and least ids up to there (pass 1, one row a block);
* an open entry's nearest smaller value lies in the nearest block whose minimum is smaller. Block minima are one
  number a block, so every task has them all; the target block's report has the place (pass 2, `resolve`);
* entries with equal LCP and the same left end are one node, emitted by the first block that has one of them;
* pass 3 reads each block again and emits its nodes, expanding the depths that a branching node or a leaf spans up to
  its parent. Counts, leaves and saved bytes are differences of running sums at a node's ends.

Sizes: a task holds one block (BLOCK distinct conversations or BLOCK_BYTES of digests). Open entries are at most blocks times shared
depth. Copies are one row from the first aggregation on; the ids of the copies of one conversation pass through a task as a
stream of CHUNK-sized pieces. The turns of one conversation (their digests, 16 bytes each) meet in one row.

Defined cases: rows without conversation id take no part; null role or text is empty; turns are ordered by turn (null
first), then role and text, and repeated rows are turns of their own; empty and very long texts are digested whole; with
c % 5 as SQL has it, conversations -4 to 4 share the head of conversation 0; a conversation left without turns is a
member of the root only; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import cut, join_if_small

#: Bytes of a turn's digest; distinct conversations and bytes of digests in a block.
DIGEST = 16
BLOCK, BLOCK_BYTES = 20_000, 8 << 20
#: Turns numbered at once, and ids of copies that are joined at once.
STRETCH, CHUNK = 64, 1024
EMPTY = hashlib.sha256(b"").hexdigest()
#: What is summed over conversations: conversations, leaves, bytes of all turns (times copies), bytes of turns that the one before doesn't share.
SUMS = 4
_REPORT = "struct<pos: array<long>, lcp: array<long>, sums: array<long>, least: array<long>>"
SUMMARY = f"block int, n long, low long, least long, sums array<long>, before {_REPORT}, after {_REPORT}, open array<struct<d: long, side: int, k: long>>"
FOUND = "block int, d long, side int, k long, l long, seen long, top long, up_block int, up_side int, conv long, n long, leaves long, weight long, own long"
CHAINS = "conv_id long, top long, parent long, n_convs long, n_children long, n_leaves long, saved array<long>, ends_sha256 string"


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns (digest d, bytes b) in order, from conv_id, turn, role, text."""
    said = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *said).filter("conv_id IS NOT NULL").withColumn("part", F.floor(F.col("turn") / STRETCH))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST))
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.select("conv_id", "part", at.alias("at"), digest.alias("d"), F.octet_length("text").cast("long").alias("b"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "d", "b"))), lambda x: F.struct(x["d"].alias("d"), x["b"].alias("b")))
    parts = rows.groupBy("conv_id", "part").agg(in_order.alias("turns"))
    return parts.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "turns"))), lambda x: x["turns"])).alias("turns"))


def rebuilt(turns: DataFrame, of: int = 5, most: int = 9) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % of, then c's own turns after its first h."""
    heads = turns.filter(F.col("conv_id") % of == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % of).join(heads, "base", "left")
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def ends(rows: DataFrame) -> DataFrame:
    """uid, ends_sha256: digest of the comma-joined ids of each uid; rows(uid, conv_id)."""
    parts = rows.groupBy("uid", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for frame in frames:
            done = []
            for uid, ids in zip(frame["uid"], frame["ids"]):
                if uid != last:
                    if last is not None:
                        done.append((last, sha.hexdigest()))
                    last, sha = uid, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["uid", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, sha.hexdigest())], columns=["uid", "ends_sha256"])

    return parts.repartition("uid").sortWithinPartitions("uid", "chunk").select("uid", "ids").mapInPandas(stream, "uid string, ends_sha256 string")


def blocks_of(convs: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Distinct conversations in order: block, uid, key, bytes, n, conv (least id), ends_sha256, next and previous key at the ends of blocks."""
    keyed = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), "")).alias("key"), F.transform("turns", lambda t: t["b"]).alias("bytes"))
    keyed = cut(keyed.withColumn("uid", F.sha2("key", 256)), "keyed")
    units = keyed.groupBy("uid", "key").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "bytes")).alias("x"))
    units = cut(units.select("uid", "key", "n", F.col("x.conv_id").alias("conv"), F.col("x.bytes").alias("bytes")).join(ends(keyed.select("uid", "conv_id")), "uid"), "units")
    size = units.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key") + 8 * F.size("bytes")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // block), -(-size["bytes"] // block_bytes))
    placed = cut(units.repartitionByRange(n_blocks, "key").withColumn("block", F.spark_partition_id()), "blocks")
    edges = placed.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"))  # one row a block
    row = Window.orderBy("block")
    edges = cut(edges.select("block", F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after")), "edges")
    edge_bytes = edges.agg(F.coalesce(F.sum(F.length("before") + F.length("after")), F.lit(0))).first()[0]
    return join_if_small(placed, edges, ["block"], "inner", edge_bytes)


def shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two conversations begin with alike; -1 where there is none to compare."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n // DIGEST
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // DIGEST


class Block:
    """A block's conversations in order, their LCPs (the last one being that of the next block's first) and nearest smaller values."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.iloc[np.array(sorted(range(len(frame)), key=frame["key"].tolist().__getitem__), int)]
        keys = frame["key"].tolist()
        none = lambda x: None if x is None or x is pd.NA or isinstance(x, float) else x
        chain = [none(frame["before"].iloc[0]), *keys, none(frame["after"].iloc[0])]
        self.m = len(keys)
        self.lcp = np.array([shared(a, b) for a, b in zip(chain[:-1], chain[1:])])
        self.length = np.array([len(k) // DIGEST for k in keys])
        self.bytes = [np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in frame["bytes"]]
        self.n, self.conv, self.ends = frame["n"].to_numpy(np.int64), frame["conv"].to_numpy(np.int64), frame["ends_sha256"].tolist()
        self.leaf = self.length > self.lcp[1:]
        total = np.array([b[-1] for b in self.bytes])
        self.own = total - np.array([b[max(d, 0)] for b, d in zip(self.bytes, self.lcp)])
        each = np.stack([self.n, self.leaf, self.n * total, self.own])
        self.sums = np.concatenate([np.zeros((SUMS, 1), np.int64), np.cumsum(each, axis=1)], axis=1)
        self.left, self.right, self.first = self.smaller()
        self.heads = np.flatnonzero((self.first == np.arange(self.m + 1)) & (self.lcp >= 0))
        #: Entries of each node, those of the next block left out.
        self.count = np.bincount(self.first[: self.m], minlength=self.m + 1)

    def smaller(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each LCP the first of the equal ones with nothing smaller between; for those the nearest smaller ones before (-1: open) and behind (m + 1: open)."""
        lcp, m = self.lcp.tolist(), self.m
        left, right, first, stack = [-1] * (m + 1), [m + 1] * (m + 1), list(range(m + 1)), []
        for i, d in enumerate(lcp):
            while stack and lcp[stack[-1]] > d:
                right[first[stack.pop()]] = i
            if stack and lcp[stack[-1]] == d:
                first[i] = first[stack.pop()]
            else:
                left[i] = stack[-1] if stack else -1
            stack.append(i)
        return np.array(left), np.array(right), np.array(first)

    def side(self, i: int) -> int:
        """1: the node of entry i begins in an earlier block, 2: it goes on in a later one, 3: both, 0: it is whole here."""
        return int(self.left[i] < 0) + 2 * int(self.right[i] > self.m)


def _minima(values: np.ndarray) -> np.ndarray:
    """Places of values smaller than all before them."""
    return np.flatnonzero(np.append(True, values[1:] < np.minimum.accumulate(values)[:-1]))


def summary(frame: pd.DataFrame) -> pd.DataFrame:
    """Pass 1: one row a block; its minima towards both ends with the sums and the least id up to there, and its open nodes."""
    b = Block(frame)
    own = b.lcp[: b.m]
    report = lambda at, least: {"pos": at.tolist(), "lcp": own[at].tolist(), "sums": b.sums[:, at].T.ravel().tolist(), "least": least[at].tolist()}
    until = np.append(np.iinfo(np.int64).max, np.minimum.accumulate(b.conv))
    before, after = report(_minima(own), until), report(b.m - 1 - _minima(own[::-1]), np.minimum.accumulate(b.conv[::-1])[::-1])
    marks = [{"d": int(b.lcp[i]), "side": b.side(i), "k": int(b.count[i])} for i in b.heads if b.side(i)]
    one = {"block": frame["block"].iloc[0], "n": b.m, "low": own.min(), "least": b.conv.min(), "sums": b.sums[:, -1].tolist(), "before": before, "after": after, "open": marks}
    return pd.DataFrame({k: [v] for k, v in one.items()})


class Minima:
    """Of every block where it starts, its least LCP and least id, and the sums before it. Blocks are meant by place here."""

    def __init__(self, rows: list):
        self.block = np.array([r["block"] for r in rows], np.int64)
        self.low = np.array([r["low"] for r in rows], np.int64)
        self.start = np.append(0, np.cumsum([r["n"] for r in rows]))
        self.sums = np.append(np.zeros((1, SUMS), np.int64), np.cumsum(np.array([r["sums"] for r in rows], np.int64).reshape(-1, SUMS), axis=0), axis=0)
        self.levels = [np.array([r["least"] for r in rows], np.int64)]  # levels[j][i]: least id of the blocks i to i + 2**j - 1
        while 2 << (len(self.levels) - 1) <= len(rows):
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-half], x[half:]))

    def at(self, block: int) -> int:
        return int(np.searchsorted(self.block, block))

    def target(self, i: int, d: int, step: int) -> int:
        """The nearest block from i on with an LCP under d, backwards (step -1) or forwards (1); -1 or the number of blocks if none has."""
        width = 64
        while 0 <= i < len(self.low):
            near = self.low[max(0, i - width + 1) : i + 1][::-1] if step < 0 else self.low[i : i + width]
            if len(found := np.flatnonzero(near < d)):
                return i + step * int(found[0])
            i, width = i + step * len(near), 2 * width
        return i

    def least_between(self, a: int, b: int) -> int:
        """Least id of the blocks a to b - 1."""
        if a >= b:
            return np.iinfo(np.int64).max
        j = (b - a).bit_length() - 1
        return int(min(self.levels[j][a], self.levels[j][b - (1 << j)]))


def resolve(open_nodes: DataFrame, reports: DataFrame, minima: Minima) -> DataFrame:
    """Pass 2: ends, sums and least id of the open nodes(block, d, side, k), by way of the reports of the blocks where they end."""

    def aim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = [minima.at(x) for x in frame["block"]]
            ends = [(minima.target(i - (s & 1), d, -1), minima.target(i + (s >> 1), d, 1)) for i, d, s in zip(at, frame["d"], frame["side"])]
            yield frame.assign(**{c: [int(minima.block[e[j]]) if e[j] < len(minima.block) else -1 for e in ends] for j, c in enumerate(("a", "z"))})

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame.to_dict("records"):
                d, rep = x["d"], x["after"]
                a, z = minima.at(x["a"]), len(minima.block) if x["z"] < 0 else minima.at(x["z"])
                i = next(i for i, v in enumerate(rep["lcp"]) if v < d)
                l, seen, least = minima.start[a] + rep["pos"][i], rep["lcp"][i], min(rep["least"][i], minima.least_between(a + 1, z))
                first, last, behind = minima.sums[a] + rep["sums"][SUMS * i : SUMS * (i + 1)], minima.sums[z], -1
                if x["z"] >= 0:
                    rep = x["before"]
                    i = next(i for i, v in enumerate(rep["lcp"]) if v < d)
                    behind, least, last = rep["lcp"][i], min(least, rep["least"][i]), last + rep["sums"][SUMS * i : SUMS * (i + 1)]
                up = (x["a"], 2) if seen >= behind else (x["z"], 1)  # an open node of that block is the parent
                out.append((x["block"], d, x["side"], x["k"], int(l), int(seen), int(max(seen, behind)), *up, int(least), *(int(v) for v in last - first)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    aimed = open_nodes.mapInPandas(aim, "block int, d long, side int, k long, a int, z int")
    of = lambda c, side: reports.select(F.col("block").alias(c), side)
    found = cut(aimed.join(of("a", "after"), "a").join(of("z", "before"), "z", "left").mapInPandas(close, FOUND), "found")
    nodes = found.groupBy("l", "d").agg(F.min("block").alias("first_block"), F.sum("k").alias("entries"))  # entries of equal LCP and left end are one node
    sides = F.when(F.col("side") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("side"))
    parents = found.select(F.col("block").alias("up_block"), F.col("d").alias("top"), F.explode(sides).alias("up_side"), F.col("conv").alias("above"))
    return cut(found.join(nodes, ["l", "d"]).join(parents, ["up_block", "top", "up_side"], "left").withColumn("emits", F.col("first_block") == F.col("block")), "open_nodes")


def chains(frame: pd.DataFrame, known: pd.DataFrame, start: int) -> pd.DataFrame:
    """Pass 3: the branching nodes and leaves of a block, each with saved bytes for all depths up to its parent; known: its open nodes as resolved."""
    b = Block(frame)
    open_ones = {(x["d"], x["side"]): x for x in known.to_dict("records")}
    lcp, nodes, rows = b.lcp.tolist(), {}, []
    for i in b.heads.tolist():
        d = lcp[i]
        if side := b.side(i):
            x = open_ones[d, side]
            nodes[i] = (x["l"] - start, x["conv"], x["seen"], x["top"], (x["n"], x["leaves"], x["weight"], x["own"]), x["entries"], x["emits"], x["above"])
        else:
            l, r = int(b.left[i]), int(b.right[i])
            nodes[i] = (l, int(b.conv[l:r].min()), lcp[l], max(lcp[l], lcp[r]), (b.sums[:, r] - b.sums[:, l]).tolist(), int(b.count[i]), True, None)

    def parent(l: int, r: int) -> int | None:
        """Least id of the node right above an interval whose ends are entries l and r."""
        i = l if lcp[l] >= lcp[r] else r
        return nodes[b.first[i]][1] if lcp[i] >= 0 else None

    def chain(conv, above, top, bottom, sums, children, base, seen, sha):
        n, leaves, weight, own = sums
        up_to = base[np.maximum(np.arange(top, bottom), 0)]  # bytes of the turns before each depth
        rows.append((conv, top, above, n, children, leaves, weight - own - int(base[max(seen, 0)]) - (n - 1) * up_to, sha))

    for i, (l, conv, seen, top, sums, entries, emits, above) in nodes.items():
        if emits:
            d, unit = lcp[i], min(i, b.m - 1)
            at_end = 0 <= l < b.m and b.length[l] == d  # the first conversation may end here
            above = (None if pd.isna(above) else int(above)) if b.side(i) else parent(l, int(b.right[i]))
            chain(conv, above, top, d, sums, entries + 1 - int(at_end), b.bytes[unit], seen, b.ends[l] if at_end else EMPTY)
    for u in np.flatnonzero(b.leaf).tolist():
        n, total = int(b.n[u]), int(b.bytes[u][-1])
        chain(int(b.conv[u]), parent(u, u + 1), max(lcp[u], lcp[u + 1]), int(b.length[u]), (n, 1, n * total, int(b.own[u])), 0, b.bytes[u], lcp[u], b.ends[u])
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHAINS.split(", ")])
    return out.assign(parent=pd.array([None if x is None else int(x) for x in [r[2] for r in rows]], "Int64"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    placed = cut(blocks_of(rebuilt(cut(turns_of(conversations), "turns")), block, block_bytes), "placed")
    reports = cut(placed.groupBy("block").applyInPandas(lambda frame: summary(frame), SUMMARY), "reports")
    minima = Minima(reports.select("block", "n", "low", "least", "sums").orderBy("block").collect())  # one row a block
    known = resolve(reports.select("block", F.explode("open").alias("x")).select("block", "x.*"), reports, minima)

    def emit(key: tuple, frame: pd.DataFrame, open_nodes: pd.DataFrame) -> pd.DataFrame:
        return chains(frame, open_nodes, int(minima.start[minima.at(key[0])])) if len(frame) else pd.DataFrame({c.split()[0]: [] for c in CHAINS.split(", ")})

    found = placed.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(emit, CHAINS)
    size = F.size("saved")
    depths = found.select("*", size.alias("size"), F.posexplode("saved").alias("k", "saved_tokens"))
    last = F.col("k") == F.col("size") - 1
    return depths.select(
        "conv_id", (F.col("top") + 1 + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.when(last, F.col("ends_sha256")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
