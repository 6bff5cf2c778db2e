"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document has a fractional number of copies, the ratio of its source's target to its source's size.
The whole part is taken as it is. The fractional parts are rounded dependently: two documents at a time,
word mass moves from one to the other, in a direction drawn so that each expectation stays, until one of
them has all or none of its words. The one that is still fractional meets the next. Chunks of a source fold
in parallel, the largest documents first; what each leaves over meets again one level up, a tree of `fanin` branches,
down to one leftover document a source. That one is rounded to the nearer side, and what it misses is made up by
rounding smaller documents of the last fold to the other side, the largest that fit first. So a source's taken words
differ from its target by less than the smallest document that could be turned; for the few documents of this last
step, rounded without a draw, the expectation isn't kept.

Draws are hashes of the documents, so reruns agree. Rows with one id, source and size can't be told apart; they are counted first and then numbered, and
the numbers spread them over the chunks like other documents, however many they are.

Defined cases: null text and texts without words have size 0 and take 0; a null source is a source of its
own, ordered last; a null doc_id is an ordinary value, ids may be of any type; rows that repeat are separate documents, and
ties in size are ordered by hash; texts of any length count whole; an empty table gives an empty result; columns other
than the three that are named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import cut, join_dimension

#: Words are maximal runs without these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that one row of the counts stands for at most when they are laid out again.
BLOCK = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """One row a source: source_size, n_docs, target.

    Targets share all words by weight; a source stops at max_copies times its size and what it can't use is
    shared again among the others. With sources in order of cap per weight that is one water level, the
    largest of (words left) / (weight left) over the order; no loop is needed. One row a source goes
    through the window, never the documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything)))
    return by.select("source", "source_size", "n_docs", "target")


def _meet(seed: str):
    """The step of the fold: the document left over so far (acc.rest) meets the next one."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        a_room, b_room = a["size"] - a["mass"], b["size"] - b["mass"]
        d_up, d_down = F.least(a_room, b["mass"]), F.least(a["mass"], b_room)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), a["h"], b["h"]), 11) / F.lit(float(1 << 53))
        up = u * (d_up + d_down) < d_down
        a_ends = F.when(up, a_room <= b["mass"]).otherwise(a["mass"] <= b_room)
        ended = F.when(a_ends, F.struct(a["doc_id"].alias("doc_id"), a["size"].alias("size"), up.cast("int").alias("x"))).otherwise(
            F.struct(b["doc_id"].alias("doc_id"), b["size"].alias("size"), (~up).cast("int").alias("x"))
        )
        moved = F.when(up & a_ends, b["mass"] - a_room).when(up, a["mass"] + b["mass"]).when(a_ends, b["mass"] + a["mass"]).otherwise(a["mass"] - b_room)
        stays = F.when(a_ends, b).otherwise(a)
        rest = F.struct(stays["less"].alias("less"), stays["h"].alias("h"), stays["doc_id"].alias("doc_id"), stays["size"].alias("size"), moved.alias("mass"))
        return F.struct(F.concat(acc["done"], F.array(ended)).alias("done"), rest.alias("rest"))

    return step


def _closed(f: str) -> Column:
    """All documents of the last fold: its leftover is rounded, and what that misses is made up by smaller documents, the largest first."""
    rest = F.col(f"{f}.rest")
    x = (rest["mass"] * 2 >= rest["size"]).cast("int")
    last = F.struct(rest["doc_id"].alias("doc_id"), rest["size"].alias("size"), x.alias("x"))
    ordered = F.sort_array(F.transform(F.col(f"{f}.done"), lambda d: F.struct((-d["size"]).alias("less"), d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["x"].alias("x"))))
    start = F.struct((x * rest["size"] - rest["mass"]).cast("double").alias("over"), F.array(last).alias("all"))

    def step(acc: Column, d: Column) -> Column:
        over = acc["over"]
        flip = F.when(d["x"] == 1, over >= d["size"]).otherwise(-over >= d["size"])
        moved = F.when(flip & (d["x"] == 1), over - d["size"]).when(flip, over + d["size"]).otherwise(over)
        kept = F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), F.when(flip, 1 - d["x"]).otherwise(d["x"]).alias("x"))
        return F.struct(moved.alias("over"), F.concat(acc["all"], F.array(kept)).alias("all"))

    return F.aggregate(ordered, start, step)["all"]


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with a number `nth` within equal rows. What repeats often is laid out in blocks, which many tasks share."""
    counted = cut(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "counted")
    few = counted.filter(F.col("n") <= BLOCK).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    many = counted.filter(F.col("n") > BLOCK).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    last = F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1
    return few.unionByName(many.repartition("doc_id", "size", "block").select("doc_id", "source", "size", F.explode(F.sequence(F.col("block") * BLOCK, last)).alias("nth")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), max_copies: int = 3, fanin: int = 256, seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    sizes = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sizes",
    )
    targets = cut(source_targets(sizes, weights, max_copies), "targets")
    rated = join_dimension(_numbered(sizes), targets, "source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    rated = rated.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio")).withColumn("part", F.col("ratio") - F.col("whole"))
    same = ["source", "source_size", "target", "whole"]
    fractional = (F.col("part") > 1e-12) & (F.col("size") > 0)
    out = rated.filter(~fractional).select(*same, "doc_id", "size", F.lit(0).alias("x"))

    document = F.struct((-F.col("size")).alias("less"), F.xxhash64(F.lit(seed), "doc_id", "size", "nth").alias("h"), "doc_id", "size", (F.col("part") * F.col("size")).alias("mass"))
    chunks = F.greatest(F.ceil(F.col("n_docs") / fanin), F.lit(1))
    level = rated.filter(fractional).select(*same, document.alias("d"), F.pmod(F.xxhash64(F.lit(f"{seed} chunk"), "doc_id", "size", "nth"), chunks).alias("chunk"))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    n = max(1, math.ceil(most / fanin))
    # The last step needs ordinary documents besides what chunks leave over: each source's first chunk waits for it.
    waiting = level.filter("chunk = 0") if n > 1 else None
    level = level.filter("chunk > 0") if n > 1 else level
    empty = F.array().cast(f"array<struct<doc_id:{sizes.schema['doc_id'].dataType.simpleString()},size:long,x:int>>")
    while True:
        met = level.groupBy(*same, "chunk").agg(F.sort_array(F.collect_list("d")).alias("ds"))
        first = F.struct(empty.alias("done"), F.element_at("ds", 1).alias("rest"))
        met = cut(met.select(*same, "chunk", F.aggregate(F.slice("ds", F.lit(2), F.size("ds")), first, _meet(seed)).alias("f")), "level")
        done = _closed("f") if waiting is None and n == 1 else F.col("f.done")
        out = out.unionByName(met.select(*same, F.explode(done).alias("e")).select(*same, "e.*"))
        if waiting is None and n == 1:
            break
        n = math.ceil(n / fanin)
        level = met.select(*same, F.col("f.rest").alias("d"), F.floor(F.col("chunk") / fanin).alias("chunk"))
        if n == 1:
            level, waiting = level.unionByName(waiting), None
    copies = F.col("whole") + F.col("x")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
