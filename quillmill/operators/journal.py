"""File actions as a journal: planned with stable ids, executed by partitions, each with one outcome; a rerun does what has none.

A plan is a table of actions. Executing it writes the outcomes of a run as one part, listed by a new version (see `versions`). A run that breaks
off lists nothing; its actions may have been done all the same, so before acting each task looks whether the effect is there
already. So after any number of crashes and retries an action has one outcome, and is done once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.sources import versions

OUTCOMES = "action_id string, seq long, kind string, source string, target string, status string, error string"
#: What a done action of a kind is called.
DONE = {"move": "renamed", "copy": "copied", "delete": "deleted"}


class Files(Protocol):
    """The caller's files; instances are sent to the tasks. Each call is whole or has no effect."""

    def exists(self, path: str) -> bool: ...

    def move(self, source: str, target: str) -> None: ...

    def copy(self, source: str, target: str) -> None: ...

    def delete(self, path: str) -> None: ...


def planned(actions: DataFrame) -> DataFrame:
    """action_id, seq, kind, source, target of actions(seq, kind move, copy or delete, source, target): the same action has the same id in every run."""
    key = F.to_json(F.struct("seq", "kind", "source", "target"), {"ignoreNullFields": "false"})
    return actions.select(F.sha2(key, 256).alias("action_id"), F.col("seq").cast("long").alias("seq"), "kind", "source", "target").dropDuplicates(["action_id"])


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    _, state = versions.latest(spark, root)
    return spark.read.schema(OUTCOMES).parquet(*state["runs"]) if state else spark.createDataFrame([], OUTCOMES)


def _act(files: Files, kind: str, source: str, target: str | None) -> tuple[str, str | None]:
    try:
        here, there = files.exists(source), target is not None and files.exists(target)
        if kind == "delete" and not here or kind == "move" and there and not here:
            return DONE[kind], None  # by a run that broke off before it could say so
        if not here:
            return "error", f"Datei nicht gefunden: {source}"
        if there:
            return ("error", f"Ziel existiert: {target}") if kind == "move" else (DONE[kind], None)
        files.delete(source) if kind == "delete" else getattr(files, kind)(source, target)
        return DONE[kind], None
    except Exception as e:  # noqa: BLE001 - one file's error is its outcome
        return "error", str(e)


def execute(spark: SparkSession, root: str, plan: DataFrame, files: Files) -> int:
    """Do what the plan has and the journal has no outcome for; returns the version. Actions on one file are done in one task, in their order."""
    number, state = versions.latest(spark, root)
    todo = plan.join(outcomes(spark, root).select("action_id"), "action_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [_act(files, k, s, None if pd.isna(t) else t) for k, s, t in zip(frame["kind"], frame["source"], frame["target"])]
            yield frame.assign(status=[x[0] for x in told], error=[x[1] for x in told])

    part = versions.new_part(root)
    ordered = todo.repartition("source").sortWithinPartitions("source", "seq").select("action_id", "seq", "kind", "source", "target")
    ordered.mapInPandas(run, OUTCOMES).write.parquet(part)
    return versions.commit(spark, root, number, {"runs": [*state.get("runs", []), part]})


def counted(spark: SparkSession, root: str) -> DataFrame:
    """status, n."""
    return outcomes(spark, root).groupBy("status").agg(F.count("*").alias("n"))


def undo_actions(spark: SparkSession, root: str, most: int = 20) -> DataFrame:
    """The last moves that were done, newest first, as actions(seq, kind, source, target) that take them back."""
    last = outcomes(spark, root).filter("status = 'renamed'").orderBy(F.desc("seq")).limit(most)
    top = F.max("seq").over(Window.partitionBy())  # over at most `most` rows
    return last.select((2 * top - F.col("seq") + 1).alias("seq"), F.lit("move").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"))
