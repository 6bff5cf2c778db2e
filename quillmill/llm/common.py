"""What several corpus operators share: tables in the shared folder, joins with small tables and sums of arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A dimension table of at most this many (narrow) rows is broadcast; a larger one is joined by salted keys.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
#: How many ways a key is split where a large dimension table meets rows whose keys may be skewed.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder and a cluster one below its warehouse.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.startswith("local"):
        own = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillmill/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: ends its lineage and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def join_dimension(rows: DataFrame, dim: DataFrame, key: str, how: str = "inner", dim_bytes: int | None = None) -> DataFrame:
    """Join rows with a table that has one row a key (nulls match). A dimension above BROADCAST_ROWS, or BROADCAST_BYTES where its size was measured, is spread over salts."""
    small = dim.count() <= BROADCAST_ROWS if dim_bytes is None else dim_bytes <= BROADCAST_BYTES
    dim = dim.withColumnRenamed(key, "_dim_key")
    match = rows[key].eqNullSafe(dim["_dim_key"])
    if small:
        return rows.join(F.broadcast(dim), match, how).drop("_dim_key")
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    dim = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = rows[key].eqNullSafe(dim["_dim_key"]) & (rows["_salt"] == dim["_dim_salt"])
    return rows.join(dim, match, how).drop("_dim_key", "_dim_salt", "_salt")


#: Partial arrays that meet in one task of a reduction.
FANIN = 32


def tree_sum(parts: DataFrame, kind: str, fanin: int = FANIN) -> DataFrame:
    """Sum arrays (columns: chunk int, part long, data binary holding numbers of that numpy kind) over parts, in a tree of `fanin` branches.

    The parts are written first, so they are computed once and the depth of the tree follows from what was written.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=kind).copy() for x in frame["data"])
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "part": [frame["part"].iloc[0] // fanin], "data": [np.asarray(total, dtype=kind).tobytes()]})

    parts = cut(parts, "parts")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("up", F.floor(F.col("part") / fanin)).groupBy("chunk", "up").applyInPandas(add, "chunk int, part long, data binary")
        n = -(-n // fanin)
        if n <= 1:
            return parts.select("chunk", "data")


def add_columns(rows: DataFrame, made: Callable[[dict[str, list]], dict[str, list]], added: str, used: list[str]) -> DataFrame:
    """rows without the columns `used`, but with the columns `added` that `made` gives for lists of the used ones.

    The other columns stay in Arrow as they are, so no id turns into a float where it stands beside a null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [f for f in rows.schema if f.name not in used]
    more = StructType.fromDDL(added)
    arrow = to_arrow_schema(more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = made({c: batch.column(c).to_pylist() for c in used})
            arrays = [batch.column(f.name) for f in kept] + [pa.array(new[f.name], arrow.field(f.name).type) for f in more]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), *(f.name for f in more)])

    return rows.mapInArrow(work, StructType([*kept, *more]))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns of df, none of which (case apart) it has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in have:
            name += "_"
        out.append(name)
    return out


def slices(frames: Iterator[pd.DataFrame], column: str = "text", most: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """The rows of frames in parts of about `most` bytes (characters) of a column, so what a task makes of a part stays small."""
    for frame in frames:
        part = (frame[column].str.len().fillna(0).cumsum() // most).to_numpy()
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            yield frame.iloc[a:b].reset_index(drop=True)


def join_if_small(rows: DataFrame, table: DataFrame, keys: list[str], how: str, table_bytes: int, most: int = 32 << 20) -> DataFrame:
    """Join with a table of a measured size: broadcast up to `most` bytes, else shuffled by the keys."""
    return rows.join(F.broadcast(table) if table_bytes <= most else table, keys, how)
