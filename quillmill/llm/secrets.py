"""Secret scan with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its bytes. The ledger is a Parquet table with one
row for each blob that a version of the rules has scanned, and what was found in it. A call scans only blobs
without such a row, once each however many paths hold them, appends them in one commit, and joins the
ledger back to all paths. A run that dies before its commit leaves the ledger as it was; where two runs have scanned
the same blob at the same time it stands in the ledger twice, and is read once.

Defined cases: null text is the empty blob; texts are scanned whole, however long; equal texts share one blob, and
repeated rows are separate rows; findings that start together (ties) come in the order of KINDS; a
null id is an ordinary value; an empty table gives an empty result; other columns are ignored, and redact() passes
them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.llm.common import cut, join_dimension, join_if_small, path_exists, unused

#: The kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "jwt", "forge", "chat")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.I | re.A)
#: Runs are maximal, so a length in the pattern equals a test of the length afterwards.
_PLAIN = {
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
}
#: Follows from the patterns, so a changed rule scans every blob anew.
RULES_VERSION = hashlib.sha256("\n".join([_ASSIGN.pattern, *(f"{k} {p.pattern}" for k, p in _PLAIN.items())]).encode()).hexdigest()[:16]
SCHEMA = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All findings of one text by start, then kind in the order of KINDS; code points, end exclusive."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for kind, pattern in _PLAIN.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for blob, text in zip(frame["blob"], frame["text"]):
            spans = spans_of(text)
            base = [x for x in spans if x[0] in BASE]
            counts = [sum(x[0] == k for x in base) for k in BASE]
            rows.append((blob, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), [dict(zip(("kind", "start", "end"), x)) for x in spans]))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob (hex), n_assign, n_access, n_hex, base_sha256, spans for every row of versions; the ledger at that path grows."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = versions.select(F.col(id_col).alias(id_col), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    at = f"{ledger.rstrip('/')}/rules={RULES_VERSION}"
    unseen = keyed.select("blob", "text")
    if path_exists(spark, at):
        unseen = unseen.join(spark.read.schema(SCHEMA).parquet(at).select("blob"), "blob", "left_anti")
    unseen.dropDuplicates(["blob"]).mapInPandas(_scan, SCHEMA).write.mode("append").option("compression", "zstd").parquet(at)
    found = spark.read.schema(SCHEMA).parquet(at).dropDuplicates(["blob"])
    told = cut(found.filter(F.size("spans") > 0), "told")  # a row that meets none of these is clean
    size = told.agg(F.coalesce(F.sum(200 + 32 * F.size("spans")), F.lit(0))).first()[0]
    out = join_dimension(keyed.select(id_col, "blob"), told, "blob", "left", size)
    nothing = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")}
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans")
    return out.select(id_col, F.lower(F.hex("blob")).alias("blob"), *nothing.values(), F.coalesce("base_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("base_sha256"), spans)


@F.pandas_udf(StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        parts, at = [], 0
        for s in found:
            if s["end"] > at:  # else within the span before it
                parts += [text[at : s["start"]], f"[{s['kind']}]" if s["start"] >= at else ""]
                at = s["end"]
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, ledger: str) -> DataFrame:
    """The rows of docs(doc_id, text, n_chars, ...) with [kind] in place of each finding; n_chars follows the text."""
    found = scan_secrets(docs, ledger).filter(F.size("spans") > 0)
    blob, spans = unused(docs, "blob", "spans")
    found = cut(found.select(F.unhex("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob]), "findings")
    size = found.agg(F.coalesce(F.sum(48 + 32 * F.size(spans)), F.lit(0))).first()[0]
    rows = join_if_small(docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))), found, [blob], "left", size)
    touched, rest = rows.filter(F.col(spans).isNotNull()), rows.filter(F.col(spans).isNull())
    touched = touched.withColumn("text", _masked("text", spans))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return touched.unionByName(rest).select(docs.columns)


def spans_text(spans: str = "spans"):
    """The spans column as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
