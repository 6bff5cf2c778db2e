"""Texts and document information of PDF files, by readers that the caller gives.

No PDF library is part of this package. A reader is a function of a file's bytes that runs inside the tasks;
files stay where they are read and none goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import basename

#: Pages that optical recognition looks at.
OCR_PAGES = 5
#: What a reader tells of a document.
INFO_FIELDS = ("title", "author", "subject", "creator", "creation_date", "modification_date", "page_count")


def texts(files: DataFrame, pages: Callable[[bytes], list[str]], ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """path, text, by_ocr, failed of files(path, content): the non-blank pages by line; ocr(content, OCR_PAGES) where they are blank.

    A file that a reader can't read has an empty text; it has failed if nothing else could read it.
    """

    def read(content: bytes | None) -> tuple[str, bool, bool]:
        if content is None:
            return "", False, True
        text, failed = "", False
        try:
            text = "\n".join(p for p in pages(content) if p and p.strip())
        except Exception:
            failed = True
        if text.strip() or ocr is None:
            return text, False, failed
        try:
            return ocr(content, OCR_PAGES) or "", True, False
        except Exception:
            return "", True, failed

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [read(None if c is None else bytes(c)) for c in frame["content"]]
            out = pd.DataFrame(said, columns=["text", "by_ocr", "failed"])
            out.insert(0, "path", frame["path"])
            yield out

    return files.select("path", "content").mapInPandas(each, "path string, text string, by_ocr boolean, failed boolean")


def information(files: DataFrame, info: Callable[[bytes], dict]) -> DataFrame:
    """path, INFO_FIELDS (as strings, null where the reader fails), file_size and filename of files(path, length, content)."""

    def read(content: bytes) -> list[str | None]:
        try:
            found = info(content)
        except Exception:
            found = {}
        return [None if found.get(k) is None else str(found[k]) for k in INFO_FIELDS]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([read(bytes(c)) if c is not None else [None] * len(INFO_FIELDS) for c in frame["content"]], columns=list(INFO_FIELDS))
            out.insert(0, "path", frame["path"])
            out.insert(1, "file_size", frame["length"].astype("Int64"))
            yield out

    told = files.select("path", "length", "content").mapInPandas(each, "path string, file_size long, " + ", ".join(f"{k} string" for k in INFO_FIELDS))
    return told.withColumn("filename", basename(F.col("path")))
