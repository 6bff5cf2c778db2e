"""License scan by conditional compression.

Candidates are windows about as long as a template around every mark of license talk, overlapping by more than
a notice, whatever line or paragraph they lie in. A window is compressed alone and with the template as a raw
zstandard dictionary; what that saves is measured against what the template saves on itself. Where it is enough, the
window is held against the template word by word: all of its words but a small share must follow one another, in
order, and what differs is listed. Every notice confirmed is reported; of overlapping ones that with the most words.

Texts are read whole where they lie; nothing is shuffled. Equal windows are judged once a task.

Defined cases: null and empty texts have no candidates; ties between templates go to the greater
saving, then the first by name; very long texts are scanned whole, window by window; repeated rows are separate; ids,
null ones too, pass as they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame

from quillmill.llm.common import add_columns

#: Notices and openings of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Lower-case marks of license talk.
CUES = ("license", "licence", "licensed", "spdx", "permission is hereby granted", "permission to use", "redistribution and use", "public domain", "free software")

_WORD = re.compile(r"[^\W_]+")
#: The cues, whatever stands between their words (a line break, a comment mark).
_CUE = re.compile("|".join(r"[\W_]+".join(c.split()) for c in CUES), re.I)
#: A template may miss this share of its words.
MISSING = 0.15
#: The least saving, as a share of what the template saves on itself.
REDUCTION = 0.10
SCHEMA = "n_candidates long, n_confirmed long, licenses string, findings array<struct<start:long,end:long,template:string,reduction:double,missing:array<string>,extra:array<string>>>"


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.cache
def _tools() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor], dict[str, list[str]]]:
    with_template = {k: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in TEMPLATES.items()}
    return zstandard.ZstdCompressor(level=6, write_content_size=False), with_template, {k: _words(v) for k, v in TEMPLATES.items()}


def _saved(text: str, name: str) -> int:
    """Bytes that a template saves where it is the dictionary."""
    alone, with_template, _ = _tools()
    raw = text.encode("utf-8", "surrogatepass")
    return len(alone.compress(raw)) - len(with_template[name].compress(raw))


@functools.cache
def _own(name: str) -> int:
    return _saved(TEMPLATES[name], name)


def best_match(block: list[str], template: list[str]) -> tuple[int, int, list[str], list[str], tuple[int, int]] | None:
    """(start, end) of the words that match best, template words they miss, words that stand between, and the longest run."""
    matches = [m for m in difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not matches:
        return None
    longest = max(matches, key=lambda m: m.size)
    between = lambda ms: ms[-1].a + ms[-1].size - ms[0].a - sum(m.size for m in ms)
    while len(matches) > 1 and between(matches) > max(1, MISSING * len(template)):  # a stray word far off is no part of the notice
        ends = [i for i in (0, -1) if matches[i] is not longest]
        gap = {0: matches[1].a - matches[0].a - matches[0].size, -1: matches[-1].a - matches[-2].a - matches[-2].size}
        del matches[max(ends, key=lambda i: gap[i] / matches[i].size)]
    have = {i for m in matches for i in range(m.b, m.b + m.size)}
    used = {i for m in matches for i in range(m.a, m.a + m.size)}
    start, end = matches[0].a, matches[-1].a + matches[-1].size
    return start, end, [w for i, w in enumerate(template) if i not in have], [block[i] for i in range(start, end) if i not in used], (longest.a, longest.a + longest.size)


@functools.lru_cache(maxsize=4096)
def judge(block: str, name: str) -> tuple[tuple[int, int, tuple], ...]:
    """Every place of a block that words the template: (start, end, (name, saving, missing, extra))."""
    if _saved(block, name) < REDUCTION * _own(name):
        return ()
    spans, template, found = [m.span() for m in _WORD.finditer(block)], _tools()[2][name], []
    words = [block[a:b].lower() for a, b in spans]
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        match = best_match(words[low:high], template) if high - low >= (1 - MISSING) * len(template) else None
        if not match:
            continue
        start, end, missing, extra, cut = match
        if len(missing) <= MISSING * len(template) and len(extra) <= max(1, MISSING * len(template)):
            a, b, cut = spans[low + start][0], spans[low + end - 1][1], (start, end)
            saving = _saved(block[a:b], name) / _own(name)
            if saving >= REDUCTION:
                found.append((a, b, (name, saving, tuple(missing), tuple(extra))))
        todo += [(low, low + cut[0]), (low + cut[1], high)]
    return tuple(found)


def windows(text: str, cues: list[int], name: str) -> Iterator[tuple[int, int]]:
    """(start, end) of windows such that a notice around any of the cues lies whole in one of them."""
    reach, done = len(TEMPLATES[name]) * 3 // 2 + 40, -1
    for at in cues:
        if at > done:
            start, end = max(0, at - reach), min(len(text), at + 3 * reach)
            while start and not text[start - 1].isspace() and at - start < 2 * reach:
                start -= 1
            yield start, end
            done = at + 2 * reach


def scan_text(text: str | None) -> tuple[int, list[tuple[int, int, tuple]]]:
    cues = [m.start() for m in _CUE.finditer(text or "")]
    blocks, confirmed = set(), set()
    for name in TEMPLATES if cues else ():
        for a, b in windows(text, cues, name):
            blocks.add((a, b))
            confirmed |= {(a + x, a + y, verdict) for x, y, verdict in judge(text[a:b], name)}
    words = _tools()[2]
    size = lambda v: len(words[v[0]]) - 2 * len(v[2]) - len(v[3])
    found: list[tuple[int, int, tuple]] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b, v in sorted(confirmed, key=lambda f: (-size(f[2]), -f[2][1], f[2][0], f[0])):
        i = bisect.bisect(taken, (a, b))
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            continue
        taken.insert(i, (a, b))
        found.append((a, b, v))
    return len(blocks), sorted(found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for every row of docs(doc_id, text): licenses (comma-joined, sorted) and where and how they are worded."""

    def scan(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for text in batch["text"]:
            n, found = scan_text(text)
            listed = [{"start": a, "end": b, "template": v[0], "reduction": v[1], "missing": list(v[2]), "extra": list(v[3])} for a, b, v in found]
            rows.append((n, len(found), ",".join(sorted({v[0].removesuffix("-line") for _, _, v in found})), listed))
        return dict(zip(("n_candidates", "n_confirmed", "licenses", "findings"), zip(*rows) if rows else [[]] * 4))

    return add_columns(docs.select("doc_id", "text"), scan, SCHEMA, ["text"])
