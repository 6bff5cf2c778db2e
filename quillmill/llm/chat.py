"""Chat formatting: records of any known layout become canonical turns, then text with a template and a loss mask.

A record is a JSON object. The set of its nested field paths (array elements as `[]`) is hashed to a
fingerprint; the fingerprint selects a declarative mapping, found once for each fingerprint: the mapping
with the most required paths of those whose required paths the record has. Extra fields don't matter.

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts `\\`
becomes `\\\\` and `<|` becomes `<\\|` (and a line break in a role `\\n`), so no text can hold a control
string and reading back gives the same turns.

A conversation is (conv_id, conv_key): whole ids are conv_id; any other id is conv_key as it is; a record that
holds a whole conversation and has no id gets a conv_key of its own.

Defined cases: null text and null role are empty; rows without conversation id are one conversation; turns are
ordered by turn (null first), then position within the record, role and text, so repeated rows and ties
have one order; a record of no known layout, and one that is no JSON (or too deep to read), gives no turn and is
listed by unmatched(); a null record likewise; numbers that aren't whole or don't fit 64 bits are no turn (null); a half of
a surrogate pair becomes U+FFFD; texts of any length stay whole; an empty table gives an empty result; columns
other than the record's are ignored. The turns of a conversation meet in one row, as its text does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import add_columns

#: The layouts. `turns` are (role, path) pairs; `list` is an array of turns with the keys given;
#: `roles` renames roles.
LAYOUTS = [
    {"name": "rows", "needs": ["conv_id", "turn", "role", "text"], "id": "conv_id", "order": "turn", "one": ("role", "text")},
    {"name": "messages", "needs": ["messages", "messages[].role", "messages[].content"], "id": "id", "list": "messages", "keys": ("role", "content")},
    {"name": "exchange", "needs": ["conversations", "conversations[].from", "conversations[].value"], "id": "id", "list": "conversations", "keys": ("from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"name": "instruction", "needs": ["instruction", "output"], "id": "id", "turns": [("system", "system"), ("user", ("instruction", "input")), ("assistant", "output")]},
    {"name": "prompt", "needs": ["prompt", "response"], "id": "id", "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "completion", "needs": ["prompt", "completion"], "id": "id", "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "question", "needs": ["question", "answer"], "id": "id", "turns": [("system", "context"), ("user", "question"), ("assistant", "answer")]},
    {"name": "nested", "needs": ["data", "data.prompt", "data.response"], "id": "id", "turns": [("user", "data.prompt"), ("assistant", "data.response")]},
]
TURNS = "conv_id long, conv_key string, turn long, part int, role string, text string, layout string"


def field_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            out |= {path} | field_paths(v, path)
        return out
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def layout_for(paths: set[str], layouts: list[dict] = LAYOUTS) -> dict | None:
    return max((x for x in layouts if paths.issuperset(x["needs"])), key=lambda x: len(x["needs"]), default=None)


def _at(record: dict, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _string(value: object) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _whole(value: object) -> int | None:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def _read(raw: str | None) -> tuple[object, set[str], str]:
    """The record, its field paths and their fingerprint; no paths where it can't be read."""
    try:
        record = json.loads(raw) if raw is not None else None
        paths = field_paths(record)
        return record, paths, fingerprint(paths)
    except (ValueError, RecursionError):
        return None, set(), "malformed"


def _ids(value: object) -> tuple[int | None, str | None]:
    """(conv_id, conv_key) of an id."""
    if (whole := _whole(value)) is not None:
        return whole, None
    return None, None if value is None else f"id {_string(value)}" if isinstance(value, str) else f"json {_string(value)}"


def turns_of(record: dict, layout: dict) -> list[tuple[int | None, int, str, str]]:
    """(turn, part, role, text) of one record."""
    rename = layout.get("roles", {})
    if "one" in layout:
        role, text = (_string(_at(record, p)) for p in layout["one"])
        return [(_whole(_at(record, layout["order"])), 0, rename.get(role, role), text)]
    if "list" in layout:
        role, text = layout["keys"]
        said = [x for x in _at(record, layout["list"]) or [] if isinstance(x, dict)]
        return [(i, 0, rename.get(r := _string(x.get(role)), r), _string(x.get(text))) for i, x in enumerate(said)]
    out = []
    for role, where in layout["turns"]:
        text = "\n".join(x for p in ([where] if isinstance(where, str) else where) if (x := _string(_at(record, p))))
        if text or role != "system":
            out.append((len(out), 0, role, text))
    return out


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: list[dict] = LAYOUTS) -> DataFrame:
    """conv_id, conv_key, turn, part, role, text, layout from a column of JSON objects."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict | None] = {}
        n, part = 0, TaskContext.get().partitionId()
        for frame in frames:
            rows = []
            for raw in frame[record_col]:
                n += 1
                record, paths, key = _read(raw)
                if key not in known:
                    known[key] = layout_for(paths, layouts)
                if layout := known[key]:
                    ids = _ids(_at(record, layout["id"]))
                    if ids == (None, None) and "one" not in layout:
                        ids = None, f"record {part} {n}"
                    rows += [(*ids, *t, layout["name"]) for t in turns_of(record, layout)]
            out = pd.DataFrame(rows, columns=["conv_id", "conv_key", "turn", "part", "role", "text", "layout"], dtype=object)
            yield out.assign(conv_id=pd.array(out["conv_id"].tolist(), "Int64"), turn=pd.array(out["turn"].tolist(), "Int64"), part=out["part"].astype("int32"))

    return records.select(record_col).mapInPandas(read, TURNS)


def unmatched(records: DataFrame, record_col: str = "record", layouts: list[dict] = LAYOUTS) -> DataFrame:
    """record, fingerprint of the records of no known layout."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(raw, *_read(raw)[1:]) for raw in frame[record_col]]
            yield pd.DataFrame([(raw, key) for raw, paths, key in found if not layout_for(paths, layouts)], columns=["record", "fingerprint"])

    return records.select(record_col).mapInPandas(read, "record string, fingerprint string")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, conv_key, formatted: one row a conversation."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "part", "role", "text")))
    piece = lambda t: F.concat(F.lit("<|im_start|>"), F.replace(_escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"), _escaped(t["text"]), F.lit("<|im_end|>\n"))
    return turns.groupBy("conv_id", "conv_key").agg(ordered.alias("turns")).select("conv_id", "conv_key", F.concat_ws("", F.transform("turns", piece)).alias("formatted"))


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def read_back(formatted: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn; start and end bound its text within formatted."""
    back = lambda s: _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], s)
    return [(back(m[1]), *m.span(2)) for m in _TURN.finditer(formatted)]


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def loss_mask(formatted: str) -> list[tuple[int, int]]:
    """The spans of formatted that count for the loss: the texts of assistant turns."""
    return [(a, b) for role, a, b in read_back(formatted) if role == "assistant"]


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text alone."""

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def read(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for text in batch["formatted"]:
            turns = [(role, unescape(text[a:b])) for role, a, b in read_back(text)]
            loss = "".join(unescape(text[a:b]) for a, b in loss_mask(text))
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        return dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), zip(*rows) if rows else [[]] * 5))

    return add_columns(formatted.select("conv_id", "formatted"), read, DIGESTS, ["formatted"])
