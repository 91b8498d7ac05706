"""Chat records of many layouts to canonical turns, and turns to one training string and back.

A record's schema fingerprint is the hash of its nested field paths (list positions are ``[]``).  The
fingerprint selects a declarative mapping; the mapping says which paths hold the turns.  Unknown fingerprints
give no turns and are reported in ``mapping`` as null.

The template writes ``### role: text</turn>`` and a line feed for each turn.  Within roles and texts a
backslash is put before ``\\``, ``#`` and ``<`` (in roles also before ``:``, and a line feed is ``\\n``), so
control strings never occur inside a text and every text is read back exactly.

A layout's own names for the canonical roles (human, gpt) are read as those; the layout "messages" has no names of its own, so
its roles stay as they are written.

Defined results: null texts and roles are empty; a conversation's rows are ordered by turn (null first), then
role, then text; repeated rows stay as turns; very long texts are kept whole (one conversation is one row); empty tables
give no rows; records that are no JSON or have an unknown fingerprint have no turns; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import numbered, quoted, trim

#: Mappings: the field paths that must be there, and where turns come from.  A turn source is either
#: (list path, role field, text field) or (None, constant role, text path); empty texts of the second kind are left out.
#: "roles" has a layout's own names for canonical roles.
MAPPINGS: dict[str, dict[str, Any]] = {
    "messages": {"paths": ["messages", "messages[].content", "messages[].role"], "turns": [("messages", "role", "content")]},
    "shared": {"paths": ["conversations", "conversations[].from", "conversations[].value"], "turns": [("conversations", "from", "value")], "roles": {"human": "user", "gpt": "assistant"}},
    "nested": {"paths": ["data", "data.turns", "data.turns[].speaker", "data.turns[].text"], "turns": [("data.turns", "speaker", "text")], "roles": {"human": "user", "bot": "assistant"}},
    "instruction": {"paths": ["instruction", "output"], "turns": [(None, "user", "instruction"), (None, "assistant", "output")]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "turns": [(None, "system", "instruction"), (None, "user", "input"), (None, "assistant", "output")]},
    "prompt": {"paths": ["completion", "prompt"], "turns": [(None, "user", "prompt"), (None, "assistant", "completion")]},
    "system_prompt": {"paths": ["prompt", "response", "system"], "turns": [(None, "system", "system"), (None, "user", "prompt"), (None, "assistant", "response")]},
}
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.S)


def field_paths(value: Any, at: str = "") -> set[str]:
    found = {at} if at and not at.endswith("[]") else set()
    if isinstance(value, dict):
        for k, v in value.items():
            found |= field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            found |= field_paths(v, f"{at}[]")
    return found


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}


def _at(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def canonical(record: Any) -> tuple[str | None, list[tuple[str, str]]]:
    """Name of the mapping that the record's fingerprint selects, and the turns as (role, text)."""
    name = BY_FINGERPRINT.get(fingerprint(field_paths(record)))
    turns: list[tuple[str, str]] = []
    names = MAPPINGS[name].get("roles", {}) if name else {}
    for source, role, text in MAPPINGS[name]["turns"] if name else []:
        if source is None:
            said = _at(record, text)
            if said:
                turns.append((role, str(said)))
        else:
            for item in _at(record, source) or []:
                who, said = item.get(role), item.get(text)
                who = "" if who is None else str(who)
                turns.append((names.get(who, who), "" if said is None else str(said)))
    return name, turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The training string and its loss mask: [start, end) of every assistant text in it."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape_role(role)}: ", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + 8
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def as_records(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns to one JSON record per conversation, in the plainest layout that says the same.

    A conversation of one user and one assistant turn with text, in this order, is {"prompt", "completion"}; one with a
    system turn before them {"system", "prompt", "response"}; one whose turns are all by user and assistant is
    {"conversations": [{"from": "human" or "gpt", "value"}, ...]}; others are {"messages": [{"role", "content"}, ...]}.
    So the records are as mixed as those of several sources, and their fingerprints decide how they are read.
    """
    said = F.struct(F.col(quoted(turn)).alias("t"), F.coalesce(quoted(role), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(quoted(key)).alias(key)).agg(F.sort_array(F.collect_list(said)).alias("turns" if key != "turns" else "_turns"))
    m = F.col(grouped.columns[1])
    roles, texts = F.transform(m, lambda x: x["role"]), F.transform(m, lambda x: x["content"])
    full = ~F.exists(texts, lambda t: t == "")
    pair = full & (roles == F.array(F.lit("user"), F.lit("assistant")))
    three = full & (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    plain = (F.size(m) > 0) & F.forall(roles, lambda r: r.isin("user", "assistant"))
    shared = F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    messages = F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = (
        F.when(pair, F.to_json(F.struct(texts[0].alias("prompt"), F.get(texts, F.lit(1)).alias("completion"))))
        .when(three, F.to_json(F.struct(texts[0].alias("system"), F.get(texts, F.lit(1)).alias("prompt"), F.get(texts, F.lit(2)).alias("response"))))
        .when(plain, F.to_json(F.struct(shared.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select(F.col(quoted(key)).alias(key), record.alias("record"))


def _by_row(df: DataFrame, key: str, columns: list[str], added: StructType, one: Callable[..., tuple]) -> DataFrame:
    """key and the columns that `one` makes of the given ones, row by row, a batch at a time."""
    schema = StructType([df.schema[key], *added.fields])
    sorts = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # only so many rows are Python objects at a time
                part = batch.slice(a, 500)
                rows = [one(*(c[k].as_py() for c in part.columns[1:])) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], sort) for i, sort in enumerate(sorts))], names=schema.names)
        trim()

    return numbered(df.select(quoted(key), *columns)).mapInArrow(run, schema)


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """key, mapping, n_turns, formatted, loss_mask (array of [start, end) into formatted) per record."""

    def one(text: str | None) -> tuple:
        try:
            name, turns = canonical(json.loads(text)) if text is not None else (None, [])
        except ValueError:
            name, turns = None, []
        out, mask = render(turns)
        return name, len(turns), out, [{"start": a, "end": b} for a, b in mask]

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    added = StructType([StructField("mapping", StringType()), StructField("n_turns", LongType()), StructField("formatted", StringType()), StructField("loss_mask", ArrayType(span))])
    return _by_row(records, key, [quoted(record)], added, one)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted strings say, read back: turns, loss text and lengths."""

    def one(text: str, mask: list[dict[str, int]]) -> tuple:
        turns = read_back(text)
        loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)

    kinds = {"n_turns": LongType(), "turns_sha256": StringType(), "loss_chars": LongType(), "loss_sha256": StringType(), "formatted_chars": LongType()}
    return _by_row(formatted, key, ["formatted", "loss_mask"], StructType([StructField(c, k) for c, k in kinds.items()]), one)
