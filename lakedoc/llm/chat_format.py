"""Operator 5: chat formatting of heterogeneous records.

Method: schema fingerprinting. The nested field paths of a record (``messages[].role``)
that any known layout mentions are sorted and hashed; the hash selects a declarative
mapping that turns the record into canonical turns ``conv_id, turn, role, text``. Typed
tables are fingerprinted once by their schema and mapped with DataFrame expressions; JSON
records of mixed layouts are fingerprinted one by one.

Template: ``<s>``, then per turn ``[INST] text [/INST]`` (user), ``[SYS] text [/SYS]``
(system), ``text</s>`` (assistant) and ``[TURN] role [/TURN]text [/TURN]`` (any other
role). Inside texts a backslash is doubled and a control string gets one after its first
character, so no text can imitate the template and `parse` restores it exactly. The loss
mask is the list of character ranges that hold assistant texts.

Plan: one shuffle by conversation; its sorted rows stream through the formatter, which
holds one conversation at a time (its result is one value).

Defined results: a null text is empty, a null role is the empty role; rows of a
conversation with equal ``turn`` follow by role and text, null turns come first; null
conversation ids are one conversation; an empty table gives no rows; further columns are
ignored unless they complete another known layout, in which case the layout listed first
wins. Records of an unknown layout are reported, not dropped.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

# -- layouts -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """``each``: array of turns with the fields ``role`` and ``text``, or none if every row
    is a turn; ``fixed``: roles with the fields whose texts they join by a blank line."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


# Role names in use, and the layouts' field names.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Layout(
        "messages",
        ("messages[].content", "messages[].role"),
        each="messages",
        role="role",
        text="content",
        roles=SPEAKERS,
    ),
    Layout(
        "speakers",
        ("conversations[].from", "conversations[].value"),
        ("system",),
        each="conversations",
        role="from",
        text="value",
        roles=SPEAKERS,
        fixed=(("system", ("system",)),),
    ),
    Layout(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        fixed=(
            ("system", ("system",)),
            ("user", ("instruction", "input")),
            ("assistant", ("output",)),
        ),
    ),
    *[
        Layout(
            f"prompt and {answer}",
            (answer, "prompt"),
            ("system",),
            fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", (answer,))),
        )
        for answer in ("response", "completion", "chosen")
    ],
    Layout(
        "question and answer",
        ("answer", "question"),
        ("context", "system"),
        fixed=(
            ("system", ("system",)),
            ("user", ("context", "question")),
            ("assistant", ("answer",)),
        ),
    ),
)
KNOWN = frozenset(path for layout in LAYOUTS for path in (*layout.required, *layout.optional))


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the paths that some layout mentions."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


def _fingerprints() -> dict[str, Layout]:
    found: dict[str, Layout] = {}
    for layout in LAYOUTS:
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, n):
                found.setdefault(fingerprint((*layout.required, *some)), layout)
    return found


MAPPINGS = _fingerprints()


def layout_of(paths: Iterable[str]) -> Layout | None:
    """By fingerprint; with paths of several layouts, the first one that is complete."""
    paths = set(paths)
    exact = MAPPINGS.get(fingerprint(paths))
    return exact or next((x for x in LAYOUTS if paths.issuperset(x.required)), None)


def schema_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        for part in kind.fields:
            yield from schema_paths(part.dataType, f"{prefix}.{part.name}" if prefix else part.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def value_paths(value, prefix: str = "") -> Iterator[str]:
    """Nested field paths of a parsed JSON value."""
    if isinstance(value, dict):
        for key, part in value.items():
            yield from value_paths(part, f"{prefix}.{key}" if prefix else key)
    elif isinstance(value, list):
        for part in value:
            yield from value_paths(part, f"{prefix}[]")
    else:
        yield prefix


_TURNS = "conv_id long, turn long, role string, text string"


def canonical_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of a typed table; its layout is selected by the fingerprint of its schema."""
    layout = layout_of(schema_paths(records.schema))
    if layout is None:
        raise ValueError(f"no layout for the fields {records.columns}")
    conv = F.col(id_col).cast("long").alias("conv_id")
    if layout.each is None and layout.order:
        return records.select(
            conv,
            F.col(layout.order).cast("long").alias("turn"),
            _canonical(F.col(layout.role), layout).alias("role"),
            F.col(layout.text).cast("string").alias("text"),
        )
    have = set(records.columns)
    parts = []
    for role, fields in layout.fixed:
        texts = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in have]
        if texts:
            text = F.concat_ws("\n\n", *texts)
            there = (text != "") | F.lit(role != "system")
            parts.append(F.when(there, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    turns = F.filter(F.array(*parts), F.isnotnull) if parts else None
    if layout.each:
        listed = F.transform(
            F.coalesce(F.col(layout.each), F.array()),
            lambda x: F.struct(
                _canonical(x[layout.role], layout).alias("role"),
                x[layout.text].cast("string").alias("text"),
            ),
        )
        turns = listed if turns is None else F.concat(turns, listed)
    return records.select(conv, F.posexplode(turns).alias("turn", "said")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text"
    )


def _canonical(role, layout: Layout):
    role = role.cast("string")
    if not layout.roles:
        return role
    pairs = itertools.chain.from_iterable(layout.roles.items())
    names = F.create_map(*[F.lit(x) for x in pairs])
    return F.coalesce(names[role], role)


def turns_of_json(records: DataFrame, id_col: str = "conv_id", json_col: str = "record"):
    """Turns of JSON records of mixed layouts; ``layout`` is null where none fits.

    Such a record, and one that is no JSON object, has one row with null role and text.
    """

    def value(record: dict, fields: tuple[str, ...]) -> str:
        texts = (record.get(f) for f in fields)
        return "\n\n".join(t if isinstance(t, str) else json.dumps(t) for t in texts if t)

    def turns(text: str | None) -> Iterator[tuple]:
        try:
            record = json.loads(text or "")
        except ValueError:
            record = None
        layout = layout_of(value_paths(record)) if isinstance(record, dict) else None
        if layout is None:
            yield None, None, None, None
            return
        said = []
        if layout.order:
            said = [(record.get(layout.role), record.get(layout.text))]
        for role, fields in layout.fixed:
            joined = value(record, fields)
            if joined or role != "system":
                said.append((role, joined))
        for part in record.get(layout.each) or () if layout.each else ():
            said.append((part.get(layout.role), part.get(layout.text)))
        for n, (role, body) in enumerate(said):
            at = record.get(layout.order) if layout.order else n
            yield layout.name, at, layout.roles.get(role, role), body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (conv, *turn)
                for conv, text in zip(*(c.to_pylist() for c in batch.columns))
                for turn in turns(text)
            ]
            if rows:
                conv, name, at, role, body = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(conv, pa.int64()),
                        pa.array(at, pa.int64()),
                        pa.array(role, pa.string()),
                        pa.array(body, pa.string()),
                        pa.array(name, pa.string()),
                    ],
                    names=["conv_id", "turn", "role", "text", "layout"],
                )

    picked = records.select(F.col(id_col).cast("long"), F.col(json_col).cast("string"))
    return picked.mapInArrow(run, f"{_TURNS}, layout string")


# -- template ----------------------------------------------------------------------------

_CONTROL = re.compile(r"\[(?=/?(?:INST|SYS|TURN)\])|<(?=/?s>)")
_ESCAPED = re.compile(r"\\(\\?)")
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "</s>")}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the range of its escaped text."""
    if role in _MARKS:
        before, after = _MARKS[role]
    else:
        before, after = f"[TURN] {escape(role)} [/TURN]", " [/TURN]"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns ``(role, text)`` of a formatted conversation."""
    if not formatted.startswith("<s>"):
        raise ValueError("a conversation begins with <s>")
    at, turns = 3, []
    while at < len(formatted):
        if formatted.startswith("[TURN] ", at):
            end = formatted.index(" [/TURN]", at + 7)
            role, at, after = unescape(formatted[at + 7 : end]), end + 8, " [/TURN]"
        else:
            role = next(r for r, (b, _) in _MARKS.items() if formatted.startswith(b, at))
            before, after = _MARKS[role]
            at += len(before)
        end = formatted.index(after, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return turns


_FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,stop:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to conversations; a conversation may go on in the next batch."""
    out, current, parts, loss, size = [], None, [], [], 0

    def done() -> None:
        out.append((current[0], "".join(parts), loss))

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if current != (conv,):
                if current is not None:
                    done()
                current, parts, loss, size = (conv,), ["<s>"], [], 3
            piece, start, stop = turn_text(role, text)
            if role == "assistant":
                loss.append({"start": size + start, "stop": size + stop})
            parts.append(piece)
            size += len(piece)
        if out:
            yield _conversations(out)
            out = []
    if current is not None:
        done()
        yield _conversations(out)


def _conversations(rows: list[tuple]) -> pa.RecordBatch:
    conv, formatted, loss = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(formatted, pa.string()), pa.array(loss, _LOSS)],
        names=["conv_id", "formatted", "loss"],
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` of canonical turns."""
    whole = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = whole.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, _FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
            turns = parse(formatted)
            said = hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode())
            masked = [unescape(formatted[x["start"] : x["stop"]]) for x in loss]
            rows.append(
                (
                    conv,
                    len(turns),
                    said.hexdigest(),
                    sum(map(len, masked)),
                    hashlib.sha256("".join(masked).encode()).hexdigest(),
                    len(formatted),
                )
            )
        if rows:
            kinds = ("int64", "int64", "string", "int64", "string", "int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, getattr(pa, k)()) for c, k in zip(zip(*rows), kinds)], names=_DIGESTS
            )


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def formatted_digests(turns: DataFrame) -> DataFrame:
    """Format, store, read back and parse; one row of digests per conversation."""
    written = stored(format_turns(turns), "chats")
    return written.mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )


#: A conversation made of control strings, which the query adds to the table.
PROBE = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]

ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'),
      '\[(/?(INST|SYS|TURN)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') AS body,
    regexp_replace(regexp_replace(replace(role, '\', '\\'),
      '\[(/?(INST|SYS|TURN)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') AS other
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  (3 + sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13
    WHEN 'assistant' THEN 4 ELSE 23 + length(other) END))::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""
