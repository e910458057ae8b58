"""Chat formatting of typed content parts.

A turn holds an ordered array of parts: text, image, audio and document.  A visitor flattens them:
text is kept, with control strings escaped, and every other part becomes a numbered placeholder.
The attachment it stands for is recorded with its reference, its place in the formatted turn and
the number of tokens it will expand to.

A turn is written ``<s>role\\nbody</s>\\n``.  Control strings of this and of related templates are
escaped in roles and texts by a tilde after their first character (one more where there are some
already), so escaping is reversible and an escaped text can never end or open a turn.  The loss
mask covers the body of assistant turns, as spans of code points.

A conversation is a stream of formatted turns, in order: it is dealt to a task by its id and read
turn by turn, so a conversation of any length takes the memory of a turn.

Defined results: null texts, roles and part arrays count as empty, a null part or one of an unknown
kind is an attachment of the kind ``other``.  Turns with equal numbers go by role and text, null
numbers first.  Rows with a null id form one conversation.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>\n"
CONTROL = r"([<\[])(~*)(/?s>|/?INST\]|\|)"
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(r"([<\[])~(~*)(/?s>|/?INST\]|\|)")
_PLACEHOLDER = re.compile(r"<\|[a-z]+_[0-9]+\|>")
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}  # a tile, a second, a page
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"
ATTACHMENTS = "array<struct<number:int,kind:string,ref:string,position:int,tokens:int>>"
FORMATTED = f"conv_id bigint, position bigint, formatted string, loss_start int, loss_end int, attachments {ATTACHMENTS}"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1~\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("~", "~~").replace("\n", "~n"))


def unescape_role(role: str) -> str:
    return re.sub(r"~([~n])", lambda m: "~" if m[1] == "~" else "\n", unescape(role))


class Visitor:
    """Flattens the parts of a turn.  ``number`` counts the attachments of a conversation."""

    def __init__(self, number: int):
        self.number, self.out, self.length, self.attachments = number, [], 0, []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("kind") or "other"
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(part)

    def _add(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, part: dict) -> None:
        self.number += 1
        units = part.get("units")
        tokens = TOKENS_PER_UNIT.get(kind, 0) * (1 if units is None else max(units, 0))
        self.attachments.append({"number": self.number, "kind": kind, "ref": part.get("ref"), "position": self.length, "tokens": tokens})
        self._add(f"<|{kind}_{self.number}|>")

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part)


def text_part(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("units")))


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn: place in the conversation, formatted text, loss span (0, 0 outside the
    mask) and attachments; positions count code points of the formatted turn."""
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).cast(PARTS).alias("parts"),
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "parts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
            ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32())]))),
        ])
        current, position, number = object(), 0, 0
        for batch in batches:
            rows = []
            for conv, role, parts in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "parts"))):
                if conv != current:
                    current, position, number = conv, 0, 0
                head = BEGIN + escape_role(role) + "\n"
                visitor = Visitor(number)
                for part in parts or []:
                    visitor.visit(part)
                number = visitor.number
                for attachment in visitor.attachments:
                    attachment["position"] += len(head)
                mask = (len(head), len(head) + visitor.length) if role in trained else (0, 0)
                rows.append((conv, position, head + "".join(visitor.out) + END, *mask, visitor.attachments))
                position += 1
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(write, FORMATTED)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders are no text."""
    if not (formatted.startswith(BEGIN) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, body = formatted[len(BEGIN):-len(END)].split("\n", 1)
    return unescape_role(role), unescape(_PLACEHOLDER.sub("", body))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: number of turns, digest of roles and
    texts, size and digest of the text under the loss mask, formatted size, attachments and
    their tokens."""
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    )
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        current, state, done = object(), None, []

        def close() -> None:
            if state is not None:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        def flush() -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            fields = ("conv_id", "formatted", "loss_start", "loss_end", "attachments")
            for conv, text, begin, end, attachments in zip(*(batch.column(c).to_pylist() for c in fields)):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, said = parse(text)
                masked = unescape(_PLACEHOLDER.sub("", text[begin:end]))
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
                state[5] += len(attachments)
                state[6] += sum(a["tokens"] for a in attachments)
            yield flush()
            done.clear()
        close()
        yield flush()

    return rows.mapInArrow(read, schema)
