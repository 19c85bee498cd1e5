"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor flattens them in order: text parts are
escaped, each other part becomes one placeholder and leaves a reference to its attachment with the number of tokens
that the placeholder stands for.  A turn is ``<|im_start|>role<|im_sep|>content<|im_end|>``; control strings inside
roles and texts are broken by a backslash after their first character (backslashes are doubled), which ``unescape``
takes back.  The loss mask covers the text parts of assistant turns.

Turns are formatted where they are read; a conversation is the formatted turns in order (by turn, then role, then
content), so no task needs a whole conversation in memory.  ``digests`` streams through the sorted turns.

Defined results: null texts are empty; null roles are the empty role; null turns come first; rows with a null
conversation id form one conversation with a null id; repeated rows are repeated turns; ties of turn numbers go by role
and content; texts are formatted whole, whatever their length; empty tables give empty results; other columns are
ignored, whatever their names.  Malformed typed content: see ``parts_of``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that common templates treat as control; texts can't contain them unbroken.
CONTROLS = (START, SEPARATOR, END, *PLACEHOLDERS.values(), "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROLS))
_BREAK = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}", re.DOTALL)
_MARKS = re.compile("(" + "|".join(re.escape(x) for x in PLACEHOLDERS.values()) + ")")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BREAK.sub(r"\1", text)


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, visitor: Flatten) -> None:
        visitor.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0
    patch: int = 14

    def accept(self, visitor: Flatten) -> None:
        visitor.attachment("image", self.ref, max(1, -(-self.width // self.patch) * -(-self.height // self.patch)))


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0
    tokens_per_second: int = 25

    def accept(self, visitor: Flatten) -> None:
        visitor.attachment("audio", self.ref, max(1, round(self.seconds * self.tokens_per_second)))


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 1
    tokens_per_page: int = 768

    def accept(self, visitor: Flatten) -> None:
        visitor.attachment("document", self.ref, max(1, self.pages * self.tokens_per_page))


@dataclass
class Flatten:
    """Visits parts in order and gathers the content string, text spans and attachments."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def _add(self, piece: str) -> int:
        at = self.length
        self.out.append(piece)
        self.length += len(piece)
        return at

    def text(self, part: Text) -> None:
        at = self._add(escape(part.text))
        if self.length > at:
            self.spans.append((at, self.length))

    def attachment(self, kind: str, ref: str, tokens: int) -> None:
        at = self._add(PLACEHOLDERS[kind])
        self.attachments.append({"kind": kind, "ref": ref, "at": at, "tokens": tokens})


def _number(value: object, kind: type, least: float = 0) -> float | int:
    """A finite number of ``kind`` (numbers in strings count); anything else and what is below ``least``: ``least``."""
    try:
        x = float(value) if isinstance(value, (int, float, str)) else math.nan
    except (ValueError, OverflowError):
        x = math.nan
    return kind(x) if math.isfinite(x) and x >= least else kind(least)


def _string(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


def part_of(raw: object) -> Text | Image | Audio | Document:
    """One part from its JSON value: see ``parts_of``."""
    if isinstance(raw, str):
        return Text(raw)
    kind = raw.get("type") if isinstance(raw, dict) else None
    ref = _string(raw.get("ref")) if isinstance(raw, dict) else ""
    if kind == "text":
        return Text(_string(raw.get("text")))
    if kind == "image":
        return Image(ref, _number(raw.get("width"), int), _number(raw.get("height"), int), _number(raw.get("patch", 14), int, 1))
    if kind == "audio":
        return Audio(ref, _number(raw.get("seconds"), float), _number(raw.get("tokens_per_second", 25), int))
    if kind == "document":
        return Document(ref, _number(raw.get("pages", 1), int), _number(raw.get("tokens_per_page", 768), int))
    return Text(json.dumps(raw, ensure_ascii=False))


def parts_of(content: str | None, typed: bool) -> list:
    """The parts of a JSON list such as ``[{"type": "image", "ref": "a.png", "width": 28, "height": 28}]``.

    Untyped content, and typed content that isn't a JSON list, is one text part, as it stands.  In a list, strings are
    text parts; null or missing texts and references are empty; sizes that are no finite numbers count as the least
    one; a part that is no object or of no known type is a text part of its JSON; unknown fields are ignored.
    """
    if not typed:
        return [Text(content or "")]
    try:
        raw = json.loads(content or "[]")
    except (ValueError, RecursionError):
        return [Text(content)]
    return [part_of(p) for p in raw] if isinstance(raw, list) else [Text(content)]


def format_turn(role: str | None, parts: list) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted turn, its loss spans and its attachments (places count from the turn's start)."""
    visitor = Flatten()
    for part in parts:
        part.accept(visitor)
    head = START + escape(role or "") + SEPARATOR
    shift = len(head)
    spans = [(a + shift, b + shift) for a, b in visitor.spans] if role == LOSS_ROLE else []
    return head + "".join(visitor.out) + END, spans, [x | {"at": x["at"] + shift} for x in visitor.attachments]


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text (placeholders as they are) of one formatted turn."""
    m = _TURN.fullmatch(formatted)
    return unescape(m[1]), "".join(x if x in PLACEHOLDERS.values() else unescape(x) for x in _MARKS.split(m[2]))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))
_FORMATTED = (
    "conv_id long, turn long, formatted string, loss array<struct<start: long, end: long>>, "
    "attachments array<struct<kind: string, ref: string, at: long, tokens: long>>"
)


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", typed: bool = False) -> DataFrame:
    """One row per turn: ``conv_id, turn, formatted, loss, attachments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, parts_of(c, typed)) for r, c in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array([x[0] for x in made], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in made], _SPAN),
                    pa.array([x[2] for x in made], _ATTACHED),
                ],
                ["conv_id", "turn", "formatted", "loss", "attachments"],
            )

    def named(c: str, kind: str, alias: str) -> Column:
        return F.col(c).cast(kind).alias(alias)

    rows = turns.select(named(id_col, "long", "conv_id"), named(turn_col, "long", "turn"), named(role_col, "string", "role"), named(content_col, "string", "content"))
    return rows.mapInArrow(run, _FORMATTED)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_turns``, one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list | None = None  # id, turns, digest, loss length, loss digest, length

        def closed(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for batch in batches:
            done = []
            for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf8", "replace"))
                for span in loss:
                    masked = unescape(text[span["start"] : span["end"]])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf8", "replace"))
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(state), kinds, strict=True)], names)

    rows = formatted.select("conv_id", "turn", "formatted", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, _DIGESTS)
