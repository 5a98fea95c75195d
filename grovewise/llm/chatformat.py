"""Chat formatting by columnar byte assembly.

Turns are formatted where they lie: for a slice of rows, the lengths of all segments (control strings, escaped role,
escaped text) are computed as columns, their running sums are the offsets, and numpy scatters headers and contents to
their places in one preallocated Arrow buffer. Then rows are dealt by conversation, sorted, and the texts of whole
conversations are new offsets over the sorted batches' buffers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import text_slices

TURNS = "conv_id long, turn long, formatted string, chars long, loss_start long, loss_chars long"
CONVERSATIONS = "conv_id long, part int, n_turns long, text string, loss array<struct<start: long, length: long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64())])
_OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(_SPAN))])
BLOCK = 1 << 20  # bytes scattered at a time: what indices take doesn't follow the length of a text


@dataclass(frozen=True)
class Template:
    """``begin role said text end after`` for each turn. ``begin``, ``said`` and ``end`` are the control strings; where one
    occurs in a role or text, and before each ``escape``, an ``escape`` is put. Texts of roles in ``learned`` are under
    the loss mask. Control strings share a first character that is found nowhere else in them, so an escape before it
    undoes the whole string, and no text completes one with what follows."""

    begin: str = "<turn>"
    said: str = "<text>"
    end: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        first = self.begin[:1]
        if not all(c.isascii() and c[:1] == first and first not in c[1:] and self.escape not in c for c in self.controls) or len(set(self.controls)) < 3:
            raise ValueError("control strings need one first character, ASCII, that isn't found elsewhere in them")
        if len(self.escape) != 1 or not self.escape.isascii() or first in self.after or self.escape in self.after:
            raise ValueError("the escape is one ASCII character; what follows a turn holds neither it nor a control's first character")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.begin, self.said, self.end

    @cached_property
    def _marks(self) -> re.Pattern[str]:
        return re.compile(f"{re.escape(self.escape)}.|" + "|".join(map(re.escape, self.controls)), re.DOTALL)

    @cached_property
    def _escaped(self) -> re.Pattern[str]:
        return re.compile(f"{re.escape(self.escape)}(.)", re.DOTALL)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text) if self.escape in text else text

    def read(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn of a formatted text, unescaped."""
        began = said = 0
        for m in self._marks.finditer(text):
            if m[0] == self.begin:
                began = m.end()
            elif m[0] == self.said:
                said = m.end()
            elif m[0] == self.end:
                yield self.unescape(text[began : said - len(self.said)]), self.unescape(text[said : m.start()])


DEFAULT = Template()


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and the n + 1 offsets of its rows in them."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _to_escape(data: np.ndarray, at: np.ndarray, template: Template) -> np.ndarray:
    """Where in ``data`` an escape has to precede, rising."""
    part = data[at[0] : at[-1]]
    found = [np.flatnonzero(part == ord(template.escape))]
    starts = np.flatnonzero(part == ord(template.begin[0]))
    if len(starts):
        ends = at[np.searchsorted(at, starts + at[0], side="right")] - at[0]  # of the row of each start
        for control in map(str.encode, template.controls):
            left = starts[starts + len(control) <= ends]
            for i, byte in enumerate(control):
                left = left[part[left + i] == byte]
            found.append(left)
    return np.sort(np.concatenate(found)) + at[0]


def _scatter(out: np.ndarray, data: np.ndarray, at: np.ndarray, starts: np.ndarray, marks: np.ndarray, escape: int) -> None:
    """Every row's bytes to ``out`` from ``starts`` on, with an escape before each mark."""
    shift = starts - at[:-1] - np.searchsorted(marks, at[:-1])
    for a in range(int(at[0]), int(at[-1]), BLOCK):
        b = min(a + BLOCK, int(at[-1]))
        first, last = np.searchsorted(marks, (a, b))
        here, bump = marks[first:last] - a, np.zeros(b - a, np.int64)
        bump[here] = 1
        to = np.arange(a, b) + np.repeat(shift, np.diff(np.clip(at, a, b))) + np.cumsum(bump) + first
        out[to] = data[a:b]
        out[to[here] - 1] = escape


def assemble(role: pa.Array, text: pa.Array, template: Template = DEFAULT) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns as one string column over one buffer; their code points, where in them the text begins, and its
    code points, escapes included."""
    n = len(text)
    (roles, role_at), (texts, text_at) = _bytes(role), _bytes(text)
    role_marks, text_marks = _to_escape(roles, role_at, template), _to_escape(texts, text_at, template)
    role_more, text_more = np.diff(np.searchsorted(role_marks, role_at)), np.diff(np.searchsorted(text_marks, text_at))
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (template.begin, template.said, template.end + template.after)]
    begin, said, end = (np.full(n, len(f)) for f in fixed)
    segments = np.stack([begin, np.diff(role_at) + role_more, said, np.diff(text_at) + text_more, end], axis=1)
    offsets = np.append(0, np.cumsum(segments.ravel()))
    starts = offsets[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for content, column in zip(fixed, (0, 2, 4), strict=True):
        out[(starts[:, column, None] + np.arange(len(content))).ravel()] = np.tile(content, n)
    _scatter(out, roles, role_at, starts[:, 1], role_marks, ord(template.escape))
    _scatter(out, texts, text_at, starts[:, 3], text_marks, ord(template.escape))
    rows = np.append(starts[:, 0], offsets[-1])
    if rows[-1] > np.iinfo(np.int32).max:
        raise ValueError("formatted turns of more than 2 GB in one batch")
    role_chars, text_chars = (pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text))
    loss_start, loss_chars = len(template.begin) + role_chars + role_more + len(template.said), text_chars + text_more
    formatted = pa.StringArray.from_buffers(n, pa.py_buffer(rows.astype(np.int32)), buffer)
    return formatted, loss_start + loss_chars + len(template.end + template.after), loss_start, loss_chars


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, formatted, chars, loss_start, loss_chars) of every row (conv_id long, turn long, role, text).

    Null roles and texts are empty; null ids and turns stay; repeated rows are turns each; an empty table gives no rows;
    other columns are ignored. ``loss_start`` and ``loss_chars`` are code points of ``formatted``, null for turns outside
    the loss mask. No shuffle. Beside a batch (bounded by bytes) a task holds about 20 MB, and one text with its copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "text"):
                role, text = rows.column("role").fill_null(""), rows.column("text").fill_null("")
                formatted, chars, start, length = assemble(role, text, template)
                masked = ~np.isin(np.array(role.to_pylist(), object), template.learned)
                columns = [rows.column("conv_id"), rows.column("turn"), formatted, pa.array(chars), pa.array(start, mask=masked), pa.array(length, mask=masked)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "formatted", "chars", "loss_start", "loss_chars"])

    own = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return conversations.select(*own).mapInArrow(run, TURNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Batches, the rows at which runs of one conversation start, and whether the first run goes on from the batch before."""
    last: object = ...
    for batch in batches:
        if batch.num_rows:
            ids, null = batch.column("conv_id").fill_null(0).to_numpy(), batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))
            yield batch, first, batch.column("conv_id")[0].as_py() == last
            last = batch.column("conv_id")[batch.num_rows - 1].as_py()


def _whole(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Conversations of sorted turns. What is still open at a batch's end is kept, up to ``part_bytes``."""
    kept: list[pa.RecordBatch] = []  # turns of one conversation, not yet given out
    part, size = 0, 0

    def given(rows: pa.RecordBatch, first: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        """One row for each run of ``rows`` that starts at ``first``: text is new offsets over the same buffer."""
        data, at = _bytes(rows.column("formatted"))
        bounds = np.append(first, rows.num_rows)
        chars = np.append(0, np.cumsum(rows.column("chars").to_numpy()))
        learned = np.flatnonzero(rows.column("loss_start").is_valid().to_numpy(zero_copy_only=False))
        start = rows.column("loss_start").drop_null().to_numpy() + chars[learned]
        start = start - chars[first[np.searchsorted(first, learned, side="right") - 1]] if len(learned) else start
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), rows.column("loss_chars").drop_null()], fields=list(_SPAN))
        loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, bounds), pa.int32()), spans)
        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(at[bounds].astype(np.int32)), rows.column("formatted").buffers()[2])
        ids = rows.column("conv_id").take(pa.array(first))
        return pa.RecordBatch.from_arrays([ids, pa.array(parts, pa.int32()), pa.array(np.diff(bounds), pa.int64()), text, loss], schema=_OUT)

    def closed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        return given(rows, np.zeros(1, np.int64), np.array([part]))

    for batch, first, goes_on in _runs(batches):
        if goes_on:
            kept.append(batch.slice(0, int(first[1]) if len(first) > 1 else batch.num_rows))
            size += kept[-1].nbytes
            first = first[1:]
        if kept and (len(first) or size >= part_bytes):
            yield closed()
            kept, part, size = [], part + 1, 0
        if len(first):
            if len(first) > 1:
                done = batch.slice(int(first[0]), int(first[-1] - first[0]))
                yield given(done, first[:-1] - first[0], np.zeros(len(first) - 1, np.int64))
            kept, part = [batch.slice(int(first[-1]))], 0
            size = kept[0].nbytes
    if kept:
        yield closed()


def format_conversations(conversations: DataFrame, template: Template = DEFAULT, part_bytes: int = 64 << 20) -> DataFrame:
    """(conv_id, part, n_turns, text, loss) of every conversation, its turns by ``turn``.

    ``loss`` are the spans of ``text``, in code points, that a model learns from: the texts of the template's learned
    roles. Turns of one number go by their formatted text, those without a number come first; rows without an id are one
    conversation. See ``format_turns`` for other odd rows. A conversation of more than ``part_bytes`` comes in parts of
    whole turns, from 0, with spans of their own; its parts are consecutive rows of one partition, in order. Rows of one
    conversation meet in one task, since its text is one, but pass through it in batches: a task holds ``part_bytes``
    and a batch at most, however long a conversation is. Formatting itself is done before, where the rows lie.
    """
    turns = format_turns(conversations, template).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return turns.mapInArrow(lambda batches: _whole(batches, part_bytes), CONVERSATIONS)


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict[str, int]], template: Template) -> None:
        for role, said in template.read(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            learned = template.unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(text)


def conversation_digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what
    ``format_conversations`` gives: turns are parsed out of the text, unescaped, and hashed as role, line end, text, line
    end; the text under the loss mask is hashed by itself. Hashes go on over the parts of a conversation."""

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def given(done: list[_Digest]) -> pa.RecordBatch:
        columns = zip(*((d.conv_id, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars) for d in done), strict=True)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Digest] = []  # the last one is still open
        for batch in batches:
            for conv_id, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss")), strict=True):
                if part == 0:
                    done.append(_Digest(conv_id))
                done[-1].add(text, loss, template)
            if len(done) > 1:
                yield given(done[:-1])
                done = done[-1:]
        if done:
            yield given(done)

    return formatted.select("conv_id", "part", "text", "loss").mapInArrow(run, DIGESTS)
