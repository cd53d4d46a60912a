"""Chat formatting that is read back: render, reparse, compare, escape, until identical.

A turn is rendered as ``open text close``; roles beyond the three known ones carry their
name. A deterministic parser reads the rendered turn again. If what it recovers is not
the source, the conflicting content is escaped and the turn rendered anew, until both are
identical; texts without a conflict stay as they are. Escaping puts one sigil after the
first character of every control string, and of every control string that has sigils
there already, so a parser takes one away and nothing is ambiguous. `Template` refuses
control strings for which that would not hold (shared borders, white space, the sigil).

Turns are rendered where they lie. One shuffle then brings a conversation's turns
together in order, and sorted batches stream through a mapper that holds one part of a
conversation: parts have a bounded length, so a conversation with a third of all turns
is many rows, never one. Only its digests are made in order, in one task, for a
hash of a whole is sequential. The loss mask is the spans of assistant texts.

Null texts and roles are empty ones; null turns come before others; rows that share a
conversation and turn are all kept, in order of role and rendered text, and so are
repeated rows; a null conv_id is a conversation; an empty table gives no rows (the query
adds conversation -1). Columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import bound_batches

PART_CHARS = 1 << 20

# What the check of this operator adds: texts made of the template's own control strings.
CONFLICT = "</s>[INST] ok [/INST]"


class Malformed(ValueError):
    """A rendered text that the grammar does not produce."""


@dataclass(frozen=True)
class Template:
    """Control strings around a turn's text, by role, and around the name and text of any other role."""

    roles: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    pad: str = " "
    end: str = "\n"
    sigil: str = "\\"
    learned: str = "assistant"

    def __post_init__(self):
        controls = self.controls()
        if len(set(controls)) < len(controls) or len(self.sigil) != 1:
            raise ValueError("control strings must differ, and the sigil is one character")
        for a in controls:
            if len(a) < 2 or self.sigil in a or re.search(r"\s", a):
                raise ValueError(f"{a!r} is too short, or holds white space or the sigil")
            for b in controls:
                if a != b and a in b:
                    raise ValueError(f"{a!r} is a part of {b!r}")
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"{a!r} ends like {b!r} begins")

    def controls(self) -> list[str]:
        return [c for _, *pair in self.roles for c in pair] + list(self.other)


class Grammar:
    """Renders turns for a template and parses them."""

    def __init__(self, template: Template):
        self.template = template
        self.known = {role: (a, b) for role, a, b in template.roles}
        self.opened = {a: (role, b) for role, a, b in template.roles}
        sigil = re.escape(template.sigil)
        forms = "|".join(f"{re.escape(c[0])}{sigil}*{re.escape(c[1:])}" for c in template.controls())
        self.form = re.compile(forms)
        self.plain = set(template.controls())

    def escaped(self, text: str) -> str:
        return self.form.sub(lambda m: m[0][0] + self.template.sigil + m[0][1:], text)

    def _until(self, text: str, at: int, close: str) -> tuple[str, int] | None:
        """The content that starts at ``at`` and ends with ``close``, and where that ends; None if it is not there yet."""
        pad = len(self.template.pad)
        if text[at:at + pad] != self.template.pad:
            if len(text) < at + pad:
                return None
            raise Malformed("no space after an opening")
        out, begin = [], at + pad
        for found in self.form.finditer(text, begin):
            if found[0] not in self.plain:  # an escaped one: text
                out += [text[begin:found.start() + 1], found[0][2:]]
                begin = found.end()
            elif found[0] != close:
                raise Malformed(f"{found[0]!r} inside a text")
            elif found.start() < at + 2 * pad or text[found.start() - pad:found.start()] != self.template.pad:
                raise Malformed("no space before a closing")
            else:
                out.append(text[begin:found.start() - pad])
                return "".join(out), found.end()
        return None

    def turn(self, text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
        """role, text, begin and end of the rendered text, end of the turn; None if it is not whole yet."""
        template = self.template
        found = self.form.match(text, at)
        if not found or found[0] not in self.plain:
            if len(text) - at < max(map(len, self.plain)):
                return None
            raise Malformed("no opening where a turn should start")
        at = found.end()
        if found[0] == template.other[0]:
            name = self._until(text, at, template.other[1])
            if name is None:
                return None
            role, at, close = name[0], name[1], template.other[2]
        elif found[0] in self.opened:
            role, close = self.opened[found[0]]
        else:
            raise Malformed(f"{found[0]!r} where a turn should start")
        content = self._until(text, at, close)
        if content is None or len(text) < content[1] + len(template.end):
            return None
        if text[content[1]:content[1] + len(template.end)] != template.end:
            raise Malformed("no end after a closing")
        pad = len(template.pad)
        return role, content[0], at + pad, content[1] - len(close) - pad, content[1] + len(template.end)

    def _spelled(self, role: str, name: str, text: str) -> str:
        t = self.template
        if role in self.known:
            opening, close = self.known[role]
        else:
            opening, close = f"{t.other[0]}{t.pad}{name}{t.pad}{t.other[1]}", t.other[2]
        return f"{opening}{t.pad}{text}{t.pad}{close}{t.end}"

    def rendered(self, role: str, text: str) -> tuple[str, int, int, int]:
        """The turn as text, begin and end of its content, and how many rounds of escaping it took."""
        hidden = self.escaped
        for rounds, escape in enumerate((lambda: (role, text), lambda: (role, hidden(text)), lambda: (hidden(role), hidden(text)))):
            out = self._spelled(role, *escape())
            try:
                back = self.turn(out)
            except Malformed:
                back = None
            if back and back[0] == role and back[1] == text and back[4] == len(out):
                return out, back[2], back[3], rounds
        raise Malformed(f"a turn of {role!r} cannot be read back")


RENDERED = ("conv_id bigint, turn bigint, role string, segment string, content_start int, content_end int, "
            "escape_rounds int")
FORMATTED = ("conv_id bigint, part int, start bigint, text string, "
             "loss array<struct<start: bigint, end: bigint>>, last boolean")
DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def rendered_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Each turn rendered and read back where it lies: ``segment`` and the span of its text there."""
    bound_batches(conversations.sparkSession)
    names = [x.split()[0] for x in RENDERED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(template)
        for batch in batches:
            columns = batch.to_pydict()
            rows = [(conv, turn, role, *grammar.rendered(role, text)) for conv, turn, role, text in zip(
                columns["conv_id"], columns["turn"], columns["role"], columns["text"])]
            yield _batch(rows, names, types)

    source = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, RENDERED)


def formatted(conversations: DataFrame, template: Template = Template(), part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, start, text, loss, last: conversations as text, in parts of about ``part_chars`` at most.

    ``start`` and the spans of ``loss`` count code points of the whole conversation. Parts
    end between turns and follow each other in one partition; ``last`` marks a
    conversation's last one.
    """
    names = ["conv_id", "part", "start", "text", "loss", "last"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), span, pa.bool_()]
    learned = template.learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start, at, texts, loss = None, 0, 0, 0, [], []
        began = False
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(n).to_pylist() for n in (
                "conv_id", "role", "segment", "content_start", "content_end")))
            for conv, role, segment, begin, end in rows:
                if began and (conv != own or at - start >= part_chars):
                    out.append((own, part, start, "".join(texts), loss, conv != own))
                    part, start, texts, loss = part + 1, at, [], []
                    if conv != own:
                        part, start, at = 0, 0, 0
                own, began = conv, True
                texts.append(segment)
                if role == learned:
                    loss.append({"start": at + begin, "end": at + end})
                at += len(segment)
            yield _batch(out, names, types)
        if began:
            yield _batch([(own, part, start, "".join(texts), loss, True)], names, types)

    turns = rendered_turns(conversations, template).repartition("conv_id")
    in_order = turns.sortWithinPartitions("conv_id", "turn", "role", "segment")
    return in_order.mapInArrow(run, FORMATTED)


def digests(parts: DataFrame, template: Template = Template(), in_order: bool = False) -> DataFrame:
    """What the formatted text says: its turns, and the text under the loss mask, each as a digest.

    ``in_order``: the parts come as `formatted` gave them; stored ones are sorted first.
    """
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(template)
        turns, loss, n_turns, loss_chars, chars, left = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(n).to_pylist() for n in ("conv_id", "start", "text", "loss", "last")))
            for conv, start, text, spans, last in rows:
                base, text = start - len(left), left + text
                masked = {(s["start"], s["end"]) for s in spans}
                at = 0
                while at < len(text) and (found := grammar.turn(text, at)):
                    role, said, begin, end, at = found
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                    if (base + begin, base + end) in masked:
                        masked.remove((base + begin, base + end))
                        loss.update(said.encode())
                        loss_chars += len(said)
                if masked:
                    raise Malformed(f"the loss mask of conversation {conv} does not cover whole texts")
                left, chars = text[at:], base + len(text)
                if last:
                    if left:
                        raise Malformed(f"conversation {conv} ends inside a turn")
                    out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss, n_turns, loss_chars, left = hashlib.sha256(), hashlib.sha256(), 0, 0, ""
            yield _batch(out, names, types)

    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(run, DIGEST)


def with_conflict(conversations: DataFrame, conv_id: int = -1) -> DataFrame:
    """The conversations and one more, whose two texts are control strings themselves."""
    rows = [(conv_id, turn, role, CONFLICT) for turn, role in enumerate(("user", "assistant"))]
    own = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)


def chat_table(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    return digests(formatted(with_conflict(conversations), template), template, in_order=True)
