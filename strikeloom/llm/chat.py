"""Chat formatting: typed content parts flattened into text with placeholders, a loss mask and attachments.

The template marks each turn; control strings inside roles and texts are broken up
reversibly, so that only the template itself writes them. A conversation leaves
as one segment for each turn with positions counted over the whole conversation,
so that memory doesn't grow with it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import slices

OPEN, BODY, CLOSE = "<|turn|>", "\n", "<|end|>\n"
CONTROL = ("<|turn|>", "<|end|>", "<|image:", "<|audio:", "<|document:", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_STARTS = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_BACK = {"e": "\\", "b": "", "n": "\n"}


def escape(text: str) -> str:
    """``text`` with no control string in it: backslashes become \\e, and \\b goes after the first character of each control string."""
    return _STARTS.sub(r"\1\\b", text.replace("\\", "\\e"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


@dataclass
class Flat:
    """What a visitor has gathered of one turn."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    text_tokens: int = 0
    length: int = 0  # of all of ``text``

    def add(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)


class PartVisitor:
    """Flattens the parts of a turn, each kind by its own method; attachments are numbered through a conversation.

    An attachment's tokens are what its placeholder expands to: an image's
    ``patch`` squares, an audio's ``rate`` frames a second, a document's
    ``page_tokens`` a page; text is estimated apart, at a token for four bytes. A part of an unknown
    kind is an attachment of no tokens with a placeholder ``unknown`` that has its
    kind noted; a null part is left out; missing sizes count as 0.
    """

    def __init__(self, patch: int = 28, rate: float = 12.5, page_tokens: int = 256):
        self.patch, self.rate, self.page_tokens, self.count = patch, rate, page_tokens, 0

    def visit(self, parts: Iterable[dict]) -> Flat:
        flat = Flat()
        for part in parts:
            if part is not None:
                VISITS.get(part.get("type") or "text", PartVisitor.visit_other)(self, part, flat)
        return flat

    def visit_text(self, part: dict, flat: Flat) -> None:
        text = part.get("text") or ""
        flat.add(escape(text))
        flat.text_tokens += -(-len(text.encode()) // 4)

    def visit_image(self, part: dict, flat: Flat) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch), flat)

    def visit_audio(self, part: dict, flat: Flat) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rate), flat)

    def visit_document(self, part: dict, flat: Flat) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens, flat)

    def visit_other(self, part: dict, flat: Flat) -> None:
        self.attach("unknown", part, 0, flat)

    def attach(self, kind: str, part: dict, tokens: int, flat: Flat) -> None:
        at = flat.length
        flat.add(f"<|{kind}:{self.count}|>")
        flat.attachments.append({"number": self.count, "kind": kind if kind != "unknown" else part["type"], "ref": part.get("ref"), "at": at, "tokens": tokens})
        flat.tokens += tokens
        self.count += 1


VISITS = {"text": PartVisitor.visit_text, "image": PartVisitor.visit_image, "audio": PartVisitor.visit_audio, "document": PartVisitor.visit_document}
PART = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))])
ATTACHMENT = T.StructType([T.StructField(n, t) for n, t in (("number", T.LongType()), ("kind", T.StringType()), ("ref", T.StringType()), ("at", T.LongType()), ("tokens", T.LongType()))])
SEGMENT = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("position", T.LongType()), ("start", T.LongType()), ("segment", T.StringType()), ("loss_start", T.LongType()), ("loss_end", T.LongType()), ("attachments", T.ArrayType(ATTACHMENT)), ("expanded_tokens", T.LongType()), ("text_tokens", T.LongType()))])
_ATTACHMENT = pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(_ATTACHMENT)), ("expanded_tokens", pa.int64()), ("text_tokens", pa.int64())])


def format_conversations(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each conversation as segments in order, see SEGMENT; positions are code points from the conversation's start.

    ``turns`` has conv_id, turn, role, and text or ``parts`` (array of PART; where
    it's null, text counts). Turns go by turn number, ties by role and text; null
    numbers come first, null roles and texts are empty, a null conv_id is a
    conversation of its own; repeated rows are turns of their own; other columns are
    left out; an empty table gives an empty table. ``loss_start`` and ``loss_end``
    frame what a model learns, the flattened content of turns whose role is in
    ``learned``, else null. A conversation is a stream within one task: its digests
    and positions follow the order of its turns, but only one turn is in memory.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]))
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(T.ArrayType(PART)), parts)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), parts.alias("parts"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        visitor, position, at = PartVisitor(), 0, 0
        for batch in batches:
            for part in slices(batch, 500):
                out = []
                for r in part.to_pylist():
                    if now != (r["conv_id"],):
                        now, visitor, position, at = (r["conv_id"],), PartVisitor(), 0, 0
                    flat = visitor.visit(r["parts"])
                    head = OPEN + escape(r["role"]).replace("\n", "\\n") + BODY
                    body = "".join(flat.text)
                    segment = head + body + CLOSE
                    inside = at + len(head)
                    for x in flat.attachments:
                        x["at"] += inside
                    mask = (inside, inside + len(body)) if r["role"] in learned else (None, None)
                    out.append({"conv_id": r["conv_id"], "position": position, "start": at, "segment": segment, "loss_start": mask[0], "loss_end": mask[1], "attachments": flat.attachments, "expanded_tokens": flat.tokens, "text_tokens": flat.text_tokens})
                    position, at = position + 1, at + len(segment)
                yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT)

    return dealt.mapInArrow(run, SEGMENT)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and flattened content (still escaped) of one marked turn."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a marked turn")
    role, _, body = segment[len(OPEN) : -len(CLOSE)].partition(BODY)
    if OPEN in body or CLOSE.rstrip("\n") in body:
        raise ValueError("a control string inside a turn")
    return unescape(role), body


READ = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of roles, texts and learned texts of each conversation, read from its segments, in whatever order they are stored.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; a null
    conv_id is a conversation; an empty table gives an empty table. A conversation is
    read by one task, because its digests are of one stream, one segment at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        n = chars = loss = 0
        turns, learned = hashlib.sha256(), hashlib.sha256()

        def ended() -> dict:
            return {"conv_id": now[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss, "loss_sha256": learned.hexdigest(), "formatted_chars": chars}

        fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for part in (p for batch in batches for p in slices(batch, 500)):
            out = []
            for r in part.to_pylist():
                if now != (r["conv_id"],):
                    if now is not None:
                        out.append(ended())
                    now, n, chars, loss, turns, learned = (r["conv_id"],), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                segment = r["segment"]
                role, body = parse_segment(segment)
                turns.update(f"{role}\n{unescape(body)}\n".encode())
                if r["loss_start"] is not None:
                    text = unescape(segment[r["loss_start"] - r["start"] : r["loss_end"] - r["start"]])
                    loss += len(text)
                    learned.update(text.encode())
                n, chars = n + 1, chars + len(segment)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=fields)

    dealt = formatted.select("conv_id", "position", "start", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(run, READ)
