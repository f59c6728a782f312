"""Chat formatting with typed content parts.

A turn's content is a list of typed parts; a visitor flattens them into text
with numbered placeholders and records each attachment's reference and the
tokens it expands to.  The template marks turns with control strings; those
that occur in a text are broken by an escape that reads back exactly.  Rows of
a conversation are formatted one after the other from a sorted partition, a
chunk a turn, so that no conversation is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END, BODY, STOP = "<s>", "</s>", "<|body|>", "<|end|>"
TURN = "<|turn|>"
#: Strings that mean something to this template or to other common ones.
CONTROL = (TURN, BODY, STOP, BEGIN, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|<\|(?:image|audio|document):|\\")


def escape(text: str) -> str:
    """Double backslashes and put one after the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


@dataclass
class Flat:
    """What a visit gives: text, attachments (kind, reference, tokens) in order, tokens of all placeholders."""

    text: str = ""
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    tokens: int = 0


class PartVisitor:
    """Flattens parts: dicts with type text, image, audio or document.

    image: ref, width, height (a token for each 28 x 28 patch, at most 1280 of
    them); audio: ref, seconds (25 a second); document: ref, pages (600 a
    page).  Missing sizes count as one patch, second or page; parts of other
    types raise ValueError.
    """

    def visit(self, parts: list[dict]) -> Flat:
        out = Flat()
        for part in parts:
            method = getattr(self, f"visit_{part.get('type')}", None)
            if method is None:
                raise ValueError(f"no part of type {part.get('type')!r}")
            method(part, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.text += escape(part.get("text") or "")

    def attach(self, kind: str, part: dict, tokens: int, out: Flat) -> None:
        out.text += f"<|{kind}:{len(out.attachments)}|>"
        out.attachments.append((kind, part.get("ref") or "", tokens))
        out.tokens += tokens

    def visit_image(self, part: dict, out: Flat) -> None:
        patches = -(-int(part.get("width") or 1) // 28) * -(-int(part.get("height") or 1) // 28)
        self.attach("image", part, min(1280, patches), out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self.attach("audio", part, max(1, round(25 * float(part.get("seconds") or 1))), out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self.attach("document", part, 600 * int(part.get("pages") or 1), out)


#: A formatted turn; the loss mask covers formatted[loss_start:loss_end].
CHUNK = "conv_id long, formatted string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string,tokens:int>>, expanded_tokens long"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def _format(batches):
    visitor = PartVisitor()
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), pa.int64()]
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for conv, role, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            flat = visitor.visit(parts if parts is not None else [{"type": "text", "text": text}])
            head = f"{TURN}{escape(role or '')}{BODY}"
            chunk = head + flat.text + STOP
            low, high = (len(head), len(head) + len(flat.text)) if role == "assistant" else (0, 0)
            made = [{"kind": k, "ref": r, "tokens": n} for k, r, n in flat.attachments]
            for c, v in zip(cols, (conv, chunk, low, high, made, flat.tokens), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])


def format_turns(rows: DataFrame) -> DataFrame:
    """One chunk for each row, conversations whole and in order within a partition.

    Rows need conv_id, turn, role, text and may have parts (which then stands
    for the text).  They are ordered by turn (null first), role and text; null
    texts and roles are empty.  A conversation is the concatenation of its
    chunks.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in rows.columns else F.lit(None).cast(PARTS)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("text"), parts.alias("parts"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "parts").mapInArrow(_format, CHUNK)


class _Reading:
    """Digests of a conversation, read from its formatted text, which comes in pieces cut anywhere.

    Turns are found by the control strings alone, which no escaped text holds;
    the loss mask is the spans that come with the pieces.
    """

    def __init__(self, conv):
        self.conv, self.n, self.loss, self.size, self.held = conv, 0, 0, 0, ""
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, low: int, high: int) -> None:
        text = unescape(piece[low:high])
        self.masked.update(text.encode("utf-8", "replace"))
        self.loss, self.size = self.loss + len(text), self.size + len(piece)
        *turns, self.held = (self.held + piece).split(STOP)
        for turn in turns:
            role, body, text = turn.removeprefix(TURN).partition(BODY)
            if not turn.startswith(TURN) or not body:
                raise ValueError(f"conversation {self.conv}: no turn at {turn[:40]!r}")
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "replace"))
            self.n += 1

    def row(self):
        if self.held:
            raise ValueError(f"conversation {self.conv}: no end of {self.held[:40]!r}")
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.size


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])
    now = None
    for batch in batches:
        rows = []
        for conv, chunk, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    rows.append(now.row())
                now = _Reading(conv)
            now.add(chunk, low, high)
        if rows:
            yield pack(rows)
    if now is not None:
        yield pack([now.row()])


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, turns and loss text recovered from what format_turns gives, in its order."""
    return chunks.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read, READ)
