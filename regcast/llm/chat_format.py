"""Chat formatting: typed content parts, flattened by a visitor into one marked text.

A turn holds parts (text, image, audio, document). The visitor has one method
per type: text is escaped, anything else becomes a placeholder, and its
reference, position and expanded token count are recorded. Control strings all
start with ``<|``; in texts a backslash is put behind that ``<`` (one more,
where backslashes stand there already), which can be undone exactly, so no text
can forge a mark.

Turns are formatted where they lie. One sort by (conversation, turn) then puts
them in order, and tasks stream through their conversations in chunks of whole
turns, so a conversation of any length passes in bounded memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from regcast.llm.common import prepare

#: Marks of the template (fixed values).
START, END, OPEN, CLOSE = "<|im_start|>", "<|im_end|>", "<|", "|>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Characters of formatted text in one row of the output; a longer turn is one row.
CHUNK_CHARS = 1 << 20

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ATTACHMENTS = "attachments array<struct<kind:string,ref:string,turn:long,position:long,tokens:long>>"
TURN_OUT = f"text string, mask array<struct<start:long,end:long>>, {_ATTACHMENTS}"
CHUNK_OUT = f"chunk long, n_turns long, text string, start long, mask array<struct<start:long,end:long>>, {_ATTACHMENTS}"
READ_OUT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, media_tokens long"
READ_NAMES = [c.split()[0] for c in READ_OUT.split(", ")]
READ_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
MEDIA = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("position", pa.int64()), ("tokens", pa.int64())]))

_FORGED, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT, _ROLE_IN = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}, re.compile(r"\\([\\np])")


def _schema(ddl: str, *first: StructField) -> StructType:
    return StructType([*first, *StructType.fromDDL(ddl).fields])


def escape(text: str) -> str:
    return _FORGED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return "".join(_ROLE_OUT.get(c, c) for c in role)


def unescape_role(role: str) -> str:
    return _ROLE_IN.sub(lambda m: {"\\": "\\", "n": "\n", "p": "|"}[m.group(1)], role)


class PartVisitor:
    """Visits the parts of one turn in order and builds its content.

    Neighbouring texts are joined before they are escaped, so that a mark cannot
    be put together from two parts. Expanded tokens: an image has one per
    ``patch`` x ``patch`` square, audio ``audio_rate`` per second, a document
    ``page_tokens`` per page; sizes that are missing count as 0. A part of any
    other type is a placeholder of 0 tokens if it has a reference, else its text.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1_000):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.pieces: list[str] = []
        self.loose: list[str] = []
        self.attachments: list[tuple[str, str | None, int, int]] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(kind, self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.loose.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(part.get(c) or 0, 0) / self.patch) for c in ("width", "height"))
        self.placeholder("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self.placeholder("audio", part, math.ceil(seconds * self.audio_rate) if 0 < seconds < math.inf else 0)

    def visit_document(self, part: dict) -> None:
        self.placeholder("document", part, max(part.get("pages") or 0, 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        if part.get("ref") is None:
            self.visit_text(part)
        else:
            self.placeholder("file", part, 0)

    def placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append((kind, part.get("ref"), sum(map(len, self.pieces)), tokens))
        self.pieces.append(f"{OPEN}{kind}{CLOSE}")

    def flush(self) -> None:
        if self.loose:
            self.pieces.append(escape("".join(self.loose)))
            self.loose = []

    def content(self) -> str:
        self.flush()
        return "".join(self.pieces)


def format_turn(role: str, parts: list[dict], learned: str = LEARNED, visitor: Callable[[], PartVisitor] = PartVisitor) -> tuple[str, list[tuple[int, int]], list[tuple]]:
    """Formatted turn, spans under the loss mask and attachments, all counted from the turn's start."""
    seen = visitor()
    for part in parts:
        seen.visit(part)
    content, head = seen.content(), f"{START}{escape_role(role)}\n"
    span, at = [], len(head)
    if role == learned:
        edges = [0, *[x for kind, _, where, _ in seen.attachments for x in (where, where + len(OPEN + kind + CLOSE))], len(content)]
        span = [(at + a, at + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return f"{head}{content}{END}\n", span, [(kind, ref, at + where, tokens) for kind, ref, where, tokens in seen.attachments]


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_MEDIA = re.compile(r"<\|(image|audio|document|file)\|>")


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; placeholders are left out."""
    for turn in _TURN.finditer(text):
        yield unescape_role(turn.group(1)), "".join(unescape(piece) for piece in _MEDIA.split(turn.group(2))[::2])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", content_col: str | None = None, learned: str = LEARNED, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Conversations as rows (conv_id, chunk, n_turns, text, start, mask, attachments), turns in order.

    The texts of a conversation's chunks, joined by chunk, are the formatted
    conversation; ``start``, the mask's spans and the attachments' positions
    count code points of that whole text. Parts come from ``content_col`` (an
    array of ``PART``) where given and not null, else the text is the only part.
    Null texts and roles are read as empty; a null conversation id is one more
    conversation; turns that share a number (null before all) are ordered by
    role, text and attachments, so repeated rows are kept, one after the other. An
    empty table gives no row. ``conv_id`` keeps its type, other columns are
    never read. A conversation's chunks follow each other in one partition.
    """
    prepare(turns.sparkSession)
    parts = F.col(f"`{content_col}`").cast(f"array<{PART}>") if content_col else F.lit(None).cast(f"array<{PART}>")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"), parts.alias("parts"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for role, text, parts in zip(*(b.column(c).to_pylist() for c in ("role", "text", "parts")), strict=True):
                out.append(format_turn(role, [{"type": "text", "text": text}] if parts is None else [p or {} for p in parts], learned))
            mask = [[{"start": s, "end": e} for s, e in spans] for _, spans, _ in out]
            media = [[dict(zip(("kind", "ref", "turn", "position", "tokens"), (kind, ref, 0, at, n), strict=True)) for kind, ref, at, n in found] for _, _, found in out]
            columns = [b.column("conv_id"), b.column("turn"), pa.array([text for text, _, _ in out], pa.string()), pa.array(mask, SPANS), pa.array(media, MEDIA)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "text", "mask", "attachments"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunks(batches, chunk_chars)

    fields = [slim.schema["conv_id"], slim.schema["turn"]]
    formatted = slim.mapInArrow(write, _schema(TURN_OUT, *fields))
    # whoever holds a conversation streams through its turns: a long one is bounded in memory
    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text", "attachments")
    return in_order.mapInArrow(chunks, _schema(CHUNK_OUT, fields[0]))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_chars: int) -> Iterator[pa.RecordBatch]:
    """Turns in order to chunks of whole turns: offsets run on from one chunk of a conversation to the next."""
    now, number, turn, start = object(), 0, 0, 0
    texts: list[str] = []
    mask: list[dict] = []
    media: list[dict] = []
    size = 0

    def row() -> pa.RecordBatch:
        columns = [pa.array([x], t) for x, t in ((now, kind), (number, pa.int64()), (len(texts), pa.int64()), ("".join(texts), pa.string()), (start, pa.int64()), (mask, SPANS), (media, MEDIA))]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "chunk", "n_turns", "text", "start", "mask", "attachments"])

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, text, spans, found in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "mask", "attachments")), strict=True):
            if texts and (conv != now or size + len(text) > chunk_chars):
                yield row()
                number, start, texts, mask, media, size = number + 1, start + size, [], [], [], 0
            if conv != now:
                now, number, turn, start = conv, 0, 0, 0
            at = start + size
            mask += [{"start": at + s["start"], "end": at + s["end"]} for s in spans]
            media += [f | {"turn": turn, "position": at + f["position"]} for f in found]
            texts.append(text)
            turn, size = turn + 1, size + len(text)
    if texts:
        yield row()


def read_back(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, media_tokens from ``format_conversations``.

    Everything but the last two is read from the formatted texts and the mask
    alone. The chunks of a conversation must follow each other in one partition,
    as ``format_conversations`` leaves them; digests are updated chunk by chunk.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, state = object(), pa.null(), None

        def row() -> pa.RecordBatch:
            values = (now, state["turns"], state["told"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["media"], state["tokens"])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (kind, *READ_TYPES), strict=True)], names=["conv_id", *READ_NAMES])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, text, start, mask, media in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "start", "mask", "attachments")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        yield row()
                    now, state = conv, {"turns": 0, "told": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "media": 0, "tokens": 0}
                for role, said in read_turns(text):
                    state["turns"] += 1
                    state["told"].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    learned = unescape(text[span["start"] - start : span["end"] - start])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["size"] += len(text)
                state["media"] += len(media)
                state["tokens"] += sum(m["tokens"] for m in media)
        if state is not None:
            yield row()

    return chunks.mapInArrow(read, _schema(READ_OUT, chunks.schema["conv_id"]))
