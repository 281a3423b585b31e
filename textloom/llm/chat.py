r"""Chat formatting with typed content parts, reversible and with a loss mask.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped,
an attachment becomes a placeholder ``<image 0>`` and a row of the attachment list with its reference and the number of
tokens that it expands to. The template marks turns as ``<turn role>`` ... ``</turn>`` with a line break after each mark.
Inside texts and roles every backslash becomes two, and ``<`` and ``#`` at the start of a control string (``<turn``,
``</turn``, ``###``, ``<image``, ``<audio``, ``<document``, ``<conversation``) gets a backslash before it, so no text can close a turn
or forge a placeholder, and the text comes back exactly.

Loss spans are the assistant's texts as they stand in the output, escaped. Null texts are empty; a null part is none, and null parts are an empty turn; a null role is "";
turns are sorted by turn (null first), then role and text, so ties and repeated rows have one order. An empty table gives
no rows. A turn is formatted where it is read. A conversation's turns are then sorted by Spark and read in order in bounded
batches: nothing holds a whole conversation, but its digest is a chain, so one task reads it through."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Fixed control strings of the template.
CONTROL = ("<turn", "</turn", "###", "<image", "<audio", "<document", "<conversation")
#: Tokens that an attachment takes once it is expanded, where its part doesn't say.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())])
ATTACHMENTS = "array<struct<kind:string,number:int,ref:string,n_tokens:long>>"

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"(?s)<turn ((?:[^\\>]|\\.)*)>\n(.*?)\n</turn>\n")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn in order."""

    def __init__(self):
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.loss: list[tuple[int, int]] = []
        self.numbers: dict[str, int] = {}
        self.size = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type'] or 'text'}", self.visit_attachment)(part)

    def _put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def visit_text(self, part: dict) -> None:
        piece = escape(part["text"] or "")
        if piece:
            self.loss.append((self.size, self.size + len(piece)))
        self._put(piece)

    def visit_attachment(self, part: dict) -> None:
        kind = part["type"] if part["type"] in EXPANDED else "document"
        number = self.numbers[kind] = self.numbers.get(kind, -1) + 1
        tokens = part["n_tokens"] if part["n_tokens"] is not None else EXPANDED[kind]
        self.attachments.append({"kind": kind, "number": number, "ref": part["ref"], "n_tokens": tokens})
        self._put(f"<{kind} {number}>")


def _role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def _format(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            visitor = Flatten()
            for part in row["parts"] or ():
                visitor.visit(part)
            head = f"<turn {_role(row['role'])}>\n"
            loss = [(len(head) + a, len(head) + b) for a, b in visitor.loss] if row["role"] == "assistant" else []
            out.append((row["conv_id"], row["turn"], row["role"], f"{head}{''.join(visitor.pieces)}\n</turn>\n", [{"first": a, "last": b} for a, b in loss], visitor.attachments))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, _FORMATTED)], schema=_FORMATTED)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss", _SPANS), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("n_tokens", pa.int64())])))])
_FORMATTED_SQL = f"conv_id long, turn long, role string, formatted string, loss array<struct<first:long,last:long>>, attachments {ATTACHMENTS}"


def text_parts(conversations: DataFrame) -> DataFrame:
    """Plain texts as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, parts) to formatted turns: conv_id, turn, role, formatted, loss, attachments."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("parts").cast(T.ArrayType(PART)).alias("parts"))
    return rows.mapInArrow(_format, _FORMATTED_SQL)


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role and the text of one formatted turn; placeholders stay as they are."""
    found = _MARK.fullmatch(formatted)
    if not found:
        raise ValueError("not a turn of this template")
    # from left to right, so that an escaped backslash before an n stays one
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], found[1]), unescape(found[2])


class _Chain:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.turns, self.loss = conv_id, 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        role, text = parse_turn(formatted)
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.chars += len(formatted)
        for span in loss:
            learned = unescape(formatted[span["first"] : span["last"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _chain(batches) -> Iterator[pa.RecordBatch]:
    chain, done = None, []
    for batch in batches:
        for conv_id, formatted, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if chain is None or chain.conv_id != conv_id:
                if chain:
                    done.append(chain.row())
                chain = _Chain(conv_id)
            chain.add(formatted, loss)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGEST)], schema=_DIGEST)
            done = []
    if chain:
        done.append(chain.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGEST)], schema=_DIGEST)


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, parsed back from the formatted turns."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(_chain, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
