"""Conversations of any layout as formatted text with a loss mask, and back.

1. Each record's nested field paths are hashed; the fingerprint selects a declared layout
   (``layouts``), whose mapping turns the record into canonical turns (conversation, place,
   role, text). This happens where the records are, row by row.
2. Turns are dealt out by ranges of (conversation, place), so that a conversation with a third
   of all rows spans as many tasks as it needs, and stream through the template, which marks
   each turn by its role. What comes out are parts of bounded length, each with the spans of
   its characters that count for the loss: assistant texts. A conversation's parts, in order,
   are its text.
3. Read back, a part gives its turns and the text under the mask.

The template's own marks may stand in a text, too. There a backslash is put behind the first
character of each mark, and before each backslash another one, so that no mark stands in an
escaped text, and unescaping gives the text as it was.

Null texts and roles are empty texts and roles; only the role "assistant" counts for the loss.
Rows without a conversation's id are one conversation, without an id. Turns without a number
come last; turns with the same number stand by role and text, so that repeated rows are
repeated turns. Very long texts are formatted whole, in a part of their own. A record whose
fingerprint no layout has keeps its fingerprint and gives no turn (``unknown`` counts them).
Other columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, parallelism, stored, task_id
from .layouts import LAYOUTS, Layout, Registry, turns_of

TURNS = "conv_id long, place long, sub int, role string, text string, layout string, fingerprint long"
PARTS = "conv_id long, at long, text string, loss array<struct<start:int,end:int>>, edge boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: How the template opens and closes a turn. Roles besides these three stand in the text themselves.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, SAYS, ENDS = "<|role|>", "<|says|>", "<|end|>"
#: All of them, none of which stands in an escaped text.
CONTROLS = (*(m for pair in MARKS.values() for m in pair), ROLE, SAYS, ENDS)
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: Code points of a part, but for a single longer turn.
PART = 1 << 18


def escaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    """What escaped() was given: \\\\ is a backslash, and a backslash behind another character goes."""
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its escaped text starts and ends."""
    opens, closes = MARKS.get(role) or (f"{ROLE}{escaped(role)}{SAYS}", ENDS)
    body = escaped(text)
    return opens + body + closes, len(opens), len(opens) + len(body)


def read_turns(part: str):
    """(role, start, end) of the turns of a formatted part; start and end of their escaped texts."""
    at = 0
    while at < len(part):
        for role, (opens, closes) in MARKS.items():
            if part.startswith(opens, at):
                start = at + len(opens)
                break
        else:
            if not part.startswith(ROLE, at):
                raise ValueError(f"no turn begins at character {at}")
            says = part.index(SAYS, at)
            role, start, closes = unescaped(part[at + len(ROLE) : says]), says + len(SAYS), ENDS
        end = part.index(closes, start)
        yield role, start, end
        at = end + len(closes)


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, json_col: str | None = None) -> DataFrame:
    """The turns of records, whose fields are the table's columns, or JSON texts in ``json_col``.

    A JSON text that can't be read, and a record with a fingerprint that isn't known, gives one
    row without a layout.
    """
    bounded_batches(df.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string()), ("fingerprint", pa.int64())])

    def records(batch):
        if not json_col:
            yield from batch.to_pylist()
            return
        for text in batch.column(0).to_pylist():
            try:
                record = json.loads(text or "null")
            except ValueError:
                record = None
            yield record if isinstance(record, dict) else {}

    def number(value):
        if isinstance(value, str) and re.fullmatch(r"-?\d{1,18}", value):
            value = int(value)
        return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None

    def run(batches):
        registry = Registry(layouts)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                out = []
                for record in records(batch.slice(start, 4096)):
                    print_, layout = registry.find(record)
                    signed = print_ - 2**64 if print_ >= 2**63 else print_
                    if layout is None:
                        out.append((None, None, None, None, None, None, signed))
                        continue
                    place = number(record.get(layout.order)) if layout.row else 0
                    out += [(number(record.get(layout.key)), place, i, role, text, layout.name, signed) for i, (role, text) in enumerate(turns_of(layout, record))]
                columns = zip(*out) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return (df.select(json_col) if json_col else df).mapInArrow(run, TURNS)


def unknown(turns: DataFrame) -> DataFrame:
    """fingerprint, n: records that no layout fits."""
    return turns.where("layout IS NULL").groupBy("fingerprint").agg(F.count("*").alias("n"))


def in_order(turns: DataFrame) -> DataFrame:
    """Turns in ranges, so that no task holds a hot conversation alone; sorted within them."""
    key = [F.col("conv_id").asc_nulls_last(), F.col("place").asc_nulls_last(), "sub", "role", F.col("text")]
    short = F.substring("text", 1, 32)  # what is sampled for the ranges is short; a range ends between rows that differ in it
    own = turns.where("layout IS NOT NULL").select("conv_id", "place", "sub", "role", "text")
    n = parallelism(turns.sparkSession)
    return own.repartitionByRange(n, *key[:-1], short).sortWithinPartitions(*key)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, at, text, loss, edge: formatted parts; by ``at`` they are a conversation's text.

    edge: the conversation has other parts, or may have them in another task.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("edge", pa.bool_())])

    def run(batches):
        place = task_id() << 33
        first, several, current, pieces, spans, size = True, False, None, [], [], 0
        ready, held = [], 0

        def cut(edge: bool):
            nonlocal place, pieces, spans, size, held
            ready.append({"conv_id": current[0], "at": place, "text": "".join(pieces), "loss": spans, "edge": edge})
            held += size
            place, pieces, spans, size = place + 1, [], [], 0

        def batch():
            nonlocal ready, held
            out, ready, held = ready, [], 0
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for b in batches:
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if current is None or current[0] != conv:
                    if current is not None:
                        cut(first or several)  # the first conversation of a task may have begun in another one
                        first = several = False
                    current = (conv,)
                elif size >= PART:
                    cut(True)
                    several = True
                piece, start, end = turn_text(role, text)
                if role == "assistant":
                    spans.append({"start": size + start, "end": size + end})
                pieces.append(piece)
                size += len(piece)
                if held >= PART:
                    yield batch()
        if current is not None:
            cut(True)
        if ready:
            yield batch()

    return in_order(turns).select("conv_id", "role", "text").mapInArrow(run, PARTS)


class Reader:
    """What is read back from a conversation's parts, one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def part(self, text: str, spans: list[dict]) -> None:
        for role, start, end in read_turns(text):
            self.turns += 1
            self.all.update(f"{role}\n{unescaped(text[start:end])}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            own = unescaped(text[span["start"] : span["end"]])
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted parts.

    A digest is one sequence of bytes. Conversations that lie in one task are read there, as
    they come; the parts of the others (two conversations a task at most) are written, dealt
    out by conversation, and streamed, so that a task holds one part at a time.
    """
    names = [f.split()[0] for f in DIGEST.split(", ")]
    plain = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    mixed = pa.schema([*plain, ("at", pa.int64()), ("text", pa.string()), ("loss", spans)])

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in ("conv_id", "at", "text", "loss", "edge")))

    def here(batches):
        done: list[dict] = []
        for conv, at, text, loss, edge in rows(batches):
            if edge:
                done.append({"conv_id": conv, "at": at, "text": text, "loss": loss})
            else:  # whole in this part
                reader = Reader(conv)
                reader.part(text, loss)
                done.append(reader.row())
            if len(done) >= 1024 or len(text) >= PART:
                yield pa.RecordBatch.from_pylist(done, schema=mixed)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=mixed)

    def there(batches):
        reader, done = None, []
        for conv, _, text, loss, _ in rows(batches):
            if reader is None or reader.conv_id != conv:
                if reader is not None:
                    done.append(reader.row())
                reader = Reader(conv)
            reader.part(text, loss)
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema=plain)
                done = []
        if reader is not None:
            done.append(reader.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=plain)

    found = stored(parts.mapInArrow(here, f"{DIGEST}, at long, text string, loss array<struct<start:int,end:int>>"))
    open_ = found.where("text IS NOT NULL").select("conv_id", "at", "text", "loss", F.lit(True).alias("edge"))
    open_ = open_.repartition(parallelism(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return found.where("text IS NULL").select(*names).unionByName(open_.mapInArrow(there, DIGEST))


def format_and_read(turns: DataFrame) -> DataFrame:
    return digests(formatted(turns))
