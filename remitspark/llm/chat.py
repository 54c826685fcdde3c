r"""Chat formatting from event logs: logs are partitioned by conversation, sorted by sequence and folded into final messages, then rendered.

Events: ``start`` opens a message (or begins it anew) with a role and its first text, ``delta`` adds text to it, ``edit`` puts another text
in the place of all before it, ``regenerate`` does so too and abandons every message of a later turn. Events on messages that are not open
(never begun, or abandoned) change no message.

A rendered turn is ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash stands before each ``\`` and ``#``, between
``<`` and ``/``, and in roles before ``:``; taking one backslash before any character away restores them, and neither ``#`` runs nor
``</turn>`` of a text can be taken for a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import on_path, shuffle_width, stored

ORDER = ["conv_id", "seq", "message", "step"]
#: Code points of a piece: a longer conversation is handed on in several, cut between turns.
PIECE = 1 << 20
#: Bytes of text of a partition of the log.
PARTITION = 64 << 20
LEARN = ("assistant",)
_OPEN, _COLON, _CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_FOLDED = "conv_id long, part int, whole boolean, message string, turn long, begun boolean, reset boolean, at long, role string, text string, cut long"
_PIECES = "conv_id long, part int, alone boolean, local long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escaped(text: str, role: bool = False) -> str:
    text = re.sub(r"[\\#:]" if role else r"[\\#]", r"\\\g<0>", text)
    return text.replace("</", "<\\/")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def rendered(role: str, text: str, learn: tuple[str, ...] = LEARN) -> tuple[str, tuple[int, int] | None]:
    """A turn, and the code points of it that are learned: the text alone, if its role is."""
    head, body = _OPEN + escaped(role, role=True) + _COLON, escaped(text)
    return head + body + _CLOSE, (len(head), len(head) + len(body)) if role in learn else None


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a rendered conversation or piece."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return out


class _Fold:
    """The open messages of one conversation, as far as a stretch of its log tells."""

    def __init__(self) -> None:
        self.open: dict[str | None, list] = {}  # message: turn, begun, reset, at, role, texts
        self.cut: int | None = None

    def take(self, seq: int, message: str | None, turn: int, kind: str, role: str, text: str) -> None:
        if kind not in ("start", "delta", "edit", "regenerate"):
            raise ValueError(f"unknown kind of event: {kind}")
        known = self.open.get(message)
        if kind == "start":
            self.open[message] = [turn, True, True, seq, role, [text]]
        elif known is None:
            if self.cut is None or turn <= self.cut:  # begun in an earlier stretch; else abandoned
                self.open[message] = [turn, False, kind != "delta", None, None, [text]]
        elif kind == "delta":
            known[5].append(text)
        else:
            known[2], known[5] = True, [text]
        if kind == "regenerate":
            self.cut = turn if self.cut is None else min(self.cut, turn)
            self.open = {m: x for m, x in self.open.items() if x[0] <= turn}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Sorted rows, by their first column; of a row the other columns are handed on."""
    rows = (r for b in batches for s in range(0, b.num_rows, 1000) for r in zip(*(c.to_pylist() for c in b.slice(s, 1000).columns)))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in group)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most a thousand, or of about a piece's text (column ``weight``)."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[weight] or "")
        if len(held) == 1000 or size >= PIECE:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _partitions(df: DataFrame) -> int:
    """As many partitions as the texts fill, so that a task's share does not grow with the table."""
    size = df.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return max(shuffle_width(df.sparkSession), size // PARTITION + 1)


def fold_log(log: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """The final messages of every conversation: conv_id, turn, at (seq of its start), message, role, text.

    ``log``: conv_id, seq, message (an id within the conversation), step (orders events of one message and seq), turn (the message's
    place), kind, role, text. Events are range-partitioned and sorted by conversation and sequence, so a conversation of a third of all
    events is many partitions. Each partition folds its stretch of a conversation; only its first and last conversation can go on
    elsewhere, and their stretches are then put together in order: what a later stretch abandons is dropped, what it continues is
    joined on. A message has at most one row for each partition there. The order of rows with equal (conv_id, seq, message,
    step) is undefined. Null roles and texts are empty, a null turn comes before all others, null ids are ids like others, an
    unknown kind is an error. An empty log gives no rows; other columns are ignored.
    """
    on_path(log.sparkSession)
    least = F.lit(-(1 << 63))
    plain = log.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("message").cast("string"), F.col("step").cast("long"), F.coalesce(F.col("turn").cast("long"), least).alias("turn"), "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    ranged = plain.repartitionByRange(partitions or _partitions(plain), *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id())
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _FOLDED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded() -> Iterator[tuple]:
            waiting = None  # a conversation is handed on when the next one shows that it was not the last
            for n, (conv, rows) in enumerate(_grouped(batches)):
                if waiting:
                    yield from out(*waiting)
                state, part = _Fold(), 0
                for seq, message, _, turn, kind, role, text, part in rows:
                    state.take(seq, message, turn, kind, role, text)
                waiting = (conv, part, n > 0, state)
            if waiting:
                yield from out(waiting[0], waiting[1], False, waiting[3])

        def out(conv: int | None, part: int, whole: bool, state: _Fold) -> Iterator[tuple]:
            for m, (turn, begun, reset, at, role, texts) in state.open.items():
                if begun or not whole:
                    yield conv, part, whole, m, turn, begun, reset, at, role, "".join(texts), None
            if not whole:
                yield conv, part, None, None, None, None, None, None, None, None, state.cut

        yield from _batches(folded(), schema, 9)

    found = stored(ranged.mapInArrow(run, _FOLDED))
    columns = ["conv_id", "turn", "at", "message", "role", "text"]
    # one row for each partition and conversation that may go on elsewhere: at most two a partition
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = found.filter("whole IS NULL").select(F.col("conv_id").alias("of"), F.col("part").alias("in"), F.min("cut").over(later).alias("cut_after"))
    items = found.filter("NOT whole").join(F.broadcast(cuts), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    items = items.filter("cut_after IS NULL OR turn <= cut_after").groupBy("conv_id", "message")
    items = items.agg(F.sort_array(F.collect_list(F.struct("part", "begun", "reset", "turn", "at", "role", "text"))).alias("x"))
    items = items.withColumn("b", F.expr("array_max(transform(x, (y, i) -> if(y.begun, i, -1)))")).filter("b >= 0")
    items = items.withColumn("r", F.expr("array_max(transform(x, (y, i) -> if(y.reset AND i >= b, i, -1)))"))
    merged = items.selectExpr("conv_id", "x[b].turn AS turn", "x[b].at AS at", "message", "x[b].role AS role", "array_join(transform(slice(x, r + 1, size(x)), y -> y.text), '') AS text")
    return found.filter("whole").select(*columns).unionByName(merged)


def format_chats(messages: DataFrame, *, learn: tuple[str, ...] = LEARN, piece: int = PIECE, partitions: int | None = None) -> DataFrame:
    """Render the messages: conv_id, piece (from 0), n_turns, formatted, loss (spans of code points of ``formatted``), alone.

    A conversation is the texts of its pieces one after the other, turns in the order of (turn, at, message). One of up to ``piece``
    code points is one piece, unless it stands at the border of two partitions; ``alone`` marks those that are known to be the
    conversation's only piece. Messages are range-partitioned by that order, so a conversation of a third of all messages is
    rendered by many tasks, each holding one piece at a time. No messages, no rows.
    """
    on_path(messages.sparkSession)
    order = ["conv_id", "turn", "at", "message"]
    n = partitions or _partitions(messages)
    ranged = messages.select(*order, "role", "text").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("alone", pa.bool_()), ("local", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            waiting = None
            for n, (conv, rows) in enumerate(_grouped(batches)):
                if waiting:
                    yield (waiting[0], waiting[1], waiting[2] and waiting[3] == 0, *waiting[3:])
                texts, loss, at, local, part = [], [], 0, 0, 0
                for _, _, _, role, text, part in rows:
                    turn, span = rendered(role, text, learn)
                    if texts and at + len(turn) > piece:
                        yield conv, part, False, local, len(texts), "".join(texts), loss
                        texts, loss, at, local = [], [], 0, local + 1
                    if span:
                        loss.append({"start": at + span[0], "end": at + span[1]})
                    texts.append(turn)
                    at += len(turn)
                waiting = (conv, part, n > 0, local, len(texts), "".join(texts), loss)
            if waiting:
                yield (waiting[0], waiting[1], False, *waiting[3:])

        yield from _batches(pieces(), schema, 5)

    found = stored(ranged.mapInArrow(run, _PIECES))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.filter("NOT alone").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col("conv_id").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # conversations of one partition and several pieces are in it too, so its size is not bounded: no hint here
    numbered = found.filter("NOT alone").join(offsets, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    columns = ["n_turns", "formatted", "loss", "alone"]
    some = numbered.select("conv_id", (F.col("local") + F.col("before")).alias("piece"), *columns)
    return found.filter("alone").select("conv_id", F.col("local").alias("piece"), *columns).unionByName(some)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse :func:`format_chats` back: conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars and
    loss_sha256 (of all text under the loss mask, unescaped), formatted_chars.

    Pieces that are alone are read where they are. A conversation of several pieces is hashed in order, which SHA-256 allows
    in one stream only: such pieces are brought together by conversation and read one by one, none is held longer.
    """
    on_path(formatted.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for conv, rows in _grouped(batches):
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for text, spans in rows:
                    for role, said in parsed(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        learned = unescaped(text[s["start"] : s["end"]])
                        loss.update(learned.encode())
                        chars += len(learned)
                    size += len(text)
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from _batches(read(), schema, 2)

    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    alone = formatted.filter("alone").select("conv_id", "formatted", "loss")
    several = formatted.filter("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss")
    return alone.mapInArrow(run, names).unionByName(several.mapInArrow(run, names))


def as_log(turns: DataFrame, *, delta: int = 1000) -> DataFrame:
    """The log of a table with one row per turn (conv_id, turn, role, text), as if each text had been streamed in deltas of ``delta`` code points.

    Every row is a message, repeated rows too; rows of one turn come in the order of a hash of role and text.
    """
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    unique = F.format_string("%016x-%d", F.xxhash64("role", "text"), F.monotonically_increasing_id())
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % delta), F.lit(0))
    events = plain.withColumn("message", unique).select("conv_id", "turn", "role", "message", F.posexplode_outer(pieces).alias("step", "text"))
    events = events.withColumn("step", F.coalesce("step", F.lit(0)))  # an empty text is a start alone
    kind = F.when(F.col("step") == 0, "start").otherwise("delta")
    return events.select("conv_id", F.col("turn").alias("seq"), "message", "step", "turn", kind.alias("kind"), "role", "text")
