"""Bounded-space online packing of token ids into sequences (operator 8).

Each partition keeps a fixed number of open windows.  A piece goes to the window it fills
best; when none has room, the fullest is emitted and the piece opens a new one.  What is
open at a partition's end is packed again by fewer tasks, round after round, and the last
task cuts what is left at powers of two, so that it needs no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import WordEncoder, text_slices
from quire.operators.staging import settle

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, open boolean"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()),
    ]
)
_ROWS = 2000

#: (doc_id, start, length, doc_tokens, ids as bytes)
Piece = tuple[int | None, int, int, int, bytes]


class Windows:
    """At most ``most`` open windows of ``size`` ids; full ones come out through ``emit``."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.room: list[tuple[int, int]] = []  # (ids that still fit, window), sorted
        self.held: dict[int, list[Piece]] = {}
        self.opened = 0

    def put(self, piece: Piece) -> list[list[Piece]]:
        """Place a piece of at most ``size`` ids; the windows that are done with it."""
        length, done = piece[2], []
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) == self.most:
                done.append(self.held.pop(self.room.pop(0)[1]))
            room, window = self.size, self.opened
            self.opened += 1
            self.held[window] = []
        self.held[window].append(piece)
        if room == length:
            done.append(self.held.pop(window))
        else:
            bisect.insort(self.room, (room - length, window))
        return done

    def rest(self) -> list[list[Piece]]:
        return [self.held[w] for _, w in self.room]


def cut_at_powers(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """Pieces in a row, cut into sequences of ``size`` and then of falling powers of two."""
    total = sum(p[2] for p in pieces)
    lengths = [size] * (total // size)
    lengths += [1 << b for b in range((total % size).bit_length() - 1, -1, -1) if total % size >> b & 1]
    out: list[list[Piece]] = []
    todo = list(reversed(pieces))
    for length in lengths:
        own: list[Piece] = []
        while length:
            doc, start, n, of, ids = todo.pop()
            take = min(n, length)
            own.append((doc, start, take, of, ids[: 4 * take]))
            if take < n:
                todo.append((doc, start + take, n - take, of, ids[4 * take :]))
            length -= take
        out.append(own)
    return out


class _Out:
    """Rows of finished and of open windows, with sequence numbers of this task alone."""

    def __init__(self, level: int, task: int):
        self.next = (level << 56) | (task << 32)
        self.rows: list[tuple] = []

    def add(self, window: list[Piece], still_open: bool) -> None:
        at = 0
        for doc, start, n, of, ids in window:
            self.rows.append((doc, start, n, of, ids, self.next, at, still_open))
            at += n
        self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_SCHEMA)
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _pack(pieces: Iterator[Piece], size: int, most: int, out: _Out, last: bool) -> Iterator[pa.RecordBatch]:
    windows = Windows(size, most)
    for piece in pieces:
        for window in windows.put(piece):
            out.add(window, False)
        if len(out.rows) >= _ROWS:
            yield out.take()
    if last:
        for window in cut_at_powers([p for w in windows.rest() for p in w], size):
            out.add(window, False)
    else:
        for window in windows.rest():
            out.add(window, True)
    yield out.take()


def pack(
    docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, windows: int = 128, fan_in: int = 16
) -> DataFrame:
    """Pieces of all documents with their place: ``PIECES`` without ``open``.

    Only ``doc_id`` and ``text`` are read.  A null or empty text gives the end id alone.  Every
    row is a document of its own, repeated or without an id as it may be; an empty table gives no
    piece.  ``ids`` are unsigned 32-bit integers, lowest byte first.  Texts are never
    shuffled: each partition packs its own, and only open windows (``windows`` for each task) move.
    A document longer than a window is cut at multiples of ``size``.  Tasks hold ``windows`` sequences,
    the encoder's bounded memory and a slice of texts, whatever the input's size.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Out(0, TaskContext.get().partitionId())
        yield from _pack(_pieces(batches, tokenizer, size, end_id), size, windows, out, False)

    parts = [settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, PIECES), "zstd")]
    level = 0
    while True:
        level += 1
        left = parts[-1].where("open")
        open_windows = left.agg(F.count_distinct("sequence_id")).first()[0]
        if not open_windows:
            break
        tasks = -(-open_windows // (windows * fan_in))
        parts.append(settle(_again(left, level, tasks, size, windows), "zstd"))
    done = parts[0].where("not open")
    for part in parts[1:]:
        done = done.unionByName(part.where("not open"))
    return done.drop("open")


def _again(left: DataFrame, level: int, tasks: int, size: int, windows: int) -> DataFrame:
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Out(level, TaskContext.get().partitionId())
        pieces = (
            tuple(row)
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")))
        )
        yield from _pack(pieces, size, windows, out, tasks == 1)

    # Large pieces first: the order is fixed, so a task that is run again packs alike.
    spread = left.withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)))
    ordered = spread.repartition(tasks, "part").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return ordered.select("doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(again, PIECES)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int) -> Iterator[Piece]:
    encoder = None
    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for start, end, texts in text_slices(batch):
            encoder = encoder or WordEncoder(tokenizer)
            ids, sizes = encoder.encode(texts, end_id)
            at = 0
            for doc, n in zip(doc_ids[start:end], sizes.tolist()):
                for s in range(0, n, size):
                    e = min(n, s + size)
                    yield doc, s, e - s, n, ids[at + s : at + e].astype("<u4").tobytes()
                at += n
