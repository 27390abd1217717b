"""Token ids in Arrow files of fixed-size-list batches (operator 1).

Texts are laid out in ascending ``doc_id`` over a row of files, one file for each range of
ids.  In a file the documents run on without a gap through sequences of equal length; a
sequence is one value of two fixed-size lists, ``ids`` and ``mask``.  Only the last
sequence of a file is padded, and the mask tells which positions hold an id.  Mapped into memory, sequence ``i`` is found by arithmetic alone
and read without a copy.  The third column names the documents that begin in a sequence.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import WordEncoder, text_slices
from quire.operators.staging import fresh_path, settle

BATCH_SEQUENCES = 256
_BEGINS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
MANIFEST = "file_no int, path string, n_ids long, n_documents long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def file_schema(length: int) -> pa.Schema:
    return pa.schema(
        [("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("begins", _BEGINS)],
        metadata={"length": str(length)},
    )


def _fixed(values: pa.Array, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, length)


class _FileWriter:
    """Collects ids and writes whole batches of sequences."""

    def __init__(self, path: str, length: int):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.sink = self.files.open_output_stream(self.path)
        self.schema, self.length = file_schema(length), length
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.begins: list[tuple[int | None, int]] = []
        self.waiting = self.written = 0
        self.documents = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = self.written + self.waiting + np.cumsum(sizes) - sizes
        self.begins += zip(doc_ids, at.tolist())
        self.held.append(ids)
        self.waiting += len(ids)
        self.documents += len(doc_ids)
        # Only the last batch of a file may be short, so that a sequence's batch follows from its number.
        if batches := self.waiting // (BATCH_SEQUENCES * self.length):
            self._flush(batches * BATCH_SEQUENCES)

    def _flush(self, sequences: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = min(len(ids), sequences * self.length)
        self.held = [ids[cut:]]
        full = np.zeros(sequences * self.length, np.uint16)
        full[:cut] = ids[:cut]
        upto = self.written + cut
        n = next((i for i, (_, at) in enumerate(self.begins) if at >= upto), len(self.begins))
        first, self.begins = self.begins[:n], self.begins[n:]
        where = np.array([at - self.written for _, at in first], np.int64)
        offsets = np.searchsorted(where, np.arange(sequences + 1) * self.length).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array([d for d, _ in first], pa.int64()), pa.array((where % self.length).astype(np.int32))],
            fields=list(_BEGINS.value_type),
        )
        for s in range(0, sequences, BATCH_SEQUENCES):
            e = min(sequences, s + BATCH_SEQUENCES)
            span = slice(s * self.length, e * self.length)
            self.writer.write_batch(
                pa.record_batch(
                    [
                        _fixed(pa.array(full[span]), self.length),
                        _fixed(pa.array(np.arange(span.start, span.stop) < cut), self.length),
                        pa.ListArray.from_arrays(
                            pa.array(offsets[s : e + 1] - offsets[s]), pairs.slice(offsets[s], offsets[e] - offsets[s]), type=_BEGINS
                        ),
                    ],
                    schema=self.schema,
                )
            )
        self.written, self.waiting = upto, self.waiting - cut

    def close(self) -> int:
        if self.waiting:
            self._flush(-(-self.waiting // self.length))
        self.writer.close()
        self.sink.close()
        return self.written


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = 2048, end_id: int = 1
) -> DataFrame:
    """Encode every text and write the files; returns their list (``MANIFEST``), already stored.

    Only ``doc_id`` and ``text`` are read.  A null text counts as empty and gives the end id
    alone; documents without an id come first; repeated ids stand side by side, each with its
    own tokens, in no set order if their texts differ.  An empty table gives no file.

    A task writes under a name of its own and hands it on only when the file is complete, so
    a task that is run again or twice leaves at most a file that no list names.  ``folder``
    is an absolute path or URI that all executors reach; without one the session's shared folder is taken.
    """
    spark = docs.sparkSession
    root = folder or fresh_path(spark, "tokens")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    _make(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId()
        path = f"{root}/part-{no:06d}-{uuid.uuid4().hex}.arrow"
        encoder, out = None, None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, end, texts in text_slices(batch):
                encoder = encoder or WordEncoder(tokenizer)
                out = out or _FileWriter(path, length)
                out.add(ids[start:end], *encoder.encode(texts, end_id))
        if out:
            yield pa.record_batch(
                [pa.array([no], pa.int32()), pa.array([path]), pa.array([out.close()]), pa.array([out.documents])],
                names=["file_no", "path", "n_ids", "n_documents"],
            )

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return settle(ordered.mapInArrow(write, MANIFEST))


def _make(root: str) -> None:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path)


def open_token_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader over the file, mapped into memory where it lies on a mounted disk."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path)
    source = pa.memory_map(inner) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(inner)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i``; the ids are a view of the mapped file."""
    batch = reader.get_batch(i // BATCH_SEQUENCES)
    at, length = i % BATCH_SEQUENCES, reader.schema.field("ids").type.list_size
    span = slice(at * length, (at + 1) * length)
    ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[span]
    return ids, batch.column("mask").flatten().slice(span.start, length).to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the listed files: ``doc_id, start, n_tokens, ids``, read from the files alone.

    ``start`` counts the ids of all documents before, over all files; ``ids`` are unsigned
    32-bit integers, lowest byte first.  Each task reads whole files, a batch at a time.
    """
    totals = manifest.select("file_no", "n_ids").collect()  # a row for each file
    before, running = {}, 0
    for row in sorted(totals, key=lambda r: r.file_no):
        before[row.file_no] = running
        running += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, path in zip(batch.column("file_no").to_pylist(), batch.column("path").to_pylist()):
                for part in _documents(open_token_file(path)):
                    yield _rows(part, before[no])

    files = manifest.select("file_no", "path")
    return files.repartition(max(1, len(totals)), "file_no").mapInArrow(read, DOCUMENTS)


def _documents(reader) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
    """(doc_id, position in the file, ids) of each document, in lists of a batch each."""
    held: list[np.ndarray] = []
    current: tuple[int | None, int] | None = None
    base = 0
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        length = batch.schema.field("ids").type.list_size
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        ids = batch.column("ids").flatten().to_numpy()[: int(mask.sum())]
        begins = batch.column("begins")
        pairs = begins.flatten()
        counts = begins.value_lengths().to_numpy()
        where = np.repeat(np.arange(len(counts)) * length, counts) + pairs.field("at").to_numpy()
        out, last = [], 0
        for doc_id, at in zip(pairs.field("doc_id").to_pylist(), where.tolist()):
            if current:
                out.append((*current, np.concatenate([*held, ids[last:at]])))
            held, last, current = [], at, (doc_id, base + at)
        held.append(ids[last:])
        base += len(ids)
        yield out
    if current:
        yield [(*current, np.concatenate(held))]


def _rows(part: list[tuple[int | None, int, np.ndarray]], before: int) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array([d for d, _, _ in part], pa.int64()),
            pa.array([before + at for _, at, _ in part], pa.int64()),
            pa.array([len(ids) for _, _, ids in part], pa.int64()),
            pa.array([ids.astype("<u4").tobytes() for _, _, ids in part], pa.binary()),
        ],
        names=["doc_id", "start", "n_tokens", "ids"],
    )
