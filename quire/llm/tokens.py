"""Whole-text tokenisation inside Spark tasks, with a bounded memory of word encodings."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
CACHED_WORDS = 150_000


_LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Encodes texts word by word.

    The tokenizer's pre-tokenizer never joins characters across white space and its
    normalizer acts within words, so a text's ids are those of its runs of non-space
    characters in turn.  A plain word is one pre-token of Latin letters and one of ASCII
    marks; its letters go to the model in lower case at once, all else takes the whole
    tokenizer.  Encodings are remembered; when ``cached`` are known, the memory starts anew.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        #: word -> its number; of each number the two units that make it up.
        self.known: dict[bytes, int] = {}
        self.front = np.zeros(1 << 14, np.int32)
        self.back = np.zeros(1 << 14, np.int32)
        #: letters, marks or an odd word -> its unit; unit 0 is empty.
        self.units: dict[str, int] = {"": 0}
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _add(self, tokenizer, texts: list[str]) -> None:
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.units), int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + total))
        if n + len(ids) > len(self.first):
            self.first = np.resize(self.first, 2 * (n + len(ids)))
            self.size = np.resize(self.size, 2 * (n + len(ids)))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint16, total)
        self.first[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(ids)] = sizes
        self.used += total
        self.units.update(zip(texts, range(n, n + len(ids))))

    def _learn(self, words: list[bytes]) -> None:
        texts = b"\n".join(words).decode().split("\n")
        fronts = [x.rstrip(_MARKS) for x in texts]
        backs = [x[len(f) :] for x, f in zip(texts, fronts)]
        odd = []
        for i, f in enumerate(fronts):
            if f.isalpha() and (f.isascii() or _LATIN.fullmatch(f.lower())):
                fronts[i] = f.lower()
            elif f:
                fronts[i], backs[i] = texts[i], ""
                odd.append(texts[i])
        # An odd word keeps its case: in lower case it could equal a plain word only if it were one.
        apart = set(odd)
        new = set(fronts).difference(self.units, apart)
        self._add(self.letters, list(new))
        self._add(self.tokenizer, list((apart | set(backs)).difference(self.units)))
        n, more = len(self.known), len(words)
        if n + more > len(self.front):
            self.front = np.resize(self.front, 2 * (n + more))
            self.back = np.resize(self.back, 2 * (n + more))
        self.front[n : n + more] = np.fromiter(map(self.units.__getitem__, fronts), np.int32, more)
        self.back[n : n + more] = np.fromiter(map(self.units.__getitem__, backs), np.int32, more)
        self.known.update(zip(words, range(n, n + more)))

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end_id``, and the count of each."""
        if max(len(self.known), len(self.units)) > self.cached:
            self._forget()
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.split() if text else []
            counts[i] = len(own)
            words += own
        new = list(set(words).difference(self.known))
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        units = np.stack([self.front[index], self.back[index]], axis=1).ravel()
        sizes = self.size[units]
        ends = np.cumsum(sizes, dtype=np.int64)
        before = np.concatenate(([0], ends[1::2]))
        upto = np.cumsum(counts)
        per_text = before[upto] - before[upto - counts]
        take = np.repeat(self.first[units] - (ends - sizes), sizes) + np.arange(int(before[-1]))
        return np.insert(self.flat[take].astype(np.uint32), before[upto], np.uint32(end_id)), per_text + 1


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """The texts of a batch as UTF-8 bytes, in slices of bounded size: (from row, to row, texts)."""
    texts = batch.column(column).cast(pa.binary())
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py()
        held.append(value)
        size += len(value or b"")
        if size >= limit:
            yield start, i + 1, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, len(texts), held


def with_columns(docs: DataFrame, schema: str, make: Callable[[], Callable[[list[bytes | None]], list]]) -> DataFrame:
    """The columns of ``docs`` and those of ``schema``, made from slices of texts within each task.

    ``make`` is called once in a task and returns a function from texts to columns.  Columns of
    ``docs`` that have one of the new names are replaced.
    """
    added = StructType.fromDDL(schema)
    kept = docs.drop(*added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            for start, end, texts in text_slices(batch):
                function = function or make()
                own = [batch.column(i).slice(start, end - start) for i in range(batch.num_columns)]
                yield pa.record_batch([*own, *map(pa.array, function(texts))], names=[*batch.schema.names, *added.names])

    return kept.mapInArrow(run, StructType(kept.schema.fields + added.fields))
