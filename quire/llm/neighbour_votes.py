"""Text quality by nearest-neighbour voting on latent-semantic vectors (operator 11).

A text is a histogram of hashed terms: its words, the shapes of its character runs alone and in
twos and threes, and words that come again at once.  The labelled sample's histograms give the
weights of terms and, by their singular vectors, a latent space of few dimensions.  The labelled
vectors are broadcast; every text is compared with all of them, block by block, and its nearest
ones vote with their similarity.

The sample has at most ``most_docs`` rows of each label, whatever the input, so the model (vectors
and basis) has a fixed largest size.  Everything else covers every row and every byte of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import with_columns
from quire.operators.staging import settle

WORD_BUCKETS = 1024
SHAPE_BUCKETS = 1023
AGAIN = 4  # a word of its own bucket: the same as the word 1, 2 or 3 before it; any word
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + AGAIN
PART_BYTES = 1 << 20
ROWS = 256  # texts compared at a time

VOTES = "score double, nearest double"

_BLANK, _LINE, _SMALL, _LARGE, _DIGIT = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each byte; an ASCII mark is a class of its own, bytes beyond ASCII count as small letters."""
    of = np.full(256, _SMALL, np.int64)
    of[:33] = _BLANK
    of[ord("\n")] = _LINE
    of[ord("A") : ord("Z") + 1] = _LARGE
    of[ord("0") : ord("9") + 1] = _DIGIT
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    of[marks] = np.arange(5, 5 + len(marks))
    return of


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(values: np.ndarray, size: int) -> np.ndarray:
    """Multiplicative hash of whole numbers to ``size`` buckets."""
    mixed = values.astype(np.uint64) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in stretches of bounded size, cut before a blank where there is one."""
    start = 0
    while len(text) - start > PART_BYTES:
        cut = max(text.rfind(b" ", start + 1, start + PART_BYTES), text.rfind(b"\n", start + 1, start + PART_BYTES))
        cut = cut if cut > start else start + PART_BYTES
        yield text[start:cut]
        start = cut
    yield text[start:]


def _terms(joined: bytes, docs: int) -> np.ndarray:
    """Term counts of texts that are joined by zero bytes: ``(docs, TERMS)``."""
    data = np.frombuffer(joined, np.uint8)
    doc_of = np.cumsum(data == 0) - (data == 0)
    counts = np.zeros(docs * TERMS, np.float64)

    def add(doc: np.ndarray, bucket: np.ndarray) -> None:
        nonlocal counts
        counts += np.bincount(doc * TERMS + bucket, minlength=docs * TERMS)

    # Shapes: runs of one class with their length in four steps.
    kind = _CLASS[data]
    kind[data == 0] = 63
    edge = np.flatnonzero(np.diff(kind, prepend=-1))
    size = np.diff(edge, append=len(data))
    run = kind[edge] * 4 + np.searchsorted([2, 4, 16], size, side="right")
    at = doc_of[edge]
    shape = run + 1
    add(at, WORD_BUCKETS + _bucket(shape, SHAPE_BUCKETS))
    for width in (1, 2):
        if len(run) > width:
            shape = shape[:-1] * 257 + run[width:] + 1
            own = at[:-width] == at[width:]
            add(at[:-width][own], WORD_BUCKETS + _bucket(shape[own], SHAPE_BUCKETS))

    # Words: a polynomial of their bytes in small letters, without marks at the end.
    dark = kind > _LINE
    dark &= data != 0
    begin = np.flatnonzero(dark & ~np.concatenate(([False], dark[:-1])))
    if len(begin):
        letters = dark & (kind <= _DIGIT)
        starts = np.zeros(len(data), np.int64)
        starts[begin] = 1
        place = np.maximum(np.arange(len(data)) - begin[np.cumsum(starts) - 1], 0)
        power = _powers(int(place.max()) + 1)
        value = np.where(letters, (_LOWER[data] + np.uint64(1)) * power[place], np.uint64(0))
        word = np.add.reduceat(value, begin)
        at = doc_of[begin]
        add(at, _bucket(word, WORD_BUCKETS))
        add(at, np.full(len(at), TERMS - 1))
        for lag in (1, 2, 3):
            if len(word) > lag:
                again = (word[lag:] == word[:-lag]) & (at[lag:] == at[:-lag])
                add(at[lag:][again], np.full(int(again.sum()), TERMS - 1 - lag))
    return counts.reshape(docs, TERMS)


def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(size - 1, 0), _MIX))), dtype=np.uint64)


def histograms(texts: list[bytes | None]) -> np.ndarray:
    """Term counts of whole texts, ``(texts, TERMS)``; a text without words is a row of zeros."""
    out = np.zeros((len(texts), TERMS))
    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            np.add.at(out, rows, _terms(b"\0".join(held) + b"\0", len(held)))
        held.clear()
        rows.clear()
        size = 0

    for i, text in enumerate(texts):
        text = text.replace(b"\0", b" ") if text else b""
        for part in _parts(text) if text.strip() else ():
            held.append(part)
            rows.append(i)
            size += len(part)
            if size >= PART_BYTES:
                flush()
    flush()
    return out


@dataclass
class Model:
    """What a task needs to score: weights of terms, latent basis, the labelled vectors and their labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: Share of a label in all labelled rows over its share in the sample.
    balance: np.ndarray
    neighbours: int
    prior: float


def latent(counts: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of the latent space; zero where no term is known."""
    found = _weighted(counts, weights) @ basis
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of shares times the weights: a histogram whose length in words does not count."""
    words = np.maximum(counts[:, -1:], 1)
    return np.sqrt(counts / words) * weights


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    most_docs: int = 2000,
    dims: int = 48,
    neighbours: int = 15,
) -> Model:
    """Learn from ``docs`` (``doc_id, text``) and the 0/1 column ``label`` of ``labels`` (``doc_id``).

    The sample holds at most ``most_docs`` rows of each label, those of the smallest hashes of
    ``doc_id``, so a label that is rare is not lost.  An id with two labels teaches both; rows
    without id or label teach nothing.  Without any labelled row every score is 0.5; with one
    label alone every score is that label.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label")).distinct()
    # Ids alone are joined; texts are read for the chosen ids only.
    ids = docs.select("doc_id").join(known, "doc_id").groupBy("doc_id", "_label").agg(F.count(F.lit(1)).alias("_n"))
    ids = settle(ids)
    totals = {r[0]: r[1] for r in ids.groupBy("_label").agg(F.sum("_n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for value in sorted(totals):
        chosen = ids.where(F.col("_label") == value).orderBy(*order).limit(most_docs).select("doc_id", "_label")
        # At most ``most_docs`` ids; a repeated id may still bring many rows, so the rows are bounded too.
        own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        own = own.orderBy(*order, F.xxhash64("text")).limit(most_docs)
        sample = own if sample is None else sample.unionByName(own)
    if sample is None:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0), np.ones(2), neighbours, 0.5)
    counted = with_columns(sample.select("_label", "text"), "terms binary", lambda: _packed).select("_label", "terms")
    found = counted.orderBy("_label", F.xxhash64("terms")).collect()
    counts = np.stack([np.frombuffer(r["terms"], np.float32) for r in found]).astype(float)
    own = np.array([r["_label"] for r in found])
    weights = np.log((1 + len(own)) / (1 + (counts > 0).sum(axis=0))) + 1
    matrix = _weighted(counts, weights)
    # The right singular vectors, from the smaller of the two Gram matrices.
    if len(matrix) < matrix.shape[1]:
        values, left = np.linalg.eigh(matrix @ matrix.T)
        best = np.argsort(-values)[: min(dims, len(values))]
        best = best[values[best] > max(values.max(), 0) * 1e-10]
        basis = matrix.T @ (left[:, best] / np.sqrt(values[best]))
    else:
        values, right = np.linalg.eigh(matrix.T @ matrix)
        basis = right[:, np.argsort(-values)[:dims]]
    all_rows = sum(totals.values())
    balance = np.array([totals.get(v, 0) / all_rows / max(np.mean(own == v), 1e-12) for v in (0, 1)])
    vectors = latent(counts, weights, basis).astype(np.float32)
    return Model(weights, basis, vectors, own.astype(float), balance, neighbours, totals.get(1, 0) / all_rows)


def _packed(texts: list[bytes | None]) -> list:
    return [[row.tobytes() for row in histograms(texts).astype(np.float32)]]


def vote(model: Model, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and largest similarity of each vector.

    The nearest labelled vectors (ties at the last place all count) vote, the stronger the closer
    their cosine is to 1; a label's votes are scaled to its share in all labelled rows.
    """
    score = np.full(len(vectors), model.prior)
    nearest = np.zeros(len(vectors))
    if not len(model.labels):
        return score, nearest
    some = np.flatnonzero(np.any(vectors != 0, axis=1))
    cosines = vectors[some].astype(np.float32) @ model.vectors.T
    k = min(model.neighbours, cosines.shape[1])
    edge = np.partition(cosines, -k, axis=1)[:, -k]
    near = cosines >= edge[:, None]
    distance = np.where(near, np.maximum(1 - cosines, 0), np.inf)
    votes = (distance + 0.02) ** -2 * model.balance[model.labels.astype(int)]
    yes = (votes * model.labels).sum(axis=1)
    score[some] = np.clip(yes / votes.sum(axis=1), 0, 1)
    nearest[some] = cosines.max(axis=1)
    return score, nearest


def with_votes(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs``, and ``score`` (0 to 1) and ``nearest`` (largest cosine).

    A text that is null or blank takes the share of label 1 among all labelled rows and
    a ``nearest`` of 0.  Repeated texts get equal scores.  Columns of those two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def score(texts: list[bytes | None]) -> list:
            found = []
            for at in range(0, len(texts), ROWS):
                counts = histograms(texts[at : at + ROWS])
                found.append(vote(own, latent(counts, own.weights, own.basis)))
            return [np.concatenate(c) for c in zip(*found)]

        return score

    return with_columns(docs, VOTES, make)
