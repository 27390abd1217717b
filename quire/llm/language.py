"""Language ID by segmentation-marginalised unigrams (operator 2).

A language is a probability for each piece of a fixed public vocabulary.  The likelihood
of a text is the sum over all ways to cut its words into pieces, by the forward
algorithm; pieces never cross words, so a text's log-likelihood is the sum of those of its
words, and a word is scored once as long as it is remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import with_columns
from quire.operators.staging import settle

WORD_START = "▁"
MOST_WORD = 40  # characters; longer words take the plain loop
CACHED_WORDS = 150_000
UNKNOWN = 1e-7  # probability of a character that no piece covers
PREDICTIONS = "lang_pred string, score double, mean_log double"


class Vocabulary:
    """Pieces of a sentencepiece model as a trie over character codes, for whole arrays of positions."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.pieces = sorted({p for p in pieces if p and WORD_START not in p[1:]})
        self.longest = max(map(len, self.pieces))
        letters = sorted({c for p in self.pieces for c in p})
        #: Code of each character; 0 is any other.
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        steps: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for number, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                key = (node, int(self.codes[ord(c)]))
                if key not in steps:
                    steps[key] = len(piece_of)
                    piece_of.append(-1)
                node = steps[key]
            piece_of[node] = number
        keys = np.array([n * self.width + c for n, c in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(steps.values()), np.int64)[order]
        self.piece_of = np.array(piece_of, np.int64)
        self.root = np.full(self.width, -1, np.int64)
        for (n, c), t in steps.items():
            if n == 0:
                self.root[c] = t

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        want = nodes * self.width + codes
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (codes > 0), self.targets[at], -1)

    def matches(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Each word's length, and all pieces in the words by start: word, start, length, piece."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = self.codes[text]
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.cumsum(lengths) - lengths
        start = np.arange(len(text)) - np.repeat(first, lengths)
        room = np.repeat(lengths, lengths) - start
        found = []
        nodes, at = self.root[codes], np.arange(len(text))
        for length in range(1, self.longest + 1):
            live = nodes >= 0
            nodes, at = nodes[live], at[live]
            piece = self.piece_of[nodes]
            hit = piece >= 0
            found.append((word[at[hit]], start[at[hit]], np.full(int(hit.sum()), length), piece[hit]))
            more = room[at] > length
            nodes, at = nodes[more], at[more]
            nodes = self.step(nodes, codes[at + length])
        # A character that is no piece of its own can stand alone as unknown.
        single = np.zeros(len(text), bool)
        single_nodes = self.root[codes]
        single[single_nodes >= 0] = self.piece_of[single_nodes[single_nodes >= 0]] >= 0
        lone = ~single
        found.append((word[lone], start[lone], np.ones(int(lone.sum()), np.int64), np.full(int(lone.sum()), len(self.pieces))))
        w, s, n, p = map(np.concatenate, zip(*found))
        order = np.argsort(s, kind="stable")
        return lengths, w[order], s[order], n[order], p[order]


_SCALE = 8.0  # for each character, so that products over a word stay in range


def forward(vocabulary: Vocabulary, model: np.ndarray, words: list[str]) -> tuple[np.ndarray, tuple]:
    """Log-likelihood of each word under each language, and what ``backward`` needs.

    ``model`` holds a probability for each piece and, last, for an unknown character: (pieces + 1, languages).
    """
    lengths, w, s, n, p = vocabulary.matches(words)
    alpha = np.zeros((len(words), int(lengths.max()) + 1, model.shape[1]))
    alpha[:, 0] = 1.0
    scale = _SCALE ** n.astype(float)
    gain = model[p] * scale[:, None]
    cuts = np.searchsorted(s, np.arange(int(lengths.max()) + 1))
    for i in range(len(cuts) - 1):
        lo, hi = cuts[i], cuts[i + 1]
        # Of one start, two pieces of a word never have the same length, but pieces of all lengths come together.
        for length in np.unique(n[lo:hi]):
            own = lo + np.flatnonzero(n[lo:hi] == length)
            alpha[w[own], i + length] += alpha[w[own], i] * gain[own]
    total = alpha[np.arange(len(words)), lengths]
    logs = np.log(np.maximum(total, 1e-300)) - lengths[:, None] * math.log(_SCALE)
    return logs, (lengths, w, s, n, p, gain, alpha, total, cuts)


def expected(vocabulary: Vocabulary, model: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations: (pieces + 1, languages).

    ``weights`` is how often each word occurs in each language.
    """
    _, (lengths, w, s, n, p, gain, alpha, total, cuts) = forward(vocabulary, model, words)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), lengths] = 1.0
    counts = np.zeros_like(model)
    share = weights / np.maximum(total, 1e-300)
    for i in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[i], cuts[i + 1]
        for length in np.unique(n[lo:hi]):
            own = lo + np.flatnonzero(n[lo:hi] == length)
            onward = gain[own] * beta[w[own], i + length]
            np.add.at(counts, p[own], alpha[w[own], i] * onward * share[w[own]])
            beta[w[own], i] += onward
    return counts


def _expected_word(vocabulary: Vocabulary, model: np.ndarray, word: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one long word and their expected counts, by forward and backward sums in logarithms."""
    _, _, s, n, p = vocabulary.matches([word])
    gain = np.log(np.maximum(model[p], 1e-300))
    alpha = np.full((len(word) + 1, model.shape[1]), -np.inf)
    beta = alpha.copy()
    alpha[0] = beta[-1] = 0.0
    ends = (s + n).tolist()
    starts = s.tolist()
    for k in range(len(starts)):
        alpha[ends[k]] = np.logaddexp(alpha[ends[k]], alpha[starts[k]] + gain[k])
    for k in range(len(starts) - 1, -1, -1):
        beta[starts[k]] = np.logaddexp(beta[starts[k]], beta[ends[k]] + gain[k])
    return p, np.exp(alpha[s] + gain + beta[s + n] - alpha[-1]) * weights


def _log_word(vocabulary: Vocabulary, model: np.ndarray, word: str) -> np.ndarray:
    """The same for one long word, in logarithms, a stretch at a time."""
    out = np.zeros(model.shape[1])
    # Forward values are renormalised at every character.
    lengths, _, s, n, p = vocabulary.matches([word])
    ring = np.zeros((vocabulary.longest + 1, model.shape[1]))
    ring[0] = 1.0
    at = 0
    for i in range(len(word)):
        here = ring[0].copy()
        while at < len(s) and s[at] == i:
            ring[n[at]] += here * model[p[at]]
            at += 1
        ring = np.roll(ring, -1, axis=0)
        ring[-1] = 0.0
        top = ring.max(axis=0)
        top[top == 0.0] = 1.0
        ring /= top
        out += np.log(top)
    return out + np.log(np.maximum(ring[0], 1e-300))


class Scorer:
    """Log-likelihoods of words under all languages, remembered up to ``cached`` words."""

    def __init__(self, vocabulary: Vocabulary, model: np.ndarray, cached: int = CACHED_WORDS):
        self.vocabulary, self.model, self.cached = vocabulary, model, cached
        self.known: dict[bytes, int] = {}
        self.logs = np.zeros((1 << 14, model.shape[1]))

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        if n + len(words) > len(self.logs):
            self.logs = np.resize(self.logs, (2 * (n + len(words)), self.model.shape[1]))
        texts = [WORD_START + w.decode().lower() for w in words]
        short = [i for i, t in enumerate(texts) if len(t) <= MOST_WORD]
        short.sort(key=lambda i: len(texts[i]))
        for at in range(0, len(short), 4096):
            own = short[at : at + 4096]
            logs, _ = forward(self.vocabulary, self.model, [texts[i] for i in own])
            self.logs[n + np.array(own)] = logs
        for i, t in enumerate(texts):
            if len(t) > MOST_WORD:
                self.logs[n + i] = _log_word(self.vocabulary, self.model, t)
        self.known.update(zip(words, range(n, n + len(words))))

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and its words."""
        if len(self.known) > self.cached:
            self.known = {}
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
        sums = np.zeros((len(texts), self.model.shape[1]))
        filled = counts > 0
        if filled.any():
            sums[filled] = np.add.reduceat(self.logs[index], (np.cumsum(counts) - counts)[filled])
        return sums, counts


class LanguageModel:
    """What a prediction needs: languages, log priors and piece probabilities (pieces + 1, languages)."""

    def __init__(self, languages: list[str], priors: np.ndarray, pieces: np.ndarray):
        self.languages, self.priors, self.pieces = languages, priors, pieces


def train(
    docs: DataFrame, vocabulary: str, most_docs: int = 6000, rounds: int = 3, smoothing: float = 0.02
) -> LanguageModel:
    """Fit piece probabilities by expectation-maximisation on ``text`` and ``lang``.

    Rows without text or language are left out.  About ``most_docs`` rows, chosen by a hash of
    their text, are used; that bounds the work of the fit.  A round ships the expected counts
    of each task's words, at most one for each piece and language.
    """
    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    total = labelled.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in total)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((1, 0)))
    share = min(1.0, most_docs / sum(r["count"] for r in total))
    if share < 1.0:
        # Rare languages keep all their rows up to an equal part of the bound.
        part = {r["lang"]: min(1.0, max(share, most_docs / len(languages) / 4 / r["count"])) for r in total}
        limits = F.create_map(*[F.lit(x) for k, v in part.items() for x in (k, int(v * (1 << 30)))])
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.try_element_at(limits, "lang"))
    words = (
        labelled.select("lang", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word"))
        .where("word <> ''").groupBy("lang", "word").count()
    )
    words = settle(words)
    priors = np.log(np.array([r["count"] for r in sorted(total, key=lambda r: r["lang"])], float))
    own = Vocabulary(vocabulary)
    model = _start(own, len(languages))
    for _ in range(rounds):
        model = _refit(_counts(words, languages, vocabulary, model), model.shape, smoothing)
    return LanguageModel(languages, priors - np.logaddexp.reduce(priors), model)


def _start(vocabulary: Vocabulary, languages: int) -> np.ndarray:
    """Equal for all languages; longer pieces are rarer."""
    weight = np.array([4.0 ** -len(p) for p in vocabulary.pieces] + [UNKNOWN])
    return np.repeat((weight / weight.sum())[:, None], languages, axis=1)


def _refit(counts: dict[tuple[int, int], float], shape: tuple[int, int], smoothing: float) -> np.ndarray:
    model = np.zeros(shape)
    for (piece, language), count in counts.items():
        model[piece, language] = count
    model += smoothing
    model[-1] = 0.0
    model /= model.sum(axis=0)
    model[-1] = UNKNOWN
    return model


def _counts(words: DataFrame, languages: list[str], path: str, model: np.ndarray) -> dict[tuple[int, int], float]:
    number = {x: i for i, x in enumerate(languages)}
    shared = words.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        sums = np.zeros_like(shared.value)
        for batch in batches:
            texts = [WORD_START + w for w in batch.column("word").to_pylist()]
            langs = [number[x] for x in batch.column("lang").to_pylist()]
            counts = batch.column("count").to_pylist()
            order = sorted((i for i in range(len(texts)) if len(texts[i]) <= MOST_WORD), key=lambda i: len(texts[i]))
            for at in range(0, len(order), 4096):
                part = order[at : at + 4096]
                weights = np.zeros((len(part), len(languages)))
                weights[np.arange(len(part)), [langs[i] for i in part]] = [counts[i] for i in part]
                sums += expected(vocabulary, shared.value, [texts[i] for i in part], weights)
            for i in (i for i in range(len(texts)) if len(texts[i]) > MOST_WORD):
                weights = np.zeros(len(languages))
                weights[langs[i]] = counts[i]
                np.add.at(sums, *_expected_word(vocabulary, shared.value, texts[i], weights))
        piece, language = np.nonzero(sums > 1e-9)
        yield pa.record_batch(
            [pa.array(piece), pa.array(language), pa.array(sums[piece, language])], names=["piece", "language", "count"]
        )

    rows = words.mapInArrow(run, "piece long, language long, count double")
    summed = rows.groupBy("piece", "language").agg(F.sum("count").alias("count")).collect()
    return {(r["piece"], r["language"]): r["count"] for r in summed}


def with_language(docs: DataFrame, model: LanguageModel, vocabulary: str) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``score`` (its posterior) and ``mean_log`` (log-likelihood a word).

    Only ``text`` is read; columns of ``docs`` with these names are replaced.  A text that is null or has no letter gets
    ``und`` with score 0, as does every text if the model has no language.  Equal posteriors
    go to the language that sorts first.  Rows are judged one by one, repeated ones alike, an
    empty table gives none, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the input's size

    def make():
        languages, priors = shared.value.languages, shared.value.priors
        if not languages:
            return lambda texts: [["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)]
        scorer = Scorer(Vocabulary(vocabulary), shared.value.pieces)

        def columns(texts: list[bytes | None]) -> list:
            logs, counts = scorer.texts(texts)
            rows = []
            for text, row, n in zip(texts, logs + priors, counts.tolist()):
                if not text or not any(c.isalpha() for c in text.decode()):
                    rows.append(("und", 0.0, 0.0))
                else:
                    best = int(np.argmax(row))
                    rows.append((languages[best], float(1.0 / np.exp(row - row[best]).sum()), float(row[best] / max(1, n))))
            return [list(c) for c in zip(*rows)]

        return columns

    return with_columns(docs, PREDICTIONS, make)
