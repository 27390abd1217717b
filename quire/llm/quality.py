"""Quality rules with compression bands (operator 3)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.tokens import with_columns

#: (least bytes, lowest ratio, highest ratio) of raw to compressed size for a text of at least that length.
#: Compression gains with length, and a frame costs a short text some bytes.
TEXT_BANDS = ((0, 0.5, 4.0), (500, 1.1, 4.5), (2000, 1.4, 5.0), (10_000, 1.5, 5.5), (50_000, 1.6, 6.5))
CHUNK_BANDS = ((1000, 1.2, 4.5), (2000, 1.3, 5.0), (4000, 1.4, 5.0))
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"

QUALITY = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, odd_share double, base_failed boolean, kept boolean"
)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more.

    Windows are named exactly by doubling: pairs of names of half the width are numbered.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    names = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    width = 1
    while width < window:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        distinct, names = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    again = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window:] -= again
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def band_of(size: int, bands: tuple) -> tuple[float, float] | None:
    """The limits for a text of ``size`` bytes; none below the first band."""
    limits = None
    for least, low, high in bands:
        if size >= least:
            limits = low, high
    return limits


def _row(text: bytes | None, compressor, chunk: int, text_bands, chunk_bands, most_odd: float) -> tuple:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.translate(None, _BLANKS)]
    # Code points: bytes that do not continue a character.
    points = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero((points & 0xC0) != 0x80)) - (len(text) - len(text.translate(None, _BLANKS)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    ratio = len(text) / len(compressor.compress(text)) if text else 0.0
    limits = band_of(len(text), text_bands)
    good = bool(text) and (limits is None or limits[0] <= ratio <= limits[1])
    odd = seen = 0
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk]
        limits = band_of(len(part), chunk_bands)
        if limits:
            seen += len(part)
            if not limits[0] <= len(part) / len(compressor.compress(part)) <= limits[1]:
                odd += len(part)
    share = odd / seen if seen else 0.0
    kept = not failed and good and share <= most_odd
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, ratio, share, failed, kept


def judge(
    docs: DataFrame, chunk: int = 4096, level: int = 3, text_bands: tuple = TEXT_BANDS,
    chunk_bands: tuple = CHUNK_BANDS, most_odd: float = 0.25,
) -> DataFrame:
    """The columns of ``docs`` with counts and verdict (``QUALITY``).

    A text is kept if it passes the base rules, its zstandard ratio lies in the band of its
    length, and at most ``most_odd`` of its bytes lie in chunks outside the band of theirs.
    Only ``text`` is read; columns of ``docs`` with the new names are replaced.  A null text counts as empty: no words,
    ratio 0, not kept.  Rows are judged one by one, so repeated rows give equal rows again; an empty
    table gives none.  There is no shuffle; a task holds one batch of texts.
    """

    def make():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)
        return lambda texts: [
            list(c) for c in zip(*(_row(t, compressor, chunk, text_bands, chunk_bands, most_odd) for t in texts))
        ]

    return with_columns(docs, QUALITY, make)
