"""Phrase collocation mining with tries of safe candidates (operator 12).

Texts become vectors of word numbers, and every position holds a state: the number of the frequent
phrase that begins there.  Level by level, a phrase of one word more is a candidate only where the
phrases without its last and without its first word are both frequent (Apriori), and where these two
meet often enough.  The candidates' edges form a double array: a task moves all positions' states
along it at once and adds up the accepting ones with bincount; Spark sums the tasks' counts.

The double array of a level is broadcast: at most ``most`` edges over at most four times as many
states and words.  A level with more is counted by grouping its pairs of states instead, with the
same result.  Words are numbered by joins, never by a broadcast dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from quire.llm.tokens import text_slices
from quire.operators.ordered import numbered
from quire.operators.staging import settle

SHARD_BYTES = 4 << 20
PART = 2 << 20  # safe positions whose candidates are told together
MOST_EDGES = 1 << 19
LONGEST = 5
ROW = 1024  # positions of a stored row
BLOCK = 4096  # candidates whose counts travel together

COLLOCATIONS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

# A byte that UTF-8 never uses stands for the end of a piece.
_END = b"\xff"
_TABLE = bytes(
    ord(chr(b).lower()) if 65 <= b <= 90 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b in (9, 32) else b
    for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    """Words in small ASCII letters; an ``_END`` between pieces."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


def _key_fields(key: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in key.split(",")]


def _local_schema(key: str) -> str:
    return f"shard long, at int, {key}, count long, words binary, places binary"


_ARROW = {"string": pa.string(), "long": pa.int64()}


def _entries(shard: int, key: str, columns: list, counts: np.ndarray) -> pa.RecordBatch:
    """Keys of a shard and how often each occurs in it; a key's number in the shard is ``at``."""
    fields = _key_fields(key)
    n = len(counts)
    own = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.record_batch(
        [
            pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), *own, pa.array(counts, pa.int64()),
            pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
        ],
        names=["shard", "at", *(name for name, _ in fields), "count", "words", "places"],
    )


def _places(shard: int, key: str, words: pa.Array | None, places: pa.Array) -> pa.RecordBatch:
    """A shard's positions as the numbers of their keys."""
    fields = _key_fields(key)
    n = len(places)
    return pa.record_batch(
        [
            pa.array(np.full(n, shard)), pa.nulls(n, pa.int32()), *(pa.nulls(n, _ARROW[kind]) for _, kind in fields),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()) if words is None else words, places,
        ],
        names=["shard", "at", *(name for name, _ in fields), "count", "words", "places"],
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All int32 values of a binary column in a row, and where each row begins and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.int32, (at[-1] - at[0]) // 4, at[0]), (at - at[0]) // 4


def _rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The opposite of ``_flat``."""
    sizes = pa.py_buffer((offsets * 4).astype(np.int64).tobytes())
    data = pa.py_buffer(np.ascontiguousarray(values, np.int32).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, sizes, data]).cast(pa.binary())


def _packed(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """Rows as ``_rows`` has them, each compressed; the shuffle's own compression gains nothing on numbers."""
    pack = ZstdCompressor(level=1).compress
    return pa.array([pack(values[a:b].tobytes()) for a, b in zip(borders[:-1], borders[1:])], pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    unpack = ZstdDecompressor().decompress
    rows = [np.frombuffer(unpack(r), np.int32) for r in column.to_pylist()]
    return np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def _cuts(values: np.ndarray) -> np.ndarray:
    """Borders of rows of about ``ROW`` positions; a row ends with the end of a piece, as the last value is one."""
    ends = np.flatnonzero(values < 0) + 1
    last = np.flatnonzero(np.diff(ends // ROW, append=-1))
    return np.concatenate(([0], ends[last]))


def _shards(docs: DataFrame) -> DataFrame:
    """Texts (``lang, text``) as vectors of word numbers that hold for a shard only; -1 ends a piece."""
    key = "lang string, word string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, end, texts in text_slices(batch, limit=SHARD_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(langs[start:end], texts):
                    if text:
                        by_lang.setdefault(lang, []).append(text)
                of, names, counts, places = [], [], [], []
                for lang, own in by_lang.items():
                    words = split_words(_END.join(own) + _END)
                    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    place = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                    # The end of a piece gets no key.
                    at = number.pop(_END)
                    place = np.where(place == at, -1, np.where(place > at, place - 1, place))
                    counts.append(np.bincount(place[place >= 0], minlength=len(number)))
                    places.append(np.where(place >= 0, place + len(names), -1).astype(np.int32))
                    names += [w.decode() for w in number]
                    of += [lang] * len(number)
                if names:
                    yield _entries(shard, key, [of, names], np.concatenate(counts))
                    values = np.concatenate(places)
                    yield _places(shard, key, None, _packed(values, _cuts(values)))
                    shard += 1

    return docs.mapInArrow(run, _local_schema(key))


def _vectors(rows: DataFrame, schema: str, each: Callable[[], Callable]) -> DataFrame:
    """Apply a function of all words, states and row borders of a batch; made once a task, it is called with None at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = each()
        for batch in batches:
            words, borders = _flat(batch.column(0))
            states, _ = _flat(batch.column(1))
            found = act(words, states, borders)
            yield from () if found is None else [found] if isinstance(found, pa.RecordBatch) else found
        last = act(None, None, None)
        if last is not None:
            yield last

    return rows.select("words", "states").mapInArrow(run, schema)


def _numbered_names(counted: DataFrame, chunk: Column, order: list[Column]) -> DataFrame:
    """Add dense numbers from 0 over the whole table."""
    out = numbered(counted.withColumn("_all", F.lit(0)), ["_all"], order, chunk, "number")
    return settle(out.withColumn("number", F.col("number") - 1).drop("_all"))


def _name(
    local: DataFrame, key: list[str], order: list[Column], chunk: Column, minimum: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Number the keys that occur ``minimum`` times or more over all shards.

    Returns all keys' counts, ``key, f, number`` of the frequent ones, and ``words, states``: each
    position's number, -1 where there is no frequent key.
    """
    entries = local.where("places IS NULL")
    counts = settle(entries.groupBy(*key).agg(F.sum("count").alias("f")))
    names = _numbered_names(counts.where(F.col("f") >= minimum), chunk, order)
    nothing = F.lit(None)
    known = entries.join(names.select(*key, "number"), key).select(
        "shard", F.lit(0).alias("kind"), "at", "number", nothing.cast("binary").alias("words"), nothing.cast("binary").alias("places")
    )
    vectors = local.where("places IS NOT NULL").select(
        "shard", F.lit(1).alias("kind"), nothing.cast("int").alias("at"), nothing.cast("long").alias("number"), "words", "places"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's known keys come first; they are laid out once and looked up by all its rows."""
        current, held, table = None, [], np.zeros(0, np.int32)
        for batch in batches:
            shards = batch.column(0).to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else []
            for begin, end in zip(begins, [*begins[1:], len(shards)]):
                if shards[begin] != current:
                    current, held, table = shards[begin], [], np.zeros(0, np.int32)
                own = batch.slice(begin, end - begin)
                first = int(np.count_nonzero(own.column(1).to_numpy() == 0))
                if first:
                    held.append((own.column(2).slice(0, first).to_numpy(), own.column(3).slice(0, first).to_numpy()))
                if first == own.num_rows:
                    continue
                own = own.slice(first)
                places, borders = _unpacked(own.column(5))
                # The last cell is never a place: -1 stays -1.
                room = int(max([places.max(), *(at.max() for at, _ in held)])) + 2
                if room > len(table):
                    table = np.full(room, -1, np.int32)
                    for at, number in held:
                        table[at] = number
                states = _rows(table[places], borders)
                words = own.column(4) if own.column(4).null_count == 0 else states
                yield pa.record_batch([words, states], names=["words", "states"])

    ordered = known.unionByName(vectors).repartition("shard").sortWithinPartitions("shard", "kind")
    return counts, names, ordered.mapInArrow(run, "words binary, states binary")


class DoubleArray:
    """Edges ``(parent, symbol) -> number`` in three arrays: ``slot = base[parent] + symbol``."""

    def __init__(self, parents: np.ndarray, symbols: np.ndarray, n_parents: int):
        order = np.lexsort((symbols, parents))
        parents, symbols = parents[order].astype(np.int64), symbols[order].astype(np.int64)
        width = int(symbols.max(initial=0)) + 1
        room = 4 * len(parents) + 64
        self.base = np.full(n_parents, -1, np.int64)
        self.owner = np.full(room + width, -1, np.int32)
        self.number = np.full(room + width, -1, np.int32)
        begins = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(begins, append=len(parents))
        draw = np.random.default_rng(0)
        # The more children, the earlier: large groups find the array nearly empty.
        many = np.argsort(-sizes, kind="stable")
        for g in many[: int((sizes > 1).sum())]:
            at = slice(begins[g], begins[g] + sizes[g])
            own = symbols[at]
            while True:
                tries = draw.integers(0, room, 32)
                free = np.flatnonzero((self.owner[tries[:, None] + own] < 0).all(axis=1))
                if len(free):
                    break
            base = tries[free[0]]
            self.base[parents[begins[g]]] = base
            self.owner[base + own] = parents[begins[g]]
            self.number[base + own] = order[at]
        # A single child takes any free slot that is not before its symbol.
        single = begins[sizes == 1]
        own = symbols[single]
        free = np.flatnonzero(self.owner[width:] < 0)[: len(single)] + width
        self.base[parents[single]] = free - own
        self.owner[free] = parents[single]
        self.number[free] = order[single]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The numbers of all edges at once; -1 where there is none."""
        base = self.base[states]
        slot = np.where((base >= 0) & (symbols >= 0), base + symbols, 0)
        slot = np.where(slot < len(self.owner), slot, 0)
        good = (base >= 0) & (symbols >= 0) & (self.owner[slot] == states)
        return np.where(good, self.number[slot], -1)


def _advance(trie: DoubleArray, words: np.ndarray, states: np.ndarray, width: int) -> np.ndarray:
    """States of phrases of ``width`` words from those of one word less."""
    out = np.full(len(states), -1, np.int32)
    at = np.flatnonzero(states >= 0)
    at = at[at + width - 1 < len(words)]
    out[at] = trie.step(states[at], words[at + width - 1])
    return out


def _candidates(rows: DataFrame, before: DataFrame, minimum: int) -> DataFrame:
    """``prefix, suffix, last``: frequent phrases of one word less that overlap in a text often enough.

    Tasks tell each pair of neighbouring states (the safe phrases of their texts) once for some million words;
    ``before`` gives a shorter phrase's last word.
    """

    def each() -> Callable:
        held: list[np.ndarray] = []
        size = 0

        def tell() -> pa.RecordBatch | None:
            nonlocal size
            size = 0
            if not held:
                return None
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([codes, counts.astype(np.int32)], names=["code", "count"])

        def act(words: np.ndarray | None, states: np.ndarray, borders: np.ndarray) -> pa.RecordBatch | None:
            nonlocal size
            if words is None:
                return tell()
            at = np.flatnonzero((states[:-1] >= 0) & (states[1:] >= 0))
            held.append((states[at].astype(np.int64) << 32) | states[at + 1])
            size += len(at)
            return tell() if size >= PART else None

        return act

    told = _vectors(rows, "code long, count int", each).groupBy("code").agg(F.sum("count").alias("told"))
    often = told.filter(F.col("told") >= minimum).select(
        F.shiftright("code", 32).alias("prefix"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("suffix")
    )
    return often.join(before, "suffix").select("prefix", "suffix", "last")


def _counts(rows: DataFrame, trie: DoubleArray, keys: np.ndarray, width: int) -> DataFrame:
    """``prefix, suffix, last, f`` of every candidate: tasks bincount accepting states, and their sums are summed.

    A task's counts travel in blocks of ``BLOCK`` candidates.
    """
    shared = rows.sparkSession.sparkContext.broadcast((trie, keys))

    def each() -> Callable:
        trie, keys = shared.value
        total = np.zeros(-(-len(keys) // BLOCK) * BLOCK, np.int64)

        def act(words: np.ndarray | None, states: np.ndarray, borders: np.ndarray) -> pa.RecordBatch | None:
            if words is None:
                own = [b.astype(np.int32).tobytes() for b in total.reshape(-1, BLOCK)]
                return pa.record_batch([pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary())], names=["block", "counts"])
            found = _advance(trie, words, states, width)
            total[:] += np.bincount(found[found >= 0], minlength=len(total))
            return None

        return act

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        for block, found in sums.items():
            own = shared.value[1][block * BLOCK : (block + 1) * BLOCK]
            yield pa.record_batch([*own.T, found[: len(own)]], names=["prefix", "suffix", "last", "f"])

    parts = _vectors(rows, "block int, counts binary", each).repartition("block")
    return parts.mapInArrow(add_up, "prefix long, suffix long, last long, f long")


def _moved(rows: DataFrame, trie: DoubleArray, width: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def each() -> Callable:
        trie = shared.value

        def act(words: np.ndarray | None, states: np.ndarray, borders: np.ndarray) -> pa.RecordBatch | None:
            if words is None:
                return None
            found = _advance(trie, words, states, width)
            return pa.record_batch([_rows(words, borders), _rows(found, borders)], names=["words", "states"])

        return act

    return _vectors(rows, "words binary, states binary", each)


def _pairs(rows: DataFrame, width: int) -> DataFrame:
    """Pairs of neighbouring states as local keys, for counting by groups."""
    key = "prefix long, suffix long, last long"

    def each() -> Callable:
        shard = TaskContext.get().partitionId() << 32

        def act(words: np.ndarray | None, states: np.ndarray, borders: np.ndarray) -> list[pa.RecordBatch] | None:
            nonlocal shard
            if words is None:
                return None
            at = np.flatnonzero((states[:-1] >= 0) & (states[1:] >= 0))
            codes = (states[at].astype(np.int64) << 32) | states[at + 1]
            distinct, first, inverse, counts = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
            last = words[at[first] + width - 1].astype(np.int64)
            places = np.full(len(states), -1, np.int32)
            places[at] = inverse
            shard += 1
            return [
                _entries(shard, key, [distinct >> 32, distinct & 0xFFFFFFFF, last], counts),
                _places(shard, key, _rows(words, borders), _packed(places, borders)),
            ]

        return act

    return _vectors(rows, _local_schema(key), each)


def _level(
    rows: DataFrame, before: DataFrame, width: int, minimum: int, n_before: int, n_symbols: int, most: int
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of ``width`` words (``number, prefix, suffix, last, f``) and the vectors with their states.

    ``before`` holds the ``n_before`` frequent phrases of one word less; ``n_symbols`` words are frequent.
    """
    order = [F.col("prefix"), F.col("suffix")]
    chunk = F.floor(F.col("prefix") / 4096)
    found = settle(_candidates(rows, before, minimum))
    if found.count() <= most and max(n_before, n_symbols) <= 4 * most:
        keys = np.array([tuple(r) for r in found.orderBy("prefix", "suffix").toPandas().to_numpy()], np.int64).reshape(-1, 3)
        trie = DoubleArray(keys[:, 0], keys[:, 2], n_before)
        names = _numbered_names(_counts(rows, trie, keys, width).where(F.col("f") >= minimum), chunk, order)
        kept = names.select("number", "prefix", "last").toPandas().sort_values("number")
        trie = DoubleArray(kept["prefix"].to_numpy(), kept["last"].to_numpy(), n_before)
        return names, settle(_moved(rows, trie, width), "zstd")
    pairs = settle(_pairs(rows, width), "zstd")
    _, names, states = _name(pairs, ["prefix", "suffix", "last"], order, chunk, minimum)
    return names, settle(states, "zstd")


def frequent_phrases(
    docs: DataFrame, minimum: int = 100, longest: int = LONGEST, most: int = MOST_EDGES
) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals ``lang, n`` and, for each length from 1, the phrases found ``minimum`` times or more:
    ``number, lang, words, f, before, after, prefix, suffix``.

    ``before[k]`` counts the first k + 1 words, ``after[k]`` the last k + 1; ``prefix`` and ``suffix``
    are the numbers of the phrases without the last and the first word (null for single words).
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    local = settle(_shards(texts), "zstd")
    # Frequent words get small numbers, which keeps the double arrays short.
    rank = -F.floor(F.log2("f"))
    spread = F.pmod(F.xxhash64("word"), F.lit(256))
    order = [rank, spread, F.col("lang"), F.col("word")]
    counts, names, states = _name(local, ["lang", "word"], order, F.struct(rank.alias("r"), spread.alias("s")), minimum)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    one = F.array("f")
    none = F.lit(None).cast("long")
    levels = [
        names.select(
            "number", "lang", F.array("word").alias("words"), "f", one.alias("before"), one.alias("after"),
            none.alias("prefix"), none.alias("suffix"),
        )
    ]
    rows = settle(states, "zstd")
    n_symbols = 0
    for width in range(2, longest + 1):
        n_before = names.count()
        if not n_before:
            break
        n_symbols = n_before if width == 2 else n_symbols
        last = F.col("number" if width == 2 else "last").alias("last")
        before = names.select(F.col("number").alias("suffix"), last)
        names, rows = _level(rows, before, width, minimum, n_before, n_symbols, most)
        shorter = levels[-1]
        head = shorter.select(
            F.col("number").alias("prefix"), "lang", F.col("words").alias("_head"), F.col("before").alias("_before")
        )
        tail = shorter.select(
            F.col("number").alias("suffix"), F.element_at("words", -1).alias("_tail"), F.col("after").alias("_after")
        )
        grown = names.join(head, "prefix").join(tail, "suffix").select(
            "number", "lang", F.concat("_head", F.array("_tail")).alias("words"), "f",
            F.concat("_before", F.array("f")).alias("before"), F.concat("_after", F.array("f")).alias("after"),
            "prefix", "suffix",
        )
        levels.append(settle(grown))
    return totals, levels


def mine(
    docs: DataFrame, minimum: int = 100, longest: int = LONGEST, top: int = 2000, most: int = MOST_EDGES
) -> DataFrame:
    """The ``top`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` holds ``lang`` (null: ``und``) and ``text`` (null and empty texts have no words); its other
    columns are ignored and repeated rows all count.  ``a``, ``l``, ``r`` and ``n`` count a phrase, the two
    parts of its weakest cut and the language's words; the score is ``1000 a n / (l r)`` rounded down,
    in whole numbers of 38 digits.  A phrase that a longer one always contains is left out.  Ties in score go by
    ``a``, then by the phrase's bytes.  A language without a phrase of ``minimum`` occurrences has no rows.
    """
    totals, levels = frequent_phrases(docs, minimum, longest, most)
    big = "decimal(38,0)"
    found = None
    for at, level in enumerate(levels[1:], start=1):
        own = level
        if at + 1 < len(levels):
            longer = levels[at + 1]
            most_of = longer.select(F.col("prefix").alias("number"), F.col("f").alias("_f")).unionByName(
                longer.select(F.col("suffix").alias("number"), F.col("f").alias("_f"))
            ).groupBy("number").agg(F.max("_f").alias("_f"))
            # A phrase is counted at least as often as a longer one that holds it, so equal is the only way to be covered,
            # and then every length between them is covered too.
            own = level.join(most_of, "number", "left").where(F.coalesce(F.col("_f") < F.col("f"), F.lit(True)))
        width = at + 1
        own = own.join(totals, "lang")

        def cut(k: int) -> Column:
            left, right = F.col("before")[k - 1], F.col("after")[width - k - 1]
            above = F.lit(1000).cast(big) * F.col("f").cast(big) * F.col("n").cast(big)
            score = F.call_function("div", above, left.cast(big) * right.cast(big))
            return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

        best = F.array_min(F.array(*(cut(k) for k in range(1, width))))
        own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", best.alias("_best"))
        own = own.select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score")
        found = own if found is None else found.unionByName(own)
    if found is None:
        schema = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each language's best are found within 64 shares first, so no task holds all phrases of a language.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    near = found.withColumn("_near", F.row_number().over(share)).where(F.col("_near") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(*COLLOCATIONS)


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same result in DuckDB over ``documents``: every phrase of up to five words is listed and counted.
SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM split, range(1, 6) sizes(m), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
own AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f),
cuts AS (
  SELECT o.lang, o.phrase, o.a, k, x.f AS l, y.f AS r, t.n,
         (1000 * o.a::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM own o, range(1, 5) parts(k), f x, f y, totals t
  WHERE k < o.m AND x.lang = o.lang AND y.lang = o.lang AND t.lang = o.lang
    AND x.phrase = array_to_string(o.ws[1 : k], ' ') AND y.phrase = array_to_string(o.ws[k + 1 : o.m], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT DISTINCT o.lang, array_to_string(o.ws[i : i + j - 1], ' ') AS phrase, o.a
  FROM own o, range(2, 5) lens(j), range(1, 5) starts(i) WHERE i + j - 1 <= o.m AND j < o.m
), kept AS (
  SELECT b.* FROM best b ANTI JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase AND 100 * c.a >= 100 * b.a
), ranked AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank,
         phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM kept
) SELECT * FROM ranked WHERE rank <= 2000
"""
