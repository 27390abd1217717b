"""Secrets in texts: fixed patterns and character Markov models (operator 7).

Only DataFrame functions: positions of matches come from the lengths of matches and of
the gaps between them, and the models are one array of log-likelihood ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns.  ``access`` and ``hex`` carry their least length; a match is the same
#: as the unlimited one, as a run's first character is its leftmost start.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: What the models judge: runs of characters that keys are written in.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: The stretches of such runs between the characters that also join words and folders.
STRETCH = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8

_LOW, _WIDTH = 32, 96  # printable ASCII; the last code stands for anything else
ALPHABET = 68
KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """``start, kind, end, value`` of all matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(empty)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``assign``, ``access`` and ``hex``: the spans of each pattern that count."""
    value = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE
    return df.withColumns(
        {
            "assign": F.filter(_spans(value, ASSIGN, 0), long_enough),
            "access": _spans(value, ACCESS, 1),
            "hex": _spans(value, HEX, 2),
        }
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` with a blank for every character of ``spans``, so that positions stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        low = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        kept = F.substring(text, acc["at"] + 1, low - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["parts"], F.array(kept, F.repeat(F.lit(" "), end - low))).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, rest)).otherwise(text)


def _codes(value: Column) -> Column:
    """Character codes, -1 at both ends turned into the last code."""
    code = lambda c: F.when(F.ascii(c).between(_LOW, _LOW + _WIDTH - 2), F.ascii(c) - _LOW).otherwise(_WIDTH - 1)
    edge = F.array(F.lit(_WIDTH - 1))
    return F.concat(edge, F.transform(F.split(value, ""), code), edge)


def _pairs(value: Column) -> Column:
    codes = _codes(value)
    return F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _WIDTH + b
    )


def labelled_samples(docs: DataFrame, most_docs: int = 20_000) -> DataFrame:
    """``value, random``: values of the fixed patterns, and the other words as ordinary ones.

    Taken from about ``most_docs`` rows chosen by a hash of id and text, the bound of the fit.
    """
    # The count needs no column of the table.
    share = min(1.0, most_docs / max(1, docs.count()))
    chosen = docs.select(F.col("text").alias("_text"), "doc_id").where(F.col("_text").isNotNull())
    if share < 1.0:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = with_base_spans(chosen, "_text")
    secret = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)),
        F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0)))
    both = F.concat(
        F.transform(secret, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))),
        F.transform(words, lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))),
    )
    return found.select(F.inline(both)).distinct()


def fit(samples: DataFrame, smoothing: float = 0.5, backoff: float = 4.0, evenness: float = 200.0) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary.

    A pair backs off to its second character with the weight of ``backoff`` observations, so few
    samples still tell key characters from those of words.  Single characters start from
    ``smoothing`` observations each; random ones from ``evenness`` more, spread evenly over the key
    characters, as random strings are even by nature.  The result has a fixed number of entries, for
    all pairs of printable characters.
    """
    pairs = samples.where("value is not null and random is not null").select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    codes = range(_WIDTH)
    keys = {ord(c) - _LOW for c in KEY_CHARACTERS}

    def model(random: bool) -> list[float]:
        seen = [[counts.get((random, a * _WIDTH + b), 0) for b in codes] for a in codes]
        even = [evenness / len(keys) if random and b in keys else 0.0 for b in codes]
        single = [sum(row[b] for row in seen) + smoothing + even[b] for b in codes]
        # Most printable characters never occur in a candidate: they share no mass.
        total = sum(single) - smoothing * (_WIDTH - ALPHABET)
        return [
            math.log((row[b] + backoff * single[b] / total) / (sum(row) + backoff)) for row in seen for b in codes
        ]

    return [r - o for r, o in zip(model(True), model(False))]


def find_secrets(docs: DataFrame, model: list[float] | None = None, least: float = 8.0, least_mean: float = 0.3) -> DataFrame:
    """The columns of ``docs`` and ``assign, access, hex, markov, secret_spans``.

    Each is an array of ``start, kind, end, value`` in code points, end exclusive;
    ``secret_spans`` has all, by start and kind.  The spans of fixed patterns are cut out of the runs of key
    characters, and what remains of a run is reported as ``markov`` if it has 16 characters and its log-likelihood
    ratio is at least ``least`` and ``least_mean`` a character; if not, so is each such stretch of it between
    ``/ = _ -``.  Columns of ``docs`` with these
    names are replaced.  A null or empty text has no spans; rows are judged one by one, so
    repeated rows repeat their result, and an empty table gives none.  Nothing is shuffled.
    """
    if model is None:
        model = fit(labelled_samples(docs))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + F.get(table, p))
    own = [c for c in docs.columns if c not in {*KINDS, "secret_spans"}]
    found = with_base_spans(docs.select(*own), "text")
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("_rest", _without(F.coalesce("text", F.lit("")), base))
    found = found.withColumns({"_runs": _spans(F.col("_rest"), CANDIDATE, 3), "_stretches": _spans(F.col("_rest"), STRETCH, 3)}).drop("_rest")
    likely = lambda c: score(c["value"]) >= F.greatest(F.lit(least), least_mean * F.char_length(c["value"]))
    found = found.withColumn("markov", F.filter("_runs", likely))
    within = lambda s, r: (r["start"] <= s["start"]) & (s["end"] <= r["end"])
    whole = lambda s, r: (r["start"] == s["start"]) & (r["end"] == s["end"])
    # A stretch that is a run of its own, or lies in one that is reported, is settled already.
    settled = lambda s: F.exists("markov", lambda r: within(s, r)) | F.exists("_runs", lambda r: whole(s, r))
    found = found.withColumn("_parts", F.filter("_stretches", lambda s: ~settled(s) & likely(s)))
    found = found.withColumn("markov", F.array_sort(F.concat("markov", "_parts"))).drop("_runs", "_stretches", "_parts")
    return found.withColumn("secret_spans", F.array_sort(F.concat(base, F.col("markov"))))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of every span of ``find_secrets`` and set ``n_chars`` to the new length.

    Spans that touch or overlap become one mark.  The columns of spans are dropped; other rows stay as they are.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        inside = (s["start"] <= acc["at"]) & (F.size(acc["parts"]) > 0)
        parts = F.concat(acc["parts"], F.array(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["parts"]).otherwise(parts).alias("parts")
        )

    whole = F.aggregate(
        "secret_spans", start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", acc["at"] + 1, F.char_length("text"))),
    )
    hit = F.size("secret_spans") > 0
    text = F.when(hit, whole).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text")).otherwise(F.col("n_chars")).cast(found.schema["n_chars"].dataType))
    return out.drop(*KINDS, "secret_spans")
