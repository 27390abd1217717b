"""Mixing sources to target weights by soft membership (operator 9).

A classifier fitted on a labelled table gives every document a posterior for each domain.
Document rates then solve a nonnegative least-squares problem: the expected tokens of each domain, summed over
all documents with their rates, are to match its target.  The solver is projected gradient;
a step needs one sum for each domain over all documents, and a document's next rate follows
from its own row.  Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.columns import let, with_fields
from quire.operators.staging import settle

_BLANK = r"[\x20\x09-\x0D]+"


@dataclass
class DomainModel:
    """Log-likelihood ratios of word buckets against the first domain; sizes do not depend on the input."""

    domains: list[str]
    priors: list[float]
    tables: list[list[float]] = field(repr=False)
    buckets: int = 1 << 13
    evidence: float = 100.0


@dataclass
class Mix:
    """Gradients of all steps; a document's rate is a function of its own tokens and posteriors."""

    model: DomainModel
    start: float
    steps: list[list[float]]
    targets: list[float]
    reached: list[float]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BLANK), lambda w: w != "")


def _buckets(words: Column, buckets: int) -> Column:
    """Distinct buckets of the words; a word that is said again counts once."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def fit_domains(
    docs: DataFrame, labelled: DataFrame, domains: list[str], most_docs: int = 6000, buckets: int = 1 << 13,
    smoothing: float = 0.5, evidence: float = 100.0,
) -> DomainModel:
    """Naive Bayes over word buckets from ``labelled(doc_id, domain)``.

    About ``most_docs`` labelled ids, chosen by a hash, bound the fit.  Rows without id or domain, or of another domain, are left
    out; an id labelled twice counts with the domain that sorts first.  Domains without a labelled text share the overall
    distribution.  ``evidence`` bounds how many words' worth of certainty a long text can have.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, most_docs / max(1, known.count()))
    if share < 1.0:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(known), "doc_id")  # about most_docs ids
    each = texts.select("domain", F.explode(_buckets(_words(F.col("_text")), buckets)).alias("bucket"))
    counts = {(r["domain"], r["bucket"]): r["count"] for r in each.groupBy("domain", "bucket").count().collect()}
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    overall = np.array([sum(counts.get((d, b), 0) for d in domains) for b in range(buckets)], float) + smoothing
    logs = []
    for d in domains:
        own = np.array([counts.get((d, b), 0) for b in range(buckets)], float)
        # Smoothed towards the overall distribution.
        own += smoothing * buckets * overall / overall.sum()
        logs.append(np.log(own / own.sum()))
    total = sum(sizes.values()) + len(domains)
    priors = [math.log((sizes.get(d, 0) + 1) / total) for d in domains]
    return DomainModel(domains, priors, [(x - logs[0]).tolist() for x in logs[1:]], buckets, evidence)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Add ``n_tokens`` (words) and ``posteriors`` (one for each domain); columns of these names are replaced."""
    tables = [F.split(F.lit(",".join(f"{x:.5f}" for x in t)), ",").cast("array<double>") for t in model.tables]

    def scores(found: Column) -> Column:
        weight = F.lit(model.evidence) / (F.lit(model.evidence) + F.size(found))
        sums = [F.aggregate(found, F.lit(0.0), _lookup(t)) for t in tables]
        return F.array(F.lit(model.priors[0]), *(F.lit(p) + weight * x for p, x in zip(model.priors[1:], sums)))

    def normal(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda norm: F.transform(powers, lambda x: x / norm))

    def posteriors(words: Column) -> Column:
        powers = let(
            let(_buckets(words, model.buckets), scores),
            lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
        )
        return let(powers, normal)

    both = let(
        _words(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), posteriors(w).alias("posteriors")),
    )
    own = [c for c in docs.columns if c not in ("n_tokens", "posteriors")]
    return with_fields(docs, own, both, ["n_tokens", "posteriors"])


def _lookup(table: Column) -> Callable[[Column, Column], Column]:
    return lambda acc, bucket: acc + F.get(table, bucket)


def _mass(i: int) -> Column:
    return F.col("posteriors")[i] * F.col("n_tokens")


def rate(mix: Mix) -> Column:
    """A document's rate from its ``n_tokens`` and ``posteriors``: all steps in turn."""
    if not mix.steps:
        return F.lit(mix.start)
    steps = F.from_json(F.lit(json.dumps(mix.steps)), "array<array<double>>")  # a constant, folded once
    move = lambda g: sum((_mass(i) * F.get(g, i) for i in range(1, len(mix.targets))), _mass(0) * F.get(g, 0))
    return F.aggregate(steps, F.lit(mix.start), lambda r, g: F.greatest(F.lit(0.0), r - move(g)))


def fit_rates(
    docs: DataFrame, model: DomainModel, weights: dict[str, float], total: float | None = None,
    most_steps: int = 24, tolerance: float = 1e-3,
) -> tuple[Mix, DataFrame]:
    """The mix, and ``doc_id, n_tokens, posteriors`` of all rows, stored.

    ``weights`` are shares of domains in the mix; steps end when every domain is within ``tolerance`` of the total, and a ``RuntimeWarning`` tells if ``most_steps`` ended them
    though another would have helped; a domain not named has 0.  ``total`` is the tokens asked for; by default
    the least at which no domain of positive weight has to be thinned.  Residuals are taken in
    the metric of an inverse Gram matrix of the domains, in which a step of 1 solves the
    unbounded problem at once; the projection keeps rates at 0 or more.  A step is one sum over all rows.
    """
    size = len(model.domains)
    features = settle(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "n_tokens", "posteriors"))
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    mass, gram = _sums(features, F.lit(1.0), size)
    if mass.sum() == 0 or share.sum() == 0:
        return Mix(model, 0.0 if share.sum() == 0 else 1.0, [], [0.0] * size, mass.tolist()), features
    share /= share.sum()
    if total is None:
        total = max(m / s for m, s in zip(mass, share) if s > 0)
    targets = share * total
    whole = _inverse(gram)
    mix = Mix(model, float(total / mass.sum()), [], targets.tolist(), [])
    last = math.inf
    for step in range(most_steps + 1):
        reached, gram = _sums(features, rate(mix), size)
        residual = reached - targets
        error = float(residual @ whole @ residual)
        mix.reached = reached.tolist()
        if step == most_steps or np.abs(residual).max() <= tolerance * total or last <= error <= last * (1 + 1e-9):
            break
        # The metric of the documents with a positive rate gets there sooner; if it overshot, that of all is safe.
        mix.steps.append(((_inverse(gram) if error < last else whole) @ residual).tolist())
        last = error
    off = np.abs(residual).max()
    if step == most_steps and off > tolerance * total:
        # Only an end that another step would better is worth a word; the best of an unbounded wish is no failure.
        more = Mix(model, mix.start, [*mix.steps, (whole @ residual).tolist()], mix.targets, [])
        further = _sums(features, rate(more), size)[0] - targets
        if float(further @ whole @ further) < error:
            warnings.warn(
                f"rates end after {most_steps} steps with a domain {off:.0f} of {total:.0f} tokens off its target; another step would come nearer",
                RuntimeWarning, stacklevel=2,
            )
    return mix, features


def _sums(features: DataFrame, rates: Column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each domain at these rates, and the Gram matrix of the documents with a positive one."""
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    live = features.withColumn("_rate", rates)
    alive = F.col("_rate") > 0
    sums = live.agg(
        *(F.sum(_mass(i) * F.col("_rate")).alias(f"m{i}") for i in range(size)),
        *(F.sum(F.when(alive, _mass(i) * _mass(j))).alias(f"g{i}_{j}") for i, j in cells),
    ).first()
    gram = np.zeros((size, size))
    for i, j in cells:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    return np.array([sums[f"m{i}"] or 0.0 for i in range(size)]), gram


def _inverse(gram: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(gram + np.eye(len(gram)) * 1e-12 * np.trace(gram), hermitian=True)


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """``doc_id, domain, n_tokens, posteriors, rate`` for each row.

    Only ``doc_id`` and ``text`` are read.  ``posteriors`` follow the names of ``weights`` in ascending order and ``domain`` is the
    likeliest, the first of equals.  A null or empty text has no tokens, the prior's posteriors and the starting rate, as
    no residual depends on it.  Repeated rows have equal rates.  An empty table gives none.  Without labels all domains are equally likely.
    """
    model = fit_domains(docs, labelled, sorted(weights))
    mix, features = fit_rates(docs, model, weights, total)
    names = F.array(*map(F.lit, model.domains))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    return features.select("doc_id", F.element_at(names, best).alias("domain"), "n_tokens", "posteriors", rate(mix).alias("rate"))


def repeat_rows(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says.

    A rate's fraction becomes one more copy by a hash of the row.  A row whose likeliest domain
    is wanted stays at least once; the others all go, whatever their rate.
    """
    model = fit_domains(docs, labelled, sorted(weights))
    mix, _ = fit_rates(docs, model, weights)
    wanted = F.array(*(F.lit(weights[d] > 0) for d in model.domains))
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    own = docs.columns
    full = with_posteriors(docs.select(F.struct(*own).alias("_row"), "doc_id", "text"), model).withColumn("_rate", rate(mix))
    copies = F.greatest(F.lit(1), F.floor(F.col("_rate") + chance).cast("int"))
    copies = F.when(F.element_at(wanted, best), copies).otherwise(0)
    return full.withColumn("_copies", copies).where("_copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    ).select("_row.*")
