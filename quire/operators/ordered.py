"""Ordered computations that never need a whole key in one task.

A plain ``Window.partitionBy(key)`` sorts everything a key owns in one task, so
one huge document would hold the job up.  ``running`` cuts each key into chunks
that follow the order (page ranges, pixel bands, ordinal ranges), solves each
chunk on its own, and hands one summary row per chunk on to the next chunk.
Only the summaries meet in a per-key window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def span(col: Column | str, width: int) -> Column:
    """Chunk number of a value: ``floor(value / width)``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: Column | None,
    *,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    most: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    ``order`` must be ascending and total within ``keys``; ``chunk`` must not
    decrease along it.  ``sums`` are inclusive running sums; ``previous`` is the
    value on the row just before; ``latest`` the last non-null value before the
    row; ``highest`` the maximum before the row; ``most`` and ``totals`` the maximum and the sum of the whole key.

    Without a ``chunk``, for keys known to be small (``largest``), a key's rows are sorted in one task: rows that
    already lie together by these keys are then dealt out no more, and ``df`` need not be stored.
    """
    sums, previous, latest, highest = sums or {}, previous or {}, latest or {}, highest or {}
    most, totals = most or {}, totals or {}
    if chunk is None:
        within = Window.partitionBy(*keys).orderBy(*order)
        upto = within.rowsBetween(Window.unboundedPreceding, 0)
        ahead = within.rowsBetween(Window.unboundedPreceding, -1)
        every = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added = {n: F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in sums.items()}
        added |= {n: F.lag(e).over(within) for n, e in previous.items()}
        added |= {n: F.last(e, ignorenulls=True).over(ahead) for n, e in latest.items()}
        added |= {n: F.max(e).over(ahead) for n, e in highest.items()}
        added |= {n: F.max(e).over(every) for n, e in most.items()}
        added |= {n: F.sum(e).over(every) for n, e in totals.items()}
        kept = [c for c in df.columns if c not in added]
        return df.dropna(subset=keys).select(*kept, *[e.alias(n) for n, e in added.items()])
    base = df.withColumn(CHUNK, chunk)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])

    tails = [F.sum(e).alias(f"t_{n}") for n, e in [*sums.items(), *totals.items()]]
    tails += [F.max_by(F.struct(e.alias("v")), rank).alias(f"t_{n}") for n, e in previous.items()]
    tails += [
        F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), rank)).alias(f"t_{n}")
        for n, e in latest.items()
    ]
    tails += [F.max(e).alias(f"t_{n}") for n, e in [*highest.items(), *most.items()]]
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"t_{n}").over(before).alias(f"c_{n}") for n in sums]
    carried += [
        F.last(f"t_{n}", ignorenulls=True).over(before).alias(f"c_{n}") for n in [*previous, *latest]
    ]
    carried += [F.max(f"t_{n}").over(before).alias(f"c_{n}") for n in highest]
    carried += [F.max(f"t_{n}").over(Window.partitionBy(*keys)).alias(f"c_{n}") for n in most]
    carried += [F.sum(f"t_{n}").over(Window.partitionBy(*keys)).alias(f"c_{n}") for n in totals]
    offsets = base.groupBy(*keys, CHUNK).agg(*tails).select(*keys, CHUNK, *carried)

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"l_{n}": F.sum(e).over(upto) for n, e in sums.items()}
    local |= {f"l_{n}": F.lag(F.struct(e.alias("v"))).over(inside) for n, e in previous.items()}
    local |= {
        f"l_{n}": F.last(F.when(e.isNotNull(), F.struct(e.alias("v"))), ignorenulls=True).over(ahead)
        for n, e in latest.items()
    }
    local |= {f"l_{n}": F.max(e).over(ahead) for n, e in highest.items()}

    out = base.withColumns(local).join(offsets, [*keys, CHUNK])
    final = {n: F.col(f"l_{n}") + F.coalesce(F.col(f"c_{n}"), F.lit(0)) for n in sums}
    final |= {n: F.coalesce(f"l_{n}", f"c_{n}")["v"] for n in [*previous, *latest]}
    final |= {n: F.greatest(f"l_{n}", f"c_{n}") for n in highest}
    final |= {n: F.col(f"c_{n}") for n in [*most, *totals]}
    kept = [c for c in df.columns if c not in final]
    return out.select(*kept, *[e.alias(n) for n, e in final.items()])


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column | None, name: str, most: dict[str, Column] | None = None
) -> DataFrame:
    """Dense 1-based position in ``order`` within ``keys``; ``most`` as in ``running``."""
    out = running(df, keys, order, chunk, sums={name: F.lit(1)}, most=most)
    return out.withColumn(name, F.col(name).cast("int"))


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return counts.agg(F.max("_k").alias("_k")).first()["_k"] or 0


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key.  ``row_number() = 1`` gets Spark's group limit, which
    drops all but one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
