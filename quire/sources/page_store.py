"""A stored page table that grows by appended versions.

A write adds one folder with the pages it brings and touches nothing else::

    <path>/gen=0/writer=<who>/batch=<n>/part-*.parquet

A reader takes the newest version of each page.  A writer that repeats a batch replaces its own folder
only, so replays change nothing.  ``compact`` writes the newest versions into a new generation, which
counts once it is complete; later writes go there.  Run it between batches of the writers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import PAGE
from quire.operators.staging import stored_table

_BASE = "writer=base/batch=0"


def _folder(spark: SparkSession, path: str):
    """The folder and its file system, whichever one Spark would use."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    own, files = _folder(spark, path)
    if not files.exists(own):
        return []
    names = [s.getPath().getName() for s in files.listStatus(own)]
    return [n[len(prefix) :] for n in names if n.startswith(prefix)]


def generation(spark: SparkSession, path: str) -> int:
    """The newest complete generation; 0 where nothing was compacted."""
    for number in sorted(map(int, _children(spark, path, "gen=")), reverse=True):
        done, files = _folder(spark, f"{path}/gen={number}/{_BASE}/_SUCCESS")
        if number == 0 or files.exists(done):
            return number
    return 0


def append(rows: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Add a version of the pages in ``rows``.

    Without ``batch`` the version follows all there are; with ``writer`` and ``batch`` a repeat takes the
    place of the first try.
    """
    spark = rows.sparkSession
    root = f"{path}/gen={generation(spark, path)}"
    if batch is None:
        writers = _children(spark, root, "writer=")
        batch = 1 + max((int(b) for w in writers for b in _children(spark, f"{root}/writer={w}", "batch=")), default=0)
    rows.write.mode("overwrite").parquet(f"{root}/writer={writer or uuid.uuid4().hex}/batch={batch}")


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored rows with ``writer`` and ``batch``; None if nothing is stored."""
    return stored_table(spark, f"{path}/gen={generation(spark, path)}")


def _version() -> Column:
    return F.struct(F.col("batch").cast("long"), F.col("writer").cast("string"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each page's newest version."""
    rows = _stored(spark, path).withColumn("_version", _version())
    newest = rows.groupBy(*PAGE).agg(F.max("_version").alias("_version"))
    return rows.join(newest, [*PAGE, "_version"], "left_semi").drop("_version", "writer", "batch")


def read_last(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """One row for each page: the last by the columns ``order``, then by version."""
    rows = _stored(spark, path)
    rest = [c for c in rows.columns if c not in (*PAGE, "writer", "batch")]
    last = F.max_by(F.struct(*rest), F.struct(*order, _version().alias("_version")))
    return rows.groupBy(*PAGE).agg(last.alias("_l")).select(*PAGE, "_l.*")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    rows = versions(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no pages are stored at {path}")
    return rows


def compact(spark: SparkSession, path: str, order: list[str] | None = None) -> None:
    """Write the newest version of each page (by ``order``, if given) into a new generation."""
    newest = read_latest(spark, path) if order is None else read_last(spark, path, order)
    newest.write.mode("overwrite").parquet(f"{path}/gen={generation(spark, path) + 1}/{_BASE}")


def drop_old(spark: SparkSession, path: str) -> None:
    """Delete the generations before the newest complete one; nothing may be reading them."""
    last = generation(spark, path)
    for number in _children(spark, path, "gen="):
        if int(number) < last:
            own, files = _folder(spark, f"{path}/gen={number}")
            files.delete(own, True)
