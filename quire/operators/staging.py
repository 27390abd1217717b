"""Cutting long plans and running small greedy loops over many little groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session within one process, as in tests, may go without: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str = "quire") -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none yet; any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def settle(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a result feeds several branches, so that it is computed once, its size is
    known to the optimizer, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(*branches: Callable[[], Any]) -> list[Any]:
    """Results of functions that do not need one another, in the order given.

    Their stored steps run at the same time, so small ones do not wait for the planning of others.
    """
    with ThreadPoolExecutor(len(branches)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(b)) for b in branches]]


def per_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[list[tuple]], list[tuple]],
    schema: str,
) -> DataFrame:
    """Run ``fn`` on the rows of each group, given as tuples in the column order of ``df``.

    Groups here are small and many, so they are streamed through one Arrow iterator per task
    after a shuffle on ``keys``, instead of one pandas call per group.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.strip().split()[0] for part in schema.split(",")]
        group: list[tuple] = []
        current = None
        for pdf in batches:
            out: list[tuple] = []
            arrays = [pdf[c].tolist() for c in columns]
            for row in zip(*arrays):
                key = [row[i] for i in at]
                if key != current:
                    if group:
                        out += fn(group)
                    group, current = [], key
                group.append(row)
            if out:
                yield _frame(out, names)
        if group:
            last = fn(group)
            if last:
                yield _frame(last, names)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)
