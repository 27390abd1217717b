"""Pages that arrive over time: upserts into a stored table and running progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire import PAGE
from quire.operators.rules import apply_rules
from quire.sources import page_store
from quire.sources.pages import read_rules


def latest_per_page(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """Last arrival of every page; folds on the map side."""
    rest = [c for c in arrivals.columns if c not in PAGE]
    last = arrivals.groupBy(*PAGE).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.select(*PAGE, "_l.*").select(*arrivals.columns)


def upsert_pages(
    arrivals: DataFrame, path: str, order: list[str], writer: str | None = None, batch: int | None = None
) -> None:
    """Bring arrivals into the page table at ``path``; see ``read_pages`` for the latest of each page.

    Only the arriving pages are written.  Doing the same batch twice gives the same table.
    """
    page_store.append(latest_per_page(arrivals, order), path, writer, batch)


def read_pages(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The latest arrival of every page by ``order``, whenever it came in."""
    return page_store.read_last(spark, path, order)


def ingest_pages(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: list[str],
    rules_path: str | None = None,
    text_col: str = "text",
) -> StreamingQuery:
    """Run a stream of arriving pages into the page table at ``path`` until it is drained.

    With ``rules_path`` the correction rules are read anew for every batch, so an edited
    dictionary counts from the next batch on.
    """

    def batch(df: DataFrame, number: int) -> None:
        if rules_path is not None:
            df = apply_rules(df, read_rules(df.sparkSession, rules_path), text_col)
        # The query's id lives in its checkpoint, so a batch done again replaces its first try.
        query_id = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert_pages(df, path, order, query_id, number if query_id else None)

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_progress(
    stream: DataFrame, batch_size: int = 20, time_col: str | None = None, idle: timedelta = timedelta(days=7)
) -> DataFrame:
    """Streaming count of the distinct pages done in each batch of a document.

    A batch's state is one bit a page; a row is given only where a count has grown (``update`` mode).
    With ``time_col`` a batch's state goes once no page of it came for ``idle`` of that time, and pages
    that are later than that behind the stream are left out.
    """
    size = max(5, batch_size)
    batch_no = (F.floor((F.col("page_no") - 1) / size).cast("int") + 1).alias("batch_no")
    pages = stream.where("doc_id IS NOT NULL AND page_no IS NOT NULL")
    span = int(idle.total_seconds() * 1000)
    if time_col is None:
        pages = pages.select("doc_id", batch_no, "page_no")
    else:
        pages = pages.select("doc_id", batch_no, "page_no", F.col(time_col).cast("timestamp").alias("at"))
        pages = pages.withWatermark("at", f"{span} milliseconds")

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = int.from_bytes(state.get[0], "little") if state.exists else 0
        seen, last = before, 0
        for frame in frames:
            for page in frame["page_no"].unique():
                seen |= 1 << int((page - 1) % size)
            if time_col is not None:
                last = max(last, int(frame["at"].max().timestamp() * 1000))
        state.update((seen.to_bytes(size // 8 + 1, "little"),))
        if time_col is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + span)
        if seen != before:
            yield pd.DataFrame({"doc_id": [key[0]], "batch_no": [key[1]], "completed": [seen.bit_count()]})

    schema = f"doc_id {dict(stream.dtypes)['doc_id']}, batch_no int, completed long"
    timeout = GroupStateTimeout.NoTimeout if time_col is None else GroupStateTimeout.EventTimeTimeout
    return pages.groupBy("doc_id", "batch_no").applyInPandasWithState(count, schema, "seen binary", "update", timeout)


def drain(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream of updates to its end, handing each batch's new rows and its number to ``sink``."""
    query = (
        frame.writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
