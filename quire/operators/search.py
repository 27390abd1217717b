"""Search over page items and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.text import strip, strip_page_prefix
from quire.operators.headings import body_lines
from quire.operators.ordered import numbered, span

KINDS = ["body", "heading", "footnote", "table", "unclassified"]


def _match(text: Column, query: str, regex: bool, match_case: bool) -> Column:
    """First matching part of the text, null without one."""
    if regex:
        pattern = ("(?m)(?U)" if match_case else "(?m)(?U)(?i)") + query
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 0))
    at = F.instr(text, query) if match_case else F.instr(F.lower(text), query.lower())
    return F.when(at > 0, F.substring(text, at, F.lit(len(query))))


def search_pages(
    page_items: DataFrame,
    table_rows: DataFrame | None,
    query: str,
    regex: bool = False,
    match_case: bool = False,
    kinds: list[str] | None = None,
    pages: tuple[int, int] | None = None,
) -> DataFrame:
    """Hits: ``kind, kind_rank, seq, matched_text, snippet, line_index``.

    Body paragraphs are searched line by line; headings, notes and unclassified items whole;
    table rows as their cells joined by ``' | '``.  ``pages`` is an inclusive range; it and the
    kinds filter the scan.
    """
    kinds = kinds or KINDS
    if not query.strip():
        raise ValueError("empty query")
    query = query.strip()
    if pages is not None:
        scope = F.col("page_no").between(*pages)
        page_items = page_items.filter(scope)
        table_rows = None if table_rows is None else table_rows.filter(scope)
    parts = []
    if "body" in kinds:
        lines = body_lines(page_items.filter("kind = 'body'"))
        parts.append(
            lines.select(
                *PAGE, F.lit("body").alias("kind"), "seq", _match(F.col("text"), query, regex, match_case).alias("matched_text"),
                strip("text").alias("snippet"), "line_index",
            )
        )
    listed = [k for k in kinds if k in ("heading", "footnote", "unclassified")]
    if listed:
        items = page_items.filter(F.col("kind").isin(listed)).select(*PAGE, "kind", "seq", "text")
        items = numbered(items, [*PAGE, "kind"], [F.col("seq")], span("seq", 4096), "_i")
        clean = strip_page_prefix("text")
        parts.append(
            items.select(
                *PAGE, "kind", "seq", _match(clean, query, regex, match_case).alias("matched_text"),
                strip(clean).alias("snippet"), (F.col("_i") - 1).alias("line_index"),
            )
        )
    if "table" in kinds and table_rows is not None:
        row = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
        parts.append(
            table_rows.select(
                *PAGE, F.lit("table").alias("kind"), F.col("row_index").alias("seq"),
                _match(row, query, regex, match_case).alias("matched_text"),
                F.concat(F.lit("["), "table_name", F.lit("] "), row).alias("snippet"), F.lit(0).alias("line_index"),
            )
        )
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return hits.filter("matched_text IS NOT NULL").withColumn("kind_rank", rank)


def order_hits(hits: DataFrame) -> DataFrame:
    """Hits by page, then by kind, then as they stand."""
    return hits.orderBy("doc_id", "page_no", "kind_rank", "seq", "line_index")


def search_summary(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id", "page_no").alias("pages")
    )
