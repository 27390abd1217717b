"""Text blobs that hold all pages of a document, turned into rows per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.headings import (
    CHAPTER_DIGITS,
    NOTE_TAG,
    ROMAN,
    is_major_heading,
    is_noise_heading,
    is_subheading,
)
from quire.functions.text import is_blank, strip, strip_page_prefix
from quire.operators.ordered import running, span
from quire.operators.staging import settle

LINE_CHUNK = 4096
DIVIDER = r"(?U)^---\s*ページ\s*(\d+)\s*---$"
TAGGED = r"(?U)(?d)^\[P(\d+)(?:-\d+)?\]\s*(.*)$"


def _carried_pages(lines: DataFrame, default: int) -> DataFrame:
    """``_page`` of a line, or the last one above it."""
    carried = running(
        settle(lines), ["doc_id"], [F.col("seq")], span("seq", LINE_CHUNK), latest={"_above": F.col("_page")}
    )
    return carried.withColumn("page_no", F.coalesce("_page", "_above", F.lit(default)))


def parse_body_text(df: DataFrame, col: str) -> DataFrame:
    """Paragraphs of a body blob: ``page_no, seq, text``.

    ``--- ページ N ---`` lines open pages; text above the first goes to the lowest page; a blob
    without any is page 1.  Paragraphs are separated by empty lines.
    """
    lines = df.filter(~is_blank(col)).select(
        "doc_id", F.posexplode(F.split(F.col(col), r"\r\n|\r|\n")).alias("seq", "text")
    )
    number = F.regexp_extract(strip("text"), DIVIDER, 1)
    lines = lines.withColumn("_page", number.try_cast("int"))
    carried = settle(_carried_pages(lines, 0).filter("_page IS NULL").select("doc_id", "page_no", "seq", "text"))
    lowest = lines.groupBy("doc_id").agg(F.min("_page").alias("_low"))
    placed = carried.join(lowest, "doc_id").withColumn(
        "page_no", F.when(F.col("page_no") == 0, F.coalesce("_low", F.lit(1))).otherwise(F.col("page_no"))
    ).drop("_low")
    broken = running(
        settle(placed), ["doc_id", "page_no"], [F.col("seq")], span("seq", LINE_CHUNK),
        sums={"_para": (F.col("text") == "").cast("int")},
    ).filter("text <> ''")
    joined = broken.groupBy("doc_id", "page_no", "_para").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n"
        ).alias("text"),
        F.min("seq").alias("seq"),
    )
    return joined.select("doc_id", "page_no", "seq", strip("text").alias("text")).filter("text <> ''")


def tagged_lines(df: DataFrame, col: str, skip_blank: bool = False) -> DataFrame:
    """Lines of a ``[Pn-mm] item`` blob with the page they belong to: ``seq, raw, text, tagged``.
    Lines without a tag stay on the page of the line above, page 1 at first."""
    lines = df.filter(~is_blank(col)).select(
        "doc_id", F.posexplode(F.split(F.col(col), r"\r?\n")).alias("seq", "_line")
    ).filter("_line <> ''")
    if skip_blank:
        lines = lines.withColumn("_line", strip("_line")).filter("_line <> ''")
    number = F.regexp_extract("_line", TAGGED, 1)
    tagged = number.try_cast("int").isNotNull()
    lines = lines.select(
        "doc_id", "seq", number.try_cast("int").alias("_page"), tagged.alias("tagged"),
        F.when(tagged, F.regexp_extract("_line", TAGGED, 2)).otherwise(F.col("_line")).alias("raw"),
    )
    return _carried_pages(lines, 1).select(
        "doc_id", "page_no", "seq", "raw", strip("raw").alias("text"), "tagged"
    )


def parse_items(df: DataFrame, col: str) -> DataFrame:
    """Items of a tagged blob: ``page_no, seq, text``; a tag without text gives no item."""
    lines = tagged_lines(df, col)
    return lines.filter("NOT tagged OR text <> ''").select("doc_id", "page_no", "seq", "text")


def parse_headings_with_levels(df: DataFrame, col: str) -> DataFrame:
    """Heading blob to ``page_no, seq, kind, text``: indented lines, section titles and
    subheading texts are subheadings, chapter titles never are."""
    lines = tagged_lines(df, col).withColumns(
        {"indented": F.col("raw").rlike("^(?:　|\t|  )"), "text": strip_page_prefix("text")}
    )
    t = F.col("text")
    kept = lines.filter(
        (t != "") & (F.length(t) <= 80) & ~t.contains("。") & ~t.rlike(NOTE_TAG) & ~is_noise_heading(t)
    )
    section = t.rlike(rf"^第[{CHAPTER_DIGITS}]+[節項条回]") | t.rlike(rf"(?i)(?U)^(?:Section|Sec\.)\s+[0-9{ROMAN}]+")
    sub = (F.col("indented") | section | is_subheading(t)) & ~is_major_heading(t)
    return kept.select(
        "doc_id", "page_no", "seq", F.when(sub, "subheading").otherwise("heading").alias("kind"), "text"
    )
