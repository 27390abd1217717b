"""Whole-document compositions: pages from lines, and the stream a document is written from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.geometry import normalize_region_type
from quire.functions.headings import CHAPTER_DIGITS, NOTE_TAG, ROMAN, is_subheading
from quire.functions.text import given, is_blank, is_western, join_western, strip, strip_page_prefix
from quire.operators import headings as H
from quire.operators import notes as N
from quire.operators.documents import move_notes_from_body
from quire.operators.ordered import numbered, span
from quire.operators.paragraphs import format_paragraphs
from quire.operators.reading import reading_order
from quire.operators.regions import order_regions, route_lines_by_region
from quire.operators.rules import apply_rules
from quire.operators.staging import settle, side_by_side
from quire.operators.tables import extract_tables

PAGE_CHUNK = 64


@dataclass(frozen=True)
class Settings:
    """Options of a run, with their usual defaults."""

    orientation: str = "auto"
    doc_type: str = "japanese"
    deck_count: int = 0
    line_chars: int = 0
    subheadings: bool = False


def _typed(regions: DataFrame, kind: str) -> DataFrame:
    either = (normalize_region_type("type") == kind) | (normalize_region_type("name") == kind)
    return regions.filter(either)


def _body_regions(user: DataFrame, auto: DataFrame, settings: Settings) -> DataFrame:
    """Body regions in reading order: the user's as listed, else the detected ones by column."""
    mine = _typed(user, "body").select(*PAGE, "region_seq", "x", "y", "width", "height")
    found = _typed(auto, "body").join(user.select(*PAGE).distinct(), PAGE, "left_anti")
    if settings.orientation != "vertical":
        found = found.filter("orientation <> 'vertical'")
    found = order_regions(found, settings.orientation).select(
        *PAGE, F.col("order_seq").alias("region_seq"), "x", "y", "width", "height"
    )
    return mine.unionByName(found)


def build_pages(
    lines: DataFrame,
    user_regions: DataFrame,
    auto_regions: DataFrame,
    rules: DataFrame | None = None,
    settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """Page items (body, heading, subheading, footnote) and table rows from recognised lines.

    Regions carry ``region_seq, name, type, orientation, x, y, width, height, rule_lines``.
    """
    if rules is not None:
        lines = apply_rules(lines, rules, "text", order="engine")
    routed, regions = side_by_side(
        lambda: settle(
            route_lines_by_region(lines, user_regions, auto_regions).select(
                *PAGE, "line_id", "text", "x", "y", "width", "height", "is_vertical", "region_type"
            )
        ),
        lambda: settle(_body_regions(user_regions, auto_regions, settings)),
    )
    args = dict(orientation=settings.orientation, doc_type=settings.doc_type, deck_count=settings.deck_count)
    styles = dict(line_chars=settings.line_chars, subheadings=settings.subheadings, **args)

    # Body text: inside body regions where a page has any, by decks elsewhere.
    body_lines = routed.filter("region_type = 'body'")
    framed_pages = regions.select(*PAGE).distinct()

    # Footnotes: in reading order, merged; a page without numbers goes on from the one before.
    note_lines = routed.filter("region_type = 'footnote'")
    note_regions = _typed(user_regions, "footnote").select(*PAGE, "region_seq", "x", "y", "width", "height")
    note_pages = note_regions.select(*PAGE).distinct()

    table_pages = routed.filter("region_type = 'table'").select(*PAGE).distinct()
    framed, free, in_regions, elsewhere, tables = side_by_side(
        lambda: format_paragraphs(body_lines.join(framed_pages, PAGE, "left_semi"), regions=regions, **styles),
        lambda: format_paragraphs(body_lines.join(framed_pages, PAGE, "left_anti"), **styles),
        lambda: reading_order(note_lines.join(note_pages, PAGE, "left_semi"), regions=note_regions, **args),
        lambda: reading_order(note_lines.join(note_pages, PAGE, "left_anti"), **args),
        lambda: extract_tables(
            lines.join(table_pages, PAGE, "left_semi"), user_regions, auto_regions, settings.doc_type
        ),
    )
    placed = in_regions.unionByName(elsewhere).join(note_lines, [*PAGE, "line_id"]).select(
        *PAGE, F.col("position").alias("seq"), "text"
    )
    body, notes = side_by_side(
        lambda: settle(
            framed.unionByName(free).select(
                *PAGE, F.lit("body").alias("kind"), F.col("para_no").alias("seq"), strip("text").alias("text")
            ).filter("text <> ''")
        ),
        lambda: N.merge_footnotes(settle(placed), carry=True).select(
            *PAGE, F.lit("footnote").alias("kind"), F.col("note_seq").alias("seq"), "text"
        ),
    )

    # Titles: lines of heading regions, and section titles found in the body.
    section_line = rf"^第[{CHAPTER_DIGITS}]+節(?:[\s　・:：].*)?$"
    section = F.col("text").rlike(rf"^第[{CHAPTER_DIGITS}]+[節項条回]") | F.col("text").rlike(
        rf"(?i)(?U)^(?:Section|Sec\.)\s+[0-9{ROMAN}]+"
    )
    own = routed.filter("region_type = 'heading'").select(
        *PAGE, F.col("line_id").alias("seq"), strip_page_prefix("text").alias("text")
    ).filter("text <> ''")
    own = own.select(
        *PAGE, F.when(section, "subheading").otherwise("heading").alias("kind"), ((1 << 28) + F.col("seq")).alias("seq"), "text"
    )
    inner = H.body_lines(body).withColumn("_t", strip("text")).filter(
        (F.length("_t") <= 80) & ~F.col("_t").contains("。") & ~F.col("_t").rlike(NOTE_TAG)
    ).withColumn("text", strip_page_prefix("_t")).filter("text <> ''")
    sub = F.col("text").rlike(section_line)
    if settings.subheadings:
        sub = sub | is_subheading("_t")
    inner = inner.filter(sub).select(*PAGE, F.lit("subheading").alias("kind"), "seq", "text")
    titles = H.distinct_ci(own.unionByName(inner)).select(*PAGE, "kind", F.col("seq").cast("int").alias("seq"), "text")

    items = body.unionByName(titles).unionByName(notes)
    return items, tables


def document_stream(
    page_items: DataFrame,
    table_rows: DataFrame,
    figures: DataFrame,
    doc_type: str = "japanese",
    auto_subheadings: bool = False,
) -> DataFrame:
    """What a document is written from, in order: ``ord, page_no, kind, text``.

    Page by page: headings that are no body line (once per document), body paragraphs and
    the subheadings inside them, tables, figures, footnotes with one kind of tag.
    """
    items = settle(move_notes_from_body(page_items))
    titles = items.filter(F.col("kind").isin("heading", "subheading"))
    own = H.first_occurrence(
        settle(H.standalone_headings(titles.filter("kind = 'heading'"), items.filter("kind = 'body'")))
    ).select(*PAGE, F.lit("heading").alias("kind"), F.lit(1).alias("part"), "seq", F.lit(0).alias("sub"), "text")

    lines = H.body_lines(items.filter("kind = 'body'")).filter(~is_blank("text"))
    marked = H.mark_heading_lines(lines, titles)
    if auto_subheadings:
        # Pages without any stored title go by the text of their lines.
        known = titles.select(*PAGE).distinct().withColumn("_known", F.lit(True))
        t = strip("text")
        guess = (F.length(t) <= 80) & ~t.contains("。") & is_subheading(t)
        marked = marked.join(known, PAGE, "left").withColumn(
            "is_heading", F.when(F.col("_known"), F.col("is_heading")).otherwise(guess)
        ).drop("_known")
    # A paragraph is one value, so its lines meet in one row; a run opens at a title and behind one.
    key = [*PAGE, "seq"]
    lines_of = F.array_sort(F.collect_list(F.struct("line_index", "is_heading", "text")))
    whole = marked.dropna(subset=key).groupBy(*key).agg(lines_of.alias("_all"))
    every = F.col("_all")

    def opens(i: Column) -> Column:
        return F.get(every, i)["is_heading"] | F.coalesce(F.get(every, i - 1)["is_heading"], F.lit(True))

    def cut(starts: Column) -> Column:
        return F.transform(
            starts, lambda i, k: F.slice(every, i + 1, F.coalesce(F.get(starts, k + 1), F.size(every)) - i)
        )

    starts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), opens)
    grouped = whole.select(*key, F.posexplode(given(starts, cut)).alias("sub", "_run")).select(
        *key, (F.col("sub") + 1).alias("sub"), F.col("_run.text").alias("_l"), F.array_max("_run.is_heading").alias("_h")
    )
    western = F.lit(doc_type == "western") | is_western(F.array_join("_l", " "))
    joined = F.when(western, join_western(F.col("_l"))).otherwise(F.array_join(F.transform("_l", strip), ""))
    body = grouped.select(
        *PAGE, F.when(F.col("_h"), "subheading").otherwise("body").alias("kind"), F.lit(2).alias("part"), "seq",
        F.col("sub").cast("int").alias("sub"), F.when(F.col("_h"), strip(F.get("_l", F.lit(0)))).otherwise(joined).alias("text"),
    )

    name = F.when(is_blank("table_name"), "表").otherwise(F.col("table_name"))
    heads = table_rows.groupBy(*PAGE, "table_seq").agg(F.min_by(name, "row_index").alias("_n")).select(
        *PAGE, F.lit("table").alias("kind"), F.lit(3).alias("part"), F.col("table_seq").alias("seq"), F.lit(0).alias("sub"),
        F.concat(F.lit("◆ "), "_n").alias("text"),
    )
    rows = table_rows.select(
        *PAGE, F.lit("table_row").alias("kind"), F.lit(3).alias("part"), F.col("table_seq").alias("seq"),
        F.col("row_index").alias("sub"), F.array_join("cells", "\t").alias("text"),
    )
    shown = figures.select(
        *PAGE, F.lit("figure").alias("kind"), F.lit(4).alias("part"), "seq", F.lit(0).alias("sub"), F.col("name").alias("text")
    )
    note = strip_page_prefix("text")
    tagged = r"(?U)(?d)^(【(?:注釈文|注)\d+】|\[(?:注釈文|注)?\d+\])\s*(.*)$"
    tag = F.regexp_replace(F.regexp_extract(note, tagged, 1), r"(?U)^【注(\d+)】", "【注釈文$1】")
    foot = items.filter("kind = 'footnote'").select(
        *PAGE, F.lit("footnote").alias("kind"), F.lit(5).alias("part"), "seq", F.lit(0).alias("sub"),
        F.when(note.rlike(tagged), F.concat(tag, F.lit(" "), F.regexp_extract(note, tagged, 2))).otherwise(note).alias("text"),
    ).filter("text <> ''")
    stream = own
    for part in (body, heads, rows, shown, foot):
        stream = stream.unionByName(part)
    order = [F.col(c) for c in ("page_no", "part", "seq", "sub")]
    ranked = numbered(settle(stream), ["doc_id"], order, span("page_no", PAGE_CHUNK), "ord")
    return ranked.select("doc_id", "ord", "page_no", "kind", "text")
