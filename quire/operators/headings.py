"""Headings of pages: cleaning, removal, running headers, matches with body lines.

Case-blind comparison uses ``lower``: unlike ``upper`` it maps letter to letter (ß stays ß).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.headings import (
    CHAPTER_DIGITS,
    NOTE_TAG,
    chapter_key,
    is_major_heading,
    is_subheading,
    major_of,
    noise_of,
    subheading_of,
)
from quire.functions.text import given, is_blank, normalize_text, strip, strip_page_prefix, without_tags
from quire.operators.ordered import largest, running, span
from quire.operators.staging import settle

PAGE_CHUNK = 64
#: Texts of a page that one task sorts; of more, ranges are made.
PAGE_TEXTS = 20_000
SECTION = rf"^第[{CHAPTER_DIGITS}]+節(?:[\s　・:：].*)?$"
PROTECTED = rf"^(?:序章|終章|第[{CHAPTER_DIGITS}]+[章節編部])"


def _short_title(text: Column) -> Column:
    return (text != "") & (F.length(text) <= 80) & ~text.contains("。") & ~text.rlike(NOTE_TAG)


def distinct_ci(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First of items that differ in case only.  Copies fold before the shuffle."""
    keys = keys or [k for k in [*PAGE, "kind"] if k in items.columns]
    rest = [c for c in items.columns if c not in keys]
    first = items.groupBy(*keys, F.lower("text").alias("_u")).agg(
        F.min_by(F.struct(*rest), "seq").alias("_f")
    )
    return first.select(*keys, "_f.*").select(*items.columns)


def drop_prefix_fragments(items: DataFrame, keys: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """Drop items that are a strict prefix, case aside, of another item of the page.

    In sorted order the texts that start with an item follow it directly, so one look at the
    next text is enough.  Pages of many texts are cut into ranges of that order.  Null texts stay.

    ``distinct``: the items are stored, and none of a page differ in case only.
    """
    keys = keys or [k for k in [*PAGE, "kind"] if k in items.columns]
    u = F.lower("text")
    if largest(items.filter("text IS NOT NULL"), keys) <= PAGE_TEXTS:
        return _without_fragments(items.repartition(*keys), keys, distinct)
    if distinct:
        texts = items.withColumn("_u", u)
    else:
        texts = settle(items.filter("text IS NOT NULL").select(*keys, u.alias("_u")).distinct())
    counts = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    crowded = settle(counts.filter(F.col("_n") > PAGE_TEXTS).select(*keys))
    follow = F.lead("_u").over(Window.partitionBy(*keys).orderBy("_u"))
    whole = F.coalesce(F.col("_next").startswith(F.col("_u")), F.lit(False))
    if crowded.isEmpty():
        looked = texts.withColumn("_next", follow)
        if distinct:
            return looked.filter(~whole).select(*items.columns)
        fragments = looked.filter(whole).select(*keys, "_u")
    else:
        texts = texts.select(*keys, "_u").filter("_u IS NOT NULL")
        few = texts.join(crowded, keys, "left_anti").withColumn("_next", follow).filter(whole).select(*keys, "_u")
        fragments = few.unionByName(_fragments_by_range(texts.join(crowded, keys, "left_semi"), keys))
    return items.withColumn("_u", u).join(fragments, [*keys, "_u"], "left_anti").select(*items.columns)


def _without_fragments(items: DataFrame, keys: list[str], distinct: bool) -> DataFrame:
    """The same for items that lie together by their page; texts are put in lower case where they lie."""
    along = Window.partitionBy(*keys).orderBy("_u")
    looked = items.withColumn("_u", F.lower("text")).withColumn("_next", F.lead("_u").over(along))
    fragment = F.col("_next").startswith(F.col("_u"))
    if not distinct:
        # Equal texts stand side by side; the last of them sees the next other one.
        looked = looked.withColumn("_next", F.max("_next").over(Window.partitionBy(*keys, "_u")))
        fragment &= F.col("_next") != F.col("_u")
    for k in keys:
        fragment &= F.col(k).isNotNull()
    return looked.filter(~F.coalesce(fragment, F.lit(False))).select(*items.columns)


def _fragments_by_range(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts (``_u``) that open another one: the last one of a range of the order looks at the first one of the next."""
    ranged = settle(settle(texts).repartitionByRange(*keys, "_u").withColumn("_range", F.spark_partition_id()))
    firsts = ranged.groupBy(*keys, "_range").agg(F.min("_u").alias("_first"))
    later = firsts.select(
        *keys, "_range", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_later")
    )
    nxt = F.coalesce(F.lead("_u").over(Window.partitionBy(*keys, "_range").orderBy("_u")), F.col("_later"))
    return (
        ranged.join(later, [*keys, "_range"]).withColumn("_next", nxt)
        .filter(F.col("_next").startswith(F.col("_u"))).select(*keys, "_u")
    )


def clean_headings(items: DataFrame) -> DataFrame:
    """Headings and subheadings as they are kept: tags stripped, short, no sentence, no note,
    not removed (``kind = 'removed'``), distinct, no fragments of longer ones."""
    # Removed headings fold into the same groups as the headings they take away.
    known = items.filter(F.col("kind").isin("heading", "subheading", "removed"))
    known = known.withColumns({"text": strip_page_prefix("text"), "_gone": F.col("kind") == "removed"})
    keyed = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & (F.col("text") != "")
    known = known.filter(F.when(F.col("_gone"), keyed).otherwise(_short_title(F.col("text"))))
    known = known.withColumn("kind", F.when(F.col("_gone"), "heading").otherwise(F.col("kind")))
    few = largest(items.filter(F.col("kind").isin("heading", "subheading", "removed")), PAGE) <= PAGE_TEXTS
    # Dealt out by page, the headings need not move again, and their lower case does not travel.
    known = known.repartition(*PAGE) if few else known
    keys = [*PAGE, "kind"]
    rest = [c for c in items.columns if c not in keys]
    first = known.groupBy(*keys, F.lower("text").alias("_u")).agg(
        F.min_by(F.when(~F.col("_gone"), F.struct(*rest)), F.when(~F.col("_gone"), F.col("seq"))).alias("_f"),
        F.max("_gone").alias("_gone"),
    )
    kept = first.filter("NOT _gone").select(*keys, "_f.*").select(*items.columns)
    return settle(_without_fragments(kept, keys, True)) if few else drop_prefix_fragments(settle(kept), distinct=True)


def reclassify_headings(items: DataFrame) -> DataFrame:
    """Headings that are really subheadings join the subheadings of their page, behind them."""
    wrong = (F.col("kind") == "heading") & is_subheading("text") & ~is_major_heading("text")
    moved = items.withColumn("_moved", wrong)
    late = F.when(F.col("_moved"), F.col("seq") + (1 << 30)).otherwise(F.col("seq"))
    out = moved.withColumns({"kind": F.when(F.col("_moved"), "subheading").otherwise(F.col("kind")), "seq": late})
    # The first of subheadings that differ in case only; every text is judged and moved once.
    same = Window.partitionBy(*PAGE, "kind", F.lower("text")).orderBy("seq")
    numbered = out.filter("kind IS NOT NULL").withColumn("_no", F.row_number().over(same))
    return numbered.filter((F.col("kind") != "subheading") | (F.col("_no") == 1)).select(*items.columns)


def filter_tagged_headings(items: DataFrame) -> DataFrame:
    """Headings tagged with another page go; tags are stripped, repeats dropped."""
    tagged = F.regexp_extract("text", r"(?U)^\[P(\d+)(?:-\d+)?\]", 1)
    here = (tagged == "") | tagged.try_cast("int").eqNullSafe(F.col("page_no")) | tagged.try_cast("int").isNull()
    clean = items.filter(~is_blank("text") & here).withColumn("text", strip_page_prefix("text"))
    return distinct_ci(clean.filter("text <> ''"))


def drop_removed_headings(headings: DataFrame, removed: DataFrame) -> DataFrame:
    """Headings the page's removed list does not cover: equal, equal when normalised, or one
    inside the other.  Chapter and section titles always stay."""
    h = headings.withColumn("_c", strip_page_prefix("text")).filter("_c <> ''")
    h = h.withColumns({"_u": F.lower("_c"), "_n": normalize_text("_c"), "_safe": F.col("_c").rlike(PROTECTED)})
    r = removed.filter(~is_blank("text")).select(
        *[F.col(k).alias(f"_r_{k}") for k in PAGE], F.lower("text").alias("_ru"), normalize_text("text").alias("_rn")
    ).distinct()
    on = (
        (F.col("doc_id") == F.col("_r_doc_id")) & (F.col("page_no") == F.col("_r_page_no")) & ~F.col("_safe")
        & (
            F.col("_u").contains(F.col("_ru")) | F.col("_ru").contains(F.col("_u"))
            | ((F.col("_n") != "") & (F.col("_n") == F.col("_rn")))
        )
    )
    return h.join(r, on, "left_anti").select(*headings.columns)


def drop_running_headers(headings: DataFrame, mode: str = "carried") -> DataFrame:
    """Drop repeated chapter titles: ``carried`` those equal to the chapter running so far,
    ``seen`` those that came up anywhere before in the document."""
    keyed = settle(headings.withColumn("_key", F.lower(chapter_key("text"))))
    if mode == "seen":
        firsts = keyed.filter("_key IS NOT NULL").groupBy("doc_id", "_key").agg(
            F.min(F.struct("page_no", "seq")).alias("_f")
        )
        kept = keyed.filter("_key IS NULL").select(*headings.columns)
        same = keyed.join(firsts, ["doc_id", "_key"]).filter(
            (F.col("_f.page_no") == F.col("page_no")) & (F.col("_f.seq") == F.col("seq"))
        )
        return kept.unionByName(same.select(*headings.columns))
    if mode != "carried":
        raise ValueError(f"unknown mode {mode!r}")
    carried = running(
        keyed, ["doc_id"], [F.col("page_no"), F.col("seq")], span("page_no", PAGE_CHUNK),
        latest={"_was": F.col("_key")},
    )
    again = F.col("_key").isNotNull() & F.col("_key").eqNullSafe(F.col("_was"))
    return carried.filter(~again).select(*headings.columns)


def first_occurrence(headings: DataFrame) -> DataFrame:
    """Each heading once per document, where it first stands."""
    clean = strip_page_prefix("text")
    n = headings.withColumns({"text": clean, "_n": normalize_text(clean)}).filter("_n <> ''")
    rest = [c for c in headings.columns if c != "doc_id"]
    firsts = n.groupBy("doc_id", "_n").agg(F.min_by(F.struct(*rest), F.struct("page_no", "seq")).alias("_f"))
    return firsts.select("doc_id", "_f.*").select(*headings.columns)


def body_lines(paragraphs: DataFrame) -> DataFrame:
    """Lines of body paragraphs: page key, ``seq``, ``line_index``, ``text`` as written."""
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda l: l != "")
    return paragraphs.select(*PAGE, "seq", F.posexplode(lines).alias("line_index", "text"))


def _match_key(clean: Column) -> Column:
    """Equal for texts that are equal but for case, or equal when normalised."""
    norm = normalize_text(clean)
    return F.when(norm != "", F.concat(F.lit("n"), norm)).otherwise(F.concat(F.lit("u"), F.lower(clean)))


def standalone_headings(headings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Headings that are no line of their page's body."""
    h = headings.withColumn("text", strip_page_prefix("text"))
    h = h.withColumn("_n", normalize_text("text")).filter("_n <> ''")
    lines = body_lines(paragraphs).select(*PAGE, normalize_text("text").alias("_n")).distinct()
    return h.join(lines, [*PAGE, "_n"], "left_anti").select(*headings.columns)


def mark_heading_lines(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds ``is_heading``: is the line one of the page's headings or subheadings?"""
    t = strip("text")
    known = headings.filter(~is_blank("text")).select(*PAGE, _match_key(strip_page_prefix("text")).alias("_k")).distinct()
    known = known.select(*[F.col(k).alias(f"_k_{k}") for k in PAGE], "_k", F.xxhash64("_k").alias("_kh"))
    fits = (F.length(t) <= 80) & ~t.contains("。") & ~t.rlike(NOTE_TAG)
    # A line travels with a number of its key; the key itself decides, written so that it does not become a join key.
    key = _match_key(t)
    on = (F.col("_h") == F.col("_kh")) & (key <= F.col("_k")) & (key >= F.col("_k"))
    for k in PAGE:
        on &= F.col(k) == F.col(f"_k_{k}")
    return (
        lines.withColumn("_h", F.xxhash64(key))
        .join(known, on, "left")
        .withColumn("is_heading", fits & F.col("_k").isNotNull())
        .select(*lines.columns, "is_heading")
    )


# --- removed headings ----------------------------------------------------------------

def update_removed(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed list after an edit of the headings: headings that are gone are added, headings
    that are back are taken out.  Pages without new headings keep their list."""
    edited = new.select(*PAGE).distinct()
    now_u = new.select(*PAGE, F.lower("text").alias("_u")).distinct()
    now_n = new.select(*PAGE, normalize_text("text").alias("_n")).distinct()
    kept = (
        removed.select(*PAGE, "text").withColumns({"_u": F.lower("text"), "_n": normalize_text("text")})
        .join(now_u, [*PAGE, "_u"], "left_anti").join(now_n, [*PAGE, "_n"], "left_anti")
    )
    gone = (
        old.join(edited, PAGE, "left_semi").select(*PAGE, "seq", strip_page_prefix("text").alias("text"))
        .withColumn("_u", F.lower("text"))
        .join(now_u, [*PAGE, "_u"], "left_anti")
        .join(kept.select(*PAGE, "_u"), [*PAGE, "_u"], "left_anti")
        .drop("_u")
    )
    added = distinct_ci(gone, PAGE).select(*PAGE, "text")
    return kept.select(*PAGE, "text").unionByName(added)


def merge_removed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two removed lists, the first one's spelling kept."""
    both = a.select(*PAGE, "text", F.lit(0).alias("seq")).unionByName(b.select(*PAGE, "text", F.lit(1).alias("seq")))
    return distinct_ci(both, PAGE).select(*PAGE, "text")


def sync_headings(page_items: DataFrame, auto_detect: bool = False) -> DataFrame:
    """Heading and subheading lists of every page, rebuilt from the stored lists and, for
    section titles and (with ``auto_detect``) subheadings, from the body lines.

    Returns rows of kind ``heading``, ``subheading`` and ``removed``.
    """
    items = page_items.select(*PAGE, "kind", "seq", "text")
    removed = items.filter("kind = 'removed'")

    def verdict(t: Column) -> Column:
        sub = (F.col("kind") == "subheading") | ((t.rlike(SECTION) | subheading_of(t)) & ~major_of(t))
        fit = (t != "") & ~noise_of(t)
        return F.when(fit, F.array(F.struct(F.when(sub, "subheading").otherwise("heading").alias("kind"), t.alias("text"))))

    # Reclassified headings come before the stored subheadings, body lines after both.
    rank = F.when(F.col("kind") == "heading", 0).otherwise(1)
    # Judged within a generator: a filter on what is judged would move before it and judge every text again.
    listed = items.filter(F.col("kind").isin("heading", "subheading")).select(
        *PAGE, rank.alias("rank"), "seq", F.lit(0).alias("line_index"),
        F.inline(given(strip_page_prefix("text"), verdict)),
    ).select(*PAGE, "kind", "rank", "seq", "line_index", "text")

    def found_in(line: Column) -> Column:
        def judged(t: Column) -> Column:
            section = t.rlike(SECTION)
            fit = (section | subheading_of(line)) if auto_detect else section
            return F.when(fit & ~noise_of(t), F.array(F.struct(section.alias("_section"), t.alias("text"))))

        return F.when(_short_title(line), given(without_tags(line), judged))

    lines = body_lines(items.filter("kind = 'body'"))
    found = settle(lines.select(*PAGE, "seq", "line_index", F.inline(given(strip("text"), found_in))))
    sections = found.filter("_section").drop("_section")
    if auto_detect:
        detected = found.filter("NOT _section").drop("_section")
        found = sections.unionByName(drop_removed_headings(detected, removed))
    else:
        found = sections
    from_body = found.select(
        *PAGE, F.lit("subheading").alias("kind"), F.lit(2).alias("rank"), "seq", "line_index", "text"
    )
    both = listed.unionByName(from_body)
    order = F.struct("rank", "seq", "line_index")
    unique = both.groupBy(*PAGE, "kind", F.lower("text").alias("_u")).agg(
        F.min_by("text", order).alias("text"), F.min(order).alias("_o")
    )
    lists = drop_prefix_fragments(settle(unique.select(*PAGE, "kind", "_o", "text")), distinct=True)
    # A section title in the body takes itself off the removed list.
    back = sections.select(*PAGE, _match_key(F.col("text")).alias("_k")).distinct()
    left = removed.withColumn("_k", _match_key(F.col("text"))).join(back, [*PAGE, "_k"], "left_anti")
    seq = F.col("_o.rank") * (1 << 28) + F.col("_o.seq")
    return lists.select(*PAGE, "kind", seq.cast("int").alias("seq"), "text").unionByName(
        left.select(*PAGE, "kind", "seq", "text")
    )
