"""Duplicate lines and overlapping detector boxes.

The merging rules are greedy and depend on order, so they run in Python, but only on the
parts of a page where boxes come near one another; a page is first cut at every gap no
rule can bridge, and boxes on their own never leave the JVM.  Within a part a grid of cells
finds the boxes near a place, so a box is held against its neighbours and not against all.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from heapq import merge

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.geometry import LINE_CLASSES
from quire.operators.bands import band_anti, box_clusters, grid_join, prefixed
from quire.operators.staging import per_group, settle

PART = [*PAGE, "_cy", "_cx"]
DET_SCHEMA = (
    "doc_id long, page_no int, det_id int, x1 int, y1 int, x2 int, y2 int, "
    "confidence double, class_index int"
)


def _crowded(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone in their part, and the rest."""
    sized = settle(df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PART))))
    return sized.filter("_n = 1").drop("_n"), sized.filter("_n > 1").drop("_n")


class Grid:
    """Numbered boxes by the cells they touch; cells are as large as the boxes are on average."""

    def __init__(self, boxes: Iterable[tuple]):
        boxes = list(boxes)
        n = max(1, len(boxes))
        self.wide = max(1, sum(max(0, b[2] - b[0]) for b in boxes) // n)
        self.tall = max(1, sum(max(0, b[3] - b[1]) for b in boxes) // n)
        self.cells: dict[tuple, list[int]] = {}

    def _touched(self, box: tuple) -> Iterator[tuple]:
        x1, y1, x2, y2 = box
        for i in range(int(x1 // self.wide), int(max(x1, x2) // self.wide) + 1):
            for j in range(int(y1 // self.tall), int(max(y1, y2) // self.tall) + 1):
                yield i, j

    def add(self, number: int, box: tuple) -> None:
        for cell in self._touched(box):
            own = self.cells.setdefault(cell, [])
            if not own or own[-1] < number:
                own.append(number)
            elif number not in own:
                insort(own, number)

    def drop(self, number: int, box: tuple) -> None:
        for cell in self._touched(box):
            own = self.cells[cell]
            del own[bisect_right(own, number) - 1]

    def near(self, box: tuple, after: int = -1) -> Iterator[int]:
        """Numbers beyond ``after``, ascending, of boxes that share a cell with ``box``."""
        lists = [own for cell in self._touched(box) if (own := self.cells.get(cell)) and own[-1] > after]
        last = after
        for number in merge(*(_from(own, after) for own in lists)):
            if number > last:
                last = number
                yield number


def _from(numbers: list[int], after: int) -> Iterator[int]:
    for at in range(bisect_right(numbers, after), len(numbers)):
        yield numbers[at]


def resolve_duplicate_lines(
    lines: DataFrame, cross: float = 0.4, along: float = 0.5, extra_chars: int = 3
) -> DataFrame:
    """Keep one of two lines that cover the same place: the one with clearly more characters,
    else the more confident one, else the earlier.  The survivor gets the higher confidence."""
    # Lines meet as rows of numbers; their texts and what else they carry join the survivors at the end.
    light = lines.select(
        *PAGE, "line_id", "x", "y", "width", "height", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "is_vertical",
        F.length(F.regexp_replace("text", r"(?U)\s+", "")).alias("chars"), F.col("confidence").alias("_given"),
    )
    placed = box_clusters(
        light, F.col("x"), F.col("y"),
        F.col("x") + F.col("width"), F.col("y") + F.col("height"),
    )
    parts = settle(placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PART))))
    alone = parts.filter("_n = 1").select(*PAGE, "line_id", F.col("_given").alias("_conf"))
    small = parts.filter("_n > 1").select(
        *PART, "line_id", "x", "y", "width", "height", "confidence", "is_vertical", "chars"
    )

    def settle_part(rows: list[tuple]) -> list[tuple]:
        conf = [r[9] for r in rows]
        boxes = [(r[5], r[6], r[5] + r[7], r[6] + r[8]) for r in rows]
        alive = [True] * len(rows)
        grid = Grid(boxes)
        for i, box in enumerate(boxes):
            grid.add(i, box)
        for i, a in enumerate(rows):
            # A line meets its later neighbours; each meeting ends one of the two, which leaves the grid.
            ended = []
            for j in grid.near(boxes[i], after=i) if alive[i] else ():
                b = rows[j]
                if not alive[j] or not _same_place(a, b, cross, along):
                    continue
                if abs(b[11] - a[11]) > extra_chars:
                    keep_later = b[11] > a[11]
                else:
                    keep_later = conf[j] > conf[i] and conf[j] > 0
                top = max(conf[i], conf[j])
                if keep_later:
                    conf[j], alive[i] = top, False
                    break
                conf[i], alive[j] = top, False
                ended.append(j)
            for j in ended:
                grid.drop(j, boxes[j])
        return [(r[0], r[1], r[4], c) for r, c, ok in zip(rows, conf, alive) if ok]

    settled = per_group(
        small, PART, ["line_id"], settle_part, "doc_id long, page_no int, line_id int, _conf double"
    )
    kept = alone.unionByName(settled)
    return lines.join(kept, [*PAGE, "line_id"]).withColumn("confidence", F.col("_conf")).select(*lines.columns)


def _same_place(a: tuple, b: tuple, cross: float, along: float) -> bool:
    """Rows are ``(.., x, y, width, height, confidence, is_vertical, chars)`` from index 5."""
    wide, tall = max(a[7], b[7]), max(a[8], b[8])
    if wide <= 0 or tall <= 0:
        return False
    rx = max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])) / wide
    ry = max(0, min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6])) / tall
    main, side = (ry, rx) if a[10] or b[10] else (rx, ry)
    return side > cross and main > along


def merge_detections(
    dets: DataFrame,
    iou: float = 0.5,
    containment: float = 0.8,
    coverage: float = 0.85,
    gap: int = 80,
) -> DataFrame:
    """Strongest boxes first: join split pieces of a line, drop what is covered already."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    line = F.col("class_index").isin(LINE_CLASSES)
    # Only pieces of one line may meet across a gap: sideways for flat ones, else downwards.
    reach_x = F.when(line & (F.greatest(F.lit(1), w) >= F.greatest(F.lit(1), h)), gap).otherwise(0)
    reach_y = F.when(line & (F.greatest(F.lit(1), h) > F.greatest(F.lit(1), w)), gap).otherwise(0)
    dets = dets.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    placed = box_clusters(
        dets, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"),
        reach_x=reach_x, reach_y=reach_y,
    )
    alone, near = _crowded(placed)
    columns = [*PAGE, "det_id", "x1", "y1", "x2", "y2", "confidence", "class_index"]

    def greedy(rows: list[tuple]) -> list[tuple]:
        kept: list[dict] = []
        grids: dict[int, Grid] = {}
        corners = [r[5:9] for r in rows]
        for row in rows:
            box = dict(zip(columns, row[:2] + row[4:11]))
            # Pieces of lines of all classes may meet; other boxes only meet their own class.
            kind = -1 if box["class_index"] in LINE_CLASSES else box["class_index"]
            if kind not in grids:
                grids[kind] = Grid(corners)
            grid = grids[kind]
            around = (kept[i] for i in grid.near(_reach(box, kind == -1, gap)))
            taker, widened = _taker(box, around, iou, containment, coverage, gap)
            if taker is None:
                box["_at"] = len(kept)
                kept.append(box)
                grid.add(box["_at"], _corners(box))
            elif widened:
                grid.add(taker["_at"], _corners(taker))
        return [tuple(k[c] for c in columns) for k in kept]

    ranked = near.select(
        *PART, *columns[2:], (-F.col("confidence")).alias("_c"),
        (-(F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))).alias("_a"),
    )
    merged = per_group(ranked, PART, ["_c", "_a", "det_id"], greedy, DET_SCHEMA)
    return alone.select(*columns).unionByName(merged)


def _corners(box: dict) -> tuple:
    return box["x1"], box["y1"], box["x2"], box["y2"]


def _reach(box: dict, line: bool, gap: int) -> tuple:
    """Where a box may meet others: a line also across ``gap`` at its ends."""
    x1, y1, x2, y2 = _corners(box)
    if not line:
        return x1, y1, x2, y2
    if max(1, x2 - x1) >= max(1, y2 - y1):
        return x1 - gap, y1, x2 + gap, y2
    return x1, y1 - gap, x2, y2 + gap


def _taker(box: dict, kept: Iterable[dict], iou, containment, coverage, gap) -> tuple[dict | None, bool]:
    """The kept box that takes this one in, if any, and whether that widened it.

    ``kept`` are boxes near it, strongest first.  A box that several cover together is taken by the last of them.
    """
    area = _size(box, "x") * _size(box, "y")
    line = box["class_index"] in LINE_CLASSES
    covered, last = 0.0, None
    for k in kept:
        if line and k["class_index"] in LINE_CLASSES and _pieces_of_one(box, k, gap):
            return k, _stretch(k, box)
        if box["class_index"] != k["class_index"] and not (line and k["class_index"] in LINE_CLASSES):
            continue
        shared = _shared(box, k, "x") * _shared(box, k, "y")
        if shared <= 0:
            continue
        union = area + _size(k, "x") * _size(k, "y") - shared
        stronger = k["confidence"] >= box["confidence"]
        if (union > 0 and shared / union > iou) or (stronger and shared / area > containment):
            return k, False
        covered, last = covered + shared, k
    return (last, False) if covered / area > coverage else (None, False)


def _size(box: dict, axis: str) -> int:
    return max(1, box[axis + "2"] - box[axis + "1"])


def _shared(a: dict, b: dict, axis: str) -> int:
    return max(0, min(a[axis + "2"], b[axis + "2"]) - max(a[axis + "1"], b[axis + "1"]))


def _axes(box: dict) -> tuple[str, str]:
    """The axis a line runs along, and the one across."""
    return ("x", "y") if _size(box, "x") >= _size(box, "y") else ("y", "x")


def _pieces_of_one(a: dict, b: dict, gap: int) -> bool:
    """Two boxes of one line: same direction, level, of like thickness, and close along it."""
    m, c = _axes(a)
    if _axes(b) != (m, c):
        return False
    thin, thick = sorted((_size(a, c), _size(b, c)))
    off = abs((a[c + "1"] + a[c + "2"]) - (b[c + "1"] + b[c + "2"])) / 2
    if off > max(8.0, thin * 0.35) or _shared(a, b, c) / thin < 0.5:
        return False
    if not 0.5 <= _size(a, c) / _size(b, c) <= 1.8:
        return False
    apart = max(0, max(a[m + "1"], b[m + "1"]) - min(a[m + "2"], b[m + "2"]))
    along = _shared(a, b, m) / min(_size(a, m), _size(b, m))
    inside = (along if m == "x" else _shared(a, b, c) / thin) > 0.6
    return apart < gap or (along > 0 and not inside)


def _stretch(kept: dict, box: dict) -> bool:
    """Let a kept piece reach over another one that is sure enough and clearly longer at an end."""
    m, c = _axes(box)
    longer = box[m + "1"] < kept[m + "1"] - 25 or box[m + "2"] > kept[m + "2"] + 25
    if not longer or box["confidence"] < 0.35:
        return False
    size, own = _size(box, m), _size(kept, m)
    # The much longer piece sets the edges across; pieces of like length share them.
    for e in "12":
        if size > own * 1.3:
            kept[c + e] = box[c + e]
        elif own <= size * 1.3:
            kept[c + e] = int(round((kept[c + e] + box[c + e]) / 2))
    kept[m + "1"], kept[m + "2"] = min(kept[m + "1"], box[m + "1"]), max(kept[m + "2"], box[m + "2"])
    kept["confidence"] = max(kept["confidence"], box["confidence"])
    return True


def box_overlap_scores(dets: DataFrame, least: float = 0.0) -> DataFrame:
    """Overlap score of every overlapping pair: IoU, or 0.85 of the share of the smaller box.

    Pairs that score below ``least`` are left out.
    """
    a, b = prefixed(dets, "a_"), prefixed(dets, "b_")
    sx = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    sy = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    pairs = grid_join(
        a, b, tuple(F.col(f"a_{e}") for e in ("x1", "y1", "x2", "y2")), tuple(F.col(f"b_{e}") for e in ("x1", "y1", "x2", "y2")),
        (F.col("a_det_id") < F.col("b_det_id")) & (sx > 0) & (sy > 0),
    )
    shared = (sx * sy).cast("double")

    def area(p: str) -> Column:
        return F.greatest(F.lit(1), (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1")))

    union = area("a_") + area("b_") - shared
    score = F.greatest(shared / union, shared / F.least(area("a_"), area("b_")) * 0.85)
    found = pairs.select(*PAGE, F.col("a_det_id").alias("id_a"), F.col("b_det_id").alias("id_b"), score.alias("score"))
    return found.filter(F.col("score") >= least) if least > 0 else found


def union_detections(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    return blocks.unionByName(lines)


def reconcile_blocks(blocks: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop text blocks that are a fragment of one line, and give lines without a block one."""
    text_block = F.col("class_index") == 0
    l = prefixed(lines.select(*PAGE, "x1", "y1", "x2", "y2"), "l_")
    bh, lh = F.col("y2") - F.col("y1"), F.col("l_y2") - F.col("l_y1")
    bw, lw = F.col("x2") - F.col("x1"), F.col("l_x2") - F.col("l_x1")
    cy = (F.col("y1") + F.col("y2")) / 2
    level = F.abs(cy - (F.col("l_y1") + F.col("l_y2")) / 2) <= F.greatest(F.lit(15.0), lh * 0.5)
    low = bh <= F.greatest(F.lit(65.0), lh * 1.4)
    spans = (F.col("l_x1") <= F.col("x1") + 35) & (F.col("l_x2") >= F.col("x2") - 35)
    touches = (lw > bw * 1.2) & (F.greatest("l_x1", "x1") < F.least("l_x2", "x2"))
    fragment = level & low & (spans | touches)
    free = band_anti(
        blocks.filter(text_block), l, cy, (F.col("l_y1") - 15, F.col("l_y2") + 15), fragment
    )
    valid = free.unionByName(blocks.filter(~text_block))
    b = prefixed(free.select(*PAGE, "x1", "y1", "x2", "y2"), "b_")
    enclosed = (
        (F.col("b_x1") <= F.col("x1") + 50) & (F.col("b_y1") <= F.col("y1") + 50)
        & (F.col("b_x2") >= F.col("x2") - 50) & (F.col("b_y2") >= F.col("y2") - 50)
    )
    bare = band_anti(
        lines, b, F.col("y1"), (F.col("b_y1") - 50, F.col("b_y2") + 50), enclosed
    )
    made = _wrap_lines(bare).join(
        pages.select(*PAGE, F.col("width").alias("_pw"), F.col("height").alias("_ph")), PAGE
    )
    columns = [*PAGE, "det_id", "x1", "y1", "x2", "y2", "confidence", "class_index"]
    wrapped = made.select(
        *PAGE, F.lit(None).cast("int").alias("det_id"),
        F.greatest(F.lit(0), F.col("x1") - 10).alias("x1"), F.greatest(F.lit(0), F.col("y1") - 10).alias("y1"),
        F.least("_pw", F.col("x2") + 10).alias("x2"), F.least("_ph", F.col("y2") + 10).alias("y2"),
        "confidence", F.lit(0).alias("class_index"),
    )
    return valid.select(*columns).unionByName(wrapped).unionByName(lines.select(*columns))


def _wrap_lines(bare: DataFrame) -> DataFrame:
    """Lines that get a block of their own.  Strongest lines go first, and a line inside the
    block of an earlier one (10 px of margin, 50 px of tolerance) needs none."""
    columns = [*PAGE, "det_id", "x1", "y1", "x2", "y2", "confidence", "class_index"]
    bare = bare.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    placed = box_clusters(
        bare.select(*columns), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"),
        reach_x=F.lit(61), reach_y=F.lit(61),
    )
    alone, near = _crowded(placed)

    def first_come(rows: list[tuple]) -> list[tuple]:
        takes: list[tuple] = []
        grid = Grid(r[5:9] for r in rows)
        for r in rows:
            x1, y1, x2, y2 = r[5:9]
            # A block that encloses the line also holds its centre, with 60 px to spare.
            centre = ((x1 + x2) / 2, (y1 + y2) / 2) * 2
            if not any(
                max(0, t[3] - 10) <= x1 + 50 and max(0, t[4] - 10) <= y1 + 50
                and t[5] + 10 >= x2 - 50 and t[6] + 10 >= y2 - 50
                for t in (takes[i] for i in grid.near(centre))
            ):
                grid.add(len(takes), (x1 - 60, y1 - 60, x2 + 60, y2 + 60))
                takes.append(r[:2] + r[4:11])
        return takes

    ranked = near.select(
        *PART, *columns[2:], (-F.col("confidence")).alias("_c"),
        (-(F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))).alias("_a"),
    )
    wrapped = per_group(ranked, PART, ["_c", "_a", "det_id"], first_come, DET_SCHEMA)
    return alone.select(*columns).unionByName(wrapped)
