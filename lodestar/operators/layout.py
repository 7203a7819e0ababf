"""Layout of a page: reading order, figures and captions. One array of boxes per page, many pages a call of Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import covered
from ..functions.text import is_caption, is_prose

#: Fixed values in points and shares: gutters, sizes, gaps, growth.
COLUMN_GAP, ROW_GAP, MIN_FIGURE, MIN_RASTER = 10.0, 1.0, 60.0, 24.0
MERGE_GAP, LABEL_GAP, LABEL_CHARS, GROWTH, CUT_SHARE = 10.0, 12.0, 80, 1.5, 0.5
CAPTION_DISTANCE, TEXT_SHARE, CLAIMED_SHARE = 80.0, 0.70, 0.5

Box = tuple[float, float, float, float]


def _overlap(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _hull(*boxes: Box) -> Box:
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return min(x0), min(y0), max(x1), max(y1)


def widest_gap(spans: list[tuple[float, float]], least: float) -> float | None:
    """Middle of the widest stretch of at least ``least`` that no span covers; the first of equals."""
    reach, best, at = None, least, None
    for low, high in sorted(spans):
        if reach is not None and low > reach and (low - reach > best or at is None and low - reach >= best):
            best, at = low - reach, (low + reach) / 2
        reach = high if reach is None else max(reach, high)
    return at


def reading_order(boxes: list[Box]) -> list[int]:
    """Recursive XY-cut: at the widest gutter into columns, else at the widest gap into rows, else from the top left.

    Where the last left edge lies less than a gutter behind the first right one,
    no part has a gutter, and cuts into rows only order by the top: such a group
    is sorted at once.
    """
    out: list[int] = []
    work = [list(range(len(boxes)))]
    while work:
        group = work.pop()
        narrow = len(group) < 2 or max(boxes[i][0] for i in group) - min(boxes[i][2] for i in group) < COLUMN_GAP
        for axis, least in () if narrow else ((0, COLUMN_GAP), (1, ROW_GAP)):
            at = widest_gap([(boxes[i][axis], boxes[i][axis + 2]) for i in group], least)
            sides = at is not None and ([i for i in group if boxes[i][axis] < at], [i for i in group if boxes[i][axis] >= at])
            if sides and all(sides):
                work += reversed(sides)
                break
        else:
            out += sorted(group, key=lambda i: (boxes[i][1], boxes[i][0])) if len(group) > 1 else group
    return out


def _prose_hit(box: Box, prose: list[Box]) -> bool:
    return any(_overlap(box, p) > 0 for p in prose)


def merged_figures(boxes: list[Box], prose: list[Box], gap: float = MERGE_GAP) -> list[Box]:
    """Boxes within ``gap`` of each other as one, unless the union would touch prose; until nothing merges.

    The first pair merges first. Boxes before a merged one had no partner, so it
    alone can be their new one.
    """
    groups = list(boxes)

    def meet(i: int, j: int) -> bool:
        a, b = groups[i], groups[j]
        near = (a[0] - gap, a[1] - gap, a[2] + gap, a[3] + gap)
        return _overlap(near, b) > 0 and not _prose_hit(_hull(a, b), prose)

    i = 0
    while i < len(groups):
        pair = next(((i, j) for j in range(i + 1, len(groups)) if meet(i, j)), None)
        while pair:
            i, j = pair
            groups[i] = _hull(groups[i], groups.pop(j))
            pair = next(((h, i) for h in range(i) if meet(h, i)), None) or next(((i, j) for j in range(i + 1, len(groups)) if meet(i, j)), None)
        i += 1
    return groups


def _takes(box: Box, label: Box, limit: float, prose: list[Box]) -> bool:
    """Whether a figure may grow over a label: it is near, the whole stays small enough and clear of prose."""
    edge = (box[0] - LABEL_GAP, box[1] - LABEL_GAP, box[2] + LABEL_GAP, box[3] + LABEL_GAP)
    whole = _hull(box, label)
    return _overlap(label, edge) > 0 and _area(whole) <= limit and not _prose_hit(whole, prose)


def with_labels(box: Box, labels: list[Box], prose: list[Box]) -> Box:
    """A figure grown over the short labels at its edge, to at most half as much area again.

    Labels are gone through three times, as one that was taken brings others near.
    """
    limit = _area(box) * GROWTH
    return reduce(lambda grown, label: _hull(grown, label) if _takes(grown, label, limit, prose) else grown, labels * 3, box)


def _within(band: Box, drawings: list[Box]) -> Box | None:
    """The smallest box around what of the drawings lies in a band; nothing if that is too small for a figure."""
    parts = [(max(d[0], band[0]), max(d[1], band[1]), min(d[2], band[2]), min(d[3], band[3])) for d in drawings if _overlap(d, band) > 0]
    tight = _hull(*parts) if parts else (0.0, 0.0, 0.0, 0.0)
    return tight if min(tight[2] - tight[0], tight[3] - tight[1]) >= MIN_FIGURE else None


def split_at_prose(box: Box, prose: list[Box], drawings: list[Box]) -> list[Box]:
    """A cluster cut into the bands around prose that spans half its width, each drawn tight around its drawings."""
    across = lambda p: min(box[2], p[2]) - max(box[0], p[0])
    walls = sorted((p[1], p[3]) for p in prose if _overlap(p, box) > 0 and across(p) >= (box[2] - box[0]) * CUT_SHARE)
    if not walls:
        return [box]
    bottoms = list(accumulate((bottom for _, bottom in walls), max, initial=box[1]))
    tops = [*(top for top, _ in walls), box[3]]
    bands = [(box[0], low, box[2], min(high, box[3])) for low, high in zip(bottoms, tops, strict=True) if min(high, box[3]) > low]
    return [b for band in bands if (b := _within(band, drawings))]


def trimmed(box: Box, prose: list[Box]) -> Box:
    """A figure pulled back from prose beside it, unless too little would stay."""
    middle = (box[0] + box[2]) / 2
    beside = [p for p in prose if min(box[3], p[3]) > max(box[1], p[1])]
    right = min([box[2], *(p[0] for p in beside if p[0] >= middle)])
    left = max([box[0], *(p[2] for p in beside if p[0] < middle and p[2] <= middle)])
    return box if right - left < MIN_FIGURE else (left, box[1], right, box[3])


def _pages(b: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """The rows of each array of structs, with those fields."""
    flat = b.flatten()
    rows = list(zip(*(flat.field(n).to_numpy(zero_copy_only=False).tolist() for n in names), strict=True))
    ends = np.cumsum(b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    yield from (rows[low:high] for low, high in zip([0, *ends], ends, strict=False))


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(lengths)], pa.int32()), values)


def is_covered(inner: Box, outer: Box, share: float = 0.6) -> bool:
    """As ``boxes.covered``."""
    return _area(inner) > 0 and _overlap(inner, outer) >= _area(inner) * share


def _places(b: pa.Array) -> pa.Array:
    """The place of each box (rank, seq, x0, y0, x1, y1, block) of a page, none for blocks that another box covers."""
    out: list[int | None] = []
    lengths = []
    for rows in _pages(b, "rank", "seq", "x0", "y0", "x1", "y1", "block"):
        assets = [r[2:6] for r in rows if r[6] == 0]
        left = sorted((n for n, r in enumerate(rows) if r[6] != 1 or not any(is_covered(r[2:6], a) for a in assets)), key=lambda n: rows[n][:2])
        places: list[int | None] = [None] * len(rows)
        for place, n in enumerate(reading_order([rows[n][2:6] for n in left])):
            places[left[n]] = place
        out += places
        lengths.append(len(rows))
    return _lists(lengths, pa.array(out, pa.int32()))


def places(rank: Column, seq: Column, corners: Column, block: Column) -> Column:
    """What ``placed`` collects of each box: its order among equals, corners, and whether it is an asset (0), a block that assets may cover (1), or neither (2)."""
    return F.struct(rank.alias("rank"), seq.alias("seq"), *[corners[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], block.alias("block"))


def placed(rows: DataFrame, box: Column, own: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (doc_id, page, ...) with their place in the reading order of their page; covered blocks are left out.

    ``box``: as ``places`` makes it. Rows are shuffled once, with the columns
    ``own`` (all, if not named), and only boxes go through Python.
    """
    own = [c for c in rows.columns if c not in ("doc_id", "page")] if own is None else list(own)
    dealt = rows.select("doc_id", "page", F.struct(*own, box.alias("_box")).alias("row"))
    pages = dealt.groupBy("doc_id", "page").agg(F.collect_list("row").alias("rows"))
    order = F.arrow_udf(_places, "array<int>")
    each = pages.withColumn("_at", order(F.col("rows._box"))).select("doc_id", "page", F.explode(F.arrays_zip("rows", "_at")).alias("r")).where(F.col("r._at").isNotNull())
    return each.select("doc_id", "page", *[F.col("r.rows")[c].alias(c) for c in own], F.col("r._at").alias("place"))


def page_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` (doc_id, page, seq, x0, y0, x1, y1) with their place in reading order."""
    box = places(F.lit(0), F.col("seq"), F.array("x0", "y0", "x1", "y1"), F.lit(2))
    return placed(boxes.select("doc_id", "page", "seq", box.alias("box")), F.col("box")).select("doc_id", "page", F.col("seq").cast("int").alias("seq"), "place")


#: Kinds of boxes by number, as ``_figures`` receives them.
KINDS = ("raster", "cluster", "drawing", "table", "text")


def _figures(b: pa.Array) -> pa.Array:
    """The figures (x0, y0, x1, y1) of each page, from its boxes (seq, kind, prose, label, x0, y0, x1, y1)."""
    out: list[Box] = []
    lengths = []
    for rows in _pages(b, "seq", "kind", "prose", "label", "x0", "y0", "x1", "y1"):
        rows.sort(key=lambda r: r[0])
        of = {k: [r[4:] for r in rows if r[1] == n] for n, k in enumerate(KINDS)}
        prose, labels = [r[4:] for r in rows if r[2]], [r[4:] for r in rows if r[3]]
        found = [b for b in dict.fromkeys(of["raster"]) if min(b[2] - b[0], b[3] - b[1]) >= MIN_RASTER]
        for cluster in of["cluster"]:
            for b in split_at_prose(cluster, prose, of["drawing"]):
                if min(b[2] - b[0], b[3] - b[1]) < MIN_FIGURE or any(_overlap(b, c) > _area(b) * CLAIMED_SHARE for c in of["table"] + found):
                    continue
                if sum(_overlap(t, b) for t in of["text"]) <= _area(b) * TEXT_SHARE:
                    found.append(b)
        made = [trimmed(with_labels(b, labels, prose), prose) for b in merged_figures(found, prose)]
        out += made
        lengths.append(len(made))
    corners = np.array(out, np.float64).reshape(-1, 4)
    return _lists(lengths, pa.StructArray.from_arrays([pa.array(corners[:, i]) for i in range(4)], ["x0", "y0", "x1", "y1"]))


def page_figures(boxes: DataFrame) -> DataFrame:
    """Figures of each page, in candidate order: (doc_id, page, figure, x0, y0, x1, y1).

    ``boxes``: doc_id, page, seq, kind (raster, cluster, drawing, table, text),
    text, x0, y0, x1, y1. Rasters come first, each placement once; clusters are
    cut at prose, and fall away if small, mostly text, or mostly claimed already
    by a table or another figure. Then panels merge, labels are taken in, and
    neighbouring columns are left out.
    """
    is_text = F.col("kind") == "text"
    marked = boxes.withColumn("prose", F.coalesce(is_text & is_prose(F.col("text")), F.lit(False))).withColumn("label", F.coalesce(is_text & ~F.col("prose") & (F.char_length("text") <= LABEL_CHARS), F.lit(False)))
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(KINDS)], F.lit(len(KINDS)))
    corners = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    pages = marked.select("doc_id", "page", F.struct("seq", number.alias("kind"), "prose", "label", *corners).alias("b")).groupBy("doc_id", "page").agg(F.collect_list("b").alias("b"))
    found = F.arrow_udf(_figures, "array<struct<x0: double, y0: double, x1: double, y1: double>>")
    return pages.select("doc_id", "page", F.posexplode(found(F.col("b"))).alias("figure", "f")).select("doc_id", "page", "figure", "f.x0", "f.y0", "f.x1", "f.y1")


def captions(assets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``assets`` (doc_id, page, asset_id, bbox) with the nearest caption of ``blocks`` (doc_id, page, seq, bbox, text) above or below in its column."""
    a, b = F.col("a.bbox"), F.col("b.bbox")
    distance = F.when(b[1] >= a[3], b[1] - a[3]).when(b[3] <= a[1], a[1] - b[3])
    near = (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (distance <= CAPTION_DISTANCE)
    pairs = assets.alias("a").join(blocks.where(is_caption(F.col("text"))).alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & near, "left")
    return pairs.groupBy("a.doc_id", "a.page", "a.asset_id").agg(F.min_by("b.text", F.when(F.col("b.seq").isNotNull(), F.struct(distance, "b.seq"))).alias("caption"))


def text_outside(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Text blocks of which no asset on the page covers six tenths."""
    a = assets.select("doc_id", "page", F.col("bbox").alias("asset"))
    return blocks.join(a, (blocks["doc_id"] == a["doc_id"]) & (blocks["page"] == a["page"]) & covered(blocks["bbox"], a["asset"]), "left_anti")
