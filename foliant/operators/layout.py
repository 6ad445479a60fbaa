"""Folds over the objects of one page whose steps depend on the ones before: suppression of
overlaps, visual rows, recursive cuts. They run on Arrow batches of many pages (``fold_groups``);
a page's objects are few, whatever the number of pages. All orders are total (ties go by obj_id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.grouped import Fold, Together, fold_groups

EDGES = ["x0", "y0", "x1", "y1"]
Page = Mapping[str, np.ndarray]


def by_page(objects: DataFrame, fold: Fold, order: Sequence[str | Column], reads: Sequence[str] = (), keeps: Sequence[str] = ("page_id", "obj_id"), together: Together | None = None, **adds: str) -> DataFrame:
    return fold_groups(objects, "page_id", order, [*reads, *EDGES], keeps, fold, adds, together)


def edges(page: Page) -> np.ndarray:
    return np.stack([page[e] for e in EDGES], -1).astype(float)


def _overlap(a: np.ndarray, b: np.ndarray, mode: str) -> np.ndarray:
    """Of one box and many, of one page or of each of many: plain intersection over the union or the smaller area."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    common = np.maximum(0, w) * np.maximum(0, h)
    one, many = (a[..., 2] - a[..., 0]) * (a[..., 3] - a[..., 1]), (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    whole = np.minimum(one, many) if mode == "small" else one + many - common
    return np.where(whole > 0, common / np.where(whole > 0, whole, 1), 0.0)


def keep_best(boxes: np.ndarray, kinds: np.ndarray, same: float, different: float) -> list[int]:
    """Indexes that greedy suppression keeps, of boxes that are sorted from the best down."""
    left, kept = np.arange(len(boxes)), []
    while len(left):
        i, rest = left[0], left[1:]
        kept.append(int(i))
        limit = np.where(kinds[rest] == kinds[i], same, different)
        left = rest[_overlap(boxes[i], boxes[rest], "union") < limit]
    return kept


def nms(objects: DataFrame, same: float = 0.6, different: float = 0.98) -> DataFrame:
    """page_id, obj_id that stay; rows have kind and score."""

    def fold(p: Page):
        return keep_best(edges(p), p["kind"], same, different), {}

    def together(p: Page):
        b, kinds = edges(p), p["kind"]
        kept = np.ones(kinds.shape, bool)
        for i in range(kinds.shape[1] - 1):
            limit = np.where(kinds[:, i + 1 :] == kinds[:, i : i + 1], same, different)
            kept[:, i + 1 :] &= ~kept[:, i : i + 1] | (_overlap(b[:, i : i + 1], b[:, i + 1 :], "union") < limit)
        return kept, {}

    return by_page(objects, fold, [F.desc("score"), "obj_id"], ["kind"], together=together)


def without_overlaps(objects: DataFrame, ratio: float = 0.7, inline: float = 0.5, smallest: float = 6) -> DataFrame:
    """page_id, obj_id that stay. In order, the smaller of two that overlap goes; inline formulas
    go at a lower ratio; a picture and another kind may overlap; slivers go."""

    def fold(p: Page):
        b, kinds = edges(p), p["kind"].tolist()
        areas = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        gone: set[int] = set()
        for i in range(len(b)):
            if i in gone:
                continue
            if min(b[i, 2] - b[i, 0], b[i, 3] - b[i, 1]) < smallest:
                gone.add(i)
                continue
            shares = _overlap(b[i], b, "small")
            for j in range(i + 1, len(b)):
                if j in gone:
                    continue
                pair = {i: kinds[i], j: kinds[j]}
                formulas = {k for k, kind in pair.items() if kind == "inline_formula"}
                if formulas:
                    if shares[j] > inline:
                        gone |= formulas
                        continue
                if shares[j] > ratio:
                    if "image" in pair.values() and kinds[i] != kinds[j]:
                        continue
                    if areas[i] >= areas[j]:
                        gone.add(j)
                    else:
                        gone.add(i)
                        break
        return [i for i in range(len(b)) if i not in gone], {}

    return by_page(objects, fold, ["obj_id"], ["kind"])


def visual_rows(objects: DataFrame) -> DataFrame:
    """page_id, obj_id, row, place: peel rows from the top. An object joins a row whose box it
    overlaps by half the smaller height, unless it stands below one of the row's objects."""

    def peel(b: np.ndarray) -> list[list[int]]:
        left, rows = list(range(len(b))), []
        while left:
            row = [left.pop(0)]
            box = b[row[0]].copy()
            i = 0
            while i < len(left):
                o = b[left[i]]
                if o[3] <= box[1]:
                    break
                half = min(box[3] - box[1], o[3] - o[1]) / 2
                beside = o[3] - box[1] >= half and box[3] - o[1] >= half
                def tight(lo, hi, own):
                    return min(4, own, hi - lo)
                below = any(
                    min(o[2] - m[0], m[2] - o[0]) >= tight(m[0], m[2], o[2] - o[0]) and m[1] - o[3] >= -4 and o[1] < m[1] for m in b[row]
                )
                if beside and not below:
                    row.append(left.pop(i))
                    box = np.concatenate([np.minimum(box[:2], o[:2]), np.maximum(box[2:], o[2:])])
                else:
                    i += 1
            rows.append(row)
        return rows

    def fold(p: Page):
        b = edges(p)
        out = [(i, n, k) for n, row in enumerate(peel(b)) for k, i in enumerate(sorted(row, key=lambda i: (b[i, 0], i)))]
        at, row, place = zip(*out, strict=True)
        return at, {"row": row, "place": place}

    return by_page(objects, fold, [F.desc("y1"), "obj_id"], row="int", place="int")


def _gap(lo: np.ndarray, hi: np.ndarray) -> float | None:
    """Middle of the first empty stretch between intervals, in the order of ``lo``."""
    order = np.argsort(lo, kind="stable")
    end = np.maximum.accumulate(hi[order])[:-1]
    free = np.flatnonzero(lo[order][1:] >= end)
    return float(lo[order][1:][free[0]] + end[free[0]]) / 2 if len(free) else None


def cut_order(b: np.ndarray) -> list[int]:
    """Reading order by cuts: columns where an empty strip goes from top to bottom, else the first
    empty strip across, what it touches counting as above."""
    out: list[int] = []
    stack = [np.arange(len(b))]
    while stack:
        i = stack.pop()
        if len(i) < 2:
            out += i.tolist()
            continue
        x = _gap(b[i, 0], b[i, 2])
        if x is not None:
            left, right = i[b[i, 2] <= x], i[b[i, 0] >= x]
            if len(left) + len(right) == len(i) and len(left) and len(right):
                stack += [right, left]
                continue
        y = _gap(-b[i, 3], -b[i, 1])
        if y is not None:
            below = i[b[i, 3] <= -y]
            if 0 < len(below) < len(i):
                stack += [below, np.setdiff1d(i, below, assume_unique=True)]
                continue
        out += i.tolist()
    return out


def _short_gap(spans: list[tuple[float, float]]) -> float | None:
    """``_gap`` of a few intervals without arrays."""
    spans.sort(key=itemgetter(0))
    end = spans[0][1]
    for lo, hi in spans[1:]:
        if lo >= end:
            return (lo + end) / 2
        if hi > end:
            end = hi
    return None


def short_cut_order(b: list[list[float]]) -> list[int]:
    """``cut_order`` of a few boxes, for which arrays cost more than they save."""
    out: list[int] = []
    stack = [list(range(len(b)))]
    while stack:
        i = stack.pop()
        if len(i) > 1:
            x = _short_gap([(b[k][0], b[k][2]) for k in i])
            if x is not None:
                left, right = [k for k in i if b[k][2] <= x], [k for k in i if b[k][0] >= x]
                if left and right and len(left) + len(right) == len(i):
                    stack += [right, left]
                    continue
            y = _short_gap([(-b[k][3], -b[k][1]) for k in i])
            if y is not None:
                below = [k for k in i if b[k][3] <= -y]
                if 0 < len(below) < len(i):
                    stack += [below, [k for k in i if b[k][3] > -y]]
                    continue
        out += i
    return out


def xy_cut(objects: DataFrame) -> DataFrame:
    """page_id, obj_id, place in reading order."""

    def fold(p: Page):
        order = cut_order(edges(p))
        return order, {"place": range(len(order))}

    def together(p: Page):
        b = edges(p)
        cut = cut_order if np.isnan(b).any() else short_cut_order
        order = np.array([cut(page) for page in (b if cut is cut_order else b.tolist())])
        place = np.empty(order.shape, np.int64)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        return np.ones(order.shape, bool), {"place": place}

    return by_page(objects, fold, ["obj_id"], together=together, place="int")


def two_columns(objects: DataFrame, page_width: float) -> DataFrame:
    """page_id, obj_id, place: between objects that span the middle, left column before right. (SRT-04)

    Windows by page: an object's part is the number of spanning ones above it, which end their part.
    """
    middle = page_width / 2
    side = F.when(F.col("x1") <= middle, 0).when(F.col("x0") >= middle, 1).otherwise(2)
    down = W.partitionBy("page_id").orderBy(F.desc("y1"), "obj_id")
    part = F.coalesce(F.sum((F.col("__side") == 2).cast("int")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = objects.withColumn("__side", side).withColumn("__part", part)
    place = F.row_number().over(W.partitionBy("page_id").orderBy("__part", "__side", F.desc("y1"), "obj_id")) - 1
    return marked.select("page_id", "obj_id", place.alias("place"))


def merge_regions(regions: DataFrame) -> DataFrame:
    """page_id, x0, y0, x1, y1: in order, a region joins the first earlier one that it touches or
    whose band (y within 3) it shares; one pass."""

    def fold(p: Page):
        done: list[list[float]] = []
        for r in edges(p).tolist():
            for m in done:
                touch = max(m[0], r[0]) <= min(m[2], r[2]) and max(m[1], r[1]) <= min(m[3], r[3])
                if touch or abs(m[1] - r[1]) <= 3 and abs(m[3] - r[3]) <= 3:
                    m[:] = [min(m[0], r[0]), min(m[1], r[1]), max(m[2], r[2]), max(m[3], r[3])]
                    break
            else:
                done.append(r)
        return [0] * len(done), dict(zip(EDGES, zip(*done, strict=True), strict=True))

    return by_page(regions, fold, ["obj_id"], keeps=["page_id"], **dict.fromkeys(EDGES, "double"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def without_duplicates(blocks: DataFrame, color: Sequence[str], near: float = 18, union: float = 0.86, small: float = 0.82) -> DataFrame:
    """page_id, obj_id that stay: from the largest down, a block goes if a kept one of nearly its colour
    covers nearly its place. (AGG-23)"""

    def fold(p: Page):
        b, kept = edges(p), []
        colors = np.stack([p[c] for c in color], 1).astype(float)
        for i in range(len(b)):
            k = [j for j in kept if _apart(colors[i], colors[j]) <= near]
            if not k or not ((_overlap(b[i], b[k], "union") >= union) | (_overlap(b[i], b[k], "small") >= small)).any():
                kept.append(i)
        return kept, {}

    def together(p: Page):
        b, colors = edges(p), np.stack([p[c] for c in color], -1).astype(float)
        kept = np.ones(b.shape[:2], bool)
        for i in range(1, b.shape[1]):
            own, before = b[:, i : i + 1], b[:, :i]
            covers = (_overlap(own, before, "union") >= union) | (_overlap(own, before, "small") >= small)
            kept[:, i] = ~(kept[:, :i] & (_apart(colors[:, i : i + 1], colors[:, :i]) <= near) & covers).any(1)
        return kept, {}

    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return by_page(blocks, fold, [F.desc(size), "y0", "x0", "y1", "x1", "obj_id"], color, together=together)


def line_order(objects: DataFrame, within: float = 10) -> DataFrame:
    """page_id, obj_id, place: from the smallest y, then x; an object moves before those ahead of it that
    stand less than a distance away in y and further right. (SRT-07)"""

    def fold(p: Page):
        x, y, order = p["x0"].tolist(), p["y0"].tolist(), []
        for i in range(len(x)):
            at = len(order)
            while at and abs(y[i] - y[order[at - 1]]) < within and x[i] < x[order[at - 1]]:
                at -= 1
            order.insert(at, i)
        return order, {"place": range(len(order))}

    return by_page(objects, fold, ["y0", "x0", "obj_id"], place="int")


def rect_lines(rects: DataFrame, within: float = 1, gap: float = 3, least: float = 5) -> DataFrame:
    """page_id, y, x0, x1: flat rectangles (page_id, obj_id, x0, x1, c: the middle of their height) as lines.

    Those within a distance of a group's first one are a line, which ends at gaps; short ones go. Rectangles
    without an edge or a middle are none. (TAB-25)
    """

    def fold(p: Page):
        lines: list[tuple[float, list]] = []
        for c, *span in zip(p["c"].tolist(), p["x0"].tolist(), p["x1"].tolist(), strict=True):
            if not lines or c - lines[-1][0] > within:
                lines.append((c, []))
            lines[-1][1].append(span)
        out = []
        for y, spans in lines:
            joined: list[list] = []
            for lo, hi in sorted(spans):
                if joined and lo <= joined[-1][1] + gap:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            out += [(y, lo, hi) for lo, hi in joined if hi - lo >= least]
        return [0] * len(out), {n: [o[i] for o in out] for i, n in enumerate(("y", "x0", "x1"))}

    kinds = dict(rects.dtypes)
    whole = rects.dropna(subset=["c", "x0", "x1"])
    return fold_groups(whole, "page_id", ["c", "x0", "obj_id"], ["c", "x0", "x1"], ["page_id"], fold, {"y": kinds["c"], "x0": kinds["x0"], "x1": kinds["x1"]})


def line_grid(lines: DataFrame) -> DataFrame:
    """page_id, row, col, row_span, col_span, x0, y0, x1, y1 of the cells that ruling lines bound.

    ``lines`` are axis-parallel (x0, y0, x1, y1). A cell starts at a crossing that opens to the
    right and down, and reaches to the next line through in each direction.
    """

    def fold(p: Page):
        b = edges(p)
        h, v = b[b[:, 1] == b[:, 3]], b[b[:, 0] == b[:, 2]]
        xs, ys = sorted(set(v[:, 0])), sorted(set(h[:, 1]), reverse=True)
        out = []
        covers_h = lambda y, a, c: bool(((h[:, 1] == y) & (h[:, 0] <= a) & (h[:, 2] >= c)).any())
        covers_v = lambda x, a, c: bool(((v[:, 0] == x) & (v[:, 1] <= a) & (v[:, 3] >= c)).any())
        for r in range(len(ys) - 1):
            for c in range(len(xs) - 1):
                if not (covers_h(ys[r], xs[c], xs[c + 1]) and covers_v(xs[c], ys[r + 1], ys[r])):
                    continue
                right = next((k for k in range(c + 1, len(xs)) if covers_v(xs[k], ys[r + 1], ys[r])), None)
                down = next((k for k in range(r + 1, len(ys)) if covers_h(ys[k], xs[c], xs[c + 1])), None)
                if right is not None and down is not None:
                    out.append((r, c, down - r, right - c, xs[c], ys[down], xs[right], ys[r]))
        return [0] * len(out), dict(zip(names, zip(*out, strict=True), strict=False))

    names = ["row", "col", "row_span", "col_span", *EDGES]
    return by_page(lines, fold, EDGES, keeps=["page_id"], **{n: "double" if n in EDGES else "int" for n in names})


def without_contained(objects: DataFrame, ratio: float = 0.7) -> DataFrame:
    """page_id, obj_id that stay: from the largest down, an object goes if a kept one holds a share of it."""

    def fold(p: Page):
        b, kept = edges(p), []
        for i in range(len(b)):
            area = (b[i, 2] - b[i, 0]) * (b[i, 3] - b[i, 1])
            k = b[kept]
            w = np.minimum(b[i, 2], k[:, 2]) - np.maximum(b[i, 0], k[:, 0])
            h = np.minimum(b[i, 3], k[:, 3]) - np.maximum(b[i, 1], k[:, 1])
            if not ((np.maximum(0, w) * np.maximum(0, h)) >= ratio * max(area, 1e-9)).any():
                kept.append(i)
        return kept, {}

    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return by_page(objects, fold, [F.desc(size), "obj_id"])


def resolved_slots(cells: DataFrame) -> DataFrame:
    """table_id, row, col, row_span, col_span of cells placed in order: one that finds slots taken
    shrinks to the largest free rectangle at its corner, or goes."""

    def fold(t: Page):
        taken: set[tuple[int, int]] = set()
        at, out = [], []
        for i, (r, c, rs, cs) in enumerate(zip(*(t[n].tolist() for n in names), strict=True)):
            best, width = (0, 0, 0), cs
            for h in range(1, rs + 1):
                free = next((k for k in range(width) if (r + h - 1, c + k) in taken), width)
                width = min(width, free)
                if not width:
                    break
                best = max(best, (h * width, h, width))
            if best[0]:
                taken |= {(r + i, c + j) for i in range(best[1]) for j in range(best[2])}
                at.append(i)
                out.append(best[1:])
        return at, {"rows": [h for h, _ in out], "cols": [w for _, w in out]}

    names = ["row", "col", "row_span", "col_span"]
    return fold_groups(cells, "table_id", ["row", "col"], names, ["table_id", "row", "col"], fold, {"rows": "int", "cols": "int"}).withColumnsRenamed({"rows": "row_span", "cols": "col_span"})
