"""Boxes, quads and affine matrices as column expressions; the origin is bottom-left.

A box is a struct (x0, y0, x1, y1). Boxes that only touch intersect; a zero extent counts as 1
in the areas that ratios are made of (``area2``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = {"x": ("x0", "x1"), "y": ("y0", "y1")}


def bbox(x0, y0, x1, y1) -> Column:
    """A box with its edges in order."""
    x0, y0, x1, y1 = (F.col(v) if isinstance(v, str) else v for v in (x0, y0, x1, y1))
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def _box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def area2(b: Column) -> Column:
    w, h = width(b), height(b)
    return F.when(w == 0, 1).otherwise(w) * F.when(h == 0, 1).otherwise(h)


def is_h(b: Column) -> Column:
    return width(b) >= height(b)


def is_v(b: Column) -> Column:
    return height(b) > width(b)


def is_valid(b: Column) -> Column:
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return (F.greatest(a["x0"], b["x0"]) <= F.least(a["x1"], b["x1"])) & (F.greatest(a["y0"], b["y0"]) <= F.least(a["y1"], b["y1"]))


def intersect(a: Column, b: Column) -> Column:
    """Null where disjoint."""
    common = _box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(intersects(a, b), common)


def intersection_area2(a: Column, b: Column) -> Column:
    """area2 of the intersection, 0 where disjoint."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w < 0) | (h < 0), 0).otherwise(F.when(w == 0, 1).otherwise(w) * F.when(h == 0, 1).otherwise(h))


def union(a: Column, b: Column) -> Column:
    return _box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    common = intersection_area2(a, b)
    return common / (area2(a) + area2(b) - common)


def contained_ratio(region: Column, obj: Column) -> Column:
    """Share of an object's area that lies in a region; a region without area holds nothing."""
    return F.when(area(region) == 0, 0.0).otherwise(intersection_area2(region, obj) / area2(obj))


def overlap_small(a: Column, b: Column) -> Column:
    """Share of the smaller area2 that is common."""
    return intersection_area2(a, b) / F.least(area2(a), area2(b))


def overlap_ratio(a: Column, b: Column, mode: str = "union") -> Column:
    """Plain overlap (touching is 0) over the union, the small or the large area."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    own, other = area(a), area(b)
    whole = {"small": F.least(own, other), "large": F.greatest(own, other), "union": own + other - w * h}[mode]
    return F.when(whole > 0, w * h / whole).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def contains_point(a: Column, x: Column, y: Column) -> Column:
    return x.between(a["x0"], a["x1"]) & y.between(a["y0"], a["y1"])


def over(axis: str, a: Column, b: Column, d0: float = 0, d1: float = 0, strict: bool = True) -> Column:
    """Whether b passes a on an axis by at least d0 and d1; strict: by no more than either's length."""
    i, j = _EDGES[axis]
    la, lb = a[j] - a[i], b[j] - b[i]
    m0, m1 = F.lit(d0), F.lit(d1)
    if strict:
        m0, m1 = F.least(m0, la, lb), F.least(m1, la, lb)
    return (b[j] - a[i] >= m0) & (a[j] - b[i] >= m1)


def align(axis: str, a: Column, b: Column, d: float = 0) -> Column:
    i, j = _EDGES[axis]
    return (F.abs(a[i] - b[i]) <= d) & (F.abs(a[j] - b[j]) <= d)


def check_length(axis: str, b: Column, low: float | None = None, high: float | None = None) -> Column:
    i, j = _EDGES[axis]
    n = b[j] - b[i]
    return (F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n <= high)


def expand(b: Column, dx: float = 0, dy: float = 0, bound: Column | None = None) -> Column:
    """Grow by dx and dy on each side; an axis that would turn over stays."""
    ok_x, ok_y = width(b) + 2 * dx > 0, height(b) + 2 * dy > 0
    ok_x, ok_y = ok_x | F.lit(dx == 0), ok_y | F.lit(dy == 0)
    out = _box(F.when(ok_x, b["x0"] - dx).otherwise(b["x0"]), F.when(ok_y, b["y0"] - dy).otherwise(b["y0"]), F.when(ok_x, b["x1"] + dx).otherwise(b["x1"]), F.when(ok_y, b["y1"] + dy).otherwise(b["y1"]))
    return out if bound is None else intersect(out, bound)


def adjust(b: Column, bound: Column | None = None, **edges) -> Column:
    """Set edges by name; nothing changes where they would cross."""
    x0, y0, x1, y1 = (F.lit(edges[k]) if k in edges else b[k] for k in ("x0", "y0", "x1", "y1"))
    ok = (x0 <= x1) & (y0 <= y1)
    out = _box(*(F.when(ok, v).otherwise(b[k]) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))
    return out if bound is None else F.when(ok, intersect(out, bound)).otherwise(b)


def split(axis: str, b: Column, weights: Sequence[float]) -> Column:
    """Array of boxes along an axis, as long as their weights."""
    i, j = _EDGES[axis]
    total, at, out = float(sum(weights)), 0.0, []
    for w in weights:
        lo, hi = b[i] + at / total * (b[j] - b[i]), b[i] + (at + w) / total * (b[j] - b[i])
        out.append(_box(lo, b["y0"].cast("double"), hi, b["y1"].cast("double")) if axis == "x" else _box(b["x0"].cast("double"), lo, b["x1"].cast("double"), hi))
        at += w
    return F.array(*out)


def outset(b: Column) -> Column:
    return _box(F.floor(b["x0"]), F.floor(b["y0"]), F.ceil(b["x1"]), F.ceil(b["y1"]))


def rounded(b: Column, digits: int = 1) -> Column:
    """Array of the edges, half to even."""
    return F.array(*(F.bround(b[k].cast("double"), digits) for k in ("x0", "y0", "x1", "y1")))


def union_agg(b: Column) -> Column:
    """Aggregate: the box of all boxes, null for none."""
    edges = F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])
    return F.when(F.count(b) > 0, _box(*edges))


# matrices (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.cast("double").alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)))


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def compose(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def inverse(m: Column) -> Column:
    """An error where the determinant is 0."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    det = F.when(det == 0, F.raise_error(F.lit("the matrix has no inverse")).cast("double")).otherwise(det)
    return matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)


def rotation(degrees: float) -> Column:
    """Clockwise."""
    r = F.radians(F.lit(float(degrees)))
    s, c = F.bround(F.sin(r), 10), F.bround(F.cos(r), 10)
    return matrix(c, -s, s, c, F.lit(0), F.lit(0))


def angle(m: Column) -> Column:
    return F.bround(F.degrees(F.atan2(m["c"], m["a"])), 6)


def transform(b: Column, m: Column) -> Column:
    """The box of a box's corners after a matrix."""
    corners = [apply(m, b[i], b[j]) for i in ("x0", "x1") for j in ("y0", "y1")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return _box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def flip(b: Column, page_height: Column, scale_x: float | Column = 1, scale_y: float | Column = 1) -> Column:
    """Between a top-left and a bottom-left origin, with scaling; its own inverse at scale 1."""
    return _box(b["x0"] * scale_x, (page_height - b["y1"]) * scale_y, b["x1"] * scale_x, (page_height - b["y0"]) * scale_y)


def unletterbox(b: Column, ratio: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Column:
    """Undo a letterbox and clip to the image."""
    x = lambda v: F.least(F.greatest((v - pad_x) / ratio, F.lit(0.0)), w)
    y = lambda v: F.least(F.greatest((v - pad_y) / ratio, F.lit(0.0)), h)
    return _box(x(b["x0"]), y(b["y0"]), x(b["x1"]), y(b["y1"]))


def from_thousandths(b: Column, w: Column, h: Column) -> Column:
    """A top-left box in 0..999 to page coordinates, clipped; null if nothing is left."""
    x = lambda v: F.least(F.greatest(v / 999.0 * w, F.lit(0.0)), w)
    y = lambda v: F.least(F.greatest(h - v / 999.0 * h, F.lit(0.0)), h)
    out = _box(x(b["x0"]), y(b["y1"]), x(b["x1"]), y(b["y0"]))
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


# quads: arrays of four points (x, y), clockwise from the bottom left


def quad(b: Column) -> Column:
    p = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(p("x0", "y0"), p("x0", "y1"), p("x1", "y1"), p("x1", "y0"))


def quad_area(q: Column) -> Column:
    """By the shoelace formula."""
    n = F.size(q)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: q[i]["x"] * q[(i + 1) % n]["y"] - q[(i + 1) % n]["x"] * q[i]["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2


def quad_bbox(q: Column) -> Column:
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return _box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def quad_is_rect(q: Column) -> Column:
    return (q[0]["x"] == q[1]["x"]) & (q[2]["x"] == q[3]["x"]) & (q[0]["y"] == q[3]["y"]) & (q[1]["y"] == q[2]["y"])


def _about(q: Column, move) -> Column:
    """``move`` of each corner and the centre of the quad's box. The centre is found once, not for each use of it."""
    return F.transform(F.array(center(quad_bbox(q))), lambda c: F.transform(q, lambda p: move(p, c)))[0]


def quad_rotate(q: Column, degrees: float, digits: int = 3) -> Column:
    """About the centre of its box."""
    r = F.radians(F.lit(float(degrees)))
    def turn(p, c):
        x, y = p["x"] - c["x"], p["y"] - c["y"]
        return F.struct(F.bround(c["x"] + x * F.cos(r) - y * F.sin(r), digits).alias("x"), F.bround(c["y"] + x * F.sin(r) + y * F.cos(r), digits).alias("y"))
    return _about(q, turn)


def quad_scale(q: Column, sx: float, sy: float) -> Column:
    return _about(q, lambda p, c: F.struct((c["x"] + (p["x"] - c["x"]) * sx).alias("x"), (c["y"] + (p["y"] - c["y"]) * sy).alias("y")))


def quad_angle(q: Column) -> Column:
    """Degrees of the longer of the first two edges."""
    e = lambda i, j: F.hypot(q[j]["x"] - q[i]["x"], q[j]["y"] - q[i]["y"])
    at = lambda i, j: F.degrees(F.atan2(q[j]["y"] - q[i]["y"], q[j]["x"] - q[i]["x"]))
    return F.when(e(0, 3) >= e(0, 1), at(0, 3)).otherwise(at(0, 1))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def quad_split(q: Column, axis: str, weights: Sequence[float]) -> Column:
    """Array of quads along an axis (x: from the first to the second point), as long as their weights. (GEO-24)"""
    total, at, out = float(sum(weights)), 0.0, []
    between = lambda i, j, t: F.struct((q[i]["x"] + (q[j]["x"] - q[i]["x"]) * t).alias("x"), (q[i]["y"] + (q[j]["y"] - q[i]["y"]) * t).alias("y"))
    for w in weights:
        s, t = at / total, (at + w) / total
        out.append(F.array(between(0, 1, s), between(0, 1, t), between(3, 2, t), between(3, 2, s)) if axis == "x" else F.array(between(0, 3, s), between(1, 2, s), between(1, 2, t), between(0, 3, t)))
        at += w
    return F.array(*out)
