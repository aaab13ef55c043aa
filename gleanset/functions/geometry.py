"""Rectangles as columns: overlaps, distances and the derived boxes of cards, titles and bands."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanset.functions.text import let

CARD_ASPECT = 88 / 63


class Rect(NamedTuple):
    x: Column
    y: Column
    width: Column
    height: Column

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height

    @property
    def center_x(self) -> Column:
        return self.x + self.width / 2

    @property
    def center_y(self) -> Column:
        return self.y + self.height / 2

    def struct(self) -> Column:
        return F.struct(self.x.cast("double").alias("x"), self.y.cast("double").alias("y"), self.width.cast("double").alias("width"), self.height.cast("double").alias("height"))


def rect(alias: str = "") -> Rect:
    """The columns x, y, width and height, of an alias or struct column if one is named."""
    p = f"{alias}." if alias else ""
    return Rect(*(F.col(f"{p}{c}") for c in ("x", "y", "width", "height")))


def of(column: Column) -> Rect:
    return Rect(*(column[c] for c in ("x", "y", "width", "height")))


def _shared(a: Rect, b: Rect) -> tuple[Column, Column]:
    return F.least(a.right, b.right) - F.greatest(a.x, b.x), F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)


def iou(a: Rect, b: Rect) -> Column:
    w, h = _shared(a, b)
    union = a.width * a.height + b.width * b.height - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(w * h / union)


def overlaps(a: Rect, b: Rect) -> Column:
    w, h = _shared(a, b)
    return (w > 0) & (h > 0)


def horizontal_overlap(a: Rect, b: Rect) -> Column:
    w, _ = _shared(a, b)
    return F.when(w <= 0, 0.0).otherwise(w / F.greatest(F.lit(1), F.least(a.width, b.width)))


def in_band(box: Rect, band: Rect) -> Column:
    return (horizontal_overlap(box, band) > 0.35) & box.center_y.between(band.y, band.bottom)


def clip(r: Rect, width: Column, height: Column) -> Rect:
    """Edges rounded and kept on the canvas; at least one pixel each way."""
    x, y = (F.greatest(F.lit(0), F.floor(v + 0.5)) for v in (r.x, r.y))
    right, bottom = F.least(width, F.floor(r.right + 0.5)), F.least(height, F.floor(r.bottom + 0.5))
    return Rect(x, y, F.greatest(F.lit(1), right - x), F.greatest(F.lit(1), bottom - y))


def clip_pixels(r: Rect, width: Column, height: Column) -> Rect:
    """Edges rounded and kept on the canvas; nothing is left of a box outside it. Without a canvas (null) the box itself."""
    on = lambda v, low, high: F.greatest(low, F.least(high, F.floor(v + 0.5)))
    x, y = on(r.x, F.lit(0), width), on(r.y, F.lit(0), height)
    clipped = Rect(x, y, on(r.right, x, width) - x, on(r.bottom, y, height) - y)
    known = width.isNotNull() & height.isNotNull()
    return Rect(*(F.when(known, c.cast("double")).otherwise(o) for c, o in zip(clipped, r)))


def expand(r: Rect, width: Column, height: Column, x_ratio: float, y_ratio: float) -> Rect:
    px, py = r.width * x_ratio, r.height * y_ratio
    return clip(Rect(r.x - px, r.y - py, r.width + px * 2, r.height + py * 2), width, height)


def card_body(title: Rect) -> Rect:
    height = F.greatest(title.height / 0.055, title.width * 1.8, F.lit(80.0))
    width = F.greatest(title.width / 0.55, height / CARD_ASPECT)
    return Rect(title.x - width * 0.12, title.y - height * 0.03, width, height)


def art_rect(body: Rect, title: Rect) -> Rect:
    y = F.greatest(body.y, title.bottom)
    return Rect(body.x, y, body.width, F.greatest(F.lit(24.0), body.bottom - y) * 0.92)


def die_search(art: Rect) -> Rect:
    return Rect(art.x - art.width * 0.08, art.y - art.height * 0.05, art.width * 1.16, art.height * 1.1)


def center_distance(a: Rect, b: Rect) -> Column:
    return F.hypot(a.center_x - b.center_x, a.center_y - b.center_y)


def die_center_score(face: Rect, center_x: Column, center_y: Column) -> Column:
    return F.coalesce(1 / (1 + F.hypot(face.center_x - center_x, face.center_y - center_y) / 40), F.lit(0.5))


def band_crop_scale(r: Rect) -> Column:
    """Upscaled to 480 by 36, at most 1600 a side and 240,000 pixels."""
    scale = F.least(F.greatest(F.lit(1.0), 480 / r.width, 36 / r.height), 1600 / r.width, 1600 / r.height)
    pixels = r.width * r.height
    return F.when((pixels > 0) & (pixels * scale * scale > 240000), F.sqrt(240000 / pixels)).otherwise(scale)


def title_band(center_x: Column, column_width: Column, y: Column, height: Column) -> Rect:
    width = F.greatest(F.lit(72.0), column_width)
    return Rect(center_x - width / 2, y - F.greatest(F.lit(6.0), height * 0.45), width, F.greatest(height * 2.2, F.lit(36 * 0.55)))


def title_band_at(center_x: Column, width: Column, y: Column, height: Column) -> Rect:
    w = F.greatest(F.lit(48.0), width * 1.15)
    return Rect(center_x - w / 2, y - height * 0.35, w, F.greatest(height * 2.2, F.lit(24.0)))


def land_row_strip(width: Column, height: Column) -> Rect:
    return Rect(F.lit(0.0), height * 0.665, width, F.greatest(F.lit(36.0), height * 0.09))


def normalized(r: Rect, width: Column, height: Column) -> Rect:
    w, h = (F.greatest(F.lit(1), v) for v in (width, height))
    return Rect(r.x / w, r.y / h, r.width / w, r.height / h)


def denormalized(r: Rect, width: Column, height: Column) -> Rect:
    return Rect(r.x * width, r.y * height, r.width * width, r.height * height)


def bounding_box(polygon: Column) -> Rect:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def to_polygon(r: Rect) -> Column:
    corners = ((r.x, r.y), (r.right, r.y), (r.right, r.bottom), (r.x, r.bottom))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def map_to_canvas(polygon: Column, crop: Rect, scale: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((crop.x + p["x"] / scale).alias("x"), (crop.y + p["y"] / scale).alias("y")))


def polygon_angle(polygon: Column, box: Rect) -> Column:
    """Degrees of the longest edge, the first such, folded to -90..90; 0 for flat boxes."""
    flat = (box.height > 0) & (box.height <= 24) & (box.width / box.height >= 2.5)
    return F.when((F.size(polygon) == 0) | flat, 0.0).otherwise(let(polygon, _longest_edge_angle))


def box_angle(box: Rect) -> Column:
    """polygon_angle() of a box's own corners: 0, or upright if it is taller than wide. Only odd numbers need the list of edges."""
    flat = (box.height > 0) & (box.height <= 24) & (box.width / box.height >= 2.5)
    ends = [c.cast("double") for c in (box.x, box.right, box.y, box.bottom)]
    dx, dy = ends[1] - ends[0], ends[3] - ends[2]
    finite = F.coalesce(reduce(Column.__add__, [c * 0 for c in ends]) == 0, F.lit(False))
    level = F.abs(dx) >= F.abs(dy)
    return F.when(flat | finite & level, 0.0).when(finite, F.degrees(F.atan2(dy, F.lit(0.0)))).otherwise(polygon_angle(to_polygon(box), box))


def _longest_edge_angle(polygon: Column) -> Column:
    # Each part is computed once, however often the next one names it.
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: let(F.element_at(polygon, (i + 1) % n + 1), lambda q: F.struct((q["y"] - p["y"]).alias("dy"), (q["x"] - p["x"]).alias("dx"))))
    sized = F.transform(edges, lambda e, i: F.struct(F.hypot(e["dx"], e["dy"]).alias("length"), (-i).alias("order"), e["dy"].alias("dy"), e["dx"].alias("dx")))
    angle = let(F.array_max(sized), lambda longest: F.degrees(F.atan2(longest["dy"], longest["dx"])))
    return let(angle, lambda a: F.when(a > 90, a - 180).when(a < -90, a + 180).otherwise(a))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b + 0.5)


def is_die_pixel(r: Column, g: Column, b: Column) -> Column:
    """Saturated, bright or dark."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    sat = F.when(top == 0, 0.0).otherwise((top - low) / top)
    return F.when((sat > 0.45) & (top > 90), True).when((top > 170) & (sat < 0.28), True).otherwise((top < 55) & (sat < 0.35))
