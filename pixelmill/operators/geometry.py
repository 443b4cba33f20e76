"""Geometry: crops, mirrors, turns, masks, borders, canvases, trim; each a filter and a projection, trim with two aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pixelmill.errors import BoundsError
from pixelmill.functions.color import check
from pixelmill.relation import CHANNELS, Pixels


#: First and last x of spans by row.
Spans = dict[int, list[tuple[int, int]]]


def crop(p: Pixels, x: int, y: int, width: int = 0, height: int = 0) -> Pixels:
    """A rectangle; an extent of 0 reaches to the edge, one past the edge is cut."""
    if x >= p.width or y >= p.height:
        raise BoundsError("crop begins past the edge")
    w, h = min(width or p.width, p.width - x), min(height or p.height, p.height - y)
    return p.select(y=f"(y - {y})", x=f"(x - {x})", where=f"x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h}", width=w, height=h)


def flip_horizontal(p: Pixels) -> Pixels:
    return p.select(x=f"({p.width - 1} - x)")


def flip_vertical(p: Pixels) -> Pixels:
    return p.select(y=f"({p.height - 1} - y)")


def rotate90(p: Pixels) -> Pixels:
    """A quarter turn clockwise."""
    return p.select(y="x", x=f"({p.height - 1} - y)", width=p.height, height=p.width)


def rotate180(p: Pixels) -> Pixels:
    return p.select(y=f"({p.height - 1} - y)", x=f"({p.width - 1} - x)")


def rotate270(p: Pixels) -> Pixels:
    return p.select(y=f"({p.width - 1} - x)", x="y", width=p.height, height=p.width)


def orient(p: Pixels, exif: int) -> Pixels:
    """Undo an EXIF orientation of 1 to 8; others leave the image."""
    steps = {2: [flip_horizontal], 3: [rotate180], 4: [flip_vertical], 5: [rotate90, flip_horizontal], 6: [rotate90], 7: [rotate270, flip_horizontal], 8: [rotate270]}
    for step in steps.get(exif, []):
        p = step(p)
    return p


def grid(p: Pixels, width: int, height: int) -> str:
    """image_id, y, x of a dense canvas for each image."""
    return f"(SELECT image_id, gy.i AS y, gx.i AS x FROM (SELECT DISTINCT image_id FROM ({p.sql}) t) ids CROSS JOIN {p.series(height, 'gy')} CROSS JOIN {p.series(width, 'gx')})"


def place(p: Pixels, width: int, height: int, left: int, top: int, fill: Sequence[int]) -> Pixels:
    """The image at (left, top) of a canvas of another extent; the rest gets a colour."""
    body = ", ".join(f"coalesce(t.{c}, {v}) AS {c}" for c, v in zip(CHANNELS, fill, strict=True))
    sql = f"SELECT g.image_id, g.y, g.x, {body} FROM {grid(p, width, height)} g LEFT JOIN ({p.sql}) t ON t.image_id = g.image_id AND t.y = g.y - {top} AND t.x = g.x - {left}"
    return p.of(sql, width=width, height=height)


def expand(p: Pixels, left: int, top: int, right: int, bottom: int, fill: Sequence[int] = (0, 0, 0, 255)) -> Pixels:
    return place(p, p.width + left + right, p.height + top + bottom, left, top, fill)


def border(p: Pixels, width: int, color: Sequence[int]) -> Pixels:
    """Nested one-pixel frames, drawn inward with the colour's alpha."""
    from pixelmill.operators.draw import paint

    return paint(p, f"least(x, y, {p.width - 1} - x, {p.height - 1} - y) < {width}", color)


def keep_inside(p: Pixels, inside: str) -> Pixels:
    """Clear what is outside a shape, colour and alpha."""
    return p.select(*(f"CASE WHEN {inside} THEN {c} ELSE 0 END" for c in CHANNELS), channels=4)


def ellipse_test(cx: int, cy: int, rx: int, ry: int, x: str = "x", y: str = "y") -> str:
    """Row half widths of an ellipse, truncated; literals, one row at a time."""
    rows = [(dy, int(rx * math.sqrt(max(0.0, 1 - (dy / ry) ** 2)))) for dy in range(-ry, ry + 1)]
    return "(CASE " + " ".join(f"WHEN {y} = {cy + dy} THEN abs({x} - {cx}) <= {half}" for dy, half in rows) + " ELSE false END)"


def crop_ellipse(p: Pixels, cx: int, cy: int, rx: int, ry: int) -> Pixels:
    check(rx > 0 and ry > 0, "radius")
    return keep_inside(p, ellipse_test(cx, cy, rx, ry))


def crop_circle(p: Pixels, cx: int, cy: int, radius: int) -> Pixels:
    return crop_ellipse(p, cx, cy, radius, radius)


def crossings(xs: Sequence[float], ys: Sequence[float], height: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each row the x of a polygon's edges at its middle, ascending, with their direction; edges are half open."""
    out = []
    for y in range(height):
        at, row = y + 0.5, []
        for i in range(len(xs)):
            x0, y0, x1, y1 = xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(ys)]
            if (y0 <= at < y1) or (y1 <= at < y0):
                row.append((x0 + (at - y0) * (x1 - x0) / (y1 - y0), 1 if y1 > y0 else -1))
        if row:
            out.append((y, sorted(row, key=lambda r: r[0])))
    return out


def polygon_spans(xs: Sequence[float], ys: Sequence[float], height: int, rule: str = "even_odd") -> Spans:
    """The spans of pixels whose middles a path encloses, row by row; an end on a middle counts on both sides."""
    check(len(xs) == len(ys) >= 3, "polygon")
    rows: Spans = {}
    for y, row in crossings(xs, ys, height):
        count = 0
        for (a, da), (b, _) in zip(row, row[1:], strict=False):
            count += 1 if rule == "even_odd" else da
            first, last = math.ceil(a - 0.5), math.floor(b - 0.5)
            if (count % 2 if rule == "even_odd" else count) and first <= last:
                rows.setdefault(y, []).append((first, last))
    return rows


def span_tests(rows: Spans) -> list[str]:
    """Predicates of the pixels that lie in at least one span of their row, in at least two, and so on; at least one predicate."""
    levels: list[dict[int, list[tuple[int, int]]]] = [{}]
    for y, spans in sorted(rows.items()):
        edges = sorted([(a, 1) for a, b in spans if a <= b] + [(b + 1, -1) for a, b in spans if a <= b])
        depth, opened = 0, {}
        for at, step in edges:  # of edges at one place the ends come first
            if step > 0:
                opened[depth] = at
                depth += 1
                if depth > len(levels):
                    levels.append({})
            else:
                depth -= 1
                if opened[depth] < at:
                    levels[depth].setdefault(y, []).append((opened[depth], at - 1))
    return ["(CASE " + " ".join(f"WHEN y = {y} THEN {' OR '.join(f'x BETWEEN {a} AND {b}' for a, b in spans)}" for y, spans in level.items()) + " ELSE false END)" if level else "false" for level in levels]


def crop_polygon(p: Pixels, xs: Sequence[int], ys: Sequence[int]) -> Pixels:
    return keep_inside(p, span_tests(polygon_spans([x + 0.5 for x in xs], [y + 0.5 for y in ys], p.height))[0])


def rounded_test(p: Pixels, x: int, y: int, width: int, height: int, radius: int) -> str:
    """A rectangle with rounded corners: each row's inset is int(r - sqrt(r^2 - dy^2) + 0.5) from the corner's middle."""
    radius = min(radius, width // 2, height // 2)
    rows = []
    for i in range(height):
        dy = radius - i - 0.5 if i < radius else i + 0.5 - (height - radius) if i >= height - radius else 0.0
        inset = int(radius - math.sqrt(max(0.0, radius * radius - dy * dy)) + 0.5) if dy > 0 else 0
        if inset:
            rows.append(f"WHEN y = {y + i} THEN x >= {x + inset} AND x < {x + width - inset}")
    box = f"x >= {x} AND x < {x + width} AND y >= {y} AND y < {y + height}"
    return f"({box} AND (CASE {' '.join(rows)} ELSE true END))" if rows else f"({box})"


def corner_radius(p: Pixels, radius: int) -> Pixels:
    return keep_inside(p, rounded_test(p, 0, 0, p.width, p.height, radius)) if radius else p


def trim_bounds(p: Pixels, tolerance: int) -> str:
    """image_id, left, top, right, bottom: what remains when lines of the corner's colour are cut off.

    An image whose four corners differ is left alone.  Lines are cut from the left and right, then from the top and
    bottom, over the full extent; at least one column and one row remain.
    """
    w, h = p.width, p.height
    corner = "SELECT image_id, " + ", ".join(f"max(CASE WHEN x = 0 AND y = 0 THEN {c} END) AS {c}0" for c in CHANNELS) + f" FROM ({p.sql}) t GROUP BY image_id"
    near = " AND ".join(f"abs(t.{c} - k.{c}0) <= {tolerance}" for c in CHANNELS)
    flagged = f"(SELECT t.image_id, t.y, t.x, CASE WHEN {near} THEN 0 ELSE 1 END AS odd FROM ({p.sql}) t JOIN ({corner}) k ON k.image_id = t.image_id)"
    odd_corner = f"max(CASE WHEN x IN (0, {w - 1}) AND y IN (0, {h - 1}) THEN odd ELSE 0 END)"
    edges = ", ".join([f"{odd_corner} AS fixed", "min(CASE WHEN odd = 1 THEN x END) AS x0", "max(CASE WHEN odd = 1 THEN x END) AS x1", "min(CASE WHEN odd = 1 THEN y END) AS y0", "max(CASE WHEN odd = 1 THEN y END) AS y1"])
    last = f"CASE WHEN fixed = 1 THEN {{}} ELSE coalesce({{}}, {{}}) END"
    return (
        f"(SELECT image_id, {last.format(0, 'x0', w - 1)} AS l, {last.format(w - 1, 'x1', w - 1)} AS r_, {last.format(0, 'y0', h - 1)} AS t_, {last.format(h - 1, 'y1', h - 1)} AS b_ "
        f"FROM (SELECT image_id, {edges} FROM {flagged} f GROUP BY image_id) e)"
    )


def trim(p: Pixels, tolerance: int = 8) -> Pixels:
    """Cut a uniform border; extents then differ from image to image, width and height are those before."""
    sql = f"SELECT t.image_id, t.y - k.t_ AS y, t.x - k.l AS x, t.r, t.g, t.b, t.a FROM ({p.sql}) t JOIN {trim_bounds(p, tolerance)} k ON k.image_id = t.image_id WHERE t.x BETWEEN k.l AND k.r_ AND t.y BETWEEN k.t_ AND k.b_"
    return p.of(sql)
