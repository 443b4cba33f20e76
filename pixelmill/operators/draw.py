"""Drawing, blending and compositing: predicates, span literals and joins on coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pixelmill.errors import RangeError
from pixelmill.functions.color import check
from pixelmill.operators import geometry as G
from pixelmill.relation import Pixels, clamp, num

BLENDS = ("normal", "replace", "multiply", "screen", "overlay", "darken", "lighten", "difference", "exclusion", "hard_light", "soft_light", "add", "subtract")


def over255(p: Pixels, e: str) -> str:
    return p.div(f"{e} + 127", "255")


def blend_channel(p: Pixels, mode: str, s: str, d: str) -> str:
    """A mode of two samples, source and destination, both opaque."""
    if mode in ("normal", "replace"):
        return s
    if mode == "multiply":
        return over255(p, f"{s} * {d}")
    if mode == "screen":
        return f"({s} + {d} - {over255(p, f'{s} * {d}')})"
    if mode == "overlay":
        return blend_channel(p, "hard_light", d, s)
    if mode == "darken":
        return f"least({s}, {d})"
    if mode == "lighten":
        return f"greatest({s}, {d})"
    if mode == "difference":
        return f"abs({s} - {d})"
    if mode == "exclusion":
        return f"({s} + {d} - {over255(p, f'2 * {s} * {d}')})"
    if mode == "hard_light":
        return f"(CASE WHEN {s} < 128 THEN {over255(p, f'2 * {s} * {d}')} ELSE 255 - {over255(p, f'2 * (255 - {s}) * (255 - {d})')} END)"
    if mode == "soft_light":
        t, k = f"({d} / 255e0)", f"(2e0 * {s} / 255e0 - 1e0)"
        root = f"(CASE WHEN 4 * {d} <= 255 THEN ((16e0 * {t} - 12e0) * {t} + 4e0) * {t} ELSE sqrt({t}) END)"
        toward = f"(CASE WHEN 2 * {s} <= 255 THEN {t} * (1e0 - {t}) ELSE {root} - {t} END)"
        return p.round8(f"255e0 * ({t} + {k} * {toward})")
    if mode == "add":
        return f"least(255, {s} + {d})"
    if mode == "subtract":
        return f"greatest(0, {d} - {s})"
    raise RangeError(mode)


def over(p: Pixels, mode: str, src: Sequence[str], dst: Sequence[str]) -> list[str]:
    """Four expressions: a source pixel over a destination pixel, unmultiplied, both with alpha.

    A clear source leaves the destination as it is, in every mode.  The colours' divisor is the rounded result alpha.
    """
    sa, da = src[3], dst[3]
    alpha = over255(p, f"{sa} * 255 + {da} * (255 - {sa})")
    out = []
    for s, d in zip(src[:3], dst[:3], strict=True):
        total = f"{sa} * (255 - {da}) * {s} + {sa} * {da} * {blend_channel(p, mode, s, d)} + (255 - {sa}) * {da} * {d}"
        out.append(clamp(p.div(f"{total} + {p.div(f'255 * {alpha}', '2')}", f"255 * {alpha}")))
    done = list(src) if mode == "replace" else [*out, alpha]
    return done if sa.isdigit() and int(sa) else [f"(CASE WHEN {sa} <= 0 THEN {d} ELSE {e} END)" for e, d in zip(done, dst, strict=True)]


def paint(p: Pixels, inside: str, color: Sequence[int], mode: str = "normal") -> Pixels:
    """Blend one colour into the pixels that a predicate names."""
    src = [f"{v}" for v in (*color, 255)[:4]]
    if src[3] == "0":
        return p
    if mode == "normal" and src[3] == "255":
        mode = "replace"
    done = over(p, mode, src, ("r", "g", "b", "a"))
    return p.select(*(f"CASE WHEN {inside} THEN {p.big(e)} ELSE {c} END" for e, c in zip(done, ("r", "g", "b", "a"), strict=True)))


def strokes(p: Pixels, rows: G.Spans, color: Sequence[int], mode: str = "normal") -> Pixels:
    """Blend a colour into spans of rows; a pixel in several spans is blended as often, which shows unless it is replaced."""
    tests = G.span_tests(rows)
    once = (*color, 255)[3] == 255 and mode in ("normal", "replace")
    for test in tests[:1] if once else tests:
        p = paint(p, test, color, mode)
    return p


def fill_rectangle(p: Pixels, x: int, y: int, w: int, h: int, color: Sequence[int], mode: str = "normal") -> Pixels:
    return paint(p, f"x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h}", color, mode)


def rectangle(p: Pixels, x: int, y: int, w: int, h: int, color: Sequence[int]) -> Pixels:
    edge = f"(x = {x} OR x = {x + w - 1} OR y = {y} OR y = {y + h - 1})"
    return paint(p, f"x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h} AND {edge}", color)


def hline(p: Pixels, x1: int, y: int, x2: int, color: Sequence[int]) -> Pixels:
    return paint(p, f"y = {y} AND x BETWEEN {min(x1, x2)} AND {max(x1, x2)}", color)


def vline(p: Pixels, x: int, y1: int, y2: int, color: Sequence[int]) -> Pixels:
    return paint(p, f"x = {x} AND y BETWEEN {min(y1, y2)} AND {max(y1, y2)}", color)


def fill_rounded_rectangle(p: Pixels, x: int, y: int, w: int, h: int, radius: int, color: Sequence[int], mode: str = "normal") -> Pixels:
    return paint(p, G.rounded_test(p, x, y, w, h, radius), color, mode)


def line_points(x1: int, y1: int, x2: int, y2: int) -> list[tuple[int, int]]:
    """Integer points of a line by accumulated error along the longer axis."""
    dx, dy = abs(x2 - x1), -abs(y2 - y1)
    sx, sy, err, out = (1 if x1 < x2 else -1), (1 if y1 < y2 else -1), dx + dy, []
    while True:
        out.append((x1, y1))
        if (x1, y1) == (x2, y2):
            return out
        twice = 2 * err
        if twice > dy:
            err, x1 = err + dy, x1 + sx
        if twice < dx:
            err, y1 = err + dx, y1 + sy


def point_spans(points: Sequence[tuple[int, int]]) -> G.Spans:
    rows: G.Spans = {}
    for x, y in points:
        rows.setdefault(y, []).append((x, x))
    return rows


def segment_test(x1: float, y1: float, x2: float, y2: float, thickness: float) -> str:
    """Whether a pixel is at most half a thickness from a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = f"least(1e0, greatest(0e0, ((x - {num(x1)}) * {num(dx)} + (y - {num(y1)}) * {num(dy)}) / {num(length)}))" if length else "0e0"
    ex, ey = f"(x - ({num(x1)} + {t} * {num(dx)}))", f"(y - ({num(y1)} + {t} * {num(dy)}))"
    return f"({ex} * {ex} + {ey} * {ey} <= {num(thickness * thickness / 4)})"


def draw_line(p: Pixels, x1: int, y1: int, x2: int, y2: int, thickness: int, color: Sequence[int]) -> Pixels:
    if thickness <= 1:
        return strokes(p, point_spans(line_points(x1, y1, x2, y2)), color)
    return paint(p, segment_test(x1, y1, x2, y2, thickness), color)


def polygon(p: Pixels, xs: Sequence[int], ys: Sequence[int], color: Sequence[int]) -> Pixels:
    """A closed outline, edge by edge, so a vertex is painted by both of its edges."""
    check(len(xs) == len(ys) >= 2, "polygon")
    points = [pt for i in range(len(xs)) for pt in line_points(xs[i], ys[i], xs[(i + 1) % len(xs)], ys[(i + 1) % len(ys)])]
    return strokes(p, point_spans(points), color)


def fill_polygon(p: Pixels, xs: Sequence[int], ys: Sequence[int], color: Sequence[int], rule: str = "even_odd", mode: str = "normal") -> Pixels:
    """Vertices name pixels, so the path runs through their middles."""
    return strokes(p, G.polygon_spans([x + 0.5 for x in xs], [y + 0.5 for y in ys], p.height, rule), color, mode)


def fill_ellipse(p: Pixels, cx: int, cy: int, rx: int, ry: int, color: Sequence[int]) -> Pixels:
    return paint(p, G.ellipse_test(cx, cy, rx, ry), color)


def fill_circle(p: Pixels, cx: int, cy: int, r: int, color: Sequence[int]) -> Pixels:
    return fill_ellipse(p, cx, cy, r, r, color)


def outline_spans(cx: int, cy: int, rx: int, ry: int) -> G.Spans:
    """In each row of the filled set the places that have a neighbour outside it, from either side."""
    half = {dy: int(rx * math.sqrt(max(0.0, 1 - (dy / ry) ** 2))) for dy in range(-ry, ry + 1)}
    rows: G.Spans = {}
    for dy, w in half.items():
        inner = min(half.get(dy - 1, -1), half.get(dy + 1, -1), w - 1)
        rows[cy + dy] = [(cx - w, cx - inner - 1), (cx + inner + 1, cx + w)]
    return rows


def draw_ellipse(p: Pixels, cx: int, cy: int, rx: int, ry: int, color: Sequence[int]) -> Pixels:
    check(rx > 0 and ry > 0, "radius")
    return strokes(p, outline_spans(cx, cy, rx, ry), color)


def draw_circle(p: Pixels, cx: int, cy: int, r: int, color: Sequence[int]) -> Pixels:
    return draw_ellipse(p, cx, cy, r, r, color)


def _ramp(p: Pixels, t: str, start: Sequence[int], end: Sequence[int]) -> Pixels:
    """Every sample, alpha too, becomes a mixture of two colours."""
    return p.select(*(p.round8(f"{s} + ({e} - {s}) * ({t})") for s, e in zip((*start, 255)[:4], (*end, 255)[:4], strict=True)))


def gradient_linear(p: Pixels, x0: int, y0: int, x1: int, y1: int, start: Sequence[int], end: Sequence[int]) -> Pixels:
    dx, dy = x1 - x0, y1 - y0
    check(dx or dy, "a gradient between equal points")
    return _ramp(p, f"least(1e0, greatest(0e0, ((x - {x0}) * {dx} + (y - {y0}) * {dy}) / {num(dx * dx + dy * dy)}))", start, end)


def gradient_radial(p: Pixels, cx: int, cy: int, radius: int, inner: Sequence[int], outer: Sequence[int]) -> Pixels:
    check(radius > 0, "radius")
    return _ramp(p, f"least(1e0, sqrt(((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy})) * 1e0) / {num(radius)})", inner, outer)


def gradient_fade(p: Pixels, angle: float, start: float, end: float) -> Pixels:
    """Alpha falls from full to none along an angle, between two fractions of the way from the first corner to the last."""
    check(0 <= start < end <= 1, "fade")
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    extent = abs(c) * p.width + abs(s) * p.height - 1
    check(extent > 0, "fade")
    corner = (abs(c) * (p.width - 1) if c < 0 else 0.0) + (abs(s) * (p.height - 1) if s < 0 else 0.0)
    along = f"((x * {num(c)} + y * {num(s)} + {num(corner)}) / {num(extent)})"
    keep = f"(1e0 - least(1e0, greatest(0e0, ({along} - {num(start)}) / {num(end - start)})))"
    return p.select(a=p.round8(f"a * {keep}"), channels=4)


def coverage(p: Pixels, mask: str, x: int, y: int, color: Sequence[int], mode: str = "normal") -> Pixels:
    """Blend a colour through a mask relation (y, x, v) of 8-bit coverage that is placed at (x, y)."""
    alpha = p.div(f"m.v * {(*color, 255)[3]}", "255")
    sql = f"(SELECT t.*, coalesce({alpha}, 0) AS cover FROM ({p.sql}) t LEFT JOIN {mask} ON m.y + {y} = t.y AND m.x + {x} = t.x)"
    done = over(p, mode, [*(str(v) for v in color[:3]), "cover"], ("r", "g", "b", "a"))
    return p.of("SELECT image_id, y, x, " + ", ".join(f"{p.big(e)} AS {c}" for e, c in zip(done, ("r", "g", "b", "a"), strict=True)) + f" FROM {sql} u")


def composite(p: Pixels, src: Pixels, mode: str = "normal", x: int = 0, y: int = 0, opacity: float = 1.0, draw: str = "once") -> Pixels:
    """Another relation's images over this one's with the same image_id: once at (x, y), tiled, or centred."""
    check(mode in BLENDS and 0 <= opacity <= 1 and draw in ("once", "tile", "center"), "composite")
    if draw == "center":
        x, y = int((p.width - src.width) / 2), int((p.height - src.height) / 2)
    ky, kx = (f"(t.y - {y})", f"(t.x - {x})")
    if draw == "tile":
        ky, kx = (f"((({k}) % {n} + {n}) % {n})" for k, n in ((ky, src.height), (kx, src.width)))
    k = int(opacity * 255 + 0.5)
    names = ", ".join(f"s.{c} AS s{c}" for c in "rgb") + f", coalesce({p.div(f's.a * {k}', '255')}, 0) AS sa"
    joined = f"(SELECT t.*, {names} FROM ({p.sql}) t LEFT JOIN ({src.sql}) s ON s.image_id = t.image_id AND s.y = {ky} AND s.x = {kx})"
    done = over(p, mode, ["sr", "sg", "sb", "sa"], ("r", "g", "b", "a"))
    body = ", ".join(f"{p.big(e)} AS {c}" for e, c in zip(done, ("r", "g", "b", "a"), strict=True))
    return p.of(f"SELECT image_id, y, x, {body} FROM {joined} u")
