"""A symbolic list of shapes under a stack of transforms; it is culled before any pixel is touched and drawn as one query."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pixelmill.errors import PlanError
from pixelmill.functions.color import check
from pixelmill.operators import draw, geometry
from pixelmill.relation import Pixels

MAX_SHAPES, MAX_POINTS, MAX_DEPTH = 64, 256, 8
Affine = tuple[float, float, float, float, float, float]  # x' = a x + b y + e, y' = c x + d y + f


@dataclass(frozen=True)
class Shape:
    kind: str
    geometry: tuple[float, ...]
    color: tuple[int, ...]
    transform: Affine
    blend: str
    rule: str = "even_odd"

    @property
    def upright(self) -> bool:
        return abs(self.transform[1]) < 1e-6 and abs(self.transform[2]) < 1e-6

    def at(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.transform
        return a * x + b * y + e, c * x + d * y + f

    def outline(self) -> list[tuple[float, float]]:
        """Corners, in the shape's own coordinates, whose box bounds it."""
        g = self.geometry
        if self.kind in ("rect", "round_rect"):
            return [(g[0], g[1]), (g[0] + g[2], g[1]), (g[0] + g[2], g[1] + g[3]), (g[0], g[1] + g[3])]
        if self.kind == "ellipse":
            return [(g[0] + sx * g[2], g[1] + sy * g[3]) for sx in (-1, 1) for sy in (-1, 1)]
        if self.kind == "line":
            r = g[4] / 2 + 1
            return [(x, y) for x in (g[0] - r, g[2] + r) for y in (g[1] - r, g[3] + r)]
        return list(zip(g[::2], g[1::2], strict=True))

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(self.at(*p) for p in self.outline()), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def covers(self, box: Sequence[float]) -> bool:
        """Only an upright opaque rectangle is sure to hide all that is under a box."""
        if self.kind != "rect" or self.blend not in ("normal", "replace") or (*self.color, 255)[3] != 255 or not self.upright:
            return False
        x0, y0, x1, y1 = self.bounds()
        return x0 <= box[0] and y0 <= box[1] and x1 >= box[2] and y1 >= box[3]


class DisplayList:
    """Shapes are appended under the current transform and blend; nothing is drawn before :meth:`render`."""

    def __init__(self):
        self.shapes: list[Shape] = []
        self.transform: Affine = (1, 0, 0, 1, 0, 0)
        self.stack: list[Affine] = []
        self.mode, self.culled, self.covered, self.points = "normal", 0, 0, 0

    def save(self) -> DisplayList:
        if len(self.stack) >= MAX_DEPTH:
            raise PlanError("the stack is full")
        self.stack.append(self.transform)
        return self

    def restore(self) -> DisplayList:
        if not self.stack:
            raise PlanError("nothing was saved")
        self.transform = self.stack.pop()
        return self

    def _compose(self, a, b, c, d, e, f) -> DisplayList:
        ta, tb, tc, td, te, tf = self.transform
        self.transform = (ta * a + tb * c, ta * b + tb * d, tc * a + td * c, tc * b + td * d, ta * e + tb * f + te, tc * e + td * f + tf)
        return self

    def translate(self, x: float, y: float) -> DisplayList:
        return self._compose(1, 0, 0, 1, x, y)

    def scale(self, x: float, y: float) -> DisplayList:
        return self._compose(x, 0, 0, y, 0, 0)

    def rotate(self, degrees: float) -> DisplayList:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return self._compose(c, -s, s, c, 0, 0)

    def set_transform(self, matrix: Affine) -> DisplayList:
        self.transform = tuple(matrix)
        return self

    def blend(self, mode: str) -> DisplayList:
        check(mode in draw.BLENDS, mode)
        self.mode = mode
        return self

    def _add(self, kind: str, geometry_: Sequence[float], color: Sequence[int], rule: str = "even_odd") -> DisplayList:
        if len(self.shapes) >= MAX_SHAPES:
            raise PlanError("the list is full")
        self.shapes.append(Shape(kind, tuple(geometry_), tuple(color), self.transform, self.mode, rule))
        return self

    def rect(self, x, y, w, h, color) -> DisplayList:
        return self._add("rect", (x, y, w, h), color)

    def round_rect(self, x, y, w, h, radius, color) -> DisplayList:
        return self._add("round_rect", (x, y, w, h, radius), color)

    def ellipse(self, cx, cy, rx, ry, color) -> DisplayList:
        return self._add("ellipse", (cx, cy, rx, ry), color)

    def line(self, x1, y1, x2, y2, thickness, color) -> DisplayList:
        return self._add("line", (x1, y1, x2, y2, thickness), color)

    def polygon(self, xs, ys, color, rule="even_odd") -> DisplayList:
        self.points += len(xs)
        if self.points > MAX_POINTS:
            raise PlanError("too many points")
        return self._add("polygon", [v for p in zip(xs, ys, strict=True) for v in p], color, rule)

    def bounds(self) -> tuple[int, int, int, int]:
        """x, y, width, height of the union of all shapes' boxes."""
        boxes = [s.bounds() for s in self.shapes]
        if not boxes:
            return 0, 0, 0, 0
        x, y = math.floor(min(b[0] for b in boxes)), math.floor(min(b[1] for b in boxes))
        return x, y, math.ceil(max(b[2] for b in boxes)) - x, math.ceil(max(b[3] for b in boxes)) - y

    def visible(self, width: int, height: int) -> list[Shape]:
        """Shapes that reach the canvas and that no later one hides; counts the others."""
        inside = [s for s in self.shapes if (b := s.bounds())[2] >= 0 and b[3] >= 0 and b[0] <= width and b[1] <= height and b[0] < b[2] and b[1] < b[3]]
        self.culled = len(self.shapes) - len(inside)
        out = [s for i, s in enumerate(inside) if not any(t.covers(s.bounds()) for t in inside[i + 1 :])]
        self.covered = len(inside) - len(out)
        return out

    def render(self, p: Pixels) -> Pixels:
        for shape in self.visible(p.width, p.height):
            p = _drawn(p, shape)
        return p


def _drawn(p: Pixels, s: Shape) -> Pixels:
    g, (a, b, c, d, _, _) = s.geometry, s.transform
    if s.kind == "line":
        (x0, y0), (x1, y1) = s.at(g[0], g[1]), s.at(g[2], g[3])
        return draw.draw_line(p, int(x0), int(y0), int(x1), int(y1), int(g[4] * math.sqrt(abs(a * d - b * c)) + 0.5), s.color)
    if s.upright and s.kind in ("rect", "round_rect"):
        x0, y0, x1, y1 = s.bounds()
        x, y, w, h = int(x0), int(y0), int(x1 - x0), int(y1 - y0)
        if s.kind == "rect":
            return draw.fill_rectangle(p, x, y, w, h, s.color, s.blend)
        return draw.fill_rounded_rectangle(p, x, y, w, h, int(g[4] * min(abs(a), abs(d)) + 0.5), s.color)
    if s.upright and s.kind == "ellipse":
        cx, cy = s.at(g[0], g[1])
        rx, ry = int(g[2] * abs(a) + 0.5), int(g[3] * abs(d) + 0.5)
        return draw.paint(p, geometry.ellipse_test(int(cx), int(cy), rx, ry), s.color, s.blend) if rx and ry else p
    if s.kind == "ellipse":
        corners = [(g[0] + g[2] * math.cos(i * math.pi / 16), g[1] + g[3] * math.sin(i * math.pi / 16)) for i in range(32)]
    else:
        corners = s.outline()
    xs, ys = zip(*(s.at(*q) for q in corners), strict=True)
    rule = s.rule if s.kind == "polygon" else "nonzero"
    return draw.strokes(p, geometry.polygon_spans(xs, ys, p.height, rule), s.color, s.blend)
