"""Tables and matrices of tone operations, in 16.16 fixed point, made on the driver once per query."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pixelmill.errors import RangeError

# Rec. 709 weights, hue rotation, colour blindness projections, sepia, error spread.
LUMA = (0.2126, 0.7152, 0.0722)
LUMA_FIXED = (13933, 46871, 4732)
HUE_BASE = (0.213, 0.715, 0.072, 0.213, 0.715, 0.072, 0.213, 0.715, 0.072)
HUE_COS = (0.787, -0.715, -0.072, -0.213, 0.285, -0.072, -0.213, -0.715, 0.928)
HUE_SIN = (-0.213, -0.715, 0.928, 0.143, 0.140, -0.283, -0.787, 0.715, 0.072)
COLORBLIND = {
    "protanopia": (0.567, 0.433, 0.0, 0.558, 0.442, 0.0, 0.0, 0.242, 0.758),
    "deuteranopia": (0.625, 0.375, 0.0, 0.7, 0.3, 0.0, 0.0, 0.3, 0.7),
    "tritanopia": (0.95, 0.05, 0.0, 0.0, 0.433, 0.567, 0.0, 0.475, 0.525),
    "achromatopsia": LUMA * 3,
}
SPREAD = (0.0, 0.0, 0.0, 0.7, 1.0, 0.0, 0.7, 0.0, 1.0)
SEPIA = (0.393, 0.769, 0.189, 0.349, 0.686, 0.168, 0.272, 0.534, 0.131)

Matrix = tuple[int, ...]  # three rows of four, 16.16
IDENTITY: Matrix = (65536, 0, 0, 0, 0, 65536, 0, 0, 0, 0, 65536, 0)


def check(ok: bool, what: str) -> None:
    if not ok:
        raise RangeError(what)


def fixed(x: float) -> int:
    return math.trunc(x * 65536 + math.copysign(0.5, x))


def fixed_matrix(rows: Sequence[Sequence[float]]) -> Matrix:
    """From three rows of three or four numbers; offsets are in samples."""
    return tuple(fixed(v) for row in rows for v in (*row, 0.0)[:4])


def square(nine: Sequence[float]) -> Matrix:
    return fixed_matrix([nine[0:3], nine[3:6], nine[6:9]])


def compose(first: Matrix, second: Matrix) -> Matrix:
    """The matrix that does ``first`` and then ``second``; each sum of products is truncated once."""

    def cut(x: int) -> int:
        return -(-x // 65536) if x < 0 else x // 65536

    out = []
    for i in range(3):
        row = second[4 * i : 4 * i + 4]
        out += [cut(sum(row[k] * first[4 * k + j] for k in range(3))) for j in range(3)]
        out.append(cut(sum(row[k] * first[4 * k + 3] for k in range(3))) + row[3])
    return tuple(out)


def brightness(f: float) -> Matrix:
    check(math.isfinite(f) and f >= 0, "brightness")
    return fixed_matrix([[f, 0, 0], [0, f, 0], [0, 0, f]])


def contrast(f: float) -> Matrix:
    check(math.isfinite(f) and f >= 0, "contrast")
    off = 127.5 * (1 - f)
    return fixed_matrix([[f, 0, 0, off], [0, f, 0, off], [0, 0, f, off]])


def saturation(f: float) -> Matrix:
    """A mix with luma; the weights of luma are the fixed ones, so that grey stays grey exactly."""
    check(math.isfinite(f) and f >= 0, "saturation")
    return fixed_matrix([[(1 - f) * LUMA_FIXED[c] / 65536 + (f if c == r else 0) for c in range(3)] for r in range(3)])


def hue(degrees: float) -> Matrix:
    check(math.isfinite(degrees), "hue")
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return square([b + c * k + s * t for b, k, t in zip(HUE_BASE, HUE_COS, HUE_SIN, strict=True)])


def invert() -> Matrix:
    return fixed_matrix([[-1, 0, 0, 255], [0, -1, 0, 255], [0, 0, -1, 255]])


def blackwhite() -> Matrix:
    return square(LUMA * 3)


def colorize(color: Sequence[int], strength: float) -> Matrix:
    check(0 <= strength <= 1, "strength")
    return fixed_matrix([[(1 - strength if r == c else 0) + strength * color[r] / 255 * LUMA[c] for c in range(3)] for r in range(3)])


def tint(color: Sequence[int], strength: float) -> Matrix:
    check(-1 <= strength <= 1, "strength")
    neutral = sum(w * v for w, v in zip(LUMA, color, strict=False))
    return fixed_matrix([[float(r == c) for c in range(3)] + [strength * (color[r] - neutral)] for r in range(3)])


def duotone(shadow: Sequence[int], highlight: Sequence[int]) -> Matrix:
    return fixed_matrix([[(highlight[r] - shadow[r]) / 255 * LUMA[c] for c in range(3)] + [shadow[r]] for r in range(3)])


def split_tone(shadow: Sequence[int], highlight: Sequence[int], balance: float) -> Matrix:
    check(0 <= balance <= 1, "balance")
    rows = []
    for r in range(3):
        low, high = (shadow[r] - 128) / 255, (highlight[r] - 128) / 255
        rows.append([(r == c) + (high - low) * LUMA[c] for c in range(3)] + [255 * (low + (high - low) * (0.5 - balance))])
    return fixed_matrix(rows)


def gains(red: float, green: float, blue: float) -> Matrix:
    check(min(red, green, blue) >= 0, "gain")
    return fixed_matrix([[red, 0, 0], [0, green, 0], [0, 0, blue]])


def white_balance(temperature: float, tint_: float = 0.0) -> Matrix:
    check(abs(temperature) <= 1 and abs(tint_) <= 1, "white balance")
    return gains(1 + 0.3 * temperature + 0.05 * tint_, 1 - 0.15 * tint_, 1 - 0.3 * temperature + 0.05 * tint_)


def colorblind_simulate(kind: str) -> Matrix:
    check(kind in COLORBLIND, kind)
    return square(COLORBLIND[kind])


def colorblind_assist(kind: str) -> Matrix:
    """The lost difference, spread over the channels that the viewer still tells apart, is added back."""
    check(kind in COLORBLIND, kind)
    p = COLORBLIND[kind]
    lost = [[float(r == c) - p[3 * r + c] for c in range(3)] for r in range(3)]
    return fixed_matrix([[float(r == c) - lost[r][c] + sum(SPREAD[3 * r + k] * lost[k][c] for k in range(3)) for c in range(3)] for r in range(3)])


def toward(color: Sequence[int], weight: float) -> Matrix:
    check(0 <= weight <= 1, "weight")
    return fixed_matrix([[(1 - weight if r == c else 0) for c in range(3)] + [weight * color[r]] for r in range(3)])


# curves


def _byte(v: float) -> int:
    return int(min(255, max(0, math.floor(v + 0.5))))


def table(f: Callable[[float], float]) -> list[int]:
    return [_byte(f(float(v))) for v in range(256)]


def curve(kind: str, *p: float) -> list[int]:
    """A table of 256 samples of one of twelve curves."""
    if kind == "gamma":
        check(p[0] > 0, kind)
        return table(lambda v: 255 * (v / 255) ** p[0])
    if kind == "posterize":
        check(2 <= p[0] <= 256, kind)
        step = 255 / (p[0] - 1)
        return table(lambda v: math.floor(v / step + 0.5) * step)
    if kind == "threshold":
        return table(lambda v: 255 if v >= p[0] else 0)
    if kind == "solarize":
        return table(lambda v: 255 - v if v >= p[0] else v)
    if kind == "exposure":
        return table(lambda v: v * 2 ** p[0])
    if kind == "levels":
        in_black, in_white, g, out_black, out_white = p
        check(in_white > in_black and g > 0, kind)
        return table(lambda v: out_black + (out_white - out_black) * min(1.0, max(0.0, (v - in_black) / (in_white - in_black))) ** (1 / g))
    if kind == "fill_light":
        return table(lambda v: 255 * (v / 255 + p[0] * (1 - v / 255) ** 3))
    if kind == "gain":
        return table(lambda v: v * p[0])
    if kind == "sigmoid":
        return table(lambda v: 255 * ((t := v / 255 - 0.5) + 4 * p[0] * t * (0.25 - t * t) + 0.5))
    if kind == "negate":
        return table(lambda v: 255 - v)
    if kind == "srgb":
        if p[0] >= 0:
            return table(lambda v: 255 * (12.92 * v / 255 if v / 255 <= 0.0031308 else 1.055 * (v / 255) ** (1 / 2.4) - 0.055))
        return table(lambda v: 255 * (v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4))
    if kind == "balance":
        s, m, h = p
        return table(lambda v: v + 255 * (s * (1 - v / 255) ** 2 + m * (1 - (1 - v / 255) ** 2 - (v / 255) ** 2) + h * (v / 255) ** 2))
    raise RangeError(kind)


def points(xs: Sequence[int], ys: Sequence[int]) -> list[int]:
    """A piecewise linear table through control points of strictly ascending x; flat outside."""
    check(len(xs) == len(ys) >= 2 and all(a < b for a, b in zip(xs, xs[1:], strict=False)), "control points")

    def at(v: float) -> float:
        if v <= xs[0]:
            return ys[0]
        for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
            if v <= x1:
                return y0 + (y1 - y0) * (v - x0) / (x1 - x0)
        return ys[-1]

    return table(at)


def compose_tables(first: Sequence[int], second: Sequence[int]) -> list[int]:
    return [second[v] for v in first]


# The looks as stacks of stages.
PRESETS: dict[str, list[tuple]] = {
    "noir": [("matrix", saturation(0)), ("matrix", contrast(1.45))],
    "chrome": [("matrix", saturation(0)), ("table", curve("levels", 12, 235, 1, 18, 255)), ("matrix", gains(1, 1, 1.08))],
    "mono": [("matrix", saturation(0))],
    "fade": [("table", curve("levels", 0, 255, 1, 28, 232)), ("matrix", saturation(0.75))],
    "vivid": [("matrix", saturation(1.4)), ("matrix", contrast(1.15))],
    "warm": [("matrix", white_balance(0.35))],
    "cool": [("matrix", white_balance(-0.35))],
    "instant": [("matrix", white_balance(0.25, 0.1)), ("table", curve("levels", 0, 248, 1.1, 22, 244)), ("matrix", saturation(0.85))],
    "tonal": [("table", curve("levels", 0, 255, 1, 34, 216)), ("matrix", saturation(0.9))],
}


def fuse(stages: Sequence[tuple]) -> list[tuple]:
    """Neighbouring matrices become one, neighbouring tables become one; the fused stage is what is rounded."""
    out: list[tuple] = []
    for kind, value in stages:
        if out and out[-1][0] == kind:
            out[-1] = (kind, compose(out[-1][1], value) if kind == "matrix" else compose_tables(out[-1][1], value))
        else:
            out.append((kind, value))
    return out
