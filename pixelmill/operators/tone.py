"""Tone and colour: matrices, tables and a few per-pixel forms, each one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pixelmill.functions import color as C
from pixelmill.relation import COLORS, Pixels, clamp, luma, num


def matrix(p: Pixels, m: C.Matrix) -> Pixels:
    """Three dot products in 16.16, rounded by adding a half and truncating, clamped; alpha stays."""
    rows = [" + ".join(f"{m[4 * i + j]} * {c}" for j, c in enumerate(COLORS) if m[4 * i + j]) or "0" for i in range(3)]
    out = [clamp(p.div(f"{row} + {m[4 * i + 3] + 32768}", "65536")) for i, row in enumerate(rows)]
    return p.select(*out)


def tables(p: Pixels, red: Sequence[int] | None, green: Sequence[int] | None, blue: Sequence[int] | None) -> Pixels:
    """One table of 256 for each colour; None leaves a channel."""
    return p.select(*(p.lookup(t, c) if t is not None else None for t, c in zip((red, green, blue), COLORS, strict=True)))


def curve(p: Pixels, kind: str, *params: float, mask: int = 0) -> Pixels:
    """A named curve on the channels of ``mask`` (bits r 1, g 2, b 4; 0 for all)."""
    t = C.curve(kind, *params)
    return tables(p, *(t if not mask or mask >> i & 1 else None for i in range(3)))


def stages(p: Pixels, stack: Sequence[tuple]) -> Pixels:
    """Fused colour stages in order."""
    for kind, value in C.fuse(stack):
        p = matrix(p, value) if kind == "matrix" else tables(p, value, value, value)
    return p


def preset(p: Pixels, name: str) -> Pixels:
    C.check(name in C.PRESETS, name)
    return stages(p, C.PRESETS[name])


def color_balance(p: Pixels, shadows: Sequence[float], midtones: Sequence[float], highlights: Sequence[float]) -> Pixels:
    return tables(p, *(C.curve("balance", *x) for x in zip(shadows, midtones, highlights, strict=True)))


def levels_channel(p: Pixels, channel: int, *params: float) -> Pixels:
    return curve(p, "levels", *params, mask=1 << channel)


def vibrance(p: Pixels, amount: float) -> Pixels:
    """Lifts saturation by 1 + amount (1 - saturation) about luma; not affine, so no stage of the planner."""
    C.check(-1 <= amount <= 2, "vibrance")
    top, low = f"greatest({', '.join(COLORS)})", f"least({', '.join(COLORS)})"
    gray = " + ".join(f"{num(w)} * {c}" for w, c in zip(C.LUMA, COLORS, strict=True))
    sat = f"CASE WHEN {top} = 0 THEN 0e0 ELSE ({top} - {low}) * 1e0 / {top} END"
    return p.each(lambda c: p.round8(f"({gray}) + ({c} - ({gray})) * (1e0 + {num(amount)} * (1e0 - ({sat})))"))


def replace_color(p: Pixels, old: Sequence[int], new: Sequence[int], tolerance: Sequence[int] = (0, 0, 0, 0)) -> Pixels:
    near = " AND ".join(f"abs({c} - {o}) <= {t}" for c, o, t in zip(("r", "g", "b", "a"), old, tolerance, strict=True))
    return p.select(*(f"CASE WHEN {near} THEN {n} ELSE {c} END" for c, n in zip(("r", "g", "b", "a"), new, strict=True)))


def inside(p: Pixels, x: int, y: int, width: int, height: int) -> str:
    """Whether a pixel is in a rectangle; extents of 0 reach to the edge."""
    right = min(p.width, x + width) if width else p.width
    bottom = min(p.height, y + height) if height else p.height
    return f"x >= {x} AND x < {right} AND y >= {y} AND y < {bottom}"


def mix_toward(p: Pixels, color: Sequence[int], weight: float, x: int = 0, y: int = 0, width: int = 0, height: int = 0) -> Pixels:
    """Toward a colour: a matrix for the whole image, 8.8 weights inside a smaller rectangle."""
    C.check(0 <= weight <= 1, "weight")
    if x == 0 and y == 0 and (width == 0 or width >= p.width) and (height == 0 or height >= p.height):
        return matrix(p, C.toward(color, weight))
    k = int(weight * 256 + 0.5)
    here = inside(p, x, y, width, height)
    return p.select(*(f"CASE WHEN {here} THEN (({256 - k} * {c} + {k * v} + 128) >> 8) ELSE {c} END" for c, v in zip(COLORS, color, strict=False)))


def darken(p: Pixels, x: int, y: int, width: int, height: int, factor: float) -> Pixels:
    return mix_toward(p, (0, 0, 0), 1 - factor, x, y, width, height)


def lighten(p: Pixels, x: int, y: int, width: int, height: int, factor: float) -> Pixels:
    return mix_toward(p, (255, 255, 255), 1 - factor, x, y, width, height)


def vignette(p: Pixels, radius: float, strength: float, color: Sequence[int] = (0, 0, 0)) -> Pixels:
    """Beyond ``radius`` toward a colour with the square of the distance; nothing if the radius covers the image."""
    C.check(radius > 0 and 0 <= strength <= 1, "vignette")
    cx, cy = p.width * 0.5, p.height * 0.5
    span = (cx * cx + cy * cy) ** 0.5
    if radius >= span:
        return p
    d = f"sqrt((x + 0.5e0 - {num(cx)}) * (x + 0.5e0 - {num(cx)}) + (y + 0.5e0 - {num(cy)}) * (y + 0.5e0 - {num(cy)}))"
    t = f"(({d} - {num(radius)}) / {num(span - radius)})"
    return p.select(*(f"CASE WHEN {d} <= {num(radius)} THEN {c} ELSE {p.round8(f'{c} + {num(strength)} * {t} * {t} * ({v} - {c})')} END" for c, v in zip(COLORS, color, strict=False)))


def _noise(p: Pixels, channel: int) -> str:
    """A hash of place and channel as the sum of three uniforms, -3 to 3; 32-bit arithmetic in 64-bit integers."""
    low = "4294967295"
    h = p.xor(p.xor(f"((x * 2654435769) & {low})", f"((y * 2246822507) & {low})"), f"{channel * 3266489909 & 0xFFFFFFFF}")

    def times(e: str, k: int) -> str:
        # split the factor so that products stay below 2**63
        return f"(((({e}) * {k >> 16}) & 65535) * 65536 + ({e}) * {k & 65535}) & {low}"

    h = p.xor(h, p.shr(h, 16))
    h = f"({times(h, 0x7FEB352D)})"
    h = p.xor(h, p.shr(h, 15))
    h = f"({times(h, 0x846CA68B)})"
    return h


def noise(p: Pixels, amount: float, monochrome: bool = False) -> Pixels:
    """Deterministic noise of place and channel."""
    C.check(amount >= 0, "amount")
    return _with_noise(p, range(1) if monochrome else range(3), lambda c, v: f"{c} + {num(amount)} * {v}")


def film_grain(p: Pixels, amount: float) -> Pixels:
    """Noise that is strongest in the midtones."""
    C.check(amount >= 0, "amount")
    return _with_noise(p, range(1), lambda c, v: f"{c} + {num(amount)} * (4e0 * ({c} / 255e0) * (1e0 - {c} / 255e0)) * {v}")


def _with_noise(p: Pixels, channels: range, form) -> Pixels:
    # each hash is a column of its own, so that it is written and computed once
    first = p.derive(", ".join(f"{_noise(p, i)} AS h{i}" for i in channels))
    mixed = f"(SELECT *, {', '.join(f'{p.xor(f"h{i}", p.shr(f"h{i}", 16))} AS k{i}' for i in channels)} FROM {first} u)"
    parts = {i: "2e0 * (" + " + ".join(f"(({p.shr(f'k{i}', 10 * j)} & 1023) / 1023e0 - 0.5e0)" for j in range(3)) + ")" for i in channels}
    body = ", ".join(f"{p.round8(form(c, parts[i if len(channels) > 1 else 0]))} AS {c}" for i, c in enumerate(COLORS))
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {mixed} v")


def bayer(p: Pixels) -> str:
    """The 8 x 8 Bayer index by interleaving bits."""
    parts = []
    for bit in range(3):
        s = 2 - bit
        parts.append(f"(({p.xor(p.shr('y', s), p.shr('x', s))}) & 1) * {1 << (2 * bit + 1)}")
        parts.append(f"({p.shr('x', s)} & 1) * {1 << (2 * bit)}")
    return "(" + " + ".join(parts) + ")"


def dither(p: Pixels, levels: int) -> Pixels:
    """Ordered dither to ``levels`` samples a channel."""
    levels = max(2, levels)
    if levels >= 256:
        return p
    step = 255.0 / (levels - 1)
    bias = f"(({bayer(p)} + 0.5e0) / 64e0 - 0.5e0)"
    return p.each(lambda c: p.round8(f"floor(({c} + {bias} * {num(step)}) / {num(step)} + 0.5e0) * {num(step)}"))


def scanlines(p: Pixels, period: int, strength: float) -> Pixels:
    if period < 2:
        return p
    keep = int(min(1.0, max(0.0, 1 - strength)) * 256 + 0.5)
    return p.each(lambda c: f"CASE WHEN y % {period} = 0 THEN (({c} * {keep} + 128) >> 8) ELSE {c} END")


# channels and alpha


def to_gray(p: Pixels) -> Pixels:
    return p.select(luma(), luma(), luma(), channels=2 if p.channels in (2, 4) else 1)


def opaque(p: Pixels) -> Pixels:
    return p.select(a="CAST(255 AS BIGINT)", channels=4)


def flatten(p: Pixels, color: Sequence[int] = (255, 255, 255)) -> Pixels:
    """Over a colour; alpha is gone."""
    return p.select(*(p.div(f"{c} * a + {v} * (255 - a) + 127", "255") for c, v in zip(COLORS, color, strict=False)), "CAST(255 AS BIGINT)", channels=3)


def opacity(p: Pixels, f: float) -> Pixels:
    C.check(0 <= f <= 1, "opacity")
    return p.select(a=f"((a * {int(f * 256 + 0.5)} + 128) >> 8)", channels=4)


def premultiply(p: Pixels) -> Pixels:
    return p.each(lambda c: p.div(f"{c} * a + 127", "255"))


def unpremultiply(p: Pixels) -> Pixels:
    return p.each(lambda c: f"CASE WHEN a = 0 OR a = 255 THEN {c} ELSE least(255, {p.div(f'{c} * 255 + {p.div("a", "2")}', 'a')}) END")
