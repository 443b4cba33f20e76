"""Neighbourhood operators: window frames for separable sums and extrema, small offset tables otherwise."""

from __future__ import annotations

import math

from pixelmill.functions.color import check
from pixelmill.operators.tone import inside
from pixelmill.relation import CHANNELS, COLORS, Pixels, clamp, num


def _axis_sum(p: Pixels, radius: int, axis: str) -> Pixels:
    """One pass of a box blur: a framed sum plus replicated edge samples, rounded; all channels, alpha too."""
    p = p.by_image()
    other, last = ("y", p.width - 1) if axis == "x" else ("x", p.height - 1)
    span, part = 2 * radius + 1, f"PARTITION BY image_id, {other}"
    frame = f"OVER ({part} ORDER BY {axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    inner = ", ".join(
        f"CAST(sum({c}) {frame} AS BIGINT) AS s_{c}, CAST(first_value({c}) OVER ({part} ORDER BY {axis}) AS BIGINT) AS f_{c}, "
        f"CAST(last_value({c}) OVER ({part} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS BIGINT) AS l_{c}"
        for c in CHANNELS
    )
    low, high = f"greatest(0, {radius} - {axis})", f"greatest(0, {axis} + {radius} - {last})"
    body = ", ".join(f"{p.div(f's_{c} + {low} * f_{c} + {high} * l_{c} + {span // 2}', str(span))} AS {c}" for c in CHANNELS)
    return p.of(f"SELECT image_id, y, x, {body} FROM (SELECT image_id, y, x, {inner} FROM ({p.sql}) t) u")


def box_blur(p: Pixels, radius: int) -> Pixels:
    return _axis_sum(_axis_sum(p, radius, "x"), radius, "y") if radius > 0 else p


def gaussian_radius(sigma: float) -> int:
    return int((math.sqrt(4 * sigma * sigma + 1) - 1) / 2 + 0.5)


def gaussian_blur(p: Pixels, sigma: float) -> Pixels:
    """Three box passes."""
    check(sigma >= 0, "sigma")
    for _ in range(3):
        p = box_blur(p, gaussian_radius(sigma))
    return p


def paired(p: Pixels, other: Pixels, prefix: str = "o_") -> str:
    """This relation with another's samples beside its own."""
    names = ", ".join(f"o.{c} AS {prefix}{c}" for c in CHANNELS)
    return f"(SELECT t.*, {names} FROM ({p.sql}) t JOIN ({other.sql}) o ON o.image_id = t.image_id AND o.y = t.y AND o.x = t.x)"


def with_other(p: Pixels, other: Pixels, form, alpha: bool = False) -> Pixels:
    body = ", ".join(f"{form(c, f'o_{c}')} AS {c}" if alpha or c != "a" else c for c in CHANNELS)
    return p.of(f"SELECT image_id, y, x, {body} FROM {paired(p, other)} u")


def unsharp_mask(p: Pixels, sigma: float, amount: float, threshold: float = 0.0) -> Pixels:
    check(sigma >= 0 and amount >= 0 and threshold >= 0, "unsharp")
    t = int(threshold)
    return with_other(p, gaussian_blur(p, sigma), lambda c, o: f"CASE WHEN abs({c} - {o}) < {t} THEN {c} ELSE {p.round8(f'{c} + {num(amount)} * ({c} - {o})')} END")


def sharpen(p: Pixels, amount: float) -> Pixels:
    return unsharp_mask(p, 1.0, amount)


def clarity(p: Pixels, amount: float) -> Pixels:
    return unsharp_mask(p, max(2.0, min(p.width, p.height) / 40), amount)


def neighbors(p: Pixels) -> str:
    """Each pixel with its 3 x 3 neighbours' colours as columns r0 to r8, g0 to g8, b0 to b8, row by row, edges clamped.

    First the left and right ones along rows, then the upper and lower ones of these three along columns: two window
    passes over an image's rows instead of nine copies of every pixel in a join.
    """
    p = p.by_image()
    row, column = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"
    across = ", ".join(f"coalesce(lag({c}) {row}, {c}) AS {c}l, {c} AS {c}m, coalesce(lead({c}) {row}, {c}) AS {c}h" for c in COLORS)
    inner = f"(SELECT image_id, y, x, a, {across} FROM ({p.sql}) t)"
    down = ", ".join(
        f"coalesce(lag({c}{s}) {column}, {c}{s}) AS {c}{i}, {c}{s} AS {c}{i + 3}, coalesce(lead({c}{s}) {column}, {c}{s}) AS {c}{i + 6}" for c in COLORS for i, s in enumerate("lmh")
    )
    return f"(SELECT image_id, y, x, a, {down} FROM {inner} v)"


def _weighted(c: str, kernel: list[int]) -> str:
    return "(" + (" + ".join(f"{w} * {c}{i}" for i, w in enumerate(kernel) if w) or "0") + ")"


def convolve3(p: Pixels, kernel: list[int], divisor: int = 1, offset: int = 0) -> Pixels:
    """A 3 x 3 kernel on the colours, edges clamped, truncated, clamped; alpha stays."""
    body = ", ".join(f"{clamp(p.div(_weighted(c, kernel), str(divisor)) + f' + {offset}')} AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {neighbors(p)} n")


def emboss(p: Pixels, strength: float) -> Pixels:
    # The relief kernel of weight zero.
    return convolve3(p, [-2, -1, 0, -1, 0, 1, 0, 1, 2], 1, int(strength))


def sobel(p: Pixels) -> Pixels:
    """Root of the squared horizontal and vertical gradients of each colour."""
    gx, gy = [-1, 0, 1, -2, 0, 2, -1, 0, 1], [-1, -2, -1, 0, 0, 0, 1, 2, 1]
    square = lambda e: f"{e} * {e}"
    body = ", ".join(p.round8(f"sqrt(CAST({square(_weighted(c, gx))} + {square(_weighted(c, gy))} AS DOUBLE))") + f" AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {neighbors(p)} n")


def despeckle(p: Pixels) -> Pixels:
    """The median of 3 x 3 for each colour."""
    nine = lambda c: ", ".join(f"{c}{i}" for i in range(9))
    middle = (lambda c: f"sort_array(array({nine(c)}))[4]") if p.spark else (lambda c: f"list_sort([{nine(c)}])[5]")
    return p.of(f"SELECT image_id, y, x, {', '.join(f'{middle(c)} AS {c}' for c in COLORS)}, a FROM {neighbors(p)} n")


def _extreme(p: Pixels, radius: int, f: str) -> Pixels:
    p = p.by_image()
    for axis, other in (("x", "y"), ("y", "x")):
        frame = f"OVER (PARTITION BY image_id, {other} ORDER BY {axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
        p = p.each(lambda c: f"{f}({c}) {frame}")
    return p


def dilate(p: Pixels, radius: int) -> Pixels:
    return _extreme(p, radius, "max")


def erode(p: Pixels, radius: int) -> Pixels:
    return _extreme(p, radius, "min")


def morph_open(p: Pixels, radius: int) -> Pixels:
    return dilate(erode(p, radius), radius)


def morph_close(p: Pixels, radius: int) -> Pixels:
    return erode(dilate(p, radius), radius)


def outline(p: Pixels, radius: int) -> Pixels:
    return with_other(dilate(p, radius), erode(p, radius), lambda c, o: f"{c} - {o}")


def pixelate(p: Pixels, size: int, x: int = 0, y: int = 0, width: int = 0, height: int = 0) -> Pixels:
    """Means of blocks that begin at the rectangle's corner, alpha too."""
    if size < 2:
        return p
    here = inside(p, x, y, width, height)
    part = f"OVER (PARTITION BY image_id, {p.div(f'y - {y}', str(size))}, {p.div(f'x - {x}', str(size))}, CASE WHEN {here} THEN 1 ELSE 0 END)"
    mean = lambda c: p.div(f"CAST(sum({c}) {part} AS BIGINT) + {p.div(f'count(*) {part}', '2')}", f"count(*) {part}")
    return p.each(lambda c: f"CASE WHEN {here} THEN {mean(c)} ELSE {c} END", alpha=True)


def halftone(p: Pixels, cell: int) -> Pixels:
    """A dot for each cell and colour; its area is the tone."""
    if cell < 2:
        return p
    part = f"OVER (PARTITION BY image_id, {p.div('y', str(cell))}, {p.div('x', str(cell))})"
    half = cell * 0.5
    d2 = " + ".join(f"((({v} % {cell}) + 0.5e0 - {num(half)}) * (({v} % {cell}) + 0.5e0 - {num(half)}))" for v in "xy")
    inner = p.derive(", ".join(f"CAST(sum({c}) {part} AS DOUBLE) / count(*) {part} AS m_{c}" for c in COLORS))
    body = ", ".join(f"CASE WHEN sqrt({d2}) <= {num(half)} * sqrt(1e0 - m_{c} / 255e0) THEN 0 ELSE 255 END AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {inner} u")


def tilt_shift(p: Pixels, sigma: float, band: float) -> Pixels:
    """Sharp in a horizontal band, blurred outside it; the weight of the blur is in 1/256 of the distance to the edge."""
    band = band if band > 0 else 0.25
    middle = p.height / 2
    t = f"least(1e0, greatest(0e0, (abs(y + 0.5e0 - {num(middle)}) - {num(band * p.height / 2)}) / {num(max(1e-6, middle - band * p.height / 2))}))"
    w = p.floor(f"{t} * 256e0 + 0.5e0")
    return with_other(p, gaussian_blur(p, sigma), lambda c, o: f"(({c} * (256 - {w}) + {o} * {w} + 128) >> 8)", alpha=True)


def blur_region(p: Pixels, x: int, y: int, width: int, height: int, sigma: float) -> Pixels:
    """The whole image is blurred, so what is around the rectangle bleeds in; only the rectangle is taken."""
    here = inside(p, x, y, width, height)
    return with_other(p, gaussian_blur(p, sigma), lambda c, o: f"CASE WHEN {here} THEN {o} ELSE {c} END", alpha=True)


def glow(p: Pixels, sigma: float, strength: float) -> Pixels:
    """The image screened with its blur times strength, which has no upper bound."""
    check(sigma >= 0 and strength >= 0, "glow")

    def screen(c: str, o: str) -> str:
        base, lit = f"({c} / 255e0)", f"({num(strength)} * {o} / 255e0)"
        return p.round8(f"255e0 * ({base} + {lit} - {base} * {lit})")

    return with_other(p, gaussian_blur(p, sigma), screen)


def drop_shadow(p: Pixels, dx: int, dy: int, sigma: float, color=(0, 0, 0, 255)) -> Pixels:
    """The image on a larger canvas over its own toned, shifted and blurred alpha; the tone's alpha does not count."""
    from pixelmill.operators import draw, geometry

    check(sigma >= 0, "sigma")
    pad = int(3 * sigma + 1)
    left, top, right, bottom = (pad + max(0, -dx), pad + max(0, -dy), pad + max(0, dx), pad + max(0, dy))
    base = geometry.expand(p, left, top, right, bottom, (0, 0, 0, 0))
    # a clear pixel of the silhouette leaves the canvas clear, so it has no tone
    shade = p.select(*(f"CASE WHEN a > 0 THEN {v} ELSE 0 END" for v in color[:3]))
    moved = geometry.place(shade, base.width, base.height, left + dx, top + dy, (0, 0, 0, 0))
    return draw.composite(gaussian_blur(moved, sigma), base)
