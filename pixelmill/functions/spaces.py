"""Colour spaces and gradients as expressions over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pixelmill.functions.color import check
from pixelmill.relation import Pixels, luma, num


def _wide(p: Pixels) -> str:
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    return p.derive(f"{top} AS hi, {low} AS lo")


def _hue() -> str:
    c = "((hi - lo) * 1e0)"
    return f"CASE WHEN hi = lo THEN 0e0 WHEN hi = r THEN 60e0 * ((g - b) / {c}) + CASE WHEN g < b THEN 360e0 ELSE 0e0 END WHEN hi = g THEN 60e0 * ((b - r) / {c}) + 120e0 ELSE 60e0 * ((r - g) / {c}) + 240e0 END"


def rgb_to_hsv(p: Pixels, digits: int = 6) -> str:
    """image_id, y, x, h in degrees, s and v in 0 to 1."""
    s = "CASE WHEN hi = 0 THEN 0e0 ELSE (hi - lo) * 1e0 / hi END"
    return f"SELECT image_id, y, x, round({_hue()}, {digits}) AS h, round({s}, {digits}) AS s, round(hi / 255e0, {digits}) AS v FROM {_wide(p)} u"


def rgb_to_hsl(p: Pixels, digits: int = 6) -> str:
    s = "CASE WHEN hi = lo THEN 0e0 WHEN hi + lo > 255 THEN (hi - lo) * 1e0 / (510 - hi - lo) ELSE (hi - lo) * 1e0 / (hi + lo) END"
    return f"SELECT image_id, y, x, round({_hue()}, {digits}) AS h, round({s}, {digits}) AS s, round((hi + lo) / 510e0, {digits}) AS l FROM {_wide(p)} u"


def rgb_to_cmyk(p: Pixels, digits: int = 6) -> str:
    one = lambda c: f"CASE WHEN hi = 0 THEN 0e0 ELSE round((hi - {c}) * 1e0 / hi, {digits}) END"
    return f"SELECT image_id, y, x, {one('r')} AS c, {one('g')} AS m, {one('b')} AS ye, round(1e0 - hi / 255e0, {digits}) AS k FROM {_wide(p)} u"


def rgb_to_gray(p: Pixels) -> str:
    return f"SELECT image_id, y, x, {luma()} AS l FROM ({p.sql}) t"


def _from_hue(p: Pixels, source: str, chroma: str, base: str) -> Pixels:
    rise = "(ch * (1e0 - abs(sec - 2e0 * floor(sec / 2e0) - 1e0)))"
    pick = lambda order: "CASE " + " ".join(f"WHEN sec < {i + 1}e0 THEN {v}" for i, v in enumerate(order[:5])) + f" ELSE {order[5]} END"
    c, x, z = "ch", rise, "0e0"
    form = lambda order: p.round8(f"round((({pick(order)}) + fl) * 255e0, 6)")
    inner = f"(SELECT *, {chroma} AS ch, (h - 360e0 * floor(h / 360e0)) / 60e0 AS sec FROM ({source}) q)"
    outer = f"(SELECT *, {base} AS fl FROM {inner} w)"
    return p.of(f"SELECT image_id, y, x, {form([c, x, z, z, x, c])} AS r, {form([x, c, c, x, z, z])} AS g, {form([z, z, x, c, c, x])} AS b, CAST(255 AS BIGINT) AS a FROM {outer} u")


def hsv_to_rgb(p: Pixels, source: str) -> Pixels:
    """From rows of image_id, y, x, h, s, v."""
    return _from_hue(p, source, "v * s", "v - ch")


def hsl_to_rgb(p: Pixels, source: str) -> Pixels:
    return _from_hue(p, source, "(1e0 - abs(2e0 * l - 1e0)) * s", "l - ch * 0.5e0")


def cmyk_to_rgb(p: Pixels, source: str) -> Pixels:
    one = lambda c: p.round8(f"round(255e0 * (1e0 - {c}) * (1e0 - k), 6)")
    return p.of(f"SELECT image_id, y, x, {one('c')} AS r, {one('m')} AS g, {one('ye')} AS b, CAST(255 AS BIGINT) AS a FROM ({source}) q")


def interpolate_rgb(p: Pixels, color: Sequence[int], t: float) -> Pixels:
    """Each pixel toward a colour."""
    check(0 <= t <= 1, "t")
    return p.select(*(p.round8(f"{c} + ({v} - {c}) * {num(t)}") for c, v in zip("rgb", color, strict=False)))


def interpolate_hue(h1: str, h2: str, t: str) -> str:
    """Along the shorter arc, in [0, 360)."""
    d = f"(({h2}) - ({h1}))"
    short = f"({d} - 360e0 * floor(({d} + 180e0) / 360e0))"
    moved = f"(({h1}) + {short} * ({t}))"
    return f"({moved} - 360e0 * floor({moved} / 360e0))"


def multigradient(p: Pixels, colors: Sequence[Sequence[float]], steps: int, distribution: Sequence[float] | None = None, hue: bool = False) -> str:
    """i and one column c0, c1, ... for each component: ``steps`` stops over legs of equal or given shares.

    Each step is joined to the leg whose range holds it.  With ``hue`` the first component is degrees on the shorter arc.
    """
    check(len(colors) >= 2 and steps >= 2, "gradient")
    legs = len(colors) - 1
    shares = list(distribution) if distribution else [1 / legs] * legs
    check(len(shares) == legs and abs(sum(shares) - 1) <= 0.01, "distribution")
    edges = [sum(shares[:i]) / sum(shares) for i in range(legs)] + [1.0]
    n = len(colors[0])
    rows = [(float(edges[i]), float(edges[i + 1]), 1 if i == legs - 1 else 0, *(float(v) for v in colors[i]), *(float(v) for v in colors[i + 1])) for i in range(legs)]
    table = p.values(["t0", "t1", "last", *(f"a{j}" for j in range(n)), *(f"b{j}" for j in range(n))], rows, "k")
    at = f"(SELECT i, i / {num(steps - 1)} AS t FROM {p.series(steps, 's')}) s"
    part = "((s.t - k.t0) / (k.t1 - k.t0))"
    body = ", ".join(f"round({interpolate_hue(f'k.a{j}', f'k.b{j}', part) if hue and j == 0 else f'k.a{j} + (k.b{j} - k.a{j}) * {part}'}, 6) AS c{j}" for j in range(n))
    return f"SELECT s.i AS i, {body} FROM {at} JOIN {table} ON s.t >= k.t0 AND (s.t < k.t1 OR (k.last = 1 AND s.t <= k.t1))"


def packed(p: Pixels, gradient: str, alpha: bool = False) -> str:
    """i and the components of a gradient as 0xRRGGBB, or 0xRRGGBBAA as a signed 32-bit integer."""
    parts = " + ".join(f"{p.round8(f'c{j}')} * {256 ** ((3 if alpha else 2) - j)}" for j in range(4 if alpha else 3))
    value = f"(({parts}) - CASE WHEN ({parts}) >= 2147483648 THEN 4294967296 ELSE 0 END)" if alpha else f"({parts})"
    return f"SELECT i, CAST({value} AS BIGINT) AS packed FROM ({gradient}) q"
