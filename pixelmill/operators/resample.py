"""Resampling by tap tables in 16.16, fit modes, gravity, and warps by inverse maps with bilinear gathers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pixelmill.errors import RangeError
from pixelmill.functions.color import check, fixed
from pixelmill.operators import geometry as G
from pixelmill.relation import CHANNELS, COLORS, Pixels, clamp, num

FITS = ("scale_down", "contain", "cover", "crop", "aspect_crop", "aspect_contain", "aspect_cover", "pad", "stretch", "fill", "scale_up")
GRAVITIES = ("center", "n", "s", "w", "e", "nw", "ne", "sw", "se")
RADIUS = {"nearest": 0.5, "box": 0.5, "bilinear": 1.0, "catmull_rom": 2.0}


def _catmull(t: float) -> float:
    t = abs(t)
    if t < 1:
        return 1.5 * t**3 - 2.5 * t**2 + 1
    return -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def pick_filter(name: str, step: float, fast: bool = False) -> str:
    """``auto``: area means when reducing, a cubic when enlarging (a line under the fast effort)."""
    if name != "auto":
        check(name in RADIUS, name)
        return name
    return "box" if step >= 1 else "bilinear" if fast else "catmull_rom"


def taps(source: int, count: int, name: str = "auto", origin: float = 0.0, extent: float | None = None, fast: bool = False) -> list[tuple[int, int, int]]:
    """(output, source, weight in 16.16) of one axis; the weights of an output sum to 65536 exactly.

    ``origin`` and ``extent`` are a window of the source.  An output takes the samples whose middles its filter reaches;
    those outside the window are left out before the weights are normalised, so what is cropped away does not bleed back.
    """
    extent = source if extent is None else extent
    step = extent / count
    kind = pick_filter(name, step, fast)
    scale = max(step, 1.0)
    low = min(source - 1, max(0, math.floor(origin)))
    high = min(source - 1, max(low, math.ceil(origin + extent) - 1))
    held = lambda v, least: min(high, max(least, v))
    out = []
    for i in range(count):
        center = origin + (i + 0.5) * step
        if kind == "nearest":
            out.append((i, held(math.floor(center), low), 65536))
            continue
        reach = RADIUS[kind] * scale
        first = math.ceil(center - reach - 0.5)
        last = max(first, math.floor(center + reach - 0.5))
        first = held(first, low)
        samples = range(first, held(last, first) + 1)
        if kind == "box":
            weights = [max(0.0, min(center + reach, j + 1) - max(center - reach, j)) for j in samples]
        else:
            away = [(j + 0.5 - center) / scale for j in samples]
            weights = [max(0.0, 1 - abs(d)) if kind == "bilinear" else _catmull(d) for d in away]
        total = sum(weights)
        fixed_ = [fixed(w / (total if total > 0 else 1.0)) for w in weights]
        fixed_[fixed_.index(max(fixed_))] += 65536 - sum(fixed_)
        out += [(i, j, w) for j, w in zip(samples, fixed_, strict=True) if w]
    return out


def _counted(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Taps with a flag: 1 where the output is one sample as it is."""
    many = {i for (i, _, _), (j, _, _) in zip(rows, rows[1:], strict=False) if i == j}
    return [(i, j, w, int(i not in many)) for i, j, w in rows]


def resize(p: Pixels, width: int, height: int, filter: str = "auto", window: tuple[float, float, float, float] | None = None, fast: bool = False) -> Pixels:
    """Sums of source pixels by the products of two taps, rounded once and clamped; columns are summed before rows.

    A zero axis keeps the ratio.  Colours are multiplied by alpha in whole samples before and divided by the rounded result
    alpha after, except where an output is one source pixel as it is.  Both sums are exact, so their order does not show.
    """
    if not width and not height:
        raise RangeError("both axes are zero")
    width = width or _round(p.width * height / p.height)
    height = height or _round(p.height * width / p.width)
    ox, oy, ex, ey = window or (0.0, 0.0, float(p.width), float(p.height))
    tx = p.values(["ox", "sx", "wx", "onex"], _counted(taps(p.width, width, filter, ox, ex, fast)), "tx")
    ty = p.values(["oy", "sy", "wy", "oney"], _counted(taps(p.height, height, filter, oy, ey, fast)), "ty")
    p = p.by_image()
    total = lambda e, name: f"CAST(sum({e}) AS BIGINT) AS {name}"
    wide = ", ".join([total("t.a * CAST(tx.wx AS BIGINT)", "s_a"), *(total(f"t.{c} * CAST(tx.wx AS BIGINT)", f"s_{c}") for c in COLORS), *(total(f"{p.div(f't.{c} * t.a', '255')} * CAST(tx.wx AS BIGINT)", f"p_{c}") for c in COLORS)])
    rows = f"(SELECT t.image_id, t.y, tx.ox AS x, max(tx.onex) AS one, {wide} FROM ({p.sql}) t JOIN {tx} ON t.x = tx.sx GROUP BY t.image_id, t.y, tx.ox)"
    tall = ", ".join(total(f"u.{k} * CAST(ty.wy AS BIGINT)", k) for k in ["s_a", *(f"{k}_{c}" for k in "sp" for c in COLORS)])
    both = f"(SELECT u.image_id, ty.oy AS y, u.x, max(u.one * ty.oney) AS one, {tall} FROM {rows} u JOIN {ty} ON u.y = ty.sy GROUP BY u.image_id, ty.oy, u.x)"
    sample = lambda k: clamp(p.shr(f"{k} + {1 << 31}", 32))
    made = f"(SELECT image_id, y, x, one, {', '.join(f'{sample(k)} AS {k}' for k in ['s_a', *(f'{k}_{c}' for k in 'sp' for c in COLORS)])} FROM {both} v)"
    color = lambda c: f"CASE WHEN one = 1 THEN s_{c} WHEN s_a > 0 AND s_a < 255 THEN {clamp(p.div(f'p_{c} * 255 + {p.div("s_a", "2")}', 's_a'))} ELSE p_{c} END AS {c}"
    return p.of(f"SELECT image_id, y, x, {', '.join(map(color, COLORS))}, s_a AS a FROM {made} w", width=width, height=height)


def zoom(p: Pixels, factor: float) -> Pixels:
    check(factor > 0, "zoom")
    return resize(p, _round(p.width * factor), _round(p.height * factor))


def reduce(p: Pixels, den: int) -> Pixels:
    """Scaled decoding: means of den x den blocks, the last ones smaller."""
    keys = f"image_id, {p.div('y', str(den))}, {p.div('x', str(den))}"
    body = ", ".join(f"{p.div(f'CAST(sum({c}) AS BIGINT) + {p.div("count(*)", "2")}', 'count(*)')} AS {c}" for c in CHANNELS)
    return p.of(f"SELECT image_id, {p.div('y', str(den))} AS y, {p.div('x', str(den))} AS x, {body} FROM ({p.sql}) t GROUP BY {keys}", width=-(-p.width // den), height=-(-p.height // den))


def _round(x: float) -> int:
    return 1 if x < 1 else math.floor(x + 0.5)


#: What each mode does with a mismatch of shapes, and which way it may scale; "ratio" works at the source's size.
_MODES = {
    "scale_down": ("keep", "down"), "scale_up": ("keep", "up"), "contain": ("keep", "free"), "pad": ("pad", "free"), "aspect_contain": ("pad", "ratio"), "cover": ("cut", "free"),
    "crop": ("cut", "down"), "fill": ("cut", "up"), "aspect_cover": ("cut", "ratio"), "aspect_crop": ("cut", "none"), "stretch": ("stretch", "free"),
}


def fit_geometry(w: int, h: int, tw: int, th: int, mode: str, gravity: str = "center", focus: tuple[float, float] | None = None) -> dict:
    """How a mode resolves: the size to scale to, the crop after it and the canvas to pad to."""
    check(mode in FITS and tw > 0 and th > 0, mode)
    mismatch, way = _MODES[mode]
    fx, fy = tw / w, th / h
    if mismatch == "stretch":
        sw, sh = tw, th
    elif way in ("ratio", "none"):
        sw, sh = w, h
    else:
        s = max(fx, fy) if mismatch == "cut" else min(fx, fy)
        s = min(s, 1.0) if way == "down" else max(s, 1.0) if way == "up" else s
        sw, sh = _round(w * s), _round(h * s)
    cw, ch = sw, sh
    if mismatch == "cut" and way == "ratio":  # the largest window of the target's shape
        cw, ch = (sw, min(sh, _round(sw * th / tw))) if fx > fy else (min(sw, _round(sh * tw / th)), sh)
    elif mismatch == "cut":
        cw, ch = min(tw, sw), min(th, sh)
    pw, ph = cw, ch
    if mismatch == "pad" and way == "ratio":  # the smallest canvas of the target's shape
        pw, ph = (cw, max(ch, _round(cw * th / tw))) if fx < fy else (max(cw, _round(ch * tw / th)), ch)
    elif mismatch == "pad":
        pw, ph = max(tw, cw), max(th, ch)
    place = lambda big, small: anchor(big[0] - small[0], big[1] - small[1], gravity, focus and (focus[0] * big[0] - small[0] / 2, focus[1] * big[1] - small[1] / 2))
    crop = (*place((sw, sh), (cw, ch)), cw, ch) if (cw, ch) != (sw, sh) else None
    canvas = (pw, ph, *place((pw, ph), (cw, ch))) if (pw, ph) != (cw, ch) else None
    return {"scale": (sw, sh), "crop": crop, "canvas": canvas}


def anchor(slack_x: int, slack_y: int, gravity: str, focus: tuple[float, float] | None = None) -> tuple[int, int]:
    """Offsets of a window with some slack: half of it in the middle, none or all at an edge, or centred on a focus."""
    if focus:
        return tuple(min(s, max(0, int(f + 0.5))) for s, f in zip((slack_x, slack_y), focus, strict=True))
    check(gravity in GRAVITIES, gravity)
    x = 0 if "w" in gravity else slack_x if "e" in gravity and gravity != "center" else slack_x // 2
    y = 0 if gravity.startswith("n") else slack_y if gravity.startswith("s") else slack_y // 2
    return x, y


def fit(p: Pixels, width: int, height: int, mode: str, gravity: str = "center", background: Sequence[int] = (0, 0, 0, 0), focus: tuple[float, float] | None = None, filter: str = "auto") -> Pixels:
    how = fit_geometry(p.width, p.height, width, height, mode, gravity, focus)
    if how["scale"] != (p.width, p.height):
        p = resize(p, *how["scale"], filter)
    if how["crop"]:
        p = G.crop(p, *how["crop"])
    if how["canvas"]:
        tw, th, left, top = how["canvas"]
        p = G.place(p, tw, th, left, top, background)
    return p


# warps


def warp(p: Pixels, width: int, height: int, sx: str, sy: str, background: Sequence[int] | None = None, clamp_edges: bool = False, drops: int = 9) -> Pixels:
    """Gather each output pixel from a fractional source place by four bilinear taps.

    ``sx`` and ``sy`` are doubles of the output's x and y, in pixel middles.  Outside, from half a pixel before the first
    middle and half a pixel behind the last, is the background or clear, or the edge's sample with ``clamp_edges``.
    Coordinates are rounded to ``drops`` digits, so that engines agree on edges.
    """
    fill = tuple(background) if background is not None else (0, 0, 0, 0)
    at = f"(SELECT g.image_id, g.y, g.x, round({sx}, {drops}) AS sx, round({sy}, {drops}) AS sy FROM {G.grid(p, width, height)} g)"
    taps_ = p.values(["dx", "dy"], [(0, 0), (1, 0), (0, 1), (1, 1)], "k")
    fx, fy = "(q.sx - floor(q.sx))", "(q.sy - floor(q.sy))"
    inside = "true" if clamp_edges else f"q.sx >= -0.5e0 AND q.sx < {num(p.width - 0.5)} AND q.sy >= -0.5e0 AND q.sy < {num(p.height - 0.5)}"
    near = lambda c, last: f"CASE WHEN {inside} THEN least(greatest({p.floor(f'q.s{c}')} + k.d{c}, 0), {last}) END AS j{c}"
    # a place outside has no neighbour: its sums are null, so one join and one aggregate make the whole canvas
    corner = (
        f"(SELECT q.image_id, q.y, q.x, {near('x', p.width - 1)}, {near('y', p.height - 1)}, "
        f"(CASE WHEN k.dx = 1 THEN {fx} ELSE 1e0 - {fx} END) * (CASE WHEN k.dy = 1 THEN {fy} ELSE 1e0 - {fy} END) AS w FROM {at} q CROSS JOIN {taps_})"
    )
    # weights are integers of 2 ** -24, so sums are the same in any order of rows
    sums = ", ".join(f"CAST(sum(CAST(floor(n.w * 16777216e0 + 0.5e0) AS BIGINT) * t.{c}) AS BIGINT) AS s_{c}" for c in CHANNELS)
    got = f"(SELECT n.image_id, n.y, n.x, {sums} FROM {corner} n LEFT JOIN ({p.sql}) t ON t.image_id = n.image_id AND t.y = n.jy AND t.x = n.jx GROUP BY n.image_id, n.y, n.x)"
    body = ", ".join(f"CASE WHEN s_{c} IS NULL THEN {f} ELSE least(255, {p.shr(f's_{c} + 8388608', 24)}) END AS {c}" for c, f in zip(CHANNELS, fill, strict=True))
    return p.of(f"SELECT image_id, y, x, {body} FROM {got} v", width=width, height=height, channels=4)


def affine(p: Pixels, width: int, height: int, inverse: Sequence[float], background=None) -> Pixels:
    """Inverse 2 x 3 map of output middles, relative to both images' centres."""
    a, b, c, d, e, f = inverse
    x, y = f"(g.x + 0.5e0 - {num(width / 2)})", f"(g.y + 0.5e0 - {num(height / 2)})"
    return warp(p, width, height, f"{num(a)} * {x} + {num(b)} * {y} + {num(c + p.width / 2 - 0.5)}", f"{num(d)} * {x} + {num(e)} * {y} + {num(f + p.height / 2 - 0.5)}", background)


def rotate(p: Pixels, degrees: float, background=None) -> Pixels:
    """Any angle, clockwise, on a canvas of the turned image's rounded extent; multiples of 90 are exact."""
    turns = degrees / 90
    whole = math.trunc(turns + math.copysign(0.5, turns))
    if abs(turns - whole) < 1e-4:
        return [lambda q: q, G.rotate90, G.rotate180, G.rotate270][whole % 4](p)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    w, h = int(abs(c) * p.width + abs(s) * p.height + 0.5), int(abs(s) * p.width + abs(c) * p.height + 0.5)
    return affine(p, w, h, (c, s, 0, -s, c, 0), background)


def shear(p: Pixels, kx: float, ky: float, background=None) -> Pixels:
    """x + kx y, ky x + y from the first corner, moved into the canvas where a factor is negative."""
    det = 1 - kx * ky
    check(abs(det) >= 1e-4, "shear")
    w, h = int(p.width + abs(kx) * p.height + 0.5), int(p.height + abs(ky) * p.width + 0.5)
    x, y = f"(g.x + {num(0.5 - max(0.0, -kx * p.height))})", f"(g.y + {num(0.5 - max(0.0, -ky * p.width))})"
    return warp(p, w, h, f"{num(1 / det)} * {x} + {num(-kx / det)} * {y} - 0.5e0", f"{num(-ky / det)} * {x} + {num(1 / det)} * {y} - 0.5e0", background)


def homography(quad: Sequence[float], width: int, height: int) -> list[float]:
    """Nine coefficients from a quadrilateral (x, y in order) to the source rectangle, by Gaussian elimination."""
    corners = [(0.0, 0.0), (float(width), 0.0), (float(width), float(height)), (0.0, float(height))]
    rows = []
    for i, (u, v) in enumerate(corners):
        x, y = quad[2 * i], quad[2 * i + 1]
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    for i in range(8):
        best = max(range(i, 8), key=lambda r: abs(rows[r][i]))
        check(abs(rows[best][i]) > 1e-9, "quadrilateral")
        rows[i], rows[best] = rows[best], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(8):
            if r != i:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [rows[i][8] for i in range(8)] + [1.0]


def perspective(p: Pixels, quad: Sequence[float], background=None) -> Pixels:
    """The image drawn into a quadrilateral, on a canvas of that one's rounded box."""
    left, top = min(quad[::2]), min(quad[1::2])
    w, h = int(max(quad[::2]) - left + 0.5), int(max(quad[1::2]) - top + 0.5)
    check(w > 0 and h > 0, "quadrilateral")
    m = homography([v - (top if i % 2 else left) for i, v in enumerate(quad)], p.width, p.height)
    x, y = "(g.x + 0.5e0)", "(g.y + 0.5e0)"
    line = lambda i: f"({num(m[i])} * {x} + {num(m[i + 1])} * {y} + {num(m[i + 2])})"
    below = f"(CASE WHEN abs({line(6)}) < 1e-6 THEN 1e-6 ELSE {line(6)} END)"
    return warp(p, w, h, f"{line(0)} / {below} - 0.5e0", f"{line(3)} / {below} - 0.5e0", background)


def _polar(p: Pixels) -> tuple[str, str, str]:
    dx, dy = f"(g.x + 0.5e0 - {num(p.width / 2)})", f"(g.y + 0.5e0 - {num(p.height / 2)})"
    return dx, dy, f"sqrt({dx} * {dx} + {dy} * {dy})"


def barrel(p: Pixels, amount: float) -> Pixels:
    """Radial distortion 1 + amount r^2, r as a fraction of the half diagonal."""
    dx, dy, d = _polar(p)
    span = math.hypot(p.width / 2, p.height / 2)
    k = f"(1e0 + {num(amount)} * ({d} / {num(span)}) * ({d} / {num(span)}))"
    return warp(p, p.width, p.height, f"{dx} * {k} + {num(p.width / 2 - 0.5)}", f"{dy} * {k} + {num(p.height / 2 - 0.5)}")


def swirl(p: Pixels, degrees: float) -> Pixels:
    """A turn that falls with the square of the distance from the middle."""
    dx, dy, d = _polar(p)
    span = math.hypot(p.width / 2, p.height / 2)
    near = f"greatest(0e0, 1e0 - {d} / {num(span)})"
    t = f"({num(math.radians(degrees))} * {near} * {near})"
    return warp(p, p.width, p.height, f"{dx} * cos({t}) - {dy} * sin({t}) + {num(p.width / 2 - 0.5)}", f"{dx} * sin({t}) + {dy} * cos({t}) + {num(p.height / 2 - 0.5)}")


def polar(p: Pixels, inverse: bool = False) -> Pixels:
    """Rectangle to disc, or back: x is the angle, from straight down all round, and y the radius up to half the diagonal."""
    span = math.hypot(p.width / 2, p.height / 2)
    if inverse:
        t, r = f"((g.x + 0.5e0) * {num(2 * math.pi / p.width)} - {num(math.pi)})", f"((g.y + 0.5e0) * {num(span / p.height)})"
        return warp(p, p.width, p.height, f"{num(p.width / 2)} + {r} * sin({t}) - 0.5e0", f"{num(p.height / 2)} - {r} * cos({t}) - 0.5e0")
    dx, dy, d = _polar(p)
    t = f"(atan2({dx}, -({dy})) + {num(math.pi)})"
    return warp(p, p.width, p.height, f"{t} * {num(p.width / 2 / math.pi)} - 0.5e0", f"{d} * {num(p.height / span)} - 0.5e0")


def arc(p: Pixels, degrees: float, background=None) -> Pixels:
    """Columns moved by a parabola that is 0 in the middle; the canvas grows by |degrees| / 180 of half the height."""
    check(-180 <= degrees <= 180, "arc")
    if not degrees:
        return p
    bend = degrees / 180 * p.height / 2
    u = f"((g.x + 0.5e0 - {num(p.width / 2)}) / {num(p.width / 2)})"
    return warp(p, p.width, p.height + int(abs(bend)), "g.x * 1e0", f"g.y - {num(bend)} * {u} * {u}", background)


def _trail(p: Pixels, names: Sequence[str], rows: Sequence[Sequence[float]], sx: str, sy: str) -> Pixels:
    """The rounded mean of several clamped gathers, one for each row of a small table ``k`` of numbers.

    ``sx`` and ``sy`` are in samples, of the pixel ``g`` and the row ``k``.  Each gather is rounded like one of its own.
    """
    steps = p.values(["i", *names], [(i, *map(float, r)) for i, r in enumerate(rows)], "k")
    at = f"(SELECT g.image_id, g.y, g.x, k.i, round({sx}, 9) AS sx, round({sy}, 9) AS sy FROM ({p.sql}) g CROSS JOIN {steps})"
    corners = p.values(["dx", "dy"], [(0, 0), (1, 0), (0, 1), (1, 1)], "e")
    part = lambda axis: f"(CASE WHEN e.d{axis} = 1 THEN q.s{axis} - floor(q.s{axis}) ELSE 1e0 - (q.s{axis} - floor(q.s{axis})) END)"
    place = lambda axis, last: f"least(greatest({p.floor(f'q.s{axis}')} + e.d{axis}, 0), {last}) AS j{axis}"
    wide = f"(SELECT q.image_id, q.y, q.x, q.i, {place('x', p.width - 1)}, {place('y', p.height - 1)}, CAST(floor({part('x')} * {part('y')} * 16777216e0 + 0.5e0) AS BIGINT) AS w FROM {at} q CROSS JOIN {corners})"
    sums = ", ".join(f"least(255, {p.shr(f'CAST(sum(n.w * t.{c}) AS BIGINT) + 8388608', 24)}) AS {c}" for c in CHANNELS)
    each = f"(SELECT n.image_id, n.y, n.x, n.i, {sums} FROM {wide} n JOIN ({p.sql}) t ON t.image_id = n.image_id AND t.y = n.jy AND t.x = n.jx GROUP BY n.image_id, n.y, n.x, n.i)"
    body = ", ".join(f"{p.div(f'CAST(sum({c}) AS BIGINT) + {len(rows) // 2}', str(len(rows)))} AS {c}" for c in CHANNELS)
    return p.of(f"SELECT image_id, y, x, {body} FROM {each} v GROUP BY image_id, y, x")


def _along(strength: float) -> list[float]:
    """Places from -1/2 to 1/2, one more than the rounded strength, at most 129."""
    n = min(128, max(1, int(strength + 0.5)))
    return [i / n - 0.5 for i in range(n + 1)]


def _from_middle(p: Pixels) -> tuple[str, str]:
    """Distances of a sample's place from half the extents, which is half a pixel behind the middle one."""
    return f"(g.x - {num(p.width / 2)})", f"(g.y - {num(p.height / 2)})"


def motion_blur(p: Pixels, length: float, angle: float) -> Pixels:
    """The mean along a line."""
    check(length >= 0, "motion blur")
    if not length:
        return p
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return _trail(p, ["ax", "ay"], [(c * t * length, s * t * length) for t in _along(length)], "g.x + k.ax", "g.y + k.ay")


def radial_blur(p: Pixels, degrees: float) -> Pixels:
    """The mean along an arc around the middle."""
    check(degrees >= 0, "radial blur")
    if not degrees:
        return p
    dx, dy = _from_middle(p)
    turns = [math.radians(t * degrees) for t in _along(degrees)]
    return _trail(p, ["c", "s"], [(math.cos(t), math.sin(t)) for t in turns], f"{num(p.width / 2)} + {dx} * k.c - {dy} * k.s", f"{num(p.height / 2)} + {dx} * k.s + {dy} * k.c")


def zoom_blur(p: Pixels, strength: float) -> Pixels:
    """The mean along a ray from the middle, to both sides of a place; one per cent of the way for each unit of strength."""
    check(strength >= 0, "zoom blur")
    if not strength:
        return p
    dx, dy = _from_middle(p)
    return _trail(p, ["z"], [(1 + t * strength / 100,) for t in _along(strength)], f"{num(p.width / 2)} + {dx} * k.z", f"{num(p.height / 2)} + {dy} * k.z")


def chromatic_aberration(p: Pixels, amount: float) -> Pixels:
    """Red is sampled further out, blue further in, by amount over the half diagonal."""
    from pixelmill.operators.stencil import paired

    dx, dy = _from_middle(p)
    k = abs(amount) / math.hypot(p.width / 2, p.height / 2)
    move = lambda f: warp(p, p.width, p.height, f"g.x + {dx} * {num(f)}", f"g.y + {dy} * {num(f)}", clamp_edges=True)
    red = p.of(f"SELECT image_id, y, x, o_r AS r, g, b, a FROM {paired(p, move(k))} u")
    return p.of(f"SELECT image_id, y, x, r, g, o_b AS b, a FROM {paired(red, move(-k))} u")
