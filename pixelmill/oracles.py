"""DuckDB queries written by hand for registered raster queries, apart from the operators that they check.

Nothing here calls an operator: shapes are lists of places worked out on paper, taps and source places are computed in
SQL, and formulas are written from the semantics.  Only the pictures themselves (``fixture``) are shared.
"""

from __future__ import annotations

import math
import re

from pixelmill.relation import fixture

_PX = fixture("duck").sql
_C = ("r", "g", "b", "a")
_RED, _SEA = (200, 40, 30), (20, 120, 160)

# blending

#: Modes of two opaque samples, source s and destination d.
_MIX = {
    "normal": "s",
    "multiply": "(s * d + 127) // 255",
    "screen": "255 - ((255 - s) * (255 - d) + 127) // 255",
    "overlay": "CASE WHEN d <= 127 THEN (2 * s * d + 127) // 255 ELSE 255 - (2 * (255 - s) * (255 - d) + 127) // 255 END",
    "hard_light": "CASE WHEN s <= 127 THEN (2 * s * d + 127) // 255 ELSE 255 - (2 * (255 - s) * (255 - d) + 127) // 255 END",
    "darken": "least(s, d)",
    "lighten": "greatest(s, d)",
    "difference": "abs(s - d)",
    "exclusion": "s + d - (2 * s * d + 127) // 255",
    "add": "least(255, s + d)",
    "subtract": "greatest(0, d - s)",
    "soft_light": """CAST(floor(0.5e0 + 255e0 * CASE WHEN s / 255e0 <= 0.5e0 THEN d / 255e0 - (1e0 - 2e0 * s / 255e0) * (d / 255e0) * (1e0 - d / 255e0)
 WHEN d / 255e0 <= 0.25e0 THEN d / 255e0 + (2e0 * s / 255e0 - 1e0) * (((16e0 * d / 255e0 - 12e0) * d / 255e0 + 4e0) * d / 255e0 - d / 255e0)
 ELSE d / 255e0 + (2e0 * s / 255e0 - 1e0) * (sqrt(d / 255e0) - d / 255e0) END) AS BIGINT)""",
}


def _layer(rel: str, mode: str = "normal") -> str:
    """Rows with a source sr, sg, sb and its alpha al (null or 0 where there is none) laid over r, g, b, a."""

    def color(c: str) -> str:
        if mode == "replace":
            return f"s{c}"
        mix = re.sub(r"\b[sd]\b", lambda m: f"s{c}" if m[0] == "s" else c, _MIX[mode])
        return f"least(255, (al * (255 - a) * s{c} + al * a * ({mix}) + (255 - al) * a * {c} + (255 * o) // 2) // (255 * o))"

    body = ", ".join(f"CASE WHEN coalesce(al, 0) <= 0 THEN {c} ELSE {color(c)} END AS {c}" for c in "rgb")
    alpha = "al" if mode == "replace" else "o"
    return f"SELECT image_id, y, x, {body}, CASE WHEN coalesce(al, 0) <= 0 THEN a ELSE {alpha} END AS a FROM (SELECT *, (al * 255 + a * (255 - al) + 127) // 255 AS o FROM ({rel}) q) w"


def _shape(where: str, color: tuple[int, ...], mode: str = "normal", rel: str = _PX) -> str:
    r, g, b, a = color
    return _layer(f"SELECT *, {r} AS sr, {g} AS sg, {b} AS sb, CASE WHEN {where} THEN {a} ELSE 0 END AS al FROM ({rel}) p", mode)


def _rows(rows: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN y = {y} THEN {test}" for y, test in rows.items()) + " ELSE false END"


def _stamp(source: str, mode: str, u: str = "x", v: str = "y", opacity: int = 255) -> str:
    """A picture over another: the source's sample at (u, v) of each place (x, y)."""
    return _layer(f"SELECT p.*, q.r AS sr, q.g AS sg, q.b AS sb, q.a * {opacity} // 255 AS al FROM (SELECT *, {u} AS u, {v} AS v FROM ({_PX}) z) p LEFT JOIN ({source}) q ON q.image_id = p.image_id AND q.x = p.u AND q.y = p.v", mode)


_FLIPPED = f"SELECT image_id, y, 7 - x AS x, r, g, b, a FROM ({_PX}) p"
_TURNED = f"SELECT image_id, x AS y, 7 - y AS x, r, g, b, a FROM ({_PX}) p"
_THICK = "(SELECT min(power(x - 7 * t, 2) + power(y - 1 - 5 * t, 2)) FROM (SELECT least(1e0, greatest(0e0, (x * 7 + (y - 1) * 5) / 74e0)) AS t) k) <= 2.25e0"
_DISC = {1: "x = 4", 2: "x BETWEEN 2 AND 6", 3: "x BETWEEN 2 AND 6", 4: "x BETWEEN 1 AND 7", 5: "x BETWEEN 2 AND 6", 6: "x BETWEEN 2 AND 6", 7: "x = 4"}
_RING = {1: "x = 4", 2: "x IN (2, 3, 5, 6)", 3: "x IN (2, 6)", 4: "x IN (1, 7)", 5: "x IN (2, 6)", 6: "x IN (2, 3, 5, 6)", 7: "x = 4"}
_OVAL = {1: "x = 4", 2: "x BETWEEN 1 AND 7", 3: "x BETWEEN 0 AND 8", 4: "x BETWEEN 1 AND 7", 5: "x = 4"}
_OVAL_RIM = {1: "x = 4", 2: "x IN (1, 2, 3, 5, 6, 7)", 3: "x = 0", 4: "x IN (1, 2, 3, 5, 6, 7)", 5: "x = 4"}
_STAR_RIM = {0: "x = 4", 1: "x = 4", 2: "true", 3: "x IN (1, 3, 5, 6)", 4: "x IN (2, 4, 5)", 5: "x IN (2, 3, 4, 5)", 6: "x IN (1, 2, 5, 6)", 7: "x IN (1, 6)"}
_STAR = {0: "x = 4", 1: "x = 4", 2: "x <> 4", 3: "x IN (2, 5)", 4: "x = 5", 5: "x BETWEEN 2 AND 5", 6: "x IN (2, 5)"}
_STAR_FULL = {0: "x = 4", 1: "x = 4", 2: "true", 3: "x BETWEEN 2 AND 5", 4: "x IN (3, 4, 5)", 5: "x BETWEEN 2 AND 5", 6: "x IN (2, 5)"}

_DRAWING = {
    "hline": _shape("y = 3 AND x BETWEEN 1 AND 6", (*_RED, 128)),
    "vline": _shape("x = 2 AND y <= 5", (*_RED, 255)),
    "rectangle": _shape("x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5 AND NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 4)", (*_SEA, 200)),
    "fill_rect": _shape("x <= 3 AND y BETWEEN 2 AND 5", (*_SEA, 90)),
    "fill_rounded": _shape(_rows({0: "x BETWEEN 1 AND 6", **dict.fromkeys(range(1, 6), "true"), 6: "x BETWEEN 1 AND 6"}), (*_RED, 255)),
    "line_thin": _shape("(x, y) IN ((0, 1), (1, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6))", (*_RED, 255)),
    "line_thick": _shape(_THICK, (*_RED, 160)),
    "fill_circle": _shape(_rows(_DISC), (*_SEA, 255)),
    "draw_circle": _shape(_rows(_RING), (*_SEA, 255)),
    "fill_ellipse": _shape(_rows(_OVAL), (*_RED, 77)),
    "draw_ellipse": _shape(_rows(_OVAL_RIM), (*_RED, 255)),
    "polygon_outline": _shape(_rows(_STAR_RIM), (*_RED, 255)),
    "polygon_even_odd": _shape(_rows(_STAR), (*_RED, 255)),
    "polygon_nonzero": _shape(_rows(_STAR_FULL), (*_RED, 200), "multiply"),
    "crop_polygon": f"SELECT image_id, y, x, {', '.join(f'CASE WHEN {_rows(_STAR)} THEN {c} ELSE 0 END AS {c}' for c in _C)} FROM ({_PX}) p",
    "border": _shape("NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)", (*_RED, 255)),
    "draw_coverage": _layer(f"SELECT *, 200 AS sr, 40 AS sg, 30 AS sb, CASE WHEN x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4 THEN 220 * ((40 * (x - 2) + 60 * (y - 1)) % 256) // 255 ELSE 0 END AS al FROM ({_PX}) p"),
    **{f"blend_{m}": _stamp(_FLIPPED, m) for m in [*_MIX, "replace"]},
    "draw_tile": _stamp(_PX, "normal", "(x + 2) % 3", "(y + 1) % 3", 179),
    "draw_center": _stamp(f"SELECT image_id, y - 1 AS y, x - 1 AS x, r, g, b, a FROM ({_PX}) p WHERE x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4", "screen", "x - 2", "y - 2"),
    "draw_once": _stamp(_TURNED, "normal", "x - 3", "y + 2", 128),
    "is_transparent": f"SELECT DISTINCT image_id, 1 AS transparent FROM ({_PX}) p",
}


def _ramp(t: str, start: tuple[int, ...], end: tuple[int, ...]) -> str:
    body = ", ".join(f"floor({s} + t * ({e - s}) + 0.5e0) AS {c}" for c, s, e in zip(_C, start, end, strict=True))
    return f"SELECT image_id, y, x, {body} FROM (SELECT *, {t} AS t FROM ({_PX}) p) q"


_COS30, _SIN30 = math.cos(math.radians(30)), math.sin(math.radians(30))
_GRADIENTS = {
    "gradient_linear": _ramp("(x * 7 + y * 7) / 98e0", (*_RED, 255), (*_SEA, 0)),
    "gradient_radial": _ramp("least(1e0, sqrt(power(x - 4, 2) + power(y - 4, 2)) / 4e0)", (*_RED, 255), (*_SEA, 128)),
    "gradient_fade": f"SELECT image_id, y, x, r, g, b, floor(a * (1e0 - least(1e0, greatest(0e0, ((x * {_COS30!r}::DOUBLE + y * {_SIN30!r}::DOUBLE) / {8 * _COS30 + 8 * _SIN30 - 1!r}::DOUBLE - 0.2e0) / 0.7e0))) + 0.5e0) AS a FROM ({_PX}) p",
}


# resampling


def _taps(n: int, count: int, kind: str, origin: float, extent: float, name: str) -> str:
    """o (output), j (sample), w (16.16), one (whether it is the only sample), computed for every pair by its distance."""
    step = extent / count
    scale, radius = max(1.0, step), {"box": 0.5, "bilinear": 1.0, "catmull_rom": 2.0, "nearest": 0.5}[kind]
    low, high = max(0, math.floor(origin)), min(n, math.ceil(origin + extent)) - 1
    middle, reach = f"({origin}::DOUBLE + (o + 0.5e0) * {step!r}::DOUBLE)", f"{radius * scale!r}::DOUBLE"
    weight = {
        "nearest": "1e0",
        "box": f"greatest(0e0, least(m + {reach}, j + 1) - greatest(m - {reach}, j))",
        "bilinear": "greatest(0e0, 1e0 - t)",
        "catmull_rom": "CASE WHEN t < 1 THEN 1.5e0 * t * t * t - 2.5e0 * t * t + 1 WHEN t < 2 THEN -0.5e0 * t * t * t + 2.5e0 * t * t - 4 * t + 2 ELSE 0e0 END",
    }[kind]
    within = f"j = least({high}, greatest({low}, floor(m)))" if kind == "nearest" else f"j + 0.5e0 >= m - {reach} AND j + 0.5e0 <= m + {reach}"
    raw = f"SELECT o, j, {weight} AS v FROM (SELECT *, abs(j + 0.5e0 - m) / {scale!r}::DOUBLE AS t FROM (SELECT o, j, {middle} AS m FROM range({count}) o_(o), range({low}, {high + 1}) j_(j)) a WHERE {within}) b"
    fixed = f"SELECT o, j, CAST(trunc(v / sum(v) OVER (PARTITION BY o) * 65536 + 0.5e0 * sign(v)) AS BIGINT) AS f FROM ({raw}) c"
    full = f"SELECT o, j, f + CASE WHEN row_number() OVER (PARTITION BY o ORDER BY f DESC, j) = 1 THEN 65536 - sum(f) OVER (PARTITION BY o) ELSE 0 END AS w FROM ({fixed}) d"
    return f"(SELECT o, j, w, count(*) OVER (PARTITION BY o) = 1 AS one FROM ({full}) e WHERE w <> 0) {name}"


def _resized(rel: str, w: int, h: int, width: int, height: int, kind: str, window: tuple[float, float, float, float] | None = None) -> str:
    """``rel`` of extent w x h; one sum over both axes."""
    ox, oy, ex, ey = window or (0.0, 0.0, float(w), float(h))
    kinds = [("box" if e / n >= 1 else "catmull_rom") if kind == "auto" else kind for e, n in ((ex, width), (ey, height))]
    x, y = _taps(w, width, kinds[0], ox, ex, "u"), _taps(h, height, kinds[1], oy, ey, "v")
    sums = ", ".join(f"sum(CASE WHEN u.one AND v.one THEN p.{c} ELSE p.{c} * p.a // 255 END * u.w * v.w) AS {c}" for c in "rgb")
    sums = f"SELECT p.image_id, v.o AS y, u.o AS x, bool_and(u.one AND v.one) AS one, {sums}, sum(p.a * u.w * v.w) AS a FROM ({rel}) p JOIN {x} ON u.j = p.x JOIN {y} ON v.j = p.y GROUP BY ALL"
    whole = f"SELECT image_id, y, x, one, {', '.join(f'least(255, greatest(0, (CAST({c} AS BIGINT) + 2147483648) >> 32)) AS {c}' for c in _C)} FROM ({sums}) s"
    body = ", ".join(f"CASE WHEN NOT one AND a BETWEEN 1 AND 254 THEN least(255, ({c} * 255 + a // 2) // a) ELSE {c} END AS {c}" for c in "rgb")
    return f"SELECT image_id, y, x, {body}, a FROM ({whole}) t"


def _cut(rel: str, x: int, y: int, w: int, h: int) -> str:
    return f"SELECT image_id, y - {y} AS y, x - {x} AS x, r, g, b, a FROM ({rel}) c WHERE x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1}"


def _canvas(rel: str, w: int, h: int, left: int, top: int, fill: tuple[int, ...] = (1, 2, 3, 255)) -> str:
    body = ", ".join(f"coalesce(c.{k}, {v}) AS {k}" for k, v in zip(_C, fill, strict=True))
    return f"SELECT i.image_id, gy.y, gx.x, {body} FROM (SELECT DISTINCT image_id FROM ({_PX}) p) i CROSS JOIN range({h}) gy(y) CROSS JOIN range({w}) gx(x) LEFT JOIN ({rel}) c ON c.image_id = i.image_id AND c.x = gx.x - {left} AND c.y = gy.y - {top}"


_OPAQUE = f"SELECT image_id, y, x, r, g, b, 255 AS a FROM ({_PX}) p"
_WIDE = _cut(_PX, 0, 0, 8, 5)  # 8 x 5, to be fitted into 6 x 6 and 4 x 4
_COVER6, _COVER4 = _resized(_WIDE, 8, 5, 10, 6, "auto"), _resized(_WIDE, 8, 5, 6, 4, "auto")
_INSIDE = _resized(_WIDE, 8, 5, 6, 4, "auto")
_RESIZING = {
    "resize_nearest": _resized(_PX, 8, 8, 5, 11, "nearest"),
    "resize_box_half": _resized(_PX, 8, 8, 4, 4, "box"),
    "resize_box_5": _resized(_PX, 8, 8, 5, 5, "box"),
    "resize_bilinear_16": _resized(_OPAQUE, 8, 8, 16, 16, "bilinear"),
    "resize_catmull_16": _resized(_OPAQUE, 8, 8, 16, 12, "catmull_rom"),
    "resize_auto": _resized(_PX, 8, 8, 12, 3, "auto"),
    "resize_window": _resized(_OPAQUE, 8, 8, 6, 6, "auto", (1.5, 0.5, 5.0, 6.0)),
    "zoom": _resized(_PX, 8, 8, 12, 12, "auto"),
    "fit_scale_down": _INSIDE,  # 6 / 8 of 8 x 5 is 6 x 3.75
    "fit_contain": _INSIDE,
    "fit_pad": _canvas(_INSIDE, 6, 6, 0, 1),
    "fit_scale_up": _WIDE,  # never below its own size
    "fit_stretch": _resized(_WIDE, 8, 5, 6, 6, "auto"),
    "fit_cover": _cut(_COVER6, 2, 0, 6, 6),  # 6 / 5 of 8 x 5 is 9.6 x 6
    "fit_fill": _cut(_COVER6, 2, 0, 6, 6),
    "fit_crop": _cut(_WIDE, 1, 0, 6, 5),
    "fit_aspect_crop": _cut(_WIDE, 1, 0, 6, 5),
    "fit_aspect_cover": _cut(_WIDE, 1, 0, 5, 5),
    "fit_aspect_contain": _canvas(_WIDE, 8, 8, 0, 1),
    # 4 / 5 of 8 x 5 is 6.4 x 4: two columns to spare
    **{f"gravity_{g}": _cut(_COVER4, {"w": 0, "e": 2}.get(g[-1] if g != "center" else "", 1), 0, 4, 4) for g in ("center", "n", "s", "w", "e", "nw", "ne", "sw", "se")},
}


# places of samples


def _sampled(at: str, edges: bool, fill: tuple[int, ...] = (0, 0, 0, 0)) -> str:
    """Rows (image_id, y, x, sx, sy, ...) with sx and sy in samples; the four neighbours' weights are in 2 ** -24."""
    fx, fy = "(sx - floor(sx))", "(sy - floor(sy))"
    near = lambda i, e: f"least(7, greatest(0, CAST(floor(s{i}) AS BIGINT) + {e}))"
    parts, joins = {c: [] for c in _C}, []
    for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        w = f"CAST(floor(({fx if i else f'(1e0 - {fx})'}) * ({fy if j else f'(1e0 - {fy})'}) * 16777216e0 + 0.5e0) AS BIGINT)"
        joins.append(f"JOIN px n{k} ON n{k}.image_id = q.image_id AND n{k}.x = {near('x', i)} AND n{k}.y = {near('y', j)}")
        for c in _C:
            parts[c].append(f"{w} * n{k}.{c}")
    outside = "false" if edges else "sx < -0.5e0 OR sy < -0.5e0 OR sx >= 7.5e0 OR sy >= 7.5e0"
    body = ", ".join(f"CASE WHEN {outside} THEN {f} ELSE least(255, ({' + '.join(parts[c])} + 8388608) >> 24) END AS {c}" for c, f in zip(_C, fill, strict=True))
    return f"SELECT q.* EXCLUDE (sx, sy), {body} FROM ({at}) q {' '.join(joins)}"


def _warped(w: int, h: int, sx: str, sy: str, fill: tuple[int, ...] = (0, 0, 0, 0)) -> str:
    """``sx``, ``sy``: the continuous source place of the continuous output place (u, v)."""
    at = f"SELECT image_id, y, x, round({sx} - 0.5e0, 9) AS sx, round({sy} - 0.5e0, 9) AS sy FROM (SELECT i.image_id, gy.y, gx.x, gx.x + 0.5e0 AS u, gy.y + 0.5e0 AS v FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range({h}) gy(y) CROSS JOIN range({w}) gx(x)) g"
    return f"WITH px AS MATERIALIZED ({_PX}) SELECT image_id, y, x, r, g, b, a FROM ({_sampled(at, False, fill)}) z"


def _mean(n: int, sx: str, sy: str) -> str:
    """The rounded mean of n + 1 samples at places of the pixel's index, t from -1/2 to 1/2."""
    at = f"SELECT image_id, y, x, k, round({sx}, 9) AS sx, round({sy}, 9) AS sy FROM (SELECT p.image_id, p.y, p.x, k, k / {float(n)}e0 - 0.5e0 AS t FROM px p CROSS JOIN range({n + 1}) k_(k)) g"
    body = ", ".join(f"(sum({c}) + {(n + 1) // 2}) // {n + 1} AS {c}" for c in _C)
    return f"WITH px AS MATERIALIZED ({_PX}) SELECT image_id, y, x, {body} FROM ({_sampled(at, True)}) z GROUP BY ALL"


def _split(k: float) -> str:
    moved = lambda sign: _sampled(f"SELECT image_id, y, x, round(x {sign} (x - 4) * {k!r}::DOUBLE, 9) AS sx, round(y {sign} (y - 4) * {k!r}::DOUBLE, 9) AS sy FROM px", True)
    return f"WITH px AS MATERIALIZED ({_PX}) SELECT p.image_id, p.y, p.x, o.r, p.g, i.b, p.a FROM px p JOIN ({moved('+')}) o USING (image_id, y, x) JOIN ({moved('-')}) i USING (image_id, y, x)"


_SPAN = math.hypot(4, 4)
_FAR = "sqrt((u - 4) * (u - 4) + (v - 4) * (v - 4))"
_TURN = f"({math.radians(60)!r}::DOUBLE * power(greatest(0e0, 1e0 - {_FAR} / {_SPAN!r}::DOUBLE), 2))"
_BENT = f"(1e0 + 0.2e0 * ({_FAR} / {_SPAN!r}::DOUBLE) * ({_FAR} / {_SPAN!r}::DOUBLE))"
_ANGLE = f"(u * {math.pi / 4!r}::DOUBLE - {math.pi!r}::DOUBLE)"
_RADIUS = f"(v / 8e0 * {_SPAN!r}::DOUBLE)"
_DEGREE = f"(t * 20e0 * {math.pi / 180!r}::DOUBLE)"
_WARPS = {
    # 8 (cos 30 + sin 30) + 0.5 is 11.4
    "rotate_free": _warped(11, 11, f"4 + {_COS30!r}::DOUBLE * (u - 5.5e0) + {_SIN30!r}::DOUBLE * (v - 5.5e0)", f"4 - {_SIN30!r}::DOUBLE * (u - 5.5e0) + {_COS30!r}::DOUBLE * (v - 5.5e0)", (10, 20, 30, 255)),
    # 8 + 0.3 8 + 0.5 and 8 + 0.1 8 + 0.5; the determinant is 0.97
    "shear": _warped(10, 9, "(u - 0.3e0 * v) / 0.97e0", "(v - 0.1e0 * u) / 0.97e0"),
    "arc": _warped(8, 9, "u", "v - 60e0 / 180 * 4 * power((u - 4) / 4, 2)"),
    "barrel": _warped(8, 8, f"4 + (u - 4) * {_BENT}", f"4 + (v - 4) * {_BENT}"),
    "swirl": _warped(8, 8, f"4 + (u - 4) * cos({_TURN}) - (v - 4) * sin({_TURN})", f"4 + (u - 4) * sin({_TURN}) + (v - 4) * cos({_TURN})"),
    "polar": _warped(8, 8, f"(atan2(u - 4, 4 - v) + {math.pi!r}::DOUBLE) / {2 * math.pi!r}::DOUBLE * 8", f"{_FAR} / {_SPAN!r}::DOUBLE * 8"),
    "polar_inverse": _warped(8, 8, f"4 + {_RADIUS} * sin({_ANGLE})", f"4 - {_RADIUS} * cos({_ANGLE})"),
    "motion_blur": _mean(3, f"x + t * 3e0 * {math.cos(math.radians(20))!r}::DOUBLE", f"y + t * 3e0 * {math.sin(math.radians(20))!r}::DOUBLE"),
    "radial_blur": _mean(20, f"4 + (x - 4) * cos({_DEGREE}) - (y - 4) * sin({_DEGREE})", f"4 + (x - 4) * sin({_DEGREE}) + (y - 4) * cos({_DEGREE})"),
    "zoom_blur": _mean(30, "4 + (x - 4) * (1 + t * 0.3e0)", "4 + (y - 4) * (1 + t * 0.3e0)"),
    "chromatic": _split(1.0 / _SPAN),
}


# neighbourhoods and measures


def _thirds(rel: str, w: int, h: int, across: bool) -> str:
    body = ", ".join(f"(sum(n.{c}) + 1) // 3 AS {c}" for c in _C)
    near = "n.x = least({}, greatest(0, p.x + k)) AND n.y = p.y".format(w - 1) if across else "n.y = least({}, greatest(0, p.y + k)) AND n.x = p.x".format(h - 1)
    return f"SELECT p.image_id, p.y, p.x, {body} FROM {rel} p CROSS JOIN range(-1, 2) k_(k) JOIN {rel} n ON n.image_id = p.image_id AND {near} GROUP BY ALL"


def _soft(rel: str, w: int = 8, h: int = 8, name: str = "px") -> str:
    """Common tables: ``name`` is the picture and ``soft`` its blur of sigma 1, three box blurs of three samples."""
    out, last = [f"{name} AS MATERIALIZED ({rel})"], name
    for i in range(6):
        now = "soft" if i == 5 else f"{name}_{i}"
        out.append(f"{now} AS MATERIALIZED ({_thirds(last, w, h, i % 2 == 0)})")
        last = now
    return "WITH " + ", ".join(out)


def _beside(form: str) -> str:
    return f"{_soft(_PX)} SELECT p.image_id, p.y, p.x, {', '.join(f'{form.format(c=f"p.{c}", o=f"s.{c}")} AS {c}' for c in 'rgb')}, p.a FROM px p JOIN soft s USING (image_id, y, x)"


_MEANS = f"SELECT image_id, sum(r)::DOUBLE / 64 AS mr, sum(g)::DOUBLE / 64 AS mg, sum(b)::DOUBLE / 64 AS mb, sum((13933 * r + 46871 * g + 4732 * b + 32768) >> 16)::DOUBLE / 64 AS ml FROM ({_PX}) p GROUP BY image_id"
_KERNEL = "(VALUES (-1, -1, -2), (0, -1, -1), (-1, 0, -1), (1, 0, 1), (0, 1, 1), (1, 1, 2)) k(dx, dy, w)"
_SHADE = _canvas(f"SELECT image_id, y, x, 0 AS r, 0 AS g, 0 AS b, a FROM ({_PX}) p", 17, 18, 5, 6, (0, 0, 0, 0))
_FRAMED = _canvas(_PX, 17, 18, 4, 4, (0, 0, 0, 0))
_VEILED = """dark AS (SELECT p.*, (SELECT min(least(n.r, n.g, n.b)) FROM px n WHERE n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1) AS veil FROM px p),
 top AS (SELECT image_id, max(veil) AS level FROM dark GROUP BY image_id),
 air AS (SELECT d.image_id, greatest(1e0, sum(CAST(floor((0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) * 1e9 + 0.5e0) AS BIGINT))::DOUBLE / 1e9 / count(*)) AS l FROM dark d JOIN top t ON t.image_id = d.image_id AND d.veil >= t.level GROUP BY d.image_id)"""
_MEASURED = {
    "emboss": f"SELECT p.image_id, p.y, p.x, {', '.join(f'least(255, greatest(0, sum(k.w * n.{c}) + 128)) AS {c}' for c in 'rgb')}, any_value(p.a) AS a FROM ({_PX}) p CROSS JOIN {_KERNEL} JOIN ({_PX}) n ON n.image_id = p.image_id AND n.x = least(7, greatest(0, p.x + k.dx)) AND n.y = least(7, greatest(0, p.y + k.dy)) GROUP BY p.image_id, p.y, p.x",
    "unsharp": _beside("CASE WHEN {c} - {o} > -3 AND {c} - {o} < 3 THEN {c} ELSE least(255, greatest(0, floor({c} + 0.8e0 * ({c} - {o}) + 0.5e0))) END"),
    "glow": _beside("least(255, floor(255e0 * ({c} / 255e0 + 0.6e0 * {o} / 255e0 - {c} / 255e0 * (0.6e0 * {o} / 255e0)) + 0.5e0))"),
    "drop_shadow": f"{_soft(_SHADE, 17, 18, 'shade')} " + _layer(f"SELECT s.*, q.r AS sr, q.g AS sg, q.b AS sb, q.a AS al FROM soft s JOIN ({_FRAMED}) q USING (image_id, y, x)"),
    "auto_color": f"SELECT image_id, y, x, {', '.join(f'CASE WHEN least(mr, mg, mb) < 1 THEN {c} ELSE least(255, ({c} * CAST(floor((mr + mg + mb) / 3e0 / m{c} * 65536e0 + 0.5e0) AS BIGINT) + 32768) >> 16) END AS {c}' for c in 'rgb')}, a FROM ({_PX}) p JOIN ({_MEANS}) m USING (image_id)",
    "auto_brightness": f"SELECT image_id, y, x, {', '.join(f'CASE WHEN ml < 1 THEN {c} ELSE least(255, ({c} * CAST(floor(127.5e0 / ml * 65536e0 + 0.5e0) AS BIGINT) + 32768) >> 16) END AS {c}' for c in 'rgb')}, a FROM ({_PX}) p JOIN ({_MEANS}) m USING (image_id)",
    "auto_gamma": f"SELECT image_id, y, x, {', '.join(f'CASE WHEN ml <= 0 OR ml >= 255 THEN {c} ELSE floor(round(255e0 * pow({c} / 255e0, ln(0.5e0) / ln(ml / 255e0)), 6) + 0.5e0) END AS {c}' for c in 'rgb')}, a FROM ({_PX}) p JOIN ({_MEANS}) m USING (image_id)",
    "dehaze": f"WITH px AS MATERIALIZED ({_PX}), {_VEILED} SELECT d.image_id, d.y, d.x, {', '.join(f'least(255, greatest(0, floor(({c} - l) / greatest(0.1e0, 1e0 - {0.7 * 0.95!r}::DOUBLE * veil / l) + l + 0.5e0))) AS {c}' for c in 'rgb')}, d.a FROM dark d JOIN air USING (image_id)",
}

_GRAY = "(13933 * r + 46871 * g + 4732 * b + 32768) >> 16"
_FACES = "(VALUES (3, 1, 1, 4, 5), (3, 5, 0, 3, 3), (9, 0, 0, 8, 8)) f(image_id, x, y, w, h)"
_CELLS = f"SELECT p.image_id, f.x AS fx, f.y AS fy, (p.x - f.x) // 3 AS i, (p.y - f.y) // 3 AS j, {', '.join(f'(sum({c}) + count(*) // 2) // count(*) AS {c}' for c in _C)} FROM ({_PX}) p JOIN {_FACES} ON f.image_id = p.image_id AND p.x BETWEEN f.x AND f.x + f.w - 1 AND p.y BETWEEN f.y AND f.y + f.h - 1 GROUP BY ALL"
# pixels of the third picture lie in one box at most: the first ends at x = 4, the second begins at x = 5
_OTHERS = {
    "convert_gray": f"SELECT image_id, y, x, {_GRAY} AS r, {_GRAY} AS g, {_GRAY} AS b, 255 AS a FROM ({_PX}) p",
    "convert_gray_alpha": f"SELECT image_id, y, x, {_GRAY} AS r, {_GRAY} AS g, {_GRAY} AS b, a FROM ({_PX}) p",
    "convert_rgb": f"SELECT image_id, y, x, r, g, b, 255 AS a FROM ({_PX}) p",
    "convert_spread": f"SELECT image_id, y, x, r, r AS g, r AS b, a FROM ({_PX}) p",
    "pixelate_boxes": f"SELECT p.image_id, p.y, p.x, {', '.join(f'coalesce(m.{c}, p.{c}) AS {c}' for c in _C)} FROM ({_PX}) p LEFT JOIN {_FACES} ON f.image_id = p.image_id AND p.x BETWEEN f.x AND f.x + f.w - 1 AND p.y BETWEEN f.y AND f.y + f.h - 1 LEFT JOIN ({_CELLS}) m ON m.image_id = f.image_id AND m.fx = f.x AND m.fy = f.y AND m.i = (p.x - f.x) // 3 AND m.j = (p.y - f.y) // 3",
    "dpr": _resized(_PX, 8, 8, 16, 16, "auto"),
}

#: Files that are read, cut, turned, inverted and written: columns 1 to 6 of rows 1 to 4, a quarter turn clockwise.
TRANSFORMED = f"SELECT image_id, x - 1 AS y, 4 - y AS x, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM ({_PX}) p WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 4"

_A = [(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 3)]  # the rows 01100, 10010, 11110, 10010
#: Lines of 5 rows, each 6 wide in a box of 7 from x = 1, to the right: "A" and "i." begin at x = 2; the fourth row of the second line is outside.
BOXED = [(y, x + 2) for y, x in _A] + [(5, 2), (7, 2)]
_OTHERS["draw_text_box"] = _shape(f"(y, x) IN ({', '.join(map(str, BOXED))})", (*_RED, 200))

#: Plain queries by name; they take the place of the operator's own twin.
HAND: dict[str, str] = {**_DRAWING, **_GRADIENTS, **_RESIZING, **_WARPS, **_MEASURED, **_OTHERS}
