"""Operators that first measure an image: an aggregate by image, joined back to its pixels."""

from __future__ import annotations

from pixelmill.operators import stencil, tone
from pixelmill.functions import color as C
from pixelmill.functions.color import check
from pixelmill.relation import COLORS, Pixels, clamp, luma, num



def histogram(p: Pixels, channel: str = "luma") -> str:
    """image_id, v, n for all 256 levels of a channel or of luma."""
    v = luma() if channel == "luma" else channel
    counted = f"(SELECT image_id, {v} AS v, count(*) AS n FROM ({p.sql}) t GROUP BY 1, 2)"
    ids = f"(SELECT DISTINCT image_id FROM ({p.sql}) t)"
    return f"SELECT i.image_id, l.i AS v, coalesce(c.n, 0) AS n FROM {ids} i CROSS JOIN {p.series(256, 'l')} LEFT JOIN {counted} c ON c.image_id = i.image_id AND c.v = l.i"


def clip_range(p: Pixels, channel: str, fraction: float = 0.005) -> str:
    """image_id, lo, hi: from each end the first level at which the running count exceeds a fraction; 0, 255 if degenerate."""
    v = luma() if channel == "luma" else channel
    counted = f"(SELECT image_id, {v} AS v, count(*) AS n FROM ({p.sql}) t GROUP BY 1, 2)"
    runs = (
        f"(SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS up, sum(n) OVER (PARTITION BY image_id ORDER BY v DESC) AS down, "
        f"sum(n) OVER (PARTITION BY image_id) AS total FROM {counted} c)"
    )
    ends = f"(SELECT image_id, min(CASE WHEN up > total * {num(fraction)} THEN v END) AS lo, max(CASE WHEN down > total * {num(fraction)} THEN v END) AS hi FROM {runs} r GROUP BY image_id)"
    return f"(SELECT image_id, CASE WHEN lo < hi THEN lo ELSE 0 END AS lo, CASE WHEN lo < hi THEN hi ELSE 255 END AS hi FROM {ends} e)"


def _stretch(p: Pixels, c: str, lo: str, hi: str) -> str:
    return p.round8(f"255e0 * least(1e0, greatest(0e0, ({c} - {lo}) * 1e0 / ({hi} - {lo})))")


def auto_contrast(p: Pixels) -> Pixels:
    body = ", ".join(f"{_stretch(p, f't.{c}', 'k.lo', 'k.hi')} AS {c}" for c in COLORS)
    return p.of(f"SELECT t.image_id, t.y, t.x, {body}, t.a FROM ({p.sql}) t JOIN {clip_range(p, 'luma')} k ON k.image_id = t.image_id")


def auto_levels(p: Pixels, fraction: float = 0.005) -> Pixels:
    """Each colour stretched by a range of its own; the three histograms come from one pass."""
    pick = "CASE k.c WHEN 0 THEN t.r WHEN 1 THEN t.g ELSE t.b END"
    counted = f"(SELECT t.image_id, k.c, {pick} AS v, count(*) AS n FROM ({p.sql}) t CROSS JOIN {p.values(['c'], [(0,), (1,), (2,)], 'k')} GROUP BY t.image_id, k.c, {pick})"
    part = "OVER (PARTITION BY image_id, c"
    runs = f"(SELECT image_id, c, v, sum(n) {part} ORDER BY v) AS up, sum(n) {part} ORDER BY v DESC) AS down, sum(n) {part}) AS total FROM {counted} h)"
    ends = f"(SELECT image_id, c, min(CASE WHEN up > total * {num(fraction)} THEN v END) AS lo, max(CASE WHEN down > total * {num(fraction)} THEN v END) AS hi FROM {runs} r GROUP BY image_id, c)"
    wide = ", ".join(f"max(CASE WHEN c = {i} THEN CASE WHEN lo < hi THEN lo ELSE 0 END END) AS lo_{c}, max(CASE WHEN c = {i} THEN CASE WHEN lo < hi THEN hi ELSE 255 END END) AS hi_{c}" for i, c in enumerate(COLORS))
    ranges = f"(SELECT image_id, {wide} FROM {ends} e GROUP BY image_id)"
    body = ", ".join(f"{_stretch(p, f't.{c}', f'k.lo_{c}', f'k.hi_{c}')} AS {c}" for c in COLORS)
    return p.of(f"SELECT t.image_id, t.y, t.x, {body}, t.a FROM ({p.sql}) t JOIN {ranges} k ON k.image_id = t.image_id")


def _means(p: Pixels) -> str:
    """Pixels beside the means of their image; the aggregate is combined by map tasks and joined back."""
    means = ", ".join(f"CAST(sum({c}) AS DOUBLE) / count(*) AS m_{c}" for c in COLORS)
    small = f"(SELECT image_id, {means}, CAST(sum({luma()}) AS DOUBLE) / count(*) AS m_l FROM ({p.sql}) t GROUP BY image_id)"
    return f"(SELECT t.*, k.m_r, k.m_g, k.m_b, k.m_l FROM ({p.sql}) t JOIN {small} k ON k.image_id = t.image_id)"


def _gain(p: Pixels, c: str, factor: str) -> str:
    """A sample times a positive factor in 16.16, rounded, clamped."""
    return clamp(p.shr(f"{c} * {p.floor(f'({factor}) * 65536e0 + 0.5e0')} + 32768", 16))


def auto_brightness(p: Pixels) -> Pixels:
    """Mean luma to 127.5 by a factor; an image darker than 1 stays."""
    body = ", ".join(f"CASE WHEN m_l < 1e0 THEN {c} ELSE {_gain(p, c, 'CASE WHEN m_l < 1e0 THEN 1e0 ELSE 127.5e0 / m_l END')} END AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {_means(p)} u")


def auto_gamma(p: Pixels) -> Pixels:
    """Gamma ln(0.5) / ln(mean / 255); images that are all black or all white stay."""
    flat = "(m_l <= 0e0 OR m_l >= 255e0)"
    g = f"(ln(0.5e0) / ln(CASE WHEN {flat} THEN 0.5e0 ELSE m_l / 255e0 END))"
    value = lambda c: p.round8(f"round(255e0 * pow({c} / 255e0, {g}), 6)")
    body = ", ".join(f"CASE WHEN {flat} THEN {c} ELSE {value(c)} END AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {_means(p)} u")


def auto_color(p: Pixels) -> Pixels:
    """Grey world: each channel's mean to the mean of the three; an image with a mean below 1 stays as a whole."""
    dark = f"(least({', '.join(f'm_{c}' for c in COLORS)}) < 1e0)"
    factor = lambda c: f"CASE WHEN {dark} THEN 1e0 ELSE (m_r + m_g + m_b) / 3e0 / m_{c} END"
    body = ", ".join(f"CASE WHEN {dark} THEN {c} ELSE {_gain(p, c, factor(c))} END AS {c}" for c in COLORS)
    return p.of(f"SELECT image_id, y, x, {body}, a FROM {_means(p)} u")


def improve(p: Pixels) -> Pixels:
    return tone.matrix(auto_color(auto_levels(p)), C.saturation(1.1))


def shadows_highlights(p: Pixels, shadows: float, highlights: float) -> Pixels:
    p = tone.curve(p, "fill_light", shadows)
    return tone.curve(p, "levels", 0, 255, 1, 0, 255 - 40 * highlights)


def dehaze(p: Pixels, strength: float) -> Pixels:
    """Dark channel prior: transmission from the eroded least colour, one airlight for all colours from the haziest pixels.

    The haziest are all pixels at or above the level that a thousandth of them (and one) reach from above.
    """
    check(0 <= strength <= 1, "dehaze")
    patch = max(3, min(p.width, p.height) // 32) // 2
    dark = stencil.erode(p.select(*[f"least({', '.join(COLORS)})"] * 3), patch)
    pair = stencil.paired(p, dark, "d_")
    gray = " + ".join(f"{num(w)} * {c}" for w, c in zip(C.LUMA, COLORS, strict=True))
    # luma in billionths: a sum of integers is the same in any order
    counted = f"(SELECT image_id, d_r, count(*) AS n, sum({p.floor(f'({gray}) * 1e9 + 0.5e0')}) AS lit FROM {pair} q GROUP BY image_id, d_r)"
    runs = f"(SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY d_r DESC) - n AS above FROM {counted} h)"
    light = f"(SELECT image_id, greatest(1e0, CAST(sum(lit) AS DOUBLE) / 1e9 / CAST(sum(n) AS DOUBLE)) AS l FROM {runs} r WHERE above < {p.div(str(p.width * p.height), '1000')} + 1 GROUP BY image_id)"
    t = f"greatest(0.1e0, 1e0 - {num(strength * 0.95)} * q.d_r / k.l)"
    body = ", ".join(f"{p.round8(f'(q.{c} - k.l) / ({t}) + k.l')} AS {c}" for c in COLORS)
    return p.of(f"SELECT q.image_id, q.y, q.x, {body}, q.a FROM {pair} q JOIN {light} k ON k.image_id = q.image_id")
