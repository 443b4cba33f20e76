"""Registered queries: each applies operators to the fixture images and has a twin in the second dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelmill.functions import color as C
from pixelmill.functions import icc
from pixelmill.functions import spaces as S
from pixelmill.operators import analysis, auto, detect, display, draw, geometry, resample, stencil, text, tone
from pixelmill.oracles import HAND
from pixelmill.relation import Pixels, fixture, fixture_gray
from pixelmill.sources import registry

def _letters() -> text.FontSet:
    glyph = {"A": (5, ["01100", "10010", "11110", "10010"]), "i": (2, ["10", "00", "10", "10"]), ".": (2, ["00", "00", "00", "10"])}
    return text.FontSet(text.Font(4, 1, {ord(c): text.Glyph(w + 1, 0, 4, rows) for c, (w, rows) in glyph.items()}))


def _display() -> display.DisplayList:
    d = display.DisplayList().rect(20, 20, 5, 5, (1, 2, 3, 255)).ellipse(4, 4, 1, 1, (255, 0, 0, 255)).rect(2, 2, 5, 5, (10, 200, 30, 255))
    d.save().translate(1, 2).rotate(20).round_rect(0, 0, 5, 3, 1, (200, 0, 90, 160)).ellipse(3, 1, 2, 1, (0, 0, 255, 255)).restore()
    return d.blend("screen").polygon([0, 6, 3], [7, 7, 2], (90, 90, 0, 200), "nonzero").line(0, 0, 7, 3, 2, (255, 255, 255, 255))


Form = Callable[[Pixels], "Pixels | str"]


def flagship(p: Pixels) -> str:
    """Crop, halve by means, luma, histogram, the two most frequent levels of each image."""
    cut = geometry.crop(p, 2, 2, 4, 4)
    d = p.div
    half = ", ".join(f"{d(f'CAST(sum({c}) AS BIGINT) + 2', '4')} AS {c}" for c in "rgb")
    small = f"SELECT image_id, {d('y', '2')} AS y, {d('x', '2')} AS x, {half} FROM ({cut.sql}) c GROUP BY 1, 2, 3"
    levels = f"SELECT image_id, CAST(((13933 * r + 46871 * g + 4732 * b + 32768) >> 16) AS BIGINT) AS l, count(*) AS n FROM ({small}) s GROUP BY 1, 2"
    return f"SELECT image_id, l, n FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, l) AS k FROM ({levels}) v) w WHERE k <= 2"


def _m(name: str, *a) -> Form:
    return lambda p: tone.matrix(p, getattr(C, name)(*a))


def _c(kind: str, *a) -> Form:
    return lambda p: tone.curve(p, kind, *a)


RED, SEA = (200, 40, 30), (20, 120, 160)
STAR = ([0, 7, 1, 4, 6], [2, 2, 7, 0, 7])

FORMS: dict[str, Form] = {
    "flagship": flagship,
    # channels and alpha
    "to_gray": tone.to_gray, "set_opaque": tone.opaque, "flatten_white": tone.flatten, "opacity": lambda p: tone.opacity(p, 0.6),
    "premultiply": tone.premultiply, "unpremultiply": tone.unpremultiply, "is_transparent": analysis.is_transparent, "get_pixel": lambda p: analysis.get_pixel(p, 3, 4),
    # matrices
    "brightness": _m("brightness", 1.3), "contrast": _m("contrast", 1.4), "saturation": _m("saturation", 0.4), "grayscale": _m("saturation", 0.0), "hue": _m("hue", 75),
    "invert": _m("invert"), "sepia": lambda p: tone.matrix(p, C.square(C.SEPIA)), "blackwhite": _m("blackwhite"), "colorize": _m("colorize", RED, 0.5), "tint": _m("tint", SEA, 0.4),
    "duotone": _m("duotone", (10, 20, 60), (250, 230, 180)), "split_tone": _m("split_tone", SEA, RED, 0.4), "white_balance": _m("white_balance", 0.5, -0.2), "temperature": _m("white_balance", -0.4),
    "channel_gain": _m("gains", 1.2, 0.9, 1.05), "channel_mixer": lambda p: tone.matrix(p, C.square((0.5, 0.5, 0, 0, 1, 0, 0.2, 0, 0.8))), "color_overlay": _m("toward", SEA, 0.3),
    **{f"colorblind_{k}": _m("colorblind_simulate", k) for k in C.COLORBLIND}, **{f"colorblind_assist_{k}": _m("colorblind_assist", k) for k in C.COLORBLIND},
    "fused_matrices": lambda p: tone.stages(p, [("matrix", C.brightness(1.2)), ("matrix", C.contrast(0.8)), ("matrix", C.hue(30)), ("table", C.curve("gamma", 0.7)), ("table", C.curve("negate"))]),
    # tables
    "gamma": _c("gamma", 1.8), "posterize": _c("posterize", 5), "threshold": _c("threshold", 120), "solarize": _c("solarize", 100), "exposure": _c("exposure", 0.7), "levels": _c("levels", 20, 230, 1.3, 5, 250),
    "fill_light": _c("fill_light", 0.4), "gain": _c("gain", 1.25), "sigmoid": _c("sigmoid", 0.8), "negate": _c("negate"), "srgb_encode": _c("srgb", 1), "srgb_decode": _c("srgb", -1), "balance": _c("balance", 0.1, -0.05, 0.08),
    "curves": lambda p: tone.tables(p, *[C.points([0, 64, 192, 255], [10, 40, 220, 250])] * 3), "apply_luts": lambda p: tone.tables(p, C.curve("gamma", 2), None, C.curve("negate")),
    "levels_channel": lambda p: tone.levels_channel(p, 1, 10, 240, 0.9, 0, 255), "color_balance": lambda p: tone.color_balance(p, (0.1, 0, -0.1), (0, 0.05, 0), (-0.05, 0, 0.1)),
    **{f"preset_{k}": (lambda p, k=k: tone.preset(p, k)) for k in C.PRESETS},
    # other tone
    "vibrance": lambda p: tone.vibrance(p, 0.8), "replace_color": lambda p: tone.replace_color(p, (128, 128, 128, 128), (255, 0, 0, 255), (60, 60, 60, 128)),
    "darken_rect": lambda p: tone.darken(p, 1, 2, 4, 3, 0.6), "lighten_rect": lambda p: tone.lighten(p, 2, 2, 0, 3, 0.6), "overlay_rect": lambda p: tone.mix_toward(p, SEA, 0.45, 1, 1, 5, 5),
    "vignette": lambda p: tone.vignette(p, 2.0, 0.8, (20, 10, 0)), "noise": lambda p: tone.noise(p, 12.0), "noise_mono": lambda p: tone.noise(p, 12.0, True), "film_grain": lambda p: tone.film_grain(p, 20.0),
    "dither": lambda p: tone.dither(p, 4), "scanlines": lambda p: tone.scanlines(p, 2, 0.5), "interpolate_rgb": lambda p: S.interpolate_rgb(p, RED, 0.35),
    # colour spaces and gradients
    "rgb_gray": S.rgb_to_gray, "rgb_hsv": S.rgb_to_hsv, "rgb_hsl": S.rgb_to_hsl, "rgb_cmyk": S.rgb_to_cmyk, "hsv_rgb": lambda p: S.hsv_to_rgb(p, S.rgb_to_hsv(p, 9)), "hsl_rgb": lambda p: S.hsl_to_rgb(p, S.rgb_to_hsl(p, 9)),
    "cmyk_rgb": lambda p: S.cmyk_to_rgb(p, S.rgb_to_cmyk(p, 9)), "gradient_rgb": lambda p: S.packed(p, S.multigradient(p, [RED, SEA], 32)), "gradient_rgba": lambda p: S.packed(p, S.multigradient(p, [(*RED, 255), (*SEA, 40)], 32), True),
    "gradient_hsv": lambda p: S.multigradient(p, [(350, 0.5, 1), (40, 1, 0.5)], 17, hue=True), "gradient_cmyk": lambda p: S.multigradient(p, [(0, 0.2, 1, 0), (1, 0.1, 0, 0.5)], 9),
    "multigradient_rgb": lambda p: S.packed(p, S.multigradient(p, [RED, SEA, (255, 255, 0), (0, 0, 0)], 50)), "multigradient_rgb_sized": lambda p: S.packed(p, S.multigradient(p, [RED, SEA, (255, 255, 0)], 40, [0.3, 0.7])),
    "multigradient_hsl_sized": lambda p: S.multigradient(p, [(10, 1, 0.5), (200, 0.5, 0.4), (330, 0.2, 0.9)], 21, [0.25, 0.75], hue=True),
    "gradient_hsl": lambda p: S.multigradient(p, [(350, 0.5, 0.4), (40, 1, 0.5)], 17, hue=True), "multigradient_rgba": lambda p: S.packed(p, S.multigradient(p, [(*RED, 255), (*SEA, 40), (0, 0, 0, 0)], 33), True),
    "multigradient_rgba_sized": lambda p: S.packed(p, S.multigradient(p, [(*RED, 255), (*SEA, 40), (0, 0, 0, 0)], 21, [0.2, 0.8]), True), "multigradient_hsv": lambda p: S.multigradient(p, [(10, 1, 0.5), (200, 0.5, 0.4), (330, 0.2, 0.9)], 13, hue=True),
    "multigradient_hsv_sized": lambda p: S.multigradient(p, [(10, 1, 0.5), (200, 0.5, 0.4), (330, 0.2, 0.9)], 13, [0.6, 0.4], hue=True), "multigradient_hsl": lambda p: S.multigradient(p, [(300, 1, 0.5), (20, 0.5, 0.4), (90, 0.2, 0.9)], 25, hue=True),
    "multigradient_cmyk": lambda p: S.multigradient(p, [(0, 0.2, 1, 0), (1, 0.1, 0, 0.5), (0.5, 0.5, 0.5, 0.5)], 9), "multigradient_cmyk_sized": lambda p: S.multigradient(p, [(0, 0.2, 1, 0), (1, 0.1, 0, 0.5), (0.5, 0.5, 0.5, 0.5)], 9, [0.25, 0.75]),
    "convert_gray": lambda p: registry.converted(p, 4, 1), "convert_gray_alpha": lambda p: registry.converted(p, 4, 2), "convert_rgb": lambda p: registry.converted(p, 4, 3), "convert_spread": lambda p: registry.converted(p, 2, 4),
    # geometry
    "crop": lambda p: geometry.crop(p, 2, 1, 5, 4), "flip_h": geometry.flip_horizontal, "flip_v": geometry.flip_vertical, "rotate90": geometry.rotate90, "rotate180": geometry.rotate180, "rotate270": geometry.rotate270,
    "auto_orient": lambda p: geometry.orient(p, 7), "expand": lambda p: geometry.expand(p, 1, 2, 3, 1, (9, 8, 7, 255)), "border": lambda p: geometry.border(p, 2, (*RED, 255)), "crop_circle": lambda p: geometry.crop_circle(p, 4, 4, 3),
    "crop_ellipse": lambda p: geometry.crop_ellipse(p, 4, 3, 3, 2), "crop_polygon": lambda p: geometry.crop_polygon(p, *STAR), "corner_radius": lambda p: geometry.corner_radius(p, 3),
    "trim": lambda p: geometry.trim(geometry.expand(p, 2, 1, 3, 2, (250, 250, 250, 255)), 8),
    # resampling
    "resize_nearest": lambda p: resample.resize(p, 5, 11, "nearest"), "resize_box_half": lambda p: resample.resize(p, 4, 4, "box"), "resize_box_5": lambda p: resample.resize(p, 5, 5, "box"),
    "resize_bilinear_16": lambda p: resample.resize(tone.opaque(p), 16, 16, "bilinear"), "resize_catmull_16": lambda p: resample.resize(tone.opaque(p), 16, 12, "catmull_rom"), "resize_auto": lambda p: resample.resize(p, 12, 3),
    "resize_window": lambda p: resample.resize(tone.opaque(p), 6, 6, "auto", (1.5, 0.5, 5.0, 6.0)), "zoom": lambda p: resample.zoom(p, 1.5), "scaled_decode_2": lambda p: resample.reduce(p, 2), "scaled_decode_4": lambda p: resample.reduce(geometry.crop(p, 0, 0, 7, 6), 4),
    **{f"fit_{m}": (lambda p, m=m: resample.fit(geometry.crop(p, 0, 0, 8, 5), 6, 6, m, background=(1, 2, 3, 255))) for m in resample.FITS},
    **{f"gravity_{g}": (lambda p, g=g: resample.fit(geometry.crop(p, 0, 0, 8, 5), 4, 4, "cover", g)) for g in resample.GRAVITIES},
    # stencils
    "box_blur": lambda p: stencil.box_blur(p, 2), "gaussian_blur": lambda p: stencil.gaussian_blur(p, 1.0), "unsharp": lambda p: stencil.unsharp_mask(p, 1.0, 0.8, 3.0), "sharpen": lambda p: stencil.sharpen(p, 0.7), "clarity": lambda p: stencil.clarity(p, 0.5),
    "sobel": stencil.sobel, "emboss": lambda p: stencil.emboss(p, 128), "convolve3": lambda p: stencil.convolve3(p, [1, 2, 1, 2, 4, 2, 1, 2, 1], 16), "median": stencil.despeckle, "dilate": lambda p: stencil.dilate(p, 1), "erode": lambda p: stencil.erode(p, 2),
    "morph_open": lambda p: stencil.morph_open(p, 1), "morph_close": lambda p: stencil.morph_close(p, 1), "outline": lambda p: stencil.outline(p, 1), "pixelate": lambda p: stencil.pixelate(p, 3), "pixelate_region": lambda p: stencil.pixelate(p, 2, 1, 1, 5, 6),
    "halftone": lambda p: stencil.halftone(p, 4), "tilt_shift": lambda p: stencil.tilt_shift(p, 1.0, 0.25), "blur_region": lambda p: stencil.blur_region(p, 2, 2, 4, 5, 1.0), "glow": lambda p: stencil.glow(p, 1.0, 0.6), "drop_shadow": lambda p: stencil.drop_shadow(p, 1, 2, 1.0),
    # measured
    "auto_brightness": auto.auto_brightness, "auto_contrast": auto.auto_contrast, "auto_levels": auto.auto_levels, "auto_color": auto.auto_color, "auto_gamma": auto.auto_gamma, "improve": auto.improve,
    "shadows_highlights": lambda p: auto.shadows_highlights(p, 0.4, 0.5), "dehaze": lambda p: auto.dehaze(p, 0.7),
    # warps
    "rotate_free": lambda p: resample.rotate(p, 30, (10, 20, 30, 255)), "shear": lambda p: resample.shear(p, 0.3, 0.1), "perspective": lambda p: resample.perspective(p, [1, 0, 7.5, 1, 6.5, 7, 0.5, 8]), "arc": lambda p: resample.arc(p, 60),
    "barrel": lambda p: resample.barrel(p, 0.2), "swirl": lambda p: resample.swirl(p, 60), "polar": lambda p: resample.polar(p), "polar_inverse": lambda p: resample.polar(p, True), "motion_blur": lambda p: resample.motion_blur(p, 3, 20),
    "radial_blur": lambda p: resample.radial_blur(p, 20), "zoom_blur": lambda p: resample.zoom_blur(p, 30), "chromatic": lambda p: resample.chromatic_aberration(p, 1.0),
    # analysis
    "histogram": lambda p: auto.histogram(p, "r"), "histogram_luma": auto.histogram, "average_color": analysis.average_color, "focus_auto": analysis.focus_auto, "integral_image": analysis.integral_image, "phash": analysis.phash, "phash_distance": analysis.phash_distance,
    # drawing
    "hline": lambda p: draw.hline(p, 1, 3, 6, (*RED, 128)), "vline": lambda p: draw.vline(p, 2, 0, 5, (*RED, 255)), "rectangle": lambda p: draw.rectangle(p, 1, 1, 6, 5, (*SEA, 200)), "fill_rect": lambda p: draw.fill_rectangle(p, -1, 2, 5, 4, (*SEA, 90)),
    "fill_rounded": lambda p: draw.fill_rounded_rectangle(p, 0, 0, 8, 7, 3, (*RED, 255)), "line_thin": lambda p: draw.draw_line(p, 0, 1, 7, 6, 1, (*RED, 255)), "line_thick": lambda p: draw.draw_line(p, 0, 1, 7, 6, 3, (*RED, 160)),
    "fill_circle": lambda p: draw.fill_circle(p, 4, 4, 3, (*SEA, 255)), "draw_circle": lambda p: draw.draw_circle(p, 4, 4, 3, (*SEA, 255)), "fill_ellipse": lambda p: draw.fill_ellipse(p, 4, 3, 4, 2, (*RED, 77)), "draw_ellipse": lambda p: draw.draw_ellipse(p, 4, 3, 4, 2, (*RED, 255)),
    "polygon_outline": lambda p: draw.polygon(p, *STAR, (*RED, 255)), "polygon_even_odd": lambda p: draw.fill_polygon(p, *STAR, (*RED, 255)), "polygon_nonzero": lambda p: draw.fill_polygon(p, *STAR, (*RED, 200), "nonzero", "multiply"),
    "gradient_linear": lambda p: draw.gradient_linear(p, 0, 0, 7, 7, (*RED, 255), (*SEA, 0)), "gradient_radial": lambda p: draw.gradient_radial(p, 4, 4, 4, (*RED, 255), (*SEA, 128)), "gradient_fade": lambda p: draw.gradient_fade(p, 30, 0.2, 0.9),
    **{f"blend_{m}": (lambda p, m=m: draw.composite(p, geometry.flip_horizontal(p), m)) for m in draw.BLENDS},
    "draw_tile": lambda p: draw.composite(p, geometry.crop(p, 0, 0, 3, 3), "normal", 1, 2, 0.7, "tile"), "draw_center": lambda p: draw.composite(p, geometry.crop(p, 1, 1, 4, 4), "screen", draw="center"), "draw_once": lambda p: draw.composite(p, geometry.rotate90(p), "normal", 3, -2, 0.5),
    "display_render": lambda p: _display().render(p), "icc_p3_to_srgb": lambda p: icc.to_srgb(p, icc.builtin("display-p3")), "icc_adobe_to_srgb": lambda p: icc.to_srgb(p, icc.builtin("adobe-rgb")),
    "blur_boxes": lambda p: detect.blur_boxes(p, "SELECT * FROM (VALUES (3, 1, 1, 4, 5), (3, 5, 0, 3, 3), (9, 0, 0, 8, 8)) AS b_(image_id, x, y, width, height)", 1.0),
    "pixelate_boxes": lambda p: detect.pixelate_boxes(p, "SELECT * FROM (VALUES (3, 1, 1, 4, 5), (3, 5, 0, 3, 3), (9, 0, 0, 8, 8)) AS b_(image_id, x, y, width, height)", 3), "dpr": lambda p: resample.zoom(p, 2.0),
    "draw_text": lambda p: text.draw_text(p, _letters(), "A i.", 0, 1, (*RED, 255), 8), "draw_text_styled": lambda p: text.draw_styled(p, _letters(), "Ai", 1, 1, (*RED, 255), (1, (*SEA, 200)), (1, 1, 1, (0, 0, 0, 180))),
    "draw_text_box": lambda p: text.draw_box(p, _letters(), "A i.", 1, 0, text.Box(7, 0, "right"), (*RED, 200)), "draw_text_runs": lambda p: text.draw_runs(p, [text.Run(_letters(), "A"), text.Run(_letters(), "i.", (*SEA, 255), (1, (0, 0, 0, 90)))], 0, 2, (*RED, 255)),
    "draw_coverage": lambda p: draw.coverage(p, p.values(["y", "x", "v"], [(y, x, (40 * x + 60 * y) % 256) for y in range(4) for x in range(5)], "m"), 2, 1, (*RED, 220)),
}


def _sql(form: Form, dialect: str) -> str:
    got = form(fixture(dialect))
    return got if isinstance(got, str) else got.sql


def spark_query(form: Form) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        got = spark.sql(_sql(form, "spark").replace("{", "{{").replace("}", "}}").replace("FROM embeddings LATERAL", "FROM {embeddings} LATERAL"), embeddings=rows)
        return got.selectExpr(*(f"CAST(`{c}` AS BIGINT) AS `{c}`" if kind in ("int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else f"`{c}`" for c, kind in got.dtypes))

    return run


_FLOATING = {"rgb_hsv": "hsv", "rgb_hsl": "hsl", "rgb_cmyk": ["c", "m", "ye", "k"], "focus_auto": ["fx", "fy"], "gradient_hsv": ["c0", "c1", "c2"], "gradient_cmyk": ["c0", "c1", "c2", "c3"], **dict.fromkeys(("multigradient_hsl_sized", "gradient_hsl", "multigradient_hsv", "multigradient_hsv_sized", "multigradient_hsl"), ["c0", "c1", "c2"]), **dict.fromkeys(("multigradient_cmyk", "multigradient_cmyk_sized"), ["c0", "c1", "c2", "c3"])}


def duck_query(name: str, form: Form) -> str:
    return f"SELECT CAST(COLUMNS(* EXCLUDE ({', '.join(_FLOATING[name])})) AS BIGINT), {', '.join(_FLOATING[name])} FROM ({_sql(form, 'duck')}) q" if name in _FLOATING else f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({_sql(form, 'duck')}) q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(form) for name, form in FORMS.items()}


def oracle_sql() -> dict[str, str]:
    """Queries written by hand where there are some, else the operator in the other dialect."""
    return {name: f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM ({HAND[name]}) q" if name in HAND else duck_query(name, form) for name, form in FORMS.items()}


__all__ = ["FORMS", "fixture_gray", "oracle_sql", "queries"]
