"""The fluent interface: a DataFrame of pixels with its extent; every method is lazy and returns a new raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelmill.functions import color as C
from pixelmill.functions import spaces
from pixelmill.operators import analysis, auto, draw, geometry, resample, stencil, tone
from pixelmill.relation import Pixels

_MODULES = (tone, geometry, resample, stencil, auto, draw)
_MATRICES = ("brightness", "contrast", "saturation", "hue", "invert", "blackwhite", "colorize", "tint", "duotone", "split_tone", "white_balance", "colorblind_simulate", "colorblind_assist")


class Raster:
    """Images of one extent as rows (image_id, y, x, r, g, b, a) of bigints.

    Operators are the functions of the operator modules by their names, for example
    ``Raster(df, 8, 8).brightness(1.2).crop(2, 2, 4, 4).df``.
    """

    def __init__(self, df: DataFrame, width: int, height: int, _pixels: Pixels | None = None):
        self.source = df
        self.pixels = _pixels or Pixels("SELECT image_id, y, x, r, g, b, a FROM {pixels}", width, height)

    @property
    def width(self) -> int:
        return self.pixels.width

    @property
    def height(self) -> int:
        return self.pixels.height

    @property
    def df(self) -> DataFrame:
        return self._run(self.pixels.sql)

    def _run(self, sql: str) -> DataFrame:
        session: SparkSession = self.source.sparkSession
        return session.sql(sql, pixels=self.source)

    def _with(self, pixels: Pixels) -> Raster:
        return Raster(self.source, pixels.width, pixels.height, pixels)

    def __getattr__(self, name: str):
        if name in _MATRICES:
            return lambda *a: self._with(tone.matrix(self.pixels, getattr(C, name)(*a)))
        for module in _MODULES:
            f = getattr(module, name, None)
            if callable(f) and not name.startswith("_"):
                return lambda *a, **k: self._with(f(self.pixels, *(x.pixels if isinstance(x, Raster) else x for x in a), **k))
        if name in ("gamma", "posterize", "threshold", "solarize", "exposure", "levels", "fill_light", "gain", "sigmoid"):
            return lambda *a: self._with(tone.curve(self.pixels, name, *a))
        raise AttributeError(name)

    def dpr(self, factor: float) -> Raster:
        """A zoom to a device's pixel ratio."""
        return self._with(resample.zoom(self.pixels, factor))

    def preset(self, name: str) -> Raster:
        return self._with(tone.preset(self.pixels, name))

    def histogram(self, channel: str = "luma") -> DataFrame:
        return self._run(auto.histogram(self.pixels, channel))

    def average_color(self) -> DataFrame:
        return self._run(analysis.average_color(self.pixels))

    def phash(self) -> DataFrame:
        return self._run(analysis.phash(self.pixels))

    def focus(self) -> DataFrame:
        return self._run(analysis.focus_auto(self.pixels))

    def palette(self, count: int) -> DataFrame:
        return analysis.palette(self.df, count)

    def to_hsv(self) -> DataFrame:
        return self._run(spaces.rgb_to_hsv(self.pixels))
