"""What formats are called, which codecs there are, how read options and channels resolve, and codes of bounded length."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.errors import BoundsError, CorruptError, RangeError, TooLargeError
from pixelmill.relation import Pixels, luma
from pixelmill.sources import codecs

# Formats by number from 1, codecs in the order in which they are asked.
FORMATS = ("png", "jpeg", "bmp", "gif", "tiff", "webp", "avif", "heif")
CODECS = ("jpeg", "png", "webp", "gif", "tiff", "bmp", "avif")
COMPRESSION = ("auto", "none", "fast", "default", "best")


def format_name(number: Column) -> Column:
    """The name of a format's number; "unknown" for others."""
    return F.coalesce(F.when(number.between(1, len(FORMATS)), F.element_at(F.array(*map(F.lit, FORMATS)), F.greatest(F.least(number, F.lit(len(FORMATS))), F.lit(1)).cast("int"))), F.lit("unknown"))


def format_extension(name: Column) -> Column:
    """The usual extension of files of a format; empty for an unknown one."""
    out = F.lit("")
    for k, v in codecs.EXTENSIONS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def image_extension(name: Column) -> Column:
    """Like :func:`format_extension`; an unknown format is an error."""
    return F.when(format_extension(name) == "", F.raise_error(F.lit("unknown format")).cast("string")).otherwise(format_extension(name))


def codec_count() -> int:
    return len(CODECS)


def codec_at(index: int) -> str | None:
    return CODECS[index] if 0 <= index < len(CODECS) else None


def codec_find(name: str) -> str | None:
    return name if name in CODECS else None


def encode_level(compression: str = "auto", quality: int = 0) -> str:
    """The deflate level of a compression option: from quality 90 on the best, where none is named."""
    if compression not in COMPRESSION:
        raise RangeError(compression)
    return {"none": "huffman", "auto": "best" if quality >= 90 else "default"}.get(compression, compression)


def resolve_decode(width: int, height: int, x: int = 0, y: int = 0, w: int = 0, h: int = 0, den: int = 1, channels: int = 0, most: int = codecs.MAX_PIXELS) -> tuple[tuple[int, int, int, int], int, tuple[int, int]]:
    """Region, denominator and extent that a request to read comes to; 0 reaches to the edge, odd denominators are 1."""
    if width <= 0 or height <= 0:
        raise CorruptError("an empty image")
    if x >= width or y >= height:
        raise BoundsError("a region past the edge")
    if channels > 4:
        raise RangeError("channels")
    w, h = min(w or width, width - x), min(h or height, height - y)
    den = den if den in (1, 2, 4, 8) else 1
    extent = -(-w // den), -(-h // den)
    if extent[0] * extent[1] > most:
        raise TooLargeError(f"{extent[0]} x {extent[1]}")
    return (x, y, w, h), den, extent


def converted(p: Pixels, source: int, channels: int) -> Pixels:
    """Pixels as an image of ``source`` channels would give them to one of ``channels``: grey spreads, alpha is 255 if missing."""
    if not (1 <= source <= 4 and 1 <= channels <= 4):
        raise RangeError("channels")
    if source < 3:
        p = p.select(g="r", b="r")
    if source in (1, 3):
        p = p.select(a="255")
    if channels < 3:
        p = p.select(*[luma()] * 3)
    return p.select(a="255", channels=channels) if channels in (1, 3) else p.select(channels=channels)


def huffman_lengths(frequencies: Sequence[int], limit: int) -> list[int]:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by merging packages; 0 for what does not occur.

    One symbol alone gets one bit.  The longest codes go to the rarest symbols, of equally frequent ones to the first.
    """
    used = [i for i, f in enumerate(frequencies) if f > 0]
    if not len(frequencies) or limit <= 0 or (limit < 32 and len(frequencies) > 1 << limit):
        raise RangeError("an alphabet that does not fit")
    out = [0] * len(frequencies)
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    leaves = sorted((frequencies[i], i) for i in used)
    # a package is its weight and how many leaves of each level it holds, which are always the lightest ones
    level: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        pairs = [(level[k][0] + level[k + 1][0], level[k][1] + level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
        level = list(heapq.merge([(f, (j,)) for f, j in leaves], pairs, key=lambda x: x[0]))
    for _, members in level[: 2 * len(used) - 2]:
        for j in members:
            out[j] += 1
    lengths = sorted((out[i] for i in used), reverse=True)
    order = sorted(used, key=lambda i: (frequencies[i], i))
    for i, n in zip(order, lengths, strict=True):
        out[i] = n
    return out
