"""Text on images: bitmap fonts in BDF, greedy wrapping, alignment, measuring, and drawing through a coverage relation.

A font is a small table of glyphs, parsed on the driver and sent along.  Layout is sequential in the characters of one
text, so it runs in Arrow batches over rows of texts; drawing is a join of pixels with coverage.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.errors import CorruptError, RangeError, UnknownFormatError, UnsupportedVariantError
from pixelmill.relation import Pixels

FALLBACKS = 4


@dataclass
class Glyph:
    advance: int
    left: int
    top: int
    rows: list[str]  # rows of 0 and 1


@dataclass
class Font:
    ascent: int
    descent: int
    glyphs: dict[int, Glyph] = field(default_factory=dict)

    @property
    def line_height(self) -> int:
        return self.ascent + self.descent

    def has_glyph(self, codepoint: int) -> bool:
        return codepoint in self.glyphs


def load_bdf(text: str) -> Font:
    """A BDF face; without ascent and descent its bounding box gives them."""
    font, box, code, glyph, bits = None, None, None, None, None
    ascent = descent = None
    glyphs: dict[int, Glyph] = {}
    for line in text.splitlines():
        word, *rest = line.split() or [""]
        if bits is not None and word != "ENDCHAR":
            bits.append(bin(int(word, 16) | 1 << (4 * len(word)))[3:])
        elif word == "FONTBOUNDINGBOX":
            box = list(map(int, rest))
        elif word == "FONT_ASCENT":
            ascent = int(rest[0])
        elif word == "FONT_DESCENT":
            descent = int(rest[0])
        elif word == "ENCODING":
            code = int(rest[0])
        elif word == "DWIDTH":
            glyph = {"advance": int(rest[0])}
        elif word == "BBX":
            glyph = (glyph or {}) | dict(zip(("w", "h", "x", "y"), map(int, rest), strict=True))
        elif word == "BITMAP":
            bits = []
        elif word == "ENDCHAR":
            if glyph and code is not None and code >= 0 and "w" in glyph:
                glyphs[code] = Glyph(glyph.get("advance", glyph["w"]), glyph["x"], glyph["y"] + glyph["h"], [b[: glyph["w"]] for b in bits or []])
            code, glyph, bits = None, None, None
    if not glyphs:
        raise CorruptError("no characters")
    if ascent is None:
        ascent = box[1] + box[3] if box else max(g.top for g in glyphs.values())
    if descent is None:
        descent = -box[3] if box else max(len(g.rows) - g.top for g in glyphs.values())
    font = Font(ascent, descent, glyphs)
    return font


def load_psf(data: bytes) -> Font:
    """A PSF face of version 1 or 2; without a Unicode table a glyph's number is its code point."""
    if data[:2] == b"\x36\x04":
        mode, height = data[2], data[3]
        count, width, size, start = 512 if mode & 1 else 256, 8, height, 4
        table = data[start + count * size :] if mode & 6 else b""
        groups = [[c for c in struct.unpack(f"<{len(g) // 2}H", g) if c != 0xFFFE] for g in _psf1_groups(table)] if table else []
    elif data[:4] == b"\x72\xb5\x4a\x86":
        _, start, flags, count, size, height, width = struct.unpack_from("<7I", data, 4)
        table = data[start + count * size :] if flags & 1 else b""
        groups = [[ord(c) for c in g.split(b"\xfe")[0].decode("utf-8", "replace")] for g in table.split(b"\xff")[:count]] if table else []
    else:
        raise CorruptError("no PSF signature")
    if len(data) < start + count * size:
        raise CorruptError("a cut font")
    stride, font = -(-width // 8), Font(height, 0)
    for i in range(count):
        raw = data[start + i * size : start + (i + 1) * size]
        rows = ["".join(f"{b:08b}" for b in raw[y * stride : (y + 1) * stride])[:width] for y in range(height)]
        for code in groups[i] if i < len(groups) else [] if groups else [i]:
            font.glyphs[code] = Glyph(width, 0, height, rows)
    return font


def _psf1_groups(table: bytes) -> list[bytes]:
    out, at = [], 0
    while at + 1 < len(table):
        end = at
        while end + 1 < len(table) and table[end : end + 2] != b"\xff\xff":
            end += 2
        out.append(table[at:end])
        at = end + 2
    return out


def load_font(data: bytes) -> Font:
    """By its first bytes; outlines are not supported."""
    if data[:9] == b"STARTFONT":
        return load_bdf(data.decode("latin-1"))
    if data[:2] == b"\x36\x04" or data[:4] == b"\x72\xb5\x4a\x86":
        return load_psf(data)
    if data[:4] in (b"\0\1\0\0", b"OTTO", b"true", b"ttcf"):
        raise UnsupportedVariantError("outlines")
    raise UnknownFormatError("no known signature")


class FontSet:
    """Up to four faces; a character is set in the first that has it, else in the first."""

    def __init__(self, *fonts: Font):
        if not 1 <= len(fonts) <= FALLBACKS:
            raise RangeError("a set holds one to four fonts")
        self.fonts = fonts

    def face(self, codepoint: int) -> Font:
        return next((f for f in self.fonts if f.has_glyph(codepoint)), self.fonts[0])

    def advance(self, char: str) -> int:
        glyph = self.face(ord(char)).glyphs.get(ord(char))
        return glyph.advance if glyph else self.fonts[0].line_height // 2

    def width(self, text: str) -> int:
        return sum(map(self.advance, text))

    @property
    def line_height(self) -> int:
        return max(f.line_height for f in self.fonts)


def wrap(text: str, width: int, advance) -> list[str]:
    """Greedy lines: broken at spaces, an over-long word at a character; newlines always break."""
    out = []
    for part in text.split("\n"):
        line, used = "", 0
        for word in part.split(" "):
            size = sum(map(advance, word))
            gap = advance(" ") if line else 0
            if line and used + gap + size > width:
                out.append(line)
                line, used, gap = "", 0, 0
            while size > width and len(word) > 1:
                n, got = 0, 0
                while n < len(word) and (n == 0 or got + advance(word[n]) <= width):
                    got += advance(word[n])
                    n += 1
                out.append(word[:n])
                word, size = word[n:], size - got
            line, used = (f"{line} {word}", used + gap + size) if line else (word, size)
        out.append(line)
    return out


def ellipsis(line: str, width: int, advance) -> str:
    """The longest beginning that fits with three dots behind it."""
    if sum(map(advance, line)) <= width:
        return line
    room = width - 3 * advance(".")
    n = used = 0
    while n < len(line) and used + advance(line[n]) <= room:
        used += advance(line[n])
        n += 1
    return line[:n].rstrip() + "..."


def measure(fonts: FontSet, text: str, width: int | None = None) -> dict:
    lines = wrap(text, width, fonts.advance) if width else text.split("\n")
    return {"width": max(map(fonts.width, lines)), "height": len(lines) * fonts.line_height, "lines": len(lines), "glyphs": sum(map(len, lines)), "missing": sum(not fonts.face(ord(c)).has_glyph(ord(c)) for x in lines for c in x)}


def lines_of(texts: DataFrame, width: int, advance: int | FontSet = 1) -> DataFrame:
    """doc_id, line, content, width of texts (doc_id, text) wrapped at a width; ``advance`` is fixed or that of fonts."""
    step = advance.advance if isinstance(advance, FontSet) else (lambda _: advance)

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(key, i, x, sum(map(step, x))) for i, x in enumerate(wrap(text, width, step))] if text is not None else []
            for i in range(0, len(rows), 10_000):
                part = list(zip(*rows[i : i + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "line", "content", "width"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, line int, content string, width long")


def coverage_rows(fonts: FontSet, text: str, width: int | None = None, align: str = "left") -> list[tuple[int, int, int]]:
    """(y, x, v) of set pixels, the text's box at the origin."""
    out = []
    for i, line in enumerate(wrap(text, width, fonts.advance) if width else text.split("\n")):
        slack = (width or 0) - fonts.width(line)
        x = {"left": 0, "center": slack // 2, "right": slack}[align] if width else 0
        base = i * fonts.line_height + max(f.ascent for f in fonts.fonts)
        for char in line:
            glyph = fonts.face(ord(char)).glyphs.get(ord(char))
            if glyph:
                out += [(base - glyph.top + dy, x + glyph.left + dx, 255) for dy, row in enumerate(glyph.rows) for dx, bit in enumerate(row) if bit == "1"]
            x += fonts.advance(char)
    return out


@dataclass(frozen=True)
class Box:
    """How a text is laid out: wrap width, height, alignments, what happens beyond the height, leading."""

    width: int
    height: int = 0
    align: str = "left"
    valign: str = "top"
    overflow: str = "clip"
    leading: float = 1.0


def lay_out(fonts: FontSet, text: str, box: Box) -> list[dict]:
    """Lines with content, width, x, y, baseline, clipped and ellipsized."""
    step = max(1, int(fonts.line_height * box.leading + 0.5))
    lines = wrap(text, box.width, fonts.advance)
    room = max(1, box.height // step) if box.height else len(lines)
    cut = len(lines) > room
    kept = lines[:room]
    if cut and box.overflow == "ellipsis":
        kept[-1] = ellipsis(kept[-1] + "\u2026" * box.width, box.width, fonts.advance)
    slack = max(0, box.height - len(kept) * step) if box.height else 0
    top = {"top": 0, "middle": slack // 2, "bottom": slack}[box.valign]
    ascent, out = max(f.ascent for f in fonts.fonts), []
    for i, line in enumerate(kept):
        gap = box.width - fonts.width(line)
        x = {"left": 0, "justify": 0, "center": gap // 2, "right": gap}[box.align]
        last = i == len(kept) - 1
        out.append({"content": line, "width": fonts.width(line), "x": x, "y": top + i * step, "baseline": top + i * step + ascent, "clipped": cut and last, "ellipsized": cut and last and box.overflow == "ellipsis"})
    return out


def box_rows(fonts: FontSet, text: str, box: Box) -> list[tuple[int, int, int]]:
    """(y, x, v) of a text's set pixels in its box; what overflows the height is left out, justified lines spread their spaces."""
    out, lines = [], lay_out(fonts, text, box)
    for i, line in enumerate(lines):
        x, spaces = line["x"], line["content"].count(" ")
        spread = box.width - line["width"] if box.align == "justify" and spaces and i + 1 < len(lines) else 0
        seen = 0
        for char in line["content"]:
            glyph = fonts.face(ord(char)).glyphs.get(ord(char))
            at = x + spread * seen // max(1, spaces)
            if glyph:
                out += [(line["baseline"] - glyph.top + dy, at + glyph.left + dx, 255) for dy, row in enumerate(glyph.rows) for dx, bit in enumerate(row) if bit == "1"]
            seen += char == " "
            x += fonts.advance(char)
    return out


def draw_box(p: Pixels, fonts: FontSet, text: str, x: int, y: int, box: Box, color: Sequence[int]) -> Pixels:
    """A text laid out in a box whose corner is at (x, y)."""
    from pixelmill.operators.draw import coverage

    rows = box_rows(fonts, text, box)
    return coverage(p, p.values(["y", "x", "v"], rows, "m"), x, y, color) if rows else p


def grown(rows: list[tuple[int, int, int]], radius: int) -> list[tuple[int, int, int]]:
    """A mask widened by a square radius: the stroke of a text."""
    best: dict[tuple[int, int], int] = {}
    for y, x, v in rows:
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                key = (y + dy, x + dx)
                best[key] = max(best.get(key, 0), v)
    return [(y, x, v) for (y, x), v in sorted(best.items())]


def softened(rows: list[tuple[int, int, int]], radius: int) -> list[tuple[int, int, int]]:
    """A mask after three box passes an axis: the shadow of a text."""
    import numpy as np

    if not rows or radius < 1:
        return rows
    ys, xs, vs = (np.array(c) for c in zip(*rows, strict=True))
    pad = 3 * radius
    top, left = ys.min() - pad, xs.min() - pad
    mask = np.zeros((ys.max() - top + pad + 1, xs.max() - left + pad + 1), np.int64)
    mask[ys - top, xs - left] = vs
    span = 2 * radius + 1
    for axis in (1, 0):
        for _ in range(3):
            wide = np.pad(mask, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
            mask = (sum(np.take(wide, range(i, i + mask.shape[axis]), axis) for i in range(span)) + span // 2) // span
    return [(int(y) + int(top), int(x) + int(left), int(mask[y, x])) for y, x in zip(*np.nonzero(mask), strict=True)]


def draw_styled(p: Pixels, fonts: FontSet, text: str, x: int, y: int, color: Sequence[int], stroke: tuple[int, Sequence[int]] | None = None, shadow: tuple[int, int, int, Sequence[int]] | None = None, width: int | None = None, align: str = "left") -> Pixels:
    """Shadow (dx, dy, radius, colour), then stroke (radius, colour), then the fill, each one join with its mask."""
    from pixelmill.operators.draw import coverage

    rows = coverage_rows(fonts, text, width, align)
    for mask, dx, dy, paint in (
        *([(softened(rows, shadow[2]), shadow[0], shadow[1], shadow[3])] if shadow else []),
        *([(grown(rows, stroke[0]), 0, 0, stroke[1])] if stroke else []),
        (rows, 0, 0, color),
    ):
        if mask:
            p = coverage(p, p.values(["y", "x", "v"], mask, "m"), x + dx, y + dy, paint)
    return p


def draw_text(p: Pixels, fonts: FontSet, text: str, x: int, y: int, color: Sequence[int], width: int | None = None, align: str = "left") -> Pixels:
    from pixelmill.operators.draw import coverage

    rows = coverage_rows(fonts, text, width, align)
    return coverage(p, p.values(["y", "x", "v"], rows, "m"), x, y, color) if rows else p


MAX_RUNS = 16


@dataclass(frozen=True)
class Run:
    """A stretch of text with fonts and paints of its own; a stroke is (radius, colour), a shadow (dx, dy, radius, colour)."""

    fonts: FontSet
    text: str
    color: Sequence[int] | None = None
    stroke: tuple[int, Sequence[int]] | None = None
    shadow: tuple[int, int, int, Sequence[int]] | None = None


Cells = list[tuple[str, int]]  # characters with the number of their run


def _run_lines(runs: Sequence[Run], width: int | None) -> list[Cells]:
    """Greedy lines over all runs, broken like those of one text."""
    if not 1 <= len(runs) <= MAX_RUNS:
        raise RangeError("one to sixteen runs")
    size = lambda cells: sum(runs[r].fonts.advance(c) for c, r in cells)
    lines: list[Cells] = []
    line: Cells = []
    word: Cells = []
    gap: Cells = []

    def close() -> None:
        """Put the word that ends here on the line, or on new ones where it does not fit."""
        nonlocal line, word, gap
        if width and line and size(line + gap + word) > width:
            lines.append(line)
            line, gap = [], []
        line += gap + word
        while width and len(line) > 1 and size(line) > width:
            n = max(1, next(i for i in range(1, len(line) + 1) if size(line[:i]) > width) - 1)
            lines.append(line[:n])
            line = line[n:]
        word, gap = [], []

    for r, run in enumerate(runs):
        for c in run.text:
            if c == "\n":
                close()
                lines.append(line)
                line = []
            elif c == " ":
                close()
                gap = [(c, r)]
            else:
                word.append((c, r))
    close()
    return [*lines, line]


def _extents(runs: Sequence[Run], line: Cells) -> tuple[int, int]:
    """Ascent and height of a line: the largest of its runs, of the first run where it is empty."""
    fonts = [f for r in ({r for _, r in line} or {0}) for f in runs[r].fonts.fonts]
    return max(f.ascent for f in fonts), max(f.line_height for f in fonts)


def measure_runs(runs: Sequence[Run], width: int | None = None) -> dict:
    """Extent of runs in one box; ascent and line_height are those of the first line."""
    lines = _run_lines(runs, width)
    extents = [_extents(runs, x) for x in lines]
    cells = [c for x in lines for c in x]
    return {
        "width": max(sum(runs[r].fonts.advance(c) for c, r in x) for x in lines), "height": sum(h for _, h in extents), "lines": len(lines), "ascent": extents[0][0], "line_height": extents[0][1],
        "glyphs": len(cells), "missing": sum(not runs[r].fonts.face(ord(c)).has_glyph(ord(c)) for c, r in cells),
    }


def draw_runs(p: Pixels, runs: Sequence[Run], x: int, y: int, color: Sequence[int], width: int | None = None, align: str = "left") -> Pixels:
    """Runs in one box on common baselines: all shadows, then all strokes, then all fills."""
    from pixelmill.operators.draw import coverage

    masks: list[list[tuple[int, int, int]]] = [[] for _ in runs]
    top = 0
    for line in _run_lines(runs, width):
        ascent, height = _extents(runs, line)
        slack = max(0, (width or 0) - sum(runs[r].fonts.advance(c) for c, r in line))
        pen = {"left": 0, "center": slack // 2, "right": slack}[align] if width else 0
        for c, r in line:
            glyph = runs[r].fonts.face(ord(c)).glyphs.get(ord(c))
            if glyph:
                masks[r] += [(top + ascent - glyph.top + dy, pen + glyph.left + dx, 255) for dy, row in enumerate(glyph.rows) for dx, bit in enumerate(row) if bit == "1"]
            pen += runs[r].fonts.advance(c)
        top += height
    layers = [(softened(m, r.shadow[2]), r.shadow[0], r.shadow[1], r.shadow[3]) for m, r in zip(masks, runs, strict=True) if r.shadow]
    layers += [(grown(m, r.stroke[0]), 0, 0, r.stroke[1]) for m, r in zip(masks, runs, strict=True) if r.stroke]
    for mask, dx, dy, ink in [*layers, *((m, 0, 0, r.color or color) for m, r in zip(masks, runs, strict=True))]:
        if mask:
            p = coverage(p, p.values(["y", "x", "v"], mask, "m"), x + dx, y + dy, ink)
    return p
