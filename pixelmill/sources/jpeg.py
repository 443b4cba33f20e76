"""JPEG: a decoder of baseline and progressive streams and a baseline encoder, transforms and colour in numpy.

The decoder reads Huffman streams of 8 bits: grey, three components (YCbCr, or RGB by their ids or by an Adobe mark) and
four (CMYK or YCCK, multiplied by black), any sampling, restart markers, interleaved and separate scans, spectral selection
and successive approximation.  Every scan is walked symbol by symbol through 16-bit prefix tables into coefficients, which
are transformed once at the end.  Lossless and arithmetic streams raise.  Chroma is enlarged by a triangle filter.
"""

from __future__ import annotations

import struct

import numpy as np

from pixelmill.errors import CorruptError, TooLargeError, UnsupportedVariantError

# The tables of the standard's annex K, by rows, and the order of coefficients.
LUMA_Q = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_Q = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
MAX_PIXELS = 16_000_000


def zigzag() -> np.ndarray:
    """Place in a block of the k-th coefficient: diagonals, up and down in turn."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = zigzag()
COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def quantiser(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


# decoding


class _Huffman:
    def __init__(self, counts: bytes, values: bytes):
        self.look = np.zeros(1 << 16, np.uint16)  # length << 8 | value by the next 16 bits
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                lo = code << (16 - length)
                self.look[lo : lo + (1 << (16 - length))] = length << 8 | values[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.look = self.look.tolist()


class _Bits:
    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff") + bytes(8)
        self.end, self.at, self.hold, self.held = len(self.data) - 8, 0, 0, 0

    def fill(self) -> None:
        self.hold = (self.hold << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")) & ((1 << (self.held + 32)) - 1)
        self.at, self.held = self.at + 4, self.held + 32
        if self.at > self.end + 64:
            raise CorruptError("the scan ends early")

    def symbol(self, table: _Huffman) -> int:
        if self.held < 16:
            self.fill()
        got = table.look[self.hold >> (self.held - 16) & 0xFFFF]
        if not got:
            raise CorruptError("an unknown code")
        self.held -= got >> 8
        return got & 255

    def value(self, n: int) -> int:
        if not n:
            return 0
        v = self.raw(n)
        return v if v >> (n - 1) else v - (1 << n) + 1

    def raw(self, n: int) -> int:
        if self.held < n:
            self.fill()
        self.held -= n
        return self.hold >> self.held & ((1 << n) - 1)


def _segments(data: bytes):
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise CorruptError("no marker")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDA:
            end = at
            while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end = data.find(b"\xff", end + 1) if data[end] != 0xFF else end + 2
                end = len(data) if end < 0 else end
            yield mark, body, data[at:end]
            at = end
        else:
            yield mark, body, b""


class _Frame:
    """Extent, components (id, horizontal and vertical sampling, table) and their coefficients, block by block."""

    def __init__(self, body: bytes, progressive: bool):
        depth, self.h, self.w, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or n not in (1, 3, 4):
            raise UnsupportedVariantError("depth or components")
        if not self.w or not self.h:
            raise CorruptError("an empty image")
        if self.w * self.h > MAX_PIXELS:
            raise TooLargeError(f"{self.w} x {self.h}")
        self.progressive = progressive
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= x <= 4 for _, u, v, _ in self.parts for x in (u, v)):
            raise CorruptError("a sampling factor")
        self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mx, self.my = -(-self.w // (8 * self.hmax)), -(-self.h // (8 * self.vmax))
        self.blocks = [[[0] * 64 for _ in range(self.my * v * self.mx * u)] for _, u, v, _ in self.parts]

    def own(self, i: int) -> tuple[int, int]:
        """Rows and columns of samples of a component."""
        _, u, v, _ = self.parts[i]
        return -(-self.h * v // self.vmax), -(-self.w * u // self.hmax)

    def units(self, chosen: list[int]):
        """For each unit of a scan its (component, block) pairs: all of a unit's blocks, or one of a single component."""
        if len(chosen) == 1:
            i = chosen[0]
            rows, cols = (-(-n // 8) for n in self.own(i))
            stride = self.mx * self.parts[i][1]
            for r in range(rows):
                for c in range(cols):
                    yield ((0, self.blocks[i][r * stride + c]),)
            return
        for r in range(self.my):
            for c in range(self.mx):
                yield [(k, self.blocks[i][(r * v + y) * self.mx * u + c * u + x]) for k, i in enumerate(chosen) for _, u, v, _ in (self.parts[i],) for y in range(v) for x in range(u)]


def decode(data: bytes) -> np.ndarray:
    """An (h, w, 1 or 3) array."""
    tables, quant, frame, restart, adobe, seen = {}, {}, None, 0, None, False
    for mark, body, scan in _segments(data):
        if mark == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                quant[body[at] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
                at += 129 if wide else 65
        elif mark == 0xC4:
            at = 0
            while at < len(body):
                n = sum(body[at + 1 : at + 17])
                tables[body[at]] = _Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif mark in (0xC0, 0xC1, 0xC2):
            frame = _Frame(body, mark == 0xC2)
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise UnsupportedVariantError("a lossless, hierarchical or arithmetic stream")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif mark == 0xDA:
            if frame is None:
                raise CorruptError("a scan without a frame")
            _scan(frame, body, scan, tables, restart)
            seen = True
    if not seen:
        raise CorruptError("no scan")
    return _colored(frame, quant, adobe)


def _scan(frame: _Frame, head: bytes, scan: bytes, tables: dict, restart: int) -> None:
    n = head[0]
    places = {p[0]: i for i, p in enumerate(frame.parts)}
    try:
        chosen = [places[head[1 + 2 * k]] for k in range(n)]
        dc = [tables.get(head[2 + 2 * k] >> 4) for k in range(n)]
        ac = [tables.get(16 | (head[2 + 2 * k] & 15)) for k in range(n)]
    except KeyError as e:
        raise CorruptError("an unknown component") from e
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if not frame.progressive:
        first, last, high, low = 0, 63, 0, 0
    if last > 63 or first > last or (frame.progressive and (first == 0) != (last == 0)) or (first and n > 1):
        raise CorruptError("a spectral selection")
    if (not first and not high and None in dc) or (last and None in ac):
        raise CorruptError("a missing table")
    pieces, at = [], 0
    if restart:
        for i in range(len(scan) - 1):
            if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
                pieces.append(scan[at:i])
                at = i + 2
    pieces.append(scan[at:])
    units = frame.units(chosen)
    for piece in pieces:
        bits, before, run = _Bits(piece), [0] * n, 0
        for count, unit in enumerate(units, 1):
            for k, block in unit:
                if first:
                    run = (_refine if high else _spectrum)(bits, ac[k], block, first, last, low, run)
                    continue
                if high:
                    block[0] |= bits.raw(1) << low
                    continue
                before[k] += bits.value(bits.symbol(dc[k]))
                block[0] = before[k] * (1 << low)
                if last:
                    _spectrum(bits, ac[k], block, 1, last, 0, 0)
            if count == restart:
                break


def _spectrum(bits: _Bits, table: _Huffman, block: list[int], at: int, last: int, low: int, run: int) -> int:
    """Coefficients of a block's first pass; the number of blocks after it that have none."""
    if run:
        return run - 1
    while at <= last:
        s = bits.symbol(table)
        skip, size = s >> 4, s & 15
        if not size:
            if skip < 15:
                return (1 << skip) - 1 + bits.raw(skip) if skip else 0
            at += 16
            continue
        at += skip
        if at > last:
            raise CorruptError("a run past the block")
        block[at] = bits.value(size) * (1 << low)
        at += 1
    return 0


def _refine(bits: _Bits, table: _Huffman, block: list[int], at: int, last: int, low: int, run: int) -> int:
    """One bit more of the coefficients that a block has, and those that begin with this bit."""
    step = 1 << low

    def more(stop_after: int | None) -> int:
        """Bits of known coefficients up to the zero behind ``stop_after`` others, or to the end; its place."""
        i = at
        while i <= last:
            if block[i]:
                if bits.raw(1):
                    block[i] += step if block[i] > 0 else -step
            elif stop_after is not None:
                if not stop_after:
                    return i
                stop_after -= 1
            i += 1
        return i

    while not run and at <= last:
        s = bits.symbol(table)
        skip, size = s >> 4, s & 15
        if not size and skip < 15:
            run = (1 << skip) + (bits.raw(skip) if skip else 0)
            break
        fresh = (step if bits.raw(1) else -step) if size else 0
        at = more(skip)
        if fresh:
            if at > last:
                raise CorruptError("a run past the block")
            block[at] = fresh
        at += 1
    if run:
        more(None)
        run -= 1
    return run


def _colored(frame: _Frame, quant: dict, adobe: int | None) -> np.ndarray:
    full = []
    for i, (_, u, v, q) in enumerate(frame.parts):
        if q not in quant:
            raise CorruptError("a missing table")
        plane = np.array(frame.blocks[i], np.int64).reshape(frame.my * v, frame.mx * u, 64)
        blocks = np.zeros_like(plane)
        blocks[..., ZIGZAG] = plane * quant[q]
        b = blocks.reshape(*plane.shape[:2], 8, 8).astype(float)
        samples = np.clip(np.floor(COSINES.T @ b @ COSINES + 128.5), 0, 255).astype(np.int64)
        flat = samples.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        rows, cols = frame.own(i)
        full.append(_enlarged(flat[:rows, :cols], frame.vmax // v, frame.hmax // u)[: frame.h, : frame.w])
    if len(full) == 1:
        return full[0][..., None].astype(np.uint8)
    plain = (len(full) == 3 and (adobe == 0 or bytes(p[0] for p in frame.parts) == b"RGB")) or (len(full) == 4 and not adobe)
    color = np.dstack(full[:3]) if plain else _rgb(*full[:3])
    if len(full) == 4:  # what is stored is light, or in YCCK ink, times the light that black leaves
        color = ((color if plain else 255 - color) * full[3][..., None] + 127) // 255
    return color.astype(np.uint8)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    red = y + ((91881 * cr + 32768) >> 16)
    green = y + ((-22554 * cb - 46802 * cr + 32768) >> 16)
    blue = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.dstack([red, green, blue]), 0, 255)


def _enlarged(a: np.ndarray, fy: int, fx: int) -> np.ndarray:
    """By a triangle filter along each axis that is doubled; other factors repeat samples."""
    for axis, f in ((0, fy), (1, fx)):
        if f == 2:
            p = np.pad(a, [(1, 1) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
            n = a.shape[axis]
            left, right = np.take(p, range(n), axis), np.take(p, range(2, n + 2), axis)
            pair = np.stack([(3 * a + left + 1) >> 2, (3 * a + right + 2) >> 2], axis + 1)
            a = pair.reshape([d * 2 if i == axis else d for i, d in enumerate(a.shape)])
        elif f > 1:
            a = np.repeat(a, f, axis)
    return a


# encoding


def _codes(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _optimal(frequency: dict[int, int]) -> tuple[list[int], list[int]]:
    """Counts by length (at most 16) and values of a Huffman code; one reserved symbol keeps codes from being all ones."""
    sizes = {s: 0 for s in [*frequency, 256]}
    groups = sorted([(f, s, [s]) for s, f in frequency.items()] + [(0, 256, [256])])
    while len(groups) > 1:
        (fa, _, a), (fb, kb, b) = groups[0], groups[1]
        for s in a + b:
            sizes[s] += 1
        groups = sorted([*groups[2:], (fa + fb, kb, a + b)])
    counts = [0] * 40
    for n in sizes.values():
        counts[n] += 1
    for i in range(39, 16, -1):
        while counts[i] > 0:
            j = i - 2
            while not counts[j]:
                j -= 1
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    longest = max(i for i in range(1, 17) if counts[i])
    counts[longest] -= 1
    order = sorted(frequency, key=lambda s: (sizes[s], s))
    return counts[1:17], order


def encode(image: np.ndarray, quality: int = 85) -> bytes:
    """4:4:4 from quality 90, else 4:2:0; alpha is dropped; the Huffman codes fit the image."""
    h, w, channels = image.shape
    quality = min(100, max(1, quality))
    if channels < 3:
        planes, sampled = [image[..., 0].astype(np.int64)], 1
    else:
        r, g, b = (image[..., i].astype(np.int64) for i in range(3))
        planes = [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16]
        planes += [(-11059 * r - 21709 * g + 32768 * b + 32768 + (128 << 16)) >> 16, (32768 * r - 27439 * g - 5329 * b + 32768 + (128 << 16)) >> 16]
        planes = [np.clip(p, 0, 255) for p in planes]
        sampled = 1 if quality >= 90 else 2
    if sampled == 2:
        ys, xs = np.arange(0, h, 2), np.arange(0, w, 2)
        n = np.diff(ys, append=h)[:, None] * np.diff(xs, append=w)[None]
        planes[1:] = [(np.add.reduceat(np.add.reduceat(p, ys, 0), xs, 1) + n // 2) // n for p in planes[1:]]
    mx, my = -(-w // (8 * sampled)), -(-h // (8 * sampled))
    tables = [quantiser(LUMA_Q, quality), quantiser(CHROMA_Q, quality)]
    coded = []
    for i, p in enumerate(planes):
        k = sampled if i == 0 else 1
        bh, bw = my * k * 8, mx * k * 8
        p = np.pad(p, [(0, bh - p.shape[0]), (0, bw - p.shape[1])], mode="edge")
        b = p.reshape(bh // 8, 8, bw // 8, 8).transpose(0, 2, 1, 3) - 128.0
        c = (COSINES @ b @ COSINES.T).reshape(bh // 8, bw // 8, 64) / tables[min(i, 1)]
        coded.append((np.sign(c) * np.floor(np.abs(c) + 0.5)).astype(np.int64)[..., ZIGZAG])
    symbols: list[tuple[int, int, int, int]] = []  # table, symbol, extra bits, their number
    before = [0] * len(planes)
    for my_ in range(my):
        for mx_ in range(mx):
            for i in range(len(planes)):
                k = sampled if i == 0 else 1
                for j in range(k):
                    for m in range(k):
                        block = coded[i][my_ * k + j, mx_ * k + m]
                        kind = min(i, 1)
                        diff = int(block[0]) - before[i]
                        before[i] += diff
                        n = abs(diff).bit_length()
                        symbols.append((kind, n, diff if diff >= 0 else diff + (1 << n) - 1, n))
                        run, last = 0, 0
                        for at in np.flatnonzero(block[1:]).tolist():
                            run, last = at - last, at + 1
                            while run > 15:
                                symbols.append((2 + kind, 0xF0, 0, 0))
                                run -= 16
                            v = int(block[at + 1])
                            n = abs(v).bit_length()
                            symbols.append((2 + kind, run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
                        if last < 63:
                            symbols.append((2 + kind, 0, 0, 0))
    used = [0, 2] if len(planes) == 1 else [0, 1, 2, 3]
    frequency: dict[int, dict[int, int]] = {t: {} for t in used}
    for t, s, _, _ in symbols:
        frequency[t][s] = frequency[t].get(s, 0) + 1
    best = {t: _optimal(f) for t, f in frequency.items()}
    code = {t: _codes(*b) for t, b in best.items()}
    out, hold, held = bytearray(), 0, 0
    for t, s, extra, n in symbols:
        bits, length = code[t][s]
        hold = (hold << length | bits) << n | extra
        held += length + n
        while held >= 8:
            v = hold >> (held - 8) & 255
            out.append(v)
            if v == 255:
                out.append(0)
            held -= 8
        hold &= (1 << held) - 1
    if held:
        v = (hold << (8 - held) | (1 << (8 - held)) - 1) & 255
        out += bytes((v, 0)) if v == 255 else bytes((v,))
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    data = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i in range(min(2, len(planes))):
        data += segment(0xDB, bytes((i,)) + bytes(tables[i][ZIGZAG].tolist()))
    comps = b"".join(bytes((i + 1, sampled * 17 if i == 0 else 17, min(i, 1))) for i in range(len(planes)))
    data += segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + comps)
    for t, (counts, values) in best.items():
        data += segment(0xC4, bytes((16 * (t // 2) | t % 2,)) + bytes(counts) + bytes(values))
    data += segment(0xDA, bytes((len(planes),)) + b"".join(bytes((i + 1, min(i, 1) * 17)) for i in range(len(planes))) + b"\0\x3f\0")
    return data + bytes(out) + b"\xff\xd9"


def orientation(data: bytes) -> int:
    """EXIF orientation of 1 to 8; 1 where there is none."""
    at = data.find(b"Exif\0\0")
    if at < 0:
        return 1
    t = data[at + 6 :]
    order = "<" if t[:2] == b"II" else ">"
    try:
        where = struct.unpack_from(order + "I", t, 4)[0]
        for i in range(struct.unpack_from(order + "H", t, where)[0]):
            tag, _, _, value = struct.unpack_from(order + "HHIH", t, where + 2 + 12 * i)
            if tag == 0x112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1
