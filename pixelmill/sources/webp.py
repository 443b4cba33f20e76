"""WebP without loss: a decoder of all transforms, colour caches and prefix groups, and an encoder, on one image at a time.

The encoder subtracts green from the other colours, predicts pixels from their neighbours, refers back to runs of equal
rows of residuals and writes prefix codes that fit the image; decoding gives the pixels back exactly.  Lossy frames raise.
"""

from __future__ import annotations

import struct

import numpy as np

from pixelmill.errors import CorruptError, TooLargeError, UnsupportedCodecError

# The order of code length codes, the hash factor of the colour cache.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_HASH = 0x1E35A7BD
MAX_PIXELS, MAX_SIDE = 16_000_000, 16_384


def plane_offsets() -> list[tuple[int, int]]:
    """(left, up) of the 120 short distances: nearest first, then the narrower, then to the left before to the right."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), c[0] < 0))


def plane_codes() -> bytes:
    """The same as bytes: up in the high half, 8 less left in the low one."""
    return bytes(y << 4 | (8 - x) for x, y in plane_offsets())


_NEAR = plane_offsets()


# reading


class _Bits:
    """Bits from the least significant on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            self.hold |= int.from_bytes(self.data[self.at : self.at + 8].ljust(8, b"\0"), "little") << self.held
            self.at, self.held = self.at + 8, self.held + 64
            if self.at > len(self.data) + 64:
                raise CorruptError("the stream ends early")

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        v = self.hold & ((1 << n) - 1)
        self.hold >>= n
        self.held -= n
        return v

    def symbol(self, code: tuple[int, list[int]]) -> int:
        most, table = code
        if not most:
            return table[0]
        self.need(most)
        v = table[self.hold & ((1 << most) - 1)]
        if v < 0:
            raise CorruptError("an unknown code")
        self.hold >>= v & 15
        self.held -= v & 15
        return v >> 4


def _canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code with its first bit lowest, length) of the used symbols."""
    out, code = [], 0
    for n in range(1, max(lengths, default=0) + 1):
        for s, own in enumerate(lengths):
            if own == n:
                out.append((s, int(f"{code:0{n}b}"[::-1], 2), n))
                code += 1
        code <<= 1
    return out


def _prefix(lengths: list[int]) -> tuple[int, list[int]]:
    """The longest length, and by the next bits the symbol and its length; a single symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return 0, [used[0] if used else 0]
    if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
        raise CorruptError("an incomplete code")
    most = max(lengths)
    table = [-1] * (1 << most)
    for s, code, n in _canonical(lengths):
        table[code :: 1 << n] = [s << 4 | n] * (1 << (most - n))
    return most, table


def _code(bits: _Bits, size: int) -> tuple[int, list[int]]:
    """One prefix code of an alphabet."""
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        symbols += [bits.read(8)] if two else []
        if max(symbols) >= size:
            raise CorruptError("a symbol past the alphabet")
        for s in symbols:
            lengths[s] = 1
        return _prefix(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[_ORDER[i]] = bits.read(3)
    code = _prefix(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + n > size:
            raise CorruptError("lengths past the alphabet")
        if s == 16:
            lengths[at : at + n] = [before] * n
        at += n
    return _prefix(lengths)


def _extended(bits: _Bits, s: int) -> int:
    """A length or distance from its prefix symbol and the extra bits that follow."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: _Bits, width: int, height: int, top: bool) -> list[int]:
    """An entropy-coded image as ARGB numbers; ``top`` ones may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise CorruptError("a colour cache")
    block, chosen, groups = 0, None, 1
    if top and bits.read(1):
        block = bits.read(3) + 2
        chosen = [v >> 8 & 0xFFFF for v in _pixels(bits, -(-width >> block), -(-height >> block), False)]
        groups = max(chosen) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_code(bits, n) for n in sizes] for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, out, total, across = 32 - cache_bits, [], width * height, -(-width >> block) if block else 0
    green, red, blue, alpha, far = codes[0]
    symbol = bits.symbol
    while len(out) < total:
        if chosen:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = codes[chosen[(y >> block) * across + (x >> block)]]
        s = symbol(green)
        if s < 256:
            r = symbol(red)
            b = symbol(blue)
            v = symbol(alpha) << 24 | r << 16 | s << 8 | b
            out.append(v)
            if cache:
                cache[(_HASH * v & 0xFFFFFFFF) >> shift] = v
        elif s < 280:
            n = _extended(bits, s - 256)
            d = _extended(bits, symbol(far))
            if d > 120:
                d -= 120
            else:
                left, up = _NEAR[d - 1]
                d = max(1, left + up * width)
            if d > len(out) or len(out) + n > total:
                raise CorruptError("a reference outside the image")
            for _ in range(n):
                v = out[-d]
                out.append(v)
                if cache:
                    cache[(_HASH * v & 0xFFFFFFFF) >> shift] = v
        elif s - 280 < len(cache):
            out.append(cache[s - 280])
        else:
            raise CorruptError("a colour outside the cache")
    return out


# transforms


def _split(values: list[int], height: int, width: int) -> np.ndarray:
    """Channels a, r, g, b of ARGB numbers."""
    return np.array(values, ">u4").view(np.uint8).reshape(height, width, 4).astype(np.int64)


def _mean(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    """The neighbour that is nearer to left + top - corner, the upper one on a tie, for each pixel."""
    toward_left = np.abs(top - corner).sum(-1, keepdims=True)  # how far the left one is from the estimate
    toward_top = np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(toward_left < toward_top, left, top)


def predicted(mode: int, left, top, corner, right):
    """The fourteen predictions from neighbours (..., 4) of channels."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(left))
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode < 10:
        return _mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = _mean(left, top)
    change = half - corner
    return np.clip(half + np.where(change < 0, -(-change // 2), change // 2), 0, 255)


def _unpredicted(data: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Residuals to pixels, one after another."""
    h, w, _ = data.shape
    out = np.zeros_like(data)
    for y in range(h):
        for x in range(w):
            if not y:
                guess = out[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                guess = predicted(int(modes[y >> block, x >> block]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)
            out[y, x] = (data[y, x] + guess) & 255
    return out


def _signed(a):
    return (a + 128 & 255) - 128


def _uncrossed(data: np.ndarray, table: np.ndarray, block: int) -> np.ndarray:
    h, w, _ = data.shape
    t = np.repeat(np.repeat(table, 1 << block, 0), 1 << block, 1)[:h, :w]
    by = lambda k, c: (_signed(t[..., k]) * _signed(c)) >> 5
    red = (data[..., 1] + by(3, data[..., 2])) & 255
    blue = (data[..., 3] + by(2, data[..., 2]) + by(1, red)) & 255
    return np.stack([data[..., 0], red, data[..., 2], blue], -1)


def _lossless(body: bytes) -> np.ndarray:
    if not body or body[0] != 0x2F:
        raise CorruptError("no signature")
    bits = _Bits(body[1:])
    w, h = bits.read(14) + 1, bits.read(14) + 1
    has_alpha, version = bits.read(1), bits.read(3)
    if version:
        raise CorruptError("a version")
    if w * h > MAX_PIXELS:
        raise TooLargeError(f"{w} x {h}")
    steps, width = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise CorruptError("a transform twice")
        if kind == 2:
            steps.append((2,))
        elif kind == 3:
            n = bits.read(8) + 1
            colors = np.cumsum(_split(_pixels(bits, n, 1, False), 1, n)[0], 0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((3, colors, packed, width))
            width = -(-width >> packed)
        else:
            block = bits.read(3) + 2
            rows, cols = -(-h >> block), -(-width >> block)
            steps.append((kind, _split(_pixels(bits, cols, rows, False), rows, cols), block))
    data = _split(_pixels(bits, width, h, True), h, width)
    for step in reversed(steps):
        if step[0] == 0:
            data = _unpredicted(data, step[1][..., 2] & 15, step[2])
        elif step[0] == 1:
            data = _uncrossed(data, step[1], step[2])
        elif step[0] == 2:
            data[..., 1] = (data[..., 1] + data[..., 2]) & 255
            data[..., 3] = (data[..., 3] + data[..., 2]) & 255
        else:
            _, colors, packed, wide = step
            index = data[..., 2]
            if packed:
                size = 8 >> packed
                index = (np.repeat(index, 1 << packed, 1)[:, :wide] >> (size * (np.arange(wide) & ((1 << packed) - 1)))) & ((1 << size) - 1)
            table = np.zeros((256, 4), np.int64)
            table[: len(colors)] = colors
            data = table[index]
    image = data[..., [1, 2, 3, 0]].astype(np.uint8)
    return image if has_alpha else np.ascontiguousarray(image[..., :3])


def decode(data: bytes) -> np.ndarray:
    """An (h, w, 3 or 4) array of a lossless file."""
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"VP8L":
            return _lossless(data[at + 8 : at + 8 + size])
        if kind in (b"VP8 ", b"ANIM", b"ANMF"):
            raise UnsupportedCodecError("a lossy or animated WebP")
        at += 8 + size + (size & 1)
    raise CorruptError("no image")


# writing


class _Writer:
    def __init__(self):
        self.out, self.hold, self.held = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.hold |= value << self.held
        self.held += n
        while self.held >= 8:
            self.out.append(self.hold & 255)
            self.hold >>= 8
            self.held -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes((self.hold,)) if self.held else b"")


def _put_code(out: _Writer, counts: list[int]) -> dict[int, tuple[int, int]]:
    """Write a prefix code that fits the counts; its codes by symbol."""
    from pixelmill.sources.registry import huffman_lengths

    used = [s for s, n in enumerate(counts) if n] or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = huffman_lengths(counts, 15) if len(used) > 1 else [int(s == used[0]) for s in range(len(counts))]
    marks: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    at = 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        if lengths[at] or run < 3:
            marks.append((lengths[at], 0, 0))
            at += 1
        else:
            run = min(run, 138)
            marks.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
    own = [0] * 19
    for s, _, _ in marks:
        own[s] += 1
    widths = huffman_lengths(own, 7)
    out.put(0, 1)
    n = max(i for i, s in enumerate(_ORDER) if widths[s]) + 1
    out.put(max(n, 4) - 4, 4)
    for s in _ORDER[: max(n, 4)]:
        out.put(widths[s], 3)
    out.put(0, 1)
    codes = {s: (c, k) for s, c, k in _canonical(widths)} if sum(map(bool, widths)) > 1 else {marks[0][0]: (0, 0)}
    for s, extra, k in marks:
        out.put(*codes[s])
        out.put(extra, k)
    return {s: (c, k) for s, c, k in _canonical(lengths)} if len(used) > 1 else {used[0]: (0, 0)}


def _prefixed(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra and its bits of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 1
    second = (v - 1) >> (n - 1) & 1
    return 2 * n + second, (v - 1) & ((1 << (n - 1)) - 1), n - 1


def _put_pixels(out: _Writer, data: np.ndarray, top: bool) -> None:
    """Channels a, r, g, b; runs of what stands one row above or one pixel before are references."""
    h, w, _ = data.shape
    flat = data.reshape(-1, 4)
    number = flat @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    symbols: list[tuple[int, ...]] = []
    runs = {}
    for code, d in ((1, w), (2, 1)):  # of the short distances the first is a row above, the second a pixel before
        same = np.concatenate([np.zeros(min(d, len(number)), bool), number[d:] == number[:-d]])
        ends = np.where(same, len(same), np.arange(len(same)))
        runs[code] = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(same))
    best = np.maximum(runs[1], runs[2])
    at = 0
    while at < len(flat):
        n = min(int(best[at]), 4096)
        if n >= 3:
            code = 1 if runs[1][at] >= runs[2][at] else 2
            symbols.append((256, *_prefixed(n), *_prefixed(code)))
            at += n
        else:
            a, r, g, b = flat[at].tolist()
            symbols.append((g, r, b, a))
            at += 1
    counts = [[0] * n for n in (280, 256, 256, 256, 40)]
    for s in symbols:
        if s[0] == 256:
            counts[0][256 + s[1]] += 1
            counts[4][s[4]] += 1
        else:
            for table, v in zip(counts, s, strict=False):
                table[v] += 1
    out.put(0, 1)
    if top:
        out.put(0, 1)
    codes = [_put_code(out, c) for c in counts]
    for s in symbols:
        if s[0] == 256:
            out.put(*codes[0][256 + s[1]])
            out.put(s[2], s[3])
            out.put(*codes[4][s[4]])
            out.put(s[5], s[6])
        else:
            for code, v in zip(codes, s, strict=False):
                out.put(*code[v])


def encode(image: np.ndarray) -> bytes:
    """A lossless file of an (h, w, 1 to 4) array; grey is written as colours."""
    h, w, channels = image.shape
    if max(h, w) > MAX_SIDE or not h or not w:
        raise TooLargeError(f"{w} x {h}")
    rgb = np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., :3]
    alpha = image[..., -1:] if channels in (2, 4) else np.full((h, w, 1), 255, np.uint8)
    data = np.concatenate([alpha, rgb], -1).astype(np.int64)
    data[..., 1] = (data[..., 1] - data[..., 2]) & 255
    data[..., 3] = (data[..., 3] - data[..., 2]) & 255
    mode, block = 11, 7
    guess = np.zeros_like(data)
    guess[0, 0] = (255, 0, 0, 0)
    guess[0, 1:], guess[1:, 0] = data[0, :-1], data[:-1, 0]
    guess[1:, 1:] = predicted(mode, data[1:, :-1], data[:-1, 1:], data[:-1, :-1], None)
    out = _Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int(channels in (2, 4)), 1)
    out.put(0, 3)
    out.put(1 | 2 << 1, 3)  # green is subtracted first, so it is added back last
    out.put(1 | 0 << 1, 3)
    out.put(block - 2, 3)
    modes = np.zeros((-(-h >> block), -(-w >> block), 4), np.int64)
    modes[..., 0], modes[..., 2] = 255, mode
    _put_pixels(out, modes, False)
    out.put(0, 1)
    _put_pixels(out, (data - guess) & 255, True)
    body = out.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
