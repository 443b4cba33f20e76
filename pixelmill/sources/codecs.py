"""Codecs for PNG, BMP, TIFF, GIF and (in their own modules) JPEG and lossless WebP, sniffing for all eight formats and header probes, in numpy and zlib.

They run on Arrow batches (see :mod:`pixelmill.sources.images`), one image at a time, so memory is bounded by one image.
What a codec does not support raises; nothing is approximated.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from pixelmill.errors import CorruptError, RasterError, TooLargeError, UnknownFormatError, UnsupportedCodecError, UnsupportedVariantError
from pixelmill.sources import jpeg, webp

# Limits of one image, formats by their first bytes, extensions.
MAX_PIXELS, MAX_BYTES = 16_000_000, 33_554_432
EXTENSIONS = {"png": ".png", "jpeg": ".jpg", "bmp": ".bmp", "gif": ".gif", "tiff": ".tiff", "webp": ".webp", "avif": ".avif", "heif": ".heic"}
MAGIC = [("png", b"\x89PNG\r\n\x1a\n"), ("jpeg", b"\xff\xd8\xff"), ("bmp", b"BM"), ("gif", b"GIF87a"), ("gif", b"GIF89a"), ("tiff", b"II*\0"), ("tiff", b"MM\0*")]
AVIF_BRANDS, HEIF_BRANDS = (b"avif", b"avis"), (b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1")


@dataclass
class Info:
    width: int
    height: int
    format: str
    channels: int
    bit_depth: int = 8
    has_alpha: bool = False
    frames: int = 1
    progressive: bool = False


def sniff(data: bytes) -> str:
    for name, head in MAGIC:
        if data.startswith(head):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(data) >= 12 and data[4:8] == b"ftyp":
        # any brand of the list makes an AVIF file, but only the major one a HEIF file
        size = min(len(data), int.from_bytes(data[:4], "big"))
        if any(data[i : i + 4] in AVIF_BRANDS for i in (8, *range(16, size - 3, 4)) if i + 4 <= size):
            return "avif"
        if data[8:12] in HEIF_BRANDS:
            return "heif"
    return "unknown"


def _guard(w: int, h: int, channels: int = 4) -> None:
    if w <= 0 or h <= 0:
        raise CorruptError("an empty image")
    if w * h > MAX_PIXELS or w * h * channels > MAX_BYTES:
        raise TooLargeError(f"{w} x {h}")


# PNG

_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png_chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise CorruptError("a cut chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def _unfilter(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise CorruptError("too few rows")
    lines = raw[: rows * (stride + 1)].reshape(rows, stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y] = np.cumsum(padded.reshape(-1, step), 0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            now, up = bytearray(stride), above.tobytes()
            src = line.tobytes()
            for i in range(stride):
                a, b = (now[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    now[i] = (src[i] + ((a + b) >> 1)) & 255
                else:
                    c = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[i] = (src[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
            out[y] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise CorruptError("an unknown filter")
        above = out[y]
    return out


def _png_samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Samples at their own depth."""
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return rows.astype(np.uint16)
    bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint16)


def decode_png(data: bytes, bottom: int | None = None) -> np.ndarray:
    """Rows from ``bottom`` on are neither inflated nor unfiltered, unless the file is interlaced."""
    head, palette, clear, body = None, None, None, []
    for kind, chunk in _png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None:
        raise CorruptError("no header")
    w, h, depth, color, _, _, lace = head
    if color not in _PNG_CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise UnsupportedVariantError("colour type")
    _guard(w, h)
    channels = _PNG_CHANNELS[color]
    try:
        if bottom and bottom < h and not lace:
            h = bottom
            raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), h * (1 + -(-w * channels * depth // 8))), np.uint8)
        else:
            raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise CorruptError(str(e)) from None
    step = max(1, channels * depth // 8)
    samples = np.zeros((h, w, channels), np.uint16)
    # The seven passes of interlacing as first x, first y, step x, step y.
    passes = [(0, 0, 1, 1)] if not lace else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    for x0, y0, dx, dy in passes:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride = -(-pw * channels * depth // 8)
        rows = _unfilter(raw, ph, stride, step)
        raw = raw[ph * (stride + 1) :]
        samples[y0::dy, x0::dx] = _png_samples(rows, pw, depth, channels).reshape(ph, pw, channels)
    if color == 3:
        if palette is None:
            raise CorruptError("no palette")
        index = samples[..., 0]
        index = np.where(index < len(palette), index, 0)
        out = palette[index]
        if clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out = np.dstack([out, alpha[index]])
        return out
    scaled = (samples >> 8 if depth == 16 else samples * {1: 255, 2: 85, 4: 17, 8: 1}[depth]).astype(np.uint8)
    if clear and color in (0, 2):
        key = np.frombuffer(clear, ">u2")[:channels]
        scaled = np.dstack([scaled, np.where((samples == key).all(2), 0, 255).astype(np.uint8)])
    return scaled


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """Eight bits, not interlaced; each row by the filter of least absolute sum, the first of equals."""
    h, w, channels = image.shape
    rows = image.reshape(h, w * channels).astype(np.int16)
    left = np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, channels:] = rows[:-1, :-channels]
    pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    tried = np.stack([(rows - x) & 255 for x in (np.zeros_like(rows), left, up, (left + up) >> 1, paeth)]).astype(np.uint8)
    best = np.abs(tried.view(np.int8).astype(np.int32)).sum(2).argmin(0)
    lines = np.concatenate([best[:, None].astype(np.uint8), tried[best, np.arange(h)]], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


# BMP


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise CorruptError("a cut header")
    start, size, w, h, _, bits, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    flip, h = h > 0, abs(h)
    _guard(w, h)
    used = struct.unpack_from("<I", data, 46)[0]
    if bits <= 8:
        n = used or 1 << bits
        palette = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if packing == 1 and bits == 8:
        index = np.zeros((h, w), np.uint8)
        x = y = 0
        at = start
        while at + 1 < len(data):
            n, v = data[at], data[at + 1]
            at += 2
            if n:
                index[y, x : x + n] = v
                x += n
            elif v == 0:
                x, y = 0, y + 1
            elif v == 1:
                break
            elif v == 2:
                x, y, at = x + data[at], y + data[at + 1], at + 2
            else:
                part = np.frombuffer(data, np.uint8, v, at)
                index[y, x : x + v] = part[: w - x]
                x, at = x + v, at + v + (v & 1)
            if y >= h:
                break
        out = palette[np.minimum(index, len(palette) - 1)]
        return out[::-1] if flip else out
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32):
        raise UnsupportedVariantError("BMP")
    stride = -(-w * bits // 32) * 4
    if len(data) < start + stride * h:
        raise CorruptError("too few rows")
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    if flip:
        rows = rows[::-1]
    if bits <= 8:
        at = rows[:, :w] if bits == 8 else _png_samples(rows, w, bits, 1)
        return palette[np.minimum(at[:, :w], len(palette) - 1)]
    if bits == 24:
        return rows[:, : w * 3].reshape(h, w, 3)[..., ::-1].copy()
    value = rows[:, : w * bits // 8].copy().view(np.uint16 if bits == 16 else np.uint32).astype(np.uint64)
    masks = (0x7C00, 0x3E0, 0x1F, 0) if bits == 16 else (0xFF0000, 0xFF00, 0xFF, 0)
    if packing == 3:
        masks = struct.unpack_from("<IIII" if size >= 56 else "<III", data, 54) + (() if size >= 56 else (0,))
    planes = []
    for m in masks:
        if m:
            shift = (m & -m).bit_length() - 1
            top = m >> shift
            planes.append((((value & np.uint64(m)) >> np.uint64(shift)) * np.uint64(255) + np.uint64(top // 2)) // np.uint64(top))
    return np.dstack(planes).astype(np.uint8)


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey palette of 8 bits, 24-bit colour, or 32-bit with masks where there is alpha; rows from the bottom."""
    h, w, channels = image.shape
    if channels == 2:
        image, channels = np.dstack([image[..., :1]] * 3 + [image[..., 1:]]), 4
    bits = {1: 8, 3: 24, 4: 32}[channels]
    rows = image[::-1] if channels == 1 else image[::-1, :, [2, 1, 0, 3][:channels]]
    rows = rows.reshape(h, -1)
    body = np.pad(rows, [(0, 0), (0, -rows.shape[1] % 4)]).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if channels == 1 else b""
    size = 108 if channels == 4 else 40
    start = 14 + size + len(palette)
    head = struct.pack("<IiiHHIIiiII", size, w, h, 1, bits, 3 if channels == 4 else 0, len(body), 2835, 2835, 256 if channels == 1 else 0, 0)
    if channels == 4:
        head += struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + head + palette + body


# TIFF

_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw_expand(data: bytes, bits: int, msb: bool, early: int = 0) -> bytes:
    """LZW of GIF (low bits first) and TIFF (high bits first, codes widen one early); ``bits`` is the literal width."""
    clear, stop = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, width, before = bytearray(), bits + 1, None
    hold = held = at = 0
    while True:
        while held < width:
            if at >= len(data):
                return bytes(out)
            if msb:
                hold = (hold << 8) | data[at]
            else:
                hold |= data[at] << held
            held, at = held + 8, at + 1
        if msb:
            code = (hold >> (held - width)) & ((1 << width) - 1)
            hold &= (1 << (held - width)) - 1
        else:
            code = hold & ((1 << width) - 1)
            hold >>= width
        held -= width
        if code == clear:
            table, width, before = [bytes((i,)) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == stop:
            return bytes(out)
        if not table:
            table = [bytes((i,)) for i in range(clear)] + [b"", b""]
        if code < len(table):
            word = table[code]
        elif before is not None and code == len(table):
            word = before + before[:1]
        else:
            raise CorruptError("an LZW code out of range")
        out += word
        if before is not None and len(table) < 4096:
            table.append(before + word[:1])
        if len(table) + early >= 1 << width and width < 12:
            width += 1
        before = word


def lzw_compress(data: bytes, bits: int) -> bytes:
    """GIF's LZW: low bits first, the table is cleared when it is full."""
    clear = 1 << bits
    out, hold, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal hold, held
        hold |= code << held
        held += width
        while held >= 8:
            out.append(hold & 255)
            hold >>= 8
            held -= 8

    table, width = {bytes((i,)): i for i in range(clear)}, bits + 1
    put(clear, width)
    word = b""
    for v in data:
        longer = word + bytes((v,))
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if len(table) + 2 < 4096:
            table[longer] = len(table) + 2
            if len(table) + 2 > 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width = {bytes((i,)): i for i in range(clear)}, bits + 1
        word = bytes((v,))
    if word:
        put(table[word], width)
    put(clear + 1, width)
    if held:
        out.append(hold & 255)
    return bytes(out)


def _tiff_tags(data: bytes) -> dict[int, list[int]]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _TIFF_SIZES.get(kind, 1) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        code = {1: "B", 2: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, where))
    return tags


def decode_tiff(data: bytes) -> np.ndarray:
    try:
        t = _tiff_tags(data)
        w, h = t[256][0], t[257][0]
        starts, counts = t[273], t[279]
    except (struct.error, KeyError) as e:
        raise CorruptError(str(e)) from None
    _guard(w, h)
    if any(b != 8 for b in t.get(258, [8])) or t.get(284, [1])[0] != 1:
        raise UnsupportedVariantError("samples of other than 8 bits, or planes")
    channels, rows_per = t.get(277, [1])[0], t.get(278, [h])[0]
    packing, photo = t.get(259, [1])[0], t.get(262, [1])[0]
    parts = []
    for i, (start, n) in enumerate(zip(starts, counts, strict=True)):
        body, rows = data[start : start + n], min(rows_per, h - i * rows_per)
        if packing == 5:
            body = lzw_expand(body, 8, True, 1)
        elif packing in (8, 32946):
            body = zlib.decompress(body)
        elif packing == 32773:
            body = unpack_bits(body)
        elif packing != 1:
            raise UnsupportedVariantError("compression")
        if len(body) < rows * w * channels:
            raise CorruptError("a short strip")
        part = np.frombuffer(body, np.uint8, rows * w * channels).reshape(rows, w, channels)
        parts.append(np.cumsum(part, 1, dtype=np.uint8) if t.get(317, [1])[0] == 2 else part)
    out = np.concatenate(parts)
    if photo == 3:
        palette = (np.array(t[320]).reshape(3, 256) >> 8).T.astype(np.uint8)
        return palette[out[..., 0]]
    return 255 - out if photo == 0 else out


def encode_tiff(image: np.ndarray) -> bytes:
    """Little-endian strips of about 64 KiB, horizontal differences, deflate; alpha as an extra sample."""
    h, w, channels = image.shape
    rows_per = max(1, 65536 // (w * channels))
    diff = image.copy()
    diff[:, 1:] = image[:, 1:] - image[:, :-1]
    strips = [zlib.compress(diff[y : y + rows_per].tobytes()) for y in range(0, h, rows_per)]
    alpha, tags = channels in (2, 4), []
    tags += [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * channels), (259, 3, [8]), (262, 3, [2 if channels >= 3 else 1]), (273, 4, None), (277, 3, [channels]), (278, 4, [rows_per]), (279, 4, [len(s) for s in strips]), (317, 3, [2])]
    if alpha:
        tags.append((338, 3, [2]))
    extra = 8 + 2 + 12 * len(tags) + 4
    blobs, at = b"", extra
    size = lambda kind, v: len(v) * (2 if kind == 3 else 4)
    room = sum(size(k, v if v is not None else strips) for _, k, v in tags if size(k, v if v is not None else strips) > 4)
    first, offsets = extra + room, []
    for s in strips:
        offsets.append(first)
        first += len(s)
    entries = b""
    for tag, kind, v in tags:
        v = offsets if v is None else v
        body = struct.pack(f"<{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(body) > 4:
            entries += struct.pack("<HHII", tag, kind, len(v), at)
            blobs, at = blobs + body, at + len(body)
        else:
            entries += struct.pack("<HHI", tag, kind, len(v)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + blobs + b"".join(strips)


# GIF


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while at < len(data) and data[at]:
        out += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    return bytes(out), at + 1


def decode_gif(data: bytes) -> np.ndarray:
    """The first frame on the logical screen, RGBA."""
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    _guard(w, h)
    at, table, clear = 13, None, None
    if flags & 128:
        n = 2 << (flags & 7)
        table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
    while at < len(data):
        mark = data[at]
        if mark == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear = data[at + 6]
            _, at = _sub_blocks(data, at + 2)
        elif mark == 0x2C:
            x, y, fw, fh, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            if own & 128:
                n = 2 << (own & 7)
                table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3), at + 3 * n
            bits = data[at]
            body, at = _sub_blocks(data, at + 1)
            index = np.frombuffer(lzw_expand(body, bits, False)[: fw * fh].ljust(fw * fh, b"\0"), np.uint8).reshape(fh, fw)
            if own & 64:
                rows = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
                laced = np.zeros_like(index)
                laced[rows] = index
                index = laced
            if table is None:
                raise CorruptError("no colours")
            frame = np.dstack([table[np.minimum(index, len(table) - 1)], np.where(index == (clear if clear is not None else 256), 0, 255).astype(np.uint8)])
            out = np.zeros((h, w, 4), np.uint8)
            ch, cw = min(fh, h - y), min(fw, w - x)
            out[y : y + ch, x : x + cw] = frame[:ch, :cw]
            return out
        else:
            break
    raise CorruptError("no frame")


def encode_gif(image: np.ndarray) -> bytes:
    """At most 256 colours exactly (255 where pixels are clear, alpha under 128); more raise, quantise first."""
    h, w, channels = image.shape
    rgb = np.repeat(image[..., :1], 3, 2) if channels < 3 else image[..., :3]
    alpha = image[..., -1] if channels in (2, 4) else np.full((h, w), 255, np.uint8)
    hidden = alpha < 128
    value = (rgb.astype(np.uint32) @ np.array([65536, 256, 1], np.uint32)).astype(np.int64)
    value[hidden] = -1
    colors, index = np.unique(value, return_inverse=True)
    if len(colors) > 256:
        raise UnsupportedVariantError("more than 256 colours")
    bits = max(2, (len(colors) - 1).bit_length())
    table = b"".join(bytes((max(c, 0) >> 16, max(c, 0) >> 8 & 255, max(c, 0) & 255)) for c in colors.tolist()).ljust(3 << bits, b"\0")
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | (bits - 1), 0, 0) + table
    if hidden.any():
        out += b"\x21\xf9\x04\x01\0\0\0\0"
    body = lzw_compress(index.astype(np.uint8).tobytes(), bits)
    blocks = b"".join(bytes((len(body[i : i + 255]),)) + body[i : i + 255] for i in range(0, len(body), 255))
    return out + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes((bits,)) + blocks + b"\0\x3b"


def median_cut(image: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` colours: boxes of 5-bit cells are split at the median of their longest axis, most populous first."""
    flat = image[..., :3].reshape(-1, 3).astype(np.int64)
    boxes = [np.arange(len(flat))]
    while len(boxes) < count:
        able = [b for b in boxes if (np.ptp(flat[b] >> 3, axis=0) > 0).any()]
        if not able:
            break
        box = max(able, key=len)
        axis = int(np.argmax(np.ptp(flat[box] >> 3, axis=0)))
        cells = flat[box, axis] >> 3
        cut = int(np.sort(cells)[(len(cells) - 1) // 2])
        cut = cut if (cells > cut).any() else cut - 1
        at = next(i for i, b in enumerate(boxes) if b is box)
        boxes[at : at + 1] = [box[cells <= cut], box[cells > cut]]
    out = image.copy()
    view = out[..., :3].reshape(-1, 3)
    for box in boxes:
        view[box] = flat[box].sum(0) // len(box)
    out[..., :3] = view.reshape(out[..., :3].shape)
    return out


# registry

DECODERS = {"png": decode_png, "bmp": decode_bmp, "tiff": decode_tiff, "gif": decode_gif, "jpeg": jpeg.decode, "webp": webp.decode}
ENCODERS = {"png": encode_png, "bmp": encode_bmp, "tiff": encode_tiff, "gif": encode_gif, "jpeg": jpeg.encode, "webp": webp.encode}


def probe(data: bytes) -> Info:
    """Header facts without decoding pixels."""
    kind = sniff(data)
    try:
        if kind == "png":
            w, h, depth, color, _, _, lace = struct.unpack_from(">IIBBBBB", data, 16)
            clear = any(k == b"tRNS" for k, _ in _png_chunks(data))
            base = 3 if color == 3 else _PNG_CHANNELS[color]
            return Info(w, h, kind, base + (clear and color in (0, 2, 3)), depth, clear or color in (4, 6), progressive=bool(lace))
        if kind == "bmp":
            w, h, _, bits = struct.unpack_from("<iiHH", data, 18)
            return Info(w, abs(h), kind, 4 if bits == 32 else 3, 8, bits == 32)
        if kind == "gif":
            w, h = struct.unpack_from("<HH", data, 6)
            return Info(w, h, kind, 4, 8, True, max(1, data.count(b"\x00\x2c") + data.count(b"\x2c\x00\x00\x00\x00") > 0))
        if kind == "tiff":
            t = _tiff_tags(data)
            n = t.get(277, [1])[0]
            return Info(t[256][0], t[257][0], kind, n, t.get(258, [8])[0], n in (2, 4))
        if kind == "jpeg":
            at = 2
            while at + 9 < len(data):
                mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if mark in (0xC0, 0xC1, 0xC2):
                    depth, h, w, n = struct.unpack_from(">BHHB", data, at + 4)
                    return Info(w, h, kind, n, depth, progressive=mark == 0xC2)
                at += 2 + size
        if kind == "webp":
            tag = data[12:16]
            if tag == b"VP8X":
                return Info(1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), kind, 4 if data[20] & 16 else 3, 8, bool(data[20] & 16))
            if tag == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return Info((bits & 16383) + 1, (bits >> 14 & 16383) + 1, kind, 4 if bits >> 28 & 1 else 3, 8, bool(bits >> 28 & 1))
            if tag == b"VP8 ":
                w, h = struct.unpack_from("<HH", data, 26)
                return Info(w & 16383, h & 16383, kind, 3)
        if kind in ("avif", "heif") and (at := data.find(b"ispe")) > 0:
            w, h = struct.unpack_from(">II", data, at + 8)
            return Info(w, h, kind, 3)
    except (struct.error, IndexError, KeyError) as e:
        raise CorruptError(str(e)) from None
    if kind == "unknown":
        raise UnknownFormatError("no known signature")
    raise CorruptError(kind)


def decode(data: bytes, bottom: int | None = None) -> np.ndarray:
    """An (h, w, channels) array of bytes; where a format is read top down, only the rows above ``bottom``."""
    kind = sniff(data)
    if kind == "unknown":
        raise UnknownFormatError("no known signature")
    if kind not in DECODERS:
        raise UnsupportedCodecError(kind)
    try:
        return decode_png(data, bottom) if kind == "png" else DECODERS[kind](data)
    except (struct.error, IndexError, zlib.error, ValueError) as e:
        if isinstance(e, RasterError):
            raise
        raise CorruptError(str(e)) from None


def encode(image: np.ndarray, kind: str) -> bytes:
    if kind not in ENCODERS:
        raise UnsupportedCodecError(kind)
    return ENCODERS[kind](np.ascontiguousarray(image, np.uint8))
