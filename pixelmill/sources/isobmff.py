"""Boxes of AVIF and HEIF files: the primary item's turn and mirror as an EXIF orientation."""

from __future__ import annotations

from collections.abc import Iterator

# The EXIF orientation of a turn (quarters against the clock) that is followed by a mirror: none, over the
# horizontal axis (top and bottom change), over the vertical one.
ORIENTATIONS = ((0, 4, 2), (8, 5, 7), (3, 2, 4), (6, 7, 5))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first and end byte of the payloads of boxes that follow one another; a damaged one ends the list."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _find(data: bytes, kind: bytes, at: int, end: int) -> tuple[int, int] | None:
    return next(((a, b) for k, a, b in boxes(data, at, end) if k == kind), None)


def orientation(data: bytes) -> int:
    """1 to 8 by the properties of the primary item, the turn first and then the mirror; 0 if it has none or is damaged."""
    meta = _find(data, b"meta", 0, len(data))
    props = meta and _find(data, b"iprp", meta[0] + 4, meta[1])
    listed = props and _find(data, b"ipco", *props)
    linked = props and _find(data, b"ipma", *props)
    first = meta and _find(data, b"pitm", meta[0] + 4, meta[1])
    if not (listed and linked and first):
        return 0
    item = int.from_bytes(data[first[0] + 4 : first[0] + (6 if data[first[0]] == 0 else 8)], "big")
    wide_id, wide_index = data[linked[0]] >= 1, data[linked[0] + 3] & 1
    at, own = linked[0] + 8, []
    for _ in range(int.from_bytes(data[linked[0] + 4 : linked[0] + 8], "big")):
        if at + 5 > linked[1]:
            break
        n = 4 if wide_id else 2
        who, count = int.from_bytes(data[at : at + n], "big"), data[at + n]
        at += n + 1
        step = 2 if wide_index else 1
        if who == item:
            own = [int.from_bytes(data[at + i * step : at + (i + 1) * step], "big") & (0x7FFF if wide_index else 0x7F) for i in range(count)]
        at += count * step
    turn = mirror = 0
    for i, (kind, a, b) in enumerate(boxes(data, *listed), 1):
        if i in own and b > a:
            turn = data[a] & 3 if kind == b"irot" else turn
            mirror = (data[a] & 1) + 1 if kind == b"imir" else mirror
    return ORIENTATIONS[turn][mirror]
