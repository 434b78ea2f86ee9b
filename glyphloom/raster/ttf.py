"""TrueType fonts: character map, outlines, advances, and coverage bitmaps. No hinting, kerning or shaping."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


class FontError(ValueError):
    pass


class Font:
    def __init__(self, data: bytes) -> None:
        self.data = data
        if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
            raise FontError("no TrueType or OpenType font")
        try:
            (n,) = struct.unpack_from(">H", data, 4)
            self.tables = {data[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">II", data, 20 + 16 * k) for k in range(n)}
            self.cmap = self._cmap()
        except (struct.error, KeyError) as e:
            raise FontError(f"unreadable font: {e}") from None

    def _at(self, tag: bytes) -> int:
        return self.tables[tag][0]

    def _cmap(self) -> dict[int, int]:
        """Glyph by code point, over all Unicode subtables of formats 4 and 12."""
        base, out = self._at(b"cmap"), {}
        (n,) = struct.unpack_from(">H", self.data, base + 2)
        for k in range(n):
            platform, encoding, offset = struct.unpack_from(">HHI", self.data, base + 4 + 8 * k)
            if platform != 0 and not (platform == 3 and encoding in (1, 10)):
                continue
            at = base + offset
            (kind,) = struct.unpack_from(">H", self.data, at)
            if kind == 4:
                out |= self._format4(at)
            elif kind == 12:
                (groups,) = struct.unpack_from(">I", self.data, at + 12)
                for g in range(groups):
                    a, b, glyph = struct.unpack_from(">III", self.data, at + 16 + 12 * g)
                    out |= {p: glyph + p - a for p in range(a, min(b, 0x10FFFF) + 1)}
        return {p: g for p, g in out.items() if g}

    def _format4(self, at: int) -> dict[int, int]:
        n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
        read = lambda offset, kind: np.frombuffer(self.data, kind, n, at + offset).astype(int)
        ends, starts = read(14, ">u2"), read(16 + 2 * n, ">u2")
        deltas, offsets = read(16 + 4 * n, ">i2"), read(16 + 6 * n, ">u2")
        out = {}
        for k in range(n):
            for p in range(starts[k], min(ends[k], 0xFFFE) + 1):
                if offsets[k] == 0:
                    glyph = (p + deltas[k]) & 0xFFFF
                else:
                    place = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (p - starts[k])
                    (glyph,) = struct.unpack_from(">H", self.data, place)
                    glyph = (glyph + deltas[k]) & 0xFFFF if glyph else 0
                out[int(p)] = int(glyph)
        return out

    def characters(self) -> list[str]:
        """What the font can draw: a font without TrueType outlines is matched with nothing, rather than fail on every row."""
        if b"glyf" not in self.tables:
            raise FontError("only TrueType outlines are drawn")
        return [chr(p) for p in sorted(self.cmap) if not 0xD800 <= p <= 0xDFFF]

    @property
    def units(self) -> int:
        return struct.unpack_from(">H", self.data, self._at(b"head") + 18)[0]

    def advance(self, glyph: int) -> int:
        (n,) = struct.unpack_from(">H", self.data, self._at(b"hhea") + 34)
        return struct.unpack_from(">H", self.data, self._at(b"hmtx") + 4 * min(glyph, n - 1))[0]

    def contours(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Closed outlines of a glyph as rows of x, y, on the curve or not; composites are resolved."""
        if b"glyf" not in self.tables:
            raise FontError("only TrueType outlines are drawn")
        if depth > 8:
            raise FontError("a composite glyph holds itself")
        wide = struct.unpack_from(">h", self.data, self._at(b"head") + 50)[0]
        loca = self._at(b"loca")
        a, b = struct.unpack_from(">II", self.data, loca + 4 * glyph) if wide else (2 * x for x in struct.unpack_from(">HH", self.data, loca + 2 * glyph))
        if a == b:
            return []
        at = self._at(b"glyf") + a
        (n,) = struct.unpack_from(">h", self.data, at)
        return self._simple(at + 10, n) if n >= 0 else self._composite(at + 10, depth)

    def _simple(self, at: int, n: int) -> list[np.ndarray]:
        ends = struct.unpack_from(f">{n}H", self.data, at)
        if not ends:
            return []
        at += 2 * n
        at += 2 + struct.unpack_from(">H", self.data, at)[0]
        count, flags = ends[-1] + 1, []
        while len(flags) < count:
            flag = self.data[at]
            at += 1
            flags.append(flag)
            if flag & 8:
                flags += [flag] * self.data[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, out = 0, []
            for flag in flags[:count]:
                if flag & short:
                    value += self.data[at] if flag & same else -self.data[at]
                    at += 1
                elif not flag & same:
                    value += struct.unpack_from(">h", self.data, at)[0]
                    at += 2
                out.append(value)
            axes.append(out)
        points = np.array([*axes, [f & 1 for f in flags[:count]]], dtype=float).T
        return np.split(points, [e + 1 for e in ends[:-1]])

    def _composite(self, at: int, depth: int) -> list[np.ndarray]:
        out = []
        while True:
            flags, glyph = struct.unpack_from(">HH", self.data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", self.data, at)
            at += 4 if flags & 1 else 2
            m = np.eye(2)
            f2 = lambda k: np.frombuffer(self.data, ">i2", k, at) / 16384
            if flags & 8:
                m, at = m * f2(1)[0], at + 2
            elif flags & 64:
                m, at = np.diag(f2(2)), at + 4
            elif flags & 128:
                m, at = f2(4).reshape(2, 2), at + 8
            for c in self.contours(glyph, depth + 1):
                out.append(np.column_stack([c[:, :2] @ m + ((dx, dy) if flags & 2 else (0, 0)), c[:, 2]]))
            if not flags & 32:
                return out


def polyline(contour: np.ndarray, steps: int = 4) -> np.ndarray:
    """A contour's quadratic curves as a closed row of points."""
    points: list[tuple[float, float, float]] = []
    for k in range(len(contour)):
        a, b = contour[k - 1], contour[k]
        if not a[2] and not b[2]:
            points.append(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, 1.0))
        points.append(tuple(b))
    start = next((k for k, p in enumerate(points) if p[2]), 0)
    points = points[start:] + points[: start + 1]
    out = [np.array(points[0][:2])]
    k = 1
    while k < len(points):
        if points[k][2]:
            out.append(np.array(points[k][:2]))
            k += 1
        else:
            p0, p1, p2 = out[-1], np.array(points[k][:2]), np.array(points[min(k + 1, len(points) - 1)][:2])
            for t in np.arange(1, steps + 1) / steps:
                out.append((1 - t) ** 2 * p0 + 2 * t * (1 - t) * p1 + t**2 * p2)
            k += 2
    return np.array(out)


def coverage(lines: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """The share of each pixel inside closed lines: signed areas are gathered by cell and summed along rows."""
    cells = np.zeros((height, width + 2))
    for line in lines:
        for (x0, y0), (x1, y1) in zip(line, np.roll(line, -1, axis=0), strict=True):
            if y0 == y1:
                continue
            sign, (xa, ya, xb, yb) = (1, (x0, y0, x1, y1)) if y0 < y1 else (-1, (x1, y1, x0, y0))
            slope = (xb - xa) / (yb - ya)
            for row in range(max(0, int(np.floor(ya))), min(height, int(np.ceil(yb)))):
                top, low = max(ya, row), min(yb, row + 1)
                if low <= top:
                    continue
                left, right = sorted((xa + slope * (top - ya), xa + slope * (low - ya)))
                left, right = min(max(left, 0.0), width), min(max(right, 0.0), width)
                tall = sign * (low - top)
                first, last = int(left), int(right)
                if first == last or right - left < 1e-12:
                    part = first + 1 - (left + right) / 2
                    cells[row, first] += tall * part
                    cells[row, first + 1] += tall * (1 - part)
                    continue
                before = 0.0
                for col in range(first, last + 1):
                    a, b = max(left, col), min(right, col + 1)
                    here = (b - a) / (right - left)
                    area = before + here * (col + 1 - (a + b) / 2)
                    cells[row, col] += tall * (area - before)
                    cells[row, col + 1] += tall * (before + here - area)
                    before += here
    return np.clip(np.abs(np.cumsum(cells, axis=1)[:, :width]), 0, 1)


@lru_cache(maxsize=64)
def font(data: bytes) -> Font:
    return Font(data)


@lru_cache(maxsize=4096)
def glyph_bitmap(data: bytes, char: str, size: int) -> tuple[np.ndarray, int, int, float]:
    """Coverage of a character, the place of its left and top edge from the pen, and its advance in pixels."""
    f = font(data)
    glyph, scale = f.cmap.get(ord(char), 0), size / f.units
    lines = [polyline(c) for c in f.contours(glyph) if len(c) > 1]
    if not lines:
        return np.zeros((0, 0)), 0, 0, f.advance(glyph) * scale
    every = np.concatenate(lines) * scale
    left, top = int(np.floor(every[:, 0].min())), int(np.floor(-every[:, 1].max()))
    width, height = int(np.ceil(every[:, 0].max())) - left, int(np.ceil(-every[:, 1].min())) - top
    moved = [np.column_stack([c[:, 0] * scale - left, -c[:, 1] * scale - top]) for c in lines]
    return coverage(moved, width, height), left, top, f.advance(glyph) * scale


def render(data: bytes, text: str, size: int, bold: bool, padding: int) -> np.ndarray:
    """The alpha plane of a text: its ink with padding; bold is drawn again at (1,0), (0,1) and (1,1) on the same canvas."""
    pen, placed = 0.0, []
    for c in text:
        bitmap, left, top, advance = glyph_bitmap(data, c, size)
        if bitmap.size:
            placed.append((bitmap, round(pen) + left, top))
        pen += advance
    if not placed:
        return np.zeros((2 * padding, 2 * padding), dtype=np.uint8)
    x0, y0 = min(p[1] for p in placed), min(p[2] for p in placed)
    x1, y1 = max(p[1] + p[0].shape[1] for p in placed), max(p[2] + p[0].shape[0] for p in placed)
    canvas = np.zeros((y1 - y0 + 2 * padding, x1 - x0 + 2 * padding))
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))[: 4 if bold else 1]:
        for bitmap, x, y in placed:
            a, b = y - y0 + padding + dy, x - x0 + padding + dx
            part = canvas[a : a + bitmap.shape[0], b : b + bitmap.shape[1]]
            ink = bitmap[: part.shape[0], : part.shape[1]]
            part[:] = ink + part * (1 - ink)
    return np.floor(canvas * 255 + 0.5).astype(np.uint8)
