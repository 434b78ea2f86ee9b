"""Planes and images as numpy arrays: warps, blur, colour, composition, PNG."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def bicubic(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The plane at places between pixels (pixel centres are at .5); zero outside."""
    x, y = x - 0.5, y - 0.5
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(-1, 3):
            d = np.abs(t - k)
            out.append(np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0)))
        return out

    wx, wy, out = weights(x - ix), weights(y - iy), np.zeros(x.shape)
    height, width = plane.shape
    for j in range(4):
        for i in range(4):
            px, py = ix + i - 1, iy + j - 1
            inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
            out += np.where(inside, plane[np.clip(py, 0, height - 1), np.clip(px, 0, width - 1)], 0) * wx[i] * wy[j]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def rotated_size(width: int, height: int, degrees: float) -> tuple[int, int]:
    """Width and height of the canvas that a rotation needs."""
    c, s = round(math.cos(math.radians(-degrees)), 15), round(math.sin(math.radians(-degrees)), 15)
    xs, ys = zip(*((c * x + s * y, -s * x + c * y) for x in (-width / 2, width / 2) for y in (-height / 2, height / 2)), strict=True)
    cx, cy = width / 2, height / 2
    return math.ceil(max(xs) + cx) - math.floor(min(xs) + cx), math.ceil(max(ys) + cy) - math.floor(min(ys) + cy)


def rotate(plane: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counter-clockwise about the centre, on a canvas that holds all of it."""
    height, width = plane.shape
    w, h = rotated_size(width, height, degrees)
    y, x = np.mgrid[0:h, 0:w] + 0.5
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = x - w / 2, y - h / 2
    return bicubic(plane, c * dx - s * dy + width / 2, s * dx + c * dy + height / 2)


def blur(plane: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur with standard deviation ``radius``."""
    if radius <= 0 or not plane.size:
        return plane
    n = max(1, math.ceil(3 * radius))
    kernel = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    kernel /= kernel.sum()
    out = plane.astype(float)
    for axis in (0, 1):
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="full")[n : n + len(v)], axis, out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def find_coefficients(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The eight numbers of the projective map that takes each source point to its target, by least squares."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.linalg.lstsq(np.array(rows, dtype=float), np.array(values, dtype=float), rcond=None)[0]


def perspective(plane: np.ndarray, shifts: list[int]) -> np.ndarray:
    """Warped at the same size so that the corners move by eight shifts (x and y of each, clockwise from top left)."""
    height, width = plane.shape
    corners = [(0, 0), (width, 0), (width, height), (0, height)]
    moved = [(x + shifts[2 * k], y + shifts[2 * k + 1]) for k, (x, y) in enumerate(corners)]
    a, b, c, d, e, f, g, h = find_coefficients(moved, corners)
    y, x = np.mgrid[0:height, 0:width] + 0.5
    below = g * x + h * y + 1
    return bicubic(plane, (a * x + b * y + c) / below, (d * x + e * y + f) / below)


Draw = Callable[[str], float]


@dataclass(frozen=True)
class RandomRotate:
    """Turns by an angle of the range, in degrees, with probability ``prob``."""

    angle_range: tuple[float, float] = (-30.0, 30.0)
    prob: float = 1.0

    def __call__(self, plane: np.ndarray, draw: Draw) -> np.ndarray:
        if draw("rotate") >= self.prob:
            return plane
        a, b = self.angle_range
        return rotate(plane, a + (b - a) * draw("angle"))


@dataclass(frozen=True)
class RandomBlur:
    """Blurs by a radius of the range with probability ``prob``."""

    radius_range: tuple[float, float] = (0.1, 2.0)
    prob: float = 1.0

    def __call__(self, plane: np.ndarray, draw: Draw) -> np.ndarray:
        if draw("blur") >= self.prob:
            return plane
        a, b = self.radius_range
        return blur(plane, a + (b - a) * draw("radius"))


@dataclass(frozen=True)
class RandomPerspective:
    """Moves each corner coordinate by up to ``margin`` pixels with probability ``prob``."""

    margin: int = 10
    prob: float = 1.0

    def __call__(self, plane: np.ndarray, draw: Draw) -> np.ndarray:
        if draw("perspective") >= self.prob:
            return plane
        m = self.margin
        return perspective(plane, [-m + math.floor(draw(f"corner{k}") * (2 * m + 1)) for k in range(8)])


@dataclass(frozen=True)
class AugmentationPipeline:
    """Augmentations one after another. Each is called with the plane and a source of draws by name."""

    augmentations: tuple[Callable[[np.ndarray, Draw], np.ndarray], ...]

    def __call__(self, plane: np.ndarray, draw: Draw) -> np.ndarray:
        for a in self.augmentations:
            plane = a(plane, draw)
        return plane


def visible_ratio(alpha: np.ndarray, over: int = 20) -> float:
    """The share of pixels whose alpha is over the threshold; an empty plane is an error."""
    if not alpha.size:
        raise ValueError("the image has no pixels")
    return float((alpha > over).mean())


def compose(alpha: np.ndarray, crop: np.ndarray, factor: float) -> np.ndarray:
    """The text, in the crop's mean colour darkened by ``factor``, over the crop: an opaque image of four channels."""
    colour = np.floor(crop.reshape(-1, 3).mean(axis=0) * factor).astype(int)
    a = alpha.astype(int)[..., None]
    mixed = (colour * a + crop.astype(int) * (255 - a) + 127) // 255
    return np.dstack([mixed, np.full(alpha.shape, 255)]).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """An array of rows, columns and 3 or 4 channels as PNG."""
    height, width, channels = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def pixels(content: bytes, width: int, height: int, channels: int) -> np.ndarray | None:
    """Three channels, red first, of a picture as Spark's image source gives it (blue first); None if it has no pixels."""
    if width <= 0 or height <= 0 or channels not in (1, 3, 4):
        return None
    rows = np.frombuffer(content, np.uint8).reshape(height, width, channels)
    return np.repeat(rows, 3, axis=2) if channels == 1 else rows[..., 2::-1]
