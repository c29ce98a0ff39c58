"""From images to column counts: small array steps inside Arrow batches, everything after them is tables.

A segmenter is a function from a BGR array (height, width, 3) to a mask; two are given. Each row of images is
segmented on its own, so the work splits as the files do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Segmenter = Callable[[np.ndarray], np.ndarray]


def crop(image: np.ndarray, roi: tuple[int, int, int, int] | None) -> np.ndarray:
    """The region x, y, w, h of an image; raises unless it lies inside."""
    if roi is None:
        return image
    x, y, w, h = roi
    if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > image.shape[1] or y + h > image.shape[0]:
        raise ValueError(f"region {roi} is not inside {image.shape[1]} x {image.shape[0]}")
    return image[y : y + h, x : x + w]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded to whole levels."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def _shifted(a: np.ndarray, offsets: np.ndarray, best, fill) -> np.ndarray:
    """best of the values at the offsets (rows, columns) from each place; ``fill`` beyond the edges."""
    r = int(np.abs(offsets).max(initial=0))
    wide = np.pad(a, r, constant_values=fill)
    out = np.full(a.shape, fill, a.dtype)
    for dy, dx in offsets:
        out = best(out, wide[r + dy : r + dy + a.shape[0], r + dx : r + dx + a.shape[1]])
    return out


def ellipse(size: int) -> np.ndarray:
    """Offsets of a filled ellipse of odd size."""
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    reach = np.round(r * np.sqrt(np.maximum(0, 1 - (np.arange(-r, r + 1) / max(r, 1)) ** 2))).astype(int) if r else np.zeros(1, int)
    return np.argwhere(np.abs(x) <= reach[y + r]) - r


def disk(r: int) -> np.ndarray:
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return np.argwhere(x * x + y * y <= r * r) - r


def _ends(a: np.ndarray) -> tuple:
    return (False, True) if a.dtype == bool else (0, 255) if a.dtype == np.uint8 else (-np.inf, np.inf)


def dilated(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _shifted(a, offsets, np.maximum, _ends(a)[0])


def eroded(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return _shifted(a, offsets, np.minimum, _ends(a)[1])


def closed(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return eroded(dilated(a, offsets), offsets)


def otsu(levels: np.ndarray) -> int:
    """The threshold of whole levels with the largest variance between the two sides."""
    n = np.bincount(levels.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    mass = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def equalised(levels: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation by tiles, interpolated between their centres."""
    h, w = levels.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(levels, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    area = th * tw
    limit = max(1, int(clip * area / 256))
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over // 256
            if rest := int(over % 256):
                n[np.arange(0, 256, max(256 // rest, 1))[:rest]] += 1
            curves[i, j] = np.clip(np.round(np.cumsum(n) * 255.0 / area), 0, 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda a, n: np.clip(a, 0, n - 1)
    pick = lambda a, b: curves[at(a, tiles)[:, None], at(b, tiles)[None], levels]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
    low = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
    return np.clip(np.round(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def components(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Labels of connected places from 1, 0 elsewhere; places that touch by a corner count as connected if ``diagonal``."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = np.array([(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or not (dy and dx)])
    while True:
        new = np.where(mask, _shifted(label, steps, np.maximum, 0), 0)
        flat = new.ravel()
        for _ in range(2):  # a label is the place of its root: jump to the root's own label
            flat = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0)
        new = np.maximum(new, flat.reshape(mask.shape))
        if (new == label).all():
            break
        label = new
    _, out = np.unique(label, return_inverse=True)
    return out.reshape(mask.shape) + (0 if (label == 0).any() else 1)


def without_small(mask: np.ndarray, least: int, diagonal: bool) -> np.ndarray:
    """The mask without components of fewer places than ``least``."""
    if least <= 0:
        return mask
    label = components(mask, diagonal)
    return mask & (np.bincount(label.ravel())[label] >= least)


def without_wall_lines(mask: np.ndarray, share: float = 0.80, most_height: int = 12) -> np.ndarray:
    """The mask without components that are as wide as ``share`` of it and at most ``most_height`` high."""
    label = components(mask, True)
    out = mask.copy()
    for i in range(1, int(label.max()) + 1):
        y, x = np.nonzero(label == i)
        if x.max() - x.min() + 1 >= share * mask.shape[1] and y.max() - y.min() + 1 <= most_height:
            out[y, x] = False
    return out


@dataclass(frozen=True)
class Baseline:
    """Dark outlines on a bright ground: equalise, black-hat, threshold, close, dilate, drop small components."""

    roi: tuple[int, int, int, int] | None = None
    blackhat_kernel: int = 17
    min_area_px: int = 12
    close_kernel: int = 3
    dilate_iterations: int = 1

    def __call__(self, image: np.ndarray) -> np.ndarray:
        odd = lambda k: max(1, int(k)) + (1 - max(1, int(k)) % 2)
        levels = equalised(grey(crop(image, self.roi)))
        hat = closed(levels, ellipse(odd(self.blackhat_kernel))) - levels
        kernel = ellipse(odd(self.close_kernel))
        mask = closed(hat > otsu(hat), kernel)
        for _ in range(self.dilate_iterations):
            mask = dilated(mask, kernel)
        return without_small(mask, self.min_area_px, diagonal=True)


def _box_mean(a: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    s = np.pad(np.pad(a, r, mode="symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def features(levels: np.ndarray) -> np.ndarray:
    """(height, width, 5): grey in [0, 1], darker than around by, edge, black-hat, height from 0 to 1."""
    g = np.clip(levels / 255.0, 0, 1)
    p = np.pad(g, 1, mode="symmetric")
    dx = (p[:, 2:] - p[:, :-2]) / 2
    dy = (p[2:] - p[:-2]) / 2
    smooth = lambda a, axis: np.apply_along_axis(lambda v: np.convolve(v, [0.25, 0.5, 0.25], "valid"), axis, a)
    edge = np.sqrt((smooth(dx, 0) ** 2 + smooth(dy, 1) ** 2) / 2)
    y = np.broadcast_to(np.linspace(0, 1, g.shape[0])[:, None], g.shape)
    return np.stack([g, np.clip(_box_mean(g, 17) - g, 0, 1), edge, closed(g, disk(7)) - g, y], axis=2)


@dataclass(frozen=True)
class PixelModel:
    """The Gaussian classifier of pixels, with the mask cleaned up; fields as in a model file."""

    foreground_mean: tuple[float, ...]
    foreground_std: tuple[float, ...]
    background_mean: tuple[float, ...]
    background_std: tuple[float, ...]
    foreground_prior: float
    threshold: float = 0.5
    roi: tuple[int, int, int, int] | None = None
    min_area_px: int = 20
    clear_top_px: int = 6

    def __call__(self, image: np.ndarray) -> np.ndarray:
        x = features(grey(crop(image, self.roi)))
        near = lambda m, s: -0.5 * (((x - m) / s) ** 2 + 2 * np.log(s) + np.log(2 * np.pi)).sum(2)
        odds = near(np.array(self.background_mean), np.array(self.background_std)) + np.log(1 - self.foreground_prior + 1e-9)
        odds -= near(np.array(self.foreground_mean), np.array(self.foreground_std)) + np.log(self.foreground_prior + 1e-9)
        mask = 1 / (1 + np.exp(np.clip(odds, -60, 60))) >= self.threshold
        mask[: self.clear_top_px] = False
        return without_wall_lines(without_small(closed(mask, disk(1)), self.min_area_px, diagonal=False))


def polygon_mask(points: list[tuple[float, float]], height: int, width: int) -> np.ndarray:
    """Places inside a polygon or on its outline."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        line = np.round(np.linspace((x1, y1), (x2, y2), n + 1)).astype(int)
        line = line[(line[:, 0] >= 0) & (line[:, 0] < width) & (line[:, 1] >= 0) & (line[:, 1] < height)]
        inside[line[:, 1], line[:, 0]] = True
    return inside


def overlay(image: np.ndarray, mask: np.ndarray, share: float = 0.22) -> np.ndarray:
    """The image (BGR) with the mask in red; both fade as their shares say."""
    red = np.zeros_like(image)
    red[..., 2] = mask * 255
    return np.clip(np.round(image * (1 - share) + red * share), 0, 255).astype(np.uint8)


def _masks(batches: Iterator[pa.RecordBatch], segmenter: Segmenter) -> Iterator[tuple[str, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
            yield row["path"], segmenter(np.repeat(image, 3, axis=2) if row["channels"] == 1 else image[..., :3])


def column_counts(images: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(path, height, width, col_counts) of the mask of each image (path, height, width, channels, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, mask in _masks(batches, segmenter):
            yield pa.RecordBatch.from_pylist([{"path": path, "height": mask.shape[0], "width": mask.shape[1], "col_counts": np.count_nonzero(mask, axis=0).tolist()}], schema=OUT)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, height int, width int, col_counts array<int>")


def mask_runs(images: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(path, y, x0, x1): the runs of the mask of each image, see runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, mask in _masks(batches, segmenter):
            edge = np.diff(np.pad(mask.astype(np.int8), [(0, 0), (1, 1)]), axis=1)
            (y, x0), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(y), pa.string()), *(pa.array(v, pa.int32()) for v in (y, x0, end - 1))], ["path", "y", "x0", "x1"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, y int, x0 int, x1 int")


def _pixels(row: dict) -> np.ndarray:
    image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    return np.repeat(image, 3, axis=2) if row["channels"] == 1 else image[..., :3]


def grey_images(images: DataFrame) -> DataFrame:
    """(path, height, width, levels): the luma of images (path, height, width, channels, data), line by line, from 0 to 1 in steps of 1 / 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = grey(_pixels(row)).astype(np.float32) / np.float32(255)
                yield pa.RecordBatch.from_arrays([pa.array([row[c]]) for c in ("path", "height", "width")] + [pa.array([levels.ravel()])], ["path", "height", "width", "levels"]).cast(GREY)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, height int, width int, levels array<float>")


def rgb_images(images: DataFrame) -> DataFrame:
    """(path, height, width, data): the bytes of images in the order red, green, blue; one channel is repeated, a fourth goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("path", "height", "width")}, "data": _pixels(row)[..., ::-1].tobytes()}], schema=RGB)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, height int, width int, data binary")


GREY = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("levels", pa.list_(pa.float32()))])
RGB = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])


def frames_of(images: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, height, width) of the masks of images."""
    return images.select("path", F.lit(roi[3]).alias("height") if roi else "height", F.lit(roi[2]).alias("width") if roi else "width")


def pixel_rows(images: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, pixel, features) of every pixel of each image: the input of a pixel model's fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])[..., :3]
                x = features(grey(crop(image, roi))).reshape(-1, 5)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(x) + 1, 5, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(x)), pa.array(np.arange(len(x), dtype=np.int64)), lists], ["path", "pixel", "features"])

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, pixel long, features array<double>")


OUT = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("col_counts", pa.list_(pa.int32()))])
