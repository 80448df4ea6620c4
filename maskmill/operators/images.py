"""Pixel functions of gray images and masks, in numpy for use in Arrow batches.

An image is a 2-D array; in tables it is height, width and row-major bytes, so a row
carries one binary value however large the image.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG (gray, gray+alpha, RGB or RGBA), not interlaced: 2-D for
    gray, 3-D for the others. Raises ValueError for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, idat, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, depth = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, 1 + width * depth)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    out = np.zeros((height, width * depth), np.uint8)
    for y in range(height):
        line, above = raw[y, 1:].astype(np.int32), out[y - 1].astype(np.int32) if y else np.zeros(width * depth, np.int32)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + above) & 255
        elif kind == 1:
            out[y] = (line.reshape(width, depth).cumsum(0) & 255).reshape(-1)
        else:
            done = np.zeros(width * depth, np.int32)
            for x in range(width * depth):
                left, corner = (done[x - depth], above[x - depth]) if x >= depth else (0, 0)
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                done[x] = (line[x] + guess) & 255
            out[y] = done
    return out.reshape(height, width) if depth == 1 else out.reshape(height, width, depth)


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    height, width = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def resize_nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = (np.arange(height) * image.shape[0]) // height, (np.arange(width) * image.shape[1]) // width
    return image[y][:, x]


def _overlaps(source: int, target: int) -> np.ndarray:
    """How much of each target cell each source cell covers."""
    edge = np.arange(target + 1) * source / target
    lo, hi = np.maximum(edge[:-1, None], np.arange(source)[None, :]), np.minimum(edge[1:, None], np.arange(1, source + 1)[None, :])
    cover = np.clip(hi - lo, 0, None)
    return cover / cover.sum(1, keepdims=True)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target pixel covers."""
    return _overlaps(image.shape[0], height) @ image.astype(float) @ _overlaps(image.shape[1], width).T


def resize_linear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between pixel centres."""

    def places(source: int, target: int):
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, source - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(image.shape[0], height), places(image.shape[1], width)
    im = image.astype(float)
    top, low = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx, im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return top * (1 - fy[:, None]) + low * fy[:, None]


def square_fit(height: int, width: int, side: int) -> tuple[int, int, int, int]:
    """(height, width, top, left) of a picture scaled into a square, the rest padded."""
    scale = side / max(height, width)
    nh, nw = max(1, min(side, round(height * scale))), max(1, min(side, round(width * scale)))
    return nh, nw, (side - nh) // 2, (side - nw) // 2


def fit_mask(mask: np.ndarray, side: int, keep_aspect: bool = True) -> np.ndarray:
    """A mask as ``fit_square`` leaves it, without a picture."""
    if not keep_aspect:
        return resize_nearest(mask, side, side)
    nh, nw, top, left = square_fit(*mask.shape, side)
    out = np.zeros((side, side), mask.dtype)
    out[top : top + nh, left : left + nw] = resize_nearest(mask, nh, nw)
    return out


def fit_square(image: np.ndarray, mask: np.ndarray, side: int, keep_aspect: bool = True) -> tuple[np.ndarray, np.ndarray, dict]:
    """Image and mask on a square together: warped, or scaled and padded with zeros."""
    h, w = image.shape
    if not keep_aspect:
        return resize_linear(image, side, side), resize_nearest(mask, side, side), {"height": side, "width": side, "top": 0, "left": 0}
    nh, nw, top, left = square_fit(h, w, side)
    out = np.zeros((side, side))
    out[top : top + nh, left : left + nw] = resize_linear(image, nh, nw)
    return out, fit_mask(mask, side), {"height": nh, "width": nw, "top": top, "left": left}


def normalize(image: np.ndarray, mean: float, std: float) -> np.ndarray:
    return (image.astype(float) / 255.0 - mean) / std


def thumbnail(image: np.ndarray, side: int = 64) -> np.ndarray:
    """Area-resized, zero mean, unit norm (zeros if flat)."""
    t = resize_area(image, side, side).ravel()
    t = t - t.mean()
    n = np.linalg.norm(t)
    return (t / n if n > 0 else t).astype(np.float32)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected parts, in scan order of their first pixel.

    Rows are taken as runs of set pixels; runs of neighbouring rows that touch are joined,
    so the work grows with the runs, not with the pixels.
    """
    edge = np.diff(np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above, last = 0, 0
    r, lo, hi = rows.tolist(), starts.tolist(), ends.tolist()
    for i in range(len(r)):
        if i and r[i] != r[i - 1]:
            above, last = (last, i) if r[i] == r[i - 1] + 1 else (i, i)
        while above < last and hi[above] < lo[i]:  # touching at a corner counts
            above += 1
        j = above
        while j < last and lo[j] <= hi[i]:
            low, high = sorted((find(i), find(j)))
            parent[high] = low
            j += 1
    roots = np.array([find(i) for i in range(len(r))], np.int64)
    labels = np.searchsorted(np.unique(roots), roots) + 1
    out = np.zeros(mask.shape, np.int64)
    for i, label in enumerate(labels.tolist()):
        out[r[i], lo[i] : hi[i]] = label
    return out


def geometry(mask: np.ndarray) -> dict:
    """Lesion pixels, number of parts and bounding box (x, y, w, h; None if empty)."""
    y, x = np.nonzero(mask)
    box = None if not len(y) else (int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1))
    return {"lesion_pixels": int(len(y)), "connected_components": int(components(mask).max()) if len(y) else 0, "box": box}


def otsu(image: np.ndarray) -> int:
    """Threshold of the largest variance between the two sides."""
    n = np.bincount(image.astype(np.uint8).ravel(), minlength=256).astype(float)
    w, s = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w - s * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def largest_part_box(image: np.ndarray, margin: int = 10) -> tuple[int, int, int, int]:
    """Box (x, y, w, h) around the largest bright part with a margin; all if there is none."""
    labels = components(image > otsu(image))
    if not labels.max():
        return 0, 0, image.shape[1], image.shape[0]
    part = labels == np.argmax(np.bincount(labels.ravel())[1:]) + 1
    y, x = np.nonzero(part)
    x0, y0 = max(0, int(x.min()) - margin), max(0, int(y.min()) - margin)
    return x0, y0, min(image.shape[1], int(x.max()) + margin + 1) - x0, min(image.shape[0], int(y.max()) + margin + 1) - y0


def decode_bitmap(text: str) -> np.ndarray:
    """Mask of base64 text of a zlib-packed PNG; the last channel counts."""
    try:
        image = decode_png(zlib.decompress(base64.b64decode(text, validate=True)))
    except (zlib.error, ValueError) as e:
        raise ValueError(f"no bitmap: {e}") from None
    return (image if image.ndim == 2 else image[:, :, -1]) > 0


def paste(canvas: np.ndarray, bitmap: np.ndarray, x: int, y: int) -> None:
    """Set the bitmap's pixels, cut at the canvas."""
    y0, x0, y1, x1 = max(0, y), max(0, x), min(canvas.shape[0], y + bitmap.shape[0]), min(canvas.shape[1], x + bitmap.shape[1])
    if y1 > y0 and x1 > x0:
        canvas[y0:y1, x0:x1] |= bitmap[y0 - y : y1 - y, x0 - x : x1 - x]


def fill_polygon(canvas: np.ndarray, exterior: list, interior: list = ()) -> None:
    """Set pixels whose centre is inside, and those of the outline; holes stay unset."""
    h, w = canvas.shape
    yy, xx = np.mgrid[0:h, 0:w]

    def inside(points: np.ndarray) -> np.ndarray:
        out = np.zeros((h, w), bool)
        for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0), strict=True):
            crosses = (yy >= min(y0, y1)) & (yy < max(y0, y1))
            if y0 != y1:
                out ^= crosses & (xx < x0 + (yy - y0) * (x1 - x0) / (y1 - y0))
        return out

    shape = np.asarray(exterior, float)
    if len(shape) < 3:
        return
    filled = inside(shape)
    for (x0, y0), (x1, y1) in zip(shape, np.roll(shape, -1, axis=0), strict=True):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        x, y = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        filled[y[ok], x[ok]] = True
    for hole in interior or ():
        if len(hole) >= 3:
            filled &= ~inside(np.asarray(hole, float))
    canvas |= filled


def draw_object(canvas: np.ndarray, obj: dict) -> None:
    """One annotation object: a bitmap, a polygon or a rectangle of two corners."""
    kind = (obj.get("geometryType") or "").lower()
    if kind == "bitmap" and obj.get("bitmap"):
        x, y = obj["bitmap"]["origin"]
        paste(canvas, decode_bitmap(obj["bitmap"]["data"]), x, y)
    elif obj.get("points"):
        outer = obj["points"].get("exterior") or []
        if kind == "rectangle" and len(outer) == 2:
            (x0, y0), (x1, y1) = outer
            canvas[max(0, int(min(y0, y1))) : int(max(y0, y1)) + 1, max(0, int(min(x0, x1))) : int(max(x0, x1)) + 1] = True
        else:
            fill_polygon(canvas, outer, obj["points"].get("interior"))


def surface_distances(target: np.ndarray, prediction: np.ndarray) -> tuple[float | None, float | None]:
    """(HD95, ASSD) of two masks in pixels, from boundary to boundary both ways; None if
    one is empty. A boundary pixel has a 4-neighbour outside (or the image edge)."""

    def edge(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])

    a, b = np.argwhere(edge(target > 0)).astype(float), np.argwhere(edge(prediction > 0)).astype(float)
    if not len(a) or not len(b):
        return None, None

    def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        size = (y * y).sum(1)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]  # whole numbers, so the squares are exact
            out[at : at + 512] = (size[None, :] - 2 * (part @ y.T)).min(1) + (part * part).sum(1)
        return np.sqrt(out)

    both = np.concatenate([nearest(a, b), nearest(b, a)])
    return float(np.percentile(both, 95)), float(both.mean())


def surface_table(pairs: DataFrame, key: str, height: str, width: str, target: str, prediction: str) -> DataFrame:
    """(key, hd95, assd) of mask pairs held as bytes; rows stay in their partition."""
    slim = pairs.select(F.col(key).alias("k"), F.col(height).cast("int"), F.col(width).cast("int"), F.col(target).cast("binary"), F.col(prediction).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for h, w, t, p in zip(*[b.column(i).to_pylist() for i in range(1, 5)], strict=True):
                d = (None, None) if None in (h, w, t, p) else surface_distances(*[np.frombuffer(x, np.uint8).reshape(h, w) for x in (t, p)])
                out[0].append(d[0])
                out[1].append(d[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64())], names=[key, "hd95", "assd"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema['k'].dataType.simpleString()}, hd95 double, assd double")


def union_masks(pixels: DataFrame, *keys: str) -> DataFrame:
    """Per-pixel union of several masks in long form (keys, y, x, value)."""
    return pixels.groupBy(*keys, "y", "x").agg(F.max((F.col("value") > 0).cast("int")).alias("value"))


def merge_masks(masks: list[bytes | None], shape: tuple[int, int]) -> tuple[np.ndarray, list[str]]:
    """(union, notes) of the masks (PNG) of one picture; a mask that cannot be read or has
    another shape is a note and adds nothing."""
    out, notes = np.zeros(shape, bool), []
    for i, data in enumerate(masks):
        try:
            mask = decode_png(data or b"")
        except ValueError:
            notes.append(f"mask_{i}_unreadable")
            continue
        mask = mask if mask.ndim == 2 else mask[:, :, 0]
        if mask.shape != tuple(shape):
            notes.append(f"mask_{i}_shape_mismatch")
        else:
            out |= mask > 0
    return out, notes


def pixel_digest(data: bytes) -> str | None:
    """sha256 of dtype, shape and pixels of a picture; None if it cannot be read."""
    try:
        image = decode_png(data)
    except (ValueError, TypeError):
        return None
    head = image.dtype.str.encode() + b"".join(struct.pack("<q", n) for n in image.shape)
    return hashlib.sha256(head + image.tobytes()).hexdigest()


def prior_members(files: DataFrame) -> DataFrame:
    """(digest, split, name) of the pictures of an earlier tree ``split/images/name``, from
    (path, content); unreadable ones are left out."""
    parts = F.split("path", "/")
    slim = files.select(F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "content").filter("folder = 'images'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pixel_digest(x) for x in b.column(2).to_pylist()], pa.string()), b.column(0), b.column(1)], names=["digest", "split", "name"])

    return slim.select("split", "name", "content").mapInArrow(run, "digest string, split string, name string").filter("digest is not null")


def checked_samples(manifest: DataFrame, files: DataFrame, key: str = "sample_id", label: str = "class_id", image: str = "image_path", mask: str = "mask_path") -> DataFrame:
    """(key, label, height, width, lesion_pixels, problem) of manifest rows joined to their
    picture and mask (``files``: path, content); pixels are read where the files are.

    ``problem`` is NULL for a sound sample, else the first of: missing or unreadable image,
    missing or unreadable mask, another shape, a value that is neither 0 nor the label, no
    lesion in a lesion class.
    """
    slim = manifest.select(F.col(key).alias("k"), F.col(label).cast("int").alias("c"), F.col(image).alias("__i"), F.col(mask).alias("__m"))
    for side in "im":
        held = files.select(F.col("path").alias(f"__p{side}"), F.col("content").alias(f"d{side}"))
        slim = slim.join(held, F.col(f"__{side}") == F.col(f"__p{side}"), "left").drop(f"__p{side}")

    def judge(c: int | None, image: bytes | None, mask: bytes | None) -> tuple:
        found = []
        for name, data in (("image", image), ("mask", mask)):
            if data is None:
                return (*(found[0].shape[:2] if found else (None, None)), None, f"missing_{name}")
            try:
                found.append(decode_png(data))
            except ValueError:
                return (*(found[0].shape[:2] if found else (None, None)), None, f"unreadable_{name}")
        h, w = found[0].shape[:2]
        m = found[1] if found[1].ndim == 2 else found[1][:, :, 0]
        if m.shape != (h, w):
            return h, w, None, "shape_mismatch"
        n = int(np.count_nonzero(m))
        if np.any((m != 0) & (m != (c or 0))):
            return h, w, n, "foreign_label"
        return h, w, n, "empty_lesion" if c and not n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(*x) for x in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[key, label, "height", "width", "lesion_pixels", "problem"])

    kind = slim.schema["k"].dataType.simpleString()
    return slim.select("k", "c", "di", "dm").mapInArrow(run, f"`{key}` {kind}, `{label}` int, height int, width int, lesion_pixels long, problem string")
