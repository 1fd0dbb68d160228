"""Operators on page images: arrays of height x width (x 3, blue green red), 8 bits. NumPy only; images come as binary columns of known shape."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]


def luminance(image: np.ndarray) -> np.ndarray:
    """Weighted grey of an image with colours, rounded."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299).astype(np.uint8)


def _extent(rows: np.ndarray, cols: np.ndarray) -> tuple[int, int, int, int] | None:
    r, c = np.flatnonzero(rows), np.flatnonzero(cols)
    return (int(c[0]), int(r[0]), int(c[-1]) + 1, int(r[-1]) + 1) if len(r) and len(c) else None


def trimmed(image: np.ndarray, dark: int = 245, padding: int = 10, least: int = 5) -> Box:
    """Around rows and columns with ``least`` pixels darker than ``dark``, padded; the whole image without any."""
    mask = luminance(image) < dark
    h, w = mask.shape
    box = _extent(mask.sum(axis=1) >= least, mask.sum(axis=0) >= least)
    if box is None:
        return 0, 0, w, h
    return max(0, box[0] - padding), max(0, box[1] - padding), min(w, box[2] + padding), min(h, box[3] + padding)


def trimmed_share(image: np.ndarray, white: float = 0.97, least: float = 0.03) -> Box:
    """Around rows and columns of which a share of ``least`` is darker than ``white``; the whole image without any."""
    grey = image.astype(np.float32).mean(axis=2) / 255 if image.ndim == 3 else image.astype(np.float32) / 255
    mask = grey < white
    return _extent(mask.mean(axis=1) >= least, mask.mean(axis=0) >= least) or (0, 0, mask.shape[1], mask.shape[0])


def _longest_run(mask: np.ndarray) -> np.ndarray:
    """Length of the longest run of set pixels in each row."""
    n, w = mask.shape
    padded = np.zeros((n, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    out = np.zeros(n, dtype=np.int64)
    rows, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    np.maximum.at(out, rows, end - start)
    return out


def content_box(image: np.ndarray, span: float = 0.90, border: float = 0.05, dark: int = 200) -> Box:
    """Within a drawn frame: its four innermost lines over 90 % of a side, within 5 % of each border; the whole image if any side has none."""
    mask = luminance(image) <= dark
    h, w = mask.shape
    rows, cols = np.flatnonzero(_longest_run(mask) >= int(w * span)), np.flatnonzero(_longest_run(mask.T) >= int(h * span))
    top, bottom = rows[rows < int(h * border)], rows[rows > int(h * (1 - border))]
    left, right = cols[cols < int(w * border)], cols[cols > int(w * (1 - border))]
    if not all(map(len, (top, bottom, left, right))):
        return 0, 0, w, h
    return int(left.max()), int(top.max()), int(right.min()), int(bottom.min())


def white_share(image: np.ndarray) -> float:
    grey = image.astype(np.float32)
    return float(((grey.mean(axis=2) if image.ndim == 3 else grey) / 255 > 0.95).mean())


def is_white(image: np.ndarray, share: float) -> bool:
    return white_share(image) >= share


def white_profile(grey: np.ndarray, axis: int) -> np.ndarray:
    """Share of white in each row (axis 0) or column (axis 1) of an image of 0..1."""
    return (grey > 0.95).mean(axis=1 - axis)


def white_blocks(grey: np.ndarray, least: float = 0.02, white: float = 0.95) -> list[Box]:
    """Boxes around connected white areas (eight neighbours) that no other encloses, if 2 % of the image or more, largest first."""
    mask = grey > white
    h, w = mask.shape
    label = np.zeros((h, w), dtype=np.int64)
    parent = [0]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    before: list[tuple[int, int, int]] = []  # runs of the row above: start, end, label
    for y in range(h):
        edge = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        now = []
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            touching = [k for a, b, k in before if a <= e and b >= s]
            if touching:
                own = min(map(root, touching))
                for k in touching:
                    parent[root(k)] = own
            else:
                own = len(parent)
                parent.append(own)
            label[y, s:e] = own
            now.append((s, e, own))
        before = now
    roots = np.array([root(k) for k in range(len(parent))])
    label = roots[label]
    boxes = {}
    for y in range(h):
        for k in np.unique(label[y][label[y] > 0]).tolist():
            x = np.flatnonzero(label[y] == k)
            b = boxes.get(k, (w, y, 0, y))
            boxes[k] = (min(b[0], int(x[0])), b[1], max(b[2], int(x[-1]) + 1), y + 1)
    outer = [b for k, b in boxes.items() if not _enclosed(label, k, b)]
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return sorted((b for b in outer if area(b) >= int(w * h * least)), key=lambda b: -area(b))


def _enclosed(label: np.ndarray, own: int, box: Box) -> bool:
    """Whether another white area surrounds this one: seen in its outline's parents, so only areas inside another one's box can be."""
    x1, y1, x2, y2 = box
    if x1 == 0 or y1 == 0 or x2 == label.shape[1] or y2 == label.shape[0]:
        return False
    row = label[(y1 + y2 - 1) // 2]
    left, right = set(row[:x1].tolist()) - {0, own}, set(row[x2:].tolist()) - {0, own}
    column = label[:, (x1 + x2 - 1) // 2]
    above, below = set(column[:y1].tolist()) - {0, own}, set(column[y2:].tolist()) - {0, own}
    return bool(left & right & above & below)


def whitened(image: np.ndarray, boxes: list[Box], inset: int = 0) -> np.ndarray:
    """A copy with rectangles painted white, drawn in by ``inset``."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1 + inset) : max(0, y2 - inset), max(0, x1 + inset) : max(0, x2 - inset)] = 255
    return out


def png(image: np.ndarray) -> bytes:
    """The image (grey, or blue green red) as a PNG file."""
    rows = image if image.ndim == 2 else image[..., ::-1]
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows, np.uint8).reshape(h, -1)], axis=1).tobytes()  # each row unfiltered

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def data_url(file: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(file).decode()}"


def cropped(images: DataFrame, boxes: DataFrame, padding: int = 0) -> DataFrame:
    """images (page, w, h, pixels: grey or blue green red bytes), boxes (page, ord, corners) -> (page, ord, corners, file: PNG, white: share of white pixels).

    Boxes grow by the padding and end at the image's borders; an empty one gives no row. A page's image meets its boxes in one row each.
    """
    around = boxes.groupBy("page").agg(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch.itertuples(index=False):
                a = np.frombuffer(page.pixels, np.uint8)
                a = a.reshape(page.h, page.w) if len(a) == page.h * page.w else a.reshape(page.h, page.w, 3)
                rows = []
                for b in page.boxes:
                    x1, y1, x2, y2 = max(0, b["x1"] - padding), max(0, b["y1"] - padding), min(page.w, b["x2"] + padding), min(page.h, b["y2"] + padding)
                    if x1 < x2 and y1 < y2:
                        own = a[y1:y2, x1:x2]
                        rows.append((page.page, b["ord"], x1, y1, x2, y2, png(own), white_share(own)))
                yield pd.DataFrame(rows, columns=["page", "ord", "x1", "y1", "x2", "y2", "file", "white"])

    both = images.select("page", "w", "h", "pixels").join(around, "page")
    return both.mapInPandas(run, "page long, ord long, x1 long, y1 long, x2 long, y2 long, file binary, white double")


def boxes_of(images: DataFrame, kind: str) -> DataFrame:
    """images (page, w, h, pixels: grey bytes) -> (page, corners) of ``trimmed``, ``content_box`` or ``white_blocks``."""
    find = {"trimmed": lambda a: [trimmed(a)], "content_box": lambda a: [content_box(a)], "white_blocks": lambda a: white_blocks(a / 255)}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.page, *b) for r in batch.itertuples(index=False) for b in find(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w))]
            yield pd.DataFrame(rows, columns=["page", "x1", "y1", "x2", "y2"])

    return images.select("page", "w", "h", "pixels").mapInPandas(run, "page long, x1 long, y1 long, x2 long, y2 long")
