"""Axis-parallel strokes of vector drawings: path data, transforms, and the walk through a page's groups."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TOKEN = re.compile(rf"([MmHhVvLlZz])|({_NUMBER})")
#: A stroke is level or upright if it leaves its axis by less than AXIS px, and counts if longer than LENGTH.
AXIS, LENGTH = 6, 8
#: Strokes this wide block the positions around them.
THICK, BLOCKED = 4.0, 14


def matrix_of(transform: str | None) -> Matrix:
    """Of ``matrix(...)`` or ``translate(...)``; the identity for anything else."""
    kind, _, rest = (transform or "").partition("(")
    values = [float(v) for v in re.findall(_NUMBER, rest.partition(")")[0])]
    if kind == "matrix" and len(values) == 6:
        return tuple(values)
    if kind == "translate" and values:
        return (1.0, 0.0, 0.0, 1.0, values[0], values[1] if len(values) > 1 else 0.0)
    return IDENTITY


def product(a: Matrix, b: Matrix) -> Matrix:
    """First b, then a."""
    (a0, a1, a2, a3, a4, a5), (b0, b1, b2, b3, b4, b5) = a, b
    return (a0 * b0 + a2 * b1, a1 * b0 + a3 * b1, a0 * b2 + a2 * b3, a1 * b2 + a3 * b3, a0 * b4 + a2 * b5 + a4, a1 * b4 + a3 * b5 + a5)


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def strokes(path: str) -> Iterator[tuple[float, float, float, float]]:
    """Straight strokes of path data: moves, lines, level and upright lines, absolute or relative. Closing a path draws nothing here."""
    numbers = {"M": 2, "L": 2, "H": 1, "V": 1}
    command, waiting, x, y = "M", [], 0.0, 0.0
    for letter, number in _TOKEN.findall(path):
        if letter:
            command, waiting = letter, []
            continue
        kind = command.upper()
        if kind not in numbers:
            continue
        waiting.append(float(number))
        if len(waiting) < numbers[kind]:
            continue
        base = (x, y) if command.islower() else (0.0, 0.0)
        to = {"H": (waiting[0] + base[0], y), "V": (x, waiting[0] + base[1])}.get(kind) or (waiting[0] + base[0], waiting[1] + base[1])
        waiting = []
        if kind == "M":
            command = "l" if command == "m" else "L"  # further pairs are lines
        else:
            yield x, y, *to
        x, y = to


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _paths(node: ET.Element, outer: Matrix, layer: str | None, inside: bool) -> Iterator[tuple[ET.Element, Matrix]]:
    tag, own = _tag(node), matrix_of(node.get("transform"))
    inside = inside or layer is None or any(k.endswith("label") and v == layer for k, v in node.attrib.items())
    here = product(outer, own) if tag == "g" else outer
    if tag == "path" and inside:
        yield node, product(outer, own)
    for child in node:
        yield from _paths(child, here, layer, inside)


def _width(node: ET.Element) -> float | None:
    found = re.search(rf"stroke-width\s*:\s*({_NUMBER})", node.get("style") or "")
    value = node.get("stroke-width") or (found[1] if found else None)
    return float(re.match(_NUMBER, value)[0]) if value and re.match(_NUMBER, value) else None


def rulings(svg: str, w: int, h: int, scale: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0), layer: str | None = "3") -> list[tuple[str, int, float, float]]:
    """(axis, pos, s0, s1) in pixels of the level and upright strokes, first of the named layer, else of all; none near a thick stroke.

    Positions are rounded half to even.
    """
    root = ET.fromstring(svg)
    for wanted in (layer, None) if layer is not None else (None,):
        found, thick = [], []
        for node, m in _paths(root, IDENTITY, wanted, False):
            size = math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) or 1.0
            wide = (_width(node) or 0.0) * size >= THICK
            for stroke in strokes(node.get("d") or ""):
                (x1, y1), (x2, y2) = moved(m, *stroke[:2]), moved(m, *stroke[2:])
                x1, x2 = ((x - origin[0]) * scale[0] for x in (x1, x2))
                y1, y2 = ((y - origin[1]) * scale[1] for y in (y1, y2))
                dx, dy = abs(x2 - x1), abs(y2 - y1)
                if dy < AXIS and dx > LENGTH:
                    (thick if wide else found).append(("h", round((y1 + y2) / 2), min(x1, x2), max(x1, x2)))
                elif dx < AXIS and dy > LENGTH:
                    (thick if wide else found).append(("v", round((x1 + x2) / 2), min(y1, y2), max(y1, y2)))
        limit = {"h": h, "v": w}
        found = [s for s in found if 0 <= s[1] <= limit[s[0]]]
        if found:
            break
    blocked = {(s[0], s[1]) for s in thick}
    return [s for s in found if not any(a == s[0] and abs(p - s[1]) <= BLOCKED for a, p in blocked)]


def svg_segments(drawings: DataFrame) -> DataFrame:
    """drawings (page, svg, w, h) -> segments (page, axis, pos, s0, s1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.page, *s) for r in batch.itertuples(index=False) for s in rulings(r.svg, r.w, r.h)]
            yield pd.DataFrame(rows, columns=["page", "axis", "pos", "s0", "s1"])

    return drawings.select("page", "svg", "w", "h").mapInPandas(run, "page long, axis string, pos long, s0 double, s1 double")
