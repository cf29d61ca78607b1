"""Colour tables in .cube text: reader, writer and trilinear lookup in column functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Cube:
    size: int
    rows: list[tuple[float, float, float]]
    title: str = ""
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = field(default=(1.0, 1.0, 1.0))


def parse_cube(text: str) -> Cube:
    """Keywords and rows of three numbers; comments and blank lines are skipped, a wrong number of rows is an error."""
    size, title, low, high, rows = 0, "", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        word, _, rest = line.partition(" ")
        if word == "TITLE":
            title = rest.strip().strip('"')
        elif word == "LUT_3D_SIZE":
            size = int(rest)
        elif word in ("DOMAIN_MIN", "DOMAIN_MAX"):
            three = tuple(map(float, rest.split()))
            low, high = (three, high) if word == "DOMAIN_MIN" else (low, three)
        else:
            rows.append(tuple(map(float, line.split())))
    if size < 2 or len(rows) != size**3 or any(len(r) != 3 for r in rows):
        raise ValueError("not a whole three-dimensional table")
    return Cube(size, rows, title, low, high)


def format_cube(cube: Cube) -> str:
    head = [f'TITLE "{cube.title}"', f"LUT_3D_SIZE {cube.size}", "DOMAIN_MIN " + " ".join(map(str, cube.low)), "DOMAIN_MAX " + " ".join(map(str, cube.high))]
    return "\n".join(head + [f"{r:.6f} {g:.6f} {b:.6f}" for r, g, b in cube.rows]) + "\n"


def apply_cube(cube: Cube, r: Column, g: Column, b: Column) -> Column:
    """Trilinear interpolation of colours within the domain, as an array of three."""
    table = F.array(*[F.array(*map(F.lit, row)) for row in cube.rows])
    n = cube.size
    low, part = [], []
    for k, c in enumerate((r, g, b)):
        place = F.least(F.greatest((c - cube.low[k]) / (cube.high[k] - cube.low[k]), F.lit(0.0)), F.lit(1.0)) * (n - 1)
        low.append(F.least(F.floor(place), F.lit(n - 2)).cast("int"))
        part.append(place - low[k])
    out = []
    for channel in range(3):
        total = F.lit(0.0)
        for corner in range(8):
            step = [corner >> k & 1 for k in range(3)]
            weight = F.lit(1.0)
            for k in range(3):
                weight = weight * (part[k] if step[k] else 1 - part[k])
            at = low[0] + step[0] + n * (low[1] + step[1]) + n * n * (low[2] + step[2])
            total = total + weight * F.get(F.get(table, at), F.lit(channel))
        out.append(total)
    return F.array(*out)
