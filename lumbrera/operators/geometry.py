"""Rings and polygons as arrays of points (x, y)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def signed_area(ring: Column) -> Column:
    """Positive for rings against the clock; the ring is closed if it isn't."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in the ring: an odd number of edges to its right."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crossing = F.zip_with(ring, following, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(crossing, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def simplify_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points kept so that none dropped is further than the tolerance from the line between kept ones; the ends stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        along, own = points[b] - points[a], points[a + 1 : b] - points[a]
        length = float(along @ along)
        at = np.clip(own @ along / length, 0, 1)[:, None] if length else np.zeros((len(own), 1))
        far = np.sqrt(((own - at * along) ** 2).sum(1))
        if far.max() > tolerance:
            k = a + 1 + int(far.argmax())
            keep[k] = True
            open_ += [(a, k), (k, b)]
    return points[keep]


def simplify(df: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """df with the ring simplified; rings that would have fewer than four points stay."""

    @F.pandas_udf(POINTS)
    def run(rings: pd.Series) -> pd.Series:
        def one(ring):  # noqa: ANN001, ANN202
            points = np.array([(p["x"], p["y"]) for p in ring])
            kept = simplify_points(points, tolerance) if len(points) > 4 else points
            return [{"x": float(x), "y": float(y)} for x, y in (kept if len(kept) >= 4 else points)]

        return rings.map(lambda r: None if r is None else one(r))

    return df.withColumn(ring, run(F.col(ring)))


def shape_records(content: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number, rings) of the polygons of a shapefile."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">2i", content, at)
        (kind,) = struct.unpack_from("<i", content, at + 8)
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<2i", content, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", content, at + 52), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", content, at + 52 + 4 * n_parts)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            yield number, [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        at += 8 + 2 * words


def table_records(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Rows of a dBASE table as trimmed strings; deleted ones are left out."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(), content[at + 16]))
        at += 32
    for i in range(n):
        row, place = content[head + i * size : head + (i + 1) * size], 1
        if row[:1] == b"*":
            continue
        out = {}
        for name, width in fields:
            out[name] = row[place : place + width].decode(encoding, "replace").strip()
            place += width
        yield out


def read_shapes(spark, shp_path: str, dbf_path: str) -> DataFrame:  # noqa: ANN001
    """number, attributes and rings of a shapefile with its table, each read as one binary file."""
    files = lambda p: spark.read.format("binaryFile").load(p).select("content")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(shape_records(bytes(content)))
                yield pd.DataFrame({"number": [n for n, _ in rows], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for _, rings in rows]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                found = list(table_records(bytes(content)))
                yield pd.DataFrame({"number": range(1, len(found) + 1), "attributes": found})

    polygons = files(shp_path).mapInPandas(shapes, f"number int, rings array<{POINTS}>")
    return polygons.join(files(dbf_path).mapInPandas(rows, "number int, attributes map<string, string>"), "number")
