"""Pixel measures over tables of pixels (image_id, x, y, and r, g, b or gray) and small kernels for whole images."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.functions import geometry as g


def with_luma(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("luma", g.luma(F.col("r"), F.col("g"), F.col("b")).cast("int"))


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, luma, n: at most 256 rows for each image leave a task."""
    return pixels.groupBy("image_id", "luma").agg(F.count("*").alias("n"))


def contrast_bounds(hist: DataFrame) -> DataFrame:
    """image_id, low, high: the first values at which the running count passes 2 % and 98 % of the pixels."""
    w = Window.partitionBy("image_id")
    run = hist.withColumns({"acc": F.sum("n").over(w.orderBy("luma")), "total": F.sum("n").over(w)})
    high = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.98))
    return run.groupBy("image_id").agg(F.min(F.when(F.col("acc") > F.floor(F.col("total") * 0.02), F.col("luma"))).alias("low"), F.min(F.when(F.col("acc") > high, F.col("luma"))).alias("high"))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """A value stretched linearly between the bounds; as it is if they are closer than 48."""
    span = high - low
    return F.when(span < 48, value).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value - low) * 255 / F.greatest(span, F.lit(1)) + 0.5))))


def edge_profile(gray: DataFrame) -> DataFrame:
    """image_id, x, v: the mean over a column of how much a pixel differs from its left neighbour; 0 at x = 0."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    return gray.withColumn("d", F.coalesce(F.abs(F.col("gray") - F.lag("gray").over(w)), F.lit(0.0))).groupBy("image_id", "x").agg(F.avg("d").alias("v"))


def image_types(files: DataFrame) -> DataFrame:
    """files (content binary, declared string) with mime: by magic number, else as declared, else JPEG."""
    c = F.col("content")
    head = lambda a, n, magic: F.substring(c, a, n) == F.unhex(F.lit(magic))
    sniffed = F.when(head(1, 3, "FFD8FF"), "image/jpeg").when(head(1, 4, "89504E47"), "image/png").when(head(1, 4, "47494638"), "image/gif").when(head(1, 4, "52494646") & head(9, 4, "57454250"), "image/webp")
    return files.withColumn("mime", F.coalesce(sniffed, F.nullif(F.col("declared"), F.lit("")), F.lit("image/jpeg")))


def first_images(uploads: DataFrame) -> DataFrame:
    """The first file (by ord) of each upload whose declared type is an image: upload_id, ord, declared."""
    images = uploads.filter(F.startswith(F.coalesce("declared", F.lit("")), F.lit("image/")))
    return images.groupBy("upload_id").agg(F.min(F.struct("ord", "declared")).alias("f")).select("upload_id", "f.*")


def sharpen(image: np.ndarray) -> np.ndarray:
    """A 3 by 3 kernel of centre 5 and cross -1; the borders stay."""
    out = image.astype(np.int32)
    x = out.copy()
    out[1:-1, 1:-1] = np.clip(5 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:], 0, 255)
    return out.astype(np.uint8)


def blobs(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of a mask's 4-connected parts, by their first pixel in reading order.

    Parts are unions of runs: stretches of a row. Runs that overlap in neighbouring rows are joined by hooking each to the
    least run it meets and halving the chains, a logarithmic number of steps over arrays of runs."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return []
    # Runs are in order of row and start, so those of the row above that a run overlaps follow one another.
    wide = w + 2
    low = np.searchsorted(row * wide + end, (row - 1) * wide + start, "right")
    high = np.searchsorted(row * wide + start, (row - 1) * wide + end, "left")
    met = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), met)
    b = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    parts, of = np.unique(root, return_inverse=True)
    left, right, top, bottom = (np.full(len(parts), v) for v in (w, 0, h, 0))
    np.minimum.at(left, of, start)
    np.maximum.at(right, of, end)
    np.minimum.at(top, of, row)
    np.maximum.at(bottom, of, row + 1)
    size = np.bincount(of, end - start).astype(int)
    return [tuple(map(int, x)) for x in zip(left, top, right - left, bottom - top, size)]


@dataclass(frozen=True)
class CropLimits:
    """Fixed values of what can be a die: pixels, sides, share and shape of its box."""

    least_pixels: int = 80
    least_side: int = 18
    share: float = 0.22
    narrow: float = 0.55
    wide: float = 1.8
    half: float = 0.5
    margin: int = 8
    crops: int = 3


def die_crops(mask: np.ndarray, how: CropLimits = CropLimits()) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of the largest parts of a mask that can be dice, with a margin, clipped to the mask."""
    h, w = mask.shape
    found = []
    for x, y, bw, bh, n in blobs(mask):
        if n >= how.least_pixels and how.least_side**2 <= bw * bh <= how.share * w * h and how.narrow <= bw / bh <= how.wide and bw <= how.half * w and bh <= how.half * h:
            found.append((x - how.margin, y - how.margin, bw + 2 * how.margin, bh + 2 * how.margin))
    found.sort(key=lambda r: -r[2] * r[3])
    cut = [(max(0, x), max(0, y), min(w, x + a), min(h, y + b)) for x, y, a, b in found[: how.crops]]
    return [(x, y, right - x, bottom - y) for x, y, right, bottom in cut]


def largest_crops(masks: DataFrame, how: CropLimits = CropLimits()) -> DataFrame:
    """image_id, rank, x, y, width, height of each image's die crops. masks: image_id, width, bits (an array of 0 and 1, row by row;
    a last row that is short is filled up with 0)."""
    kind = "array<struct<x:int,y:int,width:int,height:int>>"

    @F.pandas_udf(kind)
    def crops(width: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("x", "y", "width", "height"), c)) for c in die_crops(as_mask(w, b), how)] for w, b in zip(width, bits)])

    found = masks.select("image_id", F.posexplode(crops("width", "bits")).alias("rank", "crop"))
    return found.select("image_id", (F.col("rank") + 1).alias("rank"), "crop.*")


def as_mask(width: int, bits) -> np.ndarray:
    if bits is None or not len(bits):
        return np.zeros((1, max(1, width)), bool)
    return np.pad(np.asarray(bits, bool), (0, -len(bits) % width)).reshape(-1, width)


def count_pips(mask: np.ndarray) -> int:
    """Parts of a mask that look like the pips of a die: 6 pixels or more, compact and not too large."""
    h, w = mask.shape
    found = 0
    for _, _, bw, bh, n in blobs(mask):
        found += n >= 6 and 9 <= bw * bh <= 0.2 * w * h and 0.55 <= bw / bh <= 1.8 and n / (bw * bh) >= 0.28
    return found


@F.pandas_udf(T.IntegerType())
def pips_udf(width: pd.Series, bits: pd.Series) -> pd.Series:
    """Pips of masks in rows (an array of 0 and 1, row by row); a last row that is short is filled up with 0."""
    return pd.Series([count_pips(as_mask(w, b)) for w, b in zip(width, bits)], dtype="int32")
