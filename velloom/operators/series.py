"""Profiles: smoothing, minima, peaks, runs, and the segmentation of page images built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_mean(df: DataFrame, keys: list[str], at: str, value: str, size: int) -> DataFrame:
    """WIN4: the mean over a box of ``size`` in column ``smooth``, as if zeros lay beyond the ends. Nulls count as zeros; ``at`` must tell a
    key's rows apart. One row comes out for each that went in, also where there are fewer than ``size``; ``smooth`` of an array gives
    ``size`` values then."""
    half = size // 2
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half)
    return df.withColumn("smooth", F.sum(value).over(w) / size)


def local_minima(df: DataFrame, keys: list[str], at: str, value: str, share: float = 0.32) -> DataFrame:
    """WIN5: inner rows no higher than their neighbours and at most ``share`` of the peak. Null values are none, and no neighbours."""
    w = Window.partitionBy(*keys).orderBy(at)
    low = (F.col(value) <= F.lag(value).over(w)) & (F.col(value) <= F.lead(value).over(w)) & (F.col(value) <= share * F.max(value).over(Window.partitionBy(*keys)))
    return df.withColumn("_low", low).where("_low").drop("_low")


def sessions(df: DataFrame, keys: list[str], at: str, value: str, gap: int = 12) -> DataFrame:
    """WIN6: minima no further apart than ``gap`` as one, represented by the lowest, the first on a tie."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    grouped = df.withColumn("group", F.sum(new).over(w))
    best = F.min_by(at, F.struct(value, at)).alias(at)
    return grouped.groupBy(*keys, "group").agg(best, F.min(value).alias(value), F.count("*").alias("members"))


def middles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG7, AGG8: (keys, median, upper_median, paper): both kinds of median and the interpolated 90th percentile, nulls aside."""
    upper = F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")
    return df.groupBy(*keys).agg(F.median(value).alias("median"), upper.alias("upper_median"), F.percentile(value, 0.9).alias("paper"))


def smooth(p: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(p, np.ones(size) / size, mode="same")


def total(ink: np.ndarray, axis: int) -> np.ndarray:
    """Sums along an axis; of bytes in the least type that is sure to hold them."""
    n = ink.shape[axis]
    return ink.sum(axis=axis, dtype=None if ink.dtype != np.uint8 or n >= 1 << 24 else np.uint16 if n <= 257 else np.uint32)


def runs(on: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges where ``on`` holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def peaks(p: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """WIN11: strict local maxima (the middle of a plateau), thinned by distance from the highest down, then by prominence."""
    start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))[: len(p)]  # of each plateau
    level, stop = p[start], np.append(start[1:], len(p))
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (start[top] + stop[top] - 1) // 2
    keep = np.ones(len(at), bool)
    for k in np.argsort(p[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep &= ~near
    at = at[keep]

    def height(i: int) -> float:
        higher = np.flatnonzero(p > p[i])
        left, right = higher[higher < i], higher[higher > i]
        a, b = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(p))
        return p[i] - max(p[a : i + 1].min(), p[i:b].min())

    return np.array([i for i in at if height(i) >= prominence], int)


def word_ranges(ink: np.ndarray, min_gap: int | None = None, min_width: int | None = None) -> list[tuple[int, int]]:
    """IMG4, WIN7: ranges of columns with ink (255) in a line, gaps below ``min_gap`` closed, narrow ones dropped."""
    height = ink.shape[0]
    # fixed values: least gap and width, in pixels and in heights of the line; ink that makes a column count
    min_gap = max(12, int(0.3 * height)) if min_gap is None else min_gap
    min_width = max(8, int(0.2 * height)) if min_width is None else min_width
    found = np.array(runs(smooth(total(ink, 0) / 255, 5) > 0.4), int).reshape(-1, 2)
    wide = found[1:, 0] - found[:-1, 1] >= min_gap  # gaps that part words
    start, stop = found[np.append(True, wide)[: len(found)], 0], found[np.append(wide, True)[: len(found)], 1]
    keep = stop - start >= min_width
    return list(zip(start[keep].tolist(), stop[keep].tolist()))


def page_bands(height: int, valleys: list[int], n: int = 3) -> list[tuple[int, int]]:
    """IMG10, JN6: overlapping bands of a tall page, cut at the valley nearest to each even cut."""
    # fixed values: least height, slack and distance of cuts, overlap, least height of a band
    if n == 1 or height < 1400:
        return [(0, height)]
    cuts = [0]
    for k in range(1, n):
        target = height * k // n
        near = [v for v in valleys if abs(v - target) <= max(80, height // 8)]
        cut = min(near, key=lambda v: abs(v - target)) if near else target
        cuts.append(cut if k == 1 or cut > cuts[-1] + 40 else target)
    cuts.append(height)
    pad = max(48, int(height * 0.28 / n))
    bands = [(a if a == 0 else max(0, a - pad), b if b == height else min(height, b + pad)) for a, b in zip(cuts, cuts[1:])]
    return [(a, b) for a, b in bands if b - a >= 80] or [(0, height)]
