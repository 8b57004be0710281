"""Filters on tables of images (image, x, y, v), tile by tile.

Every function takes a table of any number of images and gives a row for each pixel. Images are
rectangles without holes. The tile's halo is as wide as the filter reaches, so tiling changes nothing.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles

#: Gaussian kernels end after so many sigmas.
TRUNCATE = 4.0
#: Numbers that one matrix product over windows holds.
WINDOW_VALUES = 1 << 22


def kernel(sigma: float) -> np.ndarray:
    radius = int(TRUNCATE * sigma + 0.5)
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return raw / raw.sum()


def along(v: np.ndarray, weights: np.ndarray, axis: int, **border) -> np.ndarray:
    """Correlation with weights along an axis; border is what np.pad puts around."""
    radius = len(weights) // 2
    wide = np.pad(v, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], **border)
    out = np.zeros_like(v)
    for k, w in enumerate(weights):
        if w:
            out += w * (wide[k : k + v.shape[0]] if axis == 0 else wide[:, k : k + v.shape[1]])
    return out


NEAREST, MIRRORED, ZERO = {"mode": "edge"}, {"mode": "symmetric"}, {"mode": "constant", "constant_values": 0.0}


def blurred(v: np.ndarray, sigma: float, border: dict = NEAREST) -> np.ndarray:
    return along(along(v, kernel(sigma), 0, **border), kernel(sigma), 1, **border)


def difference(v: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the ends; none where there is one place."""
    return np.gradient(v, axis=axis) if v.shape[axis] > 1 else np.zeros_like(v)


def eigenvalues(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of symmetric two by two matrices, the larger and the smaller."""
    mean, half = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    return mean + half, mean - half


# --- many scales --------------------------------------------------------------------------------


def scales(least: float = 0.5, most: float = 16.0, n: int | None = None) -> list[float]:
    """Sigmas from least to most in equal ratios; powers of two times the least if no number is given."""
    n = int(math.log2(most) - math.log2(least) + 1) if n is None else n
    return [float(s) for s in np.logspace(math.log2(least), math.log2(most), num=n, base=2)]


def multiscale(pixels: DataFrame, sigmas: list[float], *, intensity: bool = True, edges: bool = True, texture: bool = True, size: int = 512) -> DataFrame:
    """image, x, y and for the k-th sigma intensity_k, edges_k, large_k and small_k.

    Intensity is the blurred image, its borders repeated; edges the Sobel magnitude of that, its borders
    mirrored; texture the eigenvalues of the second differences of the blurred image. One shuffle and one
    pass over the tiles give all scales.
    """
    if not (intensity or edges or texture):
        raise ValueError("at least one of intensity, edges and texture must be chosen")
    halo = max(len(kernel(s)) // 2 for s in sigmas) + 2
    kinds = [n for n, wanted in (("intensity", intensity), ("edges", edges), ("large", texture), ("small", texture)) if wanted]
    names = [f"{kind}_{k}" for k in range(len(sigmas)) for kind in kinds]

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        out = {}
        for k, sigma in enumerate(sigmas):
            g = blurred(block.values, sigma)
            if intensity:
                out[f"intensity_{k}"] = g
            if edges:
                out[f"edges_{k}"] = sobel(g)
            if texture:
                gx, gy = difference(g, 0), difference(g, 1)
                out[f"large_{k}"], out[f"small_{k}"] = eigenvalues(difference(gx, 0), difference(gx, 1), difference(gy, 1))
        return block.rows(**out)

    return tiles.by_tile(pixels, of, ", ".join(["x long", "y long", *(f"{n} double" for n in names)]), halo=halo, size=size)


def sobel(v: np.ndarray) -> np.ndarray:
    """The magnitude of the smoothed central differences, the mean over both axes."""
    smooth, step = np.array([1.0, 2.0, 1.0]) / 4, np.array([-1.0, 0.0, 1.0]) / 2
    parts = [along(along(v, step, a, **MIRRORED), smooth, 1 - a, **MIRRORED) for a in (0, 1)]
    return np.sqrt((parts[0] ** 2 + parts[1] ** 2) / 2)


# --- bilateral, entropy, structure ----------------------------------------------------------------


def bilateral(pixels: DataFrame, sigma_spatial: float = 1.0, sigma_color: float | None = None, size: int = tiles.SIZE) -> DataFrame:
    """image, x, y, v: the mean of a window, weighed by distance and by difference in value; 0 lies outside an image.

    The window reaches ceil(3 sigma_spatial), at least 2, to each side. Without sigma_color it is the
    standard deviation of the image's values. Where all values of an image are equal, they stay.
    """
    reach = max(2, math.ceil(3 * sigma_spatial))
    if sigma_color is None:
        spread = pixels.groupBy("image").agg(F.stddev_pop("v").alias("_sigma"))  # a row for each image
        scaled = pixels.join(spread, "image").select("image", "x", "y", "v", "_sigma")
    else:
        scaled = pixels.select("image", "x", "y", "v", F.lit(float(sigma_color)).alias("_sigma"))
    # in units of sigma the filter needs no number beside the tile
    units = scaled.select("image", "x", "y", F.when(F.col("_sigma") > 0, F.col("v") / F.col("_sigma")).otherwise(F.lit(0.0)).alias("v"))

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        v = block.values
        wide = np.pad(v, reach, **ZERO)
        total, weights = np.zeros_like(v), np.zeros_like(v)
        for a in range(-reach, reach + 1):
            for b in range(-reach, reach + 1):
                there = wide[reach + a : reach + a + v.shape[0], reach + b : reach + b + v.shape[1]]
                w = np.exp(-0.5 * ((a * a + b * b) / sigma_spatial**2 + (there - v) ** 2))
                total += w * there
                weights += w
        return block.rows(mean=total / weights)

    means = tiles.by_tile(units, of, "x long, y long, mean double", halo=reach, size=size)
    if sigma_color is not None:
        return means.select("image", "x", "y", (F.col("mean") * sigma_color).alias("v"))
    flat = pixels.groupBy("image").agg(F.stddev_pop("v").alias("_sigma"), F.max("v").alias("_level"))
    return means.join(flat, "image").select("image", "x", "y", F.when(F.col("_sigma") > 0, F.col("mean") * F.col("_sigma")).otherwise(F.col("_level")).alias("v"))


def entropy(levels: DataFrame, radius: int = 3, size: int = tiles.SIZE) -> DataFrame:
    """image, x, y, v: the entropy in bits of the levels (whole numbers) in the disk around each pixel, as far as it lies in the image.

    Histograms are integral: sums of a level along a row up to each place, so that the part of a disk
    in a row is one difference, however wide it is.
    """
    half = [int(math.isqrt(radius * radius - a * a)) for a in range(-radius, radius + 1)]

    def count(mask: np.ndarray) -> np.ndarray:
        n, m = mask.shape
        sums = np.pad(np.cumsum(mask, axis=1, dtype=np.int64), [(radius, radius), (radius + 1, radius)], mode="edge")
        sums[:, : radius + 1] = 0
        sums[:radius] = sums[n + radius :] = 0
        out = np.zeros((n, m), dtype=np.int64)
        for a, h in enumerate(half):
            row = sums[a : a + n]
            out += row[:, radius + 1 + h : radius + 1 + h + m] - row[:, radius - h : radius - h + m]
        return out

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        v = block.values
        total, found = count(~np.isnan(v)), np.zeros(v.shape)
        for level in np.unique(v[~np.isnan(v)]):
            share = count(v == level) / np.maximum(total, 1)
            found -= np.where(share > 0, share * np.log2(np.where(share > 0, share, 1.0)), 0.0)
        return block.rows(v=found + 0.0)

    return tiles.by_tile(levels, of, "x long, y long, v double", halo=radius, size=size)


def structure(pixels: DataFrame, sigma: float = 1.0, size: int = tiles.SIZE) -> DataFrame:
    """image, x, y, large, small: eigenvalues of the blurred products of Sobel differences; 0 lies outside an image."""
    smooth, step = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        gx, gy = (along(along(block.values, step, a, **ZERO), smooth, 1 - a, **ZERO) for a in (0, 1))
        large, small = eigenvalues(*(blurred(p, sigma, ZERO) for p in (gx * gx, gx * gy, gy * gy)))
        return block.rows(large=large, small=small)

    return tiles.by_tile(pixels, of, "x long, y long, large double, small double", halo=len(kernel(sigma)) // 2 + 1, size=size)


# --- banks of kernels -----------------------------------------------------------------------------


def responses(v: np.ndarray, kernels: np.ndarray, border: dict):
    """For some rows of v at a time: their places, and the responses of all kernels (rows, columns, kernels) as one matrix product over windows."""
    reach = kernels.shape[1] // 2
    windows = sliding_window_view(np.pad(v, reach, **border), kernels.shape[1:])
    flat = kernels.reshape(len(kernels), -1).T
    step = max(1, WINDOW_VALUES // (v.shape[1] * flat.shape[0]))
    for at in range(0, len(v), step):
        part = windows[at : at + step]
        yield slice(at, at + step), (part.reshape(-1, flat.shape[0]) @ flat).reshape(*part.shape[:2], -1)


def membranes(side: int, rotations: int = 30) -> np.ndarray:
    """Lines through the middle of a square, turned in equal steps over half a circle: 1 where a place lies nearest to the line."""
    reach = side // 2
    a, b = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    turns = np.pi * np.arange(rotations) / rotations
    return np.array([(np.abs(np.cos(t) * b + np.sin(t) * a) <= 0.5 + 1e-9).astype(float) for t in turns])


def membrane(pixels: DataFrame, side: int = 19, rotations: int = 30, size: int = tiles.SIZE) -> DataFrame:
    """image, x, y and the sum, mean, std, median, max and min over all rotations of a line's response; 0 lies outside an image."""
    kernels = membranes(side, rotations)
    names = ("sum", "mean", "std", "median", "max", "min")

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        out = {n: np.empty_like(block.values) for n in names}
        for rows, found in responses(block.values, kernels, ZERO):
            for n in names:
                out[n][rows] = getattr(np, n)(found, axis=2)
        return block.rows(**{f"membrane_{n}": out[n] for n in names})

    return tiles.by_tile(pixels, of, ", ".join(["x long", "y long", *(f"membrane_{n} double" for n in names)]), halo=side // 2, size=size)


def gabor_kernel(frequency: float, theta: float, bandwidth: float = 1.0, n_stds: float = 3.0) -> np.ndarray:
    """The real part of a Gabor kernel: a cosine along theta under a Gaussian of the width that bandwidth gives."""
    sigma = math.sqrt(math.log(2) / 2) / math.pi * (2**bandwidth + 1) / (2**bandwidth - 1) / frequency
    reach = math.ceil(max(abs(n_stds * sigma * math.cos(theta)), abs(n_stds * sigma * math.sin(theta)), 1))
    a, b = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    turned = b * math.cos(theta) + a * math.sin(theta), -b * math.sin(theta) + a * math.cos(theta)
    return np.exp(-0.5 * (turned[0] ** 2 + turned[1] ** 2) / sigma**2) / (2 * math.pi * sigma**2) * np.cos(2 * math.pi * frequency * turned[0])


def gabor(pixels: DataFrame, frequency: float = 3.0, thetas: tuple[float, ...] = (0.0,), size: int = tiles.SIZE) -> DataFrame:
    """image, x, y, gabor_0, ...: the responses of Gabor kernels in several directions, the images mirrored at their borders."""
    found = [gabor_kernel(frequency, t) for t in thetas]
    reach = max(len(k) // 2 for k in found)
    # as a convolution turns kernels around; smaller ones are filled up with zeros
    kernels = np.array([np.pad(k[::-1, ::-1], reach - len(k) // 2) for k in found])

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        out = np.empty((len(kernels), *block.values.shape))
        for rows, part in responses(block.values, kernels, MIRRORED):
            out[:, rows] = np.moveaxis(part, 2, 0)
        return block.rows(**{f"gabor_{k}": v for k, v in enumerate(out)})

    return tiles.by_tile(pixels, of, ", ".join(["x long", "y long", *(f"gabor_{k} double" for k in range(len(kernels)))]), halo=reach, size=size)
