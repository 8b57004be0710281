"""Tables of images, cut into tiles with a halo, for filters that need a neighbourhood.

Pixels are rows (image, x, y, v). A pixel goes to its own tile and to those whose halo it lies in: one
shuffle for all filters together, whose rows grow by the halo's share alone. A tile is one small array
in one task, so an image may be as large as it likes and a table may hold any number of images.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pixels along a tile's side.
SIZE = 256


@dataclass
class Block:
    """One tile with its halo, cut to the image: values by place, nan where there is no pixel; the image's coordinates of its first place; and the places of the tile without halo."""

    image: object
    values: np.ndarray
    x0: int
    y0: int
    own: tuple[slice, slice]

    def rows(self, **columns: np.ndarray) -> dict[str, np.ndarray]:
        """image, x, y and columns, given as arrays like values, of the tile's own pixels."""
        present = ~np.isnan(self.values[self.own])
        x, y = np.nonzero(present)
        places = {"x": x + self.x0 + self.own[0].start, "y": y + self.y0 + self.own[1].start}
        return places | {k: c[self.own][present] for k, c in columns.items()}


def _reach(column: str, size: int, halo: int) -> Column:
    """The tiles that a coordinate belongs to, as numbers."""
    return F.expr(f"explode(sequence(CAST(floor(({column} - {halo}) / {size}) AS BIGINT), CAST(floor(({column} + {halo}) / {size}) AS BIGINT)))")


def in_tiles(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """image, tx, ty, x, y, v: each pixel with each tile whose array holds it; rows without a value are left out."""
    slim = pixels.where("v IS NOT NULL").select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    return slim.select("*", _reach("x", size, halo).alias("tx")).select("*", _reach("y", size, halo).alias("ty"))


def block_of(table: pa.Table, size: int, halo: int) -> Block | None:
    """The array of one tile's rows; None if the tile has no pixel of its own, only halo."""
    tx, ty = (table[c][0].as_py() for c in ("tx", "ty"))
    x, y, v = (table[c].to_numpy() for c in ("x", "y", "v"))
    low = np.array([x.min(), y.min()])
    grid = np.full(np.array([x.max(), y.max()]) - low + 1, np.nan)
    grid[x - low[0], y - low[1]] = v
    own = tuple(slice(int(max(t * size - a, 0)), int(min((t + 1) * size - a, n))) for t, a, n in zip((tx, ty), low, grid.shape, strict=True))
    if any(s.stop <= s.start for s in own):
        return None
    return Block(table["image"][0].as_py(), grid, int(low[0]), int(low[1]), own)


def by_tile(pixels: DataFrame, of: Callable[[Block], dict[str, np.ndarray]], columns: str, *, halo: int, size: int = SIZE) -> DataFrame:
    """image and columns: what ``of`` makes of each tile, a dictionary of equally long arrays under the names of columns."""
    kind = pixels.schema["image"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    types = to_arrow_schema(StructType.fromDDL(f"image {kind}, {columns}"))

    def run(table: pa.Table) -> pa.Table:
        block = block_of(table, size, halo)
        out = of(block) if block else {name: pa.nulls(0) for name in names}
        n = len(out[names[0]])
        return pa.table({"image": pa.array([block.image if block else None] * n, table["image"].type), **{name: pa.array(out[name]) for name in names}}).cast(types)

    return in_tiles(pixels, size, halo).groupBy("image", "tx", "ty").applyInArrow(run, f"image {kind}, {columns}")
