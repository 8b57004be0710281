"""Ridge complexes of images: critical points, ridge lines from saddles up to maxima, and their cancellation by persistence.

The discrete gradient of the grid of pixels and their edges and squares is local. Pixels have a total
order, by value and then by place. A pixel points to the largest of its four neighbours that are larger;
without one it is a maximum. The larger neighbours around a pixel fall into groups that touch through
squares of larger pixels; each group but that of the pointer gives a saddle, on the edge to the group's
largest. A saddle's two ridge lines follow the pointers from the two ends of its edge.

One pass over tiles with a halo of one pixel finds all of it and follows pointers to the tile's seam by
doubling; the pixels along the seams, and only those, are then followed across tiles by pointer jumping.
Cancellation contracts maxima along their highest saddles, round by round, as rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import tiles
from .graph import followed
from .keeping import store

#: Neighbours in turn around a pixel: steps in x and y.
AROUND = ((1, 0), (0, 1), (-1, 0), (0, -1))
#: Marks of pixels that point nowhere: maxima, and places without a pixel.
MAXIMUM, ABSENT = 4, 5
#: A place as one number: x times this and y.
_WIDTH = 1 << 31
#: Rows of ``passes``.
_IS_MAXIMUM, _IS_SADDLE, _IS_SEAM, _IS_TILE = 0, 1, 2, 3


def _shifted(v: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The value at (x + dx, y + dy), for all places but the outermost."""
    n, m = v.shape
    return v[1 + dx : n - 1 + dx, 1 + dy : m - 1 + dy]


def _above(v: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Whether the pixel a step away is there and larger, by value and then by place."""
    here, there = _shifted(v, 0, 0), _shifted(v, dx, dy)
    return (there > here) | (there == here) & ((dx, dy) > (0, 0))


def gradient(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pointer, saddles) of all places but the outermost: the number of the neighbour that a pixel points to, and for each of four edges whether it is a saddle."""
    up = [_above(v, *d) for d in AROUND]
    corner = [_above(v, a[0] + b[0], a[1] + b[1]) & up[k] & up[(k + 1) % 4] for k, (a, b) in enumerate(zip(AROUND, AROUND[1:] + AROUND[:1], strict=True))]
    value = [np.where(u, _shifted(v, *d), -np.inf) for u, d in zip(up, AROUND, strict=True)]

    def larger(i: int, j: int) -> np.ndarray:
        """Whether neighbour i is larger than neighbour j; both are there."""
        return (value[i] > value[j]) | (value[i] == value[j]) & (AROUND[i] > AROUND[j])

    def touch(i: int, j: int) -> np.ndarray:
        """Whether squares lead from neighbour i to j, one way round or the other."""
        steps = (j - i) % 4
        one = np.logical_and.reduce([corner[(i + s) % 4] for s in range(steps)])
        other = np.logical_and.reduce([corner[(j + s) % 4] for s in range(4 - steps)])
        return one | other

    pointer = np.full(up[0].shape, MAXIMUM, dtype=np.int8)
    for i in range(4):
        pointer[up[i] & np.logical_and.reduce([~up[j] | larger(i, j) for j in range(4) if j != i])] = i
    saddles = np.zeros((4, *pointer.shape), dtype=bool)
    for i in range(4):
        first = np.logical_and.reduce([~(up[j] & touch(i, j)) | larger(i, j) for j in range(4) if j != i])
        own = np.logical_or.reduce([(pointer == j) & ((i == j) | touch(i, j)) for j in range(4)])
        saddles[i] = up[i] & first & ~own
    pointer[np.isnan(_shifted(v, 0, 0))] = ABSENT
    return pointer, saddles


def _roots(pointer: np.ndarray) -> np.ndarray:
    """For each place of a tile with a border around it, where following pointers ends: at a maximum or on the border. Places are numbers in the bordered array."""
    n, m = pointer.shape[0] + 2, pointer.shape[1] + 2
    to = np.arange(n * m).reshape(n, m)
    inner = to[1:-1, 1:-1]
    for i, (dx, dy) in enumerate(AROUND):
        inner[pointer == i] += dx * m + dy
    to = to.ravel()
    while not np.array_equal(further := to[to], to):
        to = further
    return to


def passes(pixels: DataFrame, size: int) -> DataFrame:
    """One pass over the tiles: image, kind, at, edge, v, a, b, pointers.

    Maxima: at, v. Saddles: at, the edge's number, v, and where in this tile the pointers from both ends
    of the edge lead. Seam pixels: at, and where the pointers lead. Tiles: at, the tile's first place, and
    its pointers, with their number of columns as edge.
    """

    def of(block: tiles.Block) -> dict[str, np.ndarray]:
        v = np.pad(block.values, 1, constant_values=np.nan)
        sx, sy = block.own
        around = v[sx.start : sx.stop + 2, sy.start : sy.stop + 2]
        pointer, saddles = gradient(around)
        n, m = pointer.shape
        x0, y0 = block.x0 + sx.start, block.y0 + sy.start
        to = _roots(pointer)
        place = lambda flat: (flat // (m + 2) + x0 - 1) * _WIDTH + flat % (m + 2) + y0 - 1
        number = np.arange((n + 2) * (m + 2)).reshape(n + 2, m + 2)[1:-1, 1:-1]
        maxima = number[pointer == MAXIMUM]
        edge, x, y = np.nonzero(saddles)
        low = number[x, y]
        step = np.array([dx * (m + 2) + dy for dx, dy in AROUND])
        side = np.zeros((n, m), dtype=bool)
        side[[0, -1], :], side[:, [0, -1]] = True, True
        seam = number[side & (pointer != ABSENT)]
        flat = around.ravel()
        one = np.array([x0 * _WIDTH + y0])
        kinds = [len(maxima), len(low), len(seam), 1]
        none = lambda k: np.zeros(kinds[k], dtype=np.int64)
        blank = [None] * (sum(kinds) - 1)
        return {
            "kind": np.repeat(np.arange(4, dtype=np.int32), kinds),
            "at": np.concatenate([place(maxima), place(low), place(seam), one]),
            "edge": np.concatenate([none(0), edge, none(2), [m]]).astype(np.int32),
            "v": np.concatenate([flat[maxima], flat[low], flat[seam], [0.0]]),
            "a": np.concatenate([place(maxima), place(to[low]), place(to[seam]), one]),
            "b": np.concatenate([none(0), place(to[low + step[edge]]), none(2), none(3)]),
            "pointers": pa.array([*blank, pointer.tobytes()], pa.binary()),
        }

    return tiles.by_tile(pixels, of, "kind int, at long, edge int, v double, a long, b long, pointers binary", halo=1, size=size)


def _tile(place: str, size: int) -> Column:
    """The tile of a place, as a number of the same kind."""
    return F.expr(f"CAST(floor(shiftright({place}, 31) / {size}) AS BIGINT) * {_WIDTH} + CAST(floor(({place} & {_WIDTH - 1}) / {size}) AS BIGINT)")


def _xy(place: str, *names: str) -> list:
    return [F.shiftright(place, 31).alias(names[0]), F.col(place).bitwiseAND(F.lit(_WIDTH - 1)).alias(names[1])]


class RidgeComplex:
    """The complex of a table of images (image, x, y, v), x and y from 0 below 2^31; x and y of a row must be unique in its image.

    Pixels without a value, or whose value is nan, are absent, as is what lies outside an image. Ridges
    are the lines along which values are large; for valleys, pass the values negated.
    """

    def __init__(self, pixels: DataFrame, size: int = tiles.SIZE):
        self.size = size
        self._rows = store(passes(pixels.where("NOT isnan(v)"), size))
        self.maxima = self._rows.where(f"kind = {_IS_MAXIMUM}").select("image", "at", "v")
        seam = self._rows.where(f"kind = {_IS_SEAM}").select("image", F.col("at").alias("node"), F.col("a").alias("next"))
        # a seam pixel that leads to another tile goes on there; those that end in their tile are roots
        inner = _tile("node", size) == _tile("next", size)
        ends = seam.where(inner)
        onward = followed(store(seam.where(~inner)), keys=["image"])
        last = ends.select("image", F.col("node").alias("next"), F.col("next").alias("end"))
        crossed = onward.join(last, ["image", "next"], "left").select("image", "node", F.coalesce("end", "next").alias("end"))
        self._seam = store(ends.select("image", "node", F.col("next").alias("end")).unionByName(crossed))
        self.saddles = store(self._ended(self._ended(self._rows.where(f"kind = {_IS_SADDLE}").select("image", "at", "edge", "v", "a", "b"), "a"), "b"))

    def _ended(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the place in column followed across seams to its maximum."""
        known = self._seam.select("image", F.col("node").alias(column), F.col("end").alias("_end"))
        return rows.join(known, ["image", column], "left").withColumn(column, F.coalesce("_end", column)).drop("_end").select("image", "at", "edge", "v", "a", "b")

    def critical_points(self) -> DataFrame:
        """image, x, y, kind ('maximum' or 'saddle'), edge (of a saddle: 0 to 3 for a step along x, y, -x, -y), v."""
        top = self.maxima.select("image", *_xy("at", "x", "y"), F.lit("maximum").alias("kind"), F.lit(None).cast("int").alias("edge"), "v")
        return top.unionByName(self.saddles.select("image", *_xy("at", "x", "y"), F.lit("saddle").alias("kind"), "edge", "v"))

    def lines(self) -> DataFrame:
        """image, x, y, edge, side, seq, px, py: the points of the two ridge lines of each saddle, from an end of its edge (side 0 the lower) up to the maximum.

        Lines are followed tile by tile, all lines of a tile at once; a round goes on with those that
        cross a seam, so there are as many rounds as the longest line crosses tiles.
        """
        size, kind = self.size, self._rows.schema["image"].dataType.simpleString()
        held = self._rows.where(f"kind = {_IS_TILE}").select("image", _tile("at", size).alias("tile"), F.col("at").alias("first"), F.col("edge").alias("columns"), "pointers")
        begin = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(k).alias("n")) for k, s in enumerate((0, 1))))
        step = F.expr("element_at(array({}), edge + 1)".format(", ".join(f"CAST({dx * _WIDTH + dy} AS BIGINT)" for dx, dy in AROUND)))
        start = self.saddles.select("image", "at", "edge", F.inline(begin), step.alias("step")).select("image", "at", "edge", "side", F.lit(0).cast("long").alias("seq"), (F.col("at") + F.col("side") * F.col("step")).alias("place"))

        def follow(key: tuple, lines: pa.Table, tile: pa.Table) -> pa.Table:
            at, edge, side, seq, place = (lines[c].to_numpy().copy() for c in ("at", "edge", "side", "seq", "place"))
            out: list[tuple[np.ndarray, ...]] = []
            if tile.num_rows and len(at):
                m = tile["columns"][0].as_py()
                pointer = np.frombuffer(tile["pointers"][0].as_py(), dtype=np.int8).reshape(-1, m)
                x0, y0 = divmod(tile["first"][0].as_py(), _WIDTH)
                x, y = place // _WIDTH - x0, place % _WIDTH - y0
                dx, dy = np.array(AROUND).T
                live = np.arange(len(at))
                while len(live):
                    here = (x[live] >= 0) & (x[live] < pointer.shape[0]) & (y[live] >= 0) & (y[live] < m)
                    out.append((live, seq[live].copy(), (x[live] + x0) * _WIDTH + y[live] + y0, ~here))
                    live = live[here]
                    way = pointer[x[live], y[live]]
                    live, way = live[way < MAXIMUM], way[way < MAXIMUM]
                    x[live], y[live], seq[live] = x[live] + dx[way], y[live] + dy[way], seq[live] + 1
            who, number, where, leaves = (np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else [()] * 4))
            image = pa.array([key[0].as_py()] * len(who), lines["image"].type)
            return pa.table({"image": image, "at": at[who], "edge": edge[who], "side": side[who], "seq": number, "place": where, "leaves": leaves.astype(bool)})

        schema = f"image {kind}, at long, edge int, side int, seq long, place long, leaves boolean"
        found, ahead = [], start
        while True:
            step_ = store(ahead.withColumn("tile", _tile("place", size)).groupBy("image", "tile").cogroup(held.groupBy("image", "tile")).applyInArrow(follow, schema))
            found.append(step_.where("NOT leaves"))
            ahead = step_.where("leaves").drop("leaves")
            if ahead.isEmpty():
                break
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return every.select("image", *_xy("at", "x", "y"), "edge", "side", "seq", *_xy("place", "px", "py"))

    def cancelled(self, persistence: float) -> tuple[DataFrame, DataFrame]:
        """(maxima, saddles) after cancellation of the pairs whose values differ by less than persistence.

        maxima: image, at, v, survivor (itself if it stays) and persistence (null if it stays). saddles:
        image, at, edge, v, a, b (the surviving maxima of its lines) and cancelled. A maximum falls with the
        highest saddle that leads to a larger one; equal values are ordered by place, saddles then by edge.
        Saddles whose two lines end at one survivor close a loop and stay.

        Maxima whose saddles lead nowhere but to their own tile fall there, saddle by saddle, over two grids of
        tiles of which one has its seams inside the other's tiles. What is left goes round by round over all:
        every survivor looks at its highest saddle to another one and falls if that is larger, and chains of
        falls are followed by pointer jumping. What waits does so for a smaller neighbour, which falls first,
        so the rounds end when nothing falls.
        """
        top = lambda c: self.maxima.select("image", F.col("at").alias(c), F.col("v").alias(f"{c}v"))
        links = store(self.saddles.where("a <> b").select("image", F.struct("v", "at", "edge").alias("s"), "a", "b").join(top("a"), ["image", "a"]).join(top("b"), ["image", "b"]))
        gone = []
        for shift in (0, self.size // 2):
            if links.isEmpty():
                break
            fallen = store(self._fallen_in_tiles(links, persistence, shift))
            gone.append(fallen)
            links = store(_moved(links, fallen))
        while not links.isEmpty():
            sides = [links.select("image", "s", F.struct(F.col(f"{x}v").alias("v"), F.col(x).alias("at")).alias("own"), F.struct(F.col(f"{y}v").alias("v"), F.col(y).alias("at")).alias("other")) for x, y in ("ab", "ba")]
            best = sides[0].unionByName(sides[1]).groupBy("image", "own").agg(F.max(F.struct("s", "other")).alias("best"))
            falls = best.where((F.col("best.other") > F.col("own")) & (F.col("own.v") - F.col("best.s.v") < persistence))
            fallen = store(falls.select("image", F.col("own.at").alias("node"), F.col("best.other.at").alias("next"), F.col("best.other.v").alias("nextv"), "best.s", (F.col("own.v") - F.col("best.s.v")).alias("persistence")))
            if fallen.isEmpty():
                break
            gone.append(fallen)
            ends = followed(fallen.select("image", "node", "next"), keys=["image"])
            links = store(_moved(links, ends.join(self.maxima.select("image", F.col("at").alias("next"), F.col("v").alias("nextv")), ["image", "next"])))
        none = self.maxima.where("false").select("image", F.col("at").alias("node"), F.col("at").alias("next"), F.struct("v", "at", F.lit(0).alias("edge")).alias("s"), F.col("v").alias("persistence"))
        fell = store(reduce(DataFrame.unionByName, [g.drop("nextv") for g in gone], none))
        ends = followed(fell.select("image", "node", "next"), keys=["image"])
        owner = self.maxima.join(ends.withColumnRenamed("node", "at"), ["image", "at"], "left").join(fell.select("image", F.col("node").alias("at"), "persistence"), ["image", "at"], "left")
        owner = store(owner.select("image", "at", "v", F.coalesce("next", "at").alias("survivor"), "persistence"))
        named = lambda c: owner.select("image", F.col("at").alias(c), F.col("survivor").alias(f"_{c}"))
        saddles = self.saddles.join(named("a"), ["image", "a"]).join(named("b"), ["image", "b"]).select("image", "at", "edge", "v", F.col("_a").alias("a"), F.col("_b").alias("b"))
        marks = fell.select("image", F.col("s.at").alias("at"), F.col("s.edge").alias("edge"), F.lit(True).alias("_gone"))
        return owner, saddles.join(marks, ["image", "at", "edge"], "left").withColumn("cancelled", F.coalesce("_gone", F.lit(False))).drop("_gone")

    def _fallen_in_tiles(self, links: DataFrame, persistence: float, shift: int) -> DataFrame:
        """image, node, next, nextv, s, persistence: the maxima that fall inside the tiles of a grid moved by shift, each with the survivor that it falls to there."""
        size, kind = self.size, links.schema["image"].dataType.simpleString()
        moved = shift * (_WIDTH + 1)
        of = lambda c: _tile(f"({c} + {moved})", size)
        each = links.select("image", "s.*", "a", "av", "b", "bv", of("a").alias("ta"), of("b").alias("tb")).select("*", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
        schema = f"image {kind}, node long, next long, nextv double, s struct<v: double, at: long, edge: int>, persistence double"
        types = to_arrow_schema(StructType.fromDDL(schema))

        def run(key: tuple, table: pa.Table) -> pa.Table:
            here = key[1].as_py()
            v, at, edge, a, av, b, bv, ta, tb = (table[c].to_numpy() for c in ("v", "at", "edge", "a", "av", "b", "bv", "ta", "tb"))
            parent: dict[int, int] = {}
            closed: dict[int, bool] = {}  # whether all saddles met so far were inside and led nowhere else
            height: dict[int, tuple[float, int]] = {}
            out = []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for i in np.lexsort((edge, at, v))[::-1].tolist():
                ends = []
                for m, mv, t in ((int(a[i]), av[i], ta[i]), (int(b[i]), bv[i], tb[i])):
                    if t == here:
                        if m not in parent:
                            parent[m], closed[m], height[m] = m, True, (float(mv), m)
                        ends.append(root(m))
                if len(ends) == 1:
                    closed[ends[0]] = False
                elif ends[0] != ends[1]:
                    low, high = sorted(ends, key=height.__getitem__)
                    if closed[low] and height[low][0] - v[i] < persistence:
                        parent[low] = high
                        out.append((low, {"v": float(v[i]), "at": int(at[i]), "edge": int(edge[i])}, height[low][0] - float(v[i])))
                    else:
                        closed[low] = closed[high] = False
            ends = [root(low) for low, _, _ in out]
            rows = {"image": [key[0].as_py()] * len(out), "node": [x[0] for x in out], "next": ends, "nextv": [height[e][0] for e in ends], "s": [x[1] for x in out], "persistence": [x[2] for x in out]}
            return pa.table({f.name: pa.array(rows[f.name], f.type) for f in types})

        return each.groupBy("image", "tile").applyInArrow(run, schema)


def _moved(links: DataFrame, fallen: DataFrame) -> DataFrame:
    """links between survivors: ends that fell are moved on, and links whose ends have met are dropped."""
    for c in "ab":
        to = fallen.select("image", F.col("node").alias(c), F.col("next").alias("_to"), F.col("nextv").alias("_tov"))
        links = links.join(to, ["image", c], "left").withColumns({c: F.coalesce("_to", c), f"{c}v": F.coalesce("_tov", f"{c}v")}).drop("_to", "_tov")
    return links.where("a <> b").select("image", "s", "a", "av", "b", "bv")
