"""Two-hop GraphSAGE, trained by mini-batches over sampled supports.

Spark draws each node's support, joins the features to it and keeps one row a node, written by batch, so
a step reads its own batch alone. Steps follow one another, so small batches go through a task a chain of
them at a time: it reads ``CHAIN_ROWS`` rows at most, takes a step for each batch and hands weights and
moments on to the next chain. The steps are those of one batch after another; only jobs are fewer. A step
of a larger batch is a map over its rows, whose sums of gradients are added up by weight. The driver holds
nothing but the weights and Adam's two moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed
from .keeping import dense_ids, new_folder, store
from .neural import glorot

POOLS = ("mean", "gcn", "maxpool", "meanpool")
Weights = dict[str, np.ndarray]
#: Rows of the batches that one task takes its steps through, about.
CHAIN_ROWS = 8192
#: Rows that a task runs forward at once.
FORWARD_ROWS = 1024


@dataclass(frozen=True)
class Model:
    """pool: how a node's neighbours are combined; width of the features; out of both layers; hidden units of the pooling layer; sampled neighbours of the first and the second hop; classes; loss 'softmax' or 'sigmoid', the latter with a weight of positive labels."""

    width: int
    pool: str = "mean"
    out: tuple[int, int] = (16, 16)
    hidden: int = 32
    samples: tuple[int, int] = (5, 3)
    classes: int = 2
    concat: bool = True
    loss: str = "softmax"
    positive: float = 1.0

    def __post_init__(self) -> None:
        if self.pool not in POOLS or self.loss not in ("softmax", "sigmoid"):
            raise ValueError(f"pool must be one of {POOLS}, loss softmax or sigmoid")

    @property
    def sides(self) -> int:
        return 2 if self.concat and self.pool != "gcn" else 1

    @property
    def embedding(self) -> int:
        return self.sides * self.out[1]

    @property
    def support(self) -> int:
        a, b = self.samples
        return 1 + a + a * b

    def start(self, seed: int = 0) -> Weights:
        """Weights to begin with."""
        w: Weights = {}
        for k, (n, m) in enumerate(((self.width, self.out[0]), (self.sides * self.out[0], self.out[1]))):
            if self.pool in ("maxpool", "meanpool"):
                w[f"m{k}"], w[f"b{k}"] = glorot(n, self.hidden, seed + 10 * k + 1), np.zeros(self.hidden)
            w[f"n{k}"] = glorot(self.hidden if f"m{k}" in w else n, m, seed + 10 * k + 2)
            if self.pool != "gcn":
                w[f"s{k}"] = glorot(n, m, seed + 10 * k + 3)
        w["p"], w["q"] = glorot(self.embedding, self.classes, seed + 30), np.zeros(self.classes)
        return w


# --- forward and back ---------------------------------------------------------------------------


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product, however many axes x has; numpy would take one for each of the first axes' places."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _layer(model: Model, w: Weights, k: int, own: np.ndarray, near: np.ndarray, rectify: bool) -> tuple[np.ndarray, Callable]:
    """The layer's output, and what turns its slope into those of own and near (unless they are the features), adding to the weights' slopes."""
    n = near.shape[-2]
    if model.pool in ("maxpool", "meanpool"):
        h = np.maximum(_times(near, w[f"m{k}"]) + w[f"b{k}"], 0.0)
        at = h.argmax(axis=-2) if model.pool == "maxpool" else None
        around = h.max(axis=-2) if at is not None else h.mean(axis=-2)
    elif model.pool == "gcn":
        around = (near.sum(axis=-2) + own) / (n + 1)
    else:
        around = near.mean(axis=-2)
    parts = [_times(around, w[f"n{k}"])] if model.pool == "gcn" else [_times(own, w[f"s{k}"]), _times(around, w[f"n{k}"])]
    z = np.concatenate(parts, axis=-1) if model.sides == 2 else sum(parts)
    out = np.maximum(z, 0.0) if rectify else z
    flat = lambda x: x.reshape(-1, x.shape[-1])

    def back(slope: np.ndarray, total: Weights) -> tuple[np.ndarray, np.ndarray] | None:
        slope = slope * (z > 0) if rectify else slope
        each = np.split(slope, 2, axis=-1) if model.sides == 2 else [slope, slope]
        total[f"n{k}"] += flat(around).T @ flat(each[-1])
        if model.pool != "gcn":
            total[f"s{k}"] += flat(own).T @ flat(each[0])
        if k == 0 and model.pool in ("mean", "gcn"):
            return None
        d_around = _times(each[-1], w[f"n{k}"].T)
        if model.pool == "gcn":
            share = d_around / (n + 1)
            return share, np.repeat(share[..., None, :], n, axis=-2)
        d_own = _times(each[0], w[f"s{k}"].T) if k else None
        if model.pool == "mean":
            return d_own, np.repeat(d_around[..., None, :] / n, n, axis=-2)
        if at is not None:
            d_h = np.zeros_like(h)
            np.put_along_axis(d_h, at[..., None, :], d_around[..., None, :], axis=-2)  # the largest alone passes it on
        else:
            d_h = np.repeat(d_around[..., None, :] / n, n, axis=-2)
        d_h = d_h * (h > 0)
        total[f"m{k}"] += flat(near).T @ flat(d_h)
        total[f"b{k}"] += flat(d_h).sum(axis=0)
        return (d_own, _times(d_h, w[f"m{k}"].T)) if k else None

    return out, back


def encode(model: Model, w: Weights, x: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Embeddings of length 1 from supports x (rows, places, width), and what adds the weights' slopes from theirs.

    Layers run in the precision of x; embeddings and sums of slopes have 64 bits.
    """
    a, b = model.samples
    w = {k: v.astype(x.dtype, copy=False) for k, v in w.items()}
    x0, x1, x2 = x[:, 0], x[:, 1 : 1 + a], x[:, 1 + a :].reshape(len(x), a, b, -1)
    h0, back0 = _layer(model, w, 0, x0, x1, True)
    h1, back1 = _layer(model, w, 0, x1, x2, True)
    z, back2 = _layer(model, w, 1, h0, h1, False)
    z = z.astype(np.float64)
    size = np.sqrt(np.maximum((z * z).sum(axis=1, keepdims=True), 1e-12))
    e = z / size

    def back(slope: np.ndarray, total: Weights) -> None:
        d0, d1 = back2(((slope - e * (slope * e).sum(axis=1, keepdims=True)) / size).astype(x.dtype), total)
        back0(d0, total)
        back1(d1, total)

    return e, back


def scores(model: Model, w: Weights, x: np.ndarray) -> np.ndarray:
    """The probability of each class."""
    z = encode(model, w, x)[0] @ w["p"] + w["q"]
    if model.loss == "sigmoid":
        return 1 / (1 + np.exp(-z))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def supervised(model: Model, w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """The sum of the losses of some nodes, and its slopes."""
    total = {k: np.zeros_like(v) for k, v in w.items()}
    e, back = encode(model, w, x)
    z, own = e @ w["p"] + w["q"], np.eye(model.classes)[y]
    if model.loss == "softmax":
        top = z.max(axis=1, keepdims=True)
        log = z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True))
        loss, slope = -(own * log).sum(), np.exp(log) - own
    else:
        weight = 1 + (model.positive - 1) * own
        soft = np.maximum(-z, 0) + np.log1p(np.exp(-np.abs(z)))  # log(1 + exp(-z))
        loss = ((1 - own) * z + weight * soft).sum() / model.classes
        slope = ((1 - own) - weight / (1 + np.exp(z))) / model.classes
    total["p"] += e.T @ slope
    total["q"] += slope.sum(axis=0)
    back(slope @ w["p"].T, total)
    return float(loss), total


def skip_gram(model: Model, w: Weights, x: np.ndarray, other: np.ndarray, negatives: np.ndarray) -> tuple[float, Weights, np.ndarray]:
    """The sum of the losses of pairs against negatives, its slopes, and the place of each true affinity among those of the negatives, from 1."""
    total = {k: np.zeros_like(v) for k, v in w.items()}
    (u, back_u), (v, back_v), (n, back_n) = (encode(model, w, s) for s in (x, other, negatives))
    true, false = (u * v).sum(axis=1), u @ n.T
    soft = lambda z: np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
    loss = soft(-true).sum() + soft(false).sum()
    d_true, d_false = -1 / (1 + np.exp(true)), 1 / (1 + np.exp(-false))
    back_u(d_true[:, None] * v + d_false @ n, total)
    back_v(d_true[:, None] * u, total)
    back_n(d_false.T @ u, total)
    return float(loss), total, 1 + (false >= true[:, None]).sum(axis=1)


@dataclass
class Adam:
    """Descent with moments, on slopes that are clipped."""

    weights: Weights
    rate: float = 0.01
    decay: float = 0.0
    clip: float = 5.0
    steps: int = 0
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)

    def step(self, slopes: Weights) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, w in self.weights.items():
            g = np.clip(slopes[k] + self.decay * w, -self.clip, self.clip)
            self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * g * g
            self.weights[k] = w - rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)


# --- supports -----------------------------------------------------------------------------------


def supports(roots: DataFrame, adj: DataFrame, vectors: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """gid, x: for each root (gid) its support, the features of ``model.support`` places as bytes (see ``arrays``).

    adj: node, slot, nbr, the same slots for every node. Each hop takes the slots that a digest puts first,
    the same for all nodes. Neighbours without features (the phantom) and their own neighbours count as
    zeros. Features of 32 bits are kept as such.
    """
    spark, (a, b) = roots.sparkSession, model.samples
    width = adj.agg(F.max("slot")).first()[0] + 1

    def chosen(hop: int, n: int) -> DataFrame:
        order = F.row_number().over(Window.orderBy(keyed.digest(seed, F.lit(hop), F.col("id")), "id"))  # over the slots of one node
        slots = spark.range(n * -(-width // n) if width < n else width).select((F.col("id") % width).alias("slot"), order.alias("j")).where(F.col("j") <= n)
        return adj.join(F.broadcast(slots), "slot").select("node", (F.col("j") - 1).alias("j"), "nbr")  # n rows

    base = roots.select("gid").distinct()
    one = base.join(chosen(1, a).withColumnRenamed("node", "gid"), "gid").select("gid", F.col("j").alias("i"), "nbr")
    two = one.select("gid", "i", F.col("nbr").alias("node")).join(chosen(2, b), "node")
    places = base.select("gid", F.lit(0).alias("place"), F.col("gid").alias("at")).unionByName(one.select("gid", (1 + F.col("i")).alias("place"), F.col("nbr").alias("at"))).unionByName(two.select("gid", (1 + a + F.col("i") * b + F.col("j")).alias("place"), F.col("nbr").alias("at")))
    kind = "float" if vectors.schema["f"].dataType.elementType.simpleString() == "float" else "double"
    known = vectors.where("f IS NOT NULL").select(F.col("gid").alias("at"), F.col("f").cast(f"array<{kind}>").alias("f"))
    listed = places.join(known, "at").groupBy("gid").agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "f")).alias("x"))
    dtype = np.float32 if kind == "float" else np.float64
    rows_at_once = max(1, 2**25 // (model.support * model.width * dtype().itemsize))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, rows_at_once):
                yield pa.RecordBatch.from_arrays([part.column(0), _packed(part.column(1), model, dtype)], ["gid", "x"])

    return listed.mapInArrow(pack, f"gid {listed.schema['gid'].dataType.simpleString()}, x binary")


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def _packed(column: pa.ListArray, model: Model, dtype: type) -> pa.Array:
    """Lists of (place, f) as the bytes of (places, width), zeros where nothing is listed."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten()
    x = np.zeros((len(sizes), model.support, model.width), dtype)
    x[np.repeat(np.arange(len(sizes)), sizes), flat.field("place").to_numpy()] = flat.field("f").flatten().to_numpy().reshape(-1, model.width)
    offsets = np.arange(len(sizes) + 1, dtype=np.int32) * (x[:1].nbytes if len(x) else 0)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def arrays(column: pa.Array, model: Model) -> np.ndarray:
    """A batch's supports as (rows, places, width), in the precision they are kept in."""
    if not len(column):
        return np.zeros((0, model.support, model.width))
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    values, size = len(column) * model.support * model.width, int(offsets[-1] - offsets[0])
    x = np.frombuffer(column.buffers()[2], np.float32 if size == 4 * values else np.float64, values, int(offsets[0]))
    return x.reshape(len(column), model.support, model.width)


def by_batch(rows: DataFrame, size: int, seed: int = 0, *keys: str) -> tuple[DataFrame, int]:
    """rows written by batches of about size rows, dealt by digest of keys; and how many batches there are."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("batch", (keyed.integer(seed, *(F.col(k) for k in keys)) % n).cast("int"))
    return _written(dealt, size, *keys), n


def _written(dealt: DataFrame, size: int, *keys: str) -> DataFrame:
    to = new_folder(dealt.sparkSession, "batches")
    dealt.repartition("batch", F.pmod(F.xxhash64(*keys), F.lit(max(1, size // 10_000)))).write.partitionBy("batch").parquet(to)
    return dealt.sparkSession.read.parquet(to)


# --- steps --------------------------------------------------------------------------------------


Step = Callable[[pa.RecordBatch, Weights], tuple[float, int, float, Weights]]


def summed(rows: DataFrame, weights: Weights, of: Step) -> tuple[float, int, float, Weights]:
    """(loss, rows, sum of reciprocal places, slopes) over all rows: sums of each task, added up weight by weight.

    The task's sums are as many as there are weights; Spark adds them before the driver gets one number
    for each.
    """
    names, sizes = list(weights), [v.size for v in weights.values()]
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(3 + sum(sizes)), 0
        for batch in batches:
            for part in _parts(batch, FORWARD_ROWS):
                loss, found, reciprocal, slopes = of(part, sent.value)
                total += np.concatenate([[loss, found, reciprocal], *(slopes[k].ravel() for k in names)])
                n += found
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    found = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    sent.destroy()
    total = np.zeros(3 + sum(sizes))
    total[found["place"].to_numpy()] = found["value"].to_numpy()
    parts = np.split(total[3:], np.cumsum(sizes)[:-1])
    return float(total[0]), int(total[1]), float(total[2]), {k: p.reshape(weights[k].shape) for k, p in zip(names, parts, strict=True)}


def chained(rows: DataFrame, chain: list[int], descent: Adam, of: Step, moves: bool = True) -> tuple[float, int, float]:
    """(loss, rows, sum of reciprocal places) of some batches, one after another in a task; with moves, descent takes a step for each."""
    names = list(descent.weights)
    shapes = [descent.weights[k].shape for k in names]
    sent = rows.sparkSession.sparkContext.broadcast(descent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [batch for batch in batches if batch.num_rows]
        if not table:
            return
        table = pa.Table.from_batches(table)
        at, told = table["batch"].to_numpy(), np.zeros(3)
        own = replace(sent.value, weights=dict(sent.value.weights), first=dict(sent.value.first), second=dict(sent.value.second))  # a worker's later tasks see the broadcast again
        for b in chain:
            for part in table.filter(pa.array(at == b)).combine_chunks().to_batches():
                loss, found, reciprocal, slopes = of(part, own.weights)
                told += loss, found, reciprocal
                if moves and found:
                    own.step({k: s / found for k, s in slopes.items()})
        state = [np.ravel(part.get(k, np.zeros(n))) for part in (own.weights, own.first, own.second) for k, n in zip(names, shapes, strict=True)] if moves else []
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([told, [own.steps], *state]))], ["value"])

    values = rows.where(F.col("batch").isin(chain)).coalesce(1).mapInArrow(run, "value double").toArrow()["value"].to_numpy()
    sent.destroy()
    if not len(values):
        return 0.0, 0, 0.0
    if moves:
        descent.steps, sizes = int(values[3]), [int(np.prod(n)) for n in shapes]
        parts = [p.reshape(n) for p, n in zip(np.split(values[4:], np.cumsum(sizes * 3)[:-1]), shapes * 3, strict=True)]
        descent.weights, descent.first, descent.second = (dict(zip(names, parts[i * len(names) :], strict=False)) for i in range(3))
    return float(values[0]), int(values[1]), float(values[2])


def _chains(order: list[int], size: int) -> list[list[int]]:
    """The batches of an order, of about size rows, in chains of about ``CHAIN_ROWS``."""
    n = max(1, CHAIN_ROWS // max(1, size))
    return [order[i : i + n] for i in range(0, len(order), n)]


def _order(n: int, epoch: int, seed: int) -> list[int]:
    return np.random.default_rng([seed, epoch]).permutation(n).tolist()


def train(rows: DataFrame, batches: int, model: Model, *, epochs: int = 3, rate: float = 0.01, decay: float = 0.0, seed: int = 0, weights: Weights | None = None, each: Callable[[int, float, Weights], None] | None = None) -> Weights:
    """Weights fitted to rows (batch, x, y), one step a batch; each is told the epoch, its mean loss and the weights.

    The weights to begin with may come from an earlier fit.
    """
    descent = Adam(dict(model.start(seed) if weights is None else weights), rate, decay)
    rows = rows.select("batch", "x", F.col("y").cast("long").alias("y"))
    size = -(-rows.count() // batches)

    def of(batch: pa.RecordBatch, w: Weights) -> tuple[float, int, float, Weights]:
        loss, slopes = supervised(model, w, arrays(batch.column("x"), model), batch.column("y").to_numpy())
        return loss, batch.num_rows, float(batch.num_rows), slopes

    for epoch in range(epochs):
        losses, n = 0.0, 0
        for chain in _chains(_order(batches, epoch, seed), size):
            if size > CHAIN_ROWS:
                loss, found, _, slopes = summed(rows.where(F.col("batch").isin(chain)), descent.weights, of)
                if found:
                    descent.step({k: s / found for k, s in slopes.items()})
            else:
                loss, found, _ = chained(rows, chain, descent, of)
            losses, n = losses + loss, n + found
        if each:
            each(epoch, losses / max(n, 1), dict(descent.weights))
    return descent.weights


def predicted(rows: DataFrame, model: Model, weights: Weights) -> DataFrame:
    """rows without x, with p: the probability of each class."""
    sent, others = rows.sparkSession.sparkContext.broadcast(weights), [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, FORWARD_ROWS):
                p = scores(model, sent.value, arrays(part.column(len(others)), model))
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * model.classes)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], [*others, "p"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "x").mapInArrow(run, f"{kinds}, p array<double>")


def classes(rows: DataFrame, fits: list[tuple[Model, Weights]]) -> DataFrame:
    """rows without x, with said: the likeliest class by each of some fits over the same supports, which are read once for all."""
    sent, others = rows.sparkSession.sparkContext.broadcast(fits), [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, FORWARD_ROWS):
                x = arrays(part.column(len(others)), sent.value[0][0])
                said = np.stack([scores(model, weights, x).argmax(axis=1) for model, weights in sent.value], axis=1).astype(np.int32)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * said.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.ListArray.from_arrays(offsets, pa.array(said.ravel()))], [*others, "said"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "x").mapInArrow(run, f"{kinds}, said array<int>")


def negatives(degrees: DataFrame, known: DataFrame, model: Model, n: int, seed: int, *keys: int) -> np.ndarray:
    """The supports of n nodes drawn by degree to the power 0.75, without repetition: those with the least exponential waiting times by digest. degrees: gid, degree."""
    u = keyed.uniform(seed, *(F.lit(k) for k in keys), F.col("gid"))
    drawn = degrees.where("degree > 0").orderBy(-F.log(u) / F.pow("degree", 0.75), "gid").limit(n).select("gid")
    return arrays(known.join(F.broadcast(drawn), "gid").select("x").toArrow()["x"].combine_chunks(), model)  # n rows


def drawn_nodes(degrees: DataFrame, batches: int, epochs: int, n: int, seed: int) -> DataFrame:
    """batch, epoch, gid: for each batch and epoch n different nodes (all, if there are fewer), drawn one after another by degree to the power 0.75.

    A draw takes a degree by what all its nodes weigh, then one of these; what was drawn before is drawn
    again. So a batch costs its draws, however many nodes there are. Distinct degrees are fewer than the
    root of twice the number of edges; they alone reach the driver.
    """
    numbered = store(dense_ids(degrees.where("degree > 0").select("gid", "degree"), "degree", "gid", name="j"))
    kinds = numbered.groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree").toArrow()
    count = kinds["n"].to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    bound = np.cumsum(count * kinds["degree"].to_numpy().astype(np.float64) ** 0.75)
    n = min(n, int(count.sum()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, found = part.column(0).to_numpy(), []
            for i in at:
                draw, own = np.random.default_rng([seed, int(i) % epochs, int(i) // epochs]), {}
                while len(own) < n:
                    c = np.searchsorted(bound, draw.random(2 * n) * bound[-1], side="right").clip(max=len(bound) - 1)
                    own.update(dict.fromkeys((first[c] + (draw.random(2 * n) * count[c]).astype(np.int64)).tolist()))
                found.append(list(own)[:n])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at // epochs, n).astype(np.int32)), pa.array(np.repeat(at % epochs, n).astype(np.int32)), pa.array(np.array(found, np.int64).ravel())], ["batch", "epoch", "j"])

    return degrees.sparkSession.range(batches * epochs).mapInArrow(run, "batch int, epoch int, j long").join(numbered.select("j", "gid"), "j").select("batch", "epoch", "gid")


@dataclass(frozen=True)
class Pairs:
    """Pairs by batch, each with the supports of both nodes, and beside them the supports of the nodes drawn against a batch in an epoch (other null, epoch from 0; -1: a pair)."""

    rows: DataFrame
    batches: int
    size: int
    epochs: int


def paired(pairs: DataFrame, known: DataFrame, degrees: DataFrame, *, epochs: int = 3, size: int = 512, drawn: int = 20, seed: int = 0) -> Pairs:
    """What ``fit_pairs`` reads, for any model of the same supports. Arguments as for ``train_unsupervised``."""
    pairs = store(pairs.select("node", "ctx"))
    total = pairs.count()
    n = max(1, -(-total // size))
    own = pairs.withColumn("batch", (keyed.integer(seed, F.col("node"), F.col("ctx")) % n).cast("int"))
    both = own.join(known.select(F.col("gid").alias("node"), "x"), "node").join(known.select(F.col("gid").alias("ctx"), F.col("x").alias("other")), "ctx")
    far = drawn_nodes(degrees, n, epochs + 1, drawn, seed).join(known.select("gid", "x"), "gid")
    rows = both.select("batch", F.lit(-1).alias("epoch"), "node", "ctx", "x", "other").unionByName(far.select("batch", "epoch", F.col("gid").alias("node"), F.col("gid").alias("ctx"), "x", F.lit(None).cast("binary").alias("other")))
    return Pairs(_written(rows, size, "node", "ctx"), n, -(-total // n), epochs)


def fit_pairs(pairs: Pairs, model: Model, *, rate: float = 0.01, decay: float = 0.0, seed: int = 0, weights: Weights | None = None, each: Callable[[int, float, float, Weights], None] | None = None) -> Weights:
    """``train_unsupervised`` over pairs that are written."""
    descent = Adam(dict(model.start(seed) if weights is None else weights), rate, decay)
    rows = pairs.rows.select("batch", "epoch", "x", "other")
    for epoch in range(pairs.epochs + 1):
        now = rows.where(F.col("epoch").isin(-1, epoch))

        def of(batch: pa.RecordBatch, w: Weights, epoch=epoch, far=None) -> tuple[float, int, float, Weights]:
            own = batch.column("epoch").to_numpy() == -1
            true = batch.filter(pa.array(own))
            far = arrays(batch.filter(pa.array(~own)).column("x"), model) if far is None else far
            loss, slopes, places = skip_gram(model, w, arrays(true.column("x"), model), arrays(true.column("other"), model), far)
            return loss, true.num_rows, float((1 / places).sum()), slopes

        def run(chain: list[int], now=now, epoch=epoch, of=of) -> tuple[float, int, float]:
            if pairs.size <= CHAIN_ROWS:
                return chained(now, chain, descent, of, epoch > 0)
            here = now.where(F.col("batch").isin(chain))
            far = arrays(here.where(F.col("epoch") == epoch).select("x").toArrow()["x"].combine_chunks(), model)  # the drawn nodes of one batch
            loss, found, reciprocal, slopes = summed(here.where("epoch = -1"), descent.weights, lambda batch, w: of(batch, w, epoch, far))
            if epoch and found:
                descent.step({k: s / found for k, s in slopes.items()})
            return loss, found, reciprocal

        chains = _chains(_order(pairs.batches, epoch, seed), pairs.size)
        if epoch:
            told = [run(chain) for chain in chains]
        else:  # nothing is handed on, so chains need not wait
            with ThreadPoolExecutor(4) as pool:
                told = list(pool.map(run, chains))
        losses, n, ranks = (sum(t[i] for t in told) for i in range(3))
        if each:
            each(epoch, losses / max(n, 1), ranks / max(n, 1), dict(descent.weights))
    return descent.weights


def train_unsupervised(pairs: DataFrame, known: DataFrame, degrees: DataFrame, model: Model, *, epochs: int = 3, size: int = 512, drawn: int = 20, rate: float = 0.01, decay: float = 0.0, seed: int = 0, weights: Weights | None = None, each: Callable[[int, float, float, Weights], None] | None = None) -> Weights:
    """Weights under which nodes lie near those they are paired with and far from drawn ones.

    pairs: node, ctx. known: the supports of all nodes (gid, x). Every batch draws its own negatives. each
    is told the epoch, the mean loss, the mean reciprocal rank of the true pairs among the negatives, and
    the weights; epoch 0 stands for the weights to begin with, measured and not changed.
    """
    return fit_pairs(paired(pairs, known, degrees, epochs=epochs, size=size, drawn=drawn, seed=seed), model, rate=rate, decay=decay, seed=seed, weights=weights, each=each)


def embeddings(known: DataFrame, model: Model, weights: Weights) -> DataFrame:
    """known (gid, x) without x, with vec: the embedding of every node."""
    sent, others = known.sparkSession.sparkContext.broadcast(weights), [c for c in known.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, FORWARD_ROWS):
                e = encode(model, sent.value, arrays(part.column(len(others)), model))[0]
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * model.embedding)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.ListArray.from_arrays(offsets, pa.array(e.ravel()))], [*others, "vec"])

    kinds = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in others)
    return known.select(*others, "x").mapInArrow(run, f"{kinds}, vec array<double>")
