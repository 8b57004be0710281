"""Message passing by the names of models: how neighbours are sampled, and how they are pooled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregation, graph, neural
from .neural import patterned

#: Dimensions behind a dense layer, and neighbours that sampling by distance keeps.
HIDDEN, SAMPLED = 8, 2


def _pool(of: str) -> Callable:
    return lambda adj, f, g: neural.layered_pool(adj, f, [patterned(_width(f), HIDDEN, 1)], getattr(F, of)("v"))


def _scaled(of: str) -> Callable:
    return lambda adj, f, g: aggregation.geometric_pool(adj, f, g.select("gid", F.get("g", 0).alias("g")), getattr(F, of)("v"))


def _hidden(of: str) -> Callable:
    return lambda adj, f, g: neural.product_pool(adj, f, g, [patterned(_width(f), HIDDEN, 1)], [patterned(_width(g, "g"), HIDDEN, 2)], getattr(F, of)("v"))


def _edge(adj: DataFrame, f: DataFrame, g: DataFrame) -> DataFrame:
    return aggregation.edge_pool(adj, f, g.select("gid", F.get("g", 0).alias("p0"), F.get("g", 1).alias("p1")))


def _recurrent(adj: DataFrame, f: DataFrame, g: DataFrame) -> DataFrame:
    state = neural.recurrent(adj, f, _width(f), HIDDEN)
    return state.select("node", F.posexplode("h").alias("pos", "v"))


def _width(vectors: DataFrame, column: str = "f") -> int:
    """Dimensions of the vectors; one row is read."""
    row = vectors.select(F.size(column)).first()
    return row[0] if row else 1


#: A pool takes adj (node, slot, nbr), features (gid, f) and geometry (gid, g: array) and gives node, pos, v.
POOLS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "mean": lambda adj, f, g: aggregation.mean(adj, f),
    "gcn": lambda adj, f, g: aggregation.graph_convolution(adj, f),
    "seq": _recurrent,
    "maxpool": _pool("max"),
    "meanpool": _pool("avg"),
    "geto-maxpool": _scaled("max"),
    "geto-meanpool": _scaled("avg"),
    "hidden-maxpool": _hidden("max"),
    "hidden-meanpool": _hidden("avg"),
    "edge": _edge,
}

#: Model name to its pool and whether neighbours are sampled by distance. The names.
SUPERVISED: dict[str, tuple[str, bool]] = {
    "graphsage_mean": ("mean", False),
    "gcn": ("gcn", False),
    "graphsage_seq": ("seq", False),
    "graphsage_maxpool": ("maxpool", False),
    "graphsage_meanpool": ("meanpool", False),
    "geto-meanpool": ("geto-meanpool", False),
    "geto-maxpool": ("geto-maxpool", False),
    "geto-sampling_maxpool": ("maxpool", True),
    "hidden-geto_meanpool": ("hidden-meanpool", False),
    "geto-edge": ("edge", False),
    "hidden-geto-meanpool_geto-sampling": ("hidden-meanpool", True),
    "hidden-geto_maxpool": ("hidden-maxpool", False),
    "geto-sampling_geto-meanpool": ("geto-meanpool", True),
    "geto-sampling_geto-maxpool": ("geto-maxpool", True),
}
#: The names of models without labels; the last is trained on walks (learning.walk_embeddings), not pooled.
UNSUPERVISED: dict[str, tuple[str, bool] | None] = {
    "graphsage_mean": ("mean", False),
    "gcn": ("gcn", False),
    "graphsage_seq": ("seq", False),
    "graphsage_maxpool": ("maxpool", False),
    "getomaxpool": ("geto-maxpool", False),
    "graphsage_meanpool": ("meanpool", False),
    "n2v": None,
}


def aggregated(name: str, adj: DataFrame, features: DataFrame, geometry: DataFrame, seed: int = 0) -> DataFrame:
    """node, pos, v of a model's aggregator, one hop."""
    found = (SUPERVISED | UNSUPERVISED)[name]
    if found is None:
        raise ValueError(f"{name} is trained on walks")
    pool, by_distance = found
    if by_distance:
        adj = graph.sample_by_distance(adj, geometry.select("gid", F.get("g", 0).alias("at")), SAMPLED, seed)
    return POOLS[pool](adj, features, geometry)
