"""The register of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL views that stand for the entities of the engine over the test tables; each may use earlier ones.
VIEWS: dict[str, str] = {
    "poly_points": "SELECT l_orderkey AS gid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq, l_quantity AS p0, l_extendedprice / 1000 AS p1 FROM lineitem",
    "gnode": "SELECT o_orderkey AS gid, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "gedge": "SELECT row_number() OVER (ORDER BY pk, v1) - 1 AS gid, v1, coalesce(v2, -1) AS v2 FROM (SELECT pk, ok AS v1, lead(ok) OVER (PARTITION BY pk ORDER BY ok) AS v2 FROM (SELECT DISTINCT l_partkey AS pk, l_orderkey AS ok FROM lineitem) op) e",
    "adj": "SELECT v1 AS src, v2 AS dst FROM gedge WHERE v1 <> v2 UNION SELECT v2, v1 FROM gedge WHERE v1 <> v2",
    "real_adj": "SELECT v1 AS src, v2 AS dst FROM gedge WHERE v1 <> v2 AND v2 >= 0 UNION SELECT v2, v1 FROM gedge WHERE v1 <> v2 AND v2 >= 0",
    "pixel": "SELECT vec_id AS x, generate_subscripts(embedding, 1) - 1 AS y, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    # boxes that follow the data: the ranges of the vertices of each customer's polylines, and of each nation's
    "area": "SELECT o_custkey AS box_id, CAST(floor(min(p1)) AS BIGINT) AS x0, CAST(ceil(max(p1)) AS BIGINT) AS x1, CAST(floor(min(p0)) AS BIGINT) AS y0, CAST(ceil(max(p0)) AS BIGINT) AS y1 FROM poly_points JOIN orders ON o_orderkey = gid GROUP BY o_custkey",
    "nation_area": "SELECT c_nationkey AS box_id, CAST(floor(avg(x0)) AS BIGINT) AS x0, CAST(ceil(avg(x1)) AS BIGINT) AS x1, CAST(floor(avg(y0)) AS BIGINT) AS y0, CAST(ceil(avg(y1)) AS BIGINT) AS y1 FROM area JOIN customer ON c_custkey = box_id GROUP BY c_nationkey",
    # a table of images, of a hundred vectors each
    "image_pixel": "SELECT vec_id // 100 AS image, vec_id % 100 AS x, generate_subscripts(embedding, 1) - 1 AS y, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "feat": "SELECT vec_id AS gid, embedding AS f, label FROM embeddings",
    "fpos": "SELECT vec_id AS gid, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "pred": "SELECT vec_id AS gid, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS p, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings",
    "run_metric": "SELECT CAST(ts AS DATE) AS run, 'm' AS model, event_type AS metric, 'micro' AS avg_type, value FROM events",
    "part_of": "SELECT gid, y, CASE WHEN gid % 10 = 0 THEN 'val' WHEN gid % 10 <= 2 THEN 'test' ELSE 'train' END AS partition FROM gnode",
    "box": "SELECT 1 AS box_id, 20 AS x0, 40 AS x1, 10 AS y0, 20 AS y1 UNION ALL SELECT 2, 60, 70, 30, 45",
    "line": "SELECT l.*, CASE WHEN n >= 3 THEN p.p0 WHEN n = 2 THEN (f1 + l1) / 2 ELSE f0 END AS m0, CASE WHEN n >= 3 THEN p.p1 WHEN n = 2 THEN (f0 + l0) / 2 ELSE f1 END AS m1 FROM (SELECT gid, count(*) AS n, arg_min(p0, seq) AS f0, arg_min(p1, seq) AS f1, arg_max(p0, seq) AS l0, arg_max(p1, seq) AS l1 FROM poly_points GROUP BY gid) l JOIN poly_points p ON p.gid = l.gid AND p.seq = l.n // 2",
    "mom": "SELECT c0, c1, v00, v01, v11, v11 / (v00 * v11 - v01 * v01) AS i00, -v01 / (v00 * v11 - v01 * v01) AS i01, v00 / (v00 * v11 - v01 * v01) AS i11 FROM (SELECT avg(round_even(p1, 0)) AS c0, avg(round_even(p0, 0)) AS c1, var_samp(round_even(p0, 0)) AS v00, covar_samp(round_even(p0, 0), round_even(p1, 0)) AS v01, var_samp(round_even(p1, 0)) AS v11 FROM poly_points) m",
    # a small ring graph over the vectors, for message passing and sampling
    "ring": "SELECT a.gid AS node, s.slot AS slot, (a.gid + 1 + 7 * s.slot) % n.n AS nbr FROM feat a, (SELECT unnest(range(5)) AS slot) s, (SELECT count(*) AS n FROM feat) n",
}
_NEEDS = {"adj": "gedge", "real_adj": "gedge", "part_of": "gnode", "line": "poly_points", "mom": "poly_points", "ring": "feat", "area": "poly_points", "nation_area": "area"}


def with_views(views: str, sql: str, more: str = "") -> str:
    """SQL over the named views and further common table expressions."""
    names: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in names:
            names.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + ([more] if more else [])
    recursive = "RECURSIVE " if "UNION ALL SELECT /*step*/" in more else ""
    return (f"WITH {recursive}{', '.join(parts)} " if parts else "") + sql


def query(name: str, sql: str | None = None, views: str = "", more: str = ""):
    """Registers a function of a session and a folder as a query, with its SQL."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(views, sql, more)
        return f

    return register
