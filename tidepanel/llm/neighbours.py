"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Vectors get one more component so that all have the same length; then the
largest inner product is the least Euclidean distance, and the triangle
inequality prunes.  Pruning is relaxed by a factor: at 1.0 the search is exact,
above it a subtree is skipped as soon as ``factor`` times its least possible
distance passes the k-th best.  Shards are dealt by a hash and searched by
blocks of queries, and each returns its own best.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

SHARD, BLOCK, LEAF = 8192, 2048, 128


@dataclass
class Node:
    """A leaf holds rows ``low``..``high``; an inner node splits these at distance ``radius`` from its vantage point."""

    low: int
    high: int
    vantage: np.ndarray | None = None
    radius: float = 0.0
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # least and most distance inside, outside
    inside: Node | None = None
    outside: Node | None = None


class VpTree:
    """A vantage-point tree over the distinct vectors of a shard.

    ``ids`` has for each of them the ids that share it, ascending, no more than
    ``copies`` (any further copy is behind that many equal ones with less ids).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, copies: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(ids))
        self.ids = [ids[a : min(b, a + copies)] for a, b in zip(starts, ends, strict=True)]
        self.vectors = vectors[starts]
        self.slack = 1e-9 * longest
        lack = np.sqrt(np.maximum(longest * longest - (self.vectors**2).sum(axis=1), 0.0))
        self.points = np.column_stack([self.vectors, lack])
        self.order = np.arange(len(starts))
        self.root = self._build(0, len(starts), np.random.default_rng(3))
        self.points, self.vectors = self.points[self.order], self.vectors[self.order]
        self.ids = [self.ids[i] for i in self.order]

    def _build(self, low: int, high: int, rng: np.random.Generator) -> Node:
        node = Node(low, high)
        if high - low <= LEAF:
            return node
        own = self.order[low:high]
        node.vantage = self.points[own[int(rng.integers(len(own)))]]
        d = np.sqrt(((self.points[own] - node.vantage) ** 2).sum(axis=1))
        half = len(own) // 2
        near = np.argpartition(d, half)
        self.order[low:high], d = own[near], d[near]
        node.radius = float(d[half])
        node.bounds = (float(d[:half].min()), float(d[:half].max()), float(d[half:].min()), float(d[half:].max()))
        node.inside = self._build(low, low + half, rng)
        node.outside = self._build(low + half, high, rng)
        return node

    def search(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query the rows (of distinct vectors) that may be among its best ``k``, ties included."""
        points = np.column_stack([queries, np.zeros(len(queries))])
        norms = (points**2).sum(axis=1)
        best = np.full((len(queries), k), np.inf)
        found: list[list[np.ndarray]] = [[] for _ in queries]

        def visit(node: Node, active: np.ndarray) -> None:
            if node.inside is None:
                block = self.points[node.low : node.high]
                d = norms[active, None] - 2 * (points[active] @ block.T) + (block**2).sum(axis=1)
                both = np.concatenate([best[active], d], axis=1)
                best[active] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
                limit = best[active, k - 1]
                limit = limit + 1e-9 * (1 + np.abs(limit))
                for q, row in zip(*((x.tolist() for x in (active, d <= limit[:, None]))), strict=True):
                    hit = np.flatnonzero(row)
                    if len(hit):
                        found[q].append(hit + node.low)
                return
            d = np.sqrt(np.maximum(((points[active] - node.vantage) ** 2).sum(axis=1), 0.0))
            a, b, c, e = node.bounds
            # least possible distance to what lies inside and outside
            in_gap, out_gap = np.maximum(np.maximum(a - d, d - b), 0.0), np.maximum(np.maximum(c - d, d - e), 0.0)
            first = d <= node.radius
            for own, gap, child, other_gap, other in (
                (first, in_gap, node.inside, out_gap, node.outside),
                (~first, out_gap, node.outside, in_gap, node.inside),
            ):
                for g, part in ((gap, child), (other_gap, other)):
                    reach = np.sqrt(np.maximum(best[active, k - 1], 0.0)) + self.slack
                    keep = own & (g * factor <= reach)
                    if keep.any():
                        visit(part, active[keep])

        if len(self.points):
            visit(self.root, np.arange(len(queries)))
        return [np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for x in found]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): vectors in double precision, without those NULL, empty, zero or holding NULL or non-finite components."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    df = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0.0))


def nearest(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
    factor: float = 1.0, every: int = 20, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query by inner product, ties to the less id.

    Queries are the rows whose id is divisible by ``every``; a query is no
    candidate of its own.  Equal rows count once, as queries and as candidates;
    each further vector of a query's id has a list of its own, ranked from 1,
    and each of a candidate's id is a candidate.  Scores are inner products in double precision.
    Vectors that are NULL, zero or not finite take no part, nor do those of
    another dimension than a query's.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = stored(usable(vectors, vec_id, embedding).distinct(), "nn-vectors")
    facts = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("m"))
    n, largest = facts.collect()[0]
    schema = "query_id bigint, qk bigint, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # very large or small components are scaled by a power of two, which changes no digit, so that squares stay finite
    power = int(np.frexp(largest)[1])
    power = power if abs(power) > 300 else 0
    if power:
        kept = kept.withColumn("v", F.transform("v", lambda x: x * F.lit(2.0 ** -(power // 2)) * F.lit(2.0 ** -(power - power // 2))))
    most = kept.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).collect()[0][0]
    longest = float(np.sqrt(most)) * (1 + 1e-12)
    shards = -(-n // shard)
    blocks = -(-n // (block * every))
    salt = F.xxhash64(F.lit(17), "id")

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        trees = []
        for _, part in own.groupby(own["v"].map(len)):
            trees.append(VpTree(part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.float64), longest, k + 1))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(trees, protocol=5)]})

    trees = (
        kept.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(build, "shard int, tree binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    queries = (
        kept.where(F.pmod("id", F.lit(every)) == 0)
        .withColumn("block", F.pmod(salt, F.lit(blocks)).cast("int"))
        .withColumn("qk", F.xxhash64("id", "v"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def search(tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(tree) and len(asked):
            for vp in pickle.loads(tree["tree"].iloc[0]):
                own = asked[asked["v"].map(len) == vp.vectors.shape[1]]
                if not len(own):
                    continue
                q = np.stack(own["v"].to_numpy()).astype(np.float64)
                for qid, qk, vector, rows in zip(own["id"].tolist(), own["qk"].tolist(), q, vp.search(q, k + 1, factor), strict=True):
                    exact = np.ldexp((vp.vectors[rows] * vector).sum(axis=1), 2 * power)
                    best = np.argsort(-exact, kind="stable")
                    got: list[tuple[float, int]] = []
                    for i in best.tolist():
                        if len(got) >= k and exact[i] < got[k - 1][0]:
                            break
                        got.extend((float(exact[i]), c) for c in vp.ids[rows[i]].tolist() if c != qid)
                        got.sort(key=lambda x: (-x[0], x[1]))
                    out.extend((qid, qk, c, s) for s, c in got[:k])
        return pd.DataFrame(out, columns=["query_id", "qk", "vec_id", "score"])

    found = trees.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


