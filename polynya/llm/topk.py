"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are dealt to shards by a hash of their id, and each shard builds a ball tree. A query's
score in a node is at most q . centre + |q| * radius. The search walks the tree with all queries of a
block at once, the child with the higher bounds first, and drops a query from a subtree as soon
as the bound cannot beat its k-th score. The k-th score is shared: each query first searches its
home shard, and takes the score it finds there along to all other shards.

Queries go to shards, and shards to query blocks, by keys; nothing is broadcast and no pair is
formed but inside a visited leaf.

Definitions: a null vector, or one with a null or non-finite component, takes no part, and
neither does a null id. Vectors of different lengths are not compared. Of rows that share an id the
smallest vector counts. Equal scores go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polynya.llm.base import pieces, written

FIELDS = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Settings:
    k: int = 5
    shard_rows: int = 65_536
    least_shards: int = 16
    block_queries: int = 16_384
    leaf: int = 128


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole_numbers(table: DataFrame, factor: int = 256) -> DataFrame:
    """``vec_id, v``: floor(factor * component) of every usable vector."""
    vector = F.col("embedding").cast("array<double>")
    return table.where(F.col("vec_id").isNotNull() & usable(vector)).select(
        F.col("vec_id").cast("long"), F.transform(vector, lambda x: F.floor(x * factor)).alias("v")
    )


class Ball:
    """Node of a ball tree over the rows ``at`` of a matrix."""

    __slots__ = ("at", "centre", "radius", "first_id", "children")

    def __init__(self, points: np.ndarray, ids: np.ndarray, at: np.ndarray):
        own = points[at]
        self.at = at
        self.centre = own.mean(0)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(1).max()))
        self.first_id = int(ids[at].min())
        self.children: list[Ball] = []


def ball_tree(points: np.ndarray, ids: np.ndarray, leaf: int) -> Ball:
    """Split at the median along the line between two far points; ids ascend within a leaf."""
    root = Ball(points, ids, np.arange(len(points)))
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.at) <= leaf:
            node.at = node.at[np.argsort(ids[node.at])]
            continue
        own = points[node.at]
        a = own[((own - node.centre) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        along = np.lexsort((ids[node.at], own @ (b - a)))
        half = len(along) // 2
        node.children = [Ball(points, ids, node.at[along[:half]]), Ball(points, ids, node.at[along[half:]])]
        todo += node.children
    return root


class Search:
    """The best so far of a block of queries against one shard."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, s: Settings):
        self.s, self.ids, self.own = s, ids, own
        most = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0))
        # Doubles hold the scores exactly as long as every partial sum is below 2**53.
        self.exact = float(most) ** 2 * max(vectors.shape[1], 1) < 2**53
        self.vectors = vectors.astype(float) if self.exact else vectors
        self.queries = queries.astype(float) if self.exact else queries
        self.points, self.aims = vectors.astype(float), queries.astype(float)
        self.norm = np.sqrt((self.aims**2).sum(1))
        self.score = np.full((len(queries), s.k), np.iinfo(np.int64).min, np.int64)
        self.found = np.full((len(queries), s.k), np.iinfo(np.int64).max, np.int64)

    def start_from(self, score: np.ndarray, vec_id: np.ndarray) -> None:
        """A k-th score (and its id) found elsewhere; only better candidates are kept."""
        self.score[:], self.found[:] = score[:, None], vec_id[:, None]

    def bound(self, node: Ball, who: np.ndarray) -> np.ndarray:
        reach = self.aims[who] @ node.centre + self.norm[who] * node.radius
        return np.floor(reach + 1e-9 * np.abs(reach) + 1e-3)

    def open_to(self, node: Ball, who: np.ndarray) -> tuple[np.ndarray, float]:
        high, kth = self.bound(node, who), self.score[who, -1]
        may = (high > kth) | ((high == kth) & (node.first_id < self.found[who, -1]))
        return who[may], float(high[may].sum())

    def walk(self, root: Ball) -> None:
        todo = [(root, np.arange(len(self.queries)))]
        while todo:
            node, who = todo.pop()
            who, _ = self.open_to(node, who)
            if not len(who):
                continue
            if not node.children:
                self.visit(node, who)
                continue
            ways = [(child, *self.open_to(child, who)) for child in node.children]
            todo += [(child, active) for child, active, _ in sorted(ways, key=lambda w: w[2])]

    def visit(self, leaf: Ball, who: np.ndarray) -> None:
        score = (self.queries[who] @ self.vectors[leaf.at].T).astype(np.int64)
        ids = self.ids[leaf.at]
        score[ids[None, :] == self.own[who][:, None]] = np.iinfo(np.int64).min
        better = score.max(1) >= self.score[who, -1]
        who, score = who[better], score[better]
        if not len(who):
            return
        all_scores = np.concatenate([self.score[who], score], 1)
        all_ids = np.concatenate([self.found[who], np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((all_ids, -all_scores.astype(np.float64) if self.exact else ~all_scores), axis=1)
        top = order[:, : self.s.k]
        self.score[who] = np.take_along_axis(all_scores, top, 1)
        self.found[who] = np.take_along_axis(all_ids, top, 1)


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def search_shards(vectors: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """Top k of every asked (query, shard) within that shard, as ``query_id, vec_id, score``.

    ``vectors``: shard, dim, vec_id, v; ``asked``: block, shard, dim, query_id, q, kth, kth_id, where
    candidates that do not beat (kth, kth_id) are left out.
    """
    keys = ["block", "shard", "dim"]
    # New names for the same columns, or the two sides of the cogroup could not be told apart.
    blocks = asked.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    dealt = vectors.join(
        blocks, (F.col("shard") == F.col("_shard")) & (F.col("dim") == F.col("_dim"))
    ).select(F.col("_block").alias("block"), "shard", "dim", "vec_id", "v")

    def run(key: tuple, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(shard) or not len(block):
            return empty
        dim = int(key[2])
        if shard["vec_id"].duplicated().any():
            shard = shard.assign(_t=[tuple(v) for v in shard["v"]]).sort_values(["vec_id", "_t"])
            shard = shard.drop_duplicates("vec_id")
        ids = shard["vec_id"].to_numpy(np.int64)
        points = matrix(shard["v"], dim)
        own = block["query_id"].to_numpy(np.int64)
        search = Search(points, ids, matrix(block["q"], dim), own, s)
        kth, kth_id = block["kth"].to_numpy(np.int64), block["kth_id"].to_numpy(np.int64)
        search.start_from(kth, kth_id)
        search.walk(ball_tree(search.points, ids, s.leaf))
        new = (search.score > kth[:, None]) | ((search.score == kth[:, None]) & (search.found < kth_id[:, None]))
        new &= search.score > np.iinfo(np.int64).min
        return pd.DataFrame({
            "query_id": np.repeat(own, s.k).reshape(new.shape)[new], "vec_id": search.found[new], "score": search.score[new],
        })

    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, FIELDS)


def top_k(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's k best others. ``vectors``: vec_id, v."""
    vectors = written(vectors.withColumn("dim", F.size("v")), "vectors")
    shards = pieces(vectors.count(), s.shard_rows, s.least_shards)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    vectors = vectors.withColumn("shard", shard)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("_v")).select(
        F.col("vec_id").alias("query_id"), F.col("_v.v").alias("q"), F.col("_v.dim").alias("dim")
    )
    queries = written(queries, "queries")
    blocks = pieces(queries.count(), s.block_queries)
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.lit(blocks)).cast("int"))
    home = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")
    lowest, last = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    at_home = queries.select(
        "block", home.alias("shard"), "dim", "query_id", "q", lowest.alias("kth"), last.alias("kth_id")
    )
    first = written(search_shards(vectors, at_home, s), "home")
    worst = F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("back"))))
    kth = first.groupBy("query_id").agg(worst.alias("_top")).where(F.size("_top") >= s.k).select(
        "query_id", F.col("_top")[0]["score"].alias("_kth"), (-F.col("_top")[0]["back"]).alias("_kth_id")
    )
    rest = queries.join(kth, "query_id", "left").select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "query_id", "q",
        F.coalesce("_kth", lowest).alias("kth"), F.coalesce("_kth_id", last).alias("kth_id"),
    ).where(F.col("shard") != home)
    found = first.unionByName(search_shards(vectors, rest, s))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )


def op3_exact_top_k(embeddings: DataFrame) -> DataFrame:
    return top_k(whole_numbers(embeddings), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
