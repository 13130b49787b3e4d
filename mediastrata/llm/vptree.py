"""Nearest neighbours by vantage-point trees, one for each shard.

Vectors are scaled to length one, where the largest cosine is the smallest chord. A tree's node has a vantage point and
the median of its points' chords to it; the triangle inequality bounds from below how near a child's points can be. A child is
skipped if that bound, times ``factor``, is beyond the k-th best chord so far: factor 1 is exact, larger ones skip more.

Every vector goes to one shard, whose size in bytes is bounded, and every shard to one task, which builds the shard's tree once.
The queries follow it there, a batch at a time, and stream past the tree: vectors are shuffled once, and queries once for
each shard. A shard's k best for each query meet in a rank over k rows for each shard.

Chords only choose what to look at. The k best are kept by the score itself, in double precision on the original
vectors (scaled by their largest component, so that no square overflows), and of equal scores by the smaller id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null
id; vectors of a length other than the query's aren't its candidates; a repeated id's rows are candidates each, but never of
their own id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.llm.common import materialize, table

NEIGHBOURS = 5
FACTOR = 1.0
#: A shard holds so many bytes of vectors, about; few vectors are dealt out in shards of LEAST_ROWS.
SHARD_BYTES, LEAST_ROWS = 32 << 20, 8192
LEAF = 128
#: Queries that pass a tree at a time, and bytes of vectors whose scores are taken at a time.
BATCH_QUERIES, SCORE_BYTES = 2048, 32 << 20
#: Rounding of scores that were computed in different ways, and of chords: near zero they carry its square root.
_SCORE_SLACK, _CHORD_SLACK = 1e-12, 1e-7


@dataclass
class Node:
    rows: np.ndarray | None = None
    vantage: int = -1
    radius: float = 0.0
    far: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def build(unit: np.ndarray, rows: np.ndarray, leaf: int = LEAF, seed: int = 0) -> Node:
    """The tree over the rows of unit vectors; equal vectors end in one leaf."""
    if len(rows) <= leaf:
        return Node(rows=rows)
    vantage = int(rows[np.random.default_rng(seed + len(rows)).integers(len(rows))])
    chord = chords(unit[vantage : vantage + 1], unit[rows])[0]
    radius = float(np.median(chord))
    near = chord <= radius
    if near.all() or not near.any():
        near = chord < radius
        if not near.any() or near.all():
            return Node(rows=rows)
    inside, outside = build(unit, rows[near], leaf, seed + 1), build(unit, rows[~near], leaf, seed + 2)
    return Node(vantage=vantage, radius=float(chord[near].max()), far=float(chord[~near].min()), inside=inside, outside=outside)


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Vectors:
    """Rows of vectors, scaled by their largest component, with their lengths and directions."""

    def __init__(self, v: np.ndarray):
        self.v = v / np.abs(v).max(axis=1, keepdims=True)
        self.length = np.linalg.norm(self.v, axis=1)
        self.unit = self.v / self.length[:, None]


class Search:
    """The k nearest of batches of queries among a shard's vectors. compared counts the pairs that were looked at."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, k: int = NEIGHBOURS, factor: float = FACTOR, leaf: int = LEAF):
        keep = _first_ids(v, ids, k)
        self.ids, self.k, self.factor, self.compared = ids[keep], k, factor, 0
        self.points = Vectors(v[keep])
        self.tree = build(self.points.unit, np.arange(len(keep)), leaf)

    def __call__(self, queries: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of each query, whose own ids are left out."""
        self.q, self.own = Vectors(queries), own
        self.best = np.full((len(queries), self.k), -np.inf)
        self.row = np.full((len(queries), self.k), -1, dtype=np.int64)
        self.home: dict[int, np.ndarray] = {}
        every = np.arange(len(queries))
        self._seed(self.tree, every)
        self._visit(self.tree, every)
        query, place = np.nonzero(self.row >= 0)
        return query, self.ids[self.row[query, place]], self.best[query, place]

    def _chords(self, node: Node, at: np.ndarray) -> np.ndarray:
        return chords(self.q.unit[at], self.points.unit[node.vantage : node.vantage + 1])[:, 0]

    def _seed(self, node: Node, at: np.ndarray) -> None:
        """Each query looks at the one leaf that it falls in, for a first bound."""
        if node.rows is not None:
            self.home[id(node)] = at
            self._look(node.rows, at)
        elif len(at):
            first = self._chords(node, at) <= (node.radius + node.far) / 2
            self._seed(node.inside, at[first])
            self._seed(node.outside, at[~first])

    def _visit(self, node: Node, at: np.ndarray) -> None:
        """All queries pass the tree together; at each node those go on that the bound doesn't keep back."""
        if node.rows is not None:
            self._look(node.rows, np.setdiff1d(at, self.home.get(id(node), at[:0]), assume_unique=True))
        elif len(at):
            chord = self._chords(node, at)
            # Points inside are within radius of the vantage point, points outside at least far from it.
            self._visit(node.inside, at[self.factor * (chord - node.radius) <= self._worst(at)])
            self._visit(node.outside, at[self.factor * (node.far - chord) <= self._worst(at)])

    def _worst(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.best[at, -1])) + _CHORD_SLACK

    def _look(self, rows: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            step = max(LEAF, SCORE_BYTES // (8 * len(at) * self.q.v.shape[1]))  # a leaf of equal vectors may be large
            for k in range(0, len(rows), step):
                self._leaf(rows[k : k + step], at)

    def _leaf(self, rows: np.ndarray, at: np.ndarray) -> None:
        self.compared += len(rows) * len(at)
        near = self.q.unit[at] @ self.points.unit[rows].T
        near[self.own[at, None] == self.ids[None, rows]] = -np.inf
        hit = near.max(axis=1) >= self.best[at, -1] - _SCORE_SLACK
        near, at = near[hit], at[hit]
        if not len(at):
            return
        kth = np.partition(np.concatenate([self.best[at], near], axis=1), -self.k, axis=1)[:, -self.k]
        query, found = np.nonzero((near >= kth[:, None] - _SCORE_SLACK) & (near > -np.inf))
        row = rows[found]
        score = self._scores(at[query], row)
        old, place = np.nonzero(self.row[at] >= 0)
        query, row, score = np.concatenate([old, query]), np.concatenate([self.row[at][old, place], row]), np.concatenate([self.best[at][old, place], score])
        order = np.lexsort((self.ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.best[at], self.row[at] = -np.inf, -1
        self.best[at[query[top]], rank[top]] = score[top]
        self.row[at[query[top]], rank[top]] = row[top]

    def _scores(self, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(query))
        step = max(1, SCORE_BYTES // (16 * self.q.v.shape[1]))
        for k in range(0, len(query), step):
            a, b = query[k : k + step], row[k : k + step]
            out[k : k + step] = np.einsum("ij,ij->i", self.q.v[a], self.points.v[b]) / (self.q.length[a] * self.points.length[b])
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & some).withColumn("dim", F.size("v"))


def _first_ids(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors the first 2 k by id, of which no id has more than k.

    So k rows of the smallest other ids are left to a query that leaves out its own id; no further row can be among its nearest.
    """
    order = np.lexsort((ids, *v.T[::-1]))

    def place(new: np.ndarray) -> np.ndarray:
        return np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    new = np.ones(len(v), bool)
    new[1:] = (v[order][1:] != v[order][:-1]).any(axis=1)
    other = new.copy()
    other[1:] |= ids[order][1:] != ids[order][:-1]
    few = place(other) < k
    # What begins a group of equal vectors, or an id in it, is kept in either case, so the marks still stand at their first rows.
    order, new = order[few], new[few]
    return np.sort(order[place(new) < 2 * k])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """The parts of a batch with one (shard, kind, dim) each, and no more than BATCH_QUERIES rows."""
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
    starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
    for a, b in zip(starts, starts[1:], strict=False):
        for at in range(a, b, BATCH_QUERIES):
            yield tuple(keys[a].tolist()), batch.slice(at, min(BATCH_QUERIES, b - at))


def _searcher(k: int, factor: float):
    """The map over rows (shard, kind, dim, id, n, v) sorted by the first three: a shard's vectors (kind 0), then the queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, trees = None, {}, {}
        for batch in batches:
            for (its_shard, kind, dim), part in _runs(batch) if batch.num_rows else ():
                if its_shard != shard:
                    shard, points, trees = its_shard, {}, {}
                ids, v = part.column(3).to_numpy(), part.column(5).flatten().to_numpy().reshape(-1, dim)
                if kind == 0:
                    points.setdefault(dim, []).append((ids, v))
                    continue
                if dim in points:
                    own_ids, own_v = zip(*points.pop(dim), strict=True)
                    trees[dim] = Search(np.concatenate(own_v), np.concatenate(own_ids), k, factor)
                if dim in trees:
                    query, found, score = trees[dim](v, ids)
                    arrays = [pa.array(part.column(4).to_numpy()[query]), pa.array(ids[query]), pa.array(found), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["n", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the largest cosine, its own id left out."""
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    asked = materialize(usable(queries, id_col, vector_col).withColumn("n", F.monotonically_increasing_id()), "queries")
    count, numbers = rows.agg(F.count("*"), F.sum("dim")).first()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-8 * (numbers or 0) // SHARD_BYTES), min(tasks, -(-count // LEAST_ROWS)))
    # Rows of one id, and equal rows, are dealt out as well, by where they stood.
    own = F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(shards)).cast("int")
    points = rows.select(own.alias("shard"), F.lit(0).alias("kind"), "dim", "id", F.lit(None).cast("bigint").alias("n"), "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "dim", "id", "n", "v")
    dealt = points.unionAll(every).repartition("shard").sortWithinPartitions("shard", "kind", "dim")
    found = dealt.mapInArrow(_searcher(k, factor), "n bigint, query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
