"""Exact top-k inner products by a pivot-distance index (operator 9).

Vectors are lifted by one component that makes all norms equal to M, the largest, so the largest inner product is the least
distance: |q - lift(x)|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot and its distance to it; a pivot's
vectors, sorted by distance, are cut into annuli of at most ``ANNULUS_ROWS`` rows, so a pivot that is near to everything
only has more annuli.

Queries that lie together form chunks. A chunk takes the annuli in the order of their least possible distance and
keeps each query's k best; by the triangle inequality an annulus [low, high] of a pivot at distance d from a query
holds nothing nearer than max(d - high, low - d). Annuli that can't hold an equal or better score for any query of the
chunk are never read: most are left out before they move, by the scores of a bounded sample, the others when they come up.
Bounds only leave out rows that can't be in the result, so results are exact for any pivots. Pivots are chosen
farthest first from the same sample (``SAMPLE_ROWS`` rows in hash order).

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids; vectors of another
length are only compared with their like. Equal scores order by vec_id. A repeated vec_id is a candidate once for each row, except for
queries of that id. Scores are exact below 2^53. No queries or no vectors give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, stored

#: Pivots per vector length, the rows they are chosen from, rows of an annulus, and queries of a chunk.
PIVOTS, SAMPLE_ROWS, ANNULUS_ROWS, CHUNK_ROWS = 16, 4096, 1024, 128

_BLOCK = "dim int, pivot int, block string, low double, high double, ids binary, vectors binary"


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, vector) with components floor(scale * x) as whole doubles."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.size(x).alias("dim"), whole.alias("vector")
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, np.float64).reshape(len(own), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T)


class PivotIndex:
    """Annuli of all vectors (vec_id, dim, vector), written to the shared folder."""

    def __init__(self, vectors: DataFrame) -> None:
        vectors = stored(vectors, "vectors")
        square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
        self.norm = float(vectors.agg(F.max(square)).first()[0] or 0.0)
        rows = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE_ROWS).toArrow()
        dims = rows["dim"].to_numpy()
        self.sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pivots: dict[int, np.ndarray] = {}
        for dim in np.unique(dims).tolist():
            own = rows.filter(pa.array(dims == dim))
            points = _matrix(own["vector"])
            self.sample[dim] = own["vec_id"].to_numpy(), points
            picked, nearest = [points[0]], ((points - points[0]) ** 2).sum(axis=1)
            while len(picked) < min(PIVOTS, len(points)) and nearest.max() > 0:
                picked.append(points[int(nearest.argmax())])
                nearest = np.minimum(nearest, ((points - picked[-1]) ** 2).sum(axis=1))
            self.pivots[dim] = np.array(picked)
        self.annuli = stored(self._blocks(vectors, ANNULUS_ROWS), "annuli")

    def _blocks(self, vectors: DataFrame, most: int) -> DataFrame:
        """Vectors with nearest pivot and near distance in blocks. The sort is by range: one pivot's rows fill as many tasks as they need."""
        norm, pivots = self.norm, self.pivots

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    points = _matrix(part.column(2))
                    flat = _squares(points, pivots.get(dim, np.zeros((1, dim))))
                    nearest = flat.argmin(axis=1)
                    lift = np.maximum(0, norm - (points**2).sum(axis=1))
                    distance = np.sqrt(flat[np.arange(len(flat)), nearest] + lift)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "dim", "vector", "pivot", "distance"]
                    )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in groups_of(batches, ["dim", "pivot"], 4 * most):
                dim, pivot, distance, ids = (rows[c].to_numpy() for c in ("dim", "pivot", "distance", "vec_id"))
                change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(pivot) != 0)) + 1
                found = []
                for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
                    for at in range(a, b, most):
                        end = min(b, at + most)
                        points = _matrix(rows["vector"].slice(at, end - at))
                        name = f"{dim[at]}/{pivot[at]}/{distance[at]!r}/{ids[at]}/{at}"
                        found.append((int(dim[at]), int(pivot[at]), name, distance[at], distance[end - 1], ids[at:end].tobytes(), points.tobytes()))
                types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                names = ["dim", "pivot", "block", "low", "high", "ids", "vectors"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        keyed = vectors.mapInArrow(key, "vec_id long, dim int, vector array<double>, pivot int, distance double")
        parts = keyed.repartitionByRange("dim", "pivot", "distance", "vec_id").sortWithinPartitions("dim", "pivot", "distance", "vec_id")
        return parts.mapInArrow(cut, _BLOCK)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best of all vectors but the query's own id."""
        chunks = stored(self._blocks(queries, CHUNK_ROWS), "chunks")
        norm, pivots_of, sample = self.norm, self.pivots, self.sample

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each chunk and pivot: least and largest distance of a query, and the largest distance that may still count."""
            for batch in batches:
                rows = []
                for dim, block, ids, vectors in zip(*[batch.column(c).to_pylist() for c in ("dim", "block", "ids", "vectors")]):
                    own, points = _unpacked(ids, vectors)
                    limit = np.full(len(own), np.inf)
                    if dim in sample:
                        other, near = sample[dim]
                        scores = np.where(own[:, None] == other[None], -np.inf, points @ near.T)
                        if scores.shape[1] > k:
                            best = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                            limit = (points**2).sum(axis=1) + norm - 2 * best
                    radius = float(np.sqrt(np.maximum(0, limit)).max())
                    apart = np.sqrt(_squares(points, pivots_of.get(dim, np.zeros((1, dim)))))
                    rows += [(dim, p, block, apart[:, p].min(), apart[:, p].max(), radius) for p in range(apart.shape[1])]
                types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["dim", "pivot", "chunk", "least", "most", "radius"])

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of a chunk come by rising bound, its own queries first."""
            state = None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("bound", "dim", "pivot", "low", "high", "ids", "vectors")]
                for bound, dim, pivot, low, high, ids, vectors in zip(*columns):
                    own, points = _unpacked(ids, vectors)
                    if bound < 0:
                        if state:
                            yield _result(state)
                        state = _Chunk(own, points, norm, k, pivots_of.get(dim, np.zeros((1, dim))))
                    else:
                        state.read(pivot, low, high, own, points)
            if state:
                yield _result(state)

        meta = chunks.mapInArrow(reach, "dim int, pivot int, chunk string, least double, most double, radius double")
        bound = F.greatest(F.lit(0.0), F.col("least") - F.col("high"), F.col("low") - F.col("most"))
        rings = self.annuli.select("dim", "pivot", "block", "low", "high")
        wanted = rings.join(meta, ["dim", "pivot"]).select("block", "chunk", bound.alias("bound"), "radius")
        wanted = wanted.where(F.col("bound") <= F.col("radius") * (1 + 1e-9) + 1e-6).drop("radius")
        reads = self.annuli.join(wanted, "block").select("chunk", "bound", "dim", "pivot", "low", "high", "ids", "vectors")
        heads = chunks.select(F.col("block").alias("chunk"), F.lit(-1.0).alias("bound"), "dim", "pivot", "low", "high", "ids", "vectors")
        ordered = heads.unionByName(reads).repartition("chunk").sortWithinPartitions("chunk", "bound")
        return ordered.mapInArrow(expand, "query_id long, rank int, vec_id long, score long")


class _Chunk:
    """The k best so far of some queries."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, norm: float, k: int, pivots: np.ndarray) -> None:
        self.ids, self.points, self.k = ids, points, k
        self.base = (points**2).sum(axis=1) + norm
        self.apart = np.sqrt(_squares(points, pivots))
        self.scores = [np.zeros(0)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf)

    def read(self, pivot: int, low: float, high: float, ids: np.ndarray, points: np.ndarray) -> None:
        apart = self.apart[:, pivot]
        bound = np.maximum(0, np.maximum(apart - high, low - apart))
        limit = self.base - 2 * self.least
        open_ = np.flatnonzero(bound**2 <= limit * (1 + 1e-9) + 1e-3)
        if not len(open_):
            return
        scores = self.points[open_] @ points.T
        for q, row in zip(open_.tolist(), scores):
            keep = np.flatnonzero((row >= self.least[q]) & (ids != self.ids[q]))
            if len(keep):
                best, found = np.append(self.scores[q], row[keep]), np.append(self.found[q], ids[keep])
                order = np.lexsort((found, -best))[: self.k]
                self.scores[q], self.found[q] = best[order], found[order]
                if len(order) == self.k:
                    self.least[q] = best[order[-1]]


def _result(state: _Chunk) -> pa.RecordBatch:
    sizes = [len(s) for s in state.scores]
    rank = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
    columns = [np.repeat(state.ids, sizes), rank, np.concatenate(state.found), np.rint(np.concatenate(state.scores)).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "rank", "vec_id", "score"])


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows."""
    vectors = usable(embeddings, scale)
    return PivotIndex(vectors).search(vectors.where(F.col("vec_id") % every == 0), k)
