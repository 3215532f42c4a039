"""Exact many-to-many vector work in blocks: matrix products per Arrow batch, only results leave a task.

Queries travel as one broadcast matrix while they are within ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES``. Beyond that both sides
meet in a grid: one is cut into fragments of about ``FRAGMENT_BYTES`` that a task holds, the other into strips that stream past every
fragment, so that no task compares more than about ``CELL_PAIRS`` pairs, and neither the driver nor one task ever holds a whole side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import matrix_of, unit_rows

BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
FRAGMENT_BYTES = 64 << 20
#: Pairs that one task of the grid compares; a strip of the streaming side is so long.
CELL_PAIRS = 1 << 31
#: Queries of one request that are read at once; their width tells how many may be broadcast.
FIRST_ROWS = 64
SCORE_DIGITS = 8
SCORE_CELLS = 1 << 20
#: Rows of a score block; its columns are what ``SCORE_CELLS`` leaves.
SCORE_ROWS = 256

BlockKernel = Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.RecordBatch | None]


def rounded(scores: np.ndarray, digits: int = SCORE_DIGITS) -> np.ndarray:
    scale = 10.0**digits
    return np.floor(scores * scale + 0.5) / scale


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def score_blocks(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``left @ right.T`` in blocks within ``SCORE_CELLS``, with their first row and column; all columns of some rows before the next rows."""
    columns = SCORE_CELLS // SCORE_ROWS
    for row in range(0, len(left), SCORE_ROWS):
        for column in range(0, len(right), columns):
            yield row, column, left[row : row + SCORE_ROWS] @ right[column : column + columns].T


def _row_bytes(width: int) -> int:
    return 8 * width + 64


def apply_blocks(
    points: DataFrame,
    queries: DataFrame,
    point_vector: str,
    query_vector: str,
    out: T.StructType,
    make_kernel: Callable[[], BlockKernel],
    broadcast_rows: int = BROADCAST_ROWS,
    fragment_bytes: int = FRAGMENT_BYTES,
    cell_pairs: int = CELL_PAIRS,
    hold_points: bool = True,
) -> DataFrame:
    """Run a kernel on (point block, query block) pairs that together cover every combination.

    ``make_kernel`` builds one kernel per task; it may keep state between calls with the same block on one side. The kernel gets the
    points without their vectors, their unit matrix, the queries and their unit matrix. Beyond the broadcast a task holds a fragment of
    the points, or of the queries, so a kernel sees a batch of the other side against the whole fragment at once.
    """
    spark = points.sparkSession
    points = points.filter(F.col(point_vector).isNotNull())
    queries = queries.filter(F.col(query_vector).isNotNull())
    first = min(FIRST_ROWS, broadcast_rows)
    head = queries.limit(first + 1).toArrow()
    width = max([len(v) for v in head.column(query_vector).to_pylist()], default=0)
    if head.num_rows > first:
        broadcast_rows = min(broadcast_rows, max(first, BROADCAST_BYTES // _row_bytes(width)))
        head = queries.limit(broadcast_rows + 1).toArrow()
    if head.num_rows > broadcast_rows:
        sides = [(points, point_vector), (queries, query_vector)]
        return _grid(*(sides if hold_points else sides[::-1]), out, make_kernel, width, fragment_bytes, cell_pairs, hold_points)
    table = head.drop_columns([query_vector])
    matrix = unit_rows(matrix_of(head.column(query_vector)))
    shared = spark.sparkContext.broadcast((_pack(table), matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, query_matrix = shared.value
        query_table = _unpack(packed)
        kernel = make_kernel()
        if query_table.num_rows == 0:
            return
        for batch in batches:
            result = kernel(*_side(batch, point_vector), query_table, query_matrix)
            if result is not None and result.num_rows:
                yield result

    return points.mapInArrow(scan, out)


def _side(batch: pa.RecordBatch, vector: str) -> tuple[pa.Table, np.ndarray]:
    return pa.Table.from_batches([batch]).drop_columns([vector]), unit_rows(matrix_of(batch.column(vector)))


def _grid(
    held_side: tuple[DataFrame, str],
    passing_side: tuple[DataFrame, str],
    out: T.StructType,
    make_kernel: Callable[[], BlockKernel],
    width: int,
    fragment_bytes: int,
    cell_pairs: int,
    hold_points: bool,
) -> DataFrame:
    """Fragments of one side, each held by a task, against strips of the other in a stream; every cell is one task.

    While one strip is short enough, the held side is shuffled once and the other once for each fragment. Rows stay rows: no block is ever one value.
    """
    (holding, held_vector), (passing, passing_vector) = held_side, passing_side
    n_held, n_passing = holding.count(), passing.count()
    fragments = max(1, -(-n_held * _row_bytes(width) // fragment_bytes))
    strips = max(1, -(-n_passing * -(-n_held // fragments) // cell_pairs))
    kinds = (holding.schema.simpleString(), passing.schema.simpleString())

    def dealt_to(df: DataFrame, parts: int) -> Column:
        plain = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
        return F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)

    def side(df: DataFrame, fragment: Column, strip: Column, number: int) -> DataFrame:
        whole = F.struct(*df.columns)
        placed = df.select(whole.alias("row"), fragment.alias("fragment"), strip.alias("strip"))
        return placed.select(
            (F.col("fragment") * strips + F.col("strip")).alias("cell"), F.lit(number).alias("side"),
            (F.lit(None).cast(kinds[0]) if number else F.col("row")).alias("held"), (F.col("row") if number else F.lit(None).cast(kinds[1])).alias("passing"),
        )

    held_rows = side(holding, dealt_to(holding, fragments), every(strips), 0)
    stream = side(passing, every(fragments), dealt_to(passing, strips), 1)
    dealt = held_rows.unionByName(stream).repartitionById(fragments * strips, "cell").sortWithinPartitions("cell", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, arriving, held, kernel = None, [], None, make_kernel()
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(places) != 0).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for begin, end in zip(bounds, bounds[1:]):
                if places[0, begin] != cell:
                    cell, arriving, held, kernel = places[0, begin], [], None, make_kernel()
                rows = pa.RecordBatch.from_struct_array(batch.column(2 + int(places[1, begin])).slice(begin, end - begin))
                if places[1, begin] == 0:
                    # taken rows are copies: the Arrow batch with its vectors is let go at once
                    plain, vectors = _side(rows, held_vector)
                    arriving.append((plain.take(np.arange(plain.num_rows)), vectors))
                    continue
                if arriving:
                    held = pa.concat_tables([plain for plain, _ in arriving]).combine_chunks(), np.concatenate([vectors for _, vectors in arriving])
                    arriving = []
                if held is None:
                    continue
                asked = _side(rows, passing_vector)
                result = kernel(*held, *asked) if hold_points else kernel(*asked, *held)
                if result is not None and result.num_rows:
                    yield result

    return dealt.mapInArrow(meet, out)


def _first_k(rows: tuple[np.ndarray, np.ndarray, np.ndarray], order: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The first ``k`` (query, row, score) of every query by score descending, then ``order`` of the row; and their places from 0."""
    queries, found, scores = rows
    by = np.lexsort((order[found], -scores, queries))
    queries, found, scores = queries[by], found[by], scores[by]
    place = np.arange(len(queries)) - np.searchsorted(queries, queries)
    kept = place < k
    return (queries[kept], found[kept], scores[kept]), place[kept]


class TopK:
    """Per query (and point group), the points of a block that can still be among the first ``k`` of all blocks seen with these queries."""

    def __init__(self, k: int, id_column: str, point_cols: Sequence[str], query_cols: Sequence[str], schema: pa.Schema, floor: float, group_column: str | None):
        self.k, self.id_column, self.point_cols, self.query_cols = k, id_column, point_cols, query_cols
        self.schema, self.floor, self.group_column = schema, floor, group_column
        self.asked = self.found = None

    def _see(self, found: pa.Table, matrix: np.ndarray, asked: pa.Table) -> None:
        """What belongs to a block is made once for it: the order of its ids and its groups, without rows that have no number for a score."""
        if asked is not self.asked:
            self.asked, self.best = asked, {}
        if found is not self.found:
            self.found, self.order = found, np.empty(found.num_rows, np.int64)
            self.order[pc.sort_indices(found.column(self.id_column)).to_numpy()] = np.arange(found.num_rows)
            sound = np.isfinite(matrix).all(axis=1)
            self.groups = [(None, None if sound.all() else np.flatnonzero(sound))]
            if self.group_column is not None:
                labels = found.column(self.group_column).to_numpy()
                self.groups = [(g, np.flatnonzero((labels == g) & sound)) for g in np.unique(labels)]

    def __call__(self, found: pa.Table, matrix: np.ndarray, asked: pa.Table, asked_matrix: np.ndarray) -> pa.RecordBatch | None:
        self._see(found, matrix, asked)
        hits = []
        for group, members in self.groups:
            part, order = (matrix, self.order) if members is None else (matrix[members], self.order[members])
            best = self.best.setdefault(group, np.full((len(asked_matrix), self.k), -np.inf))
            for begin, (queries, rows, scores), place in self._blocks(part, order, asked_matrix, np.maximum(best[:, -1], self.floor)):
                hits.append((begin + queries, rows if members is None else members[rows], scores))
                block = best[begin : begin + SCORE_ROWS]
                fresh = np.full_like(block, -np.inf)
                fresh[queries, place] = scores
                block[:] = -np.sort(-np.concatenate([block, fresh], axis=1), axis=1)[:, : self.k]
        if not sum(len(h[0]) for h in hits):
            return None
        queries, rows, scores = (np.concatenate(c) for c in zip(*hits))
        arrays = [asked.column(c).take(pa.array(queries)) for c in self.query_cols] + [found.column(c).take(pa.array(rows)) for c in self.point_cols]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in [*arrays, pa.array(scores)]]
        return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, self.schema.types)], self.schema.names)

    def _blocks(self, matrix: np.ndarray, order: np.ndarray, asked: np.ndarray, bars: np.ndarray):
        """Per block of queries, its first ``k`` rows with a score of at least the query's bar."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for row, column, raw in score_blocks(asked, matrix):
            if column == 0:
                kept, floors = none, bars[row : row + SCORE_ROWS].copy()
                if raw.shape[1] >= self.k:
                    # any k columns give a bound; the margin below is for the rounding
                    some = raw[:, : max(self.k, 1024)]
                    floors = np.fmax(floors, np.partition(some, -self.k, axis=1)[:, -self.k])
            hit = np.flatnonzero(raw >= (floors - 10.0**-SCORE_DIGITS)[:, None])
            if len(hit):
                queries, rows = np.divmod(hit, raw.shape[1])
                fresh = (queries, rows + column, rounded(raw.ravel()[hit]))
                kept, place = _first_k(tuple(np.concatenate(c) for c in zip(kept, fresh)), order, self.k)
                last = place == self.k - 1
                floors[kept[0][last]] = np.maximum(floors[kept[0][last]], kept[2][last])
            if column + raw.shape[1] == len(matrix) and len(kept[0]):
                above = kept[2] >= bars[row + kept[0]]
                kept = tuple(c[above] for c in kept)
                yield row, kept, np.arange(len(kept[0])) - np.searchsorted(kept[0], kept[0])


def top_k_kernel(k: int, id_column: str, point_cols: Sequence[str], query_cols: Sequence[str], out: T.StructType,
                 threshold: float | None, group_column: str | None = None) -> Callable[[], BlockKernel]:
    schema = _arrow_schema(out)
    floor = -np.inf if threshold is None else threshold
    return lambda: TopK(k, id_column, point_cols, query_cols, schema, floor, group_column)


#: Fixed directions that vectors are laid along, and how far rounding may move a vector.
_SLAB_AXES, _SLAB_MARGIN = 2, 1e-6


def _slabs(matrix: np.ndarray, reach: float) -> np.ndarray:
    """Slab numbers of unit rows along each axis; rows closer than ``reach`` lie in the same or in neighbouring slabs."""
    axes = np.random.default_rng(0).normal(size=(matrix.shape[1], _SLAB_AXES))
    lengths = np.linalg.norm(axes, axis=0)
    return np.floor(matrix @ (axes / np.where(lengths == 0, 1.0, lengths)) / (reach + _SLAB_MARGIN)).astype(np.int64)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one cell each from batches sorted by ``_cell``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("_cell").to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:]):
            if held and held[-1].column("_cell")[0].as_py() != names[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def better_neighbour_counts(
    df: DataFrame,
    keys: Sequence[str],
    place: str,
    vector: str,
    near: Callable[[np.ndarray, np.ndarray], np.ndarray],
    out: str,
    block_rows: int = 1024,
    reach: float | None = None,
) -> DataFrame:
    """For each row, how many rows of its key with a smaller ``place`` are near it.

    ``place`` is the 0-based position inside the key. ``near(a, b)`` gives a boolean matrix for two unit matrices (or two columns
    of 64-bit words). A key of up to ``block_rows`` rows is one cell. In a larger one, rows meet only along slabs of width ``reach``,
    the largest distance of unit vectors that are near (None: one slab), and a slab that is still full is a grid of
    cells, each a block of rows against a block of possible neighbours. A task returns one count per row, never the pairs.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    words = not isinstance(df.schema[vector].dataType, T.ArrayType)
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows).select(*keys, F.lit(True).alias("_large"))
    rows = df.select(*keys, place, vector).join(large, keys, "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
    small = rows.filter("not _large").select(*keys, place, vector, F.lit("").alias("_slab"), F.lit(2).alias("_role"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.zeros((batch.num_rows, _SLAB_AXES), np.int64)
            steps = [(0,) * _SLAB_AXES]
            if reach is not None and not words:
                own = _slabs(unit_rows(matrix_of(batch.column(vector))), reach)
                steps = list(product((-1, 0, 1), repeat=_SLAB_AXES))
            for role, moves in ((0, [(0,) * _SLAB_AXES]), (1, steps)):
                for move in moves:
                    names = pa.array([f"{a}/{b}" for a, b in (own + np.array(move)).tolist()])
                    yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(np.full(batch.num_rows, role, np.int32))], [*batch.schema.names, "_slab", "_role"])

    crowd = rows.filter("_large").drop("_large")
    laid = crowd.mapInArrow(lay, T.StructType([*crowd.schema.fields, T.StructField("_slab", T.StringType()), T.StructField("_role", T.IntegerType())]))
    blocks = lambda role: F.ceil(F.count_if(F.col("_role") == role) / F.lit(block_rows)).cast("int")
    shape = laid.select(*keys, "_slab", "_role").groupBy(*keys, "_slab").agg(blocks(0).alias("_rows"), blocks(1).alias("_others"))
    placed = laid.join(shape.filter("_rows > 0"), [*keys, "_slab"])
    sent = lambda own, n: F.when(F.col("_role") == own, F.array(F.pmod(F.xxhash64(place), F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    placed = placed.withColumn("_row_block", F.explode(sent(0, "_rows"))).withColumn("_other_block", F.explode(sent(1, "_others"))).drop("_rows", "_others")
    cells = small.withColumns({"_row_block": F.lit(0), "_other_block": F.lit(0)}).unionByName(placed)
    cells = cells.withColumn("_cell", F.to_json(F.struct(*keys, "_slab", "_row_block", "_other_block"))).drop("_slab", "_row_block", "_other_block")
    schema = T.StructType([*key_fields, T.StructField(place, T.LongType()), T.StructField(out, T.LongType())])
    arrow_schema = _arrow_schema(schema)

    def vectors_of(table: pa.Table) -> np.ndarray:
        return table.column(vector).to_numpy() if words else unit_rows(matrix_of(table.column(vector)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            role = table.column("_role").to_numpy()
            targets = table.take(pa.array(np.flatnonzero(role != 1)))
            others = targets if role[0] == 2 else table.take(pa.array(np.flatnonzero(role == 1)))
            if not targets.num_rows or not others.num_rows:
                continue
            places = targets.column(place).to_numpy()
            earlier = others.column(place).to_numpy()[None, :] < places[:, None]
            counts = (near(vectors_of(targets), vectors_of(others)) & earlier).sum(axis=1)
            found = np.flatnonzero(counts)
            if len(found):
                kept = targets.take(pa.array(found))
                arrays = [kept.column(k).combine_chunks().cast(arrow_schema.field(k).type) for k in [*keys, place]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts[found].astype(np.int64))], arrow_schema.names)

    counts = cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(count, schema)
    totals = counts.groupBy(*keys, place).agg(F.sum(out).alias(out))
    return df.join(totals, [*keys, place], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))
