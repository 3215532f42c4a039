"""What the corpus operators share: row keys, shared tables, Arrow text buffers, hashing, streamed groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step handles; longer documents make a step of their own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """64-bit identity of a row by content: equal rows share it and so share their results."""
    return F.xxhash64(*[F.col(c) for c in columns])


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, whole): each row's key by doc_id and text, and all its columns as one struct, so that their names can't clash with others."""
    return docs.select(row_key("doc_id", "text").alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's result to the shared folder and read it back: no lineage, and no loss with an executor."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- numpy over Arrow text ----------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each row begins (with the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), starts


def row_steps(starts: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one longer row."""
    first, rows = 0, len(starts) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1)
        yield first, min(last, rows)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _place_values(seed: int, places: int = 256) -> np.ndarray:
    """A random value for each byte at each of the first places of a span."""
    return mix(np.arange(1, places * 256 + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


_PLACE_VALUES = [_place_values(seed) for seed in (1 << 20, 1 << 40)]


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of a byte buffer: sums of a random value for each byte at its place in the span.

    Unlike a polynomial no text has a structure that the sum repeats. Two seeds give independent hashes.
    """
    sizes = ends - begins
    if not len(sizes):
        return np.zeros(0, np.uint64)
    after = np.cumsum(sizes)
    within = np.arange(int(after[-1])) - np.repeat(after - sizes, sizes)
    letters = data[np.repeat(begins, sizes) + within].astype(np.int64)
    values = _PLACE_VALUES[seed][((within & 255) << 8) | letters]
    far = np.flatnonzero(within > 255)
    if len(far):
        values[far] = mix(values[far] + (within[far] >> 8).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return mix(sums[after] - sums[after - sizes] + sizes.astype(np.uint64))


class PrefixHash:
    """Hashes of any substring of a byte buffer from one running sum (polynomial, modulo 2^64).

    Texts of some thousand letters can be made on which such sums agree, so it serves only short spans (op1's windows).
    """

    _base = np.uint64(0x5851F42D4C957F2D)
    _inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    _letters = mix(np.arange(1, 257, dtype=np.uint64))
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        cls = PrefixHash
        if len(cls._powers) <= len(data):
            size = max(len(data) + 1, STEP_BYTES + 4096)
            cls._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, cls._base)]), dtype=np.uint64)
            cls._inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, cls._inverse)]), dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls._letters[data] * cls._powers[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * PrefixHash._inverses[begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes at every place."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * PrefixHash._inverses[:n]) if n > 0 else np.zeros(0, np.uint64)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``: small groups together, at least ``rows`` rows if there are."""
    held: list[pa.Table] = []
    count, wanted = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < wanted:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        last = np.ones(whole.num_rows, bool)
        for key in keys:
            column = whole[key].to_numpy(zero_copy_only=False)
            last &= column == column[-1]
        cut = whole.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.slice(0, cut)
        held, count = [whole.slice(cut)], whole.num_rows - cut
        wanted = max(rows, 2 * count)
    if held and count:
        yield pa.concat_tables(held).combine_chunks()


def distinct_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``keys`` with one row of each run of equal keys."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        yield batch.filter(pa.array([a != b for a, b in zip([last, *rows], rows)]))
        last = rows[-1]
