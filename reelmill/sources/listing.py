"""Media folders as tables: listing, type sniffing, content digests, live-photo pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import folder_of, name_of, stem_of, suffix_of
from ..operators.catalog import with_fast_hash, with_mime_type
from ..operators.ordering import first_row
from ..schemas import COMPANION_SUFFIXES, IMAGE_BRANDS, IMAGE_SUFFIXES, STILL_SUFFIXES, VIDEO_BRANDS, VIDEO_SUFFIXES

CHUNK = 1 << 20


def _media(listing: DataFrame) -> DataFrame:
    shown = ~name_of(F.col("file_path")).startswith(".")
    return listing.filter(shown & suffix_of(F.col("file_path")).isin(*IMAGE_SUFFIXES, *VIDEO_SUFFIXES))


def _listed(read: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", "^file:(//)?/", "/")
    return read.select(
        path.alias("file_path"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime")
    )


class FolderPartition(InputPartition):
    """One folder; ``deep`` means with everything below it."""

    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class FolderReader(DataSourceReader):
    """Lists folders inside tasks. The driver only walks folder names, level by level, until there are ``folders`` of them."""

    def __init__(self, root: str, folders: int) -> None:
        self.root, self.folders = root, folders

    def partitions(self) -> Sequence[InputPartition]:
        system, root = file_system(self.root)
        passed, level = [], [root]
        while level and len(level) < self.folders:
            below = [i.path for folder in level for i in system.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.Directory]
            passed, level = [*passed, *level], below
        return [FolderPartition(f, False) for f in passed] + [FolderPartition(f, True) for f in level]

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.root)
        prefix = self.root[: self.root.index("://") + 3] if "://" in self.root and not self.root.startswith("file:") else ""
        waiting = [partition.folder]
        while waiting:
            entries = system.get_file_info(pafs.FileSelector(waiting.pop()))
            if partition.deep:
                waiting += [i.path for i in entries if i.type == pafs.FileType.Directory]
            files = [i for i in entries if i.type == pafs.FileType.File]
            if files:
                # whole milliseconds, as Spark's own file listings give them
                times = [i.mtime_ns // 1_000_000 / 1000.0 if i.mtime_ns is not None else None for i in files]
                columns = [pa.array([prefix + i.path for i in files]), pa.array([i.size for i in files], pa.int64()), pa.array(times, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["file_path", "file_size", "mtime"])


class MediaFolders(DataSource):
    """``spark.read.format("media_folders").load(root)``: every file below a folder, one partition per folder."""

    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return "file_path string, file_size long, mtime double"

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("folders", "64")))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def scan_corpus(spark: SparkSession, root: str, folders: int = 64) -> DataFrame:
    """All media files below ``root``: file_path, file_size, mtime. No file is opened, and tasks list the folders.

    Hidden files are skipped. ``folders`` is how many folders the driver looks for to deal out the work.
    """
    spark.dataSource.register(MediaFolders)
    return _media(spark.read.format("media_folders").option("folders", folders).load(root))


def open_file(path: str) -> pa.NativeFile:
    system, inner = file_system(path)
    return system.open_input_stream(inner)


def _per_file(listing: DataFrame, added: list[T.StructField], read, skip: str | None = None, opener: Callable[[str], Any] = open_file) -> DataFrame:
    """Run ``read(input_stream) -> tuple`` on each file from within tasks; a failure only marks its row.

    Files whose column ``skip`` is true are not opened.
    """
    out = T.StructType([*listing.schema.fields, *added, T.StructField("read_error", T.StringType())])
    types = {"binary": pa.binary(), "string": pa.string()}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            left = batch.column(skip).to_pylist() if skip else [False] * batch.num_rows
            for path, known in zip(batch.column("file_path").to_pylist(), left):
                if known:
                    rows.append((None,) * len(added))
                    errors.append(None)
                    continue
                try:
                    with opener(path) as stream:
                        rows.append(read(stream))
                    errors.append(None)
                except Exception as problem:
                    rows.append((None,) * len(added))
                    errors.append(str(problem) or type(problem).__name__)
            columns = [pa.array([r[i] for r in rows], types[f.dataType.simpleString()]) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(errors, pa.string())], out.fieldNames())

    return listing.mapInArrow(visit, out)


def read_headers(listing: DataFrame) -> DataFrame:
    """First 12 bytes of each file as ``header``; the rest is not read."""
    return _per_file(listing, [T.StructField("header", T.BinaryType())], lambda stream: (stream.read(12),)).drop("read_error")


def _digest(stream, start: bytes = b"") -> str:
    total = hashlib.md5(start, usedforsecurity=False)
    while block := stream.read(CHUNK):
        total.update(block)
    return total.hexdigest()


def hash_contents(listing: DataFrame) -> DataFrame:
    """Digest of each file's bytes as ``content_hash``, streamed in chunks, so size does not matter."""
    return _per_file(listing, [T.StructField("content_hash", T.StringType())], lambda stream: (_digest(stream),))


def read_contents(listing: DataFrame, skip: str | None = None, opener: Callable[[str], Any] = open_file) -> DataFrame:
    """``header`` (first 12 bytes) and ``content_hash`` from one open of each file; see :func:`_per_file` for ``skip``."""

    def both(stream) -> tuple[bytes, str]:
        header = stream.read(12)
        return header, _digest(stream, header)

    return _per_file(listing, [T.StructField("header", T.BinaryType()), T.StructField("content_hash", T.StringType())], both, skip, opener)


def sniffed_type(header: Column, path: Column) -> Column:
    """image or video from the leading bytes, else from the suffix, else null."""
    code = F.hex(F.substring(header, 1, 12))
    brand = F.when(F.length(code) == 24, F.when(F.substring(code, 9, 8) == "66747970", F.substring(code, 17, 8)))

    def codes(brands: tuple[str, ...]) -> list[str]:
        return [b.encode("ascii").hex().upper() for b in brands]

    suffix = suffix_of(path)
    return (
        F.when(code.startswith("FFD8FF") | code.startswith("89504E470D0A1A0A"), "image")
        .when(brand.isin(codes(IMAGE_BRANDS)), "image")
        .when(brand.isin(codes(VIDEO_BRANDS)), "video")
        .when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .when(suffix.isin(*VIDEO_SUFFIXES), "video")
    )


def sniff_type(listing: DataFrame) -> DataFrame:
    """Adds ``file_type``; the header wins over the suffix and rows of unknown type are dropped."""
    typed = listing.withColumn("file_type", sniffed_type(F.col("header"), F.col("file_path")))
    return typed.filter(F.col("file_type").isNotNull()).drop("header")


def live_photo_pairs(listing: DataFrame) -> DataFrame:
    """Stills with the video of the same folder and stem; ``.MOV`` before ``.mov`` before mp4."""
    name, stem, folder = name_of(F.col("file_path")), stem_of(F.col("file_path")), folder_of(F.col("file_path"))
    parts = listing.select("file_path", folder.alias("folder"), stem.alias("stem"), name.alias("_name"))
    exact = F.regexp_extract("_name", r"(\.[^.]+)$", 1)
    stills = parts.filter(F.lower(exact).isin(*STILL_SUFFIXES)).select("folder", "stem", F.col("file_path").alias("still_path"))
    order = F.array_position(F.array(*[F.lit(s) for s in COMPANION_SUFFIXES]), exact)
    videos = parts.filter(exact.isin(*COMPANION_SUFFIXES)).select(
        "folder", "stem", F.col("file_path").alias("companion_path"), order.alias("_order")
    )
    best = first_row(videos, ["folder", "stem"], [F.asc("_order")]).drop("_order")
    return stills.join(best, ["folder", "stem"]).select("still_path", "companion_path")


def read_listing(spark: SparkSession, root: str, files: DataFrame, force: bool = False, opener: Callable[[str], Any] = open_file) -> DataFrame:
    """A listing ready to classify: typed, with fast hashes, and content hashes where they are needed.

    One pass: the folders are listed once, and a file is opened once, and only if its fast hash is not the catalogue's. Files
    are dealt out anew before they are opened, so a folder that holds most of them does not keep one task busy.
    """
    known = files.select("file_path", F.col("file_hash").alias("_hash"), F.col("file_type").alias("_type"))
    listing = with_fast_hash(scan_corpus(spark, root)).join(known, "file_path", "left")
    same = F.coalesce((F.col("_hash") == F.col("file_hash")) & F.col("_type").isNotNull(), F.lit(False)) & F.lit(not force)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listing.withColumn("_same", same).repartition(tasks, "file_path")
    read = read_contents(dealt, "_same", opener)
    kind = F.when(F.col("_same"), F.col("_type")).otherwise(sniffed_type(F.col("header"), F.col("file_path")))
    typed = read.withColumn("file_type", kind).filter(F.col("file_type").isNotNull())
    return with_mime_type(typed).drop("header", "_hash", "_type", "_same")
