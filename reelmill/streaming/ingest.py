"""A media folder as a stream that keeps the catalogue in sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import apply_changes, classify, mark_errors, mark_indexed, with_fast_hash, with_mime_type
from ..sources.listing import _listed, _media, read_contents, sniff_type
from ..sources.tables import HashedTable, PointStore

IN_FLIGHT_FRAMES = 512


def media_stream(spark: SparkSession, root: str, max_files: int = IN_FLIGHT_FRAMES) -> DataFrame:
    """Newly found media files below ``root``; ``max_files`` bounds what one batch takes on."""
    read = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return _media(_listed(read))


def ingest_stream(
    spark: SparkSession,
    root: str,
    catalogue: HashedTable,
    checkpoint: str,
    index: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    points: PointStore | None = None,
    max_files: int = IN_FLIGHT_FRAMES,
) -> StreamingQuery:
    """Upsert found files batch by batch; failed files become ERROR and the others go on.

    ``catalogue`` is keyed by ``file_path``. A batch reads each of its files once and rewrites only the buckets that hold them.
    ``index(files to process)`` may return (points, errors) for the batch: the caller's decoding and
    model. A batch that is replayed after a failure writes the same rows again. Deletions are not seen by
    a file stream; run a full scan for them.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        listing = with_mime_type(sniff_type(read_contents(with_fast_hash(batch)))).persist()
        try:
            paths = listing.select("file_path")
            numbers = catalogue.touched(paths)
            files, own = catalogue.read(), catalogue.read_buckets(numbers).join(paths, "file_path", "left_semi")
            classified = classify(files, listing)
            merged = apply_changes(files, classified, F.unix_micros(F.current_timestamp()) / F.lit(1e6), own)
            broken = listing.filter(F.col("read_error").isNotNull()).select("file_path", F.col("read_error").alias("_problem"))
            failed = merged.join(broken, "file_path", "left")
            hit = F.col("_problem").isNotNull()
            catalogue.upsert(failed.withColumns(
                {"status": F.when(hit, "ERROR").otherwise(F.col("status")), "error_message": F.when(hit, F.col("_problem")).otherwise(F.col("error_message"))}
            ))
            if index is not None:
                current = catalogue.read_buckets(numbers).join(paths, "file_path", "left_semi")
                new_points, errors = index(current.filter("status in ('SCANNED', 'PENDING')"))
                if points is not None:
                    points.upsert(new_points)
                catalogue.upsert(mark_errors(mark_indexed(current, new_points, "caller"), errors, check=False))
        finally:
            listing.unpersist()

    return (
        media_stream(spark, root, max_files)
        .writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

