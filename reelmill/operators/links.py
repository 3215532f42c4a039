"""Points of catalogued files as a link table (file_id, point_id), for files whose points don't fit in a row.

The catalogue then keeps ``point_ids`` null; the operators here stand beside those of ``catalog`` that read the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links_of(files: DataFrame) -> DataFrame:
    """The link table of a catalogue that lists its points in arrays."""
    return files.select(F.col("id").alias("file_id"), F.explode("point_ids").alias("point_id")).distinct()


def link_points(links: DataFrame, points: DataFrame) -> DataFrame:
    """Links after points of some files were written: all points of those files, and the links of all others."""
    new = points.select("file_id", "point_id").where("file_id is not null and point_id is not null").distinct()
    return links.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def mark_linked(files: DataFrame, points: DataFrame, model_name: str, model_version: str = "1.0", now: Column | None = None) -> DataFrame:
    """Files that have points become INDEXED; which points they are stays in the link table. One row per file is shuffled."""
    hit = F.col("_hit").isNotNull()
    stamp = F.lit(None).cast("double") if now is None else now
    marked = points.select(F.col("file_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    values = {"status": F.lit("INDEXED"), "model_name": F.lit(model_name), "model_version": F.lit(model_version), "embedded_at": stamp, "updated_at": stamp}
    joined = files.join(marked, "id", "left")
    return joined.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in files.columns])


def removed_points(files: DataFrame, links: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, file_path, point_id) of every point to clean up after files are gone."""
    gone = files.join(listing.select("file_path"), "file_path", "left_anti").select(F.col("id").alias("file_id"), "file_path")
    return links.join(gone, "file_id").select(F.col("file_id").alias("id"), "file_path", "point_id")


def linked_donors(files: DataFrame, links: DataFrame) -> DataFrame:
    """Per content hash the lowest id; it donates only if it is INDEXED and has links itself."""
    known = files.filter(F.col("content_hash").isNotNull())
    lowest = known.groupBy("content_hash").agg(F.min_by(F.struct("id", "status"), "id").alias("donor"))
    usable = lowest.filter(F.col("donor.status") == "INDEXED").select("content_hash", F.col("donor.id").alias("donor_id"))
    return usable.join(links.select(F.col("file_id").alias("donor_id")), "donor_id", "left_semi").select("content_hash", "donor_id")


def donate_links(links: DataFrame, reused: DataFrame) -> DataFrame:
    """Links after files took over their donor's points (``reused``: id, donor_id); a file's earlier links go."""
    pairs = reused.select("id", "donor_id").where("id <> donor_id")
    given = links.withColumnRenamed("file_id", "donor_id").join(pairs, "donor_id").select(F.col("id").alias("file_id"), "point_id")
    kept = links.join(pairs.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_anti")
    return kept.unionByName(given.distinct())
