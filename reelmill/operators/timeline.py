"""Timelines: compilation, reads, edit lists and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, millis, name_of, nonzero, round_to, suffix_of
from ..schemas import PAN_ZOOM_CYCLE, TIMELINE
from .ordering import first_row, nearest, position_of, sums_before, value_before

POSITION_SLICE = 4096
VIDEO_TYPES = ("video", "video_clip")
CLIP_SUFFIXES = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm")


def _slices() -> list[Column]:
    return [F.floor(F.col("position") / F.lit(POSITION_SLICE))]


def compile_timeline(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Timeline rows of a storyboard (``job_id``, ``position``, ...).

    A missing file id is looked up by path; rows that stay without one are dropped and leave a gap.
    """
    ids = files.select("file_path", F.col("id").alias("_id"))
    joined = segments.join(ids, "file_path", "left").withColumn("file_id", F.coalesce("file_id", "_id"))
    rows = joined.filter(F.col("file_id").isNotNull())
    score = F.coalesce(nonzero(F.col("composite_rank")), F.col("similarity_score"))
    values = {"similarity_score": score, "time_bucket": F.col("position")}
    return rows.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TIMELINE])


def load_timeline(timeline: DataFrame, job_id: str) -> DataFrame:
    return timeline.filter(F.col("job_id") == job_id).orderBy("position")


def timelines_with_files(timeline: DataFrame, files: DataFrame) -> DataFrame:
    """All saved segments with their file's columns; rows of deleted files disappear.

    Rows stay flat (job, position): an array per job would gather a whole job in one row.
    """
    side = files.select(
        F.col("id").alias("file_id"), "file_path", "file_type", "creation_timestamp", F.col("duration_seconds").alias("total_duration")
    )
    joined = timeline.join(side, "file_id")
    return joined.select(
        "job_id", "position", "file_path", name_of(F.col("file_path")).alias("file_name"), "file_type", "segment_type",
        "duration", "start_offset", "similarity_score", "creation_timestamp", "total_duration",
    )


def _is_video() -> Column:
    by_suffix = suffix_of(F.coalesce("file_path", F.lit(""))).isin(*CLIP_SUFFIXES)
    return F.coalesce(F.lower("segment_type").isin(*VIDEO_TYPES), F.lit(False)) | by_suffix


def edit_list(segments: DataFrame, keys: Sequence[str] = ("job_id",), transition: float = 0.5) -> DataFrame:
    """Render plan: clamped durations, cross-fade of each cut, start offset of each segment, plain total.

    A segment starts at the sum of what its predecessors keep after their fade, so each term needs only
    its own row.
    """
    video = _is_video()
    length = F.when(video, clamp(F.coalesce("duration", F.lit(3.5)), 1.5, 10.0)).otherwise(
        clamp(F.coalesce("duration", F.lit(2.5)), 1.0, 2.5)
    )
    timed = segments.withColumn("clip_seconds", length).withColumn(
        "fade_out", F.least(F.lit(min(0.5, transition)), F.col("clip_seconds") * F.lit(0.4))
    )
    kept = F.greatest(F.lit(0.1), F.col("clip_seconds") - F.col("fade_out"))
    placed = sums_before(
        timed.withColumn("_kept", kept), keys, [F.asc("position")], _slices(), {"_ms": F.floor(F.col("_kept") * 1e6 + F.lit(0.5)).cast("long")}
    )
    totals = timed.groupBy(*keys).agg((F.sum(F.floor(F.col("clip_seconds") * 1e6 + F.lit(0.5)).cast("long")) / F.lit(1e6)).alias("total_seconds"))
    return (
        placed.withColumn("starts_at", F.col("_ms") / F.lit(1e6))
        .join(totals, list(keys))
        .withColumn("fade_out", round_to(F.col("fade_out"), 6))
        .drop("_kept", "_ms")
    )


def dominant_resolution(segments: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """4K when more than half of a job's sources are; 1080p otherwise (``sizes``: file_path, width, height)."""
    large = F.coalesce((F.col("width") >= 3840) | (F.col("height") >= 2160), F.lit(False))
    named = segments.filter(F.coalesce("file_path", F.lit("")) != "")
    counted = named.join(sizes, "file_path", "left").groupBy(*keys).agg(
        F.count_if(large).alias("large_sources"), F.count("*").alias("sources")
    )
    four_k = F.col("large_sources") > F.col("sources") / 2
    return counted.withColumn("out_width", F.when(four_k, 3840).otherwise(1920)).withColumn("out_height", F.when(four_k, 2160).otherwise(1080))


def inventory(timeline: DataFrame, files: DataFrame, points: DataFrame) -> DataFrame:
    """Timeline rows with file facts and the scores of the point nearest to their start offset.

    ``segment_index`` counts from 1 without the gaps that positions may have; the motion follows it.
    """
    side = files.select(F.col("id").alias("file_id"), "file_path", "file_size", "creation_timestamp")
    numbered = position_of(timeline, ["job_id"], [F.col("position")], _slices(), "segment_index")
    rows = numbered.join(side, "file_id", "left").withColumns(
        {"start_offset": F.coalesce("start_offset", F.lit(0.0)), "file_path": F.coalesce("file_path", F.lit("unknown"))}
    )
    order = [F.when(F.col("granularity") == "scene", 0).otherwise(1), F.asc("frame_index"), F.asc("point_id")]
    spots = first_row(points.select("file_path", "source_offset", "granularity", "frame_index", "point_id", "scores"),
                      ["file_path", "source_offset"], order)
    spots = spots.select("file_path", "source_offset", F.col("point_id").alias("nearest_point_id"), F.col("scores").alias("quality_scores"))
    found = nearest(rows, spots, ["file_path"], "start_offset", "source_offset", ["nearest_point_id", "quality_scores"], 3600.0)
    video = _is_video()
    effective = F.when(video, clamp(F.col("duration"), 1.5, 10.0)).otherwise(clamp(F.col("duration"), 1.0, 5.0))
    return found.withColumns(
        {
            "media_type": F.when(video, "video").otherwise("photo"),
            "file_name": name_of(F.col("file_path")),
            "file_size_mb": round_to(nonzero(F.col("file_size")) / F.lit(1048576.0), 2),
            "effective_seconds": effective,
            "capture_time": F.coalesce(
                F.date_format(F.timestamp_micros((nonzero(F.col("creation_timestamp")) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")
            ),
            "motion": F.when(~video, pan_zoom_by_index(F.col("segment_index"))),
            "segment_index": F.col("segment_index") + 1,
        }
    )


def chronology_audit(timeline: DataFrame, files: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Per job: do capture times never fall, missing ones ignored?"""
    times = files.select(F.col("id").alias("file_id"), "creation_timestamp")
    rows = timeline.join(times, "file_id", "left")
    timed = rows.filter(nonzero(F.col("creation_timestamp")).isNotNull())
    linked = value_before(timed, keys, ["position"], _slices(), F.col("creation_timestamp"), "_previous")
    ordered = linked.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("creation_timestamp") >= F.col("_previous"), F.lit(True))).alias("_ok"))
    jobs = timeline.select(*keys).distinct()
    return jobs.join(ordered, list(keys), "left").select(*keys, F.coalesce("_ok", F.lit(True)).alias("is_chronological"))


def duration_audit(timeline: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Per job: does the total lie between the target and 1.25 targets?"""
    totals = timeline.groupBy(*keys).agg(F.sum(millis(F.col("duration"))).alias("_ms"), F.count("*").alias("segments"))
    joined = jobs.select(*keys, "target_duration").join(totals, list(keys), "left")
    ms, goal = F.coalesce("_ms", F.lit(0)), F.col("target_duration").cast("double") * 1000
    return joined.select(
        *keys, "target_duration", F.coalesce("segments", F.lit(0).cast("long")).alias("segments"),
        (ms / F.lit(1000.0)).alias("total_duration"), ((ms >= goal) & (ms <= goal * 1.25)).alias("within_bounds"),
    )


def pan_zoom_by_index(index: Column) -> Column:
    cycle = F.array(*[F.lit(m) for m in PAN_ZOOM_CYCLE])
    return F.element_at(cycle, (index % len(PAN_ZOOM_CYCLE)).cast("int") + 1)


def motion_plan(segments: DataFrame, index: str = "position") -> DataFrame:
    """Pan or zoom per photo from aspect and subject position (``width``, ``height``, ``subject_x``).

    Without a size the motion cycles by index, as it does between the wide and the square range.
    """
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(1.0))
    x = F.coalesce("subject_x", F.lit(0.5))
    motion = (
        F.when(known & (aspect >= 1.4) & (x < 0.42), "pan_left")
        .when(known & (aspect >= 1.4) & (x > 0.58), "pan_right")
        .when(known & (aspect >= 1.4), "zoom_out")
        .when(known & (aspect < 1.2) & x.between(0.4, 0.6), "zoom_in")
        .when(known & (aspect < 1.2), "zoom_out")
        .otherwise(pan_zoom_by_index(F.col(index)))
    )
    return segments.withColumn("motion", motion)
