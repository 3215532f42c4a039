"""Frames and scenes: sampling, cut detection, tagging, scene representatives, point rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from ..functions.columns import clamp, mean_of_units, round_to, sum_units, units
from ..functions.vectors import l2_normalize
from ..schemas import MISSING_SCORE
from .ordering import position_of, value_before
from .search import point_key

ORDER_SLICE = 4096


def sample_frames(frame_index: DataFrame, fps: float = 1.0) -> DataFrame:
    """Every ``round(src_fps / fps)``-th frame, renumbered from 0 per file, with its offset in seconds.

    ``frame_index``: file_id, idx, src_fps. Without a rate every 30th frame is kept and the offset is
    the new number itself.
    """
    known = F.coalesce(F.col("src_fps") > 0, F.lit(False))
    interval = F.when(known, F.greatest(F.lit(1), F.bround(F.col("src_fps") / F.lit(fps)).cast("int"))).otherwise(30)
    kept = frame_index.withColumn("_every", interval).filter(F.col("idx") % F.col("_every") == 0)
    slices = [F.floor(F.col("idx") / F.lit(ORDER_SLICE))]
    numbered = position_of(kept, ["file_id"], [F.col("idx")], slices, "frame_no")
    offset = F.when(known, F.col("idx") / F.col("src_fps")).otherwise(F.col("frame_no").cast("double"))
    return numbered.withColumn("source_offset", round_to(offset, 3)).drop("_every")


def preview_frames(clips: DataFrame, frame_index: DataFrame, fps: int = 12) -> DataFrame:
    """Frames of a clip preview: ``int(clamp(duration, 1, 10) * fps)`` of them, evenly stepped.

    ``clips``: clip_id, file_id, start_offset, duration. Frame n of the preview sits at a fixed index,
    so the wanted indices are generated per clip and equi-joined; no window over the video is needed.
    """
    rates = frame_index.groupBy("file_id").agg(F.max("src_fps").alias("src_fps"))
    rate = F.coalesce(F.when(F.col("src_fps") > 0, F.col("src_fps")), F.lit(30.0))
    plan = (
        clips.join(rates, "file_id")
        .withColumn("_n", (clamp(F.col("duration"), 1.0, 10.0) * F.lit(fps)).cast("int"))
        .withColumn("_step", F.greatest(F.lit(1), (rate / F.lit(fps)).cast("int")))
        .withColumn("_first", F.ceil(F.greatest(F.lit(0.0), F.col("start_offset")) * rate))
        .withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("idx", F.col("_first") + F.col("frame_no") * F.col("_step"))
    )
    return plan.select("clip_id", "file_id", "frame_no", "idx").join(frame_index.select("file_id", "idx"), ["file_id", "idx"], "left_semi")


# --- scene detection ----------------------------------------------------------------------------


def cut_candidates(frames: DataFrame, threshold: float = 3.0, min_change: float = 0.0, around: int = 2) -> DataFrame:
    """Frames whose change against the previous one exceeds ``threshold`` times its local average.

    ``frames``: file_id, frame_index, features (array). Change is the mean absolute feature difference;
    the local average leaves the frame itself out. A video is cut into slices, so a long one spreads over
    many tasks.
    """
    earlier = value_before(
        frames, ["file_id"], ["frame_index"], [F.floor(F.col("frame_index") / F.lit(ORDER_SLICE))], F.col("features"), "_before"
    )
    gap = F.zip_with("features", "_before", lambda a, b: F.abs(a - b))
    total = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    change = F.when(F.col("_before").isNotNull(), total / F.size("features"))
    changes = earlier.select("file_id", "frame_index", change.alias("change"))
    # a slice also gets copies of its neighbours' border frames, so the local average needs no join
    inside = F.col("frame_index") % ORDER_SLICE
    own = F.floor(F.col("frame_index") / F.lit(ORDER_SLICE))
    slices = F.array(own, F.when(inside < around, own - 1), F.when(inside >= ORDER_SLICE - around, own + 1))
    spread = changes.filter("change is not null").withColumn("_slice", F.explode(F.array_compact(slices)))
    ordered = W.partitionBy("file_id", "_slice").orderBy("frame_index")
    # one addition after another from the last neighbour to the first, as the SQL twin's engine adds: the last bits decide on exact ties
    near = F.collect_list(F.struct("frame_index", "change")).over(ordered.rangeBetween(-around, around))
    joined = spread.withColumn("_near", F.filter(near, lambda x: x["frame_index"] != F.col("frame_index"))).filter(F.col("_slice") == own)
    sums = F.aggregate(F.reverse("_near"), F.lit(0.0), lambda s, x: s + x["change"])
    joined = joined.withColumn("local", sums / F.nullif(F.size("_near"), F.lit(0))).filter(F.col("local").isNotNull())
    ratio = F.col("change") / F.greatest(F.col("local"), F.lit(1e-9))
    return joined.filter((F.col("change") > min_change) & (ratio >= threshold)).select("file_id", "frame_index", "change", "local")


def _accept(candidates: np.ndarray, gate: int, last: int) -> tuple[list[int], int]:
    taken = []
    while True:
        at = np.searchsorted(candidates, last + gate)
        if at == len(candidates):
            return taken, last
        last = int(candidates[at])
        taken.append(last)


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def gate_cuts(candidates: DataFrame, gate: str = "min_frames", slice_frames: int = 1 << 16) -> DataFrame:
    """Cuts that keep every scene at least ``gate`` frames long: each accepted cut blocks the next ones.

    The rule is sequential, but what a slice of a video does depends only on how far before its start
    the last cut lies, and only up to ``gate`` frames. So each slice tabulates its exit for every possible entry. In nearly all
    slices every entry leads to one exit (a pause longer than the gate is enough), and the next slice starts from there without
    knowing more. Only runs of slices that keep several exits are followed one after the other. Candidates are read once;
    a slice holds at most ``slice_frames`` of them, and a video's slices are numbered from one narrow row each.
    """
    key = candidates.schema["file_id"].dataType.simpleString()
    sliced = candidates.withColumn("_slice", F.floor(F.col("frame_index") / F.lit(slice_frames)).cast("long"))
    packed = sliced.groupBy("file_id", "_slice").agg(
        F.sort_array(F.collect_list(F.col("frame_index").cast("long"))).alias("frames"), F.max(F.col(gate).cast("long")).alias("width")
    )

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, fixed = [], []
            for found, width, n in zip(_lists(batch.column("frames")), batch.column("width").to_pylist(), batch.column("_slice").to_pylist()):
                # entry e: the last cut lies e frames before the slice; e = width already means "not blocked"
                table = [_accept(found, width, n * slice_frames - e)[1] for e in range(width + 1)]
                ends.append(table)
                fixed.append(table[0] if min(table) == max(table) and table[0] >= n * slice_frames else None)
            columns = [batch.column(c) for c in ("file_id", "_slice", "width", "frames")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.list_(pa.int64())), pa.array(fixed, pa.int64())],
                                             ["file_id", "_slice", "width", "frames", "exits", "fixed"])

    table = packed.mapInArrow(exits, f"file_id {key}, _slice long, width long, frames array<long>, exits array<long>, fixed long")
    order = W.partitionBy("file_id").orderBy("_slice")
    settled = F.col("fixed").isNotNull().cast("long")
    runs = table.withColumns({
        "_run": F.coalesce(F.sum(settled).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_before": F.lag("fixed").over(order)
    })
    chains = runs.groupBy("file_id", "_run").agg(F.sort_array(F.collect_list(F.struct("_slice", "_before", "width", "exits", "frames"))).alias("chain"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = []
            for chain in batch.column("chain").to_pylist():
                last, cuts = chain[0]["_before"] or 0, []
                for step in chain:
                    start = step["_slice"] * slice_frames
                    cuts += _accept(np.array(step["frames"], np.int64), step["width"], last)[0]
                    outcome = step["exits"][min(start - last, step["width"])]
                    last = outcome if outcome >= start else last
                taken.append(cuts)
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(taken, pa.list_(pa.int64()))], ["file_id", "taken"])

    return chains.mapInArrow(take, f"file_id {key}, taken array<long>").select("file_id", F.explode("taken").alias("frame_index"))


def detect_scenes(frames: DataFrame, threshold: float = 3.0, min_seconds: float = 2.0, min_change: float = 0.0) -> DataFrame:
    """Scene intervals per video: file_id, scene_id, scene_start, scene_end, start_frame, end_frame.

    ``frames``: file_id, frame_index, src_fps, features. Without a cut the whole video is scene 0.
    """
    rate = F.coalesce(F.when(F.col("src_fps") > 0, F.col("src_fps")), F.lit(30.0))
    videos = frames.groupBy("file_id").agg(F.max("src_fps").alias("src_fps"), (F.max("frame_index") + 1).alias("frames"))
    videos = videos.withColumn("fps", rate).drop("src_fps")
    gates = videos.select("file_id", F.greatest(F.lit(15), F.bround(F.col("fps") * F.lit(min_seconds))).cast("long").alias("min_frames"))
    cuts = gate_cuts(cut_candidates(frames, threshold, min_change).join(gates, "file_id"))
    starts = videos.select("file_id", F.lit(0).cast("long").alias("start_frame")).unionByName(
        cuts.select("file_id", F.col("frame_index").alias("start_frame"))
    )
    # scenes are at least 15 frames long: a few rows per minute of a video
    order = W.partitionBy("file_id").orderBy("start_frame")
    numbered = starts.withColumns({"scene_id": F.row_number().over(order) - 1, "_next": F.lead("start_frame").over(order)})
    scenes = numbered.join(videos, "file_id")
    end = F.coalesce(F.col("_next"), F.col("frames"))
    return scenes.select(
        "file_id",
        F.col("scene_id").cast("int").alias("scene_id"),
        round_to(F.col("start_frame") / F.col("fps"), 3).alias("scene_start"),
        round_to(end / F.col("fps"), 3).alias("scene_end"),
        "start_frame",
        end.alias("end_frame"),
    )


def tag_scene(frames: DataFrame, scenes: DataFrame, bin_seconds: float = 60.0) -> DataFrame:
    """Each frame gets the first scene that holds its offset (both ends inclusive), else the file's first.

    Scenes are laid into time bins and folded into one short array per (file, bin), beside the file's first scene, so a frame meets the
    scenes of its minute only, in one join, and a long video spreads over its bins.
    """
    def bin_of(seconds: Column) -> Column:
        return F.coalesce(F.floor(seconds / F.lit(bin_seconds)), F.lit(-1).cast("long"))

    scene = F.struct("scene_id", "scene_start", "scene_end")
    binned = scenes.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("scene_start")), bin_of(F.col("scene_end")))))
    lists = binned.groupBy("file_id", "_bin").agg(F.sort_array(F.collect_list(scene)).alias("_scenes"))
    firsts = scenes.groupBy("file_id").agg(F.min(scene).alias("_first"))
    holding = F.filter("_scenes", lambda s: (s.scene_start <= F.col("source_offset")) & (F.col("source_offset") <= s.scene_end))
    rows = frames.withColumn("_bin", bin_of(F.col("source_offset")))
    slots = rows.select("file_id", "_bin").distinct().join(firsts, "file_id").join(lists, ["file_id", "_bin"], "left")
    placed = rows.join(slots, ["file_id", "_bin"], "left")
    tagged = placed.withColumn("_scene", F.coalesce(F.try_element_at(holding, F.lit(1)), F.col("_first")))
    fields = {c: F.col(f"_scene.{c}") for c in ("scene_id", "scene_start", "scene_end")}
    return tagged.withColumns(fields).drop("_scene", "_scenes", "_first", "_bin")


def scene_representatives(frames: DataFrame, score_keys: Sequence[str] | None = None) -> DataFrame:
    """One row per (file, scene): unit mean vector, mean scores (missing 0.5), first frame's bounds.

    Scores are added up in whole units, so the order of the frames changes nothing. All sums combine map-side, so a scene that holds very many frames costs one row per task. The score
    keys of a scene are those of its first frame that has any, unless ``score_keys`` fixes them; frames without scores don't count.
    """
    scene_rows = frames.filter((F.col("file_type") == "video") & F.col("scene_id").isNotNull())
    order = F.struct("frame_index", "point_id")
    first = F.min_by(F.struct("scene_start", "scene_end", "file_path", "creation_timestamp", "duration_seconds"), order)
    scored = F.size("scores") > 0
    grouped = scene_rows.groupBy("file_id", "scene_id").agg(
        Summarizer.mean(array_to_vector(F.col("vector"))).alias("_mean"), first.alias("_first"), F.count("*").alias("scene_frame_count"),
        F.min_by(F.when(scored, F.map_keys("scores")), F.when(scored, order)).alias("_keys"), F.sum(scored.cast("int")).alias("_scored"),
    )
    # per key: what scored frames hold, and MISSING_SCORE for those without it
    sums = scene_rows.select("file_id", "scene_id", F.explode("scores").alias("k", "v")).groupBy("file_id", "scene_id", "k").agg(
        sum_units(F.coalesce("v", F.lit(MISSING_SCORE))).alias("s"), F.count("*").alias("n")
    )
    maps = sums.groupBy("file_id", "scene_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("s", "n")))).alias("_sums"))
    grouped = grouped.join(maps, ["file_id", "scene_id"], "left")
    wanted = F.col("_keys") if score_keys is None else F.array(*[F.lit(k) for k in score_keys])

    def mean(k: Column) -> Column:
        held = F.try_element_at("_sums", k)
        missing = units(F.lit(MISSING_SCORE)).cast("decimal(20,0)") * (F.col("_scored") - F.coalesce(held["n"], F.lit(0))).cast("decimal(10,0)")
        total = F.coalesce(held["s"], F.lit(0).cast("decimal(38,0)")) + missing
        return F.coalesce(mean_of_units(total, F.col("_scored"), 4), F.lit(MISSING_SCORE))

    empty = F.create_map().cast("map<string,double>")
    kept = F.coalesce(F.map_from_entries(F.transform(wanted, lambda k: F.struct(k, mean(k)))), empty)
    offset = F.coalesce(F.col("_first.scene_start"), F.lit(0.0))
    path = F.col("_first.file_path")
    return grouped.select(
        point_key(path, F.lit("scene"), offset, F.col("scene_id")).alias("point_id"),
        l2_normalize(vector_to_array("_mean")).cast("array<float>").alias("vector"),
        path.alias("file_path"),
        "file_id",
        F.lit("video").alias("file_type"),
        F.lit(-1).alias("frame_index"),
        offset.alias("source_offset"),
        F.col("_first.creation_timestamp").alias("creation_timestamp"),
        F.col("_first.duration_seconds").alias("duration_seconds"),
        F.lit("scene").alias("granularity"),
        "scene_id",
        F.col("_first.scene_start").alias("scene_start"),
        F.col("_first.scene_end").alias("scene_end"),
        "scene_frame_count",
        F.lit(True).alias("is_scene_representative"),
        kept.alias("scores"),
    )


def build_points(frames: DataFrame, score_keys: Sequence[str] | None = None) -> DataFrame:
    """Frame points plus one scene point per video scene (``frames``: tagged, with vector and scores)."""
    columns = scene_representatives(frames, score_keys)
    frame_rows = frames.withColumns(
        {"granularity": F.lit("frame"), "is_scene_representative": F.lit(False), "scene_frame_count": F.lit(None).cast("long")}
    ).select(*columns.columns)
    return frame_rows.unionByName(columns)

