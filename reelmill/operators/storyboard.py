"""Storyboard selection and scoring, keyed by job (and profile).

The greedy loops become prefixes of ordered rows: a file has one capture time, so all its candidates
fall into one time bucket, and durations are positive, so "until the target is reached" keeps a prefix.
Sums run in whole milliseconds, so they do not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp, exact_mean, millis, nonzero, round_to
from ..schemas import (
    APPROVAL_SCORE,
    FALLBACK_CANDIDATES,
    IMAGE_SECONDS,
    MIN_SCORE,
    VIDEO_SECONDS,
    VIDEO_SECONDS_RANGE,
)
from .ordering import first_row, position_of, sums_before, top_n, value_before
from .search import search_many

DEFAULT_SECONDS = 3.0
ORDER_SLICE = 4096


def check_one_time_per_file(cands: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Files with two capture times; must be empty for the selection to equal the sequential rule."""
    times = cands.groupBy(*keys, "file_path").agg(F.count_distinct(F.coalesce("creation_timestamp", F.lit(0.0))).alias("times"))
    return times.filter("times > 1")


def one_time_per_file(cands: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Candidates of a file all get its earliest capture time, so that the check finds nothing."""
    own = W.partitionBy(*keys, "file_path")
    return cands.withColumn("creation_timestamp", F.min("creation_timestamp").over(own))


# --- time buckets and selection -----------------------------------------------------------------


def _whole(keys: Sequence[str]) -> W:
    """A key's candidates: some queries of k hits each. A job with very many of them sorts and spills in one task.

    All steps up to the finished storyboard share this partitioning and need one shuffle together.
    """
    return W.partitionBy(*keys)


def viable_candidates(cands: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Scores of at least 0.08, else the first ten in input order (``seq``)."""
    passes = F.coalesce("score", F.lit(0.0)) >= MIN_SCORE
    marked = cands.withColumn("_any", F.max(passes).over(_whole(keys))).withColumn(
        "_n", F.row_number().over(_whole(keys).orderBy("seq"))
    )
    return marked.filter(passes | (~F.col("_any") & (F.col("_n") <= FALLBACK_CANDIDATES))).drop("_any", "_n")


def time_buckets(cands: DataFrame, keys: Sequence[str] = ("job_id",), buckets: int | None = None) -> DataFrame:
    """Viable candidates with ``bucket`` and ``n_buckets`` (two per day, 3 to 15).

    A missing time counts as the first one. With fewer than two times the count follows the rows.
    """
    time = nonzero(F.col("creation_timestamp"))
    whole = _whole(keys)
    rows = viable_candidates(cands, keys).withColumns(
        {"_min": F.min(time).over(whole), "_max": F.max(time).over(whole), "_timed": F.count(time).over(whole), "_rows": F.count("*").over(whole)}
    )
    timed = F.col("_timed") >= 2
    low, high = F.when(timed, F.col("_min")).otherwise(F.lit(0.0)), F.when(timed, F.col("_max")).otherwise(F.lit(1.0))
    span_days = F.greatest(F.lit(1.0), (high - low) / F.lit(86400.0))
    by_time = clamp(F.floor(span_days * 2), 3, 15) if buckets is None else F.lit(buckets)
    by_rows = clamp(F.floor(F.col("_rows") / 2), 3, 10) if buckets is None else F.lit(buckets)
    counted = rows.withColumn("n_buckets", F.when(timed, by_time).otherwise(by_rows).cast("int"))
    width = F.when(high > low, F.greatest(F.lit(1.0), (high - low + F.lit(1.0)) / F.col("n_buckets"))).otherwise(F.lit(1.0))
    index = F.floor((F.coalesce(time, low) - low) / width)
    bucket = F.greatest(F.lit(0), F.least(F.col("n_buckets") - 1, index)).cast("int")
    return counted.withColumn("bucket", bucket).drop("_min", "_max", "_timed", "_rows")


def _selection_order() -> list[Column]:
    value = F.coalesce(F.col("composite_rank"), F.col("score"), F.lit(0.0))
    return [F.desc(value), F.asc(F.coalesce("creation_timestamp", F.lit(0.0))), F.asc("seq")]


def segment_seconds(fixed: bool) -> Column:
    """Images 2.5 s; videos their scene length within 2..6 s, or 4 s without a scene (always, if ``fixed``)."""
    scene = F.coalesce("scene_end", F.lit(0.0)) - F.coalesce("scene_start", F.lit(0.0))
    clip = F.lit(VIDEO_SECONDS) if fixed else clamp(F.when(scene > 0, scene).otherwise(F.lit(VIDEO_SECONDS)), *VIDEO_SECONDS_RANGE)
    return F.when(F.col("file_type") == "video", clip).otherwise(F.lit(IMAGE_SECONDS))


def with_segment(cands: DataFrame, duration: Column, keep_image_offset: bool = False) -> DataFrame:
    """Segment columns for candidates of the given length; images start and end at 0."""
    video = F.col("file_type") == "video"
    start = F.coalesce("source_offset", F.lit(0.0))
    return cands.withColumns(
        {
            "duration": duration,
            "start_offset": start if keep_image_offset else F.when(video, start).otherwise(F.lit(0.0)),
            "end_offset": F.when(video, start + duration).otherwise(F.lit(0.0)),
            "segment_type": F.when(video, "video_clip").otherwise("image"),
            "similarity_score": F.col("score"),
        }
    )


def _clip_millis(fixed: bool) -> Column:
    return millis(segment_seconds(fixed))


def mark_bucket_best(bucketed: DataFrame, keys: Sequence[str] = ("job_id",), target: str = "target_duration") -> DataFrame:
    """Adds ``in_buckets``: the best candidate of its time bucket, buckets in order until the target."""
    ranked = bucketed.withColumn("_n", F.row_number().over(_whole([*keys, "bucket"]).orderBy(*_selection_order())))
    best = F.col("_n") == 1
    earlier = _whole(keys).orderBy("bucket", "_n").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(best, _clip_millis(False))).over(earlier), F.lit(0))
    marked = ranked.withColumn("_before", before)
    return marked.withColumn("in_buckets", best & (F.col("_before") < millis(F.col(target).cast("double")))).drop("_n", "_before")


def mark_fill(marked: DataFrame, keys: Sequence[str] = ("job_id",), target: str = "target_duration") -> DataFrame:
    """Adds ``in_fill``: further files by rank until the target is reached."""
    per_path = _whole([*keys, "file_path"])
    rows = marked.withColumns(
        {
            "_used": F.coalesce(F.sum(F.when(F.col("in_buckets"), _clip_millis(False))).over(_whole(keys)), F.lit(0)),
            "_taken": F.max("in_buckets").over(per_path),
            "_n": F.row_number().over(per_path.orderBy(*_selection_order())),
        }
    )
    leads = ~F.col("_taken") & (F.col("_n") == 1)
    earlier = _whole(keys).orderBy(*_selection_order()).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(leads, _clip_millis(True))).over(earlier), F.lit(0))
    room = F.col("_used") + F.col("_before") < millis(F.col(target).cast("double"))
    return rows.withColumn("_before", before).withColumn("in_fill", leads & room).drop("_used", "_taken", "_n", "_before")


def bucket_best(bucketed: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Segments of the bucket pass; at most 15 per key."""
    return with_segment(mark_bucket_best(bucketed, keys).filter("in_buckets"), segment_seconds(False)).drop("in_buckets")


def fill_to_target(bucketed: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Segments of the fill pass that follows the bucket pass."""
    marked = mark_fill(mark_bucket_best(bucketed, keys), keys)
    return with_segment(marked.filter("in_fill"), segment_seconds(True)).drop("in_buckets", "in_fill")


def curate(cands: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Rule-based storyboard per key: best of each time bucket, filled by rank, in chronological order.

    ``jobs``: keys and ``target_duration``. Ties in time keep the order of selection.
    """
    planned = cands.join(jobs.select(*keys, "target_duration"), list(keys))
    chosen = mark_fill(mark_bucket_best(time_buckets(planned, keys), keys), keys).filter("in_buckets or in_fill")
    length = F.when(F.col("in_buckets"), segment_seconds(False)).otherwise(segment_seconds(True))
    picked = F.when(F.col("in_buckets"), F.col("bucket")).otherwise(F.lit(1000))
    order = [F.asc(F.coalesce("creation_timestamp", F.lit(0.0))), picked, *_selection_order()]
    board = with_segment(chosen, length).withColumn("position", F.row_number().over(_whole(keys).orderBy(*order)) - 1)
    return board.drop("in_buckets", "in_fill", "n_buckets")


# --- drafts -------------------------------------------------------------------------------------


def draft_dedupe(draft: DataFrame, cands: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Fill a draft's missing columns from the candidate of the same path, keep the first segment per path.

    When a path has several candidates the last one in rank order counts. Zero and empty count as missing.
    """
    named = draft.filter(F.coalesce("file_path", F.lit("")) != "")
    firsts = first_row(named, [*keys, "file_path"], [F.asc("seq")])
    last = first_row(cands, [*keys, "file_path"], [F.desc("place")])
    source = last.select(
        *keys, "file_path", F.col("creation_timestamp").alias("_ts"), F.col("file_id").alias("_id"), F.col("score").alias("_score"),
        F.col("composite_rank").alias("_rank"), F.col("scores").alias("_scores"),
    )
    joined = firsts.join(source, [*keys, "file_path"], "left")

    def filled(name: str, other: str) -> Column:
        return F.coalesce(nonzero(F.col(name)), F.col(other), F.col(name))

    return joined.withColumns(
        {
            "creation_timestamp": filled("creation_timestamp", "_ts"),
            "file_id": filled("file_id", "_id"),
            "similarity_score": filled("similarity_score", "_score"),
            "composite_rank": filled("composite_rank", "_rank"),
            "scores": F.when(F.size("scores") > 0, F.col("scores")).otherwise(F.coalesce("_scores", "scores")),
        }
    ).drop("_ts", "_id", "_score", "_rank", "_scores")


def _seconds() -> Column:
    return F.coalesce("duration", F.lit(DEFAULT_SECONDS))


DRAFT_COLUMNS = (
    "file_path", "file_id", "start_offset", "end_offset", "duration", "segment_type", "scene_id", "retrieval_strategy",
    "similarity_score", "composite_rank", "scores", "creation_timestamp", "seq",
)


def autofill(draft: DataFrame, cands: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """A draft below its target takes unused files in rank order (``place``) until it reaches it.

    ``jobs``: keys and ``target_duration``; a job without any draft row is filled from nothing.
    """
    used = draft.groupBy(*keys).agg(F.sum(millis(_seconds())).alias("_used"), F.max("seq").alias("_last"))
    unused = cands.join(draft.select(*keys, "file_path"), [*keys, "file_path"], "left_anti")
    per_file = first_row(unused, [*keys, "file_path"], [F.asc("place")])
    leading = per_file.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("place")))
    earlier = W.partitionBy(*keys).orderBy("_n").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(_clip_millis(True)).over(earlier), F.lit(0))
    timed = with_segment(leading, segment_seconds(True), keep_image_offset=True).withColumn("_before", before)
    planned = timed.join(jobs.select(*keys, "target_duration"), list(keys)).join(used, list(keys), "left")
    room = F.coalesce("_used", F.lit(0)) + F.col("_before") < millis(F.col("target_duration").cast("double"))
    added = planned.filter(room).withColumn("seq", F.coalesce("_last", F.lit(-1)) + F.col("_n")).withColumn(
        "retrieval_strategy", F.coalesce("granularity", F.lit("frame"))
    )
    columns = [*keys, *DRAFT_COLUMNS]
    return draft.select(*columns).unionByName(added.select(*columns))


def segment_limits(target: Column, factor: Column) -> tuple[Column, Column]:
    """Fewest and most segments asked for: a quarter and a half of the seconds, scaled by the profile."""
    fewest = F.greatest(F.lit(4), (F.floor(target / 4) * factor).cast("int"))
    most = F.greatest(fewest + 4, (F.floor(target / 2) * factor).cast("int"))
    return fewest, most


def _draft_rank() -> Column:
    return F.coalesce(nonzero(F.col("composite_rank")), nonzero(F.col("similarity_score")), F.lit(0.0))


def tail_trim(draft: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Drop the lowest-ranked segments while the total exceeds 1.25 targets and enough segments stay.

    ``jobs``: keys, ``target_duration``, ``min_segments``. Equal ranks fall in draft order.
    """
    totals = draft.groupBy(*keys).agg(F.sum(millis(_seconds())).alias("_total"), F.count("*").alias("_rows"))
    ranked = draft.withColumn("_rank", F.floor(_draft_rank() * F.lit(1e8) + F.lit(0.5)))
    order = [F.asc("_rank"), F.asc("seq")]
    # ranks compare at 8 decimals; equal ones are cut further by draft order
    bucket = [F.col("_rank"), F.floor(F.col("seq") / F.lit(ORDER_SLICE))]
    one = F.lit(1).cast("long")
    running = sums_before(ranked, keys, order, bucket, {"_gone": millis(_seconds()), "_count": one})
    planned = running.join(totals, list(keys)).join(jobs.select(*keys, "target_duration", "min_segments"), list(keys))
    limit = F.col("target_duration").cast("double") * F.lit(1250.0)
    removed = (F.col("_total") - F.col("_gone") > limit) & (F.col("_rows") - F.col("_count") > F.col("min_segments"))
    return planned.filter(~removed).select(*draft.columns)


def chronological(draft: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Zero-based ``position`` by capture time (missing first), then draft order."""
    timed = draft.withColumn("_time", F.coalesce("creation_timestamp", F.lit(0.0)))
    untimed = F.when(F.col("_time") == 0, F.floor(F.col("seq") / F.lit(ORDER_SLICE))).otherwise(F.lit(1 << 60))
    bucket = [F.when(F.col("_time") == 0, F.lit(-1)).otherwise(F.floor(F.col("_time") / 3600)), untimed]
    order = [F.asc("_time"), F.asc("seq")]
    return position_of(timed, keys, order, bucket, "position").drop("_time")


def board_from_ranks(cands: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Autofill of an empty draft, trim and chronological order as windows over one partitioning by key.

    ``jobs``: keys, ``target_duration``, ``min_segments``. The same rows as the three operators one after another.
    """
    whole = _whole(keys)
    target = F.col("target_duration").cast("double")

    def earlier(*order: str) -> W:
        return whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)

    planned = cands.join(jobs.select(*keys, "target_duration", "min_segments"), list(keys)).repartition(*[F.col(k) for k in keys])
    leads = planned.withColumn("_n", F.row_number().over(_whole([*keys, "file_path"]).orderBy("place"))).filter("_n = 1")
    placed = leads.withColumns({
        "_before": F.coalesce(F.sum(_clip_millis(True)).over(earlier("place")), F.lit(0)),
        "seq": (F.row_number().over(whole.orderBy("place")) - 1).cast("long"),
    }).filter(F.col("_before") < millis(target))
    filled = with_segment(placed, segment_seconds(True), keep_image_offset=True)
    ranked = filled.withColumns({"retrieval_strategy": F.coalesce("granularity", F.lit("frame")), "_rank": F.floor(_draft_rank() * F.lit(1e8) + F.lit(0.5))})
    length = millis(_seconds())
    summed = ranked.withColumns({
        "_total": F.sum(length).over(whole), "_rows": F.count("*").over(whole),
        "_gone": F.coalesce(F.sum(length).over(earlier("_rank", "seq")), F.lit(0)), "_count": F.row_number().over(whole.orderBy("_rank", "seq")) - 1,
    })
    removed = (F.col("_total") - F.col("_gone") > target * F.lit(1250.0)) & (F.col("_rows") - F.col("_count") > F.col("min_segments"))
    board = summed.filter(~removed).withColumn("_time", F.coalesce("creation_timestamp", F.lit(0.0)))
    board = board.withColumn("position", (F.row_number().over(whole.orderBy("_time", "seq")) - 1).cast("long"))
    return board.select(*keys, *DRAFT_COLUMNS, "position")


# --- evaluation ---------------------------------------------------------------------------------


def score_storyboard(drafts: DataFrame, jobs: DataFrame, keys: Sequence[str] = ("job_id",), per: Sequence[str] = ()) -> DataFrame:
    """Five-part storyboard score on a 0..10 scale, 2 decimals, with its parts.

    ``per`` are extra key columns of the drafts (such as ``iteration``). Jobs come from ``jobs``; one
    without segments gets the score of an empty storyboard when ``per`` is empty.
    """
    nima = F.coalesce(F.try_element_at("scores", F.lit("nima_aesthetic")), F.lit(0.5))
    relevance = F.coalesce(nonzero(F.col("similarity_score")), F.lit(0.10))
    kind, length = F.coalesce("segment_type", F.lit("")), millis(_seconds())
    parts = drafts.groupBy(*keys, *per).agg(
        F.sum(length).alias("_ms"),
        F.sum((length * length).cast("decimal(28,0)")).alias("_squares"),
        exact_mean(nima).alias("_nima"),
        exact_mean(relevance).alias("_rel"),
        (F.min(kind) != F.max(kind)).alias("_mixed"),
        F.count("*").alias("segments"),
    )
    # the deviation from whole milliseconds: the same in any order
    spread = F.col("_squares") * F.col("segments").cast("decimal(20,0)") - F.col("_ms").cast("decimal(19,0)") * F.col("_ms").cast("decimal(19,0)")
    parts = parts.withColumns({
        "total_duration": F.col("_ms") / F.lit(1000.0), "_std": F.sqrt(spread.cast("double")) / F.col("segments") / F.lit(1000.0)
    }).drop("_ms", "_squares")
    plan = jobs.select(*keys, F.col("target_duration").cast("double").alias("target_duration"))
    joined = plan.join(parts, list(keys), "inner" if per else "left")
    total, low = F.coalesce("total_duration", F.lit(0.0)), F.col("target_duration")
    high = low * F.lit(1.25)
    duration = (
        F.when(total < low, F.greatest(F.lit(0.0), total / low))
        .when(total > high, F.greatest(F.lit(0.0), F.lit(1.0) - (total - high) / low))
        .otherwise(F.lit(1.0))
    )
    scored = joined.withColumns(
        {
            "total_duration": total,
            "segments": F.coalesce("segments", F.lit(0).cast("long")),
            "duration_score": duration,
            "pacing_score": clamp(F.coalesce("_std", F.lit(0.0)), 0.2, 1.0),
            "visual_score": F.coalesce("_nima", F.lit(0.5)),
            "relevance_score": F.coalesce(clamp((F.col("_rel") - F.lit(0.05)) / F.lit(0.18), 0.0, 1.0), F.lit(0.5)),
            "diversity_score": F.when(F.col("_mixed"), F.lit(1.0)).otherwise(F.lit(0.7)),
        }
    )
    total_score = F.lit(10.0) * (
        F.lit(0.25) * F.col("duration_score") + F.lit(0.20) * F.col("pacing_score") + F.lit(0.25) * F.col("visual_score")
        + F.lit(0.20) * F.col("relevance_score") + F.lit(0.10) * F.col("diversity_score")
    )
    return scored.withColumn("composite_score", round_to(total_score, 2)).drop("_std", "_nima", "_rel", "_mixed")


def editor_notes(scored: DataFrame, critic: str | None = None) -> DataFrame:
    """``note`` on the duration and ``approved``: no note, a score of 7.5, and the critic's agreement.

    ``critic`` names a boolean column with the outside verdict, if there is one.
    """
    total, low = F.col("total_duration"), F.col("target_duration")
    note = F.when(total < low, "too short").when(total > low * F.lit(1.25), "too long")
    ok = note.isNull() & (F.col("composite_score") >= APPROVAL_SCORE)
    if critic is not None:
        ok = ok & F.coalesce(F.col(critic), F.lit(True))
    return scored.withColumn("note", note).withColumn("approved", ok)


def best_draft(scored: DataFrame, keys: Sequence[str] = ("job_id",), max_iterations: int | None = None) -> DataFrame:
    """The iteration a job ends with: the best score so far, a later equal one wins.

    An empty storyboard never holds the place. ``max_iterations`` leaves later ones out, if given.
    """
    tried = scored if max_iterations is None else scored.filter(F.col("iteration") <= max_iterations)
    item = F.struct("iteration", "composite_score", "segments")
    ordered = F.sort_array(F.collect_list(item))
    start = F.struct(F.lit(0).alias("iteration"), F.lit(0.0).alias("composite_score"), F.lit(0).cast("long").alias("segments"))
    typed = F.transform(
        ordered,
        lambda d: F.struct(
            d.iteration.cast("int").alias("iteration"), d.composite_score.alias("composite_score"), d.segments.cast("long").alias("segments")
        ),
    )
    kept = F.aggregate(
        typed, start, lambda best, d: F.when((d.composite_score >= best.composite_score) | (best.segments == 0), d).otherwise(best)
    )
    return tried.groupBy(*keys).agg(kept.alias("_best"), F.max("iteration").alias("iterations")).select(
        *keys, F.col("_best.iteration").alias("best_iteration"), F.col("_best.composite_score").alias("best_composite_score"), "iterations"
    )


# --- described in the reference's documents only ------------------------------------------------


def segment_merge(hits: DataFrame, keys: Sequence[str] = ("job_id",), gap: float = 4.0, lead: float = 0.5, clip: float = 3.0) -> DataFrame:
    """Hits of one video closer than ``gap`` seconds become one clip that starts shortly before the first."""


    within = [*keys, "file_path"]
    slices = [F.floor(F.col("source_offset") / F.lit(3600.0))]
    video = hits.filter(F.col("file_type") == "video").select(*within, "source_offset").distinct()
    linked = value_before(video, within, ["source_offset"], slices, F.col("source_offset"), "_previous")
    opens = F.when(F.col("_previous").isNull() | (F.col("source_offset") - F.col("_previous") >= gap), 1).otherwise(0).cast("long")
    numbered = sums_before(linked.withColumn("_opens", opens), within, [F.asc("source_offset")], slices, {"_earlier": F.col("_opens")})
    island = numbered.withColumn("segment_no", F.col("_earlier") + F.col("_opens") - 1)
    return island.groupBy(*within, "segment_no").agg(
        F.greatest(F.lit(0.0), F.min("source_offset") - F.lit(lead)).alias("start_offset"),
        F.lit(clip).alias("duration"),
        F.count("*").alias("merged_hits"),
    )


def bucket_quota(points: DataFrame, queries: DataFrame, target: int, floor: float = 0.22, per_bucket: int = 50,
                 keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Hits per time bucket above the floor, with the seconds each bucket may fill.

    ``min(10, max(5, target // 15))`` buckets over the collection's time span, the last one closed. A query without
    any hit yields one row with ``zero_matches`` set.
    """


    count = min(10, max(5, int(target // 15)))
    span = points.agg(F.min("creation_timestamp").alias("low"), F.max("creation_timestamp").alias("high")).first()
    if span is None or span["low"] is None:
        found = queries.select(*keys)
        return found.select(*keys, F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("string").alias("point_id"),
                            F.lit(None).cast("double").alias("score"), F.lit(target / count).alias("quota"), F.lit(True).alias("zero_matches"))
    low, width = span["low"], (span["high"] - span["low"]) / count
    inner = F.lit(0)
    for i in range(1, count):
        inner = inner + (F.col("creation_timestamp") >= F.lit(low + i * width)).cast("int")
    timed = points.filter((F.col("creation_timestamp") >= F.lit(low)) & (F.col("creation_timestamp") <= F.lit(span["high"])))
    hits = search_many(
        timed.withColumn("bucket", inner), queries, per_bucket, query_keys=list(keys), score_threshold=floor,
        payload=["point_id", "bucket"], per="bucket",
    ).drop("rank")
    return queries.select(*keys).join(hits, list(keys), "left").withColumn("quota", F.lit(target / count)).withColumn(
        "zero_matches", F.col("point_id").isNull()
    )


