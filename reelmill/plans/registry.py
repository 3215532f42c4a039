"""Every operator as a named query over the media views; each runs over its whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import Media
from ..functions.columns import round_to
from ..functions.vectors import l2_normalize
from ..operators import catalog, evaluate, frames, links, quality, ranking, search, storyboard, timeline
from ..schemas import PRESETS, PROFILES
from ..sources import listing as listings
from ..streaming import jobs as job_stream
from ..streaming import telemetry as telemetry_stream
from .generate import generate_alternatives, generate_timelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str) -> Callable:
    def register(build: Callable[[Media], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Media.of(spark, folder))
        return build

    return register


HIT_COLUMNS = ("query_id", "rank", "point_id", "score")


# --- sources ------------------------------------------------------------------------------------


@query("mime_type")
def _(m: Media) -> DataFrame:
    return catalog.with_mime_type(m.listing).select("file_path", "mime_type")


@query("sniffed_type")
def _(m: Media) -> DataFrame:
    """Types from leading bytes: each document's text stands behind a header chosen by its number."""
    headers = F.array(
        F.unhex(F.lit("FFD8FFE000104A46494600")), F.unhex(F.lit("89504E470D0A1A0A0000000D")),
        F.unhex(F.lit("000000186674797068656963")), F.unhex(F.lit("00000018667479706D703432")), F.unhex(F.lit("")),
    )
    docs = m.table("documents").withColumn("file_path", F.concat(F.lit("/m/"), "doc_id", F.element_at(
        F.array(F.lit(".MP4"), F.lit(".jpg"), F.lit(".txt")), (F.col("doc_id") % 3).cast("int") + 1)))
    header = F.substring(F.concat(F.element_at(headers, (F.col("doc_id") % 5).cast("int") + 1), F.col("text").cast("binary")), 1, 12)
    return listings.sniff_type(docs.withColumn("header", header)).select("doc_id", "file_type")


@query("fast_hash")
def _(m: Media) -> DataFrame:
    docs = m.table("documents").withColumn("mtime", (F.lit(1700000000) + F.col("doc_id") * 61 + F.col("n_chars")) * 1000000)
    return catalog.with_fast_hash(docs, "n_chars", "mtime").select("doc_id", "file_hash")


@query("content_hash")
def _(m: Media) -> DataFrame:
    return catalog.with_content_hash(m.table("documents"), "text").select("doc_id", "content_hash")


@query("live_photo_pairs")
def _(m: Media) -> DataFrame:
    kinds = F.array(*[F.lit(s) for s in (".HEIC", ".mov", ".jpg", ".MOV", ".png", ".mp4", ".txt")])
    name = F.concat(F.lit("/m/"), F.floor(F.col("doc_id") / 3).cast("string"))
    named = m.table("documents").withColumn("file_path", F.concat(name, F.element_at(kinds, (F.col("doc_id") % 7).cast("int") + 1)))
    return listings.live_photo_pairs(named.select("file_path").distinct())


# --- catalogue ----------------------------------------------------------------------------------


@query("removed_files")
def _(m: Media) -> DataFrame:
    gone = catalog.removed_files(m.files, m.listing)
    return gone.select("id", "file_path", F.size("point_ids").alias("points"))


@query("removed_points")
def _(m: Media) -> DataFrame:
    return catalog.removed_files(m.files, m.listing).select("id", F.explode("point_ids").alias("point_id"))


@query("kept_files")
def _(m: Media) -> DataFrame:
    return catalog.kept_files(m.files, m.listing).select("id", "file_path", "status")


@query("cascade_timeline")
def _(m: Media) -> DataFrame:
    rows = m.table("events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("position"), (F.col("event_id") % 1500).alias("file_id")
    )
    return catalog.cascade_timeline(rows, catalog.kept_files(m.files, m.listing)).select("job_id", "position", "file_id")


@query("classify")
def _(m: Media) -> DataFrame:
    return catalog.classify(m.files, m.listing).select("file_path", "action", "donor_id")


@query("classify_forced")
def _(m: Media) -> DataFrame:
    return catalog.classify(m.files, m.listing, force=True).select("file_path", "action", "donor_id")


@query("content_donors")
def _(m: Media) -> DataFrame:
    return catalog.content_donors(m.files).select("content_hash", "donor_id")


@query("upsert_files")
def _(m: Media) -> DataFrame:
    changes = m.listing.select(
        "file_path", "file_hash", "file_size", "file_type", F.lit("SCANNED").alias("status"),
        F.when(F.col("file_size") % 2 == 0, F.col("content_hash")).alias("content_hash"),
        F.when(F.col("file_size") % 5 == 0, F.col("mtime")).alias("creation_timestamp"),
        F.lit(None).cast("long").alias("id"),
    )
    merged = catalog.upsert_files(m.files, changes, F.lit(200.0))
    return merged.select("id", "file_path", "file_hash", "content_hash", "file_size", "creation_timestamp", "status", "error_message",
                         "model_name", "scanned_at", "updated_at")


@query("apply_scan")
def _(m: Media) -> DataFrame:
    classified = catalog.classify(m.files, m.listing)
    after = catalog.apply_scan(m.files, classified, F.lit(200.0))
    return after.select("file_path", "file_hash", "status", F.array_join("point_ids", ",").alias("point_ids"), "model_name", "scanned_at", "updated_at")


@query("assign_ids")
def _(m: Media) -> DataFrame:
    new = m.listing.join(m.files.select("file_path"), "file_path", "left_anti")
    return catalog.assign_ids(new, 100000).select("file_path", "id")


@query("select_for_processing")
def _(m: Media) -> DataFrame:
    return catalog.select_for_processing(m.files).select("id", "status")


@query("by_status")
def _(m: Media) -> DataFrame:
    return catalog.by_status(m.files, "ERROR").select("id", "file_path", "error_message")


@query("lookup")
def _(m: Media) -> DataFrame:
    by_path = catalog.lookup(m.files, "/media/src1/1.png").select("id", "file_path", F.lit("path").alias("found_by"))
    return by_path.unionByName(catalog.lookup_by_id(m.files, 4).select("id", "file_path", F.lit("id").alias("found_by")))


@query("all_files")
def _(m: Media) -> DataFrame:
    return catalog.all_files(m.files).select("id", "file_path", "file_size", "status")


@query("mark_indexed")
def _(m: Media) -> DataFrame:
    points = m.table("events").select((F.col("user_id") * 2).alias("file_id"), F.concat(F.lit("e"), "event_type").alias("point_id"))
    marked = catalog.mark_indexed(m.files, points, "siglip2", "2.0", F.lit(300.0))
    return marked.select("id", "status", "model_version", F.array_join("point_ids", ",").alias("point_ids"), "embedded_at", "updated_at")


@query("link_points")
def _(m: Media) -> DataFrame:
    points = m.table("events").select((F.col("user_id") * 2).alias("file_id"), F.concat(F.lit("e"), "event_type").alias("point_id"))
    return links.link_points(links.links_of(m.files), points)


@query("mark_linked")
def _(m: Media) -> DataFrame:
    points = m.table("events").select((F.col("user_id") * 2).alias("file_id"), F.concat(F.lit("e"), "event_type").alias("point_id"))
    return links.mark_linked(m.files, points, "siglip2", "2.0", F.lit(300.0)).select("id", "status", "model_version", "embedded_at", "updated_at")


@query("removed_links")
def _(m: Media) -> DataFrame:
    return links.removed_points(m.files, links.links_of(m.files), m.listing)


@query("linked_donors")
def _(m: Media) -> DataFrame:
    return links.linked_donors(m.files, links.links_of(m.files))


@query("donate_links")
def _(m: Media) -> DataFrame:
    reused = catalog.classify(m.files, m.listing).filter("action = 'reuse' and known_id is not null").select(F.col("known_id").alias("id"), "donor_id")
    return links.donate_links(links.links_of(m.files), reused)


@query("mark_errors")
def _(m: Media) -> DataFrame:
    errors = m.files.filter("id % 13 = 0").select("id", F.concat(F.lit("cannot decode "), "file_path").alias("message"))
    return catalog.mark_errors(m.files, errors, F.lit(300.0)).select("id", "status", "error_message", "updated_at")


@query("update_status")
def _(m: Media) -> DataFrame:
    changes = m.files.filter("status = 'ERROR'").select("id", F.lit("PENDING").alias("status"))
    return catalog.update_status(m.files, changes, F.lit(300.0)).select("id", "status", "error_message", "updated_at")


@query("reset_embeddings")
def _(m: Media) -> DataFrame:
    reset = catalog.reset_embeddings(m.files, F.lit(300.0))
    return reset.select("id", "status", "model_name", F.size(F.coalesce("point_ids", F.array())).alias("points"), "embedded_at", "creation_timestamp", "updated_at")


@query("stats")
def _(m: Media) -> DataFrame:
    return catalog.stats(m.files)


@query("transition_audit")
def _(m: Media) -> DataFrame:
    states = F.create_map(*[F.lit(x) for pair in {"signup": "PENDING", "view": "SCANNED", "click": "EMBEDDED", "purchase": "INDEXED", "error": "ERROR"}.items() for x in pair])
    log = m.table("events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").cast("double").alias("changed_at"), F.element_at(states, F.col("event_type")).alias("status")
    )
    return catalog.transition_audit(log).select("file_id", "changed_at", "from_status", "status")


@query("check_unique")
def _(m: Media) -> DataFrame:
    return catalog.check_unique(m.files, ["content_hash"])


@query("set_meta")
def _(m: Media) -> DataFrame:
    events = m.table("events").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
                                      F.col("event_id").cast("double").alias("updated_at"))
    old, new = events.filter("updated_at % 10 = 0"), events.filter("updated_at % 10 <> 0")
    start = old.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"), F.max("updated_at").alias("updated_at"))
    return catalog.set_meta(start, new)


@query("scan_summary")
def _(m: Media) -> DataFrame:
    return catalog.scan_summary(catalog.classify(m.files, m.listing), m.files)


@query("capture_time")
def _(m: Media) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    tags = m.table("events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy:MM:dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, "invalid_date").alias("datetime_original"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("datetime_digitized"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" "))).otherwise("").alias("datetime"),
        F.lit(5.0).alias("filesystem_time"),
    )
    return catalog.capture_time(tags).select("event_id", "creation_timestamp", "timestamp_source")


@query("workspace_info")
def _(m: Media) -> DataFrame:
    files = m.files.withColumn("workspace_id", F.col("id") % 3)
    points = m.points.withColumn("workspace_id", F.col("file_id") % 4)
    return catalog.workspace_info(files, points)


# --- frames and quality -------------------------------------------------------------------------


@query("sample_frames")
def _(m: Media) -> DataFrame:
    return frames.sample_frames(m.frame_index).select("file_id", "idx", "frame_no", "source_offset")


@query("preview_frames")
def _(m: Media) -> DataFrame:
    clips = m.frame_index.select("file_id").distinct().select(
        F.col("file_id").alias("clip_id"), "file_id", ((F.col("file_id") % 3) / F.lit(2.0)).alias("start_offset"),
        ((F.col("file_id") % 5) * F.lit(0.7)).alias("duration"),
    )
    return frames.preview_frames(clips, m.frame_index).select("clip_id", "frame_no", "idx")


def _feature_frames(m: Media) -> DataFrame:
    return m.frame_index.select("file_id", F.col("idx").alias("frame_index"), "src_fps", F.array("value").alias("features"))


@query("cut_candidates")
def _(m: Media) -> DataFrame:
    found = frames.cut_candidates(_feature_frames(m), 3.0)
    return found.select("file_id", "frame_index", round_to(F.col("change"), 6).alias("change"), round_to(F.col("local"), 6).alias("local"))


@query("detect_scenes")
def _(m: Media) -> DataFrame:
    return frames.detect_scenes(_feature_frames(m), 2.0, min_change=0.1)


@query("tag_scene")
def _(m: Media) -> DataFrame:
    return m.tagged.filter("file_type = 'video'").select("vec_id", "scene_id", "scene_start", "scene_end")


@query("scene_representatives")
def _(m: Media) -> DataFrame:
    scenes = frames.scene_representatives(m.tagged)
    score = {k: F.try_element_at("scores", F.lit(k)) for k in ("nima_aesthetic", "sharpness", "technical_composite")}
    return scenes.select("point_id", "file_id", "scene_id", "frame_index", "source_offset", "scene_start", "scene_end", "scene_frame_count",
                         *[v.alias(k) for k, v in score.items()])


@query("scene_vectors")
def _(m: Media) -> DataFrame:
    scenes = frames.scene_representatives(m.tagged)
    return scenes.select("point_id", F.posexplode("vector").alias("i", "x")).withColumn("x", round_to(F.col("x").cast("double"), 5))


@query("l2_normalize")
def _(m: Media) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 50 != 0, x.cast("double") * (F.col("label") + 1)).otherwise(F.lit(0.0)))
    unit = m.table("embeddings").select("vec_id", l2_normalize(scaled).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("i", "x")).withColumn("x", round_to(F.col("x"), 8))


def _measures(df: DataFrame) -> DataFrame:
    return df.select("frame_id", *[round_to(F.col(c), 9).alias(c) for c in ("sharpness", "colorfulness", "contrast")])


@query("measure_frames")
def _(m: Media) -> DataFrame:
    return _measures(quality.measure_frames(m.images))


@query("measure_pixels")
def _(m: Media) -> DataFrame:
    return _measures(quality.measure_pixels(m.pixels))


@query("technical_composite")
def _(m: Media) -> DataFrame:
    return quality.technical_composite(quality.measure_frames(m.images)).select("frame_id", "sharpness", "colorfulness", "contrast", "technical_composite")


@query("aesthetic_from_distribution")
def _(m: Media) -> DataFrame:
    """Softmax over the first ten components; every seventh frame has no distribution."""
    first = F.slice("embedding", 1, 10)
    powers = F.transform(first, lambda x: F.exp(x.cast("double") * 8))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    probs = F.when(F.col("vec_id") % 7 != 0, F.transform(powers, lambda v: v / total))
    rows = m.table("embeddings").select("vec_id", probs.alias("probs"), F.lit(0.4321).alias("technical_composite"), (F.col("vec_id") % 50 == 1).alias("lost"))
    return quality.aesthetic_from_distribution(rows, batch_missing="lost").select("vec_id", "nima_aesthetic")


@query("epic_composite")
def _(m: Media) -> DataFrame:
    return quality.epic_composite(m.frames).select("vec_id", "epic_composite")


@query("hash_embed_text")
def _(m: Media) -> DataFrame:
    embedded = quality.hash_embed_text(m.table("documents"), "text")
    return embedded.select("doc_id", F.size("vector").alias("dimension"), round_to(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("prompt_text")
def _(m: Media) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 4 == 0, "  a photo of ").when(F.col("doc_id") % 4 == 1, "a video of ").otherwise(" "), "text")
    return m.table("documents").select("doc_id", quality.prompt_text(text).alias("prompt"))


@query("embed_table")
def _(m: Media) -> DataFrame:
    """Each text's unit vector against two fixed directions."""
    made = quality.embed_table(m.table("documents").select("doc_id", "text"), "text", quality.word_count_model(64))
    along = lambda weight: round_to(F.aggregate(F.zip_with("vector", F.sequence(F.lit(0), F.lit(63)), weight), F.lit(0.0), lambda s, x: s + x), 3)
    return made.select("doc_id", F.col("embed_error").isNull().alias("embedded"), along(lambda x, i: x.cast("double") * i).alias("by_slot"),
                       along(lambda x, i: F.when(i % 2 == 0, x.cast("double")).otherwise(0.0)).alias("even_slots"))


@query("build_points")
def _(m: Media) -> DataFrame:
    kept = ("point_id", "file_path", "granularity", "frame_index", "source_offset", "scene_id", "is_scene_representative", "scene_frame_count")
    return m.points.select(*kept, *[F.try_element_at("scores", F.lit(k)).alias(k) for k in ("nima_aesthetic", "sharpness", "technical_composite")])


# --- search -------------------------------------------------------------------------------------


@query("search_topk")
def _(m: Media) -> DataFrame:
    one = m.label_queries.filter("query_id = 3")
    return search.search_many(m.points, one, 10).select(*HIT_COLUMNS)


@query("search_threshold")
def _(m: Media) -> DataFrame:
    return search.search_many(m.points, m.label_queries, 25, score_threshold=0.15).select(*HIT_COLUMNS)


@query("search_filtered")
def _(m: Media) -> DataFrame:
    found = search.filter_points(m.points, start_timestamp=1704200000, end_timestamp=1704900000, file_type="video", granularity="frame", scene_id=1)
    return search.search_many(found, m.label_queries, 5).select(*HIT_COLUMNS)


@query("filter_points")
def _(m: Media) -> DataFrame:
    found = search.filter_points(m.points, start_timestamp=1704200000, granularity="scene", is_scene_representative=True)
    return found.select("point_id", "file_path", "creation_timestamp")


@query("exclude_paths")
def _(m: Media) -> DataFrame:
    points = m.points.withColumn("file_path", F.when(F.col("file_id") % 5 != 0, F.col("file_path")))
    paths = m.frames.filter("label = 4").select("file_path")
    return search.exclude_paths(points, paths).select("point_id", "file_path")


@query("search_many")
def _(m: Media) -> DataFrame:
    queries = m.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.search_many(m.points, queries, 10, payload=["point_id"]).select(*HIT_COLUMNS)


@query("search_many_blocks")
def _(m: Media) -> DataFrame:
    """The same search with queries in joined blocks instead of one broadcast."""
    queries = m.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.search_many(m.points, queries, 10, payload=["point_id"], broadcast_rows=256).select(*HIT_COLUMNS)


@query("similar_to")
def _(m: Media) -> DataFrame:
    points = m.points.select("point_id", "granularity", "vector")
    return search.similar_many(points, points.filter("granularity = 'scene'"), 5, granularity="frame").select("source_id", "rank", "point_id", "score")


@query("get_point")
def _(m: Media) -> DataFrame:
    key = hashlib.md5(b"/media/v16.mp4|scene|4000|1").hexdigest()
    return search.get_point(m.points, key).select("point_id", "file_path", "granularity", "score", round_to(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("vector_sum"))


@query("points_by_file")
def _(m: Media) -> DataFrame:
    return search.points_by_file(m.points, "/media/v16.mp4").select("point_id", "granularity", "source_offset", "frame_index", "score")


@query("scene_list")
def _(m: Media) -> DataFrame:
    return search.scene_list(m.points).select("file_path", "scene_id", "start_sec", "end_sec", "duration_sec", "frame_count")


@query("scene_breakdown")
def _(m: Media) -> DataFrame:
    return search.scene_breakdown(m.points)


@query("scene_list")
def _(m: Media) -> DataFrame:
    return search.scene_list(m.points)


@query("frame_list")
def _(m: Media) -> DataFrame:
    return search.frame_list(m.points)


@query("upsert_points")
def _(m: Media) -> DataFrame:
    changed = m.points.filter("file_id % 3 = 0").withColumn("label_note", F.lit("new"))
    new = changed.withColumn("file_type", F.concat("file_type", F.lit("-new"))).drop("label_note")
    return search.upsert_points(m.points, new).select("point_id", "file_path", "file_type")


@query("delete_points")
def _(m: Media) -> DataFrame:
    return search.delete_points(m.points, m.points.filter("scene_id = 0 and granularity = 'frame'")).select("point_id", "granularity")


@query("delete_by_path")
def _(m: Media) -> DataFrame:
    return search.delete_by_path(m.points, "/media/v16.mp4").select("point_id", "file_path")


@query("pair_similarity")
def _(m: Media) -> DataFrame:
    e = m.table("embeddings")
    left = e.select("vec_id", F.col("embedding").alias("left_vector"))
    right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("right_vector"))
    return search.pair_similarity(left.join(right, "vec_id")).select("vec_id", "similarity")


@query("similarity_band")
def _(m: Media) -> DataFrame:
    e = m.table("embeddings").select("vec_id", round_to(F.element_at("embedding", 1).cast("double"), 4).alias("similarity"))
    return search.similarity_band(e)


@query("reference_vector")
def _(m: Media) -> DataFrame:
    chosen = m.frames.select("point_id", "label")
    vectors = search.reference_vector(m.points, chosen, ["label"])
    return vectors.select("label", F.posexplode("reference_vector").alias("i", "x")).withColumn("x", round_to(F.col("x"), 8))


@query("near_duplicates")
def _(m: Media) -> DataFrame:
    """Frames of one label whose cosine distance is below 0.75 (the test vectors are far apart)."""
    items = m.frames.select("label", "point_id", "vector", F.col("contrast").alias("score"))
    return search.near_duplicates(items, ["label"], 0.75).select("point_id", "is_duplicate")


@query("near_duplicate_hashes")
def _(m: Media) -> DataFrame:
    """64-bit hashes with planted near copies: every frame of a group shares a pattern with a few flipped bits."""
    base = F.conv(F.substring(F.md5((F.floor(F.col("vec_id") / 4)).cast("string")), 1, 15), 16, 10).cast("long")
    flips = F.expr("shiftleft(1L, cast(vec_id % 3 as int)) + shiftleft(1L, cast(vec_id % 41 as int))")
    items = m.frames.select("file_type", "point_id", base.bitwiseXOR(flips).alias("phash"), F.col("contrast").alias("score"))
    return search.near_duplicate_hashes(items, ["file_type"]).select("point_id", "is_duplicate")


# --- ranking ------------------------------------------------------------------------------------


@query("retrieve")
def _(m: Media) -> DataFrame:
    return m.hits.select("job_id", "query_idx", F.col("pass"), "rank", "point_id", "score", "seq")


@query("merge_candidates")
def _(m: Media) -> DataFrame:
    return m.merged.select("job_id", "candidate_key", "point_id", "score", "seq")


@query("normalize_cosine")
def _(m: Media) -> DataFrame:
    return m.merged.select("job_id", "candidate_key", round_to(ranking.normalize_cosine(F.col("score")), 6).alias("cos_norm"))


def _weight_cases(m: Media) -> DataFrame:
    number = F.col("label")
    names = F.array(*[F.lit(p) for p in PROFILES])
    signals = (
        F.when(number % 4 == 0, F.array(F.lit("nima"), F.lit("epic_sim")))
        .when(number % 4 == 1, F.array(F.lit("sharpness"), F.lit("contrast"), F.lit("unknown")))
        .when(number % 4 == 2, F.array().cast("array<string>"))
    )
    custom = F.when(number == 7, F.create_map(F.lit("cosine"), F.lit(3.0), F.lit("mystery"), F.lit(1.0), F.lit("nima"), F.lit(0.0)))
    return m.table("embeddings").select("label").distinct().select(
        "label", F.element_at(names, (number % 3).cast("int") + 1).alias("profile"), signals.alias("signals"), custom.alias("custom"),
        (number % 2 == 0).alias("has_reference"),
    )


@query("resolve_weights")
def _(m: Media) -> DataFrame:
    weights = ranking.resolve_weights(F.col("profile"), F.col("signals"), F.col("custom"), F.col("has_reference"))
    return _weight_cases(m).select("label", F.explode(weights).alias("signal", "w")).select("label", "signal", round_to(F.col("w"), 8).alias("weight"))


@query("composite_rank")
def _(m: Media) -> DataFrame:
    return m.composed.select("job_id", "candidate_key", "composite_rank")


@query("epic_similarity")
def _(m: Media) -> DataFrame:
    chosen = m.frames.filter("label < 3").select("point_id", F.concat(F.lit("job"), F.col("label").cast("string")).alias("job_id"))
    references = search.reference_vector(m.points, chosen, ["job_id"])
    weights = ranking.resolve_weights(F.lit("cinematic"), F.array(F.lit("cosine"), F.lit("epic_sim")), None, F.lit(True))
    cands = ranking.epic_similarity(m.merged, m.points, references)
    return ranking.composite_rank(cands, weights, F.col("epic_sim")).select("job_id", "candidate_key", "composite_rank", round_to(F.col("epic_sim"), 6).alias("epic_sim"))


@query("order_candidates")
def _(m: Media) -> DataFrame:
    """Composite of some candidates set to 0, so that they order by their raw score."""
    zeroed = m.composed.withColumn("composite_rank", F.when(F.col("seq") % 5 != 0, F.col("composite_rank")).otherwise(F.lit(0.0)))
    window = Window.partitionBy("job_id").orderBy(*ranking.candidate_order())
    return zeroed.withColumn("place", F.row_number().over(window)).select("job_id", "candidate_key", "place")


@query("min_score_filter")
def _(m: Media) -> DataFrame:
    """Scores of one job pushed below the floor: it keeps its first ten."""
    low = m.composed.withColumn("score", F.when(F.col("job_id") == "job1", F.col("score") * 0.01).otherwise(F.col("score")))
    return ranking.min_score_filter(low).select("job_id", "candidate_key", "composite_rank")


@query("cap_per_file")
def _(m: Media) -> DataFrame:
    return ranking.cap_per_file(m.composed, clips=1).select("job_id", "file_path", "candidate_key")


@query("rank_candidates")
def _(m: Media) -> DataFrame:
    return m.ranked.select("job_id", "place", "candidate_key", "composite_rank", "score")


@query("rerank")
def _(m: Media) -> DataFrame:
    ranked = ranking.rerank(m.merged, "clarity", "sharpness_desc")
    return ranked.select("job_id", "candidate_key", "composite_rank", "cos_norm", "sharp_val", "tech_val", "sort_value")


@query("filter_by_name")
def _(m: Media) -> DataFrame:
    return ranking.filter_by_name(m.merged, " V1 ").select("job_id", "candidate_key")


@query("compare_strategies")
def _(m: Media) -> DataFrame:
    return ranking.compare_strategies(m.merged).select("job_id", "rank", *PRESETS)


@query("diversity_penalty")
def _(m: Media) -> DataFrame:
    """With a cosine of 0.3 as "similar", because the test vectors are far apart."""
    cands = m.ranked.join(m.points.select("point_id", "vector"), "point_id")
    penalised = ranking.diversity_penalty(cands, threshold=0.3)
    return penalised.select("job_id", "candidate_key", "similar_before", round_to(F.col("adjusted_rank"), 8).alias("adjusted_rank"))


@query("retrieval_report")
def _(m: Media) -> DataFrame:
    return ranking.retrieval_report(m.hits.filter("query_idx % 4 <> 1"), queries=m.job_queries)


@query("retrieval_summary")
def _(m: Media) -> DataFrame:
    found = ranking.retrieval_summary(m.composed.filter("job_id <> 'job2'"), m.ranked.filter("job_id <> 'job2'"), m.jobs, ranking.resolve_weights(F.lit("journey")))
    return found.select("job_id", "total_candidates", "filtered_out_low_score", "min_score_threshold", F.explode("scoring_weights").alias("signal", "weight"))


@query("filter_report")
def _(m: Media) -> DataFrame:
    return ranking.filter_report(m.composed)


# --- storyboards --------------------------------------------------------------------------------

SEGMENT_COLUMNS = ("job_id", "file_path", "duration", "start_offset", "end_offset", "segment_type")


@query("time_buckets")
def _(m: Media) -> DataFrame:
    return storyboard.time_buckets(m.ranked).select("job_id", "candidate_key", "bucket", "n_buckets")


def _bucketed(m: Media) -> DataFrame:
    return storyboard.time_buckets(m.ranked.join(m.jobs.select("job_id", "target_duration"), "job_id"))


@query("bucket_best")
def _(m: Media) -> DataFrame:
    return storyboard.bucket_best(_bucketed(m)).select("job_id", "bucket", *SEGMENT_COLUMNS[1:])


@query("fill_to_target")
def _(m: Media) -> DataFrame:
    return storyboard.fill_to_target(_bucketed(m)).select(*SEGMENT_COLUMNS)


@query("segment_duration")
def _(m: Media) -> DataFrame:
    return storyboard.with_segment(m.merged, storyboard.segment_seconds(False)).select("candidate_key", *SEGMENT_COLUMNS)


@query("curate")
def _(m: Media) -> DataFrame:
    return storyboard.curate(m.ranked, m.jobs).select("position", *SEGMENT_COLUMNS)


@query("one_time_per_file")
def _(m: Media) -> DataFrame:
    return storyboard.check_one_time_per_file(_two_times(m))


def _two_times(m: Media) -> DataFrame:
    """Candidates of which some carry another capture time than the rest of their file."""
    return m.composed.withColumn("creation_timestamp", F.when(F.col("seq") % 3 == 0, F.coalesce("creation_timestamp", F.lit(0.0)) + 5).otherwise(F.col("creation_timestamp")))


@query("one_time_enforced")
def _(m: Media) -> DataFrame:
    return storyboard.one_time_per_file(_two_times(m)).select("job_id", "candidate_key", "creation_timestamp")


@query("draft_dedupe")
def _(m: Media) -> DataFrame:
    return m.deduped.select("job_id", "seq", "file_path", "file_id", "similarity_score", "composite_rank", "creation_timestamp",
                              F.size("scores").alias("score_count"))


@query("autofill")
def _(m: Media) -> DataFrame:
    return m.filled.select("job_id", "seq", *SEGMENT_COLUMNS[1:])


@query("tail_trim")
def _(m: Media) -> DataFrame:
    return storyboard.tail_trim(m.deduped, m.jobs).select("job_id", "seq", "file_path", "duration")


@query("segment_limits")
def _(m: Media) -> DataFrame:
    factor = F.element_at(F.array(F.lit(0.8), F.lit(1.2), F.lit(1.0)), (F.col("event_id") % 3).cast("int") + 1)
    fewest, most = storyboard.segment_limits(F.col("event_id") % 296 + 5, factor)
    return m.table("events").select("event_id", fewest.alias("min_segments"), most.alias("max_segments"))


@query("chronological")
def _(m: Media) -> DataFrame:
    return storyboard.chronological(m.filled).select("job_id", "position", "file_path")


def _iterations(m: Media) -> DataFrame:
    tries = F.array(*[F.lit(i) for i in (1, 2, 3)])
    return m.filled.withColumn("iteration", F.explode(tries)).filter("seq % (iteration + 1) <> 0")


SCORE_COLUMNS = ("total_duration", "segments", "duration_score", "pacing_score", "visual_score", "relevance_score", "diversity_score", "composite_score")


@query("score_storyboard")
def _(m: Media) -> DataFrame:
    scored = storyboard.score_storyboard(_iterations(m), m.jobs, per=["iteration"])
    return scored.select("job_id", "iteration", "segments", *[round_to(F.col(c), 6).alias(c) for c in SCORE_COLUMNS if c != "segments"])


@query("editor_notes")
def _(m: Media) -> DataFrame:
    scored = storyboard.score_storyboard(_iterations(m), m.jobs, per=["iteration"])
    return storyboard.editor_notes(scored.withColumn("critic", F.col("iteration") != 2), "critic").select("job_id", "iteration", "note", "approved")


@query("best_draft")
def _(m: Media) -> DataFrame:
    return storyboard.best_draft(storyboard.score_storyboard(_iterations(m), m.jobs, per=["iteration"]))


@query("alternatives")
def _(m: Media) -> DataFrame:
    return generate_alternatives(m.points, m.job_queries, m.jobs).select("profile", "position", *SEGMENT_COLUMNS)


@query("segment_merge")
def _(m: Media) -> DataFrame:
    return storyboard.segment_merge(m.hits)


@query("bucket_quota")
def _(m: Media) -> DataFrame:
    return storyboard.bucket_quota(m.points, m.label_queries, 90).select("query_id", "bucket", "point_id", "score", "quota", "zero_matches")


# --- timelines ----------------------------------------------------------------------------------


@query("compile_timeline")
def _(m: Media) -> DataFrame:
    return m.compiled


@query("load_timeline")
def _(m: Media) -> DataFrame:
    return timeline.load_timeline(m.compiled, "job1").select("job_id", "position", "file_id", "duration")


@query("timelines_with_files")
def _(m: Media) -> DataFrame:
    return timeline.timelines_with_files(m.compiled, m.media_files).select("job_id", "position", "file_name", "file_type", "segment_type", "duration", "total_duration")


@query("generate_timelines")
def _(m: Media) -> DataFrame:
    return generate_timelines(m.points, m.job_queries, m.jobs).select("position", *SEGMENT_COLUMNS)


def _long_segments(m: Media) -> DataFrame:
    return m.table("events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("position"), F.concat(F.lit("/m/"), "event_id", F.lit(".jpg")).alias("file_path"),
        F.when(F.col("event_type") == "view", "video_clip").otherwise("image").alias("segment_type"), (F.col("value") / 20).alias("duration"),
    )


@query("edit_list")
def _(m: Media) -> DataFrame:
    plan = timeline.edit_list(_long_segments(m))
    return plan.select("job_id", "position", round_to(F.col("clip_seconds"), 5).alias("clip_seconds"), round_to(F.col("fade_out"), 5).alias("fade_out"),
                       round_to(F.col("starts_at"), 3).alias("starts_at"), round_to(F.col("total_seconds"), 3).alias("total_seconds"))


@query("dominant_resolution")
def _(m: Media) -> DataFrame:
    sizes = m.table("events").select(
        F.concat(F.lit("/m/"), "event_id", F.lit(".jpg")).alias("file_path"), (F.col("event_id") % 4 * 1300).alias("width"), (F.col("value") * 10).cast("int").alias("height")
    )
    return timeline.dominant_resolution(_long_segments(m), sizes)


@query("inventory")
def _(m: Media) -> DataFrame:
    rows = m.compiled.withColumn("start_offset", F.col("start_offset") + F.col("position") % 5 * F.lit(0.7))
    found = timeline.inventory(rows, m.media_files, m.points)
    return found.select("job_id", "position", "segment_index", "file_name", "media_type", "effective_seconds", "file_size_mb", "motion", "nearest_point_id",
                        F.try_element_at("quality_scores", F.lit("contrast")).alias("contrast"))


@query("chronology_audit")
def _(m: Media) -> DataFrame:
    return timeline.chronology_audit(m.compiled, m.media_files)


@query("duration_audit")
def _(m: Media) -> DataFrame:
    return timeline.duration_audit(m.compiled, m.jobs)


@query("motion_plan")
def _(m: Media) -> DataFrame:
    shots = m.table("events").select(
        F.col("event_id").alias("position"), F.when(F.col("event_id") % 6 != 0, F.col("user_id") + 50).alias("width"), F.lit(100).alias("height"),
        (F.col("value") % 1.0).alias("subject_x"),
    )
    return timeline.motion_plan(shots).select("position", "motion")


# --- evaluation ---------------------------------------------------------------------------------


def _prompts(m: Media) -> tuple[DataFrame, DataFrame]:
    """Each vector as an image; its prompt is the vector shifted by one place, plus a share of its label's mean."""
    images = m.table("embeddings").select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("vector"), "label")
    mixed = F.transform("vector", lambda x, i: x.cast("double") * 0.3 + F.element_at("vector", (i + 1) % 64 + 1).cast("double"))
    return images.select("pair_id", "vector"), images.select("pair_id", mixed.alias("vector"))


@query("retrieval_ranks")
def _(m: Media) -> DataFrame:
    return evaluate.retrieval_ranks(*_prompts(m))


@query("retrieval_eval")
def _(m: Media) -> DataFrame:
    found = evaluate.retrieval_eval(*_prompts(m))
    return found.select("pairs", round_to(F.col("top1_accuracy"), 6).alias("top1_accuracy"), round_to(F.col("top3_accuracy"), 6).alias("top3_accuracy"), round_to(F.col("mean_margin"), 6).alias("mean_margin"))


@query("embedding_drift")
def _(m: Media) -> DataFrame:
    """The vectors against a copy with components cut to two decimals."""
    e = m.table("embeddings")
    cut = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 0.5) / 100).alias("embedding"))
    drift = evaluate.embedding_drift(e, cut, "vec_id", "embedding")
    return drift.select("vec_id", round_to(F.col("cosine"), 8).alias("cosine"), round_to(F.col("mse"), 10).alias("mse"), round_to(F.col("retention_pct"), 6).alias("retention_pct"))


@query("drift_summary")
def _(m: Media) -> DataFrame:
    e = m.table("embeddings")
    cut = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 0.5) / 100).alias("embedding"))
    total = evaluate.drift_summary(evaluate.embedding_drift(e, cut, "vec_id", "embedding"))
    return total.select("vectors", round_to(F.col("mean_cosine"), 8).alias("mean_cosine"), round_to(F.col("min_cosine"), 8).alias("min_cosine"), round_to(F.col("mean_mse"), 10).alias("mean_mse"))


@query("stage_latency")
def _(m: Media) -> DataFrame:
    step = F.struct(F.upper("event_type").alias("node"), F.col("event_type").alias("stage"), F.col("value").alias("latency_seconds"), F.col("props").alias("summary"))
    second = F.struct(F.lit("EDITOR").alias("node"), F.lit("editing").alias("stage"), (F.col("value") / 2).alias("latency_seconds"), F.col("event_type").alias("summary"))
    log = m.table("events").select(F.col("event_id").cast("string").alias("job_id"), F.array(step, second, step).alias("steps"))
    found = evaluate.stage_latency(log)
    return found.select("job_id", "node", "stage", "runs", round_to(F.col("total_seconds"), 4).alias("total_seconds"), round_to(F.col("slowest_seconds"), 4).alias("slowest_seconds"), "last_summary")


# --- streams in their batch form ----------------------------------------------------------------


@query("progress")
def _(m: Media) -> DataFrame:
    return job_stream.progress(m.job_events)


@query("latest_job_state")
def _(m: Media) -> DataFrame:
    return job_stream.latest_job_state(m.job_events, now=1706659200.0).select("job_id", "status", "stage", "progress_pct", "event_no", "events", "needs_check")


@query("telemetry_rollup")
def _(m: Media) -> DataFrame:
    found = telemetry_stream.telemetry_rollup(m.telemetry, "1 hour")
    means = [round_to(F.col(f"avg_{m}"), 6).alias(f"avg_{m}") for m in telemetry_stream.MEASURES]
    highest = [f"max_{m}" for m in telemetry_stream.MEASURES]
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "samples", *means, *highest)


@query("telemetry_runs")
def _(m: Media) -> DataFrame:
    return telemetry_stream.run_rollup(m.telemetry)

