"""Vector collection: filters, exact cosine top-k, similar points, maintenance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from ..functions.columns import clamp, millis, round_to
from ..functions.vectors import dot, l2_normalize
from .ordering import first_row, position_of, top_n
from .vector_blocks import apply_blocks, better_neighbour_counts, top_k_kernel


def point_key(path: Column, granularity: Column, offset: Column, scene_id: Column) -> Column:
    """A repeatable point id, so that writing the same frame twice gives one point."""
    scene = F.coalesce(scene_id.cast("string"), F.lit("-"))
    return F.md5(F.concat_ws("|", path, granularity, millis(offset).cast("string"), scene))


# --- filters ------------------------------------------------------------------------------------


def filter_points(
    points: DataFrame,
    start_timestamp: float | None = None,
    end_timestamp: float | None = None,
    file_type: str | None = None,
    file_path: str | None = None,
    granularity: str | None = None,
    scene_id: int | None = None,
    is_scene_representative: bool | None = None,
) -> DataFrame:
    """All given conditions must hold; both time ends are inclusive; a missing field never matches.

    Plain predicates placed before scoring, so Parquet statistics and partitions can prune the scan.
    """
    if start_timestamp is not None:
        points = points.filter(F.col("creation_timestamp") >= float(start_timestamp))
    if end_timestamp is not None:
        points = points.filter(F.col("creation_timestamp") <= float(end_timestamp))
    equal = {
        "file_type": file_type,
        "file_path": file_path,
        "granularity": granularity,
        "scene_id": scene_id,
        "is_scene_representative": is_scene_representative,
    }
    for name, value in equal.items():
        if value is not None:
            points = points.filter(F.col(name) == F.lit(value))
    return points


def exclude_paths(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Drop points on the given paths; a point without a path stays."""
    return points.join(paths.select("file_path").distinct(), "file_path", "left_anti")


# --- top-k --------------------------------------------------------------------------------------


def search_many(
    points: DataFrame,
    queries: DataFrame,
    k: int = 10,
    query_keys: Sequence[str] = ("query_id",),
    query_vector: str = "query_vector",
    score_threshold: float | None = None,
    payload: Sequence[str] | None = None,
    per: str | None = None,
    **blocks: int,
) -> DataFrame:
    """Exact cosine top-``k`` of every query: score descending, then point id; ``rank`` starts at 1.

    With ``per`` (a point column) each query gets ``k`` hits for every value of it.

    Each task keeps its own running top-k, so the shuffle carries about ``k`` rows per query and task.
    """
    payload = list(payload or [c for c in points.columns if c != "vector"])
    if "point_id" not in payload:
        payload = ["point_id", *payload]
    fields = [T.StructField(f.name, f.dataType) for f in queries.select(*query_keys).schema]
    fields += [T.StructField(f.name, f.dataType) for f in points.select(*payload).schema]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    kernel = top_k_kernel(k, "point_id", payload, list(query_keys), out, score_threshold, per)
    hits = apply_blocks(
        points.select(*payload, "vector"), queries.select(*query_keys, query_vector), "vector", query_vector, out, kernel, **blocks
    )
    return top_n(hits, [*query_keys, *([per] if per else [])], [F.desc("score"), F.asc("point_id")], k)


def search(points: DataFrame, query: Sequence[float], k: int = 10, score_threshold: float | None = None,
           must_not: DataFrame | None = None, **filters) -> DataFrame:
    """Top-``k`` of one query vector after the filters of :func:`filter_points`."""
    spark = points.sparkSession
    queries = spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
    found = filter_points(points, **filters)
    if must_not is not None:
        found = exclude_paths(found, must_not)
    return search_many(found, queries, k, score_threshold=score_threshold).drop("query_id")


def similar_many(points: DataFrame, sources: DataFrame, k: int = 12, granularity: str | None = None) -> DataFrame:
    """Nearest neighbours of stored points (``sources.point_id``), the point itself left out."""
    wanted = sources.select("point_id").distinct()
    queries = points.join(wanted, "point_id", "left_semi").select(
        F.col("point_id").alias("source_id"), F.col("vector").alias("query_vector")
    )
    found = filter_points(points, granularity=granularity)
    hits = search_many(found, queries, k + 1, query_keys=["source_id"]).drop("rank")
    others = hits.filter(F.col("point_id") != F.col("source_id"))
    return top_n(others, ["source_id"], [F.desc("score"), F.asc("point_id")], k)


def similar_to(points: DataFrame, point_id: str, k: int = 12, granularity: str | None = None) -> DataFrame:
    source = points.filter(F.col("point_id") == point_id).select("point_id")
    if source.isEmpty():
        raise ValueError(f"Point {point_id} not found")
    return similar_many(points, source, k, granularity).drop("source_id")


# --- point access -------------------------------------------------------------------------------


def with_payload_defaults(points: DataFrame) -> DataFrame:
    """Missing payload fields read as their defaults."""
    defaults = {
        "file_path": F.lit(""),
        "file_type": F.lit("image"),
        "frame_index": F.lit(0),
        "source_offset": F.lit(0.0),
        "granularity": F.lit("frame"),
        "is_scene_representative": F.lit(False),
        "scores": F.create_map().cast("map<string,double>"),
    }
    return points.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in points.columns})


def get_point(points: DataFrame, point_id: str) -> DataFrame:
    return with_payload_defaults(points.filter(F.col("point_id") == point_id)).withColumn("score", F.lit(1.0))


def points_by_file(points: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Points of one file by offset, scenes before frames; ``limit`` keeps the first page, if given."""
    order = ["source_offset", F.when(F.col("granularity") == "scene", 0).otherwise(1), "frame_index", "point_id"]
    found = with_payload_defaults(points.drop("vector").filter(F.col("file_path") == path))
    ordered = found.orderBy(*order)
    return (ordered if limit is None else ordered.limit(limit)).withColumn("score", F.lit(1.0))


def scene_list(points: DataFrame) -> DataFrame:
    """Scenes per file: the last point of a scene id wins; an open end takes the file's duration."""
    scenes = points.drop("vector").filter(F.col("granularity") == "scene").withColumn("scene_id", F.coalesce("scene_id", F.lit(0)))
    latest = first_row(scenes, ["file_path", "scene_id"], [F.desc("source_offset"), F.desc("frame_index"), F.desc("point_id")])
    zero = F.lit(0.0)
    return latest.select(
        "file_path",
        "scene_id",
        "point_id",
        F.coalesce("scene_start", zero).alias("start_sec"),
        F.coalesce("scene_end", "duration_seconds", zero).alias("end_sec"),
        round_to(F.coalesce("scene_end", zero) - F.coalesce("scene_start", zero), 2).alias("duration_sec"),
        F.coalesce("scene_frame_count", F.lit(0)).alias("frame_count"),
    )


def frame_list(points: DataFrame) -> DataFrame:
    return points.filter(F.coalesce("granularity", F.lit("frame")) != "scene").select("file_path", "point_id", "frame_index", "source_offset", "scene_id")


def scene_breakdown(points: DataFrame) -> DataFrame:
    """One row per file: scene and frame counts over :func:`scene_list` and :func:`frame_list`."""
    scenes = scene_list(points).groupBy("file_path").agg(
        F.count("*").alias("total_scenes"), F.round(F.sum("duration_sec"), 2).alias("scene_seconds")
    )
    frames = frame_list(points).groupBy("file_path").agg(F.count("*").alias("total_frames"))
    zero = F.lit(0).cast("long")
    return frames.join(scenes, "file_path", "full").select(
        "file_path",
        F.coalesce("total_scenes", zero).alias("total_scenes"),
        F.coalesce("total_frames", zero).alias("total_frames"),
        F.coalesce("scene_seconds", F.lit(0.0)).alias("scene_seconds"),
    )


# --- maintenance --------------------------------------------------------------------------------


def upsert_points(points: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Points by id, the new row wins; among new rows of one id the last in ``order``, or any one without an order."""
    if order is not None:
        new = first_row(new, ["point_id"], [F.desc(order)]).drop(order)
    else:
        new = new.dropDuplicates(["point_id"])
    kept = points.join(new.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(new)


def delete_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("point_id"), "point_id", "left_anti")


def delete_by_path(points: DataFrame, path: str) -> DataFrame:
    return points.filter(~F.col("file_path").eqNullSafe(F.lit(path)))


# --- pairs and reference vectors ----------------------------------------------------------------


def pair_similarity(pairs: DataFrame, left: str = "left_vector", right: str = "right_vector") -> DataFrame:
    """Dot product of two normalised vectors, 4 decimals; 0 when their lengths differ."""
    return pairs.withColumn("similarity", round_to(dot(F.col(left), F.col(right)), 4))


def similarity_band(df: DataFrame, similarity: str = "similarity") -> DataFrame:
    s = F.col(similarity)
    band = F.when(s >= 0.08, "strong").when(s >= 0.03, "moderate").when(s >= 0.0, "weak").otherwise("negative")
    gauge = (clamp(s, -0.15, 0.15) + F.lit(0.15)) / F.lit(0.30) * F.lit(100.0)
    return df.withColumn("band", band).withColumn("gauge_pct", round_to(gauge, 4))


def mean_unit_vector(df: DataFrame, keys: Sequence[str], vector: str = "vector", out: str = "reference_vector") -> DataFrame:
    """L2-normalised mean vector per key, combined map-side; a zero mean stays zero."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    means = df.groupBy(*keys).agg(mean.alias("_mean"))
    return means.withColumn(out, l2_normalize(vector_to_array("_mean"))).drop("_mean")


def reference_vector(points: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reference vector per key from the chosen points (``chosen``: keys and ``point_id``)."""
    return mean_unit_vector(chosen.join(points.select("point_id", "vector"), "point_id"), keys)


# --- near duplicates (described in the reference's documents, not in its code) -------------------


def _best_first(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_place`` by score (4 decimals) descending, then point id.

    Equal scores are cut once more by the first letters of the id, which follow the id's own order.
    """
    ranked = items.withColumn("_down", -F.floor(F.coalesce(F.col("score"), F.lit(0.0)) * F.lit(1e4) + F.lit(0.5)))
    bucket = [F.col("_down"), F.substring("point_id", 1, 2)]
    return position_of(ranked, keys, [F.col("_down"), F.col("point_id")], bucket, "_place").drop("_down")


def _best_copies(items: DataFrame, keys: Sequence[str], same: Sequence[Column]) -> DataFrame:
    """The best row of each set of exact copies; its other copies are duplicates of it and need no comparing."""
    names = [f"_same{i}" for i in range(len(same))]
    marked = items.withColumns(dict(zip(names, same)))
    order = [F.desc(F.floor(F.coalesce(F.col("score"), F.lit(0.0)) * F.lit(1e4) + F.lit(0.5))), F.asc("point_id")]
    return first_row(marked, [*keys, *names], order).drop(*names)


def _flag_all_but(items: DataFrame, survivors: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept = survivors.select(*keys, "point_id").withColumn("_kept", F.lit(True))
    return items.join(kept, [*keys, "point_id"], "left").withColumn("is_duplicate", F.col("_kept").isNull()).drop("_kept")


def _reach(max_distance: float) -> float:
    """How far unit vectors may lie apart whose cosine distance is within a bound."""
    return math.sqrt(max(0.0, 2.0 * max_distance))


def near_duplicates(items: DataFrame, keys: Sequence[str], max_distance: float = 0.05) -> DataFrame:
    """Rows of a selection with ``is_duplicate``: a better row of the key lies within the cosine distance.

    Whatever is near a copy is near the best copy too, so only one row per distinct vector is compared,
    in blocks of rows that lie close along two fixed directions. A zero vector is near nothing, not even its copies.
    """
    limit = 1.0 - max_distance
    zero = F.when(~F.exists("vector", lambda x: x != 0), F.col("point_id"))
    distinct = _best_copies(items.select(*keys, "point_id", "vector", "score"), keys, [F.col("vector"), zero])
    counted = better_neighbour_counts(
        _best_first(distinct, keys), keys, "_place", "vector", lambda a, b: np.round(a @ b.T, 12) > limit, "_better", reach=_reach(max_distance)
    )
    return _flag_all_but(items, counted.filter("_better = 0"), keys)


def near_duplicate_hashes(items: DataFrame, keys: Sequence[str], bits: str = "phash", max_bits: int = 5) -> DataFrame:
    """The perceptual-hash form: 64-bit hashes that differ in fewer than ``max_bits`` bits.

    Two such hashes agree on at least one of ``max_bits`` slices of the word, so only rows that share
    a slice are compared; the result is exact.
    """
    width = -(-64 // max_bits)
    mask = (1 << width) - 1
    slices = F.array(*[
        F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col(bits), i * width).bitwiseAND(F.lit(mask)).alias("v"))
        for i in range(max_bits)
    ])
    distinct = _best_copies(items.select(*keys, "point_id", bits, "score"), keys, [F.col(bits)])
    sliced = distinct.withColumn("_s", F.explode(slices))
    sliced = sliced.select(*keys, "point_id", "score", bits, F.col("_s.i").alias("_i"), F.col("_s.v").alias("_v"))
    within = [*keys, "_i", "_v"]

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differing = np.bitwise_count(a[:, None].view(np.uint64) ^ b[None, :].view(np.uint64))
        return differing < max_bits

    counted = better_neighbour_counts(_best_first(sliced, within), within, "_place", bits, close, "_better")
    dropped = counted.filter("_better > 0").select(*keys, "point_id").distinct()
    return _flag_all_but(items, distinct.join(dropped, [*keys, "point_id"], "left_anti"), keys)
