"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelmill.fixtures import Media  # noqa: E402
from reelmill.operators import catalog, evaluate, frames, quality, ranking, search, storyboard, timeline  # noqa: E402
from reelmill.plans.generate import generate_alternatives  # noqa: E402
from reelmill.session import build_session, cut  # noqa: E402
from reelmill.streaming import telemetry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = 100


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    media = Media(spark, SF_DIR)
    # inputs are tables in practice, so the derived ones are written before the clock starts
    points = cut(media.points.repartition(int(CPUS)))
    queries = cut(media.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))
    many_points = cut(points.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).withColumn(
        "point_id", F.concat_ws("-", "point_id", F.col("_c").cast("string"))).drop("_c").repartition(int(CPUS)))
    thirteen = cut(queries.filter("query_id < 13"))
    jobs_of = (F.col("query_id") % 1000).cast("string")
    job_queries = cut(queries.select(jobs_of.alias("job_id"), F.col("query_id").alias("query_idx"), "query_vector"))
    jobs = cut(job_queries.select("job_id").distinct().withColumn("target_duration", F.lit(60)))
    merged = ranking.merge_candidates(ranking.retrieve(points, job_queries))
    ranked = cut(ranking.rank_candidates(ranking.composite_rank(merged, ranking.resolve_weights(F.lit("journey")))))
    one_job, one_ranked = cut(job_queries.filter("job_id = '1'")), cut(ranked.filter("job_id = '1'"))
    files, listing = cut(media.files), cut(media.listing)
    images, tagged, frame_jobs, telemetry_rows = cut(media.images), cut(media.tagged), cut(media.jobs), cut(media.telemetry)
    label_queries = cut(media.job_queries)
    shots = cut(media.frame_index.select("file_id", F.col("idx").alias("frame_index"), "src_fps", F.array("value").alias("features")))

    # more queries than one broadcast, of 768 dimensions; a key with nearly all rows; a photo that most segments show
    wide = F.flatten(F.array_repeat("vector", 12))
    wide_points = cut(points.filter("granularity = 'frame'").select("point_id", wide.alias("vector")))
    wide_queries = cut(wide_points.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        F.xxhash64("point_id", "_c").alias("query_id"), F.transform("vector", lambda x, i: x + (F.col("_c") * i) / 1e4).alias("query_vector")))
    crowd = cut(points.filter("granularity = 'frame'").withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(8)))).select(
        F.when(F.col("file_id") % 10 == 0, "rest").otherwise("hot").alias("key"), F.concat_ws("-", "point_id", "_c").alias("point_id"),
        F.transform("vector", lambda x, i: x + F.col("_c") * F.pmod(i, F.col("_c")) / 200).alias("vector"), F.lit(0.5).alias("score")))
    shown = cut(media.table("events").select(
        F.concat(F.lit("j"), F.col("event_id") % 500).alias("job_id"), F.col("event_id").alias("position"), F.col("value").alias("start_offset"),
        F.when(F.col("event_id") % 5 < 4, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("file_id"), F.lit("image").alias("segment_type"), F.lit(2.0).alias("duration")))

    cases = {
        "topk_13_queries": lambda: search.search_many(points, thirteen, 15),
        "topk_all_pairs": lambda: search.search_many(points, queries, 10),
        "topk_100x_points": lambda: search.search_many(many_points, queries, 10),
        "retrieve_rank_1000_jobs": lambda: ranking.rank_candidates(ranking.composite_rank(
            ranking.merge_candidates(ranking.retrieve(points, job_queries)), ranking.resolve_weights(F.lit("journey")))),
        "curate_1000_jobs": lambda: storyboard.curate(ranked, jobs),
        "retrieve_rank_one_job": lambda: ranking.rank_candidates(ranking.composite_rank(
            ranking.merge_candidates(ranking.retrieve(points, one_job)), ranking.resolve_weights(F.lit("journey")))),
        "curate_one_job": lambda: storyboard.curate(one_ranked, jobs),
        "alternatives_3_jobs": lambda: generate_alternatives(points, label_queries, frame_jobs),
        "catalogue_sync": lambda: catalog.apply_scan(files, catalog.classify(files, listing), F.lit(1.0)),
        "scene_points": lambda: frames.build_points(tagged),
        "detect_scenes": lambda: frames.detect_scenes(shots, 2.0),
        "measure_frames": lambda: quality.technical_composite(quality.measure_frames(images)),
        "topk_grid_768d": lambda: search.search_many(wide_points, wide_queries, 10),
        "near_duplicates_hot_key": lambda: search.near_duplicates(crowd, ["key"]),
        "inventory_hot_photo": lambda: timeline.inventory(shown, media.media_files, points),
        "retrieval_eval": lambda: evaluate.retrieval_eval(
            media.table("embeddings").select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("vector")),
            media.table("embeddings").select(F.col("vec_id").alias("pair_id"), F.reverse("embedding").alias("vector"))),
        "edit_list": lambda: timeline.edit_list(media.table("events").select(
            F.col("user_id").alias("job_id"), F.col("event_id").alias("position"), F.lit("/m/a.jpg").alias("file_path"),
            F.lit("image").alias("segment_type"), (F.col("value") / 20).alias("duration"))),
        "telemetry_rollup": lambda: telemetry.telemetry_rollup(telemetry_rows, "1 hour"),
        "telemetry_runs": lambda: telemetry.run_rollup(telemetry_rows),
    }
    seconds = {}
    for name, build in cases.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    n_queries, n_points = queries.count(), points.count()
    rates = {
        "ms_per_query_all_pairs": round(1000 * seconds["topk_all_pairs"] / n_queries, 3),
        "ms_per_query_100x_points": round(1000 * seconds["topk_100x_points"] / n_queries, 3),
        "million_scores_per_second_100x": round(n_queries * n_points * COPIES / seconds["topk_100x_points"] / 1e6, 1),
        "ms_per_job_retrieve_rank": round(1000 * seconds["retrieve_rank_1000_jobs"] / jobs.count(), 3),
        "ms_per_job_curate": round(1000 * seconds["curate_1000_jobs"] / jobs.count(), 3),
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rates": rates, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
