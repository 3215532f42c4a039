import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import ranking
from reelmill.schemas import PROFILES

HITS = ("job_id string, query_idx int, pass int, rank int, file_path string, scene_id int, source_offset double, score double, "
        "scores map<string,double>, seq long")


def hits_of(spark, rows):
    return spark.createDataFrame([(*r, (r[1] * 2 + r[2]) * 1000 + r[3]) for r in rows], HITS)


def test_first_seen_wins_ties_and_keeps_its_place(spark):
    rows = [
        ("j", 0, 1, 1, "/a", None, 0.0, 0.2, {}), ("j", 0, 1, 2, "/b", None, 0.0, 0.1, {}),
        ("j", 1, 1, 1, "/b", None, 0.0, 0.3, {}), ("j", 1, 1, 2, "/a", None, 0.0, 0.2, {}),
    ]
    got = {r.file_path: r for r in ranking.merge_candidates(hits_of(spark, rows)).collect()}
    assert got["/a"].query_idx == 0 and got["/b"].query_idx == 1
    assert got["/b"].seq == 1002 and got["/b"].score == 0.3


def ranked_of(spark, rows):
    merged = ranking.merge_candidates(hits_of(spark, rows))
    ranked = ranking.rank_candidates(ranking.composite_rank(merged, ranking.resolve_weights(F.lit("journey"))))
    return merged, ranking.top_n(ranked, ["job_id"], ranking.candidate_order(), 10**9, "place").orderBy("job_id", "place")


def test_ranking_by_hand(spark):
    """Journey weighs cosine 0.45, aesthetics 0.45, technical 0.10; missing scores are 0.5."""
    rows = [
        ("j", 0, 1, 1, "/a", None, 0.0, 0.25, {}),  # 0.45 + 0.225 + 0.05
        ("j", 0, 1, 2, "/a", None, 1.0, 0.15, {"nima_aesthetic": 1.0}),  # 0.225 + 0.45 + 0.05
        ("j", 0, 1, 3, "/a", None, 2.0, 0.10, {}),  # the third clip of a file
        ("j", 0, 1, 4, "/b", None, 0.0, 0.05, {"nima_aesthetic": 1.0}),  # below the least score
        ("j", 1, 0, 1, "/c", 4, 0.0, 0.30, {"nima_aesthetic": 0.0, "technical_composite": 1.0}),  # 0.45 + 0 + 0.1
    ]
    _, found = ranked_of(spark, rows)
    assert [(r.file_path, r.source_offset, r.composite_rank) for r in found.collect()] == [("/a", 0.0, 0.725), ("/a", 1.0, 0.725), ("/c", 0.0, 0.55)]


def test_low_scores_fall_back_to_the_first_ten(spark):
    rows = [("j", 0, 1, n + 1, f"/{n:02}", None, 0.0, 0.07 - n / 1000, {}) for n in range(12)]
    assert [r.file_path for r in ranked_of(spark, rows)[1].collect()] == [f"/{n:02}" for n in range(10)]


def test_ranking_properties(spark):
    rng = random.Random(5)
    rows = []
    for job in range(40):
        for q in range(3):
            for side in (0, 1):
                for rank in range(1, 8):
                    scores = {"nima_aesthetic": rng.randrange(5) / 4} if rng.random() < 0.7 else {}
                    rows.append((f"j{job}", q, side, rank, f"/f{rng.randrange(8)}", rng.randrange(2), float(rng.randrange(3)), round(rng.uniform(0.08, 0.3), 2), scores))
    merged, found = ranked_of(spark, rows)
    best = {}
    for job, _, side, _, path, scene, offset, score, _ in rows:
        key = (job, path, side, scene if side == 0 else offset)
        best[key] = max(best.get(key, 0), score)
    assert merged.count() == len(best)
    boards = {}
    for r in found.collect():
        boards.setdefault(r.job_id, []).append(r)
    for job, board in boards.items():
        values = [r.composite_rank for r in board]
        assert values == sorted(values, reverse=True)
        clips = [r.file_path for r in board]
        mine = [path for (j, path, *_) in best if j == job]
        assert {p: clips.count(p) for p in set(mine)} == {p: min(2, mine.count(p)) for p in set(mine)}


def test_zero_composite_orders_by_raw_score(spark):
    rows = spark.createDataFrame([("j", "/a", 0.9, 0.0, 1), ("j", "/b", 0.1, 0.5, 2)], "job_id string, file_path string, score double, composite_rank double, seq long")
    got = ranking.top_n(rows, ["job_id"], ranking.candidate_order(), 5, "place").orderBy("place").collect()
    assert [r.file_path for r in got] == ["/a", "/b"]


@pytest.mark.parametrize("profile", list(PROFILES))
@pytest.mark.parametrize("signals", [None, [], ["nima"], ["epic_sim", "sharpness"], ["cosine", "contrast", "what"]])
def test_weights_sum_to_one(spark, profile, signals):
    column = None if signals is None else F.array(*[F.lit(s) for s in signals]).cast("array<string>")
    row = spark.range(1).select(ranking.resolve_weights(F.lit(profile), column).alias("w")).first()
    assert abs(sum(row.w.values()) - 1) < 1e-12 and "cosine" in row.w and "epic_sim" not in row.w


def test_custom_weights(spark):
    custom = F.create_map(*[F.lit(x) for x in ("cosine", 0.45, "nima", 0.45, "technical", 0.10, "zero", 0.0)])
    row = spark.range(1).select(ranking.resolve_weights(F.lit("journey"), None, custom).alias("w")).first()
    assert {k: round(v, 6) for k, v in row.w.items()} == {"cosine": 0.45, "nima": 0.45, "technical": 0.1}


def test_unknown_custom_weight_only_dilutes(spark):
    cands = spark.createDataFrame([(0.25, {})], "score double, scores map<string,double>")
    custom = F.create_map(F.lit("cosine"), F.lit(1.0), F.lit("mystery"), F.lit(3.0))
    assert ranking.composite_rank(cands, ranking.resolve_weights(F.lit("journey"), None, custom)).first().composite_rank == 0.25


def test_many_queries_of_one_job(spark):
    queries = spark.createDataFrame([("j", i, [1.0]) for i in range(25)], "job_id string, query_idx int, query_vector array<double>")
    points = spark.createDataFrame([("p", [1.0], "frame", False)], "point_id string, vector array<float>, granularity string, is_scene_representative boolean")
    assert ranking.retrieve(points, queries).count() == 25


def test_report_lists_queries_without_hits(spark):
    hits = hits_of(spark, [("j", 0, 1, 1, "/a", None, 0.0, 0.2, {})])
    queries = spark.createDataFrame([("j", 0), ("j", 1)], "job_id string, query_idx int")
    got = {r.query_idx: (r.matched_scenes, r.matched_frames) for r in ranking.retrieval_report(hits, queries=queries).collect()}
    assert got == {0: (0, 1), 1: (0, 0)}


def test_epic_parity_flag(spark):
    cands = spark.createDataFrame([("j", "p", 0.2)], "job_id string, point_id string, score double")
    points = spark.createDataFrame([("p", [1.0, 0.0])], "point_id string, vector array<double>")
    refs = spark.createDataFrame([("j", [1.0, 0.0])], "job_id string, reference_vector array<double>")
    assert ranking.epic_similarity(cands, points, refs).first().epic_sim == 1.0
    assert ranking.epic_similarity(cands, points, refs, parity=True).first().epic_sim == 0.0
    assert ranking.epic_similarity(cands, points, refs.limit(0)).first().epic_sim == 0.0


def test_clips_per_file_come_from_the_profile(spark, monkeypatch):
    rows = [("j", profile, "/f", float(i), 0.5, i) for profile in ("journey", "personal", "cinematic", "other") for i in range(5)]
    cands = spark.createDataFrame(rows, "job_id string, profile string, file_path string, composite_rank double, score double, seq long")
    changed = {name: {**p, "clips_per_file": n} for (name, p), n in zip(ranking.PROFILES.items(), (1, 3, 4))}
    monkeypatch.setattr(ranking, "PROFILES", changed)
    kept = ranking.cap_per_file(cands, ("job_id", "profile"))
    assert {r.profile: r["count"] for r in kept.groupBy("profile").count().collect()} == {"cinematic": 1, "personal": 3, "journey": 4, "other": 4}
    assert ranking.cap_per_file(cands, ("job_id", "profile"), clips=2).count() == 8
