import random

from pyspark.sql import functions as F

from reelmill.operators import storyboard

CANDS = ("job_id string, seq long, place long, file_path string, file_id long, file_type string, score double, composite_rank double, source_offset double, "
         "scene_id int, scene_start double, scene_end double, creation_timestamp double, granularity string, scores map<string,double>")


def candidate(job, place, path, kind="video", score=0.2, rank=None, time=None, scene=None, start=1.0):
    """``scene``: seconds of the scene the hit lies in."""
    return dict(
        job_id=job, seq=place, place=place, file_path=path, file_id=place + 1, file_type=kind, score=score, composite_rank=rank, source_offset=start,
        scene_id=None if scene is None else 0, scene_start=None if scene is None else start, scene_end=None if scene is None else start + scene,
        creation_timestamp=time, granularity="frame", scores={})


def random_candidates(rng, jobs):
    rows = []
    for job in jobs:
        files = [(f"/{n}", rng.choice(["video", "image"]), 1e9 + rng.randrange(9 * 86400)) for n in range(rng.randrange(1, 25))]
        for place in range(rng.randrange(1, 60)):
            path, kind, time = rng.choice(files)
            rows.append(candidate(job, place, path, kind, round(rng.uniform(0.08, 0.3), 2), round(rng.random(), 1), time, rng.choice([None, 1.0, 3.25, 9.0])))
    return rows


def to_df(spark, rows):
    names = [f.split()[0] for f in CANDS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CANDS).repartition(6)


def boards_of(spark, rows, targets):
    plan = spark.createDataFrame(list(targets.items()), "job_id string, target_duration int")
    found = {}
    for r in storyboard.curate(to_df(spark, rows), plan).orderBy("job_id", "position").collect():
        found.setdefault(r.job_id, []).append(r)
    return found


def test_curation_by_hand(spark):
    """Three days make six buckets; worked out on paper."""
    day = 86400.0
    rows = [
        candidate("j", 0, "/a", rank=0.9, time=1e9, scene=3.0), candidate("j", 1, "/b", rank=0.8, time=1e9 + 60),  # one bucket: /a wins it
        candidate("j", 2, "/c", "image", rank=0.1, time=1e9 + 1.5 * day),  # alone in its bucket
        candidate("j", 3, "/d", rank=0.3, time=1e9 + 3 * day, scene=9.0),  # the last bucket; a long scene is cut to 6 s
        candidate("j", 4, "/low", rank=1.0, score=0.01, time=1e9),  # below the least score
    ]
    buckets_only = boards_of(spark, rows, {"j": 11})["j"]
    assert [(r.file_path, r.duration) for r in buckets_only] == [("/a", 3.0), ("/c", 2.5), ("/d", 6.0)]
    filled = boards_of(spark, rows, {"j": 60})["j"]
    assert [(r.file_path, r.duration) for r in filled] == [("/a", 3.0), ("/b", 4.0), ("/c", 2.5), ("/d", 6.0)]
    assert [r.file_path for r in boards_of(spark, rows, {"j": 2})["j"]] == ["/a"]


def test_curation_falls_back_to_the_first_ten(spark):
    rows = [candidate("j", n, f"/{n:02}", "image", score=0.01, rank=n / 100) for n in range(14)]
    assert sorted(r.file_path for r in boards_of(spark, rows, {"j": 600})["j"]) == [f"/{n:02}" for n in range(10)]


def test_curation_properties(spark):
    rng = random.Random(6)
    targets = {f"j{n}": rng.choice([5, 20, 30, 90]) for n in range(80)}
    rows = random_candidates(rng, targets)
    boards = boards_of(spark, rows, targets)
    bucketed = {}
    for r in storyboard.time_buckets(to_df(spark, rows)).collect():
        bucketed.setdefault(r.job_id, []).append(r)
    for job, target in targets.items():
        board, mine = boards[job], bucketed[job]
        files = {r.file_path for r in mine}
        total = sum(r.duration for r in board)
        assert len({r.file_path for r in board}) == len(board) and {r.file_path for r in board} <= files
        assert total >= target or len(board) == len(files)
        assert total - min(r.duration for r in board) < target + 6.0
        times = [r.creation_timestamp for r in board]
        assert times == sorted(times) and [r.position for r in board] == list(range(len(board)))
        first = min(r.bucket for r in mine)
        best = max(r.composite_rank for r in mine if r.bucket == first)
        assert any(r.composite_rank == best and r.bucket == first for r in board)
        if total < target:
            assert {r.file_path for r in board} == files


def trimmed(spark, draft, target, least):
    rows = [("j", n, *d) for n, d in enumerate(draft)]
    df = spark.createDataFrame(rows, "job_id string, seq long, duration double, composite_rank double, similarity_score double")
    jobs = spark.createDataFrame([("j", target, least)], "job_id string, target_duration int, min_segments int")
    return sorted(r.seq for r in storyboard.tail_trim(df, jobs).collect())


def test_trim_by_hand(spark):
    draft = [(4.0, 0.5, None), (4.0, None, 0.1), (4.0, 0.0, 0.3), (4.0, None, None), (4.0, 0.5, None)]
    assert trimmed(spark, draft, 16, 2) == [0, 1, 2, 3, 4]  # 20 s are just 1.25 targets
    assert trimmed(spark, draft, 10, 2) == [0, 2, 4]  # nothing known goes first, then 0.1
    assert trimmed(spark, draft, 10, 4) == [0, 1, 2, 4]  # four segments have to stay
    assert trimmed(spark, draft, 4, 1) == [4]  # equal ranks fall in draft order


def test_trim_properties(spark):
    rng = random.Random(7)
    for _ in range(6):
        draft = [(rng.choice([1.5, 2.5, 4.0]), rng.choice([0.3, 0.6, 0.9]), None) for _ in range(rng.randrange(1, 20))]
        target, least = rng.choice([5, 10, 20]), rng.choice([2, 4])
        kept = trimmed(spark, draft, target, least)
        gone = [n for n in range(len(draft)) if n not in kept]
        total = sum(draft[n][0] for n in kept)
        assert total <= 1.25 * target or len(kept) <= least
        if gone:
            assert max(draft[n][1] for n in gone) <= min(draft[n][1] for n in kept)
            assert total + min(draft[n][0] for n in gone) > 1.25 * target or len(kept) >= least


def test_autofill_of_a_long_job(spark):
    """400 images for 600 seconds: 240 segments, not cut short."""
    rows = [candidate("j", n, f"/{n}", "image") for n in range(400)]
    empty = to_df(spark, rows).limit(0)
    columns = {"start_offset": "double", "end_offset": "double", "duration": "double", "segment_type": "string", "retrieval_strategy": "string", "similarity_score": "double"}
    draft = empty.withColumns({k: F.lit(None).cast(t) for k, t in columns.items()})
    board = storyboard.autofill(draft, to_df(spark, rows), spark.createDataFrame([("j", 600)], "job_id string, target_duration int")).collect()
    assert len(board) == 240 and {r.file_path for r in board} == {f"/{n}" for n in range(240)}


def test_a_late_iteration_can_win(spark):
    df = spark.createDataFrame([("a", n, s, 5) for n, s in ((1, 4.0), (3, 5.0), (4, 9.0))], "job_id string, iteration int, composite_score double, segments long")
    assert storyboard.best_draft(df).first().best_iteration == 4
    assert storyboard.best_draft(df, max_iterations=3).first().best_iteration == 3


def test_bucket_quota_searches_the_newest_point(spark):
    points = spark.createDataFrame([(f"p{n}", [1.0, 0.0], float(t)) for n, t in enumerate((0, 500, 1000))], "point_id string, vector array<float>, creation_timestamp double")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert {r.point_id for r in storyboard.bucket_quota(points, queries, 90).collect()} == {"p0", "p1", "p2"}
    same = points.withColumn("creation_timestamp", F.lit(7.0))
    assert not any(r.zero_matches for r in storyboard.bucket_quota(same, queries, 90).collect())


def test_autofill_reaches_the_target_in_rank_order(spark):
    day = 86400.0
    rows = [candidate("j", i, f"/{i}", rank=r, time=(4 - i) * day) for i, r in enumerate((0.85, 0.80, 0.75, 0.70))]
    cands = to_df(spark, rows)
    picks = spark.createDataFrame([("j", 0, "/0", 4.0), ("j", 1, "/1", 4.0), ("j", 2, "/0", 4.0)], "job_id string, seq long, file_path string, duration double")
    empty = {"file_id": "long", "start_offset": "double", "end_offset": "double", "segment_type": "string", "scene_id": "int", "retrieval_strategy": "string",
             "similarity_score": "double", "composite_rank": "double", "scores": "map<string,double>", "creation_timestamp": "double"}
    draft = storyboard.draft_dedupe(picks.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()}), cands)
    jobs = spark.createDataFrame([("j", 15, 4)], "job_id string, target_duration int, min_segments int")
    board = storyboard.chronological(storyboard.autofill(draft, cands, jobs)).orderBy("position").collect()
    assert [r.file_path for r in board] == ["/3", "/2", "/1", "/0"]
    assert sum(r.duration for r in board) == 16.0 and board[3].composite_rank == 0.85


def test_best_draft_keeps_the_better_and_later_equal_one(spark):
    rows = [("a", 1, 8.0, 5), ("a", 2, 6.0, 5), ("b", 1, 7.0, 5), ("b", 2, 7.0, 4), ("c", 1, 3.35, 0), ("c", 2, 2.0, 3)]
    df = spark.createDataFrame(rows, "job_id string, iteration int, composite_score double, segments long")
    assert {r.job_id: r.best_iteration for r in storyboard.best_draft(df).collect()} == {"a": 1, "b": 2, "c": 2}


def test_score_of_an_empty_storyboard(spark):
    drafts = spark.createDataFrame([], "job_id string, duration double, segment_type string, similarity_score double, scores map<string,double>")
    jobs = spark.createDataFrame([("j", 30)], "job_id string, target_duration int")
    row = storyboard.editor_notes(storyboard.score_storyboard(drafts, jobs)).first()
    assert row.composite_score == 3.35 and row.note == "too short" and not row.approved


def test_hits_close_together_become_one_clip(spark):
    hits = spark.createDataFrame([("j", "/v", "video", t) for t in (0.2, 3.0, 6.9, 11.0)], "job_id string, file_path string, file_type string, source_offset double")
    got = storyboard.segment_merge(hits).orderBy("start_offset").collect()
    assert [(r.start_offset, r.merged_hits) for r in got] == [(0.0, 3), (10.5, 1)]
