import os
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reelmill.fixtures import Media
from reelmill.functions.columns import exact_mean, round_to
from reelmill.operators import evaluate, frames, quality
from reelmill.plans.oracle import ORACLE


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(round_to(F.lit(0.125), 2).alias("a"), round_to(F.lit(-0.125), 2).alias("b"), round_to(F.lit(None).cast("double"), 2).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.13, -0.12, None)


def test_sampling_with_and_without_rate(spark):
    rows = [(1, i, 29.97) for i in range(95)] + [(2, i, None) for i in range(95)] + [(3, i, 0.4) for i in range(4)]
    df = spark.createDataFrame(rows, "file_id int, idx long, src_fps double")
    got = {}
    for r in frames.sample_frames(df).orderBy("file_id", "idx").collect():
        got.setdefault(r.file_id, []).append((r.idx, r.frame_no, r.source_offset))
    assert got[1] == [(0, 0, 0.0), (30, 1, 1.001), (60, 2, 2.002), (90, 3, 3.003)]
    assert got[2] == [(0, 0, 0.0), (30, 1, 1.0), (60, 2, 2.0), (90, 3, 3.0)]
    assert [x[0] for x in got[3]] == [0, 1, 2, 3]


def test_gate_equals_the_sequential_rule_across_slices(spark):
    rng = np.random.default_rng(8)
    cuts = {f: sorted(rng.choice(900, size=rng.integers(1, 300), replace=False).tolist()) for f in range(12)}
    gates = {f: int(rng.integers(2, 90)) for f in cuts}
    df = spark.createDataFrame([(f, int(c), gates[f]) for f, cs in cuts.items() for c in cs], "file_id int, frame_index long, min_frames long")
    got = {}
    for r in frames.gate_cuts(df, slice_frames=64).orderBy("file_id", "frame_index").collect():
        got.setdefault(r.file_id, []).append(r.frame_index)
    want = {}
    for f, cs in cuts.items():
        last = 0
        for c in cs:
            if c - last >= gates[f]:
                want.setdefault(f, []).append(c)
                last = c
    assert got == want


def test_cut_candidates_across_slice_borders(spark):
    rng = np.random.default_rng(12)
    n = 3 * frames.ORDER_SLICE + 10
    values = rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"file_id": 1, "frame_index": range(n), "v": values})).select("file_id", "frame_index", F.array("v").alias("features"))
    change = np.abs(np.diff(values, prepend=np.nan))
    want = set()
    for i in range(1, n):
        local = [change[k] for k in range(max(1, i - 2), min(n, i + 3)) if k != i]
        if change[i] >= 2.0 * max(np.mean(local), 1e-9) and change[i] > 0.1:
            want.add(i)
    assert {r.frame_index for r in frames.cut_candidates(df, 2.0, 0.1).collect()} == want


def test_cut_candidates_on_exact_ties_add_up_as_their_sql(spark):
    """Changes of three times their local average to the cent: the last bits decide, so the order of addition has to be the twin's."""
    videos = [
        [80.0, 44.39, 52.37, 136.07, 105.74, 68.06], [80.0, 56.58, 63.6, 136.5, 96.73, 69.74], [80.0, 70.74, 107.24, 41.27, 77.33, 83.47],
        [80.0, 41.51, 73.47, 156.75, 129.05, 116.16], [80.0, 46.38, 79.25, 155.54, 143.71, 120.31], [80.0, 55.18, 91.0, 28.27, 32.88, 51.27],
    ]
    rows = [(f, i, [v]) for f, video in enumerate(videos) for i, v in enumerate(video)]
    df = spark.createDataFrame(rows, "file_id int, frame_index long, features array<double>")
    got = {(r.file_id, r.frame_index) for r in frames.cut_candidates(df).collect()}
    events = pd.DataFrame([(i * 10 + f, f, v[0]) for f, i, v in rows], columns=["event_id", "user_id", "value"])
    con = duckdb.connect()
    con.register("events", events)
    assert got == {(r[0], r[1]) for r in con.execute(ORACLE["cut_candidates"]).fetchall()}
    assert {f for f, i in got if i == 3} == {0, 1, 2}


def test_scenes_of_a_synthetic_video(spark):
    noise = np.random.default_rng(9).random(200) * 0.01
    level = np.where(np.arange(200) < 70, 0.0, np.where(np.arange(200) < 140, 5.0, 1.0)) + noise
    rows = [(1, i, 30.0, [float(v)]) for i, v in enumerate(level)] + [(2, i, 30.0, [0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "file_id int, frame_index long, src_fps double, features array<double>")
    got = [tuple(r) for r in frames.detect_scenes(df, min_change=0.1).select("file_id", "scene_id", "start_frame", "end_frame").orderBy("file_id", "scene_id").collect()]
    assert got == [(1, 0, 0, 70), (1, 1, 70, 140), (1, 2, 140, 200), (2, 0, 0, 50)]


def test_tagging_prefers_the_earlier_scene_and_falls_back(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 4.0, 6.5)], "file_id int, scene_id int, scene_start double, scene_end double")
    df = spark.createDataFrame([(1, 4.0), (1, 4.1), (1, 7.0), (2, 1.0)], "file_id int, source_offset double")
    got = {(r.file_id, r.source_offset): r.scene_id for r in frames.tag_scene(df, scenes).collect()}
    assert got == {(1, 4.0): 0, (1, 4.1): 1, (1, 7.0): 0, (2, 1.0): None}


def test_scene_scores_keep_open_keys(spark):
    """Keys come from the first frame that has any; a scored frame without a key counts 0.5, one without scores not at all."""
    scores = [{}, {"new_score": 0.8, "sharpness": 0.9}, {"sharpness": 0.5, "new_score": 0.8}, {}, {"contrast": 0.1, "sharpness": 0.7, "new_score": 0.8}]
    rows = [(f"p{i}", "/v.mp4", 1, "video", 10.0, 8.0, i, float(i), 0, 0.0, 4.0, [1.0, 0.0], s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "point_id string, file_path string, file_id long, file_type string, creation_timestamp double, duration_seconds double, "
                               "frame_index int, source_offset double, scene_id int, scene_start double, scene_end double, vector array<float>, scores map<string,double>")
    assert frames.scene_representatives(df).first().scores == {"new_score": 0.8, "sharpness": 0.7}
    assert frames.scene_representatives(df, ["contrast"]).first().scores == {"contrast": 0.3667}


def test_scene_point_counts_and_means(spark):
    row = ("v", "/v.mp4", 1, "video", 10.0, 8.0)
    rows = [(f"p{i}", *row, i, float(i), 0, 0.0, 4.0, [1.0, 0.0] if i else [0.0, 1.0], {"sharpness": 0.2} if i == 0 else {}) for i in range(3)]
    df = spark.createDataFrame(rows, "point_id string, x string, file_path string, file_id long, file_type string, creation_timestamp double, duration_seconds double, "
                               "frame_index int, source_offset double, scene_id int, scene_start double, scene_end double, vector array<float>, scores map<string,double>")
    points = frames.build_points(df)
    assert points.filter("granularity = 'frame'").count() == 3
    scene = points.filter("granularity = 'scene'").collect()
    assert len(scene) == 1 and scene[0].scene_frame_count == 3 and scene[0].scores == {"sharpness": 0.2}
    assert abs(np.linalg.norm(scene[0].vector) - 1) < 1e-6 and scene[0].frame_index == -1


def frame_rows():
    rng = np.random.default_rng(10)
    images = {"black": np.zeros((64, 64, 3)), "noise": rng.integers(0, 256, (64, 64, 3)), "vivid": np.zeros((64, 64, 3))}
    images["vivid"][:, :32] = (255, 0, 0)
    images["vivid"][:, 32:] = (255, 255, 255)
    return {k: v.astype(np.uint8) for k, v in images.items()}


def test_measures_and_a_broken_frame(spark):
    rows = [(k, v.tobytes(), 64, 64) for k, v in frame_rows().items()] + [("short", b"abc", 64, 64), ("empty", b"", 0, 0)]
    df = spark.createDataFrame([(a, bytearray(b), h, w) for a, b, h, w in rows], "frame_id string, pixels binary, h int, w int")
    got = {r.frame_id: r for r in quality.measure_frames(df).collect()}
    assert (got["black"].sharpness, got["black"].colorfulness, got["black"].contrast) == (0.0, 0.0, 0.0)
    assert got["vivid"].colorfulness > 0.3 and got["vivid"].contrast > 0.5 and got["noise"].sharpness > got["black"].sharpness
    assert got["short"].measure_error and got["short"].sharpness == 0.5
    assert got["empty"].sharpness == 0.0 and got["noise"].measure_error is None


def test_kernel_equals_its_pixel_table_form(spark):
    image = frame_rows()["noise"][:9, :7]
    packed = spark.createDataFrame([("n", bytearray(image.tobytes()), 9, 7)], "frame_id string, pixels binary, h int, w int")
    long = spark.createDataFrame([("n", y, x, *map(float, image[y, x])) for y in range(9) for x in range(7)], "frame_id string, y int, x int, r double, g double, b double")
    a, b = quality.measure_frames(packed).first(), quality.measure_pixels(long).first()
    for name in ("sharpness", "colorfulness", "contrast"):
        assert abs(a[name] - b[name]) < 1e-9


def test_embedding_hook_loses_only_the_bad_row(spark):
    def model(values):
        if any(v == "bad" for v in values):
            raise RuntimeError("no pixels")
        return np.array([[len(v), 1.0] for v in values])

    df = spark.createDataFrame([("aaa",), ("bad",), ("b",)], "text string").coalesce(1)
    got = {r.text: r for r in quality.embed_table(df, "text", lambda: model).collect()}
    assert got["bad"].vector is None and got["bad"].embed_error == "no pixels"
    assert abs(np.linalg.norm(got["aaa"].vector) - 1) < 1e-6


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        return lambda values: np.array([[len(v), 1.0] for v in values])

    df = spark.range(400).select(F.col("id").cast("string").alias("text")).repartition(40)
    assert quality.embed_table(df, "text", load).filter("vector is not null").count() == 400
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 40


def test_prompt_prefix(spark):
    df = spark.createDataFrame([("  a dog ",), ("a photo of x",), ("a video of y",)], "t string")
    assert [r.p for r in df.select(quality.prompt_text(F.col("t")).alias("p")).collect()] == ["a photo of a dog", "a photo of x", "a video of y"]


def test_retrieval_ranks_in_blocks_and_alone(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(60, 5))
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "pair_id long, vector array<double>")
    prompts = spark.createDataFrame([(i, (v + rng.normal(scale=0.5, size=5)).tolist()) for i, v in enumerate(vectors)], "pair_id long, vector array<double>")
    whole = sorted(evaluate.retrieval_ranks(images, prompts).collect())
    assert whole == sorted(evaluate.retrieval_ranks(images, prompts, broadcast_rows=16).collect())
    one = evaluate.retrieval_ranks(images.limit(1), prompts.filter("pair_id = 0")).first()
    assert one.true_rank == 1 and one.margin == one.true_similarity
    pdf = pd.DataFrame(whole)
    assert pdf[2].min() == 1 and pdf[2].max() <= 60


def test_retrieval_ranks_of_copies_in_bounded_cells(spark):
    """Equal similarities rank by id, an image's own prompt is no rival; in fragments of prompts and strips of images, by brute force."""
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(700, 6))
    vectors[100:300] = vectors[100]
    asked = vectors + rng.normal(scale=0.4, size=vectors.shape)
    asked[200:320] = asked[200]
    sides = [spark.createDataFrame([(i * 11 % 700, v.tolist()) for i, v in enumerate(side)], "pair_id long, vector array<double>") for side in (vectors, asked)]
    unit = [side / np.linalg.norm(side, axis=1)[:, None] for side in (vectors, asked)]
    scores = np.floor(unit[0] @ unit[1].T * 1e8 + 0.5) / 1e8
    ids = np.arange(700) * 11 % 700
    want = {}
    for i in range(700):
        own = scores[i, i]
        ahead = ((scores[i] > own) | ((scores[i] == own) & (ids < ids[i]))) & (ids != ids[i])
        want[int(ids[i])] = (1 + int(ahead.sum()), round((own - np.where(ids == ids[i], -np.inf, scores[i]).max()) * 1e8))
    cells = dict(broadcast_rows=16, fragment_bytes=30_000, cell_pairs=20_000)
    for blocks in ({}, cells):
        got = {r.pair_id: (r.true_rank, round(r.margin * 1e8)) for r in evaluate.retrieval_ranks(*sides, **blocks).collect()}
        assert got == want


def test_exact_means_do_not_depend_on_the_order(spark):
    """Means on a rounding edge, large and negative values; the same at any number of partitions."""
    rows = [(i % 3, (i * 7919 % 1000) / 1000.0 - 0.25, 1e10 + i / 8) for i in range(999)]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    found = []
    for parts in (1, 7, 211):
        got = df.repartition(parts).groupBy("k").agg(exact_mean(F.col("v"), 4).alias("v"), exact_mean(F.col("w"), 4).alias("w"), F.count(F.lit(1)).alias("n"))
        found.append(sorted(tuple(r) for r in got.collect()))
    assert found[0] == found[1] == found[2]
    for k, v, w, n in found[0]:
        own = [r for r in rows if r[0] == k]
        assert abs(v - sum(Fraction(str(r[1])) for r in own) / n) <= Fraction(1, 20000) and abs(w - sum(r[2] for r in own) / n) < 1e-3
    edge = spark.createDataFrame([(0.27895,)] * 2 + [(0.2789,), (0.2790,)], "v double").agg(exact_mean(F.col("v"), 4).alias("m")).first()
    assert edge.m == 0.279
    assert spark.createDataFrame([], "v double").agg(exact_mean(F.col("v")).alias("m")).first().m is None


def test_scene_scores_are_the_same_at_any_partition_count(spark):
    rows = Media(spark, "/root/testdata/sf0.01").tagged
    results = [sorted(str((r.point_id, sorted(r.scores.items()))) for r in frames.scene_representatives(rows.repartition(n)).select("point_id", "scores").collect()) for n in (1, 7, 211)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 50
