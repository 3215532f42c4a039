import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.functions.vectors import l2_normalize
from reelmill.operators import search, vector_blocks
from reelmill.operators.vector_blocks import better_neighbour_counts
from reelmill.plans.registry import QUERIES
from reelmill.schemas import POINTS


def points_of(spark, rows):
    columns = POINTS.fieldNames()
    filled = [dict(file_type="image", granularity="frame", source_offset=0.0, frame_index=0, is_scene_representative=False, scores={}) | r for r in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in filled], POINTS)


def small(spark):
    return points_of(spark, [
        dict(point_id="p1", vector=[1.0, 0.0, 0.0, 0.0], file_path="/1", creation_timestamp=100.0),
        dict(point_id="p2", vector=[0.7071, 0.7071, 0.0, 0.0], file_path="/2", creation_timestamp=500.0),
        dict(point_id="p3", vector=[0.0, 0.0, 1.0, 0.0], file_path="/3", creation_timestamp=900.0, file_type="video"),
        dict(point_id="p4", vector=[0.0, 0.0, 0.0, 1.0], file_path=None),
    ])


def test_cosine_order_and_threshold(spark):
    got = search.search(small(spark), [1.0, 0.0, 0.0, 0.0], 3).orderBy("rank").collect()
    assert [r.point_id for r in got] == ["p1", "p2", "p3"]
    assert [round(r.score, 4) for r in got] == [1.0, 0.7071, 0.0]
    assert search.search(small(spark), [1.0, 0.0, 0.0, 0.0], 9, score_threshold=0.5).count() == 2
    assert search.search(small(spark).limit(0), [1.0, 0.0, 0.0, 0.0]).count() == 0


def test_filters(spark):
    points = small(spark)
    assert search.filter_points(points, start_timestamp=400, end_timestamp=600).count() == 1
    assert search.filter_points(points, start_timestamp=500).count() == 2
    assert search.filter_points(points, file_type="video").count() == 1
    paths = spark.createDataFrame([("/1",)], "file_path string")
    assert {r.point_id for r in search.exclude_paths(points, paths).collect()} == {"p2", "p3", "p4"}


def test_filter_reaches_the_scan(spark, tmp_path):
    small(spark).write.partitionBy("granularity").parquet(str(tmp_path / "points"))
    stored = spark.read.schema(POINTS).parquet(str(tmp_path / "points"))
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    hits = search.search_many(search.filter_points(stored, start_timestamp=400, granularity="frame"), queries, 2, payload=["point_id"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(creation_timestamp,400.0)" in plan and "PartitionFilters: [isnotnull(granularity" in plan
    assert "scores" not in plan


@pytest.mark.parametrize("broadcast_rows, fragment_bytes, copies", [(4096, 64 << 20, 1), (7, 64 << 20, 1), (7, 9000, 1), (7, 9000, 40)])
def test_many_queries_with_a_hot_group_of_copies(spark, broadcast_rows, fragment_bytes, copies):
    """By broadcast, in one fragment, in many fragments of points, and of queries where those are more."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)).astype("f4")
    vectors[100:320] = vectors[100]  # a third are copies
    rows = [dict(point_id=f"p{i:03d}", vector=v.tolist(), file_path="/x") for i, v in enumerate(vectors)]
    points = points_of(spark, rows).repartition(4)
    asked = [(i + 30 * c, vectors[90 + i].tolist()) for i in range(30) for c in range(copies)]
    queries = spark.createDataFrame(asked, "query_id int, query_vector array<float>")
    got = search.search_many(points, queries, 5, broadcast_rows=broadcast_rows, fragment_bytes=fragment_bytes)
    unit = vectors.astype("f8") / np.linalg.norm(vectors.astype("f8"), axis=1)[:, None]
    scores = np.floor(unit[90:120] @ unit.T * 1e8 + 0.5) / 1e8
    want = {(q + 30 * c, n + 1, f"p{j:03d}") for q in range(30) for n, j in enumerate(sorted(range(600), key=lambda j: (-scores[q, j], j))[:5]) for c in range(copies)}
    assert {(r.query_id, r["rank"], r.point_id) for r in got.collect()} == want


def test_no_task_of_the_grid_compares_more_than_its_pairs(spark):
    """One fragment of points against strips of queries: the work of a task is bounded, results stay, also with copies and broken vectors."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(500, 6))
    vectors[50:150] = vectors[50]
    vectors[7], vectors[8, 2] = 0.0, np.nan
    points = points_of(spark, [dict(point_id=f"p{i:03d}", vector=v.tolist(), file_path="/x") for i, v in enumerate(vectors)])
    queries = spark.createDataFrame([(i, vectors[i].astype("f4").tolist()) for i in range(400)], "query_id int, query_vector array<float>")
    seen = spark.sparkContext.accumulator(0)
    schema = T.StructType.fromDDL("query_id int, point_id string, score double")
    kernel = vector_blocks.top_k_kernel(4, "point_id", ["point_id"], ["query_id"], schema, None)

    def counted():
        inner, pairs = kernel(), [0]

        def run(found, matrix, asked, asked_matrix):
            pairs[0] += len(matrix) * len(asked_matrix)
            assert pairs[0] <= 2 * 20_000
            seen.add(len(matrix) * len(asked_matrix))
            return inner(found, matrix, asked, asked_matrix)

        return run

    grid = vector_blocks.apply_blocks(points.select("point_id", "vector"), queries, "vector", "query_vector", schema, counted, broadcast_rows=16, cell_pairs=20_000)
    grid.count()
    assert seen.value == 500 * 400
    got = {(r.query_id, r["rank"], r.point_id) for r in search.search_many(points, queries, 4, broadcast_rows=16, cell_pairs=20_000).collect()}
    a, b = vectors[:400].astype("f4").astype("f8"), vectors.astype("f4").astype("f8")
    unit = [m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None] for m in (a, b)]
    scores = np.floor(unit[0] @ unit[1].T * 1e8 + 0.5) / 1e8
    sound = [i for i in range(500) if i != 8]
    assert got == {(q, n + 1, f"p{j:03d}") for q in range(400) if q != 8 for n, j in enumerate(sorted(sound, key=lambda j: (-scores[q, j], j))[:4])}


def test_similar_leaves_itself_out_and_knows_missing_points(spark):
    got = search.similar_to(small(spark), "p1", 2).orderBy("rank").collect()
    assert [r.point_id for r in got] == ["p2", "p3"]
    with pytest.raises(ValueError):
        search.similar_to(small(spark), "nope")


def test_similar_points_travel_without_their_payload(spark):
    """Only ids and vectors reach the workers, not the score maps."""
    plan = QUERIES["similar_to"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "technical_composite" not in plan and "map(" not in plan


def test_upsert_twice_is_once(spark):
    new = points_of(spark, [dict(point_id="p1", vector=[0.0, 1.0, 0.0, 0.0], file_path="/new"), dict(point_id="p9", vector=[1.0] * 4, file_path="/9")])
    once = search.upsert_points(small(spark), new)
    assert once.count() == 5 and once.filter("point_id = 'p1'").first().file_path == "/new"
    key = ["point_id", "file_path"]
    assert sorted(search.upsert_points(once, new).select(key).collect()) == sorted(once.select(key).collect())


def test_zero_vector_and_unequal_lengths(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [1.0, 0.0, 0.0]), (None, [1.0, 0.0])], "left_vector array<double>, right_vector array<double>")
    assert [r.u for r in rows.select(l2_normalize(F.col("left_vector")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8], None]
    assert [r.similarity for r in search.pair_similarity(rows).collect()] == [0.0, 0.0, None]


def test_near_duplicates_in_a_hot_group(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    vectors = np.concatenate([base, base[:1] + rng.normal(scale=0.02, size=(60, 6)), np.repeat(base[1:2], 50, axis=0), np.zeros((2, 6))])
    items = [("j", f"p{i:03d}", v.tolist(), float(i % 10) / 10) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(items, "job_id string, point_id string, vector array<double>, score double")
    got = {r.point_id: r.is_duplicate for r in search.near_duplicates(df, ["job_id"]).collect()}
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1, norms)[:, None]
    for i, (_, name, _, score) in enumerate(items):
        better = [k for k, o in enumerate(items) if (-o[3], o[1]) < (-score, name)]
        assert got[name] == any(unit[i] @ unit[k] > 0.95 for k in better)


def test_the_larger_side_moves_once(spark):
    """Beyond the broadcast there is one exchange to the cells, the points are not multiplied, and no block is collected into a row."""
    rng = np.random.default_rng(6)
    points = points_of(spark, [dict(point_id=f"p{i:04d}", vector=v.tolist(), file_path="/x") for i, v in enumerate(rng.normal(size=(400, 4)))])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))], "query_id int, query_vector array<float>")
    hits = search.search_many(points, queries, 3, broadcast_rows=16, fragment_bytes=4000)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "collect_list" not in plan and plan.count("RepartitionByExpression") == 1
    assert hits.count() == 270


@pytest.mark.parametrize("reach, block_rows", [(0.3, 16), (0.3, 4096), (None, 16), (None, 50)])
@pytest.mark.parametrize("width", [1, 3])
def test_neighbour_counts_of_a_crowded_key(spark, reach, block_rows, width):
    """Nine tenths of all rows share a key; no task compares more than a few blocks of them."""
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(size=(250, width)), np.ones((60, width)) + rng.normal(scale=0.05, size=(60, width)), np.zeros((2, width))])
    keys = ["hot" if i % 10 else f"k{i % 4}" for i in range(len(vectors))]
    place, seen = [], {}
    for k in keys:
        place.append(seen.get(k, 0))
        seen[k] = place[-1] + 1
    df = spark.createDataFrame([(k, p, v.tolist()) for k, p, v in zip(keys, place, vectors)], "key string, place long, vector array<double>")
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms == 0, 1, norms)[:, None]
    limit = 1 - 0.3**2 / 2

    def near(a, b):
        assert len(a) <= 4 * block_rows and len(b) <= 4 * block_rows
        return a @ b.T > limit

    found = {(r.key, r.place): r.n for r in better_neighbour_counts(df, ["key"], "place", "vector", near, "n", block_rows, reach).collect()}
    for i, (k, p) in enumerate(zip(keys, place)):
        assert found[k, p] == sum(unit[i] @ unit[j] > limit for j in range(i) if keys[j] == k)


def test_ragged_vectors_are_an_error(spark):
    points = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 0.0, 0.0])], "point_id string, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    with pytest.raises(Exception, match="lengths"):
        search.search_many(points.coalesce(1), queries, 2).collect()


def test_upsert_keeps_one_row_of_an_id(spark):
    points = spark.createDataFrame([("a", 1)], "point_id string, n int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("a", 4)], "point_id string, n int")
    assert search.upsert_points(points, new).groupBy("point_id").count().filter("count > 1").count() == 0


def test_points_without_granularity_are_frames(spark):
    points = spark.createDataFrame([("/a", "p", None, 0, 0.0, None)], "file_path string, point_id string, granularity string, frame_index int, source_offset double, scene_id int")
    assert search.frame_list(points).count() == 1
