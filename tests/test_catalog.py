import pytest
from pyspark.sql import functions as F

from reelmill.operators import catalog, links
from reelmill.schemas import FILES, META


def files_of(spark, rows):
    columns = FILES.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], FILES)


def listing_of(spark, rows):
    return spark.createDataFrame(rows, "file_path string, file_hash string, content_hash string, file_size long, file_type string")


BASE = dict(file_size=1, file_type="image", scanned_at=1.0, updated_at=1.0)


def test_lowest_id_is_the_only_possible_donor(spark):
    files = files_of(spark, [
        dict(BASE, id=1, file_path="/a", content_hash="h", status="ERROR", point_ids=["p1"]),
        dict(BASE, id=2, file_path="/b", content_hash="h", status="INDEXED", point_ids=["p2"]),
        dict(BASE, id=3, file_path="/c", content_hash="g", status="INDEXED", point_ids=["p3"]),
    ])
    assert [r.donor_id for r in catalog.content_donors(files).collect()] == [3]
    listing = listing_of(spark, [("/new", "x", "h", 1, "image"), ("/copy", "y", "g", 1, "image")])
    actions = {r.file_path: r.action for r in catalog.classify(files, listing).collect()}
    assert actions == {"/new": "new", "/copy": "reuse"}


def test_forced_scan_of_an_unchanged_file_is_a_reuse(spark):
    files = files_of(spark, [
        dict(BASE, id=1, file_path="/a", file_hash="f", content_hash="h", status="INDEXED", point_ids=["p"]),
        dict(BASE, id=2, file_path="/b", file_hash="f", content_hash="k", status="SCANNED"),
    ])
    listing = listing_of(spark, [("/a", "f", "h", 1, "image"), ("/b", "f", "k", 1, "image")])
    forced = {r.file_path: r.action for r in catalog.classify(files, listing, force=True).collect()}
    assert forced == {"/a": "reuse", "/b": "new"}
    plain = {r.file_path: r.action for r in catalog.classify(files, listing).collect()}
    assert plain == {"/a": "skip", "/b": "resume"}


def test_upsert_keeps_what_does_not_come_in_and_is_idempotent(spark):
    files = files_of(spark, [dict(BASE, id=1, file_path="/a", file_hash="f", content_hash="h", status="INDEXED", error_message="e")])
    change = spark.createDataFrame([(None, "/a", "g", None, 5, "image", "SCANNED"), (7, "/b", "z", "q", 6, "video", "PENDING")],
                                   "id long, file_path string, file_hash string, content_hash string, file_size long, file_type string, status string")
    once = catalog.upsert_files(files, change, F.lit(9.0))
    row = once.filter("file_path = '/a'").first()
    assert (row.id, row.file_hash, row.content_hash, row.status, row.error_message, row.scanned_at, row.updated_at) == (
        1, "g", "h", "SCANNED", "e", 1.0, 9.0)
    assert once.filter("file_path = '/b'").first().id == 7
    twice = catalog.upsert_files(once, change, F.lit(9.0))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_scan_gives_new_ids_and_takes_donor_points(spark):
    files = files_of(spark, [
        dict(BASE, id=5, file_path="/a", file_hash="f", content_hash="h", status="INDEXED", point_ids=["p"], model_name="m"),
        dict(BASE, id=9, file_path="/gone", file_hash="f", content_hash="x", status="INDEXED", point_ids=["q"]),
    ])
    listing = listing_of(spark, [("/a", "f", "h", 1, "image"), ("/b", "n", "h", 1, "image"), ("/c", "n", "w", 1, "video")])
    after = {r.file_path: r for r in catalog.apply_scan(files, catalog.classify(files, listing), F.lit(2.0)).collect()}
    assert set(after) == {"/a", "/b", "/c"}
    assert after["/b"].status == "INDEXED" and after["/b"].point_ids == ["p"] and after["/b"].model_name == "m"
    assert after["/c"].status == "SCANNED" and after["/a"].id == 5
    assert {after["/b"].id, after["/c"].id} == {10, 11}
    summary = catalog.scan_summary(catalog.classify(files, listing), files).first()
    assert (summary.total_found, summary.new_files, summary.reused_files, summary.skipped_files, summary.deleted_files) == (3, 1, 1, 1, 1)


def test_unknown_id_is_an_error_and_errors_stay_on_their_row(spark):
    files = files_of(spark, [dict(BASE, id=i, file_path=f"/{i}", status="SCANNED") for i in (1, 2)])
    with pytest.raises(ValueError):
        catalog.update_status(files, spark.createDataFrame([(3, "ERROR")], "id long, status string"))
    marked = catalog.mark_errors(files, spark.createDataFrame([(2, "bad")], "id long, message string"))
    assert [(r.id, r.status, r.error_message) for r in marked.orderBy("id").collect()] == [(1, "SCANNED", None), (2, "ERROR", "bad")]


def test_meta_last_value_wins(spark):
    meta = spark.createDataFrame([("a", "1", 1.0), ("b", "1", 1.0)], META)
    after = catalog.set_meta(meta, spark.createDataFrame([("a", "2", 2.0), ("a", "3", 3.0)], META))
    assert catalog.get_meta(after, "a").first().value == "3" and catalog.get_meta(after, "b").first().value == "1"


def test_dates(spark):
    tags = spark.createDataFrame(
        [("2025:08:15 14:30:00", None, None), ("invalid_date", "2025-08-15T14:30:00+0200", None), ("", None, "2025-08-15T14:30:00Z"), (None, None, None)],
        "datetime_original string, datetime_digitized string, datetime string").withColumn("filesystem_time", F.lit(7.0))
    got = [(r.creation_timestamp, r.timestamp_source) for r in catalog.capture_time(tags).collect()]
    assert got == [(1755268200.0, "exif"), (1755261000.0, "exif"), (1755268200.0, "exif"), (7.0, "filesystem")]


def test_capture_times_with_offsets(spark):
    tags = ["2025:08:15 14:30:00+05:30", "2025-08-15T14:30:00+05:30", "2025:08:15 14:30:00+0530", "2025-08-15T09:00:00Z"]
    df = spark.createDataFrame([(t, None, None, 1.0) for t in tags], "datetime_original string, datetime_digitized string, datetime string, filesystem_time double")
    assert {r.creation_timestamp for r in catalog.capture_time(df).collect()} == {1755248400.0}


def test_several_changes_of_one_file(spark):
    files = spark.createDataFrame([(1, "A", None), (2, "B", None)], "id long, status string, error_message string")
    changes = spark.createDataFrame([(1, "X", 1.0), (1, "Y", 2.0)], "id long, status string, changed_at double")
    assert sorted((r.id, r.status) for r in catalog.update_status(files, changes).collect()) == [(1, "Y"), (2, "B")]
    assert catalog.update_status(files, changes.drop("changed_at")).count() == 2


def test_a_file_with_very_many_points_has_no_wide_row(spark):
    """Links stay rows: a file with a million points marks, goes and donates without an array."""
    points = spark.range(1_000_000).select(F.lit(1).cast("long").alias("file_id"), F.concat(F.lit("p"), "id").alias("point_id"))
    columns = {"id": "long", "file_path": "string", "content_hash": "string", "status": "string", "model_name": "string", "model_version": "string", "embedded_at": "double", "updated_at": "double"}
    files = spark.createDataFrame([(1, "/a", "h", "SCANNED", None, None, None, None), (2, "/b", "h", "SCANNED", None, None, None, None)], ", ".join(f"{k} {v}" for k, v in columns.items()))
    empty = points.limit(0)
    marked = links.mark_linked(files, points, "m")
    table = links.link_points(empty, points)
    for plan in (marked, table):
        assert "collect_set" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.status for r in marked.collect()} == {1: "INDEXED", 2: "SCANNED"}
    assert [tuple(r) for r in links.linked_donors(marked, table).collect()] == [("h", 1)]
    given = links.donate_links(table, spark.createDataFrame([(2, 1)], "id long, donor_id long"))
    assert {r.file_id: r["count"] for r in given.groupBy("file_id").count().collect()} == {1: 1_000_000, 2: 1_000_000}
    assert links.removed_points(files, table, files.filter("id = 2")).count() == 1_000_000
    again = links.link_points(table, spark.createDataFrame([(1, "q")], "file_id long, point_id string"))
    assert [tuple(r) for r in again.collect()] == [(1, "q")]


def test_ids_follow_their_paths(spark):
    paths = [(f"/p{i}",) for i in range(500)]
    first = {r.file_path: r.id for r in catalog.assign_ids(spark.createDataFrame(paths, "file_path string").repartition(7), 40).collect()}
    again = {r.file_path: r.id for r in catalog.assign_ids(spark.createDataFrame(paths[::-1], "file_path string").coalesce(1), 40).collect()}
    assert first == again and sorted(first.values()) == list(range(41, 541))
