import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.operators import catalog
from reelmill.schemas import FILES
from reelmill.sources import documents, listing
from reelmill.sources.tables import HashedTable, PointStore, save_timeline
from test_search import points_of

JPEG = b"\xff\xd8\xff\xe0" + b"0" * 40
MP4 = b"\x00\x00\x00\x18ftypmp42" + b"0" * 12


def write(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    write(root, "photo1.jpg", JPEG)
    write(root, "subfolder/photo2.png", b"\x89PNG\r\n\x1a\n" + b"1" * 30)
    write(root, "clip1.mp4", MP4)
    write(root, "readme.txt", b"no")
    write(root, ".hidden_photo.jpg", JPEG)
    return root


def test_scan_sniff_and_hash(spark, corpus):
    listed = listing.scan_corpus(spark, str(corpus))
    assert {os.path.basename(r.file_path) for r in listed.collect()} == {"photo1.jpg", "photo2.png", "clip1.mp4"}
    write(corpus, "fake.jpg", MP4)  # the header wins over the suffix
    ready = listing.read_listing(spark, str(corpus), spark.createDataFrame([], FILES))
    got = {os.path.basename(r.file_path): r for r in ready.collect()}
    assert got["fake.jpg"].file_type == "video" and got["fake.jpg"].mime_type == "image/jpeg"
    assert got["clip1.mp4"].file_type == "video" and got["photo2.png"].mime_type == "image/png"
    assert got["fake.jpg"].content_hash == got["clip1.mp4"].content_hash and got["photo1.jpg"].read_error is None


def test_second_scan_reads_nothing_and_prunes(spark, corpus):
    empty = spark.createDataFrame([], FILES)
    first = listing.read_listing(spark, str(corpus), empty)
    store = HashedTable(spark, str(corpus.parent / "catalogue"), FILES, "file_path", 8)
    store.replace(catalog.apply_scan(empty, catalog.classify(empty, first), F.lit(1.0)))
    assert store.read().count() == 3
    indexed = store.read().withColumn("status", F.lit("INDEXED")).withColumn("point_ids", F.array(F.lit("p")))
    store.replace(indexed)
    (corpus / "photo1.jpg").unlink()
    write(corpus, "copy.mp4", MP4)
    files = store.read()
    again = listing.read_listing(spark, str(corpus), files)
    assert again.filter("content_hash is not null").count() == 1
    actions = {os.path.basename(r.file_path): r.action for r in catalog.classify(files, again).collect()}
    assert actions == {"photo2.png": "skip", "clip1.mp4": "skip", "copy.mp4": "reuse"}
    store.replace(catalog.apply_scan(files, catalog.classify(files, again), F.lit(2.0)))
    assert store.read().count() == 3 and store.read().filter("status <> 'INDEXED'").count() == 0


def test_each_new_file_is_opened_once_and_known_ones_never(spark, corpus, tmp_path):
    for n in range(40):
        write(corpus, f"deep/level{n % 3}/more/p{n}.jpg", JPEG + bytes([n]))
    log = str(tmp_path / "opened")

    def counted(path):
        with open(log, "a") as file:
            file.write(path + "\n")
        return listing.open_file(path)

    empty = spark.createDataFrame([], FILES)
    ready = listing.read_listing(spark, str(corpus), empty, opener=counted)
    first = spark.createDataFrame(ready.collect(), ready.schema)
    opened = open(log).read().split()
    assert len(opened) == len(set(opened)) == 43 and first.filter("content_hash is null").count() == 0
    files = catalog.apply_scan(empty, catalog.classify(empty, first), F.lit(1.0))
    write(corpus, "deep/new.jpg", JPEG)
    again = listing.read_listing(spark, str(corpus), files, opener=counted).collect()
    assert len(again) == 44 and [p.rsplit("/", 1)[1] for p in open(log).read().split()[43:]] == ["new.jpg"]
    assert {r.file_type for r in again} == {"image", "video"}
    assert listing.read_listing(spark, str(corpus), files, force=True).filter("content_hash is not null").count() == 44


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_folders_are_partitions(spark, corpus, folders):
    """Files are listed by tasks; the driver's plan holds folders only, and the times are those of Spark's own listing."""
    for n in range(12):
        write(corpus, f"a{n % 4}/b{n}/c.jpg", JPEG)
    parts = listing.FolderReader(str(corpus), folders).partitions()
    assert all(not p.folder.endswith(".jpg") for p in parts) and len(parts) >= min(folders, 5)
    found = sorted(tuple(r) for r in listing.scan_corpus(spark, str(corpus), folders).collect())
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(corpus))
    assert found == sorted(tuple(r) for r in listing._media(listing._listed(own)).collect()) and len(found) == 15


def test_a_missing_file_only_marks_its_row(spark, tmp_path):
    write(tmp_path, "a.jpg", JPEG)
    df = spark.createDataFrame([(str(tmp_path / "a.jpg"),), (str(tmp_path / "none.jpg"),)], "file_path string")
    got = {os.path.basename(r.file_path): r for r in listing.hash_contents(df).collect()}
    assert got["a.jpg"].content_hash and got["none.jpg"].content_hash is None and got["none.jpg"].read_error


def test_live_photos(spark):
    names = ["/m/a.HEIC", "/m/a.mp4", "/m/a.MOV", "/m/b.jpg", "/n/b.mov", "/m/c.png", "/m/c.mov", "/m/d.tif", "/m/d.mov"]
    df = spark.createDataFrame([(n,) for n in names], "file_path string")
    got = {r.still_path: r.companion_path for r in listing.live_photo_pairs(df).collect()}
    assert got == {"/m/a.HEIC": "/m/a.MOV", "/m/c.png": "/m/c.mov"}


def stamps(root):
    return {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in root.iterdir() if p.name.startswith("bucket=")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, name string")
    table = HashedTable(spark, str(tmp_path / "t"), schema, "id", 8)
    assert not table.exists() and table.read().count() == 0
    table.delete(spark.createDataFrame([(1,)], "id long"))
    table.create()
    table.create()
    assert table.exists() and table.read().count() == 0 and len(stamps(tmp_path / "t")) == 8
    table.upsert(spark.createDataFrame([(i, f"n{i}") for i in range(40)] + [(None, "no key")], schema))
    assert table.read().count() == 40
    before = stamps(tmp_path / "t")
    table.upsert(spark.createDataFrame([(7, "new")], schema))
    after = stamps(tmp_path / "t")
    assert sum(before[k] != after[k] for k in before) == 1
    assert table.read().count() == 40 and table.read().filter("id = 7").first().name == "new"
    own = table.touched(spark.createDataFrame([(7,)], "id long"))
    inside = [r.id for r in table.read_buckets(own).collect()]
    table.delete(spark.createDataFrame([(i,) for i in inside], "id long"))  # a whole bucket
    assert table.read().count() == 40 - len(inside) and table.read_buckets(own).count() == 0
    assert sum(after[k] != v for k, v in stamps(tmp_path / "t").items()) == 1
    with pytest.raises(Exception, match="boom"):
        table.upsert(spark.createDataFrame([(3, "x")], schema).withColumn("name", F.raise_error(F.lit("boom"))))
    assert table.read().filter("id = 3").count() == (3 not in inside) and table.drop() and not table.exists()


def test_point_store(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "points"))
    assert store.count() == 0
    store.create()
    store.create()
    assert store.exists() and store.count() == 0
    rows = [dict(point_id=f"p{i}", vector=[1.0, float(i)], file_path="/a" if i < 2 else "/b") for i in range(3)]
    store.upsert(points_of(spark, rows))
    assert store.count() == 3 and store.dimension() == 2
    with pytest.raises(Exception, match="dimension 2"):
        store.upsert(points_of(spark, [dict(point_id="x", vector=[1.0], file_path="/c")]))
    store.delete_path("/a")
    assert store.count() == 1
    store.delete(spark.createDataFrame([("p2",)], "point_id string"))
    assert store.count() == 0 and store.drop() and store.count() == 0


def test_ground_truth_and_telemetry(spark, tmp_path):
    case = {"id": 1, "filename_stem": "a", "category": "c", "expected_scene": "e", "positive_prompt": "p", "negative_prompt": "n"}
    (tmp_path / "cases.json").write_text(json.dumps({"description": "d", "test_cases": [case, case | {"id": 2}]}, indent=2))
    assert [r.id for r in documents.read_ground_truth(spark, str(tmp_path / "cases.json")).orderBy("id").collect()] == [1, 2]
    lines = [{"event": "pipeline_start", "timestamp": 1.0}, {"timestamp": 2.0, "decode_qsize": 3, "index_qsize": 0, "cpu_percent": 5.0}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    log = documents.read_telemetry(spark, str(tmp_path / "log.jsonl"))
    assert log.filter("event is null").first().decode_qsize == 3 and log.count() == 2


def test_timeline_replaces_only_its_jobs_and_exports(spark, tmp_path):
    columns = "job_id string, position long, file_id long, segment_type string, start_offset double, duration double, similarity_score double, time_bucket long"
    rows = [("a", 0, 1, "image", 0.0, 2.5, 0.5, 0), ("a", 2, 2, "video_clip", 1.0, 4.0, 0.4, 2), ("b", 0, 1, "image", 0.0, 2.5, 0.3, 0)]
    root = str(tmp_path / "timeline")
    save_timeline(spark.createDataFrame(rows, columns), root)
    saved = save_timeline(spark.createDataFrame([("a", 0, 2, "video_clip", 1.1, 4.0, 0.9, 0)], columns), root).read()
    assert len(stamps(tmp_path / "timeline")) <= 2
    assert sorted((r.job_id, r.file_id) for r in saved.collect()) == [("a", 2), ("b", 1)]
    files = spark.createDataFrame([(1, "/a.jpg", 2097152, 5.0), (2, "/v.mp4", None, None)], "id long, file_path string, file_size long, creation_timestamp double")
    points = points_of(spark, [dict(point_id="x", vector=[1.0], file_path="/v.mp4", source_offset=float(i), scores={"sharpness": i / 10}) for i in range(4)])
    jobs = spark.createDataFrame([("a", 4), ("b", 30)], "job_id string, target_duration int")
    documents.export_session(saved, files, points, jobs, str(tmp_path / "out"))
    exported = spark.read.json(str(tmp_path / "out" / "inventory"))
    row = exported.filter("job_id = 'a'").first()
    assert row.media_type == "video" and row.quality_scores.sharpness == 0.1
    assert {r.job_id: r.within_bounds for r in spark.read.json(str(tmp_path / "out" / "durations")).collect()} == {"a": True, "b": False}
