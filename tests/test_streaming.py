import os

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelmill.fixtures import Media
from reelmill.schemas import FILES
from reelmill.sources.tables import HashedTable, PointStore
from reelmill.streaming import jobs, telemetry
from reelmill.streaming.ingest import ingest_stream
from test_search import points_of
from test_sources import JPEG, MP4, stamps, write

FOLDER = "/root/testdata/sf0.001"


def test_ingest_resumes_and_isolates_failures(spark, tmp_path):
    root = tmp_path / "corpus"
    write(root, "a.jpg", JPEG)
    write(root, "b.mp4", MP4)
    catalogue = HashedTable(spark, str(tmp_path / "catalogue"), FILES, "file_path", 16)
    points = PointStore(spark, str(tmp_path / "points"))

    def index(files):
        ok = files.filter(~F.col("file_path").endswith("bad.jpg"))
        template = points_of(spark, [dict(point_id="x", vector=[1.0, 0.0])]).drop("point_id", "file_id", "file_path")
        made = ok.select(F.md5("file_path").alias("point_id"), F.col("id").alias("file_id"), "file_path").join(template)
        return made, files.filter(F.col("file_path").endswith("bad.jpg")).select("id", F.lit("cannot decode").alias("message"))

    def run():
        query = ingest_stream(spark, str(root), catalogue, str(tmp_path / "checkpoint"), index, points, max_files=1)
        query.awaitTermination()

    run()
    assert {os.path.basename(r.file_path): r.status for r in catalogue.read().collect()} == {"a.jpg": "INDEXED", "b.mp4": "INDEXED"}
    assert points.count() == 2
    write(root, "bad.jpg", JPEG + b"!")
    write(root, "copy.jpg", JPEG)
    run()
    state = {os.path.basename(r.file_path): r for r in catalogue.read().collect()}
    assert state["bad.jpg"].status == "ERROR" and state["bad.jpg"].error_message == "cannot decode"
    assert state["copy.jpg"].status == "INDEXED" and state["copy.jpg"].point_ids == state["a.jpg"].point_ids
    assert len({r.id for r in state.values()}) == 4 and points.count() == 2
    before = stamps(tmp_path / "catalogue")
    write(root, "one.jpg", JPEG + b"?")
    run()
    assert catalogue.read().count() == 5 and points.count() == 3
    assert sum(before[k] != v for k, v in stamps(tmp_path / "catalogue").items() if k in before) <= 1


def stream_of(spark, tmp_path, df, parts=4):
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, name, tmp_path, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = Media(spark, FOLDER).telemetry
    batch = telemetry.telemetry_rollup(rows, "6 hours")
    live = telemetry.telemetry_rollup(stream_of(spark, tmp_path, rows), "6 hours", watermark="30 days")
    got = drain(spark, live, "rollup", tmp_path, "complete")
    key = ["window_start", "samples", "max_decode_qsize", "max_cpu_percent"]
    assert sorted(got.select(key).collect()) == sorted(batch.select(key).collect())


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = Media(spark, FOLDER).job_events
    got = drain(spark, jobs.progress(stream_of(spark, tmp_path, rows)), "progress", tmp_path, "complete")
    assert sorted(got.collect()) == sorted(jobs.progress(rows).collect())


def test_run_stream_equals_batch(spark, tmp_path):
    """Rows of all sources mixed and out of order within the watermark; a last file moves the watermark past all of them."""
    rows = Media(spark, FOLDER).telemetry
    rows = rows.select(*rows.columns)
    end = rows.agg(F.max("timestamp")).first()[0]
    path = str(tmp_path / "in")
    rows.withColumn("_part", F.ntile(6).over(Window.orderBy(F.col("timestamp") + F.pmod(F.hash("event_no"), F.lit(7200))))).write.partitionBy("_part").parquet(path + "-parts")
    for n in range(1, 7):
        spark.read.schema(rows.schema).parquet(f"{path}-parts/_part={n}").coalesce(1).write.mode("append").parquet(path)
    for late in (1e7, 2e7):
        rows.limit(1).withColumns({"timestamp": F.lit(end + late), "source": F.lit("end"), "event": F.lit(None).cast("string")}).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, telemetry.run_rollup_stream(stream, "3 hours"), "runs", tmp_path, "append")
    best = {}
    for r in got.filter("source <> 'end'").collect():
        if (r.source, r.run_id) not in best or best[r.source, r.run_id].samples < r.samples:
            best[r.source, r.run_id] = r
    batch = telemetry.run_rollup(rows)
    assert sorted(tuple(r) for r in best.values()) == sorted(tuple(r) for r in batch.collect())
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source" in plan and "windowspecdefinition(0" not in plan


def test_progress_stream_forgets_and_counts_replays_once(spark, tmp_path):
    """A running job is reported as it moves, replays change nothing, and finished jobs leave the state."""
    schema = "job_id string, stage string, event_no long, processed long, total long, timestamp double"
    path = str(tmp_path / "in")
    batches = [[(f"j{n}", "scan", n, 1, 10, 100.0 + n) for n in range(20)], [("j1", "scan", 1, 1, 10, 101.0), ("j1", "scan", 50, 5, 10, 111.0)],
               [("k", "scan", 90, 1, 2, 400.0)], [("k", "scan", 91, 2, 2, 401.0)], [("k", "scan", 92, 2, 2, 402.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.progress_stream(stream, "5 seconds", 30.0).writeStream.outputMode("append").format("memory").queryName("moves").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("moves").collect()
    j1 = sorted((r.processed, r.percentage, r.elapsed_seconds) for r in got if r.job_id == "j1")
    assert j1 == [(1, 10.0, 0.0), (5, 50.0, 10.0)]
    last = max((r for r in got if r.job_id == "k"), key=lambda r: (r.processed, r.elapsed_seconds))
    assert (last.percentage, last.elapsed_seconds, last.files_per_second) == (100.0, 2.0, 1.0)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert sizes[-1] < sizes[0]


def test_latest_state_stream_and_silence(spark, tmp_path):
    events = [("a", 1, "progress", 0.0, 100.0), ("a", 2, "progress", 50.0, 101.0), ("b", 3, "progress", 10.0, 102.0), ("b", 4, "completed", 100.0, 103.0),
              ("z", 5, "progress", 1.0, 400.0), ("z", 6, "progress", 2.0, 500.0)]
    df = spark.createDataFrame([(j, n, k, "stage", p, "m", t) for j, n, k, p, t in events],
                               "job_id string, event_no long, event_type string, stage string, progress_pct double, message string, timestamp double")
    path = str(tmp_path / "in")
    for low, high in ((0, 102), (102, 300), (300, 450), (450, 600)):  # one file after the other, so in this order
        df.filter(f"timestamp >= {low} and timestamp < {high}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = jobs.latest_job_state_stream(stream, watermark="1 second")
    got = drain(spark, live, "states", tmp_path, "append").collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.event_no, r.needs_check)):
        last[r.job_id] = r
    assert last["b"].status == "COMPLETED" and not last["b"].needs_check
    assert last["a"].progress_pct == 50.0 and last["a"].needs_check
    batch = {r.job_id: r for r in jobs.latest_job_state(df, now=118.0).collect()}
    assert batch["a"].needs_check and batch["b"].status == "COMPLETED" and not batch["z"].needs_check


def test_a_late_event_does_not_open_an_ended_job(spark, tmp_path):
    schema = "job_id string, event_no long, event_type string, stage string, progress_pct double, message string, timestamp double"
    path = str(tmp_path / "in")
    batches = [[("b", 1, "progress", 10.0, 102.0)], [("b", 4, "completed", 100.0, 103.0)], [("b", 3, "progress", 50.0, 102.8)], [("z", 9, "progress", 1.0, 400.0)]]
    for rows in batches:
        frame = spark.createDataFrame([(j, n, k, "stage", p, "m", t) for j, n, k, p, t in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, jobs.latest_job_state_stream(stream, watermark="1 second"), "late", tmp_path, "append").collect()
    assert [r.status for r in sorted(got, key=lambda r: r.event_no) if r.job_id == "b"] == ["RUNNING", "COMPLETED"]


def test_sessions_and_runs(spark):
    rows = [(i, "pipeline_start" if i in (0, 5) else None, 100.0 + 2 * i + (60 if i >= 5 else 0), i, 0, 1.0, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "event_no long, event string, timestamp double, decode_qsize long, index_qsize long, cpu_percent double, memory_rss_mb double")
    assert sorted(r.samples for r in telemetry.session_rollup(df).collect()) == [4, 4]
    assert {r.run_id: r.max_decode_qsize for r in telemetry.run_rollup(df).collect()} == {1: 4, 2: 9}
    assert np.isclose(telemetry.telemetry_rollup(df, "1 minute", "30 seconds").agg(F.sum("samples")).first()[0], 16)
