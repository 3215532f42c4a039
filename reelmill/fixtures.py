"""Media tables derived from the given parquet tables, so that every operator can run on them."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.frames import build_points, tag_scene
from .operators.ordering import position_of
from .operators.quality import score_map, technical_composite
from .operators.ranking import candidate_order, composite_rank, merge_candidates, rank_candidates, resolve_weights, retrieve
from .operators.search import point_key
from .operators.storyboard import autofill, chronological, draft_dedupe
from .operators.timeline import compile_timeline
from .session import cut

EPOCH_2024 = 1704067200


def epoch(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


class Media:
    """Views over one folder of tables. Those that many views stand on are written to the shared folder, the others stay lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Media:
        return cls(spark, folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- frames and points

    @cached_property
    def frames(self) -> DataFrame:
        """Every vector as a frame: groups of eight are a video or eight photos."""
        group, pos = F.floor(F.col("vec_id") / 8), F.col("vec_id") % 8
        video = group % 2 == 0
        base = self.table("embeddings").withColumn("is_video", video).withColumn("pos", pos)
        base = base.withColumn("file_id", F.when(video, group * 8).otherwise(F.col("vec_id")))
        events = self.table("events")
        taken = events.select(F.col("event_id").alias("file_id"), (F.lit(EPOCH_2024) + (epoch("ts") - F.lit(EPOCH_2024)) * 10).alias("taken"))
        values = events.select(F.col("event_id").alias("vec_id"), "value")
        x = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
        raw = base.join(taken, "file_id", "left").join(values, "vec_id", "left").select(
            "vec_id",
            F.col("embedding").alias("vector"),
            "label",
            "file_id",
            F.concat(
                F.lit("/media/"), F.when(F.col("is_video"), "v").otherwise("i"), F.col("file_id").cast("string"),
                F.when(F.col("is_video"), ".mp4").otherwise(".jpg"),
            ).alias("file_path"),
            F.when(F.col("is_video"), "video").otherwise("image").alias("file_type"),
            F.when(F.col("is_video"), F.col("pos")).otherwise(F.lit(0)).cast("int").alias("frame_index"),
            F.when(F.col("is_video"), F.col("pos").cast("double")).otherwise(F.lit(0.0)).alias("source_offset"),
            F.when(F.col("file_id") % 17 != 0, F.col("taken")).alias("creation_timestamp"),
            F.when(F.col("is_video"), F.lit(8.0)).alias("duration_seconds"),
            F.when(F.col("vec_id") % 13 != 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("nima_aesthetic"),
            F.when(F.col("vec_id") % 19 != 0, F.least(F.abs(x[0]) * 4, F.lit(1.0))).alias("sharpness"),
            F.least(F.abs(x[1]) * 4, F.lit(1.0)).alias("contrast"),
            F.least(F.abs(x[2]) * 4, F.lit(1.0)).alias("colorfulness"),
        )
        scored = technical_composite(raw)
        names = ("nima_aesthetic", "sharpness", "contrast", "colorfulness", "technical_composite")
        return scored.withColumn("scores", score_map(*names)).withColumn(
            "point_id", point_key(F.col("file_path"), F.lit("frame"), F.col("source_offset"), F.lit(None))
        )

    @cached_property
    def scenes(self) -> DataFrame:
        bounds = F.array(*[
            F.struct(F.lit(i).alias("scene_id"), F.lit(a).alias("scene_start"), F.lit(b).alias("scene_end"))
            for i, a, b in ((0, 0.0, 4.0), (1, 4.0, 6.5))
        ])
        videos = self.frames.filter("file_type = 'video'").select("file_id").distinct()
        return videos.select("file_id", F.inline(bounds))

    @cached_property
    def tagged(self) -> DataFrame:
        return tag_scene(self.frames, self.scenes)

    @cached_property
    def points(self) -> DataFrame:
        return build_points(self.tagged)

    @cached_property
    def label_queries(self) -> DataFrame:
        """One query per label: the mean vector of the label."""
        mean = Summarizer.mean(array_to_vector(F.col("embedding")))
        means = self.table("embeddings").groupBy("label").agg(mean.alias("m"))
        return means.select(F.col("label").alias("query_id"), vector_to_array("m").alias("query_vector"))

    @cached_property
    def jobs(self) -> DataFrame:
        """Labels spread over three jobs, with growing targets."""
        number = F.col("query_id") % 3
        return self.label_queries.select(number.alias("n")).distinct().select(
            F.concat(F.lit("job"), F.col("n").cast("string")).alias("job_id"), (F.lit(20) + F.col("n") * 15).cast("int").alias("target_duration"),
            F.lit(4).alias("min_segments"),
        )

    @cached_property
    def job_queries(self) -> DataFrame:
        return self.label_queries.select(
            F.concat(F.lit("job"), (F.col("query_id") % 3).cast("string")).alias("job_id"), F.col("query_id").alias("query_idx"), "query_vector"
        )

    @cached_property
    def hits(self) -> DataFrame:
        return retrieve(self.points, self.job_queries)

    @cached_property
    def merged(self) -> DataFrame:
        return merge_candidates(self.hits)

    @cached_property
    def composed(self) -> DataFrame:
        return composite_rank(self.merged, resolve_weights(F.lit("journey")))

    @cached_property
    def ranked(self) -> DataFrame:
        """Final candidates with ``place``: the 0-based rank per job (a job has at most 600 of them)."""
        window = W.partitionBy("job_id").orderBy(*candidate_order())
        return cut(rank_candidates(self.composed).withColumn("place", (F.row_number().over(window) - 1).cast("long")))

    @cached_property
    def draft(self) -> DataFrame:
        """A patchy storyboard per job: every third candidate, some columns missing, one path repeated."""
        third = self.ranked.filter("place % 3 = 0 or place = 1")
        video = F.col("file_type") == "video"
        return third.select(
            "job_id",
            F.col("place").alias("seq"),
            "file_path",
            F.when(F.col("place") % 2 == 0, F.col("file_id")).alias("file_id"),
            F.col("source_offset").alias("start_offset"),
            F.when(video, F.col("source_offset") + 5.0).otherwise(F.lit(0.0)).alias("end_offset"),
            F.when(video, F.lit(5.0)).otherwise(F.lit(2.0)).alias("duration"),
            F.when(video, "video_clip").otherwise("image").alias("segment_type"),
            "scene_id",
            F.col("granularity").alias("retrieval_strategy"),
            F.when(F.col("place") % 4 == 0, F.col("score")).otherwise(F.lit(0.0)).alias("similarity_score"),
            F.when(F.col("place") % 9 == 0, F.col("composite_rank")).alias("composite_rank"),
            F.create_map().cast("map<string,double>").alias("scores"),
            F.when(F.col("place") % 2 == 1, F.col("creation_timestamp")).alias("creation_timestamp"),
        )

    @cached_property
    def deduped(self) -> DataFrame:
        return draft_dedupe(self.draft, self.ranked)

    @cached_property
    def filled(self) -> DataFrame:
        """The whole draft, filled to a long target."""
        jobs = self.jobs.withColumn("target_duration", F.col("target_duration") * 60)
        return cut(autofill(self.deduped, self.ranked, jobs))

    @cached_property
    def media_files(self) -> DataFrame:
        """Catalogue rows of the media files behind the points; one in ten is not catalogued."""
        return self.frames.filter("frame_index = 0 and file_id % 10 <> 9").select(
            F.col("file_id").alias("id"), "file_path", "file_type", "creation_timestamp", "duration_seconds", (F.col("file_id") * 100000).alias("file_size")
        )

    @cached_property
    def compiled(self) -> DataFrame:
        """Saved timelines; every second segment has to find its file by path."""
        board = chronological(self.filled).withColumn("file_id", F.when(F.col("seq") % 2 == 0, F.col("file_id")))
        return cut(compile_timeline(board, self.media_files))

    # --- catalogue

    @cached_property
    def _documents(self) -> DataFrame:
        kinds = F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".mp4"), F.lit(".mov"))
        kind = F.element_at(kinds, (F.col("doc_id") % 4).cast("int") + 1)
        mtime = F.lit(1.7e9) + F.col("doc_id") * 61 + F.col("n_chars")
        docs = self.table("documents").withColumn("mtime", mtime)
        return docs.select(
            "doc_id",
            F.concat(F.lit("/media/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), kind).alias("file_path"),
            F.col("n_chars").alias("file_size"),
            F.when(F.col("doc_id") % 4 < 2, "image").otherwise("video").alias("file_type"),
            F.md5("text").alias("content_hash"),
            "mtime",
        )

    @staticmethod
    def _fast_hash(size: Column) -> Column:
        micros = F.floor(F.col("mtime") * 1e6 + 0.5).cast("string")
        return F.md5(F.concat_ws("_", size.cast("string"), micros))

    @cached_property
    def files(self) -> DataFrame:
        """The catalogue before the scan."""
        status = F.when(F.col("doc_id") % 9 == 0, "ERROR").when(F.col("doc_id") % 23 == 0, "SCANNED").otherwise("INDEXED")
        ids = F.when(F.col("doc_id") % 29 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
        )
        return self._documents.filter("doc_id % 10 <> 0").select(
            (F.col("doc_id") + 1).alias("id"),
            "file_path",
            self._fast_hash(F.col("file_size")).alias("file_hash"),
            "content_hash",
            "file_size",
            "file_type",
            F.lit(None).cast("string").alias("mime_type"),
            F.when(F.col("doc_id") % 3 == 0, F.col("mtime")).alias("creation_timestamp"),
            F.lit("filesystem").alias("timestamp_source"),
            F.lit(None).cast("double").alias("duration_seconds"),
            status.alias("status"),
            F.when(F.col("doc_id") % 9 == 0, "unreadable").alias("error_message"),
            F.lit(None).cast("int").alias("frame_count"),
            F.when(status == "INDEXED", "siglip2").alias("model_name"),
            F.when(status == "INDEXED", "1.0").alias("model_version"),
            ids.alias("point_ids"),
            F.when(status == "INDEXED", F.lit(100.0)).alias("embedded_at"),
            F.lit(50.0).alias("scanned_at"),
            F.lit(100.0).alias("updated_at"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """The folder as the scan finds it: some files gone, some grown, some new."""
        size = F.col("file_size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
        return self._documents.filter("doc_id % 11 <> 5").select(
            "file_path", size.alias("file_size"), "file_type", "mtime", self._fast_hash(size).alias("file_hash"), "content_hash"
        )

    # --- streams and logs

    @cached_property
    def telemetry(self) -> DataFrame:
        start = F.col("event_type") == "signup"
        return self.table("events").select(
            F.col("event_id").alias("event_no"),
            F.when(start, "pipeline_start").alias("event"),
            epoch("ts").alias("timestamp"),
            F.when(~start, F.col("user_id")).alias("decode_qsize"),
            F.when(~start, F.col("user_id") % 7).alias("index_qsize"),
            F.when(~start, F.col("value")).alias("cpu_percent"),
            F.when(~start, F.col("value") * 2).alias("memory_rss_mb"),
            F.when(~start, F.col("value") / 4).alias("system_cpu_percent"),
            F.when(~start, (F.col("user_id") % 100).cast("double")).alias("system_ram_percent"),
            F.concat(F.lit("host"), F.col("event_id") % 5).alias("source"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("progress")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("job_id"),
            F.col("event_id").alias("event_no"),
            kind.alias("event_type"),
            F.col("event_type").alias("stage"),
            F.least(F.lit(100.0), F.col("value")).alias("progress_pct"),
            F.col("props").alias("message"),
            F.floor(F.col("value")).cast("long").alias("processed"),
            F.when(F.col("user_id") % 11 == 0, 0).otherwise(500).cast("long").alias("total"),
            epoch("ts").alias("timestamp"),
        )

    @cached_property
    def frame_index(self) -> DataFrame:
        """Decoded frames: each user's events in time order are the frames of one video."""
        rates = F.array(F.lit(None).cast("double"), F.lit(24.0), F.lit(29.97), F.lit(2.5), F.lit(60.0))
        rows = self.table("events").select(F.col("user_id").alias("file_id"), "event_id", "value")
        numbered = position_of(rows, ["file_id"], [F.col("event_id")], [F.floor(F.col("event_id") / 4096)], "idx")
        return numbered.select("file_id", "idx", "value", F.element_at(rates, (F.col("file_id") % 5).cast("int") + 1).alias("src_fps"))

    @cached_property
    def pixels(self) -> DataFrame:
        """Each vector as an 8 x 8 colour image, one row per pixel."""
        def channel(shift: int) -> Column:
            x = F.element_at("embedding", ((F.col("pos") + shift) % 64 + 1).cast("int")).cast("double")
            return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.lit(128.0) + F.lit(400.0) * x).cast("double")))

        spread = self.table("embeddings").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63))))
        return spread.select(
            F.col("vec_id").alias("frame_id"), F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"),
            channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"),
        )

    @cached_property
    def images(self) -> DataFrame:
        """The same images as raw bytes, packed on the JVM."""
        def channel(pos: Column, shift: int) -> Column:
            x = F.element_at("embedding", ((pos + shift) % 64 + 1).cast("int")).cast("double")
            return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128.0) + F.lit(400.0) * x).cast("int")))

        cells = F.transform(
            F.sequence(F.lit(0), F.lit(191)),
            lambda i: F.lpad(
                F.hex(
                    F.when(i % 3 == 0, channel(F.floor(i / 3).cast("int"), 0))
                    .when(i % 3 == 1, channel(F.floor(i / 3).cast("int"), 1))
                    .otherwise(channel(F.floor(i / 3).cast("int"), 2))
                ), 2, "0",
            ),
        )
        return self.table("embeddings").select(
            F.col("vec_id").alias("frame_id"), F.unhex(F.array_join(cells, "")).alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w")
        )
