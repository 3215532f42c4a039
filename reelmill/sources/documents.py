"""JSON inputs and outputs: ground truth, telemetry log, session export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import chronology_audit, duration_audit, inventory
from ..schemas import TELEMETRY

CASE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("filename_stem", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("expected_scene", T.StringType()),
        T.StructField("positive_prompt", T.StringType()),
        T.StructField("negative_prompt", T.StringType()),
    ]
)
GROUND_TRUTH = T.StructType([T.StructField("description", T.StringType()), T.StructField("test_cases", T.ArrayType(CASE))])


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of the alignment documents."""
    documents = spark.read.schema(GROUND_TRUTH).option("multiLine", "true").json(path)
    return documents.select(F.explode("test_cases").alias("case")).select("case.*")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs: lifecycle rows carry ``event``, samples carry measurements; ``source`` is the file, one per producer."""
    return spark.read.schema(TELEMETRY).json(path).withColumn("source", F.col("_metadata.file_path"))


def export_session(
    timeline: DataFrame, files: DataFrame, points: DataFrame, jobs: DataFrame, out: str, alternatives: DataFrame | None = None
) -> None:
    """Inventory, order audit and duration audit as JSON tables, the rows of a job together; likewise the alternatives, if given."""
    tables = {
        "inventory": inventory(timeline, files, points),
        "chronology": chronology_audit(timeline, files),
        "durations": duration_audit(timeline, jobs),
    }
    if alternatives is not None:
        tables["alternatives"] = alternatives
    for name, table in tables.items():
        dealt = table.repartition("job_id").sortWithinPartitions("job_id")
        dealt.write.mode("overwrite").json(f"{out.rstrip('/')}/{name}")
