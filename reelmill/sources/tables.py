"""Tables that are changed in part: plain Parquet folders dealt into hash buckets, of which a write replaces the touched ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import exact_mean
from ..operators.search import upsert_points
from ..schemas import POINTS

BUCKET = "bucket"


class HashedTable:
    """Rows by key (one or many of a key) in a Parquet folder partitioned by a hash of the key.

    A change reads and writes the buckets of its keys only, by Spark's dynamic partition overwrite: a write that fails changes nothing,
    a repeated one gives the same rows. One writer at a time; a reader that began before a write may have to begin again. Each written
    bucket holds one row without a key, so that a bucket whose last row goes is still replaced; readers don't see it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 64, order_by: str | None = None):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.order_by = order_by or key

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.root)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def exists(self) -> bool:
        return self._stored() is not None

    def create(self) -> None:
        """An empty table, if there is none yet."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], self.schema), list(range(self.buckets)))

    def read(self) -> DataFrame:
        stored = self._stored()
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        return stored.filter(F.col(self.key).isNotNull()).drop(BUCKET)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys; at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect())

    def read_buckets(self, numbers: list[int]) -> DataFrame:
        stored = self._stored()
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        return stored.filter(F.col(BUCKET).isin(numbers) & F.col(self.key).isNotNull()).drop(BUCKET)

    def _write(self, rows: DataFrame, numbers: list[int]) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        marks = self.spark.createDataFrame([(n,) for n in numbers], f"{BUCKET} int")
        marks = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], BUCKET)
        dealt = typed.withColumn(BUCKET, self._bucket(F.col(self.key))).unionByName(marks)
        dealt = dealt.repartition(max(1, len(numbers)), BUCKET).sortWithinPartitions(BUCKET, self.order_by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.root)

    def replace(self, rows: DataFrame) -> None:
        """The whole table anew. ``rows`` may come from the table itself."""
        self._write(rows.filter(F.col(self.key).isNotNull()), list(range(self.buckets)))

    def upsert(self, new: DataFrame) -> None:
        """All rows of the new rows' keys are replaced by the new ones. Rows without a key are left out."""
        keyed = new.filter(F.col(self.key).isNotNull())
        numbers = self.touched(keyed)
        if numbers:
            kept = self.read_buckets(numbers).join(keyed.select(self.key), self.key, "left_anti")
            self._write(kept.unionByName(keyed.select(*self.schema.fieldNames())), numbers)

    def delete(self, keys: DataFrame) -> None:
        gone = keys.select(self.key).filter(F.col(self.key).isNotNull())
        numbers = self.touched(gone) if self.exists() else []
        if numbers:
            self._write(self.read_buckets(numbers).join(gone, self.key, "left_anti"), numbers)

    def drop(self) -> bool:
        """Remove the folder; false if there was none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return bool(path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True))


class PointStore:
    """A vector collection of fixed dimension by point id; files are sorted by granularity, so filters on it skip row groups."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.table = HashedTable(spark, root, POINTS, "point_id", buckets, "granularity")

    def create(self) -> None:
        self.table.create()

    def exists(self) -> bool:
        return self.table.exists()

    def read(self) -> DataFrame:
        return self.table.read()

    def count(self) -> int:
        return self.read().count()

    def dimension(self) -> int | None:
        first = self.read().select(F.size("vector").alias("n")).filter("n > 0").first()
        return None if first is None else first["n"]

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Write points by id, the new row wins (the last in ``order``); the first vector fixes the dimension."""
        single = upsert_points(self.table.spark.createDataFrame([], POINTS), new, order)
        wanted = self.dimension()
        if wanted is None:
            head = single.select(F.size("vector").alias("n")).first()
            wanted = 0 if head is None else head["n"]
        wrong = F.raise_error(F.lit(f"Vectors must have dimension {wanted}"))
        self.table.upsert(single.withColumn("vector", F.when(F.size("vector") == wanted, F.col("vector")).otherwise(wrong)))

    def delete(self, ids: DataFrame) -> None:
        self.table.delete(ids)

    def delete_path(self, path: str) -> None:
        if self.exists():
            self.delete(self.read().filter(F.col("file_path") == path).select("point_id"))

    def info(self) -> DataFrame:
        """Points and mean vector length per granularity."""
        return self.read().groupBy("granularity").agg(
            F.count("*").alias("points"), F.max(F.size("vector")).alias("dimension"), exact_mean(F.size("scores").cast("double"), 2).alias("scores_per_point"),
        )

    def drop(self) -> bool:
        return self.table.drop()


def save_timeline(timeline: DataFrame, root: str, buckets: int = 64) -> HashedTable:
    """Replace the rows of exactly the jobs in ``timeline``; other jobs' rows stay. The returned table reads them all."""
    table = HashedTable(timeline.sparkSession, root, timeline.schema, "job_id", buckets)
    table.upsert(timeline)
    return table
