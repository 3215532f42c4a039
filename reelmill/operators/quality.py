"""Quality scores: image kernels on frames, their form on an exploded pixel table, composites."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels as px
from ..functions.columns import clamp, round_to
from ..functions.vectors import l2_normalize
from ..schemas import MISSING_SCORE, PROMPT_PREFIXES


def measure_frames(frames: DataFrame, pixels: str = "pixels", height: str = "h", width: str = "w") -> DataFrame:
    """Adds sharpness, colorfulness, contrast (unrounded) and ``measure_error`` per frame.

    ``pixels`` is the raw RGB byte string. An empty frame measures 0; a frame whose bytes do not fit its
    size measures 0.5 like any failed measure and carries the message, so one bad row fails alone.
    """
    names = ("sharpness", "colorfulness", "contrast")
    added = [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("measure_error", T.StringType())]
    kept = [f for f in frames.schema.fields if f.name != pixels]
    out = T.StructType([*kept, *added])
    kernels = (px.sharpness, px.colorfulness, px.contrast)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[list[float]] = [[], [], []]
            errors: list[str | None] = []
            for blob, h, w in zip(batch.column(pixels), batch.column(height), batch.column(width)):
                raw, error = blob.as_py(), None
                if not raw:
                    measured = [0.0, 0.0, 0.0]
                else:
                    try:
                        image = np.frombuffer(raw, np.uint8).reshape(h.as_py(), w.as_py(), 3)
                        measured = [kernel(image) for kernel in kernels]
                    except (ValueError, TypeError) as problem:
                        measured, error = [MISSING_SCORE] * 3, str(problem)
                errors.append(error)
                for column, value in zip(values, measured):
                    column.append(value)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(v, pa.float64()) for v in values]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(errors, pa.string())], out.fieldNames())

    return frames.mapInArrow(measure, out)


def _grey() -> Column:
    return F.floor(F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b") + F.lit(0.5)).cast("double")


def measure_pixels(pixels: DataFrame) -> DataFrame:
    """The same three measures on long pixel rows (frame_id, y, x, r, g, b), built-in functions only.

    Each pixel sends its grey value to the cells whose Laplacian uses it; mirrored borders make a
    neighbour of the edge count twice. Sums combine map-side per cell and per frame.
    """
    sizes = pixels.groupBy("frame_id").agg(F.max("y").alias("ymax"), F.max("x").alias("xmax"))
    sized = pixels.withColumn("grey", _grey()).join(sizes, "frame_id")

    def along(at: Column, last: Column, to: Callable[[Column], Column]) -> list[Column]:
        # the inner neighbour of an edge cell stands in for the missing outer one
        doubled_low, doubled_high = F.when(at == 1, 2.0).otherwise(1.0), F.when(at == last - 1, 2.0).otherwise(1.0)
        return [
            F.struct(to(at - 1).alias("cell"), doubled_low.alias("weight")),
            F.struct(to(at + 1).alias("cell"), doubled_high.alias("weight")),
        ]

    y, x = F.col("y"), F.col("x")
    sends = [F.struct(F.struct(y.alias("y"), x.alias("x")).alias("cell"), F.lit(-4.0).alias("weight"))]
    sends += along(y, F.col("ymax"), lambda c: F.struct(c.alias("y"), x.alias("x")))
    sends += along(x, F.col("xmax"), lambda c: F.struct(y.alias("y"), c.alias("x")))
    sent = sized.select("frame_id", "ymax", "xmax", "grey", F.explode(F.array(*sends)).alias("s"))
    sent = sent.filter(F.col("s.cell.y").between(0, F.col("ymax")) & F.col("s.cell.x").between(0, F.col("xmax")))
    cells = sent.groupBy("frame_id", "s.cell.y", "s.cell.x").agg(F.sum(F.col("grey") * F.col("s.weight")).alias("laplacian"))
    sharp = cells.groupBy("frame_id").agg(clamp(F.var_pop("laplacian") / 1200.0, 0.0, 1.0).alias("sharpness"))

    red_green = F.abs(F.col("r") - F.col("g"))
    yellow_blue = F.abs((F.col("r") + F.col("g")) * F.lit(0.5) - F.col("b"))
    colour = F.sqrt(F.pow(F.stddev_pop(red_green), 2) + F.pow(F.stddev_pop(yellow_blue), 2)) + F.lit(0.3) * F.sqrt(
        F.pow(F.avg(red_green), 2) + F.pow(F.avg(yellow_blue), 2)
    )
    spread = F.percentile(_grey(), F.lit(0.95)) - F.percentile(_grey(), F.lit(0.05))
    rest = pixels.groupBy("frame_id").agg(
        clamp(colour / 100.0, 0.0, 1.0).alias("colorfulness"), clamp(spread / 220.0, 0.0, 1.0).alias("contrast")
    )
    return sharp.join(rest, "frame_id")


def technical_composite(df: DataFrame) -> DataFrame:
    """Composite of the unrounded measures; all four are then rounded to 4 decimals."""
    total = F.lit(0.50) * F.col("sharpness") + F.lit(0.15) * F.col("colorfulness") + F.lit(0.35) * F.col("contrast")
    scored = df.withColumn("technical_composite", round_to(total, 4))
    return scored.withColumns({c: round_to(F.col(c), 4) for c in ("sharpness", "colorfulness", "contrast")})


def aesthetic_from_distribution(df: DataFrame, probs: str = "probs", batch_missing: str | None = None) -> DataFrame:
    """Expected value of a 10-bin distribution scaled to 0..1; the technical composite where it is missing.

    Rows flagged by the boolean column ``batch_missing`` (the whole batch had no result) get 0.5.
    """
    weighted = F.transform(probs, lambda p, i: p * (i + F.lit(1)))
    mean = F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v.cast("double"))
    value = F.coalesce(round_to(clamp((mean - 1.0) / 9.0, 0.0, 1.0), 4), F.col("technical_composite"))
    if batch_missing is not None:
        value = F.when(F.col(batch_missing), F.lit(MISSING_SCORE)).otherwise(value)
    return df.withColumn("nima_aesthetic", value)


def epic_composite(df: DataFrame) -> DataFrame:
    blend = F.lit(0.55) * F.col("nima_aesthetic") + F.lit(0.45) * F.col("technical_composite")
    return df.withColumn("epic_composite", round_to(blend, 4))


def score_map(*names: str) -> Column:
    """Score columns as one map without the missing ones."""
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(n).cast("double")) for n in names]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


# --- embedding hook -----------------------------------------------------------------------------


def prompt_text(text: Column) -> Column:
    """Query text in the form image models were trained on."""
    trimmed = F.trim(text)
    known = F.lit(False)
    for prefix in PROMPT_PREFIXES:
        known = known | trimmed.startswith(prefix)
    return F.when(known, trimmed).otherwise(F.concat(F.lit("a photo of "), trimmed))


def worker_model(name: str, loader: Callable[[], Callable[[Sequence], np.ndarray]]) -> Callable[[Sequence], np.ndarray]:
    """The model of a plan, loaded by the first task that this Python worker runs for it.

    This package travels by value, anew with each task; what a worker shall keep needs a module of the worker's own.
    """
    module = sys.modules.setdefault("worker_models", ModuleType("worker_models"))
    held: dict = module.__dict__.setdefault("loaded", {})
    if name not in held:
        held.clear()  # a worker serves one plan at a time; older models would only take room
        held[name] = loader()
    return held[name]


def embed_table(df: DataFrame, column: str, loader: Callable[[], Callable[[Sequence], np.ndarray]], out: str = "vector") -> DataFrame:
    """Unit vectors from a caller's batch model, one call per Arrow batch.

    ``loader()`` gives the model, ``model(values) -> matrix``; it runs once per Python worker, so weights are read there and never travel
    with a task. When a batch fails it is retried row by row, so a bad row only loses its own vector and reports in ``embed_error``.
    """
    name = uuid.uuid4().hex
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_fn = worker_model(name, loader)
        for batch in batches:
            values = batch.column(column).to_pylist()
            vectors: list = []
            errors: list[str | None] = [None] * len(values)
            try:
                vectors = list(np.asarray(model_fn(values), dtype=np.float64))
            except Exception:
                vectors = []
                for i, value in enumerate(values):
                    try:
                        vectors.append(np.asarray(model_fn([value]), dtype=np.float64)[0])
                    except Exception as problem:
                        vectors.append(None)
                        errors[i] = str(problem) or type(problem).__name__
            column_out = pa.array([None if v is None else v.astype(np.float32) for v in vectors], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column_out, pa.array(errors, pa.string())], schema.fieldNames())

    return df.mapInArrow(embed, schema).withColumn(out, l2_normalize(F.col(out)).cast("array<float>"))


def word_count_model(dim: int = 64) -> Callable[[], Callable[[Sequence[str]], np.ndarray]]:
    """A loader for tests: words counted in the slot that the first 32 bits of their MD5 name."""

    def load() -> Callable[[Sequence[str]], np.ndarray]:
        slots: dict[str, int] = {}

        def model(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for word, n in Counter((text or "").split(" ")).items():
                    if word:
                        slot = slots.setdefault(word, int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dim)
                        out[row, slot] += n
            return out

        return model

    return load


def hash_embed_text(df: DataFrame, column: str, dim: int = 64, out: str = "vector") -> DataFrame:
    """A model-free text embedder for tests: hashed word counts, normalised, all on the JVM."""
    prompts = df.withColumn("_prompt", prompt_text(F.coalesce(F.col(column), F.lit(""))))
    words = Tokenizer(inputCol="_prompt", outputCol="_words").transform(prompts)
    counts = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_counts").transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_prompt", "_words", "_counts", "_unit")
