"""Retrieval evaluation, embedding drift, stage latency."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import exact_mean, round_to, sum_units
from ..functions.vectors import cosine, mean_squared_error
from .vector_blocks import SCORE_DIGITS, apply_blocks, rounded, score_blocks


def _rivals_kernel(names: list[str]) -> Callable[[], Callable]:
    def make():
        seen: list = [None, None, None]

        def kernel(images: pa.Table, matrix: np.ndarray, prompts: pa.Table, prompt_matrix: np.ndarray):
            if prompts is not seen[0]:
                others = prompts.column("prompt_id").to_numpy()
                order = np.argsort(others, kind="stable")
                seen[:] = prompts, others, (order, others[order])
            _, others, (order, sorted_others) = seen
            ids, true = images.column("pair_id").to_numpy(), images.column("true_similarity").to_numpy()
            # own prompts never count: their places are found by id, image after image
            first, last = (np.searchsorted(sorted_others, ids, side) for side in ("left", "right"))
            own_image = np.repeat(np.arange(len(ids)), last - first)
            own_prompt = order[np.arange(len(own_image)) - np.repeat(np.cumsum(last - first) - last, last - first)]
            ahead, best = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
            for row, column, raw in score_blocks(matrix, prompt_matrix):
                rows = slice(row, row + len(raw))
                inside = (own_image >= row) & (own_image < row + len(raw)) & (own_prompt >= column) & (own_prompt < column + raw.shape[1])
                raw[own_image[inside] - row, own_prompt[inside] - column] = -np.inf
                best[rows] = np.maximum(best[rows], raw.max(axis=1))
                # whatever lies further off than the rounding is settled unrounded; the few others one by one
                low, high = true[rows] - 10.0**-SCORE_DIGITS, true[rows] + 10.0**-SCORE_DIGITS
                over, near = np.count_nonzero(raw > high[:, None], axis=1), np.count_nonzero(raw > low[:, None], axis=1)
                ahead[rows] += over
                some = np.flatnonzero(near > over)
                if len(some):
                    i, j = np.nonzero((raw[some] > low[some, None]) & (raw[some] <= high[some, None]))
                    i = some[i]
                    score, aim = rounded(raw[i, j]), true[row + i]
                    wins = (score > aim) | ((score == aim) & (others[column + j] < ids[row + i]))
                    ahead[rows] += np.bincount(i[wins], minlength=len(raw))
            arrays = [images.column("pair_id").combine_chunks(), images.column("true_similarity").combine_chunks(), pa.array(ahead), pa.array(rounded(best), mask=np.isinf(best))]
            return pa.RecordBatch.from_arrays(arrays, names)

        return kernel

    return make


def retrieval_ranks(images: DataFrame, prompts: DataFrame, **blocks: int) -> DataFrame:
    """Per image: similarity to its own prompt, the prompt's rank among all, margin to the best wrong one.

    ``images``/``prompts``: pair_id, vector. Only counts and maxima leave a block; equal similarities
    rank by id. A single pair has nothing wrong to compare with, which counts as similarity 0.
    """
    own = images.join(prompts.select("pair_id", F.col("vector").alias("_prompt")), "pair_id")
    scored = own.withColumn("true_similarity", round_to(cosine(F.col("vector"), F.col("_prompt")), 8)).drop("_prompt")
    key = images.schema["pair_id"].dataType
    out = T.StructType([
        T.StructField("pair_id", key), T.StructField("true_similarity", T.DoubleType()),
        T.StructField("ahead", T.LongType()), T.StructField("best_wrong", T.DoubleType()),
    ])
    queries = prompts.select(F.col("pair_id").alias("prompt_id"), F.col("vector").alias("prompt_vector"))
    partial = apply_blocks(scored.select("pair_id", "true_similarity", "vector"), queries, "vector", "prompt_vector", out,
                           _rivals_kernel(out.fieldNames()), hold_points=False, **blocks)
    return partial.groupBy("pair_id", "true_similarity").agg(F.sum("ahead").alias("_ahead"), F.max("best_wrong").alias("_wrong")).select(
        "pair_id",
        "true_similarity",
        (F.col("_ahead") + 1).alias("true_rank"),
        round_to(F.col("true_similarity") - F.coalesce("_wrong", F.lit(0.0)), 8).alias("margin"),
    )


def retrieval_eval(images: DataFrame, prompts: DataFrame, **blocks: int) -> DataFrame:
    """One row: pairs, top-1 and top-3 accuracy, mean margin."""
    return retrieval_ranks(images, prompts, **blocks).agg(
        F.count("*").alias("pairs"),
        (F.count_if(F.col("true_rank") == 1) / F.count("*")).alias("top1_accuracy"),
        (F.count_if(F.col("true_rank") <= 3) / F.count("*")).alias("top3_accuracy"),
        exact_mean(F.col("margin")).alias("mean_margin"),
    )


def embedding_drift(before: DataFrame, after: DataFrame, key: str = "point_id", vector: str = "vector") -> DataFrame:
    """Per point: cosine, mean squared error and percent kept between two versions of its vector."""
    pairs = before.select(key, F.col(vector).alias("_a")).join(after.select(key, F.col(vector).alias("_b")), key)
    similarity = cosine(F.col("_a"), F.col("_b"))
    error = mean_squared_error(F.col("_a"), F.col("_b"))
    return pairs.select(key, similarity.alias("cosine"), error.alias("mse"), (similarity * 100).alias("retention_pct"))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.count("*").alias("vectors"), exact_mean(F.col("cosine"), 12, 12).alias("mean_cosine"), F.min("cosine").alias("min_cosine"), exact_mean(F.col("mse"), 12, 12).alias("mean_mse")
    )


def stage_latency(agent_log: DataFrame) -> DataFrame:
    """Per job and node: runs, seconds and the last summary, from ``steps`` (array of structs).

    A step has node, stage, latency_seconds and summary; the array order is the order of the run.
    """
    steps = agent_log.select("job_id", F.posexplode("steps").alias("step_no", "step")).select("job_id", "step_no", "step.*")
    return steps.groupBy("job_id", "node", "stage").agg(
        F.count("*").alias("runs"),
        (sum_units(F.col("latency_seconds")) / F.lit(1e8)).cast("double").alias("total_seconds"),
        F.max("latency_seconds").alias("slowest_seconds"),
        F.max_by("summary", "step_no").alias("last_summary"),
    )


