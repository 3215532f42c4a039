"""From queries to timelines in one plan, for many jobs and profiles at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import candidate_order, composite_rank, merge_candidates, rank_candidates, resolve_weights, retrieve
from ..operators.storyboard import autofill, board_from_ranks, chronological, draft_dedupe, segment_limits, tail_trim
from ..schemas import PROFILES


def place_candidates(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``place``, the 0-based rank."""
    window = W.partitionBy(*keys).orderBy(*candidate_order())
    return ranked.withColumn("place", (F.row_number().over(window) - 1).cast("long"))


def storyboard_from(cands: DataFrame, jobs: DataFrame, keys: Sequence[str], draft: DataFrame | None = None) -> DataFrame:
    """Draft completion, autofill, trim and chronological order over placed candidates."""
    if draft is None:
        return board_from_ranks(cands, jobs, keys)
    return chronological(tail_trim(autofill(draft_dedupe(draft, cands, keys), cands, jobs, keys), jobs, keys), keys)


def generate_timelines(points: DataFrame, queries: DataFrame, jobs: DataFrame, profile: str = "journey", mode: str = "dual",
                       draft: DataFrame | None = None) -> DataFrame:
    """One storyboard per job. Drafts come from outside; without one the ranked candidates fill the time."""
    keys = ["job_id"]
    merged = merge_candidates(retrieve(points, queries, mode))
    ranked = place_candidates(rank_candidates(composite_rank(merged, resolve_weights(F.lit(profile)))), keys)
    fewest, _ = segment_limits(F.col("target_duration"), F.lit(PROFILES[profile]["segments_factor"]))
    return storyboard_from(ranked, jobs.withColumn("min_segments", fewest), keys, draft)


def generate_alternatives(points: DataFrame, queries: DataFrame, jobs: DataFrame, profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    """A storyboard per job and profile. Retrieval runs once; each candidate then carries its profiles."""
    keys = ["job_id", "profile"]
    names = F.array(*[F.lit(p) for p in profiles])
    merged = merge_candidates(retrieve(points, queries)).withColumn("profile", F.explode(names))
    ranked = place_candidates(rank_candidates(composite_rank(merged, resolve_weights(F.col("profile"))), keys), keys)
    factors = F.create_map(*[F.lit(x) for p in profiles for x in (p, PROFILES[p]["segments_factor"])])
    fewest, _ = segment_limits(F.col("target_duration"), F.element_at(factors, F.col("profile")))
    planned = jobs.withColumn("profile", F.explode(names)).withColumn("min_segments", fewest)
    return storyboard_from(ranked, planned, keys)
