"""Candidate retrieval and multi-signal ranking, keyed by job (and profile)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp, name_of, nonzero, round_to
from ..functions.vectors import dot
from ..schemas import (
    DEFAULT_SIGNALS,
    FALLBACK_CANDIDATES,
    MIN_SCORE,
    MISSING_SCORE,
    PRESETS,
    PRESET_SIGNALS,
    PROFILES,
    SCORE_KEYS,
    SIGNALS,
)
from .ordering import top_n
from .search import filter_points, search_many
from .vector_blocks import better_neighbour_counts

SCENE_PASS, FRAME_PASS = 0, 1


# --- retrieval ----------------------------------------------------------------------------------


def retrieve(points: DataFrame, queries: DataFrame, mode: str = "dual", k: int = 15, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Scene and/or frame pass of every query; ``seq`` is the order in which a hit is seen.

    ``queries``: keys, query_idx, query_vector. Both passes read only their own granularity.
    """
    if mode not in ("scene", "frame", "dual"):
        raise ValueError(f"Unknown retrieval mode {mode!r}")
    scenes = filter_points(points, granularity="scene", is_scene_representative=True).withColumn("pass", F.lit(SCENE_PASS))
    single = filter_points(points, granularity="frame").withColumn("pass", F.lit(FRAME_PASS))
    sides = {"scene": scenes, "frame": single, "dual": scenes.unionByName(single)}
    hits = search_many(sides[mode], queries, k, query_keys=[*keys, "query_idx"], per="pass")
    seq = (F.col("query_idx").cast("long") * 2 + F.col("pass")) * F.lit(max(1000, k + 1)) + F.col("rank")
    return hits.withColumn("seq", seq)


def merge_candidates(hits: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """One candidate per scene or frame: the best score, the first one seen among equals.

    ``seq`` becomes the key's first appearance, even when a later hit supplies the kept row.
    """
    place = F.when(F.col("pass") == SCENE_PASS, F.concat(F.lit("scene_"), F.coalesce(F.col("scene_id").cast("string"), F.lit("-"))))
    place = place.otherwise(F.concat(F.lit("offset_"), F.col("source_offset").cast("string")))
    named = hits.withColumn("candidate_key", F.concat_ws(":", "file_path", place))
    payload = [c for c in hits.columns if c not in (*keys, "seq")]
    best = F.max_by(F.struct(*payload), F.struct(F.col("score"), -F.col("seq")))
    merged = named.groupBy(*keys, "candidate_key").agg(best.alias("_best"), F.min("seq").alias("seq"))
    return merged.select(*keys, "candidate_key", "_best.*", "seq")


def normalize_cosine(score: Column) -> Column:
    return clamp((score - F.lit(0.05)) / F.lit(0.20), 0.0, 1.0)


def retrieval_report(hits: DataFrame, keys: Sequence[str] = ("job_id",), queries: DataFrame | None = None) -> DataFrame:
    """Matched scenes and frames per query; with ``queries`` (keys, query_idx) also those without any."""
    found = hits.groupBy(*keys, "query_idx").agg(
        F.count_if(F.col("pass") == SCENE_PASS).alias("matched_scenes"),
        F.count_if(F.col("pass") == FRAME_PASS).alias("matched_frames"),
    )
    if queries is None:
        return found
    asked = queries.select(*keys, "query_idx").distinct()
    return asked.join(found, [*keys, "query_idx"], "left").fillna(0, ["matched_scenes", "matched_frames"])


def filter_report(cands: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Candidates before the score filter and how many of them it removes, per key."""
    passing = F.count_if(F.col("score") >= MIN_SCORE)
    total = F.count("*")
    removed = F.when(passing > 0, total - passing).otherwise(F.greatest(total - FALLBACK_CANDIDATES, F.lit(0)))
    return cands.groupBy(*keys).agg(total.alias("candidates"), removed.cast("long").alias("filtered_out_low_score"))


def retrieval_summary(cands: DataFrame, final: DataFrame, jobs: DataFrame, weights: Column, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """What a retrieval reports per job: candidates in the end, those below the score threshold, the threshold, the weights used.

    ``cands`` come before the score filter, ``final`` after filter and file cap; a job without any candidate reports zeros.
    """
    ended = final.groupBy(*keys).agg(F.count("*").alias("total_candidates"))
    found = jobs.join(ended, list(keys), "left").join(filter_report(cands, keys).drop("candidates"), list(keys), "left")
    shown = F.transform_values(weights, lambda _, v: round_to(v, 4))
    return found.select(
        *keys, F.coalesce("total_candidates", F.lit(0).cast("long")).alias("total_candidates"),
        F.coalesce("filtered_out_low_score", F.lit(0).cast("long")).alias("filtered_out_low_score"),
        F.lit(MIN_SCORE).alias("min_score_threshold"), shown.alias("scoring_weights"),
    )


# --- weights ------------------------------------------------------------------------------------


def profile_weights(profile: Column) -> Column:
    """Rank weights of a creative profile; unknown names use ``journey``."""
    def literal(weights: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])

    choice = literal(PROFILES["journey"]["weights"])
    for name in ("personal", "cinematic"):
        choice = F.when(F.lower(profile) == name, literal(PROFILES[name]["weights"])).otherwise(choice)
    return choice


def resolve_weights(profile: Column, signals: Column | None = None, custom: Column | None = None,
                    has_reference: Column | None = None) -> Column:
    """Normalised signal weights as a map.

    Positive custom weights replace everything, and an unknown custom name takes its share without
    adding a value. Otherwise the signals (cosine always among them) are looked up in the profile, and
    ``epic_sim`` needs a reference vector.
    """
    no_map = F.lit(None).cast("map<string,double>")
    custom = no_map if custom is None else F.map_filter(custom, lambda _, v: v > 0)
    default = F.array(*[F.lit(s) for s in DEFAULT_SIGNALS])
    wanted = default if signals is None else F.when(F.size(signals) > 0, signals).otherwise(default)
    wanted = F.when(F.array_contains(wanted, "cosine"), wanted).otherwise(F.concat(F.array(F.lit("cosine")), wanted))
    wanted = F.array_distinct(wanted)
    has_reference = F.lit(False) if has_reference is None else has_reference
    weights = profile_weights(profile)
    looked_up = F.map_from_arrays(
        wanted,
        F.transform(
            wanted,
            lambda s: F.when((s == "epic_sim") & ~has_reference, F.lit(None).cast("double")).otherwise(F.try_element_at(weights, s)),
        ),
    )
    from_profile = F.map_filter(looked_up, lambda _, v: v.isNotNull())
    raw = F.when(F.coalesce(F.size(custom), F.lit(0)) > 0, custom).otherwise(from_profile)
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform_values(raw, lambda _, v: v / total)).otherwise(F.create_map(F.lit("cosine"), F.lit(1.0)))


# --- ranking ------------------------------------------------------------------------------------


def _score(name: str) -> Column:
    return F.coalesce(F.try_element_at("scores", F.lit(name)), F.lit(MISSING_SCORE))


def composite_rank(cands: DataFrame, weights: Column, epic_value: Column | None = None, out: str = "composite_rank") -> DataFrame:
    """Weighted sum over the seven signals, 4 decimals; a missing score counts 0.5."""
    values = {"cosine": normalize_cosine(F.col("score")), "epic_sim": F.lit(0.0) if epic_value is None else epic_value}
    values.update({signal: _score(key) for signal, key in SCORE_KEYS.items()})
    total = None
    for signal in SIGNALS:
        term = F.coalesce(F.try_element_at(weights, F.lit(signal)), F.lit(0.0)) * values[signal]
        total = term if total is None else total + term
    return cands.withColumn(out, round_to(total, 4))


def epic_similarity(cands: DataFrame, points: DataFrame, references: DataFrame, keys: Sequence[str] = ("job_id",),
                    parity: bool = False) -> DataFrame:
    """``epic_sim`` of each candidate to its job's reference vector, scaled like the cosine.

    The reference's candidates carry no vector, so its value is always 0; ``parity=True`` gives that.
    """
    if parity:
        return cands.withColumn("epic_sim", F.lit(0.0))
    vectors = points.select("point_id", F.col("vector").alias("_vector"))
    joined = cands.join(vectors, "point_id", "left").join(references, list(keys), "left")
    value = F.coalesce(normalize_cosine(dot(F.col("_vector"), F.col("reference_vector"))), F.lit(0.0))
    return joined.withColumn("epic_sim", value).drop("_vector", "reference_vector")


def rank_value() -> Column:
    """What candidates are ordered by: the composite, or the raw score where the composite is 0 or missing."""
    return F.coalesce(nonzero(F.col("composite_rank")), F.col("score"))


def candidate_order() -> list[Column]:
    return [F.desc(rank_value()), F.asc("seq")]


def min_score_filter(cands: DataFrame, keys: Sequence[str] = ("job_id",), floor: float = MIN_SCORE) -> DataFrame:
    """Drop low scores; a key that would lose everything keeps its first ten.

    A key holds the hits of its queries in two passes; a very large job sorts and spills.
    """
    whole = W.partitionBy(*keys)
    passes = F.col("score") >= floor
    marked = cands.withColumn("_any", F.max(passes).over(whole)).withColumn("_n", F.row_number().over(whole.orderBy(*candidate_order())))
    return marked.filter(passes | (~F.col("_any") & (F.col("_n") <= FALLBACK_CANDIDATES))).drop("_any", "_n")


def profile_clips(profile: Column) -> Column:
    """Clips of one file that a creative profile takes; unknown names use ``journey``."""
    choice = F.lit(PROFILES["journey"]["clips_per_file"])
    for name in ("personal", "cinematic"):
        choice = F.when(F.lower(profile) == name, F.lit(PROFILES[name]["clips_per_file"])).otherwise(choice)
    return choice


def cap_per_file(cands: DataFrame, keys: Sequence[str] = ("job_id",), clips: int | None = None) -> DataFrame:
    """First candidates of each file in rank order: ``clips`` of them, else as many as the row's ``profile`` takes (``journey`` without one)."""
    if clips is not None:
        return top_n(cands, [*keys, "file_path"], candidate_order(), clips, "_n").drop("_n")
    most = max(p["clips_per_file"] for p in PROFILES.values())
    allowed = profile_clips(F.col("profile") if "profile" in cands.columns else F.lit("journey"))
    return top_n(cands, [*keys, "file_path"], candidate_order(), most, "_n").filter(F.col("_n") <= allowed).drop("_n")


def rank_candidates(cands: DataFrame, keys: Sequence[str] = ("job_id",), clips: int | None = None) -> DataFrame:
    """Score filter and file cap over candidates that have their composite rank."""
    return cap_per_file(min_score_filter(cands, keys), keys, clips)


# --- experiments --------------------------------------------------------------------------------

SORT_COLUMNS = {
    "composite_desc": "composite_rank",
    "cosine_desc": "score",
    "nima_desc": "nima_val",
    "sharpness_desc": "sharp_val",
    "contrast_desc": "cont_val",
    "colorfulness_desc": "color_val",
    "technical_desc": "tech_val",
}


def preset_weights(weights: Sequence[float]) -> dict[str, float]:
    total = sum(weights)
    if total <= 0:
        return {s: float(s == "cosine") for s in PRESET_SIGNALS}
    return {s: w / total for s, w in zip(PRESET_SIGNALS, weights)}


def rerank(cands: DataFrame, weights: Sequence[float] | str = "journey", sort_mode: str = "composite_desc") -> DataFrame:
    """Re-rank over six signals with given or preset weights; ``sort_value`` is what the mode orders by."""
    chosen = preset_weights(PRESETS[weights] if isinstance(weights, str) else weights)
    cos = normalize_cosine(F.coalesce("score", F.lit(0.0)))
    values = {"cosine": cos, **{s: _score(k) for s, k in SCORE_KEYS.items()}}
    total = None
    for signal in PRESET_SIGNALS:
        term = F.lit(chosen[signal]) * values[signal]
        total = term if total is None else total + term
    shown = {"cosine": "cos_norm", "nima": "nima_val", "sharpness": "sharp_val", "contrast": "cont_val",
             "colorfulness": "color_val", "technical": "tech_val"}
    ranked = cands.withColumn("composite_rank", round_to(total, 4)).withColumns(
        {shown[s]: round_to(values[s], 3) for s in PRESET_SIGNALS}
    )
    return ranked.withColumn("sort_value", F.col(SORT_COLUMNS.get(sort_mode, "composite_rank")))


def filter_by_name(cands: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the file name; blank text keeps everything."""
    wanted = text.strip().lower()
    return cands.filter(F.lower(name_of(F.col("file_path"))).contains(wanted)) if wanted else cands


def compare_strategies(cands: DataFrame, strategies: dict[str, Sequence[float]] | None = None,
                       keys: Sequence[str] = ("job_id",), n: int = 10) -> DataFrame:
    """Top ``n`` of each weighting side by side: one row per key and rank, one path column per strategy.

    The strategies are literals, so each candidate carries its own copies and nothing is joined.
    """
    strategies = strategies or PRESETS
    cos = normalize_cosine(F.coalesce("score", F.lit(0.0)))
    values = {"cosine": cos, **{s: _score(k) for s, k in SCORE_KEYS.items()}}
    entries = []
    for name, weights in strategies.items():
        chosen = preset_weights(weights)
        total = None
        for signal in PRESET_SIGNALS:
            term = F.lit(chosen[signal]) * values[signal]
            total = term if total is None else total + term
        entries.append(F.struct(F.lit(name).alias("strategy"), round_to(total, 4).alias("composite_rank")))
    spread = cands.select(*keys, "candidate_key", "file_path", "score", "seq", F.explode(F.array(*entries)).alias("_s"))
    scored = spread.select(*keys, "candidate_key", "file_path", "score", "seq", "_s.*")
    ranked = top_n(scored, [*keys, "strategy"], [F.desc("composite_rank"), F.asc("seq")], n)
    return ranked.groupBy(*keys, "rank").pivot("strategy", list(strategies)).agg(F.first("candidate_key"))


def diversity_penalty(cands: DataFrame, keys: Sequence[str] = ("job_id",), place: str = "place", vector: str = "vector",
                      threshold: float = 0.85) -> DataFrame:
    """Halve the rank once for each better-placed candidate with cosine above ``threshold``.

    Described in the reference's documents only. ``place`` is the 0-based rank position per key.
    """
    counted = better_neighbour_counts(cands, keys, place, vector, lambda a, b: (a @ b.T) > threshold, "similar_before",
                                      reach=math.sqrt(max(0.0, 2.0 * (1.0 - threshold))))
    return counted.withColumn("adjusted_rank", F.col("composite_rank") * F.pow(F.lit(0.5), F.col("similar_before")))
