"""A training corpus in five stages: quality, near duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a DataFrame; all but the last return the
columns of ``docs``. Null and empty texts pass through all filters that have nothing against them; packing gives
them one piece. Of equal rows with words one stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.llm import decontaminate, near_dups, packing, personal, quality
from reelmill.llm.common import stored, table, whole_rows
from reelmill.llm.queries import tokenizer_files

QUALITY_LEAST, SHINGLE_WORDS, NEAR_PERCENT, WINDOW_WORDS, HIT_SHARE, SEQUENCE_TOKENS, END_TOKEN = 0.3, 5, 80, 13, 20, 1024, 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the positive-unlabelled scorer accepts; it learns from all trusted positives among ``docs``."""
    named = docs.toDF(*[c if c in ("doc_id", "text") else f"c{n}" for n, c in enumerate(docs.columns)])
    model = quality.fit_quality(named, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull())
    good = quality.score(named, model, named.columns).where(F.col("__score") >= QUALITY_LEAST)
    return good.select(*named.columns).toDF(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a similarity of ``NEAR_PERCENT`` or more, that of the smallest doc_id."""
    found = near_dups.near_duplicates(docs, SHINGLE_WORDS, NEAR_PERCENT)
    keep = found.where("is_first").select("row").distinct()
    # rows without words are linked with nothing: they all stay, and meet nowhere
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    joined = whole_rows(docs.where(words)).join(keep, "row")
    first = joined.withColumn("number", F.row_number().over(Window.partitionBy("row").orderBy("row"))).where("number = 1")
    return first.select("whole.*").unionByName(docs.where(~words))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contamination rule leaves."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), WINDOW_WORDS, HIT_SHARE)
    return whole_rows(docs).join(found.where("contaminated").select("row"), "row", "left_anti").select("whole.*")


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows the text."""
    clean = personal.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents and their places in sequences."""
    return packing.pack(docs, *tokenizer_files(), capacity=SEQUENCE_TOKENS, end_id=END_TOKEN)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("pii", sanitised),
    ("best_fit_packing", packed),
]

#: The stages hold a trained model, hash forests and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
