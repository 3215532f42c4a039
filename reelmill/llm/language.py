"""Language identification by bit-sliced n-gram filters (operator 3).

Each language has a Bloom filter of its typical character n-grams. All filters share their hash functions and lie bit by bit next to
each other: a slot holds one bit per language, and the AND of an n-gram's slots is the set of all languages that contain
it. A text's votes are the popcounts per language over its n-grams, corrected for each filter's false positives
(n grams give n * rate of them), and the largest share wins.

Filters are fitted on a bounded sample of labelled texts (about ``SAMPLE_DOCS`` of each language, or all if it has fewer, chosen by
hash; the shares come from counts of the labelled rows). An n-gram belongs to each language
in which it is common enough: at least ``LEAST_SHARE`` of its rate in the language that has it most, among that
language's ``GRAMS_PER_LANGUAGE`` most frequent. A slot has as many 64-bit words as the languages need.

A null text, or one without a letter, is ``und`` with score 0. Texts without a known n-gram get the language most frequent among
the labelled rows, with score 0. Ties go to the language that sorts first. With nothing to learn from, all are ``und``. Equal rows get equal
rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, row_steps, text_buffer

GRAM, SAMPLE_DOCS, GRAMS_PER_LANGUAGE, LEAST_SHARE = 4, 20_000, 100_000, 0.5
SLOTS, HASHES = 1 << 20, 3

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-cased letters and word ends, their text, and whether each text has a letter.

    Everything but letters counts as one word end; n-grams of two word ends in a row are left out.
    """
    # two word ends between texts keep n-grams inside them
    points = np.frombuffer("  ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    sizes = np.array([len(t.lower()) for t in texts], np.int64) + 2
    starts = np.cumsum(sizes) - sizes + 2
    codes = np.where(letter, points, 32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    value = np.zeros(n, np.uint64)
    for k in range(GRAM):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    pause = ~letter[:-1] & ~letter[1:]
    double = np.zeros(n, bool)
    for k in range(GRAM - 1):
        double |= pause[k : k + n]
    place = np.flatnonzero(~double)
    owner = np.searchsorted(starts, place + 1, side="right") - 1  # a gram may begin with the word end before the text
    count = np.concatenate([[0], np.cumsum(letter)])
    return mix(value[place]), owner, count[starts + sizes - 2] > count[starts]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    default: int

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray], default: int) -> "LanguageFilters":
        bits, kind = next(((b, t) for b, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= b), (64, np.uint64))
        slots = np.zeros((-(-len(languages) // bits), SLOTS), kind)
        for number, own in enumerate(grams):
            for at in _slots(own):
                slots[number // bits, at] |= kind(1 << number % bits)
        fill = np.array([np.count_nonzero(slots[n // bits] & kind(1 << n % bits)) / SLOTS for n in range(len(languages))])
        return cls(languages, slots, fill**HASHES, default)

    def votes(self, grams: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Corrected counts of each text's n-grams in each language."""
        masks = np.bitwise_and.reduce([self.slots[:, at] for at in _slots(grams)])
        bits = 8 * masks.dtype.itemsize
        total = np.bincount(owner, minlength=texts)
        found = np.empty((texts, len(self.languages)))
        for number, rate in enumerate(self.rates):
            raw = np.bincount(owner[(masks[number // bits] & masks.dtype.type(1 << number % bits)) != 0], minlength=texts)
            found[:, number] = np.maximum(0, raw - total * rate) / (1 - rate)
        return found


def fit_filters(docs: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters | None:
    """Filters from text and lang of the rows where ``training`` holds, about ``sample_docs`` of each language. None if there are no such rows."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = {r["lang"]: r["count"] for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    if not labelled:
        return None
    least = {lang: int(min(1.0, sample_docs / n) * (1 << 40)) + 1 for lang, n in labelled.items()}
    bound = F.create_map(*[F.lit(x) for item in least.items() for x in item])[F.col("lang").cast("string")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 40)) < bound).select(F.col("lang").cast("string"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = [t for t, x in zip(batch.column(1).to_pylist(), langs) if x == lang]
                grams, _, _ = text_grams(texts)
                values, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(values) + 1)), pa.array(np.append(values.view(np.int64), 0)), pa.array(np.append(counts, 0)), pa.array([*[0] * len(values), len(texts)])],
                    ["lang", "gram", "n", "docs"],
                )

    counts = sample.mapInArrow(count, "lang string, gram long, n long, docs long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).persist()
    try:
        totals = {r["lang"]: (r["n"], r["docs"]) for r in sums.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
        languages = sorted(totals)
        rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(1.0 / max(1, totals[lang][0])))])[F.col("lang")]
        best = sums.groupBy("gram").agg(F.max(F.col("n") * rate).alias("best"))
        typical = sums.join(best, "gram").where((F.col("n") > 1) & (F.col("n") * rate >= LEAST_SHARE * F.col("best")))
        grams = []
        for lang in languages:
            top = typical.where(F.col("lang") == lang).orderBy(F.col("n").desc(), "gram").limit(GRAMS_PER_LANGUAGE).select("gram").toArrow()
            grams.append(top["gram"].to_numpy().astype(np.int64).view(np.uint64))
    finally:
        sums.unpersist()
    return LanguageFilters.build(languages, grams, int(np.argmax([labelled[lang] for lang in languages])))


def identify(docs: DataFrame, filters: LanguageFilters | None) -> DataFrame:
    """doc_id, lang_pred, score of each row; only ``text`` decides."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, starts = text_buffer(batch.column(1))
            for first, last in row_steps(starts):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                grams, owner, worded = text_grams(texts)
                if filters is None:
                    pred, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    votes = filters.votes(grams, owner, len(texts))
                    best, total = votes.argmax(axis=1), votes.sum(axis=1)
                    score = np.where((total > 0) & worded, votes.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                    best = np.where(total > 0, best, filters.default)
                    pred = [filters.languages[b] if w else "und" for b, w in zip(best, worded)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, lang_pred string, score double")
