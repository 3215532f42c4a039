"""Secret scan with false positives removed by a random forest (operator 2).

Candidates are runs of key characters with a digit (``LEAST`` or more long) and values assigned to a credential's name. Each is described
by its length, its character transitions (mean bigram surprise, and how often the class of character changes), how
much of it dictionary words cover, whether it lies in a path or link, and its neighbouring words. A random forest, trained from labelled
findings, gives the probability that a candidate is a secret.

The dictionary (the ``DICTIONARY`` most frequent words) and the bigrams are counted over all documents. The forest is fitted on weighted
findings, one for each different description and label; beyond ``SAMPLE_FINDINGS`` of them the light ones are a sample with raised
weights. Everything else covers all rows and whole texts.

Null and empty texts have no candidates. Equal rows give equal findings. With findings of one class only, every candidate
gets that class; without any, none is removed. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST, DICTIONARY, SAMPLE_FINDINGS, NEIGHBOUR_SLOTS = 12, 5000, 20_000, 32
TREES, DEPTH = 24, 6

_KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
_FROM_DIGIT = re.compile(r"[0-9][A-Za-z0-9_+/=-]*")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api_?key|access_?key)[ \t]{0,4}[=:][ \t]{0,4}[\"']?([^\s\"']{6,})")
_WORD = re.compile(r"[^\W\d_]+")


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of candidates, without overlaps."""
    found, done, next_ = [], 0, 0
    assigned = [m.span(1) for m in _ASSIGNED.finditer(text)]
    for m in _FROM_DIGIT.finditer(text):
        if m.start() < done:
            continue
        head = text[done : m.start()]
        begin = m.start() - (len(head) - len(head.rstrip(_KEY_CHARACTERS)))
        done = m.end()
        # both lists go forwards: values that end before this run can't meet a later one
        while next_ < len(assigned) and assigned[next_][1] <= begin:
            next_ += 1
        if done - begin >= LEAST and not (next_ < len(assigned) and assigned[next_][0] < done):
            found.append((begin, done))
    return sorted(found + assigned)


@dataclass
class Vocabulary:
    words: frozenset
    surprise: np.ndarray

    @classmethod
    def learn(cls, docs: DataFrame) -> "Vocabulary":
        """The most frequent words, and the letter bigrams of all words."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    seen.update(w for w in _WORD.findall((text or "").lower()) if 3 <= len(w) <= 16)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((128, 128), np.int64)
            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    codes = [min(127, ord(c)) for c in f" {word} "]
                    np.add.at(sums, (codes[:-1], codes[1:]), n)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["pair", "n"])

        counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = stored(counts, "words")
        top = counts.orderBy(F.col("n").desc(), "word").limit(DICTIONARY).collect()
        pairs = np.ones((128, 128))
        for row in counts.mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            pairs[divmod(row["pair"], 128)] += row["n"]
        return cls(frozenset(r["word"] for r in top), -np.log2(pairs / pairs.sum(axis=1, keepdims=True)))

    def describe(self, text: str, begin: int, end: int) -> list[float]:
        raw = text[begin:end]
        lower = raw.lower()
        codes = np.minimum(127, np.frombuffer(lower.encode("utf-32-le"), np.uint32))
        kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in raw]
        covered = at = 0
        while at < len(lower):
            size = next((n for n in range(min(16, len(lower) - at), 2, -1) if lower[at : at + n] in self.words), 0)
            covered += size
            at += size or 1
        n = len(raw)
        line = text.rfind("\n", max(0, begin - 300), begin) + 1 or max(0, begin - 300)
        before, after = text[line:begin], text[end : end + 60].split("\n")[0]
        last = before.rsplit(None, 1)[-1] if before.strip() else ""
        neighbours = [0.0] * NEIGHBOUR_SLOTS
        for word in _WORD.findall(before.lower())[-3:] + _WORD.findall(after.lower())[:2]:
            neighbours[crc32(word.encode()) % NEIGHBOUR_SLOTS] += 1
        return [
            float(n), float(self.surprise[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), covered / max(1, n),
            *[kinds.count(k) / max(1, n) for k in range(4)], len(set(raw)) / max(1, n),
            float("/" in raw or "\\" in raw), float("://" in last or last.endswith("/")), float(before.rstrip(" \t\"'").endswith(("=", ":"))), *neighbours,
        ]


def describe_candidates(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, begin, end, secret, x) of every candidate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, a, b, text[a:b], vocabulary.describe(text, a, b)) for a, b in (candidates(text) if text else ())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "begin", "end", "secret", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, begin int, end int, secret string, x array<double>"
    )


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, begin, end, length, probability and is_secret of every candidate.

    ``findings``: labelled (doc_id, begin, label); by default those that ``format_findings`` knows by their form.
    """
    described = stored(describe_candidates(docs, Vocabulary.learn(docs)), "candidates")
    findings = format_findings(described) if findings is None else findings
    known = described.join(findings.select("doc_id", "begin", "label").distinct(), ["doc_id", "begin"]).select("x", F.col("label").cast("double"))
    sample = bounded(stored(known.groupBy("x", "label").agg(F.count("*").cast("double").alias("weight")), "findings"))
    classes = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(classes) < 2:
        scored = described.withColumn("probability", F.lit(classes[0] if classes else 1.0))
    else:
        forest = RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="p")
        ordered = sample.orderBy("x", "label").coalesce(1)  # a bounded sample; the order makes the forest repeatable
        model = forest.fit(ordered.withColumn("v", array_to_vector("x")))
        scored = model.transform(described.withColumn("v", array_to_vector("x"))).withColumn("probability", vector_to_array("p")[1])
    return scored.select(
        "doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("length"), F.round("probability", 6).alias("probability"),
        (F.col("probability") >= least).alias("is_secret"),
    )


def bounded(weighted: DataFrame, most: int | None = None) -> DataFrame:
    """All rows of ``weighted`` (x, label, weight), or about ``most``: heavy rows stay, light ones are drawn by weight and then weigh the same."""
    most = SAMPLE_FINDINGS if most is None else most
    n, total = weighted.agg(F.count("*"), F.sum("weight")).first()
    if n <= most:
        return weighted
    least = total / most
    drawn = F.pmod(F.xxhash64("x", "label"), F.lit(1_000_000)) < F.col("weight") / least * 1_000_000
    return weighted.where(drawn).withColumn("weight", F.greatest("weight", F.lit(least)))


def format_findings(described: DataFrame) -> DataFrame:
    """Labels of candidates whose form leaves no doubt: known key formats and long hexadecimal values are secrets, plain numbers are not."""
    s = F.col("secret")
    key = s.rlike(r"^AKIA[0-9A-Z]{16}$") | (s.rlike(r"^[0-9a-f]{16,64}$") & s.rlike("[a-f]") & s.rlike("[0-9]"))
    plain = s.rlike(r"^[0-9-]+$") | s.rlike(r"^[A-Za-z]+-?[0-9]{1,4}$") | s.rlike(r"^[a-z]+(/[a-z0-9]+)+/?$")
    return described.where(key | plain).select("doc_id", "begin", F.when(key, 1).otherwise(0).alias("label"))
