"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives and unlabelled web text train a linear scorer that minimises the non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])     with the logistic loss l,
so the unlabelled rows stand for the negatives less their expected share of positives. Rows labelled negative are not used.
The class prior is estimated from the same rows: a first scorer separates positives from unlabelled rows, and over its
thresholds the least ratio of unlabelled to positive rows above (with an allowance for chance) bounds the share of positives.

Features are shares of byte classes and of repeated words, for the whole text. Both samples are bounded (about ``SAMPLE_DOCS``
rows each, chosen by hash); training runs on their features only.

Null texts count as empty; their features are zero and they are scored like any text. Without positives or texts every score is 0.5. Equal
texts get equal scores. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, mix, row_steps, text_buffer

SAMPLE_DOCS, STEPS, RATE, DECAY = 20_000, 800, 0.05, 1e-4

_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b"\t\n\r\x0b\x0c", b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{}~", b"|", range(128, 256)), 1):
    _KINDS[[*_bytes]] = _kind
_N_KINDS = 11
FEATURES = _N_KINDS + 6


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of features for each text of a byte buffer."""
    data, starts = data[starts[0] : starts[-1]], starts - starts[0]
    rows, sizes = len(starts) - 1, np.diff(starts)
    found = np.zeros((rows, FEATURES))
    row = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(row * _N_KINDS + _KINDS[data], minlength=rows * _N_KINDS).reshape(rows, _N_KINDS)
    found[:, :_N_KINDS] = kinds / np.maximum(1, sizes)[:, None]
    blank = (_KINDS[data] == 4) | (_KINDS[data] == 5)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    begins = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    if len(begins):
        owner = row[begins]
        words = np.bincount(owner, minlength=rows)
        value = PrefixHash(data).of(begins, ends) ^ mix(owner.astype(np.uint64))
        again = np.zeros(len(value), bool)
        again[1:] = value[1:] == value[:-1]
        distinct = np.bincount(owner[np.unique(value, return_index=True)[1]], minlength=rows)
        capital = (_KINDS[data[begins]] == 1) & (_KINDS[data[np.minimum(begins + 1, len(data) - 1)]] == 1)
        odd = (_KINDS[data[ends - 1]] >= 7) & (_KINDS[data[ends - 1]] <= 9)
        many = np.maximum(1, words)
        found[:, _N_KINDS] = np.bincount(owner, again, rows) / many
        found[:, _N_KINDS + 1] = np.where(words > 0, 1 - distinct / many, 0)
        found[:, _N_KINDS + 2] = np.bincount(owner, capital, rows) / many
        found[:, _N_KINDS + 3] = np.bincount(owner, odd, rows) / many
        found[:, _N_KINDS + 4] = np.bincount(owner, ends - begins, rows) / many / 10
        found[:, _N_KINDS + 5] = np.log1p(words) / 10
    return np.sqrt(found)


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            for first, last in row_steps(starts):
                x = features(data, starts[first : last + 1])
                column = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), column], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, x array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam over all rows at once."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from both groups' scores."""
    best = 1.0
    chance = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
    for t in np.quantile(positive, np.linspace(0.02, 0.9, 45)):
        above_p, above_u = (positive >= t).mean(), (unlabelled >= t).mean()
        best = min(best, (above_u + 0.5 * chance) / above_p)
    return float(min(max(best, 0.01), 0.99))


@dataclass
class QualityModel:
    centre: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_lifted((x - self.centre) / self.width) @ self.weights)


def _lifted(z: np.ndarray) -> np.ndarray:
    """Each feature, its square and one: a text can be too far out on either side."""
    z = np.clip(z, -8, 8)
    return np.hstack([z, z**2 / 4, np.ones((len(z), 1))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> QualityModel:
    centre, width = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = _lifted((positive - centre) / width), _lifted((unlabelled - centre) / width)
    if prior is None:
        # a plain classifier of positives against unlabelled rows; its order is all that counts
        w = _descend(lambda w: -p.T @ _sigmoid(-p @ w) / len(p) + u.T @ _sigmoid(u @ w) / len(u), p.shape[1])
        prior = estimate_prior(p @ w, u @ w)

    def risk(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        loss_u, loss_p = np.logaddexp(0, gu).mean(), np.logaddexp(0, gp).mean()
        negative = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        if loss_u - prior * loss_p < 0:
            return -negative  # step back until the negative part of the risk is one again
        return prior * -(p.T @ _sigmoid(-gp)) / len(p) + negative

    return QualityModel(centre, width, _descend(risk, p.shape[1]), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, prior: float | None = None) -> QualityModel | None:
    """Learn from the labels of rows where ``training`` (on doc_id) holds. None if there is no positive or no text."""
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    trusted = labels.where((F.col("quality") == 1) & training).select(F.col("doc_id").cast("long")).distinct()
    part = min(1.0, sample_docs / max(1, trusted.count()))
    trusted = trusted.where(pick < int(part * 1_000_000) + 1)
    share = min(1.0, sample_docs / max(1, docs.count()))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    # the sample bounds the broadcast: about sample_docs ids of eight bytes
    positive = feature_rows(texts.join(F.broadcast(trusted), "doc_id")).select("x").toArrow()
    unlabelled = feature_rows(texts.where(training & (pick < int(share * 1_000_000) + 1))).select("x").toArrow()
    if not positive.num_rows or not unlabelled.num_rows:
        return None
    p, u = (t["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) for t in (positive, unlabelled))
    order = [np.lexsort(x.T) for x in (p, u)]  # sums don't depend on the order of arrival
    return fit(p[order[0]], u[order[1]], prior)


def score(docs: DataFrame, model: QualityModel | None, columns: list[str] | None = None) -> DataFrame:
    """Each row's doc_id (or ``columns``) and its score."""
    names = columns or ["doc_id"]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"]))
    at = source.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(at))
            for first, last in row_steps(starts):
                n = last - first
                found = np.full(n, 0.5) if model is None else model.scores(features(data, starts[first : last + 1]))
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(found)], [*names, "__score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[: len(names)])
    return source.mapInArrow(work, fields + ", `__score` double")
