"""Alignment of two tokenizers over a corpus by an identity map and a pair shuffle of the rest (operator 12).

1. ``aligned`` encodes each text with both tokenizers and cuts it into groups where both have a token end. Token ends are running
   sums of token sizes, so groups and overlapping pairs come from sorted arrays without a loop over tokens.
2. The identity map gives for each id of A the id of B with the same bytes. Groups that are exactly such a pair are counted in a vector
   as long as A's vocabulary, of which a task hands on one sum; only pairs of other groups enter the pair shuffle.
3. A second pass over the written groups adds up the counts: identity pairs and the ``HOT_PAIRS`` most frequent others through tables
   of bounded size, all rarer pairs by a join, in which no key holds more than its own few documents.

A pair counts once for each document that holds it linked, however often. Texts that are null or empty, or whose tokens do not give back
a space and the text (the second tokenizer normalises, or the text holds its space mark), have no tokens: zeros and an empty string. Repeated rows count each.
Texts of any length are encoded whole. A null doc_id stays. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_steps, stored, text_buffer
from .packing import FormTokenizer, read_ranks

#: Pairs whose counts every task of the second pass holds; bytes of text handled in a step; pairs held in a task before they are handed on.
HOT_PAIRS, TEXT_STEP, HELD_PAIRS = 200_000, 2 << 20, 1 << 20


class Vocabulary:
    """Bytes of each id of a tokenizer, one after another, with their sizes and offsets."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes = self.sizes[ids]
        after = np.cumsum(sizes)
        return self.pool[np.repeat(self.offsets[ids] - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)]


def rank_tokens(path: str) -> list[bytes]:
    """Token bytes by id of a rank file."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def piece_tokens(path: str) -> list[bytes]:
    """Token bytes by id of a sentencepiece model; control and unknown pieces have none."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            tokens.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            tokens.append(b"")
        else:
            tokens.append(piece.replace("▁", " ").encode())
    return tokens


def identity_map(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """For each id of the first vocabulary the smallest id of the second with the same bytes, else -1."""
    ids: dict[bytes, int] = {}
    for i, token in enumerate(second):
        if token:
            ids.setdefault(token, i)
    return np.array([ids.get(token, -1) for token in first], np.int64)


class PairEncoder:
    """Both tokenizers and their vocabularies, loaded once by a Python worker."""

    _of: dict[tuple, "PairEncoder"] = {}

    def __init__(self, tokenizer: str, ranks: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor

        first, second = rank_tokens(ranks), piece_tokens(pieces)
        self.forms = FormTokenizer.at(tokenizer, ranks, specials=False)
        self.model = SentencePieceProcessor(model_file=pieces)
        self.a, self.b, self.identity = Vocabulary(first), Vocabulary(second), identity_map(first, second)
        digits = np.zeros((max(len(first), len(second)), 8), np.uint8)
        for i in range(len(digits)):
            text = str(i).encode()
            digits[i, : len(text)] = np.frombuffer(text, np.uint8)
        #: decimal form of each id, and where the mark behind it begins
        self.digits, self.shift = digits.view(np.uint64).ravel(), (digits != 0).sum(axis=1).astype(np.uint64) * np.uint64(8)

    @classmethod
    def at(cls, *paths: str) -> "PairEncoder":
        if paths not in cls._of:
            cls._of[paths] = cls(*paths)
        return cls._of[paths]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers over all texts, and how many each text has; none where the bytes are not a space and the text."""
        whole = pa.array([" " + t if t else "" for t in texts], pa.large_string())
        data, starts = text_buffer(whole)
        data, starts = data[starts[0] : starts[-1]], starts - starts[0]
        first = self.forms.encode(data, starts)
        second = [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
        sizes = np.diff(starts)
        good = np.ones(len(texts), bool)
        for vocabulary, lists in ((self.a, first), (self.b, second)):
            counts = np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate([x.astype(np.int64) for x in lists]) if counts.sum() else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[np.cumsum(counts)]
            same = np.diff(ends, prepend=0) == sizes
            good &= same
            owner = np.repeat(same, counts)
            made, kept = vocabulary.joined(ids[owner]), data[np.repeat(same, sizes)]
            wrong = np.flatnonzero(made != kept)
            if len(wrong):
                rows = np.flatnonzero(same)
                good[rows[np.searchsorted(np.cumsum(sizes[rows]), wrong, side="right")]] = False
        none = np.zeros(0, np.int64)
        first = [x.astype(np.int64) if g else none for x, g in zip(first, good)]
        second = [x if g else none for x, g in zip(second, good)]
        return (
            np.concatenate([none, *first]), np.array([len(x) for x in first], np.int64),
            np.concatenate([none, *second]), np.array([len(x) for x in second], np.int64),
        )


class Groups:
    """Groups and links of some texts: ``a``, ``b`` are their ids one after another, ``n_a``, ``n_b`` how many each text has."""

    def __init__(self, encoder: PairEncoder, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        self.encoder, self.a, self.b, self.n_a, self.n_b = encoder, a, b, n_a, n_b
        ends_a, ends_b = np.cumsum(encoder.a.sizes[a]), np.cumsum(encoder.b.sizes[b])
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.concatenate([ends[1:] != ends[:-1], np.ones(min(1, len(ends)), bool)])]
        # one link for each stretch between two ends: the tokens of both sides that hold it
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a if len(b) else np.zeros(0, bool)
        shared_b = ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)] == ends_b if len(a) else np.zeros(0, bool)
        self.group_a, self.group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        total = int(shared_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=total), np.bincount(self.group_b, minlength=total)
        owner = np.repeat(np.arange(len(n_a)), n_a)
        self.text = owner[self.link_a]
        self.n_groups = np.bincount(owner[shared_a], minlength=len(n_a))
        self.n_links = np.bincount(self.text, minlength=len(n_a))
        group = self.group_a[self.link_a]
        single = (self.size_a[group] == 1) & (self.size_b[group] == 1)
        self.plain = single & (encoder.identity[a[self.link_a]] == b[self.link_b])

    def text_forms(self) -> list[bytes]:
        """The groups of each text in decimal: ids of A, ids of B, group after group."""
        encoder = self.encoder
        before_b, before_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        place_a = np.arange(len(self.a)) + before_b[self.group_a]
        place_b = np.arange(len(self.b)) + before_a[self.group_b]
        last_a, last_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        last_a[:-1] = self.group_a[1:] != self.group_a[:-1]
        last_b[:-1] = self.group_b[1:] != self.group_b[:-1]
        words, sizes = np.zeros(len(self.a) + len(self.b), np.uint64), np.zeros(len(self.a) + len(self.b), np.int64)
        for ids, place, last, mark in ((self.a, place_a, last_a, b"|"), (self.b, place_b, last_b, b";")):
            marks = np.where(last, np.uint64(mark[0]), np.uint64(44))
            words[place] = encoder.digits[ids] | (marks << encoder.shift[ids])
            sizes[place] = (encoder.shift[ids] >> np.uint64(3)).astype(np.int64) + 1
        letters = words.view(np.uint8)
        raw = letters[letters != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [raw[begin : end - 1] if end > begin else b"" for begin, end in zip([0, *ends], ends)]

    def counted(self, chosen: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, key) of chosen links and how many links each has."""
        order = np.lexsort((key[chosen], self.text[chosen]))
        text, key = self.text[chosen][order], key[chosen][order]
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])[: len(text)])
        return text[first], key[first], np.diff(np.append(first, len(text)))


ALIGNED = (
    "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "plain binary, plain_links binary, other binary, other_links binary, other_new binary"
)


def aligned(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """One row per document: counts, the digest of its groups, its identity pairs and other pairs (packed integers) with their links.

    ``other_new`` marks pairs that count for this document; an identity pair that also overlaps elsewhere is counted once. ``uid`` is
    unique in the written table.
    """
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairEncoder.at(tokenizer, ranks, pieces)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            _, starts = text_buffer(batch.column(1))
            for first, last in row_steps(starts, TEXT_STEP):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = Groups(encoder, *encoder.encode(texts))
                digests = [hashlib.sha256(t).hexdigest() if t else "" for t in found.text_forms()]
                a, b = found.a[found.link_a], found.b[found.link_b]
                own, key, links = found.counted(np.flatnonzero(found.plain), a)
                own2, pair, links2 = found.counted(np.flatnonzero(~found.plain), (a << 32) | b)
                met = np.isin((own2 << 32) | (pair >> 32), (own << 32) | key) & (encoder.identity[pair >> 32] == pair & 0xFFFFFFFF)
                n = np.arange(len(texts) + 1)
                cuts, cuts2 = np.searchsorted(own, n), np.searchsorted(own2, n)
                packed = [_packed(key.astype("<i4"), cuts), _packed(links.astype("<i4"), cuts), _packed(pair.astype("<i8"), cuts2),
                          _packed(links2.astype("<i4"), cuts2), _packed(~met, cuts2)]
                columns = [np.arange(number, number + len(texts)), part.column(0), found.n_a, found.n_b, found.n_groups, found.n_links, digests]
                number += len(texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in [*columns, *packed]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, ALIGNED)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose entries are the bytes of values between cuts."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    data, starts = text_buffer(column)
    return data[starts[0] : starts[-1]].view(kind)


def identity_counts(groups: DataFrame, vocabulary: int) -> np.ndarray:
    """Documents that hold each identity pair in a group of its own: one vector per task, summed up by id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), "<i4"), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["a", "docs"])

    found = groups.select("plain").mapInArrow(work, "a long, docs long").groupBy("a").agg(F.sum("docs").alias("docs"))
    total = np.zeros(vocabulary, np.int64)
    for a, n in found.collect():  # at most one row per id
        total[a] = n
    return total


def pair_counts(groups: DataFrame) -> DataFrame:
    """(pair, docs): documents that hold a pair of another group linked; tasks sum up before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], ["pair", "docs"])

        for batch in batches:
            own = _flat(batch.column(0), "<i8")[_flat(batch.column(1), "u1").astype(bool)]
            held.append(own)
            size += len(own)
            if size >= HELD_PAIRS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return groups.select("other", "other_new").mapInArrow(work, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def align(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    spark = docs.sparkSession
    identity = identity_map(rank_tokens(ranks), piece_tokens(pieces))
    groups = stored(aligned(docs, tokenizer, ranks, pieces), "aligned")
    plain = identity_counts(groups, len(identity))
    others = stored(pair_counts(groups), "pairs")
    # an identity pair's documents are those of both counts; all tables by id have at most one row per id of A
    ids = [(int(a << 32 | b), int(a)) for a, b in enumerate(identity.tolist()) if b >= 0]
    pairs_of_ids = F.broadcast(spark.createDataFrame(ids, "pair long, a long"))
    total = np.where(identity >= 0, plain, 0)
    for a, n in others.join(pairs_of_ids, "pair").select("a", "docs").collect():
        total[a] += n
    counts = others.join(pairs_of_ids, "pair", "left_anti")
    best = total.copy()
    for a, n in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("n")).collect():
        best[a] = max(best[a], n)
    hot = counts.orderBy(F.desc("docs"), "pair").limit(HOT_PAIRS).collect()
    pairs, docs_of = (np.array([r[k] for r in hot], np.int64) for k in (0, 1))
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((identity, total, best, pairs[order], docs_of[order]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, total, best, pairs, docs_of = shared.value
        for batch in batches:
            ids, cuts = _rows_of(batch.column(7), "<i4")
            value, top = _weighed(ids, _flat(batch.column(8), "<i4"), cuts, total[ids], best[ids])
            other, cuts = _rows_of(batch.column(9), "<i8")
            first = other >> 32
            docs = np.where(identity[first] == other & 0xFFFFFFFF, total[first], _known_counts(other, pairs, docs_of))
            value2, top2 = _weighed(other, _flat(batch.column(10), "<i4"), cuts, docs, best[first])
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(top + top2), pa.array(value + value2)], [*kept, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity, _, best, pairs, docs_of = shared.value
        for batch in batches:
            other, cuts = _rows_of(batch.column(1), "<i8")
            rest = np.flatnonzero((_known_counts(other, pairs, docs_of) == 0) & (identity[other >> 32] != other & 0xFFFFFFFF))
            owner = batch.column(0).to_numpy()[np.repeat(np.arange(batch.num_rows), np.diff(cuts))[rest]]
            columns = [owner, other[rest], _flat(batch.column(2), "<i4")[rest].astype(np.int64), best[other[rest] >> 32]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "pair", "links", "best"])

    kept = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{c} {t}" for c, t in groups.select(*kept).dtypes)
    found = groups.select(*kept, "plain", "plain_links", "other", "other_links").mapInArrow(sums, schema + ", n_best long, count_sum long")
    if len(hot) == HOT_PAIRS:
        met = groups.select("uid", "other", "other_links").mapInArrow(rare, "uid long, pair long, links long, best long").join(counts, "pair")
        best_links = F.when(F.col("docs") == F.col("best"), F.col("links")).otherwise(0)
        tail = met.groupBy("uid").agg(F.sum(best_links).alias("more_best"), F.sum(F.col("docs") * F.col("links")).alias("more_sum"))
        found = found.join(tail, "uid", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _rows_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of all rows, and where each row begins (with the end)."""
    data, starts = text_buffer(column)
    return data[starts[0] : starts[-1]].view(kind).astype(np.int64), (starts - starts[0]) // np.dtype(kind).itemsize


def _known_counts(pairs: np.ndarray, known: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The count of each pair that a sorted table holds, else 0."""
    if not len(known):
        return np.zeros(len(pairs), np.int64)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    return np.where(known[at] == pairs, docs[at], 0)


def _weighed(keys: np.ndarray, links: np.ndarray, cuts: np.ndarray, docs: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sum of links times counts, and the links whose count is the best; unknown counts are 0 and add nothing."""
    value = np.concatenate([[0], np.cumsum(links * docs)])
    top = np.concatenate([[0], np.cumsum(np.where((docs == best) & (docs > 0), links, 0))])
    return value[cuts[1:]] - value[cuts[:-1]], top[cuts[1:]] - top[cuts[:-1]]
