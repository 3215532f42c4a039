"""Phrase collocations by best-first branch-and-bound growth (operator 11).

A phrase scores floor(1000 * a * n / (l * r)) at its worst cut; a, l and r count it and its two parts, n all words of its language.
As no part occurs less often than the phrase, floor(1000 * n / f(first word)) bounds the score of everything that grows from a word.

1. One pass counts words. Words of fewer than ``least`` occurrences end every phrase, so from here on they act like separators.
2. The frontier is all words in order of their bounds, best first, expanded in three steps (``RUNGS``). A step counts the pairs that
   its roots begin, grows the frequent pairs to ``longest`` words, each prefix only while it occurs ``least`` times, and keeps for each
   phrase its most frequent one-word extension on either side: if a longer phrase occurs as often, so does one of these.
3. Parts that begin with words not yet expanded are counted in a pass of their own, for phrases that can still reach the result.
4. A language is settled when its ``top``-th surviving score is above the bounds of all words left, so ties are all seen; the words
   that could still matter are the roots of the next step, others are never expanded.

Tasks find phrases through bit filters whose size follows what they hold, up to 2^``MOST_BITS`` bits. A filter never misses; what it lets
through too much is dropped by exact joins on the words. So results are exact at any size.

Null texts and texts without words count nothing; a null lang is ``und``. Repeated rows count each. Texts of any length are read in parts cut at
separators. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, row_steps, span_hashes, stored, text_buffer

#: Shares of a language's words that the first and second step may expand; the third has no bound.
RUNGS = (1 / 8, 1 / 2)
#: Bytes handled at once; bits of a filter for each entry, the fewest and the most (as powers of two).
STEP, ENTRY_BITS, LEAST_BITS, MOST_BITS = 8 << 20, 16, 16, 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed characters of the contract: white space between words (1), and those that end a piece (2).
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_CHAIN = np.uint64(0x2545F4914F6CDD1D)


class Words:
    """Words of some texts in order: ``entry`` numbers in ``entries`` (distinct words), ``piece`` numbers, ``row``, hashes with the language."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: pa.Array) -> None:
        n, kind = len(data), _KIND[data]
        letter = kind == 0
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        begins = np.flatnonzero(letter & ~(np.concatenate([[False], letter[:-1]]) & ~edge[:n])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(letter & ~(np.concatenate([letter[1:], [False]]) & ~edge[1:])) + 1 if n else begins
        self.row = np.searchsorted(starts, begins, side="right") - 1
        # a piece ends where a stop stands between two words: mostly beside one of them
        new = np.ones(len(begins), bool)
        if len(begins) > 1:
            gap = begins[1:] - ends[:-1]
            new[1:] = (self.row[1:] != self.row[:-1]) | ((gap > 0) & ((kind[ends[:-1]] == 2) | (kind[begins[1:] - 1] == 2)))
            wide = np.flatnonzero(~new[1:] & (gap > 2))
            if len(wide):
                new[wide + 1] = np.maximum.reduceat(kind, np.column_stack([ends[wide], begins[wide + 1]]).ravel())[::2] == 2
        self.piece = np.cumsum(new)
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]])])
        coded = packed.dictionary_encode()
        self.entry, self.entries = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.lang = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        own, other = (span_hashes(*_spans(v), seed) for seed, v in enumerate((self.entries, self.langs.dictionary)))
        self.hash = mix(own[self.entry] ^ other[self.lang])

    def follows(self, steps: int) -> np.ndarray:
        """Whether the word so many places on stands in the same piece."""
        out = np.zeros(len(self.piece), bool)
        if len(out) > steps:
            out[: len(out) - steps] = self.piece[steps:] == self.piece[: len(out) - steps]
        return out

    def chained(self, sums: np.ndarray, steps: int) -> np.ndarray:
        """Hashes of phrases one word longer: ``sums`` are those of the first ``steps`` words at each place."""
        out = np.zeros(len(sums), np.uint64)
        if len(out) > steps:
            out[: len(out) - steps] = mix(sums[: len(out) - steps] * _CHAIN + self.hash[steps:])
        return out

    def taken(self, at: np.ndarray, real: np.ndarray) -> pa.Array:
        """Words at places, null where not ``real``."""
        numbers = self.entry[np.clip(at, 0, max(0, len(self.entry) - 1))] if len(at) else np.zeros(0, np.int64)
        return self.entries.take(pa.array(numbers, mask=~real))

    def counted(self, at: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None) -> pa.RecordBatch:
        """(lang, before, phrase, n) of the phrases of some sizes at places; ``before`` tells where the word before belongs to it."""
        parts = [self.taken(at + k, sizes > k) for k in range(int(sizes.max()) if len(sizes) else 1)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip") if len(parts) > 1 else parts[0]
        lang = self.langs.dictionary.take(pa.array(self.lang[at]))
        prior = self.taken(at - 1, before if before is not None else np.zeros(len(at), bool))
        rows = pa.table({"lang": lang, "before": prior.cast(pa.large_string()).cast(pa.string()), "phrase": phrase.cast(pa.large_string()).cast(pa.string())})
        found = rows.group_by(["lang", "before", "phrase"], use_threads=False).aggregate([([], "count_all")])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in (found[k] for k in ("lang", "before", "phrase", "count_all"))], ["lang", "before", "phrase", "n"])


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, starts = text_buffer(column)
    return data, starts[:-1], starts[1:]


def _parts(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, text bounds, first and last row of steps; a long text comes in several, cut behind a character that ends a piece."""
    for first, last in row_steps(starts, STEP):
        at, end = int(starts[first]), int(starts[last])
        if end - at <= 2 * STEP:
            yield data[at:end], starts[first : last + 1] - at, first, last
            continue
        while at < end:
            cut = min(at + STEP, end)
            while cut < end:
                found = np.flatnonzero(_KIND[data[cut : min(cut + 65_536, end)]] == 2)
                if len(found):
                    cut += int(found[0]) + 1
                    break
                cut = min(cut + 65_536, end)
            yield data[at:cut], np.array([0, cut - at]), first, last
            at = cut


def scan(docs: DataFrame, pick: Callable[[Words], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, before, phrase, n): what ``pick`` counts in the words of all texts, summed up for each step only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            for part, bounds, first, last in _parts(data, starts):
                yield from pick(Words(part, bounds, batch.column(0).slice(first, last - first)))

    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, "lang string, before string, phrase string, n long")


class PhraseFilter:
    """A bit for each hash of some phrases: whatever was put in passes, little else does."""

    def __init__(self, phrases: DataFrame) -> None:
        """``phrases``: lang, phrase. The bits are united on the executors; the driver gets at most 2^``MOST_BITS`` of them."""
        size = max(1, phrases.count() * ENTRY_BITS)
        self.power = power = min(max(LEAST_BITS, size.bit_length()), MOST_BITS)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    slots = phrase_hashes(batch.column(0), batch.column(1)) >> np.uint64(64 - power)
                    masks = (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(masks)], ["word", "mask"])

        found = phrases.select("lang", "phrase").mapInArrow(work, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        bits = np.zeros(1 << power - 6, np.uint64)
        bits[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
        self.shared = phrases.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"power": self.power, "shared": self.shared}

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> np.uint64(64 - self.power)
        return (self.shared.value[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hash of each phrase, as a scan finds it."""
    data, starts = text_buffer(phrases)
    words = Words(data[starts[0] : starts[-1]], starts - starts[0], langs)
    first = np.searchsorted(words.row, np.arange(len(phrases)))
    size = np.diff(np.append(first, len(words.row)))
    sums = words.hash[first]
    for k in range(1, int(size.max())):
        longer = np.flatnonzero(size > k)
        sums[longer] = mix(sums[longer] * _CHAIN + words.hash[first[longer] + k])
    return sums


def _score(a: str, n: str, part_l: str, part_r: str) -> Column:
    """Exact: products take up to 38 digits."""
    whole = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(cast(1000 as decimal(4,0)) * {whole(a)} * {whole(n)}) div ({whole(part_l)} * {whole(part_r)})")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""

    def pick(words: Words) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(words.lang * len(words.entries) + words.entry, return_counts=True)
        lang = words.langs.dictionary.take(pa.array(keys // max(1, len(words.entries))))
        word = words.entries.take(pa.array(keys % max(1, len(words.entries)))).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.nulls(len(keys), pa.string()), word, pa.array(counts)], ["lang", "before", "phrase", "n"])

    return scan(docs, pick).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def pair_counts(docs: DataFrame, frequent: PhraseFilter, roots: PhraseFilter) -> DataFrame:
    """(lang, phrase, a) of pairs of frequent words, of which the first is a root (and of few others)."""

    def pick(words: Words) -> Iterator[pa.RecordBatch]:
        common = frequent.passes(words.hash)
        at = np.flatnonzero(words.follows(1) & common & roots.passes(words.hash))
        at = at[common[at + 1]] if len(at) else at
        yield words.counted(at, np.full(len(at), 2))

    return scan(docs, pick).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def occurrences(docs: DataFrame, frequent: PhraseFilter, pairs: PhraseFilter, longest: int) -> DataFrame:
    """(lang, before, phrase, n): every place of the pairs, grown to ``longest`` frequent words, with the frequent word before it."""

    def pick(words: Words) -> Iterator[pa.RecordBatch]:
        common = frequent.passes(words.hash)
        at = np.flatnonzero(words.follows(1) & pairs.passes(words.chained(words.hash, 1)))
        size, grows = np.full(len(at), 2), np.ones(len(at), bool)
        for k in range(2, longest):
            grows &= words.follows(k)[at]
            grows[grows] = common[at[grows] + k]
            size += grows
        before = at > 0
        before[before] = (words.piece[at[before] - 1] == words.piece[at[before]]) & common[at[before] - 1]
        yield words.counted(at, size, before)

    return scan(docs, pick).groupBy("lang", "before", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, wanted: PhraseFilter, longest: int) -> DataFrame:
    """(lang, phrase, r) of the phrases of 2 to ``longest`` words that pass the filter."""

    def pick(words: Words) -> Iterator[pa.RecordBatch]:
        sums = words.hash
        for size in range(2, longest + 1):
            sums = words.chained(sums, size - 1)
            at = np.flatnonzero(words.follows(size - 1) & wanted.passes(sums))
            yield words.counted(at, np.full(len(at), size))

    return scan(docs, pick).groupBy("lang", "phrase").agg(F.sum("n").alias("r"))


def _grown(places: DataFrame, pairs: DataFrame, least: int, longest: int, percent: int) -> DataFrame:
    """(lang, phrase, size, a, survives) of the frequent prefixes of all places that begin with one of ``pairs``."""
    size = F.size(F.split("phrase", " "))
    each = places.withColumn("size", F.explode(F.sequence(F.lit(2), size))).withColumn("phrase", F.expr("substring_index(phrase, ' ', size)"))
    sides = each.groupBy("lang", "phrase", "size", "before").agg(F.sum("n").alias("n"))
    counts = sides.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"), F.max(F.when(F.col("before").isNotNull(), F.col("n"))).alias("wider"))
    known = pairs.select("lang", F.col("phrase").alias("pair"))
    counts = counts.where(F.col("a") >= least).withColumn("pair", F.substring_index("phrase", " ", 2)).join(known, ["lang", "pair"], "left_semi")
    counts = stored(counts.drop("pair"), "grown")
    parent = F.expr("substring_index(phrase, ' ', size - 1)")
    ahead = counts.where("size > 2").select("lang", parent.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("ahead"))
    most = F.greatest(F.coalesce("wider", F.lit(0)), F.coalesce("ahead", F.lit(0)))
    dropped = (F.col("size") < longest) & (most >= least) & (most * 100 >= F.col("a") * percent)
    return counts.join(ahead, ["lang", "phrase"], "left").select("lang", "phrase", "size", "a", (~dropped).alias("survives"))


def mine(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` surviving phrases of each language.

    A phrase is dropped if a longer candidate holds it that has ``percent`` hundredths of its count or more.
    """
    vocabulary = stored(word_counts(docs), "words")
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = vocabulary.where(F.col("f") >= least)
    # the bound falls as f grows: words of one count are expanded together
    upto = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    shares = frequent.groupBy("lang", "f").agg(F.sum("f").alias("of")).join(totals, "lang")
    share = F.coalesce(F.sum("of").over(upto), F.lit(0)) / F.col("n")
    rung = F.when(share < RUNGS[0], 0).when(share < RUNGS[1], 1).otherwise(2)
    words = stored(frequent.join(shares.select("lang", "f", "n", rung.alias("rung")), ["lang", "f"]), "frequent")
    if words.isEmpty():
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    common = PhraseFilter(words)
    known = words.select("lang", "phrase", F.col("f").alias("count"))
    found, floors = None, None
    for step in range(len(RUNGS) + 1):
        roots = words.where(F.col("rung") == step)
        if floors is not None:
            above = F.expr("cast(coalesce(floor, 0) as decimal(19,0)) * cast(f as decimal(19,0)) <= 1000 * cast(n as decimal(19,0))")
            roots = roots.join(floors, "lang", "left").where(above)
        roots = stored(roots.select("lang", "phrase"), "roots")
        if roots.isEmpty():
            continue
        pairs = pair_counts(docs, common, PhraseFilter(roots)).where(F.col("a") >= least)
        first = F.substring_index("phrase", " ", 1)
        pairs = stored(pairs.withColumn("first", first).join(roots.withColumnRenamed("phrase", "first"), ["lang", "first"], "left_semi"), "pairs")
        if pairs.isEmpty():
            continue
        grown = stored(_grown(occurrences(docs, common, PhraseFilter(pairs), longest), pairs, least, longest, percent), "phrases")
        known = known.unionByName(grown.select("lang", "phrase", F.col("a").alias("count")))
        scored = stored(_scored(docs, grown, known, totals, floors, longest), "scored")
        found = scored if found is None else found.unionByName(scored)
        order = Window.partitionBy("lang").orderBy(F.desc("score"))
        floors = stored(found.where("survives").select("lang", "score", F.row_number().over(order).alias("k")).where(F.col("k") == top).select("lang", F.col("score").alias("floor")), "floors")
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.where("survives").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(docs: DataFrame, grown: DataFrame, known: DataFrame, totals: DataFrame, floors: DataFrame | None, longest: int) -> DataFrame:
    """``grown`` with l, r, n and the score of the lowest cut. Phrases that an already known cut puts below ``floors`` are left out."""
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = grown.join(totals, "lang").withColumn("k", cut).withColumn("front", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(front) + 2)"))
    lefts = known.select("lang", F.col("phrase").alias("front"), F.col("count").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    cuts = stored(cuts.join(lefts, ["lang", "front"]).join(rights, ["lang", "rest"], "left"), "cuts")
    lost = cuts.where("r is null")
    if floors is not None:
        partly = cuts.where("r is not null").groupBy("lang", "phrase").agg(F.min(_score("a", "n", "l", "r")).alias("bound"))
        low = partly.join(floors, "lang").where("bound < floor").select("lang", "phrase")
        cuts = cuts.join(low, ["lang", "phrase"], "left_anti")
        lost = cuts.where("r is null")
    lost = stored(lost.select("lang", F.col("rest").alias("phrase")).distinct(), "lost")
    if not lost.isEmpty():
        more = phrase_counts(docs, PhraseFilter(lost), longest - 1).select("lang", F.col("phrase").alias("rest"), F.col("r").alias("more"))
        cuts = cuts.join(more.join(lost.withColumnRenamed("phrase", "rest"), ["lang", "rest"], "left_semi"), ["lang", "rest"], "left")
        cuts = cuts.withColumn("r", F.coalesce("r", "more"))
    lowest = F.min(F.struct(_score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "a", "n", "survives").agg(lowest)
    return best.select("lang", "phrase", "a", "n", "survives", "cut.l", "cut.r", "cut.score")
