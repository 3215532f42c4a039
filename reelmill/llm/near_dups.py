"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets (operator 7).

1. One pass turns each text into the set of its word shingles: size, a 128-bit digest of the set, and a signature of
   ``COLUMNS`` one-byte minima. Equal sets become one representative, so groups of copies cost one row from here on. Words are hashed
   with a random value for each byte at its place, shingles from their words; the digest holds two independent hashes of each shingle.
2. The forest: each order permutes the columns; representatives whose sorted signatures share a long enough prefix in an order are
   neighbours, and all pairs of such a group are held against each other by their whole signatures. The depth adapts to the region: it
   begins at ``prefix_depth`` columns; where a group holds more than ``GROUP_ROWS``, its rows descend by ``DESCENT`` columns, in as many
   more orders as a longer prefix needs to find a pair at the threshold as surely. At ``MOST_DEPTH`` columns, groups that are still
   crowded are split in blocks, and each pair of blocks is a task's work: nothing is left out.
3. Signatures that agree enough span families; a group emits only spanning links. A family is confirmed by full sets: all of
   its pairs are judged, in blocks of ``BLOCK_ROWS``. Only one link per joined class leaves a block.
4. Links give components; members get them through their set's digest.

Null texts and texts without words have an empty set and are linked with nothing. Fewer words than a shingle make
one shingle. Equal rows are linked. A null doc_id never names a component unless its component has no other. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_runs, groups_of, mix, row_key, row_steps, span_hashes, stored, text_buffer
from .components import connected_components

#: Signature columns, orders and most columns of the first depth; columns added by a descent, and where descents end.
COLUMNS, TREES, LEAST_DEPTH, DESCENT, MOST_DEPTH = 64, 16, 4, 4, 12
#: Following rows of a group that are compared before all others, and how far an agreement may fall below the threshold
#: (near four standard deviations of its estimate).
REACH, SLACK = 3, 0.19
#: Representatives that one block holds, of a family and of a group; split groups whose list may be broadcast.
BLOCK_ROWS, GROUP_ROWS, BROADCAST_GROUPS = 512, 2048, 100_000
#: Probability that no order brings a pair at the threshold together.
MISSED = 2e-5

_FACTORS = mix(np.arange(1, COLUMNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int, seeds: tuple[int, ...] = (0,)) -> Iterator[list[np.ndarray]]:
    """The distinct shingles of each text in a byte buffer: their 64-bit hashes, sorted by the first seed's, for each seed."""
    data = _LOWER[data[starts[0] : starts[-1]]]
    starts = starts - starts[0]
    n = len(data)
    letter = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.zeros(n, bool)
    before[1:] = letter[:-1]
    begins = np.flatnonzero(letter & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = letter[1:]
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    first = np.searchsorted(begins, starts)
    weights = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(words)]
    hashes = [span_hashes(data, begins, ends, seed) for seed in seeds]
    runs = []
    for own in hashes:
        sums = np.zeros(max(0, len(own) - words + 1), np.uint64)
        for k, weight in enumerate(weights):
            sums += own[k : k + len(sums)] * weight
        runs.append(mix(sums))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            least, at = np.unique(runs[0][a : b - words + 1], return_index=True)
            yield [least, *(other[a : b - words + 1][at] for other in runs[1:])]
        elif b > a:
            short = (own[a:b] * np.array(weights[: b - a], np.uint64) for own in hashes)
            yield [mix(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) for part in short]
        else:
            yield [np.zeros(0, np.uint64) for _ in seeds]


def signature(shingles: np.ndarray) -> bytes:
    """One byte for each of ``COLUMNS`` hash functions: that of the least value."""
    least = np.full(COLUMNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, np.multiply.outer(_FACTORS, shingles[at : at + 4096]).min(axis=1), out=least)
    return (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, row, n_shingles, set_key (null if empty) and signature of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(2))
            for first, last in row_steps(starts):
                sizes, keys, signs = [], [], []
                for own, other in shingle_sets(data, starts[first : last + 1], words, (0, 1)):
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes() + other.tobytes(), digest_size=16).digest() if len(own) else None)
                    signs.append(signature(own) if len(own) else None)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    ["doc_id", "row", "n_shingles", "set_key", "signature"],
                )

    source = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string"))
    return source.mapInArrow(work, "doc_id long, row long, n_shingles long, set_key binary, signature binary")


def prefix_depth(threshold: float) -> int:
    """Columns that a group shares: as many as find a pair at the threshold in some order but for a share of ``MISSED``."""
    return next((d for d in range(LEAST_DEPTH, 1, -1) if (1 - threshold**d) ** TREES < MISSED), 1)


def _agreeing(signs: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Spanning links of the rows of a group that agree in ``enough`` columns (all pairs, or those across two halves)."""
    links = []
    across = left is not right
    for i in left.tolist():
        others = right if across else right[right > i]
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        for j in others[(signs[others] == signs[i]).sum(axis=1) >= enough].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((i, j))
    return links


def orders_at(depth: int, threshold: float) -> int:
    """Orders that find a pair at the threshold at a depth in some order but for a share of ``MISSED``."""
    return max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-(threshold**depth)))))


def forest_groups(sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(group, set_key, signature): rows of one group share the first ``depth`` columns of one of the orders."""
    orders = [np.random.default_rng((depth, tree)).permutation(COLUMNS)[:depth] for tree in range(trees)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COLUMNS)
            for tree, order in enumerate(orders):
                group = np.full(len(signs), tree, np.uint64)
                for column in order:
                    group = mix((group << np.uint64(8)) ^ signs[:, column])
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), *batch.columns], ["group", "set_key", "signature"])

    return sets.select("set_key", "signature").mapInArrow(work, "group long, set_key binary, signature binary")


def forest_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that span the set keys which are neighbours in one of the orders and agree enough over all columns."""
    depth, found, rows = prefix_depth(threshold), None, sets
    while True:
        places = forest_groups(rows, depth, orders_at(depth, threshold))
        counts = places.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
        crowded = stored(counts.select("group", F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("blocks")), "crowded")
        size = crowded.count()
        known = places.join(F.broadcast(crowded) if size <= BROADCAST_GROUPS else crowded, "group", "left")
        last = not size or depth >= MOST_DEPTH
        pairs = _group_links(known if last else known.where("blocks is null"), threshold)
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found.distinct()
        rows = stored(known.where("blocks is not null").groupBy("set_key").agg(F.min("signature").alias("signature")), "descending")
        depth = min(depth + DESCENT, MOST_DEPTH)


def _group_links(places: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that span the rows of each group which agree enough. ``places``: group, set_key, signature, blocks (null: one)."""
    enough = int(np.ceil((threshold - SLACK) * COLUMNS))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["group", "i", "j"]):
            signs = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(-1, COLUMNS)
            group, i, j, own = (rows[c].to_numpy() for c in ("group", "i", "j", "block"))
            change = np.flatnonzero((np.diff(group) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            bounds = np.concatenate([[0], change, [len(group)]])
            run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            left, right = [], []
            for step in range(1, REACH + 1):
                at = np.flatnonzero(run[:-step] == run[step:])
                at = at[(signs[at] == signs[at + step]).sum(axis=1) >= enough]
                left.append(at)
                right.append(at + step)
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            more = []
            for k in np.flatnonzero(np.diff(bounds) > REACH + 1).tolist():
                first, last = int(bounds[k]), int(bounds[k + 1])
                root = np.arange(last - first)
                for x, y in zip(*(v[np.searchsorted(a, first) : np.searchsorted(a, last)] - first for v in (a, b))):
                    if root[x] != root[y]:
                        root[root == root[y]] = root[x]
                half = np.flatnonzero(own[first:last] == i[first])
                other = half if i[first] == j[first] else np.flatnonzero(own[first:last] == j[first])
                more += [(first + x, first + y) for x, y in _agreeing(signs[first:last], root, half, other, enough)]
            a = np.concatenate([a, np.array([x for x, _ in more], np.int64)])
            b = np.concatenate([b, np.array([y for _, y in more], np.int64)])
            keys = rows["set_key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b))], ["a", "b"])

    known = places.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    dealt = known.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", "set_key", "signature", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "signature", "set_key")
    pairs = parts.mapInArrow(compare, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _classes(keys: list[bytes], shingles: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple]:
    """Spanning links of the pairs of a block with den * intersection >= num * union (all pairs, or those across two halves)."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    values, inverse = np.unique(np.concatenate(shingles), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(len(keys))
    links = []
    marked = np.zeros(len(values), bool)
    across = left is not right
    for i in left.tolist():
        others = right if across else right[right > i]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(root[others] != root[i]) & (den * small >= num * large)]
        if not len(others):
            continue
        own = inverse[bounds[i] : bounds[i + 1]]
        marked[own] = True
        lengths = sizes[others]
        ends = np.cumsum(lengths)
        index = np.repeat(bounds[others] - (ends - lengths), lengths) + np.arange(ends[-1])
        shared = np.add.reduceat(marked[inverse[index]].astype(np.int64), ends - lengths)
        marked[own] = False
        for j in others[den * shared >= num * (sizes[i] + lengths - shared)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((keys[i], keys[j]))
    return links


def confirmed_links(docs: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of one family. ``members``: set_key, doc_id, row, family, blocks (of the family)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(3))
            for first, last in row_steps(starts):
                sets = [s.tobytes() for s, in shingle_sets(data, starts[first : last + 1], words)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["set_key", "family", "blocks", "shingles"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(distinct_runs(batches, ["set_key", "j", "i"]), ["family", "i", "j"], 2000):
            family = rows["family"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            i, j, own = (rows[c].to_numpy() for c in ("i", "j", "block"))
            change = np.flatnonzero((np.diff(family) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            keys, raw = rows["set_key"].to_pylist(), rows["shingles"].to_pylist()
            links = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(keys)]):
                sets = [np.frombuffer(r, np.uint64) for r in raw[a:b]]
                left = np.flatnonzero(own[a:b] == i[a])
                right = left if i[a] == j[a] else np.flatnonzero(own[a:b] == j[a])
                links += _classes(keys[a:b], sets, left, right, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    # hash-dealt blocks: their rows come out near BLOCK_ROWS; each pair of blocks is one group
    texts = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string"))
    found = texts.join(members, "row").select("set_key", "family", "blocks", "text").mapInArrow(
        sets_of, "set_key binary, family binary, blocks int, shingles binary"
    )
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    placed = found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "set_key", "family", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    parts = placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "set_key")
    return parts.mapInArrow(judge, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept and is_first (one row key of each component) for each row of ``docs``."""
    sketches = stored(sketch(docs, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    sets = sketches.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("row"), F.min("signature").alias("signature"), first.alias("first"))
    sets = stored(sets, "sets")
    families = connected_components(forest_candidates(sets, percent / 100)).select(
        F.col("node").alias("set_key"), F.col("component").alias("family")
    )
    blocks = families.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    members = families.join(blocks, "family").join(sets.select("set_key", "row"), "set_key")
    links = stored(confirmed_links(docs, members, words, percent, 100), "links")
    # names by set, then by component; written, so that a join with a hot set or component can be split
    linked = connected_components(links).select(F.col("node").alias("set_key"), "component")
    linked = stored(linked.join(sets.select("set_key", "first"), "set_key"), "linked")
    least = stored(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    named = linked.join(least, "component").select("set_key", "least")
    names = sets.select("set_key", "first").join(named, "set_key", "left").select("set_key", F.coalesce("least", "first").alias("first"))
    # rows without a set get keys that no set has, each its own
    key = F.coalesce("set_key", F.col("row").cast("string").cast("binary"))
    placed = sketches.withColumn("key", key).join(stored(names, "names").withColumnRenamed("set_key", "key"), "key", "left")
    return placed.select(
        "doc_id", "row", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("is_first"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
