"""Exact repeated strings by a logarithmic family of suffix arrays (operator 1).

A window is a string of ``length`` bytes; it repeats if it starts at a second place of any document. Every window holds an
anchor, its least ``GRAM``-byte gram by hash, which depends on the window alone; equal windows have equal anchors at equal
places. So the suffixes that begin at anchors are enough: the suffix arrays are sparse.

1. One pass writes the postings of each batch: runs of windows with one anchor, with the fingerprint of the suffix head (the gram)
   and of the run's whole context (all bytes of its windows).
2. ``SuffixFamily`` holds levels, each a suffix array sorted by head fingerprint. Any order that brings equal heads together
   serves, so fingerprints stand for lexicographic order. A new batch gets its own array, is merge-scanned against every level
   (heads met on both sides are repeats), and levels of equal size merge into one of twice the size, so an entry is rewritten
   only log2(batches) times.
3. A head that repeats with a single context repeats as a whole run: every copy of a passage ends here at the cost
   of one row per run. Where contexts differ, the windows of each distinct context are compared.
4. Covered bytes are united per document and removed.

Fingerprints have 64 bits and contexts are compared by two of them. Null texts are empty; texts shorter than a window
keep everything. Equal rows repeat each other. Documents of any length are read in chunks. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, distinct_runs, groups_of, mix, remove_stored, row_key, row_steps, stored, text_buffer

#: Bytes of an anchor, batches of the family, and bytes of a document that are read at once.
GRAM, BATCHES, CHUNK = 32, 4, 4 << 20
#: Distinct contexts of a head from which its windows are counted as fingerprints instead of compared in one task.
HOT_CONTEXTS = 50_000
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window, count of windows, anchor, head and context fingerprints."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = PrefixHash(data)
    grams = hashes.grams(GRAM)
    anchors = (_sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & _PLACE).astype(np.int64)
    row = np.searchsorted(starts, np.arange(n), side="right") - 1 if len(starts) > 2 else np.zeros(n, np.int64)
    valid = np.arange(n) + length <= starts[row + 1]
    change = np.ones(n, bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change & valid)
    ends = np.flatnonzero(np.append(change[1:] | ~valid[1:], True) & valid) + 1
    at = anchors[first]
    context = hashes.of(first, ends + length - 1) ^ mix((at - first).astype(np.uint64))
    return row[first], first, ends - first, at, grams[at], context


def postings(docs: DataFrame, length: int) -> DataFrame:
    """(batch, row, first, windows, anchor, head, context) of each run of windows; places are byte offsets."""
    names = ["batch", "row", "first", "windows", "anchor", "head", "context"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            parts = batch.column(1).to_numpy()
            data, starts = text_buffer(batch.column(2))
            for begin, end in row_steps(starts):
                lo, hi = int(starts[begin]), int(starts[end])
                # a chunk repeats the bytes that the windows of the chunk before ran into
                for at in range(lo, max(lo + 1, hi - length + 1 if end - begin == 1 else lo + 1), CHUNK):
                    stop = min(hi, at + CHUNK + length - 1) if end - begin == 1 else hi
                    inner = np.array([0, stop - at]) if end - begin == 1 else starts[begin : end + 1] - lo
                    row, first, windows, anchor, head, context = window_runs(data[at:stop], inner, length)
                    if len(row):
                        base = (at - lo) - inner[row]
                        columns = [parts[begin + row], keys[begin + row], first + base, windows, anchor - first, head.view(np.int64), context.view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    key = row_key("doc_id", "text")
    source = docs.select(key.alias("row"), F.pmod(key, F.lit(BATCHES)).cast("int").alias("batch"), F.col("text").cast("string"))
    return source.mapInArrow(work, "batch int, row long, first long, windows int, anchor int, head long, context long")


class SuffixFamily:
    """Levels of sorted arrays of suffix heads: head, its context where all of its suffixes share one, and whether it repeats."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        """One entry per head; ``single`` is null where contexts differ."""
        same = (F.min("single") == F.max("single")) & (F.count("single") == F.count("*"))
        return rows.groupBy("head").agg(
            F.when(same, F.min("single")).alias("single"), (F.count("*") > 1).alias("met"), F.max("repeats").alias("repeats")
        )

    def _report(self, heads: DataFrame) -> None:
        self.matches.append(stored(heads.select("head", "single"), "matches"))

    def add(self, batch: DataFrame) -> None:
        """Index a batch (head, context): report the heads that it repeats, in itself or in any level, then merge equal levels."""
        entries = batch.select("head", F.col("context").alias("single"), F.lit(False).alias("repeats"))
        array = self._merged(entries).select("head", "single", F.col("met").alias("repeats"))
        run, size = stored(array.sortWithinPartitions("head"), "level"), 0
        self._report(run.where("repeats"))
        for level in sorted(self.levels):
            scan = self._merged(run.unionByName(self.levels[level]))
            if level == size:  # as large as what has been merged: scan and merge are one pass
                joined = scan.select("head", "single", (F.col("met") | F.col("repeats")).alias("repeats"), "met")
                merged = stored(joined.sortWithinPartitions("head"), "level")
                self._report(merged.where("met"))
                remove_stored(run)
                remove_stored(self.levels.pop(level))
                run, size = merged.drop("met"), size + 1
            else:
                self._report(scan.where("met"))
        self.levels[size] = run

    def repeated(self) -> DataFrame:
        """Heads that repeat, with their context if it is the only one."""
        found = self.matches[0]
        for match in self.matches[1:]:
            found = found.unionByName(match)
        return self._merged(found.withColumn("repeats", F.lit(True))).select("head", "single")


def _window_values(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some contexts: the row, the place in its context, and a fingerprint that also holds head and anchor."""
    heads = rows["head"].to_numpy()
    data, starts = text_buffer(rows["bytes"])
    windows, anchor = rows["windows"].to_numpy().astype(np.int64), rows["anchor"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(heads)), windows)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = (starts[:-1] - starts[0])[row] + inner
    # equal windows of a head have the anchor at the same place
    place = mix(heads.view(np.uint64)[row] + (anchor[row] - inner).astype(np.uint64))
    return row, inner, PrefixHash(data[starts[0] : starts[-1]]).of(begin, begin + length) ^ place


def _shared_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(head, context, begin, end): spans, from the context's begin, of windows that occur in several contexts of a head.

    ``contexts``: head, context, hot, anchor, windows, bytes; equal rows count once. The contexts of a head meet in one
    task, unless the head is ``hot``: then only fingerprints of its windows are counted, summed up before they are dealt out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(distinct_runs(batches, ["context", "head"]), ["head"], 2000):
            row, inner, value = _window_values(rows, length)
            order = np.argsort(value, kind="stable")
            equal = value[order][1:] == value[order][:-1]
            shared = np.zeros(len(value), bool)
            shared[order[1:][equal]] = shared[order[:-1][equal]] = True
            open_, close = _runs(shared, np.flatnonzero(np.diff(row, prepend=-1)))
            owner = pa.array(row[open_])
            columns = [rows["head"].combine_chunks().take(owner), rows["context"].combine_chunks().take(owner), pa.array(inner[open_]), pa.array(inner[close] + length)]
            yield pa.RecordBatch.from_arrays(columns, ["head", "context", "begin", "end"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, inner, value = _window_values(pa.Table.from_batches([batch]), length)
                owner = pa.array(row)
                columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(inner), pa.array(value.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["head", "context", "begin", "value"])

    schema = "head long, context long, begin long, "
    plain = contexts.where("not hot").repartition("head").sortWithinPartitions("head", "context").mapInArrow(compare, schema + "end long")
    hot = contexts.where("hot").select("head", "context", "windows", "anchor", "bytes").dropDuplicates(["head", "context"])
    single = hot.mapInArrow(spread, schema + "value long")
    common = single.groupBy("value").count().where("count > 1").select("value")
    return plain.unionByName(single.join(common, "value").select("head", "context", "begin", (F.col("begin") + length).alias("end")))


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags; none goes over a break."""
    before = np.zeros(len(flags), bool)
    before[1:] = flags[:-1]
    before[breaks] = False
    opens = np.flatnonzero(flags & ~before)
    after = np.zeros(len(flags), bool)
    after[:-1] = flags[1:]
    after[breaks[breaks > 0] - 1] = False
    return opens, np.flatnonzero(flags & ~after)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(row, begin, end) byte spans that windows cover which repeat anywhere; spans may overlap."""
    runs = stored(postings(docs, length), "postings")
    family = SuffixFamily()
    for batch in range(BATCHES):
        family.add(runs.where(F.col("batch") == batch).select("head", "context"))
    hits = runs.drop("batch").join(family.repeated(), "head")
    hits = stored(hits, "hits")
    remove_stored(runs)
    whole = hits.where("single is not null").select("row", F.col("first").alias("begin"), (F.col("first") + F.col("windows") + length - 1).alias("end"))
    open_ = hits.where("single is null")
    place = F.struct("row", "first", "anchor", "windows")
    kinds = stored(open_.groupBy("head", "context").agg(F.count("*").alias("copies"), F.min(place).alias("at")), "contexts")
    crowds = kinds.groupBy("head").agg((F.count("*") > HOT_CONTEXTS).alias("hot"))
    wanted = kinds.join(crowds, "head").select("head", "context", "hot", "at.*").groupBy("row").agg(
        F.collect_list(F.struct("head", "context", "hot", "first", "anchor", "windows")).alias("runs")
    )
    texts = docs.select(row_key("doc_id", "text").alias("row"), F.col("text").cast("string")).join(wanted, "row").select("text", "runs")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["head", "context", "hot", "anchor", "windows", "bytes"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for r in own:
                    rows.append((r["head"], r["context"], r["hot"], r["anchor"], r["windows"], text[r["first"] : r["first"] + r["windows"] + length - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    contexts = texts.mapInArrow(cut_out, "head long, context long, hot boolean, anchor int, windows int, bytes binary")
    shared = _shared_windows(contexts, length)
    copied = kinds.where("copies > 1").select("head", "context", F.lit(0).cast("long").alias("begin"), (F.col("at.windows") + length - 1).cast("long").alias("end"))
    spans = stored(shared.unionByName(copied), "spans")
    parts = open_.join(spans, ["head", "context"]).select("row", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs``; ``with_text`` adds the kept bytes."""
    # equal rows have equal spans; one of each is collected
    places = repeated_spans(docs, length).groupBy("row", "begin").agg(F.max("end").alias("end"))
    spans = places.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), F.col("text").cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                text = text or b""
                kept, at, removed, count = [], 0, 0, 0
                for begin, end in sorted((s["begin"], s["end"]) for s in own or []):
                    if begin > at or not count:
                        kept.append(text[at:begin])
                        removed += end - begin
                        count += 1
                    elif end > at:
                        removed += end - at
                    at = max(at, end)
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((len(text), removed, count, hashlib.sha256(left).hexdigest()) + ((left,) if with_text else ()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    found = texts.join(spans, "row", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.mapInArrow(work, schema + (", kept_text binary" if with_text else ""))
