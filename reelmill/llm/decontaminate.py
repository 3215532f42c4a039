"""Benchmark decontamination on a distributed positional inverted index (operator 8, DataFrame functions only).

1. Test items become windows of ``window`` consecutive words (an item with fewer, but any, words is one window). Equal
   windows of several items are looked up once.
2. One pass counts how often each test term occurs in the training texts. A window with a term that never occurs is out.
3. A second pass stores the postings (term, row, position) of each window's two rarest terms, all that an exact lookup starts from,
   and of some more of each item's blocks, if proximity matches are wanted.
4. Lists are shifted by the term's offset in its window and intersected on (window, row, start). What is left is almost only
   true matches; each is confirmed word for word on its text.
5. Hits of a row are united to covered words; windows lead back to their items.
6. Proximity: an item's adjacent windows (from its begin, and the last one) are its blocks. A block of ``NEAR_WORDS`` words or more stands
   near a place of a text if, set there, all but one in five of its words have an equal one at most ``slop`` places off. So inserted,
   missing, replaced and swapped words are found, also at the begin and the end of a text. Of its rarest terms, two more than
   may be missing, at least two stand right at any match: their lists are intersected, and candidates are confirmed on their text.

A hot term, window or text only makes its lists longer: every step is a join or a sum that Spark can split. The table of test terms
is broadcast only if it is counted to be at most ``BROADCAST_TERMS`` rows, else it is joined by shuffle.

Null and empty texts have no words, items without words no windows. A row is known by doc_id and text, so equal rows get equal
results and rows that share an id are judged apart. Null doc_ids are kept. Items of equal id count once. Extra columns are
ignored. An empty table gives no rows; without items nothing is hit.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored

BROADCAST_TERMS = 100_000
#: Least words of a block that proximity matches are sought for; one in as many may be missing.
NEAR_WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z only; words are runs of digits, letters and everything beyond ASCII."""
    # lower() knows ASCII texts, where it does the same, by their bytes and is much faster
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(F.coalesce(lowered, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def test_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window, words, whether it is a block of some item) of the distinct windows, and (window, item_id as a string) of all."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    each = own.select("item_id", "all", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("at"))
    block = ((F.col("at") % window == 0) | (F.col("at") == F.col("last"))).alias("block")
    each = each.select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"), block)
    each = each.withColumn("window", F.xxhash64("words"))
    return each.groupBy("window").agg(F.first("words").alias("words"), F.max("block").alias("block")), each.select("window", "item_id").distinct()


class PositionalIndex:
    """Postings of the test windows' rarest terms in the training texts (doc_id, text); with ``near``, of those that proximity needs too."""

    def __init__(self, docs: DataFrame, windows: DataFrame, near: bool = False) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        terms = windows.select("window", F.posexplode("words").alias("offset", "term"))
        known = stored(terms.select("term").distinct(), "terms")
        self.small = known.count() <= BROADCAST_TERMS
        counts = stored(self._tokens("term").join(self._side(known), "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
        # each window's terms, the rarest first, and how many of them occur
        counted = terms.join(counts, "term", "left")
        sizes = windows.select("window", F.size("words").alias("size"), "block")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")))
        ranked = counted.groupBy("window").agg(order.alias("terms"), F.count("n").alias("found")).join(sizes, "window")
        # an exact match needs every term, so two lists do; a near one may lack some
        exact = F.when(F.col("found") == F.col("size"), 2).otherwise(0)
        close = F.when(F.col("block") & (F.col("size") >= NEAR_WORDS), missing_words(F.col("size")) + 2).otherwise(0) if near else F.lit(0)
        most = ranked.withColumn("exact", exact).withColumn("close", close)
        first = most.select("window", "size", "exact", "close", F.posexplode(F.slice("terms", 1, F.greatest("exact", "close"))).alias("place", "t"))
        self.anchors = stored(first.select("window", "size", "exact", "close", "place", "t.offset", "t.term"), "anchors")
        wanted = self.anchors.select("term").distinct()
        self.postings = stored(self._tokens("row", "position", "term").join(self._side(wanted), "term"), "postings")

    def _tokens(self, *columns: str) -> DataFrame:
        words = self.docs.select(row_key("doc_id", "text").alias("row"), words_of(F.col("text")).alias("words"))
        if "position" in columns:
            return words.select("row", F.posexplode("words").alias("position", "term")).select(*columns)
        return words.select(F.explode("words").alias("term")).select(*columns)

    def _side(self, terms: DataFrame) -> DataFrame:
        return F.broadcast(terms) if self.small else terms

    def lists(self, place: int) -> DataFrame:
        """(window, row, start) by the window's rarest (0) or second rarest (1) term."""
        anchors = self.anchors.where((F.col("place") == place) & (F.col("place") < F.col("exact"))).select("window", "term", "offset")
        return self.postings.join(anchors, "term").select("window", "row", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0").distinct()

    def phrases(self) -> DataFrame:
        """Candidates (window, row, start) of exact matches."""
        single = self.anchors.where("size = 1 and exact > 0").select("window")
        return self.lists(0).join(self.lists(1), ["window", "row", "start"]).unionByName(self.lists(0).join(single, "window", "left_semi"))

    def near(self, slop: int) -> DataFrame:
        """Candidates (window, row, start) of proximity matches: two of the block's rarest terms or more stand at most ``slop`` places off."""
        anchors = self.anchors.where("place < close").select("window", "term", "offset", F.expr("shiftleft(1, place)").alias("bit"))
        shift = F.col("position") - F.col("offset")
        each = self.postings.join(anchors, "term").select("window", "row", "bit", F.explode(F.sequence(shift - slop, shift + slop)).alias("start"))
        met = each.groupBy("window", "row", "start").agg(F.bit_or("bit").alias("bits"))
        return met.where(F.bit_count("bits") >= 2).select("window", "row", "start")


def missing_words(size: Column) -> Column:
    """How many words of a block a proximity match may lack."""
    return F.floor(size / NEAR_WORDS).cast("int")


def words_in_place(text: Column, words: Column, start: Column, slop: int) -> Column:
    """How many of ``words``, set at ``start`` of the text's words, have an equal one at most ``slop`` places off."""

    def here(word: Column, offset: Column) -> Column:
        places = [F.coalesce(F.get(text, start + offset + d) == word, F.lit(False)) for d in range(-slop, slop + 1)]
        return functools.reduce(operator.or_, places)

    return F.size(F.filter(words, here))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, slop: int | None = None) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``; with ``slop``, near_items too.

    Contaminated: some word is hit, and at least one in ``share`` of all words. near_items: sorted ids of the items with a block that stands
    near some place of the text. An exact copy of a block is near, too.
    """
    windows, owners = test_windows(items, window)
    windows, owners = stored(windows, "windows"), stored(owners, "owners")
    index = PositionalIndex(docs, windows, near=slop is not None)
    found = _by_row(index.phrases(), windows, "found")
    if slop is not None:
        found = found.join(_by_row(index.near(slop), windows, "close"), "row", "full")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", row_key("doc_id", "text"))
    joined = texts.join(found, "row", "left").select("row", "doc_id", words_of(F.col("text")).alias("all"), *found.columns[1:])
    right = F.filter("found", lambda h: F.slice(F.col("all"), h["start"] + 1, F.size(h["words"])) == h["words"])
    hits = F.transform(right, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.size(h["words"])).alias("end"), h["window"].alias("window")))
    own = [F.size("all").cast("long").alias("n_words"), hits.alias("hits")]
    if slop is not None:
        least = lambda h: F.size(h["words"]) - missing_words(F.size(h["words"]))
        close = F.filter("close", lambda h: words_in_place(F.col("all"), h["words"], h["start"], slop) >= least(h))
        own.append(F.array_distinct(F.transform(close, lambda h: h["window"])).alias("near"))
    judged = stored(joined.select("doc_id", "row", *own), "hits")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort(F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,window:bigint>>"))), begin,
        lambda s, h: F.struct(
            F.greatest(s["at"], h["end"]).alias("at"), (s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(s["at"], h["start"]))).cast("long").alias("n")
        ),
    )["n"]
    result = judged.withColumn("n_hit", covered).join(_items(judged, F.transform("hits", lambda h: h["window"]), owners, "items"), "row", "left")
    more = []
    if slop is not None:
        result = result.join(_items(judged, F.col("near"), owners, "near_items"), "row", "left")
        more.append(F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"))
    return result.select(
        "doc_id", "row", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        *more,
    )


def _by_row(candidates: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """Candidates (window, row, start) with their words, as one list a row."""
    each = candidates.join(windows, "window").select("row", F.struct("start", "window", "words").alias("one"))
    return each.groupBy("row").agg(F.collect_list("one").alias(name))


def _items(judged: DataFrame, windows: Column, owners: DataFrame, name: str) -> DataFrame:
    """(row, sorted ids of the items that hold any of its windows)."""
    pairs = judged.where(F.size(windows) > 0).select("row", F.explode(F.array_distinct(windows)).alias("window"))
    named = pairs.join(owners, "window").select("row", "item_id").distinct()
    return named.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias(name))
