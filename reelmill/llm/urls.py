"""URL filter: rules first, then the ratio of two character language models (operator 4, DataFrame functions only).

Rules name a host and a path. A rule fits its host and all subdomains where the url's path begins with its path; the longest rule wins.
Urls that rules allow or block train two variable-order Markov models over characters. Each smooths its longest known context with
the next shorter one, down to a uniform distribution:
    p(c | h) = (n(h c) + ALPHA * p(c | h')) / (n(h) + ALPHA)       h' is h without its first character.
The score of a url is the mean over its characters of log p_allow - log p_block. It is calibrated on a fifth of the ruled urls that
the models don't see: the threshold lies between both classes' means, nearer to the one that spreads less.

Scores are sums of one number per character and context length: what the longer context adds to the shorter one's log ratio. These come
from a table of all n-grams of the ruled urls, which is broadcast only if it is counted to have at most ``MODEL_GRAMS`` rows. Beyond
that each distinct n-gram of the urls to score is looked up once by shuffle; the ``MODEL_GRAMS`` most used ones are broadcast to the
urls, so that none of the others, which are joined by shuffle, is hot. Each distinct url is counted and scored once, so a hot url is one row.

A null url, or one without ``://``, has an empty host and path; it is judged by the models like any string (null as empty). Without both
classes among the ruled urls, everything is allowed that no rule blocks. Equal rows get equal results; null page_ids are kept; extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Longest n-gram (context and character), smoothing, size of the alphabet, n-grams and rules that may be broadcast.
ORDER, ALPHA, ALPHABET, MODEL_GRAMS, BROADCAST_RULES = 5, 2.0, 256, 50_000, 100_000
_BEGIN, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.select(
        "page_id", url.alias("url"), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add rule and action of the longest fitting rule of ``rules`` (host, path, action); null if none fits."""
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    named = rules.select(F.col("host").alias("ending"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), "action")
    places = urls.select("host", "path").distinct()
    ends = places.select("host", "path", F.explode(endings).alias("ending"))
    fits = ends.join(F.broadcast(named) if small else named, "ending").where(F.startswith(F.col("path"), F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "action")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "best.rule", "best.action")


def _grams(urls: DataFrame, *others: str) -> DataFrame:
    """(gram, context) for each character and each number of characters before it, up to ORDER - 1."""
    framed = urls.select(*others, F.concat(F.lit(_BEGIN), "url", F.lit(_END)).alias("s"))
    places = framed.select(*others, "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    sized = places.select(*others, "s", "i", F.explode(F.sequence(F.lit(1), F.least("i", F.lit(ORDER)))).alias("k"))
    gram = F.substring(F.col("s"), F.col("i") - F.col("k") + 1, F.col("k"))
    return sized.select(*others, "i", "k", gram.alias("gram"), F.substring(F.col("s"), F.col("i") - F.col("k") + 1, F.col("k") - 1).alias("context"))


def markov_ratio(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, delta) and (context, back) of two models fitted on ``labelled`` (url, accepted, n).

    ``delta`` is what a known n-gram adds to the log ratio of its ending, ``back`` what an unknown one adds after a known context.
    """
    each = _grams(labelled, "accepted", "n")
    yes, no = F.when(F.col("accepted"), F.col("n")).otherwise(0), F.when(F.col("accepted"), 0).otherwise(F.col("n"))
    counts = each.groupBy("gram", "context", "k").agg(F.sum(yes).alias("yes"), F.sum(no).alias("no"))
    counts = stored(counts, "grams")
    known = stored(counts.groupBy("context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no")), "known_contexts")
    level = counts.where("k = 0").select("gram", F.lit(0.0).alias("p_yes"), F.lit(0.0).alias("p_no"))
    table = None
    for k in range(1, ORDER + 1):
        own = counts.where(F.col("k") == k).join(known, "context").withColumn("ending", F.substring("gram", 2, ORDER))
        if k == 1:
            own = own.withColumns({"s_yes": F.lit(1.0 / ALPHABET), "s_no": F.lit(1.0 / ALPHABET)})
        else:
            own = own.join(level.select(F.col("gram").alias("ending"), F.col("p_yes").alias("s_yes"), F.col("p_no").alias("s_no")), "ending")
        fitted = own.select(
            "gram", ((F.col("yes") + ALPHA * F.col("s_yes")) / (F.col("all_yes") + ALPHA)).alias("p_yes"),
            ((F.col("no") + ALPHA * F.col("s_no")) / (F.col("all_no") + ALPHA)).alias("p_no"), "s_yes", "s_no",
        )
        level = stored(fitted, f"level{k}")
        part = level.select("gram", (F.log(F.col("p_yes") / F.col("p_no")) - F.log(F.col("s_yes") / F.col("s_no"))).alias("delta"))
        table = part if table is None else table.unionByName(part)
    return table, known.select("context", F.log((F.col("all_no") + ALPHA) / (F.col("all_yes") + ALPHA)).alias("back"))


def ratio_scores(urls: DataFrame, deltas: DataFrame, backs: DataFrame) -> DataFrame:
    """(url, score) of distinct urls."""
    each = _grams(urls, "url")
    step = F.coalesce("delta", "back", F.lit(0.0)).alias("step")
    if deltas.limit(MODEL_GRAMS + 1).count() <= MODEL_GRAMS:  # each context begins a gram, so there are no more of them
        steps = each.join(F.broadcast(deltas), "gram", "left").join(F.broadcast(backs), "context", "left").select("url", step)
    else:
        used = each.groupBy("gram", "context").agg(F.count("*").alias("uses"))
        used = stored(used.join(deltas, "gram", "left").join(backs, "context", "left").select("gram", "uses", step), "steps")
        most = stored(used.orderBy(F.col("uses").desc(), "gram").limit(MODEL_GRAMS).select("gram", F.col("step").alias("known")), "most_used")
        first = each.select("url", "gram").join(F.broadcast(most), "gram", "left")
        rest = first.where("known is null").join(used.join(F.broadcast(most), "gram", "left_anti"), "gram").select("url", "step")
        steps = first.where("known is not null").select("url", F.col("known").alias("step")).unionByName(rest)
    return steps.groupBy("url").agg(F.sum("step").alias("total")).select("url", F.round(F.col("total") / (F.length("url") + 1), 6).alias("score"))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides)."""
    ruled = with_rule(with_host_and_path(pages), rules)
    urls = stored(ruled.groupBy("url").agg(F.first("action").alias("action"), F.count("*").alias("n")), "urls")
    known = urls.where("action is not null").select("url", (F.col("action") == "allow").alias("accepted"), F.lit(1).alias("n"))
    test = F.crc32("url") % 5 == 0
    deltas, backs = markov_ratio(known.where(~test))
    deltas, backs = stored(deltas, "deltas"), stored(backs, "backs")
    held = ratio_scores(known.where(test), deltas, backs).join(known, "url")
    classes = {r["accepted"]: r for r in held.groupBy("accepted").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("spread")).collect()}
    if len(classes) < 2:
        verdict: Column = F.lit("allow")
    else:
        yes, no = classes[True], classes[False]
        threshold = (yes["mean"] * (no["spread"] + 1e-6) + no["mean"] * (yes["spread"] + 1e-6)) / (yes["spread"] + no["spread"] + 2e-6)
        verdict = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    scores = ratio_scores(urls.where("action is null").select("url"), deltas, backs)
    return ruled.join(scores, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"), "score")
