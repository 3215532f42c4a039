"""Personal data: fixed patterns, then information-theoretic sanitisation of what gives them away (operator 10).

The patterns find emails, IP addresses, card and phone numbers; their values are the protected entities. A term (word) near an entity
may reveal it: over the corpus, the term's pointwise mutual information with the entity,
    log2( p(entity | term) / p(entity) ),   p(entity | term) = contexts of the term that hold the entity / its observations,
counts how many bits of the entity's identity it discloses, out of the log2(1 / p(entity)) that name it wholly. A term is removed
beside the entity if it discloses at least ``DISCLOSED`` of those bits and stands near it in at least ``LEAST_CONTEXTS``
different contexts. A context is a text and the words near the entity in it: copies of a text count once, a footer once in each
different text. A term's observations are its contexts, and one for each different text that holds it near no entity. Terms that only
narrow an entity down (at least ``NARROWED`` of the bits) are generalised instead. Terms are words of four letters or more; of the
``NEARBY`` terms on either side of an entity those that overlap a span are left out.

A term is generalised to a broader one that the corpus teaches: a term that stands in at least ``SUBSUMED`` of its contexts, has more contexts of its
own, and is not itself removed or generalised beside any entity of theirs. The narrowest of these (fewest contexts, then the first
in order) takes its place, as ``[word]``; where the corpus knows none, ``[TERM]`` does.

Both counts cover the whole corpus: nearby words of every occurrence, and all occurrences of the terms that come up for
judgement. Only entities that occur in several contexts can be judged; an entity met once leaves nothing to estimate.

Null texts are empty. Overlapping spans are all listed; masking unites them. Rows are judged one by one, so equal rows get equal
rows. Extra columns are ignored by ``find_personal`` and kept by ``sanitise``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, stored, whole_rows

#: Words on either side of an entity that may reveal it, contexts that are needed, and shares of the bits disclosed.
NEARBY, LEAST_CONTEXTS, DISCLOSED, NARROWED = 6, 3, 0.9, 0.75
#: Share of a term's contexts in which a broader term stands.
SUBSUMED = 0.8
#: Terms under judgement that may be broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000
KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds.
REMOVED, GENERALISED = "reveal", "general"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = regex.compile(r"\p{L}{4,}")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = int(d) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind; matches that fail are dropped."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the name before an @ is as long as it can be, so a match begins there and nowhere else
        name = text[done:at]
        size = len(name) - len(name.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        if domain:
            found.append(("email", at - size, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def entity_value(kind: str, raw: str) -> str:
    return raw.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", raw)


def clear_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """All terms of a text in order, lower-cased, with their places and whether they lie outside all spans."""
    taken, at, end = sorted((a, b) for _, a, b in spans), 0, 0
    found = []
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][1])
            at += 1
        found.append((m[0].lower(), m.start(), m.end(), end <= m.start()))
    return found


def nearby_terms(terms: list[tuple[str, int, int, bool]], begins: list[int], start: int, end: int) -> list[tuple[str, int, int]]:
    """Those of the ``NEARBY`` terms before and after a span that lie outside all spans."""
    first, last = bisect_left(begins, start), bisect_left(begins, end)
    return [t[:3] for t in terms[max(0, first - NEARBY) : first] + terms[last : last + NEARBY] if t[3]]


_DETECTED = (
    "doc_id long, row long, copy long, spans array<struct<kind:string,begin:int,end:int>>, "
    "nearby array<struct<entity:string,context:bigint,term:string,begin:int,end:int>>"
)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, row, copy (the same for equal texts), the base spans of each row, and the terms near each of its entities with their context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, all_near = [], []
            for text in batch.column(3).to_pylist():
                spans = base_spans(text or "")
                near = []
                known = clear_terms(text, spans) if spans else []
                begins = [t[1] for t in known]
                for kind, start, end in spans:
                    terms = nearby_terms(known, begins, start, end)
                    words = " ".join(sorted({t for t, _, _ in terms}))
                    context = int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "little", signed=True)
                    entity = f"{kind}:{entity_value(kind, text[start:end])}"
                    near += [{"entity": entity, "context": context, "term": t, "begin": a, "end": b} for t, a, b in terms]
                all_spans.append([{"kind": k, "begin": a, "end": b} for k, a, b in spans])
                all_near.append(near)
            span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            term = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(all_spans, span), pa.array(all_near, term)], ["doc_id", "row", "copy", "spans", "nearby"]
            )

    source = docs.select(
        F.col("doc_id").cast("long"), row_key("doc_id", "text").alias("row"), row_key("text").alias("copy"), F.col("text").cast("string")
    )
    return source.mapInArrow(work, _DETECTED)


def revealing_terms(docs: DataFrame, detected: DataFrame) -> DataFrame:
    """(entity, term, action, broader) of the terms that disclose an entity of the corpus; broader is null unless a term is generalised to it."""
    each = detected.select("copy", F.explode("nearby").alias("n")).select("n.entity", "copy", "n.context", "n.term")
    contexts = stored(each.distinct(), "contexts")
    pairs = contexts.select("entity", "copy", "context").distinct()
    bits = F.log2(F.lit(float(max(1, pairs.count()))) / F.col("with_entity"))
    both = contexts.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= LEAST_CONTEXTS)
    with_entity = pairs.groupBy("entity").agg(F.count("*").alias("with_entity"))
    near_texts = contexts.groupBy("term", "copy").agg(F.count("*").alias("n"))
    with_term = near_texts.groupBy("term").agg(F.sum("n").alias("near"), F.count("*").alias("near_texts"))

    def share(seen: Column) -> Column:
        return (F.log2(F.col("both") / seen) + bits) / bits

    # other occurrences only weaken a term: what contexts alone don't make strong enough needs no further count
    judged = both.join(with_entity, "entity").join(with_term, "term").where((bits > 0) & (share(F.col("near")) >= NARROWED))
    judged = stored(judged, "judged")
    wanted = judged.select("term").distinct()
    wanted = F.broadcast(wanted) if judged.count() <= BROADCAST_TERMS else wanted
    words = F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+")
    each = docs.select(row_key("text").alias("copy"), F.array_distinct(words).alias("words"))
    used = each.select("copy", F.explode("words").alias("term")).join(wanted, "term", "left_semi").distinct()
    measured = judged.join(used.groupBy("term").agg(F.count("*").alias("texts")), "term", "left")
    # a term's observations: its contexts, and the texts that hold it near no entity
    final = share(F.col("near") + F.greatest(F.lit(0), F.coalesce("texts", F.lit(0)) - F.col("near_texts")))
    action = F.when(final >= DISCLOSED, F.lit(REMOVED)).otherwise(F.lit(GENERALISED)).alias("action")
    actions = stored(measured.where(final >= NARROWED).select("entity", "term", action), "actions")
    return actions.join(broader_terms(contexts, actions, with_term), ["entity", "term"], "left")


def broader_terms(contexts: DataFrame, actions: DataFrame, with_term: DataFrame) -> DataFrame:
    """(entity, term, broader) of the terms to generalise that have a broader one. A context holds at most 2 * ``NEARBY`` terms, so its pairs are few."""
    general = actions.where(F.col("action") == GENERALISED).select("entity", "term")
    spots = contexts.join(general, ["entity", "term"])
    beside = contexts.withColumnRenamed("term", "broader")
    shared = spots.join(beside, ["entity", "copy", "context"]).where("broader != term").groupBy("entity", "term", "broader").agg(F.count("*").alias("shared"))
    # the broader term must not be one that gives the entity away
    fit = shared.join(actions.select("entity", F.col("term").alias("broader")), ["entity", "broader"], "left_anti")
    fit = fit.join(spots.groupBy("entity", "term").agg(F.count("*").alias("own")), ["entity", "term"]).where(F.col("shared") >= F.col("own") * SUBSUMED)
    sizes = with_term.select("term", F.col("near").alias("n"))
    fit = fit.join(sizes.select("term", F.col("n").alias("narrow")), "term").join(sizes.select(F.col("term").alias("broader"), F.col("n").alias("wide")), "broader")
    least = F.min(F.struct("wide", "broader"))
    return fit.where("wide > narrow").groupBy("entity", "term").agg(least.alias("least")).select("entity", "term", "least.broader")


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans (kind, begin, end: the base kinds as found) and added (the same of the revealing terms, and what takes their place)."""
    detected = stored(detect(docs), "detected")
    reveals = revealing_terms(docs, detected)
    near = detected.select("row", F.explode("nearby").alias("n")).select("row", "n.entity", "n.term", "n.begin", "n.end")
    span = F.struct(F.col("action").alias("kind"), "begin", "end", "broader")
    # a term between two entities may reveal both: the stronger action holds ("reveal" sorts last); of two broader terms none is
    # known to suit both entities, so the plain mask does
    agreed = F.when((F.count("broader") == F.count("*")) & (F.min("broader") == F.max("broader")), F.max("broader")).alias("broader")
    hit = near.join(reveals, ["entity", "term"]).groupBy("row", "begin", "end", "entity").agg(F.max("action").alias("action"), F.max("broader").alias("broader"))
    hit = hit.groupBy("row", "begin", "end").agg(F.max("action").alias("action"), agreed)
    added = hit.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    none = F.array().cast("array<struct<kind:string,begin:int,end:int,broader:string>>")
    return detected.join(added, "row", "left").select("doc_id", "row", "spans", F.coalesce("added", none).alias("added"))


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans in order of kind, then place."""
    found = find_personal(docs)
    text = lambda column: F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda column, kind: F.array_sort(F.filter(column, lambda s: s["kind"] == kind))
    base = F.flatten(F.array(*[of("spans", k) for k in KINDS]))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))
    every = F.concat(base, *[F.transform(of("added", k), plain) for k in (REMOVED, GENERALISED)])
    counts = [F.size(of("spans", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(every).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with entities masked by kind, revealing terms removed and narrowing ones generalised; null texts stay null."""
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), F.lit(None).cast("string").alias("broader")))
    found = find_personal(docs).select("row", F.concat(base, "added").alias("spans")).where(F.size("spans") > 0)
    # any name may be among the columns of docs: they travel as one struct
    joined = whole_rows(docs).join(found.dropDuplicates(["row"]), "row", "left")
    keyed = joined.select("spans", "whole.*").toDF("spans", *[f"c{n}" for n in range(len(docs.columns))])
    at = docs.columns.index("text") + 1
    own = docs.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(0).to_pylist()):
                texts.append(masked(text, [(s["kind"], s["begin"], s["end"], s["broader"]) for s in spans]) if spans and text else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns[1:], own)

    return keyed.mapInArrow(mask, docs.withColumn("text", F.col("text").cast("string")).schema)


def masked(text: str, spans: list[tuple[str, int, int, str | None]]) -> str:
    """Overlapping spans are masked as one, by the kind of the first; a generalised term becomes its broader one."""
    out, at = [], 0
    for kind, begin, end, broader in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if begin >= at:
            out += [text[at:begin], "" if kind == REMOVED else f"[{broader or 'TERM'}]" if kind == GENERALISED else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
