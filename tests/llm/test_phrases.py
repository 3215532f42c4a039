"""Collocations against a count of everything, with few and many steps of the frontier."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from reelmill.llm import phrases


def brute(rows, top, least, longest, percent):
    lower, counts, total = {i: i + 32 for i in range(65, 91)}, defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            total[lang] += len(words)
            counts[lang].update(words[i : i + m] for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    for lang, own in counts.items():
        known = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        inside = lambda g: {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1)} - {g}
        gone = {s for g, a in known.items() for s in inside(g) if 100 * a >= percent * own[s]}
        scored = []
        for g, a in known.items():
            if g not in gone:
                score, k = min((1000 * a * total[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                scored.append((" ".join(g), a, own[g[:k]], own[g[k:]], total[lang], score))
        scored.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        yield from ((lang, n + 1, *r) for n, r in enumerate(scored[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"W{i}\u00e9" if i % 7 == 0 else f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    fixed = [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(12)]
    out = []
    for _ in range(160):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(fixed) if rng.random() < 0.3 else rng.choices(words, weights)[0]
            text += rng.choice([" ", " ", "  ", "\t", " . ", ", ", "\n", "\xa0", "?"])
        out.append((text, rng.choice(["en", "en", "fr", None])))
    return out + [(None, "en"), ("", "fr"), (" .. ", "de")] + [(out[0][0], "en")] * 5


@pytest.mark.parametrize("top, least, percent, step, power", [(20, 3, 100, 8 << 20, 27), (5, 4, 100, 300, 27), (7, 3, 60, 8 << 20, 16), (2000, 5, 100, 100, 27)])
def test_same_as_brute_force(spark, rows, monkeypatch, top, least, percent, step, power):
    monkeypatch.setattr(phrases, "STEP", step)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6 if power == 16 else power)  # a filter that lets nearly all pass changes nothing
    docs = spark.createDataFrame([(t, x, 1) for t, x in rows], "text string, lang string, phrase int").repartition(5)
    assert sorted(tuple(r) for r in phrases.mine(docs, top, least, 5, percent).collect()) == sorted(brute(rows, top, least, 5, percent))


def test_settled_languages_expand_no_further(spark, monkeypatch):
    """Rare pairs settle the result: the most frequent words are never roots."""
    rows = [(f"x{i % 5} y{i % 5}. the of", "en") for i in range(100)] + [("the of and", "en")] * 300
    seen = []
    pair_counts = phrases.pair_counts
    monkeypatch.setattr(phrases, "pair_counts", lambda d, c, r: seen.append(r) or pair_counts(d, c, r))
    found = phrases.mine(spark.createDataFrame(rows, "text string, lang string"), top=3, least=10)
    assert [r["phrase"] for r in found.orderBy("rank").collect()] == [r[2] for r in sorted(brute(rows, 3, 10, 5, 100), key=lambda r: r[1])]
    assert len(seen) == 1


def test_exact_arithmetic(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([(big, 10 * big, big, big + 1)], "a long, n long, l long, r long").select(phrases._score("a", "n", "l", "r").alias("s")).first()
    assert row["s"] == 1000 * big * 10 * big // (big * (big + 1))


def test_words_beside_edges_and_gaps():
    data, starts = phrases.text_buffer(pa.array(["a  , b", "b c", "", None, "d .\t. E"]))
    words = phrases.Words(data, starts, pa.array(["x", None, "x", "x", "y"]))
    assert [words.entries[int(i)].as_py() for i in words.entry] == [b"a", b"b", b"b", b"c", b"d", b"e"]
    assert words.row.tolist() == [0, 0, 1, 1, 4, 4] and words.follows(1).tolist() == [False, False, True, False, False, False]
