"""Whole results against SQL twins, brute force, round trips and held-out labels."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from reelmill.llm import decontaminate, language, near_dups, packing, personal, pivot_index, quality, repeats, secrets, urls
from reelmill.llm.common import row_steps, text_buffer
from reelmill.llm.queries import CORPUS_ORACLE, CORPUS_QUERIES, URL_RULES, tokenizer_files

FOLDER = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def result(spark, name, folder=FOLDER):
    return CORPUS_QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(CORPUS_ORACLE))
def test_same_as_sql(spark, name):
    assert compare(CORPUS_QUERIES[name](spark, FOLDER), connect(FOLDER), CORPUS_ORACLE[name]) is None


# --- repeated strings


def brute_repeats(documents, length):
    seen = Counter(b[i : i + length] for b in documents for i in range(len(b) - length + 1))
    for b in documents:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        yield len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()


def test_repeats(spark, texts):
    found = {r["doc_id"]: tuple(r)[1:5] for r in result(spark, "op1_suffix_array_dedup")}
    assert found == dict(zip(texts, brute_repeats([t.encode() for t in texts.values()], 200)))


def test_repeats_across_chunks_and_hot_heads(spark, monkeypatch):
    """A long text read in chunks, a passage under many different beginnings, and periods."""
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = word(260)
    documents = [word(300) + passage + word(50) for _ in range(40)] + [word(3000) + passage[:220] + word(9000), "ab" * 500, "", passage]
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 20)
    monkeypatch.setattr(repeats, "CHUNK", 4096)
    monkeypatch.setattr(repeats, "row_steps", lambda starts: row_steps(starts, 2000))
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:5] for r in repeats.remove_repeats(docs, 200).collect()}
    assert found == dict(enumerate(brute_repeats([d.encode() for d in documents], 200)))


# --- near duplicates


def shingles(text, words=5):
    own = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute_components(texts, percent=85):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and root[a] != root[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {d: new if r == old else r for d, r in root.items()}
    return {d: (len(sets[d]), root[d]) for d in texts}


def test_near_duplicates(spark, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op7_minhash_near_dedup")}
    assert found == brute_components(texts)


def test_near_duplicates_of_a_crowd(spark, monkeypatch):
    """A family over several blocks whose members differ from their source more than from each other, and the reverse."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    documents = [" ".join(base)]
    for n in range(120):
        own = list(base)
        for at in rng.integers(0, len(own), int(rng.integers(1, 5))):
            own[at] = f"x{n}-{at}"
        documents.append(" ".join(own))
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 32)
    docs = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs).collect()}
    assert found == brute_components(dict(enumerate(documents)))


@pytest.mark.parametrize("group_rows", [2048, 64])
def test_candidates_in_a_template_crowd(spark, monkeypatch, group_rows):
    """Pairs at the threshold among many sets that share a template: members of the crowd sort between them in every order."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    template, rows, planted = draw(200), [], []
    for n in range(800):
        own, changes = draw(100), draw(2 * 24)
        for side in range(2):
            values = np.unique(np.concatenate([template, own, changes[side * 24 : side * 24 + 24]]))
            rows.append((b"%06d" % (2 * n + side), near_dups.signature(values)))
        planted.append((rows[-2][0], rows[-1][0]))
    monkeypatch.setattr(near_dups, "GROUP_ROWS", group_rows)
    sets = spark.createDataFrame(rows, "set_key binary, signature binary")
    pairs = [(bytes(r["a"]), bytes(r["b"])) for r in near_dups.forest_candidates(sets, 0.85).collect()]
    root = {key: key for key, _ in rows}
    for a, b in pairs:
        if root[a] != root[b]:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
    signs = {key: np.frombuffer(s, np.uint8) for key, s in rows}
    close = [(a, b) for a, b in planted if (signs[a] == signs[b]).sum() >= 43]
    assert len(close) > 790 and sum(root[a] == root[b] for a, b in close) >= 0.999 * len(close)
    assert len(pairs) < near_dups.TREES * 4 * len(rows)


def test_a_crowd_descends_without_comparing_all_its_pairs(spark, monkeypatch):
    """Rows of full groups go deeper, in more orders, and only there; the number of pairs held against each other falls."""
    assert [near_dups.orders_at(d, 0.85) for d in (4, 8, 12)] == [16, 35, 71]
    signs = np.random.default_rng(8).integers(0, 256, (400, near_dups.COLUMNS), dtype=np.uint8)
    signs[:300, :48] = signs[0, :48]  # a template
    sets = spark.createDataFrame([(b"%04d" % n, s.tobytes()) for n, s in enumerate(signs)], "set_key binary, signature binary")
    sizes = {}
    for depth in (4, 8, 12):
        groups = near_dups.forest_groups(sets, depth, near_dups.orders_at(depth, 0.85)).groupBy("group").count().collect()
        sizes[depth] = sum(r["count"] ** 2 for r in groups) / len({r["group"] for r in groups})
    assert sizes[12] < sizes[8] < sizes[4]


def thue_morse(size):
    """A word and its complement, on which polynomial sums modulo a power of two agree."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    return word, word.translate({97: 98, 98: 97})


def test_words_that_polynomial_hashes_confuse(spark):
    words = thue_morse(1024) + thue_morse(4096)
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in near_dups.near_duplicates(docs).collect())
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    forms = packing.FormTokenizer(*tokenizer_files())
    texts = [f"x {w} y {w[:24]} {w[:23]} z" for w in words] * 2
    data, starts = text_buffer(pa.array(texts))
    assert [ids.tolist() for ids in forms.encode(data, starts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_of_one_hash_keep_their_own_ids(monkeypatch):
    """All forms in one slot with one hash: each still gets the ids of its own bytes."""
    monkeypatch.setattr(packing, "mix", lambda x: np.zeros_like(x))
    forms = packing.FormTokenizer(*tokenizer_files())
    other = packing.FormTokenizer(*tokenizer_files())
    texts = ["the cat sat on the mat a\0 a b", "cat the on the sat a a\0 b", "mat the cat"]
    data, starts = text_buffer(pa.array(texts))
    assert [i.tolist() for i in forms.encode(data, starts)] == [other._text_ids(t).tolist() for t in texts]


def test_all_exchanges_are_tried():
    """A bin of many sizes whose only helpful exchange sends two small pieces."""
    sizes = [*range(60, 44, -1), 9, 7, 1000, 1008]
    bins = [list(range(16)), [16, 17], [18], [19]]
    better = packing.improve(bins, sizes, 1024)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert any(sum(sizes[i] for i in b) == 1024 for b in better)


def test_pipeline_stage_links_from_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    other = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 86 of 106 shingles: 0.81
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else")], "doc_id long, text string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, FOLDER).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


# --- packing


def test_packing_is_a_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_files()[0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, "op6_best_fit_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert [a for a, _ in places] == [0, *ends[:-1]] and ends[-1] <= 1024
    total = sum(n for places in sequences.values() for _, n in places)
    assert len(sequences) <= -(-total // 1024) + 2


@pytest.mark.parametrize("ranks", [True, False])
def test_form_tokenizer_equals_the_tokenizer(ranks, monkeypatch):
    monkeypatch.setattr(packing, "FORM_SLOTS", 4)  # forms push each other out of the table
    path, rank_file = tokenizer_files()
    forms = packing.FormTokenizer(path, rank_file if ranks else None)
    odd = ["a  b \n c", "  x", "x  ", "\n\n a\tb  c", " don't  I'll", " é <|endoftext|> z<|endoftext|>y ", "", "　あ い", "a\x1c b", "a \x85b", "a b\n", "\nb a a b", "x é b «a b» c"]
    data, starts = text_buffer(pa.array(odd))
    for _ in range(2):
        found = [ids.tolist() for ids in forms.encode(data, starts)]
        assert found == [forms.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_local_search_improves():
    # best fit leaves 7 bins; exchanges reach the least number
    sizes = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2]
    bins = packing.improve([[0], [1], [2, 6], [3, 7], [4, 5], [8, 9]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(10))
    assert all(sum(sizes[i] for i in b) <= 10 for b in bins) and len(bins) == 4


# --- decontamination and search


def brute_near(docs, items, window, slop):
    """Blocks set at every place of every text."""
    found = {}
    for doc_id, text in docs:
        words, own = re.findall("[0-9a-z]+", text.lower()), set()
        for item_id, item in items:
            all_ = re.findall("[0-9a-z]+", item.lower())
            last = max(0, len(all_) - window)
            for at in {*range(0, last + 1, window), last}:
                block = all_[at : at + window]
                for start in range(-window, len(words) + window if len(block) >= 5 else -window):
                    right = sum(w in words[max(0, start + o - slop) : max(0, start + o + slop + 1)] for o, w in enumerate(block))
                    if right >= len(block) - len(block) // 5:
                        own.add(str(item_id))
        found[doc_id] = sorted(own)
    return found


def test_proximity(spark):
    texts = [
        "alpha beta gamma delta omega", "so alpha beta very gamma delta omega", "alpha beta gamma delta", "beta gamma delta omega and more",
        "alpha beta sigma delta omega", "alpha gamma beta delta omega", "alpha beta x y z gamma delta omega", "omega delta gamma beta alpha",
        "alpha beta gamma", "alpha beta gamma delta iota", "", "one two three", "say one two nine four five six seven eight extra nine ten",
    ]
    docs = list(enumerate(texts))
    items = [(1, "alpha beta gamma delta omega"), (2, "one two three four five six seven eight nine ten"), (3, "alpha beta"), (4, "unseen beta gamma delta omega")]
    rows = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7, 20, slop=1
    ).collect()
    found = {r["doc_id"]: r["near_items"] for r in rows}
    assert found == brute_near(docs, items, 7, 1)
    assert sorted(n for n in found if "1" in found[n]) == [0, 1, 2, 3, 4, 5, 9] and found[12] == ["2"]


def test_proximity_of_random_texts(spark):
    draw = np.random.default_rng(3)
    words = np.array([f"w{n}" for n in range(40)])
    items = [(n, " ".join(draw.choice(words, size))) for n, size in enumerate([5, 6, 9, 13, 14, 20, 31, 40])]
    docs = []
    for n in range(120):
        text = items[n % len(items)][1].split()
        for _ in range(n % 7):
            at = int(draw.integers(len(text)))
            text[at : at + int(draw.integers(0, 2))] = list(draw.choice(words, int(draw.integers(0, 2))))
            text = text or ["w0"]
        docs.append((n, " ".join([*draw.choice(words, n % 5), *text])))
    rows = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 13, 20, slop=1
    ).collect()
    wanted = brute_near(docs, items, 13, 1)
    # a block names all items that hold it as a window
    assert {r["doc_id"] for r in rows if r["near_items"]} == {n for n, own in wanted.items() if own}
    assert all(set(wanted[r["doc_id"]]) <= set(r["near_items"]) for r in rows)


def test_search_with_ties_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(60)] + [(100, [0.5, 0.5, 0.5]), (150, [2.0, 0.0, 1.0]), (101, None), (102, [nan, 0.0, 0.0]), (103, []), (104, [1.0, None, 0.0]), (200, [1.0, 1.0]), (201, [1.0, -1.0]), (202, [float("inf"), 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    wanted = set()
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        wanted |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    assert {tuple(r) for r in pivot_index.top_k(vectors).collect()} == wanted


# --- personal data


def test_personal_base(spark, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda m: re.sub(r"\D", "", m[0])
    fits = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and sum(int(d) if n % 2 == 0 else sum(divmod(2 * int(d), 10)) for n, d in enumerate(digits(m)[::-1])) % 10 == 0,
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    odd = ["a@@b.c x@y.z@w.q", "..@a.b.c- +%@x.y", "1.2.3.4.5 256.1.1.1 00001.2.3.4", "4111 1111 1111 1111-4", "+1 (555) 123-4567) +12", "4111111111111111@x.io"]
    for text in [*texts.values(), *odd]:
        wanted = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if fits[k](m)]
        assert sorted(personal.base_spans(text)) == sorted(wanted)
    for r in result(spark, "op10_pii_sanitisation"):
        base = personal.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == kind for k, _, _ in base) for kind in patterns)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_revealing_terms(spark):
    """A nickname that stands beside one address in different contexts is removed; words used everywhere stay."""
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(rng.choice(["river", "stone", "cloud", "garden", "window", "paper"], 4))
    rows = [f"{filler()} zorblax ann@x.org {filler()}" for _ in range(6)] + [f"{filler()} u{i}@y.org {filler()}" for i in range(60)] + [filler()] * 5
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = [r["text"] for r in personal.sanitise(docs).orderBy("doc_id").collect()]
    assert not any("zorblax" in t or "@" in t for t in clean) and clean[0].count("[EMAIL]") == 1
    assert clean[-5:] == rows[-5:] and all("[TERM]" not in t for t in clean[6:])


def test_revealing_terms_with_copies_and_footers(spark):
    """A copied document does not weaken a term; a footer in many documents counts in each."""
    rng = np.random.default_rng(6)
    filler = lambda: " ".join(rng.choice(["river", "stone", "cloud", "garden", "window", "paper", "candle", "meadow"], 6))
    near = [f"{filler()} zorblax ann@x.org {filler()}" for _ in range(4)]
    footer = [f"{filler()} {n}\n" + "x " * 150 + "quibnor bob@x.org" for n in range(9)]
    rows = near + [near[0]] * 200 + footer + [f"{filler()} u{i}@y.org {filler()}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = [r["text"] for r in personal.sanitise(docs).orderBy("doc_id").collect()]
    assert not any("zorblax" in t or "quibnor" in t for t in clean)
    assert clean[-1].split("[EMAIL]") == rows[-1].split("u199@y.org")
    assert all("[TERM]" not in t for t in clean[:204])


def test_narrowing_terms_become_broader_ones(spark):
    """A nickname of a few people, all of them sailors, is generalised to the word that the corpus has beside it everywhere."""
    rng = np.random.default_rng(8)
    filler = lambda: " ".join(rng.choice(["river", "stone", "cloud", "garden", "window", "paper", "candle", "meadow"], 4))
    rows = [f"{filler()} sailor zorblax ann@x.org {filler()}" for _ in range(4)] + [f"{filler()} sailor zorblax v{i}@y.org {filler()}" for i in range(4)]
    rows += [f"{filler()} sailor u{i}@y.org {filler()}" for i in range(100)] + [f"{filler()} w{i}@y.org {filler()}" for i in range(200)]
    # the same without a companion in common: nothing broader is known
    rows += [f"quibnor bob@x.org {n}{'z' * n}abc" for n in range(4, 8)] + [f"quibnor t{n}@y.org {n}{'y' * n}abc" for n in range(4, 8)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = [r["text"] for r in personal.sanitise(docs).orderBy("doc_id").collect()]
    assert all(t == r.replace("zorblax", "[sailor]").replace("ann@x.org", "[EMAIL]") for t, r in zip(clean[:4], rows))
    assert all("sailor zorblax [EMAIL]" in t for t in clean[4:8])
    assert all(t.startswith("[TERM] [EMAIL]") for t in clean[-8:-4]) and not any("[TERM]" in t for t in clean[:-8])


def test_nearby_terms_by_words():
    """Six terms a side however far, without those in spans; many spans of a long text take one pass."""
    text = "one1 alpha beta " + "1 " * 2000 + "gamma delta omega kappa 10.0.0.1 " + "- " * 900 + "sigma ann@x.org theta"
    spans = personal.base_spans(text)
    terms = personal.clear_terms(text, spans)
    begins = [t[1] for t in terms]
    near = {text[a:b]: [t for t, _, _ in personal.nearby_terms(terms, begins, a, b)] for _, a, b in spans}
    assert near["10.0.0.1"] == ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    assert near["ann@x.org"] == ["beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    long = "10.0.0.1 ann@xyzzy.org " * 30_000
    began = time.time()
    spans = personal.base_spans(long)
    terms = personal.clear_terms(long, spans)
    begins = [t[1] for t in terms]
    assert len(spans) == 60_000 and not any(personal.nearby_terms(terms, begins, a, b) for _, a, b in spans) and time.time() - began < 10


# --- classifiers


def test_language_and_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in result(spark, "op3_language_id", folder) if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in held)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in result(spark, "op5_quality_classifier", folder) if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_rare_and_many_languages(spark):
    """Few labelled rows among many others, a rare language, and more languages than one word has bits."""
    rng = np.random.default_rng(7)
    letters = [chr(0x4E00 + i) for i in range(80 * 6)]
    text = lambda n: " ".join("".join(rng.choice(letters[6 * n : 6 * n + 6], 6)) for _ in range(60))
    rows = [("common", text(0)) for _ in range(300)] + [("rare", text(1)) for _ in range(2)] + [(None, text(0)) for _ in range(3000)]
    rows += [(f"many{n}", text(n)) for n in range(2, 80) for _ in range(2)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    few = language.fit_filters(docs.where("lang is null or lang in ('common', 'rare')"), F.lit(True), 20)
    assert few.languages == ["common", "rare"] and few.languages[few.default] == "common"
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.where("lang = 'rare'"), few).collect()}
    assert set(found.values()) == {"rare"}
    filters = language.fit_filters(docs, F.lit(True), 20)
    assert len(filters.languages) == 80
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, filters).collect()}
    assert all(found[i] == lang for i, (lang, _) in enumerate(rows) if lang)


def test_prior_and_risk():
    rng = np.random.default_rng(4)
    positive = rng.normal(1, 1, (4000, 3))
    unlabelled = np.vstack([rng.normal(1, 1, (2800, 3)), rng.normal(-3, 1, (1200, 3))])
    model = quality.fit(positive, unlabelled)
    assert 0.6 < model.prior < 0.85
    assert (model.scores(positive) > 0.5).mean() > 0.95 and (model.scores(unlabelled[2800:]) < 0.3).mean() > 0.95


def test_secrets(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = result(spark, "op2_secret_scan", folder)
    real = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{16,}")
    for r in found:
        value = texts[r["doc_id"]][r["begin"] : r["end"]]
        assert r["length"] == len(value)
        assert r["is_secret"] == bool(real.fullmatch(value) and re.search("[a-zA-Z]", value))
    assert any(r["is_secret"] for r in found)


def test_secret_candidates_against_all_pairs():
    """Runs that overlap an assigned value are left to it; many of both cost no more than their number."""
    rng = np.random.default_rng(4)
    parts = ["token=", "abc123def456ghi", " ", "pwd: 9x8y7z6w5v4u", "\n", "word", "0123456789ab", "\"", "a=1", "secret='", "--", "é7"]
    for _ in range(300):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 40))
        assigned = [m.span(1) for m in secrets._ASSIGNED.finditer(text)]
        runs, done = [], 0
        for m in secrets._FROM_DIGIT.finditer(text):
            if m.start() >= done:
                begin = m.start()
                while begin > done and text[begin - 1] in secrets._KEY_CHARACTERS:
                    begin -= 1
                done = m.end()
                runs.append((begin, done))
        free = [r for r in runs if r[1] - r[0] >= secrets.LEAST and not any(a < r[1] and b > r[0] for a, b in assigned)]
        assert secrets.candidates(text) == sorted(free + assigned)
    long = "token=abc123def456 0123456789abcdef " * 20_000
    start = time.perf_counter()
    assert len(secrets.candidates(long)) == 40_000 and time.perf_counter() - start < 5


def test_secrets_are_whole_and_counted_over_all_documents(spark):
    key = "aB3x" * 75
    assert secrets.candidates(f"token={key} end") == [(6, 306)]
    assert secrets.candidates("k" * 5000 + "1") == [(0, 5001)]
    rows = [(i, f"alpha beta {'rare' + chr(97 + i // 1000) if i % 1000 == 0 else ''} t{i}") for i in range(20_000)]
    words = secrets.Vocabulary.learn(spark.createDataFrame(rows, "doc_id long, text string")).words
    assert {"rare" + chr(97 + i) for i in range(20)} <= words
    weighted = spark.createDataFrame([([float(i)], float(i % 2), 500.0 if i == 0 else 1.0) for i in range(1000)], "x array<double>, label double, weight double")
    kept = secrets.bounded(weighted, 100).collect()
    assert 30 < len(kept) < 130 and any(r["x"] == [0.0] and r["weight"] == 500.0 for r in kept)
    assert abs(sum(r["weight"] for r in kept) - 1499) < 400


# --- urls


def test_url_filter(spark):
    """Rules and the model ratio against a plain dictionary version."""
    found = {r["page_id"]: r for r in result(spark, "op4_url_filter")}
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    ruled = {}
    for page, url in pages.items():
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled[page] = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (found[page]["host"], found[page]["path"], found[page]["rule"]) == (host, path, ruled[page][0])
    known = {pages[p]: a == "allow" for p, (_, a) in ruled.items() if a}
    test = {u for u in known if zlib.crc32(u.encode()) % 5 == 0}
    counts, totals = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for u in known.keys() - test:
        s = f"\x02{u}\x03"
        for i in range(1, len(s)):
            for k in range(1, min(i + 1, urls.ORDER) + 1):
                counts[s[i - k + 1 : i + 1]][1 - known[u]] += 1
                totals[s[i - k + 1 : i]][1 - known[u]] += 1

    def p(gram, side):
        if not gram:
            return 1 / urls.ALPHABET
        return (counts[gram][side] + urls.ALPHA * p(gram[1:], side)) / (totals[gram[:-1]][side] + urls.ALPHA)

    def score(u):
        s = f"\x02{u}\x03"
        return sum(math.log(p(g, 0) / p(g, 1)) for i in range(1, len(s)) for g in [s[max(0, i + 1 - urls.ORDER) : i + 1]]) / (len(u) + 1)

    assert len(counts) <= urls.MODEL_GRAMS
    unruled = {pages[i]: found[i] for i in pages if not ruled[i][0]}
    assert unruled
    for u, r in unruled.items():
        assert abs(r["score"] - score(u)) < 2e-6
    sides = [[score(u) for u in test if known[u] == side] for side in (True, False)]
    (a, sa), (b, sb) = [(np.mean(x), np.std(x, ddof=1) + 1e-6) for x in sides]
    threshold = (a * sb + b * sa) / (sa + sb)
    for r in unruled.values():
        if abs(r["score"] - threshold) > 1e-4:
            assert r["verdict"] == ("allow" if r["score"] >= threshold else "block")


def test_url_model_beyond_the_broadcast_bound(spark, monkeypatch):
    """With more n-grams than may be broadcast all of them still count."""
    whole = {r["page_id"]: (r["verdict"], r["score"]) for r in result(spark, "op4_url_filter")}
    monkeypatch.setattr(urls, "MODEL_GRAMS", 100)
    found = {r["page_id"]: (r["verdict"], r["score"]) for r in result(spark, "op4_url_filter")}
    assert found.keys() == whole.keys() and any(s is not None for _, s in whole.values())
    for page, (verdict, score) in whole.items():
        assert found[page][0] == verdict and (score is None) == (found[page][1] is None)
        assert score is None or abs(score - found[page][1]) < 2e-6
