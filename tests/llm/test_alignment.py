"""Alignment against a token-by-token brute force, under every plan of the second pass."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from reelmill.llm import alignment

FILES = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ODD = [
    None, "", "a \u2581 b", "x <|endoftext|> <s> </s> y", "  two  spaces\n\n\ttab", "\ufb01 \uff46\uff55\uff4c\uff4c \u2460", "\U0001f642 \u65e5\u672c\u8a9e \u0627\u0644",
    "a" * 31, "\x00\x01 e\u0301\u00e9", "aaaa aaa" * 3, " lead", "trail ", "same text", "same text", "word " * 20_000,
]


def byte_letters():
    """The characters that a byte-level vocabulary writes for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(rest)}}


def spans(tokens):
    at = 0
    for t in tokens:
        yield at, at + len(t)
        at += len(t)


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second, letters = sentencepiece.SentencePieceProcessor(model_file=FILES[2]), byte_letters()
    found, docs = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        left = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        right = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            found.append(None)
            continue
        sa, sb = list(spans(left)), list(spans(right))
        links, k = [], 0
        for i, (begin, end) in enumerate(sa):
            while sb[k][1] <= begin:
                k += 1
            j = k
            while j < len(sb) and sb[j][0] < end:
                links.append((a[i], b[j]))
                j += 1
        ends_b, groups, pa, pb = {e: n for n, (_, e) in enumerate(sb)}, [], 0, 0
        for i, (_, end) in enumerate(sa):
            if end in ends_b:
                groups.append((a[pa : i + 1], b[pb : ends_b[end] + 1]))
                pa, pb = i + 1, ends_b[end] + 1
        found.append((len(a), len(b), groups, links))
        docs.update(set(links))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    for own in found:
        if own is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        n_a, n_b, groups, links = own
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield n_a, n_b, len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def expected(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] for r in rows] + ODD
    return texts, list(brute(texts))


@pytest.mark.parametrize("hot", [200_000, 50, 0])
def test_same_as_brute_force(spark, expected, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500 if hot else 1 << 20)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(expected[0])], "doc_id long, text string, pair string")
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, *FILES).collect()}
    assert [found[i] for i in range(len(found))] == expected[1]


def test_identity_map():
    assert alignment.identity_map([b" a", b"b", b"", b"zz"], [b"", b"b", b" a", b"b"]).tolist() == [2, 1, -1, -1]
