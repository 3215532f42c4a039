"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from reelmill.llm import near_dups, packing, phrases, pivot_index, urls
from reelmill.llm.queries import CORPUS_QUERIES, tokenizer_files

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near ann@x.org and 10.0.0.1", "en"),
    (1, "The quick brown fox jumps over the lazy dog near ann@x.org and 10.0.0.1", "en"),
    (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (None, "a text without an id", "en"), (None, None, None),
    (5, LONG, "en"), (6, LONG, "de"), (7, "12345 !!", "de"), (8, "é", "fr"), (9, "short", "en"), (9, "another text of the same id", "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string, score int, term string, head long, "
SCHEMA += "__row long, __score double, whole string, number int, __number int, __spans string, found string, near string"


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    rows = DOCS if request.param == "odd" else []
    docs = [(i, t, x, None, len(t or ""), 0, "s", 1, "t", 2, 7, 0.5, "w", 8, 9, "s", "f", "n") for i, t, x in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, None), (None, 1, 0), (5, 1, 0), (5, 1, 0), (99, None, None)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "quick brown fox jumps"), (1, "quick brown fox jumps"), (2, None), (3, "..."), (None, "short")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, None), (1, None), (2, "no scheme"), (None, "https://A.Example.COM/en/1"), (3, ""), (4, "http://a.com"), (5, "x://b.net/fr/?q#f"), (6, "http://www.example.com/en/x")] if rows else []
    spark.createDataFrame([(i, u, None, "x") for i, u in pages], "page_id long, url string, html string, rule string").write.parquet(f"{path}/pages.parquet")
    vectors = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (50, None, 1), (None, [1.0, 1.0], 2), (51, [0.5, 0.5], None), (52, [], 1)] if rows else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, len(rows)


PER_DOCUMENT = [n for n in CORPUS_QUERIES if n.split("_")[0] in ("op1", "op3", "op5", "op7", "op8", "op10", "op12")]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, folder, name):
    path, rows = folder
    found = CORPUS_QUERIES[name](spark, path).collect()
    assert len(found) == rows
    assert sorted((r["doc_id"] for r in found), key=str) == sorted((d[0] for d in DOCS[:rows]), key=str)
    if not rows:
        return
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0] == by[1][1]
    if name.startswith("op1_"):
        assert by[2][0]["n_bytes"] == 0 and by[5][0]["n_removed"] == len(LONG) and by[9][0]["n_removed"] == 0
    if name.startswith("op3"):
        assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (2, 3, 4, 7))
    if name.startswith("op7"):
        assert by[6][0]["component_id"] == 5 and not by[6][0]["kept"] and by[2][0]["n_shingles"] == 0 and by[8][0]["n_shingles"] == 1
    if name.startswith("op8"):
        assert by[1][0]["n_hit"] == 4 and by[1][0]["n_items"] == 1 and by[2][0]["n_words"] == 0
        assert any(r["contaminated"] for r in by[9])  # the one-word item, whose id is null
    if name.startswith("op12"):
        assert all((by[i][0]["n_a"], by[i][0]["n_links"], by[i][0]["count_sum"], by[i][0]["groups_sha256"]) == (0, 0, 0, "") for i in (2, 3))
        assert by[5][0]["n_groups"] > 30_000 and by[8][0]["n_a"] >= by[8][0]["n_groups"] > 0
    if name.startswith("op10"):
        assert (by[1][0]["n_email"], by[1][0]["n_ip"]) == (1, 1) and by[2][0]["spans"] == ""


def test_packing(spark, folder):
    path, rows = folder
    found = CORPUS_QUERIES["op6_best_fit_packing"](spark, path).collect()
    assert sum(r["piece"] == 0 for r in found) == rows
    places = [(r["sequence_id"], r["offset"]) for r in found]
    assert len(set(places)) == len(places)
    with_ids = packing.pack(spark.read.parquet(f"{path}/documents.parquet"), *tokenizer_files(), with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_search_and_secrets(spark, folder):
    path, rows = folder
    found = CORPUS_QUERIES["op9_pivot_top_k"](spark, path).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in found} == ({(0, 51, 98304)} if rows else set())
    assert len(CORPUS_QUERIES["op2_secret_scan"](spark, path).collect()) >= 0


def test_urls(spark, folder):
    path, rows = folder
    found = CORPUS_QUERIES["op4_url_filter"](spark, path).collect()
    assert len(found) == (8 if rows else 0)
    by = {r["page_id"]: r for r in found}
    if rows:
        assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("", "", None)
        assert (by[None]["host"], by[None]["rule"], by[None]["verdict"]) == ("a.example.com", "example.com/en/", "block")
        assert by[4]["rule"] is None and by[5]["rule"] == "net/fr/" and by[6]["verdict"] == "allow"


def test_phrases_and_archives(spark, folder):
    path, rows = folder
    assert CORPUS_QUERIES["op11_phrase_collocations"](spark, path).count() == 0
    found = phrases.mine(spark.read.parquet(f"{path}/documents.parquet"), least=2).collect()
    assert {r["lang"] for r in found} == ({"en", "de"} if rows else set())
    found = CORPUS_QUERIES["op13_warc_normaliser"](spark, path).collect()
    assert sorted((r["page_id"] for r in found), key=str) == ([1, 1, 2, 3, 4, 5, 6, None] if rows else [])
    assert all((r["payload_bytes"], r["record_type"], r["refers_to"]) == (0, "response", None) for r in found)


def test_pipeline(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).where("piece = 0").count() == sizes[-1]
    if rows:
        near = corpus_pipeline.without_near_duplicates(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()
        assert sum(r["doc_id"] in (5, 6) for r in near) == 1 and sum(r["doc_id"] == 1 for r in near) == 1
        assert sum(r["text"] is None for r in near) == 2 and all((r["__row"], r["whole"], r["number"]) == (7, "w", 8) for r in near)


def test_hot_copies_keep_one_representative(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(500)] + [(1000, "eight nine")], "doc_id long, text string")
    found = near_dups.near_duplicates(docs).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 500} == {0} and sum(r["kept"] for r in found) == 2


def test_large_rule_lists_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(1, "http://a.b.com/x"), (2, "http://c.net/y")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("b.com", "/x", "block")], "host string, path string, action string")
    assert {r["page_id"]: r["rule"] for r in urls.judge_urls(pages, rules).collect()} == {1: "b.com/x", 2: None}


def test_no_usable_vector(spark):
    assert pivot_index.top_k(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")).count() == 0
