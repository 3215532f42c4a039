"""The corpus operators as named queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, language, near_dups, packing, personal, phrases, pivot_index, quality, repeats, secrets, urls, warc
from .common import table

CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CORPUS_ORACLE: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        CORPUS_QUERIES[name] = build
        return build

    return register


def tokenizer_files() -> tuple[str, str]:
    """The public vocabulary and the same one as ranks; both paths are parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op6_best_fit_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), *tokenizer_files(), capacity=1024, end_id=2)


@query("op7_minhash_near_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, folder, "documents"), words=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op1_suffix_array_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), length=200)


@query("op9_pivot_top_k")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.top_k(table(spark, folder, "embeddings"), every=50, k=5, scale=256.0)


CORPUS_ORACLE["op9_pivot_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id query_id, v.vec_id, cast(list_inner_product(q.e, v.e) as bigint) score
  from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score
  from scored
)
select * from ranked where rank <= 5
"""


def fold(parts: int):
    """crc32 of doc_id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query("op3_language_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = language.fit_filters(docs, fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs, filters).select("doc_id", held, "lang_pred", "score")


@query("op5_quality_classifier")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"), fold(5) != 0)
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    scored = quality.score(docs, model).withColumnRenamed("__score", "score")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_positional_decontamination")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontaminate.contamination(docs, items, window=13, share=20, slop=1)
    near = [F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256")]
    return found.select("*", *near).drop("row", "near_items")


CORPUS_ORACLE["op8_positional_decontamination"] = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from documents
), i as (
  select cast(item_id as varchar) item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') w from benchmark
), windows as (
  select distinct item_id, list_slice(w, p + 1, p + 13) words, p % 13 = 0 or p = greatest(len(w) - 13, 0) block
  from (select item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) p from i where len(w) > 0)
), blocks as (
  select words, len(words) size, row_number() over () id from (select distinct words from windows where block and len(words) >= 5)
), places as (
  select doc_id, id, size, o, x - o + s p
  from (select doc_id, unnest(w) term, unnest(range(len(w))) x from d) join (select id, size, unnest(words) term, unnest(range(size)) o from blocks) using (term),
    (values (-1), (0), (1)) shifts(s)
), near as (
  select distinct doc_id, id from (select doc_id, id, size, p from places group by all having count(distinct o) >= size - size // 5)
), near_named as (
  select doc_id, count(*) n_near, string_agg(item_id, ',' order by item_id) items
  from (select distinct doc_id, item_id from near join blocks using (id) join windows using (words)) group by 1
), sizes as (select distinct len(words) size from windows),
starts as (
  select doc_id, size, list_slice(w, p + 1, p + size) words, p from (
    select doc_id, w, size, unnest(range(len(w) - size + 1)) p from d, sizes where len(w) >= size)
), hits as (
  select doc_id, p, size, item_id from starts join windows using (words)
), covered as (
  select doc_id, count(distinct p + k) n_hit from (select doc_id, p, unnest(range(size)) k from (select distinct doc_id, p, size from hits)) group by 1
), named as (
  select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct doc_id, item_id from hits) group by 1
)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(named.items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated,
  coalesce(n_near, 0) n_near, sha256(coalesce(near_named.items, '')) near_sha256
from d left join covered using (doc_id) left join named using (doc_id) left join near_named using (doc_id)
"""


@query("op10_pii_sanitisation")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_report(table(spark, folder, "documents"))


#: The given rules: host, path, action.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query("op4_url_filter")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules)


@query("op2_secret_scan")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query("op13_warc_normaliser")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(table(spark, folder, "pages"))


CORPUS_ORACLE["op13_warc_normaliser"] = """
with p as (
  select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest,
    case when strlen(coalesce(html, '')) >= 1000 then max(page_id) over (partition by coalesce(html, '')) end first_id
  from pages
)
select page_id, payload_bytes, payload_digest,
  case when first_id is not null and (page_id is null or page_id < first_id) then 'revisit' else 'response' end record_type,
  case when first_id is not null and (page_id is null or page_id < first_id) then first_id end refers_to
from p
"""


@query("op12_tokenizer_alignment")
def _(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, folder, "documents"), *tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_phrase_collocations")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"), top=2000, least=100, longest=5, percent=100)


CORPUS_ORACLE["op11_phrase_collocations"] = r"""
with d as (
  select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
), p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d
), w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w from p
), totals as (select lang, cast(sum(len(w)) as bigint) n from w group by 1
), places as (select lang, w, unnest(range(len(w))) i from w
), grams as (select lang, w[i + 1 : i + m] g, m from places, (select unnest(range(1, 6)) m) where i + m <= len(w)
), f as (select lang, g, m, count(*) f from grams group by all having count(*) >= 100
), c as (select lang, g, m, f a, array_to_string(g, ' ') phrase from f where m > 1
), cuts as (
  select c.lang, phrase, a, k, l.f l, r.f r, n, (1000::hugeint * a * n) // (l.f::hugeint * r.f) score
  from (select *, unnest(range(1, c.m)) k from c) c join totals t using (lang)
  join f l on l.lang = c.lang and l.g = c.g[1 : k] join f r on r.lang = c.lang and r.g = c.g[k + 1 : c.m]
), lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), kept as (
  select * from lowest x where not exists (
    select 1 from c y where y.lang = x.lang and y.a >= x.a and y.phrase <> x.phrase and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, cast(score as bigint) score
from kept qualify rank <= 2000
"""
