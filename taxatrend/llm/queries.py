"""The operators' registered queries over the given tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatrend.llm import mixing_queries, packing, pii, quality, sentencepiece_codec, toxicity
from taxatrend.llm.chat_format import format_chats
from taxatrend.llm.common import table
from taxatrend.llm.exact_dedup import exact_groups
from taxatrend.llm.simhash import simhash_groups
from taxatrend.llm.topk_search import top_k
from taxatrend.llm.url_filter import filter_captures, host

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with an end id and decoded again, as digests."""
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles, linked at two bits."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries made out of the hosts of ``pages``: of a host or its parent domain, added, removed and added again."""
    hosts = pages.select("page_id", host(F.col("url")).alias("h")).filter("h is not null").groupBy("h").agg(F.min("page_id").alias("m"))
    at = lambda days: F.date_add(F.lit("2020-01-01").cast("date"), days.cast("int"))
    m, first = F.col("m"), F.col("m") * 7 % 700
    event = lambda when, action, day: F.when(when, F.struct(F.lit(action).alias("action"), at(day).alias("day")))
    events = F.array(event(m % 4 != 3, "add", first), event(m % 2 == 0, "remove", first + 30 + m % 200), event(m % 3 == 0, "add", first + 300), event(m % 7 == 0, "remove", first))
    return hosts.select(
        F.when(m % 5 == 0, "allow").otherwise("block").alias("list"),
        F.when(m % 3 == 1, F.regexp_replace("h", r"^[^.]*\.", "")).otherwise(F.col("h")).alias("key"), F.explode(events).alias("e"),
    ).filter("e is not null").select("list", "key", "e.action", "e.day")


@query(r"""
with p as (
  select page_id, url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) as h, date '2020-01-01' + cast(page_id * 37 % 1000 as integer) as fetch_day from pages
), hosts as (select h, min(page_id) as m from p where h <> '' group by h),
e0 as (select *, case when m % 5 = 0 then 'allow' else 'block' end as list, case when m % 3 = 1 then regexp_replace(h, '^[^.]*\.', '') else h end as key, m * 7 % 700 as first from hosts),
e as (
  select list, key, 'add' as action, first as nth from e0 where m % 4 <> 3 union all select list, key, 'remove', first + 30 + m % 200 from e0 where m % 2 = 0
  union all select list, key, 'add', first + 300 from e0 where m % 3 = 0 union all select list, key, 'remove', first from e0 where m % 7 = 0
), daily as (select list, key, date '2020-01-01' + cast(nth as integer) as day, bool_or(action = 'remove') as removed from e group by 1, 2, 3),
v as (select *, lead(day) over (partition by list, key order by day) as until from daily),
a as (select * from v where not removed),
hits as (
  select p.page_id, a.list, a.key from p join a on (p.h = a.key or ends_with(p.h, '.' || a.key)) and p.fetch_day >= a.day and (a.until is null or p.fetch_day < a.until)
), best as (select page_id, list, arg_max(key, length(key)) as key, max(length(key)) as n from hits group by 1, 2)
select p.page_id, nullif(p.h, '') as host, cast(p.fetch_day as varchar) as fetch_day, b.key as blocked_by, w.key as allowed_by, b.key is null or coalesce(w.n >= b.n, false) as kept
from p left join best b on b.page_id = p.page_id and b.list = 'block' left join best w on w.page_id = p.page_id and w.list = 'allow'
""")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active on the day it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 37 % 1000).cast("int")))
    return filter_captures(captures, list_entries(pages)).select("page_id", "host", F.col("fetch_day").cast("string").alias("fetch_day"), "blocked_by", "allowed_by", "kept")


def span_list(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text. n_email to n_phone count base spans, n_added the spans beyond them; ``spans`` has all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    return found.select(
        "doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


@query("""
with v as (
  select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0
), r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("kept"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query(r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of the normalised texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


@query()
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired at least cost and rendered, turn by turn."""
    return format_chats(table(spark, sf_dir, "conversations"))


query(mixing_queries.OP11)(mixing_queries.op11_target_resampling)
query()(mixing_queries.op12_source_mixing)
query(mixing_queries.OP13)(mixing_queries.op13_conversation_repair)
