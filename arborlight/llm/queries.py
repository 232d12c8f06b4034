"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.llm import bpe, embedding_dedup, langid, licenses, maxscore, minhash_dedup, mixing, quality, secrets, warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "crc32(cast(id as string)) % 5 <> 0")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def warc_records(pages: DataFrame) -> DataFrame:
    """Each page as a full response at second 10 * page_id, and as a later visit that a server answered by 304.

    Every second visit names the page's entity tag, weakly; others a date, a wrong tag, or nothing.
    """
    p = pages.select(F.col("page_id"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    tag = F.concat(F.lit('"'), "digest", F.lit('"'))
    day = F.concat(F.lit("day "), F.expr("page_id div 7").cast("string"))
    said = F.create_map(F.lit("etag"), tag, F.lit("date"), F.concat(F.lit("fetched "), F.col("page_id").cast("string")), F.lit("content-type"), F.lit("text/html"))
    full = p.select((F.col("page_id") * 2).alias("rec_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), day.alias("last_modified"), said.alias("headers"))
    turn = F.pmod(F.col("page_id"), F.lit(8))
    again = p.select(
        (F.col("page_id") * 2 + 1).alias("rec_id"), "url", (F.col("page_id") * 10 + 5 + 10 * F.pmod(F.col("page_id") * 7, F.lit(50))).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(turn.isin(0, 2, 4, 6), F.concat(F.lit("W/"), tag)).when(turn == 1, F.lit('"other"')).alias("etag"), F.when(turn.isin(3, 5), day).alias("last_modified"),
        F.create_map(F.lit("date"), F.concat(F.lit("revisited "), F.col("page_id").cast("string")), F.lit("content-type"), F.lit("none")).alias("headers"),
    )
    return full.unionByName(again)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc_records(table(spark, sf_dir, "pages")))
    joined = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return out.select("rec_id", "url_key", "ts", "original_id", "status", joined.alias("headers"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    terms = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    v = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", terms.alias("terms"))
    found = maxscore.exact_top_k(v.where("vec_id % 50 = 0"), v, "vec_id", "terms", 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), reach=None)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learnt = langid.learn_filter(docs.where(~fold))
    return langid.identify(docs, learnt).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scans, op2_embedding_near_dedup, op3_quality_classifier, op4_warc_revisits, op5_exact_top_k, op6_bpe, op7_minhash_near_dedup, op8_secret_scans, op9_language_id, op10_source_mixing]
    return {f.__name__: f for f in found}


_OP2 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
), good as (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, root) as (
  select vec_id, vec_id from embeddings
  union
  select l.b, r.root from reach r join links l on l.a = r.id
), comp as (select id, min(root) as component_id from reach group by id),
deg as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on c.id = e.vec_id left join deg d on d.a = e.vec_id
"""

_OP4 = r"""
with p as (
  select page_id, url, '"' || md5(coalesce(html, '')) || '"' as tag, 'day ' || (page_id // 7) as day from pages
), c as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from p
), k as (
  select *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\.|:80$|:443$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as main,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') as query from c
), u as (select *, main || case when query <> '' then '?' || query else '' end as url_key from k),
full_ as (select page_id, page_id * 2 as rec_id, url_key, page_id * 10 as ts, tag, day from u),
again as (
  select page_id, page_id * 2 + 1 as rec_id, url_key, page_id * 10 + 5 + 10 * ((page_id * 7) % 50) as ts,
    case when page_id % 8 in (0, 2, 4, 6) then tag when page_id % 8 = 1 then '"other"' end as tag,
    case when page_id % 8 in (3, 5) then day end as day from u
), j as (
  select a.*, f.rec_id as original_id, f.page_id as origin, f.tag as ftag, f.day as fday
  from again a asof left join full_ f on a.url_key = f.url_key and a.ts > f.ts
), s as (
  select *, case when original_id is null then 'missing'
    when tag is not null then case when tag = ftag then 'resolved' else 'mismatch' end
    when day is not null then case when day = fday then 'resolved' else 'mismatch' end else 'unvalidated' end as status from j
)
select rec_id, url_key, ts, original_id, status,
  case when status = 'resolved' then 'content-type=text/html;date=revisited ' || page_id || ';etag=' || ftag
    else 'content-type=none;date=revisited ' || page_id end as headers from s
"""

_OP5 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256.0 * cast(x as double)) as bigint)) as t from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.t, d.t), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": _OP2, "op4_warc_revisits": _OP4, "op5_exact_top_k": _OP5}
