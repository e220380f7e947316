"""Registered queries of the training-data operators, with DuckDB checks where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.llm import byte_dedup, exact_dups, forest, leaks, licenses, near_dups, quality, ranked, token_counts, warc, whitening, word_bpe, word_dedup

TOKEN_LIMIT = 4096
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@_register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"))
    return (quality.with_quality_score(documents, model)
            .select("doc_id", F.coalesce(~quality.learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


@_register("op4_warc", """
    with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
         w as (select d, max(page_id) as top from p where n >= 1000 group by d)
    select page_id, n as payload_bytes, p.d as payload_digest,
           case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
           case when n >= 1000 and page_id < top then top end as refers_to
    from p left join w on p.d = w.d""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.removal_digest(_table(spark, sf_dir, "documents"))


@_register("op3_bpe_coding")
def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.coding_digest(F.col("text"), tokenizer_path("word_bpe_49k.json"))
    return _table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.*")


@_register("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup.removal_digest(_table(spark, sf_dir, "documents"))


@_register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.token_count(F.col("text"), tokenizer_path("piece_bpe_32k.model"))
    return (_table(spark, sf_dir, "documents")
            .select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), count.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT))


@_register("op2_dart_minhash")
def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_dup_classes(_table(spark, sf_dir, "documents"))


@_register("op6_hash_prefix_forest")
def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"))


@_register("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


@_register("op9_benchmark_leaks")
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register("op12_exact_dedup", r"""
    with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
         g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups.exact_classes(_table(spark, sf_dir, "documents"))


@_register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@_register("op13_ranked_search", r"""
    with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
         n as (select r, doc_id, len(ws) as n from d where len(ws) > 0),
         s as (select count(*) as docs, sum(n)::bigint as terms from n),
         q as (select i, item_id, w, count(*) as times from (
                   select i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w
                   from (select row_number() over () as i, item_id, text from (select distinct item_id, text from benchmark))) group by all),
         tf as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) where w in (select w from q) group by all),
         df as (select w, count(*) as df from tf group by w),
         g as (select w, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as gain from df, s),
         p as (select r, w, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))) as points
               from tf join n using (r), s),
         sums as (select i, item_id, r, doc_id, sum(times * gain * points)::bigint as score
                  from q join g using (w) join p using (w) join n using (r) group by all)
    select item_id, rank::int as rank, doc_id, score from (
        select *, row_number() over (partition by i order by score desc, doc_id) as rank from sums where score > 0) where rank <= 10""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
