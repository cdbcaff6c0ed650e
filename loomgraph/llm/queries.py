"""The registered queries of the training-data operators; thin over the operators, parameters are the production ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm_lm, license_scan, line_dedup, quality_knn, simhash_dedup, source_mix, token_counts, topk_search, url_filter
from .common import crc_mod, table


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after the privacy scrub's edits."""
    trees = token_counts.build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = token_counts.apply_edits(trees)
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_edits", "edited_tokens", "edited_chars", "reencoded_chars")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"), "license", F.array_join("matches", "|").alias("licenses"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_knn.fit(docs, labels.where(crc_mod("doc_id", 4) != 2))
    out = quality_knn.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= quality_knn.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_table(spark, sf_dir, F.col("vec_id") % 20 == 0)


def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.length("text").cast("long").alias("kept_chars"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_edit_token_counts, op2_license_scan, op3_quality_knn, op4_decontaminate, op5_topk_search, op6_hmm_lm, op7_source_mix, op8_line_dedup, op9_simhash_dedup, op10_url_filter)
    return {f.__name__: f for f in ops}


OP5_SQL = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({topk_search.SCALE} * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select r, vec_id, unnest(e) as x, unnest(range(len(e))) as d from v),
s as (select q.r as q, c.r as r, sum(q.x * c.x) as score from c join (select * from c where vec_id % 20 = 0) q on q.d = c.d and q.r <> c.r group by 1, 2
    union all select q.r, v.r, 0 from v join v q on q.vec_id % 20 = 0 and q.r <> v.r and (len(q.e) = 0 or len(v.e) = 0)),
named as (select s.q, a.vec_id as query_id, b.vec_id, cast(s.score as bigint) as score from s join v a on s.q = a.r join v b on s.r = b.r)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by q order by score desc, vec_id) as rank from named) where rank <= {topk_search.TOP_K}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.scan_sql(), "op5_topk_search": OP5_SQL, "op7_source_mix": source_mix.mix_sql()}
