"""Queries of the llm operators; each takes (spark, data directory) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import abuse, leak, linkage, matching, packing, survivor
from larder.session import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.found(read(spark, d, "nutrition_sample"))


def p2_products(spark: SparkSession, d: str) -> DataFrame:
    """Product of every listing, with the merged attributes."""
    return matching.product_table(read(spark, d, "nutrition_sample"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.found(read(spark, d, "fda_recalls_sample"), read(spark, d, "nutrition_sample"))


def p3_confidences(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of recalls and catalogue products with their confidence."""
    return linkage.confidences(read(spark, d, "fda_recalls_sample"), read(spark, d, "nutrition_sample"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.found(read(spark, d, "dedup_clusters"), read(spark, d, "source_trust"))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(read(spark, d, "dedup_clusters"), read(spark, d, "source_trust"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.found(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents per leaked test item, with the longest passage found."""
    pairs = leak.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))
    return pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words_found").alias("most_words"), F.max("words_item").alias("words_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(read(spark, d, "documents"), read(spark, d, "review_labels"))


def p9_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of unwanted documents per source."""
    documents = read(spark, d, "documents")
    return abuse.source_rates(abuse.document_scores(documents, *abuse.train(documents, read(spark, d, "review_labels"))))


QUERIES = {f.__name__: f for f in (p2_found, p2_products, p3_found, p3_confidences, p5_found, p5_survivors, p7_packed, p8_found, p8_leak_report, p9_found, p9_source_rates)}
_MISSING = ", ".join(f"'{w}'" for w in survivor.MISSING)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
#: Each real value against every other member's, written out as the definition says.
_P5 = f"""with c as (select run_id, cluster_id, arg_max(members, id) members from dedup_clusters group by 1, 2),
    m as (select run_id, cluster_id, unnest(json_extract(members, '$[*]')) j from c where json_valid(members)),
    f as (select distinct run_id, cluster_id, field_name, cast(json_extract_string(j, '$.member_id') as bigint) member_id, json_extract_string(j, '$.' || field_name) v, lower(trim(json_extract_string(j, '$.data_source'))) s, trim(json_extract_string(j, '$.published_date')) d
        from m, (select unnest(['product_name', 'brand_name', 'ingredients', 'food_category']) field_name)),
    t as (select lower(trim(data_source)) s, min(trust_rank) r from source_trust group by 1),
    g as (select f.*, coalesce(t.r, 2147483647) r, length({_STRIP.format("v")}) n, coalesce(case when regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}($|[T ])') then try_cast(d[1:10] as date) when regexp_matches(d, '^[0-9]{{8}}$') then try_strptime(d, '%Y%m%d')::date
        when regexp_matches(d, '^[0-9]{{9,10}}$') then to_timestamp(cast(d as bigint))::timestamp::date else try_strptime(d, '%d %b %Y')::date end, date '0001-01-01') dt
        from f left join t using (s) where v is not null and lower({_STRIP.format("v")}) not in ({_MISSING}))
    select run_id, cluster_id, field_name, member_id from g a where not exists (select 1 from g b where b.run_id = a.run_id and b.cluster_id = a.cluster_id and b.field_name = a.field_name and b.member_id <> a.member_id
        and not (a.dt >= b.dt and a.r <= b.r and a.n >= b.n and (a.dt > b.dt or a.r < b.r or a.n > b.n)))"""
ORACLES: dict[str, str] = {"p5_found": _P5}
