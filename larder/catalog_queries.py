"""Queries of mapping, cleaning, quality, deduplication, enrichment, joins and profiles, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import cleaning, dedup, enrich, joins, mapping, profiling, quality
from larder.plans import registry
from larder.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _map(df: DataFrame, *ops: dict) -> DataFrame:
    return mapping.apply(df, {"column_operations": list(ops)})


@query("select o_orderkey as order_id, case when o_totalprice = floor(o_totalprice) then cast(o_totalprice as bigint) end as price_int, cast(o_orderpriority as varchar) as priority from orders")
def m_rename_cast(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return _map(df, {"action": "rename", "source": "o_orderkey", "target": "order_id"}, {"action": "type_cast", "source": "o_totalprice", "target": "price_int", "type": "integer"}, {"action": "to_string", "source": "o_orderpriority", "target": "priority"})


@query("select o_orderkey, case lower(trim(o_orderstatus)) when 'f' then 'final' when 'o' then 'open' else o_orderstatus end as status from orders")
def m_value_map(spark, d):
    return _map(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"action": "value_map", "source": "o_orderstatus", "target": "status", "mapping": {"F": "final", " O ": "open"}})


@query("select p_partkey, try_cast(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') as bigint) as brand_no from part")
def m_regex_extract(spark, d):
    return _map(read(spark, d, "part").select("p_partkey", "p_brand"), {"action": "regex_extract", "source": "p_brand", "target": "brand_no", "pattern": r"#(\d+)", "type": "integer"})


@query("select p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\\2-\\1', 'g') as brand_swapped from part")
def m_regex_replace(spark, d):
    return _map(read(spark, d, "part").select("p_partkey", "p_brand"), {"action": "regex_replace", "source": "p_brand", "target": "brand_swapped", "pattern": r"([A-Za-z]+)#(\d+)", "replacement": r"\2-\1"})


@query("select c_custkey, substr(c_name, 1, 8) as short_name, case when length(cast(c_nationkey as varchar)) < 4 then lpad(cast(c_nationkey as varchar), 4, '0') else cast(c_nationkey as varchar) end as nation_code, case when length(c_mktsegment) < 12 then rpad(c_mktsegment, 12, '.') else c_mktsegment end as segment from customer")
def m_pad_truncate(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return _map(df, {"action": "truncate_string", "source": "c_name", "target": "short_name", "max_length": 8}, {"action": "pad_string", "source": "c_nationkey", "target": "nation_code", "min_length": 4}, {"action": "pad_string", "source": "c_mktsegment", "target": "segment", "min_length": 12, "fill_char": ".", "side": "right"})


@query("select p_partkey, p_name, case when p_name is null then 'other' when contains(lower(p_name), 'red') then 'warm' when contains(lower(p_name), 'blue') then 'cold' else 'other' end as tone from part")
def m_conditional_map(spark, d):
    return _map(read(spark, d, "part").select("p_partkey", "p_name"), {"action": "conditional_map", "source": "p_name", "target": "tone", "mapping": {"RED": "warm", "blue": "cold"}, "default": "other"})


@query("select doc_id, coalesce(contains(lower(text), 'recall') or contains(lower(text), 'allerg'), false) as about_safety from documents")
def m_contains_flag(spark, d):
    return _map(read(spark, d, "documents").select("doc_id", "text"), {"action": "contains_flag", "source": "text", "target": "about_safety", "keywords": ["Recall", "allerg"]}).drop("text")


@query("select record_id, coalesce(brand_name, brand_owner) as maker, case when brand_name is not null or product_name is not null then concat_ws(' - ', brand_name, product_name) end as label, coalesce(brand_name, '') || '/' || coalesce(brand_owner, '') as both_names from nutrition_sample")
def m_coalesce_concat(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "brand_name", "brand_owner", "product_name")
    df = _map(df, {"action": "coalesce", "sources": ["brand_name", "brand_owner", "absent"], "target": "maker"}, {"action": "concat_columns", "sources": ["brand_name", "product_name"], "target": "label", "separator": " - "}, {"action": "concat_columns", "sources": ["brand_name", "brand_owner"], "target": "both_names", "separator": "/", "exclude_nulls": False})
    return df.select("record_id", "maker", "label", "both_names")


@query("select p_partkey, coalesce(p_name, '') || ' (' || coalesce(cast(p_size as varchar), '') || ', ' || coalesce(p_brand, '') || ')' as title from part")
def m_template(spark, d):
    return _map(read(spark, d, "part"), {"action": "string_template", "template": "{p_name} ({p_size}, {p_brand})", "target": "title"}).select("p_partkey", "title")


@query("select record_id, trim(string_split(gcs_source_file, '/')[1]) as feed, trim(string_split(gcs_source_file, '/')[2]) as shard, trim(string_split(gcs_source_file, '/')[5]) as nothing from nutrition_sample")
def m_split(spark, d):
    df = _map(read(spark, d, "nutrition_sample").select("record_id", "gcs_source_file"), {"action": "split_column", "source": "gcs_source_file", "delimiter": "/", "column_names": ["feed", "shard", "file", "x", "nothing"]})
    return df.select("record_id", "feed", "shard", "nothing")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1.0 - l_discount) as net, case when l_tax = 0 then case when l_discount > 0 then 'inf' when l_discount = 0 then 'nan' end else cast(round(l_discount / l_tax, 6) as varchar) end as ratio from (select *, 1 as one from lineitem)")
def m_expression(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    df = _map(df, {"action": "expression", "expression": "l_extendedprice * (1 - l_discount)", "target": "net"}, {"action": "expression", "expression": "l_discount / l_tax", "target": "q"})
    ratio = F.when(F.col("q") == float("inf"), "inf").when(F.isnan("q"), "nan").otherwise(F.round("q", 6).cast("string"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "net", ratio.alias("ratio"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def m_extract_json_field(spark, d):
    return _map(read(spark, d, "events").select("event_id", "props"), {"action": "extract_json_field", "source": "props", "target": "k", "key": "k", "type": "integer"})


@query(
    """select id, (select string_agg(v, ', ' order by i) from (select json_extract_string(e, '$.data_source') v, i from (select unnest(json_extract(members, '$[*]')) e, generate_subscripts(json_extract(members, '$[*]'), 1) i)) where v is not null) as sources,
    (select first(n order by i) from (select json_extract_string(e, '$.product_name') n, i from (select unnest(json_extract(members, '$[*]')) e, generate_subscripts(json_extract(members, '$[*]'), 1) i) where lower(json_extract_string(e, '$.data_source')) = 'off' and list_contains(json_keys(e), 'product_name'))) as off_name
    from dedup_clusters"""
)
def m_json_array_multi(spark, d):
    df = _map(
        read(spark, d, "dedup_clusters").select("id", "members"),
        {"action": "json_array_extract_multi", "source": "members", "target_columns": {"sources": {"key": "data_source", "join_all": True}, "off_name": {"key": "product_name", "filter": {"data_source": "OFF"}}}},
    )
    return df.select("id", "sources", "off_name")


@query("select doc_id, case when regexp_matches(text, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>') then regexp_replace(regexp_extract(text, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), '^\\s+|\\s+$', '', 'g') end as paragraph from documents")
def m_xml_extract(spark, d):
    return _map(read(spark, d, "documents").select("doc_id", "text"), {"action": "xml_extract", "source": "text", "target": "paragraph", "tag": "p"}).select("doc_id", "paragraph")


@query("select record_id, case when regexp_matches(published_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then strftime(try_strptime(published_date, '%Y-%m-%d'), '%Y-%m-%d') end as published from nutrition_sample")
def m_parse_date(spark, d):
    df = _map(read(spark, d, "nutrition_sample").select("record_id", "published_date"), {"action": "parse_date", "source": "published_date", "target": "published", "format": "%Y-%m-%d"})
    return df.withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("select record_id, lower(brand_name) as low, upper(brand_owner) as up, regexp_replace(food_category, '^\\s+|\\s+$', '', 'g') as category from nutrition_sample")
def m_case_strip(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "brand_name", "brand_owner", "food_category")
    return _map(df, {"action": "to_lowercase", "source": "brand_name", "target": "low"}, {"action": "to_uppercase", "source": "brand_owner", "target": "up"}, {"action": "format_transform", "transform": "strip", "source": "food_category", "target": "category"})


@query("select p_partkey, p_name, cast(null as double) as weight, 'piece' as unit from part")
def m_set_null_default(spark, d):
    df = read(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return _map(df, {"action": "set_null", "target": "weight", "type": "float"}, {"action": "set_default", "target": "unit", "default_value": "piece"}, {"action": "set_null", "target": "p_name"}, {"action": "drop_column", "source": "p_type"})


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"select record_id, nullif({_STRIP.format('product_name')}, '') as product_name, nullif({_STRIP.format('food_category')}, '') as food_category, lower(nullif({_STRIP.format('brand_name')}, '')) as brand_name from nutrition_sample")
def b_strip_lower(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "food_category", "brand_name")
    return df.transform(cleaning.strip_whitespace).transform(cleaning.lowercase_brand)


_LEGAL = "|".join(cleaning.LEGAL)


@query(f"with t as (select record_id, brand_owner, {_STRIP.format(f'''regexp_replace(brand_owner, '(?i)\\b(?:{_LEGAL})\\b\\.?', '', 'g')''')} as c from nutrition_sample) select record_id, case when c = '' then brand_owner else c end as brand_owner from t")
def b_noise_words(spark, d):
    return cleaning.remove_noise_words(read(spark, d, "nutrition_sample").select("record_id", "brand_owner"), ["brand_owner"])


@query("select record_id, case when product_name = '' then product_name else trim(regexp_replace(regexp_replace(product_name, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) end as product_name from nutrition_sample")
def b_strip_punctuation(spark, d):
    return cleaning.strip_punctuation(read(spark, d, "nutrition_sample").select("record_id", "product_name"), ["product_name"])


_QTY = "(?i)([0-9]+\\.?[0-9]*)\\s*(oz|g|mg|kg|lb|lbs|ml|l|fl\\s*oz|gal|ct|count|pk|pack)\\b"


@query(
    f"""with t as (select record_id, product_name, regexp_extract_all(product_name, '{_QTY}', 1) a, regexp_extract_all(product_name, '{_QTY}', 2) b,
      regexp_replace(regexp_replace(regexp_replace(product_name, '{_QTY}', '', 'g'), '\\s+', ' ', 'g'), '^[, ]+|[, ]+$', '', 'g') r from nutrition_sample)
    select record_id, case when len(a) > 0 and r <> '' then r else product_name end as product_name,
      case when len(a) > 0 then array_to_string(list_transform(generate_series(1, len(a)), lambda i: a[i] || b[i]), '; ') end as sizes from t"""
)
def b_extract_quantity(spark, d):
    return cleaning.extract_quantity(read(spark, d, "nutrition_sample").select("record_id", "product_name"))


# The values that results must equal, in the SQL's own words.
_SQL_ALLERGENS = {
    "egg": "eggs?|albumin|lysozyme|mayonnaise", "fish": "fish|cod|salmon|tuna|anchovies?|bass|tilapia", "milk": "milk|dairy|lactose|casein|whey|cream|butter", "peanut": "peanuts?",
    "sesame": "sesame|tahini", "shellfish": "shellfish|shrimps?|crabs?|lobsters?|crawfish|prawns?", "soybean": "soy|soybeans?|soya|tofu|edamame|lecithin",
    "tree nut": "almonds?|cashews?|walnuts?|pecans?|pistachios?|macadamia|hazelnuts?|brazil\\s*nuts?", "wheat": "wheat|flour|gluten|semolina|durum|spelt",
}
_SAYS = "case when lower({0}) not in ('', 'nan', 'none', '<na>') then {0} end"


def _labels(column: str, table: dict[str, str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when regexp_matches({column}, '(?i)\\b(?:{p})\\b') then '{a}' end" for a, p in sorted(table.items())) + ")"


@query(
    f"""with t as (select record_id, coalesce({_SAYS.format('ingredients')}, {_SAYS.format('food_category')}) c from nutrition_sample)
    select record_id, case when {_STRIP.format('c')} <> '' then {_labels('c', _SQL_ALLERGENS)} end as allergens from t"""
)
def b_extract_allergens(spark, d):
    """Allergens of the ingredients; rows without any are read in a second text, as recall reasons are."""
    df = read(spark, d, "nutrition_sample").select("record_id", "ingredients", F.col("food_category").alias("recall_reason"))
    return cleaning.extract_allergens(df).select("record_id", "allergens")


@query(
    """with t as (select doc_id, list_filter(regexp_extract_all(text, '\\b([A-Z][0-9]{2}(?:\\.[0-9A-Z]{1,4})?)\\b', 1), lambda x: x <> '') a from documents)
    select doc_id, array_to_string(list_sort(list_distinct(a)), ', ') as codes from t where len(a) > 0"""
)
def b_disease_codes(spark, d):
    """Documents with texts that look like disease codes, the codes in alphabetical order."""
    df = cleaning.extract_codes(read(spark, d, "documents").select("doc_id", "text"), "text", "codes").filter("codes is not null")
    return df.select("doc_id", F.array_join(F.array_sort(F.split("codes", ", ")), ", ").alias("codes"))


@query(
    "with t as (select doc_id, concat_ws(', ', "
    + ", ".join(f"case when regexp_matches(coalesce(text, '') || case when doc_id % 3 = 0 then ' took Metformin and ASPIRIN' else '' end, '(?i)\\b{w}\\b') then '{w}' end" for w in (
        "metformin lisinopril atorvastatin omeprazole amlodipine levothyroxine albuterol gabapentin losartan metoprolol "
        "aspirin warfarin furosemide prednisone insulin sertraline escitalopram azithromycin ciprofloxacin ibuprofen").split())
    + ") m from documents) select doc_id, nullif(m, '') as medications from t"
)
def b_medications(spark, d):
    """Medications named in texts, to a third of which a sentence with two is added."""
    added = F.when(F.col("doc_id") % 3 == 0, " took Metformin and ASPIRIN").otherwise("")
    df = read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("text"))
    return cleaning.extract_words(df, "text", "medications").select("doc_id", "medications")


@query("select record_id, case when trim(brand_owner) <> '' then regexp_extract(regexp_replace(brand_owner, '^\\s+|\\s+$', '', 'g'), '([^\\s]+)$', 1) end as last_word from nutrition_sample")
def b_last_word(spark, d):
    return cleaning.last_word(read(spark, d, "nutrition_sample").select("record_id", "brand_owner"), "brand_owner", "last_word").select("record_id", "last_word")


@query(
    f"""with v as (select distinct lower(brand_owner) v from nutrition_sample where brand_owner is not null), w as (select unnest(list_distinct(regexp_extract_all(v, '([\\p{{L}}\\p{{N}}_]+)', 1))) word from v), c as (select word, count(*) documents from w group by 1)
    select word, documents from c where documents >= (select greatest(2, floor(count(*) * 0.1)) from v) or word in ({', '.join(f"'{w}'" for w in cleaning.LEGAL)})"""
)
def b_noise_word_stats(spark, d):
    return cleaning.noise_words(read(spark, d, "nutrition_sample"), "brand_owner")


@query()
def b_repair_text(spark, d):
    return cleaning.repair_text(read(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", F.length("text").alias("n_chars"), "text_changed")


@query("select doc_id, cast(doc_type as varchar) as doc_type, try_cast(n_chars as double) as n_chars, cast(null as boolean) as reviewed, lang from documents")
def q_schema_enforce(spark, d):
    schema = quality.Schema((quality.Field("doc_id", "integer", required=True), quality.Field("doc_type"), quality.Field("n_chars", "float"), quality.Field("reviewed", "boolean"), quality.Field("lang", required=True)))
    return quality.enforce(read(spark, d, "documents"), schema)


@query(
    """with m as (select max(length(ingredients)) l from nutrition_sample), t as (select record_id, ((product_name is not null)::int + (brand_name is not null)::int + (ingredients is not null)::int + (food_category is not null)::int + (published_date is not null)::int) / 5.0::double c,
    case when regexp_matches(published_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(published_date as date) end dt, coalesce(length(ingredients)::double / l, 0.0) r from nutrition_sample, m)
    select record_id, round_even(100 * (0.4::double * c + 0.35::double * coalesce(greatest(1 - greatest(date_diff('day', dt, date '2024-06-30'), 0) / 730.0::double, 0.0), 0.5) + 0.25::double * r), 2) as score from t"""
)
def q_dq_score(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name", "ingredients", "food_category", "published_date")
    iso = F.when(F.col("published_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("published_date"))
    df = df.withColumn("iso", iso)
    scored = quality.quality_score(df, "score", "2024-06-30", ["product_name", "brand_name", "ingredients", "food_category", "published_date"], date_col="iso")
    return scored.select("record_id", "score")


@query("select record_id, product_name, brand_name from nutrition_sample where product_name is not null and brand_name is not null")
def q_quarantine_clean(spark, d):
    return quality.split_quarantine(read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name"), ["product_name", "brand_name"])[0]


@query("select record_id, 'Null in required field(s): ' || concat_ws(', ', case when brand_name is null then 'brand_name' end, case when product_name is null then 'product_name' end) as reason from nutrition_sample where product_name is null or brand_name is null")
def q_quarantine_reasons(spark, d):
    return quality.split_quarantine(read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name"), ["product_name", "brand_name"])[1].select("record_id", "reason")


_NUTRITION = ["product_name", "brand_owner", "brand_name", "ingredients", "food_category", "serving_size", "serving_size_unit", "published_date"]


@query(" union all ".join(f"select '{c}' as column_name, round(avg(({c} is null)::int), 6) as null_rate from nutrition_sample" for c in _NUTRITION))
def q_null_rates(spark, d):
    return quality.null_rates(read(spark, d, "nutrition_sample"), _NUTRITION).withColumn("null_rate", F.round("null_rate", 6))


@query("select p_name, p_brand, count(*) as n, min(p_partkey) as first_id, max(p_partkey) as last_id from part group by 1, 2 having count(*) > 1")
def d_exact_duplicates(spark, d):
    return dedup.exact_duplicates(read(spark, d, "part"), ["p_name", "p_brand"], "p_partkey")


@query()
def d_fuzzy_groups(spark, d):
    """Fuzzy groups of the catalogue's listings."""
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name")
    return dedup.duplicate_groups(df, "record_id").select("record_id", "duplicate_group_id", "canonical")


@query()
def d_components(spark, d):
    """Components of all parts and suppliers (negative) by who delivers what, over the whole table; tested against brute force on small
    graphs, as a recursive SQL is too slow on whole tables."""
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b")).distinct()
    return dedup.connected_components(e)


@query(
    """select p_brand, min(p_partkey) as p_partkey, arg_max(p_name, length(p_name) * 1000000000 - p_partkey) as p_name, arg_max(p_type, length(p_type) * 1000000000 - p_partkey) as p_type, arg_min(p_size, p_partkey) as p_size from part group by p_brand"""
)
def d_merge_longest(spark, d):
    return dedup.merge_columns(read(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_brand", "p_partkey")


@query(
    """with t as (select record_id, data_source, food_category, ((food_category is not null)::int + (ingredients is not null)::int + (brand_name is not null)::int) / 3.0::double c, coalesce(length(ingredients)::double / (select max(length(ingredients)) from nutrition_sample), 0.0) r, brand_name, ingredients from nutrition_sample),
    s as (select *, round(0.4::double * c + 0.35::double * 0.5 + 0.25::double * r, 9) g from t), k as (select *, row_number() over (partition by data_source order by g desc, record_id) i from s) select data_source, record_id, round(g, 6) as golden_score from k where i = 1"""
)
def d_golden(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "data_source", "food_category", "brand_name", "ingredients")
    return dedup.golden_records(df, "data_source", "record_id", text="ingredients").select("data_source", "record_id", F.round("golden_score", 6).alias("golden_score"))


@query("with g as (select count(*) n from part group by p_brand, p_type) select cast(sum(n) as bigint) as rows, count(*) as clusters, round(1 - count(*) / sum(n), 6) as duplicate_rate from g")
def d_cluster_stats(spark, d):
    df = read(spark, d, "part").withColumn("g", F.concat_ws("|", "p_brand", "p_type"))
    return dedup.cluster_stats(df, "g").select("rows", "clusters", F.round("duplicate_rate", 6).alias("duplicate_rate"))


@query("with g as (select distinct p_brand from part) select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as bigint) as group_no from part")
def d_group_numbers(spark, d):
    return dedup.dense_group_ids(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "group_no")


def _rule_sql(rule: enrich.Rule, text: str) -> str:
    hit = lambda p: f"regexp_matches({text}, '(?i){p}')"
    if rule.kind == "boolean":
        return " or ".join(hit(p) for p, _ in rule.patterns)
    if rule.kind == "multi":
        return "concat_ws(', ', " + ", ".join(f"case when {hit(p)} then '{v}' end" for p, v in rule.patterns) + ")"
    return "case " + " ".join(f"when {hit(p)} then '{v}'" for p, v in rule.patterns) + " end"


_RULE_TEXT = "concat_ws(' ', coalesce(product_name, ''), coalesce(ingredients, ''))"


@query(f"with t as (select record_id, {_RULE_TEXT} x from nutrition_sample) select record_id, " + ", ".join(f"{_rule_sql(r, 'x')} as {r.name}" for r in enrich.FOOD_RULES) + " from t")
def e_rules(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "ingredients")
    return enrich.apply_rules(df).select("record_id", *[r.name for r in enrich.FOOD_RULES])


_KNN = """with q as (select vec_id query_id, cast(embedding as double[]) v from embeddings where vec_id % 100 = 0), c as (select vec_id, label, cast(embedding as double[]) v from embeddings),
    s as (select query_id, vec_id, cast(label as varchar) as label, round(list_cosine_similarity(q.v, c.v), 9) similarity, row_number() over (partition by query_id order by round(list_cosine_similarity(q.v, c.v), 12) desc, vec_id) as rank from q, c)"""


def _neighbours(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    e = read(spark, d, "embeddings")
    return enrich.knn(e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, k)


@query(_KNN + " select query_id, vec_id, label, round(similarity, 6) as similarity, cast(rank as integer) as rank from s where rank <= 5")
def e_knn(spark, d):
    return _neighbours(spark, d).withColumn("similarity", F.round("similarity", 6))


@query(_KNN + ", v as (select query_id, label, sum(similarity) s, avg(similarity) confidence from s where rank <= 5 and similarity >= 0.45 group by 1, 2), b as (select *, row_number() over (partition by query_id order by s desc, label) i from v) select query_id, case when confidence >= 0.6 then label end as category, round(confidence, 6) as confidence from b where i = 1")
def e_category_vote(spark, d):
    return enrich.category_vote(_neighbours(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("with k as (select recall_number, recalling_firm, classification, row_number() over (partition by recalling_firm order by recall_number, classification) i from fda_recalls_sample), f as (select * from k where i = 1) select n.record_id, f.recall_number, f.classification, f.recalling_firm is not distinct from n.brand_owner as is_recalled from nutrition_sample n left join f on f.recalling_firm is not distinct from n.brand_owner")
def j_recall_null_safe(spark, d):
    recalls = read(spark, d, "fda_recalls_sample").select(F.col("recalling_firm").alias("brand_owner"), "recall_number", "classification")
    df = read(spark, d, "nutrition_sample").select("record_id", "brand_owner")
    return joins.left_first_match(df, recalls, ["brand_owner"], ["recall_number", "classification"], ["recall_number", "classification"], "is_recalled").select("record_id", "recall_number", "classification", "is_recalled")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def j_semi(spark, d):
    return joins.restrict(read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def j_anti(spark, d):
    return joins.exclude(read(spark, d, "part").select("p_partkey"), read(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("select s_suppkey, s_name, n_name, coalesce(r_name, 'none') as region from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j_left_dims(spark, d):
    s, n, r = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "s_name", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@query("with k as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) i from orders) select o_custkey, o_orderkey from k where i = 1")
def w_first_per_key(spark, d):
    return joins.first_per_key(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("with k as (select record_id, brand_owner, row_number() over (partition by brand_owner order by published_date desc nulls last, record_id) i from nutrition_sample) select record_id, brand_owner from k where brand_owner is null or i = 1")
def w_latest_per_key(spark, d):
    return joins.latest_per_key(read(spark, d, "nutrition_sample").select("record_id", "brand_owner", "published_date"), ["brand_owner"], "published_date", "record_id").select("record_id", "brand_owner")


@query("with k as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) select o_orderpriority, o_orderkey, cast(place as integer) as place from k where place <= 3")
def w_top_per_group(spark, d):
    from pyspark.sql import Window as W

    o = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return o.withColumn("place", F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("place <= 3").drop("o_totalprice")


@query("select l_returnflag as value, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 4) as share from lineitem group by 1")
def w_share_of_total(spark, d):
    return profiling.share_of_total(read(spark, d, "lineitem"), "l_returnflag")


@query("select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def u_union_by_name(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return joins.union_all(c, s)


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75, max({c}) as max from lineitem" for c in _DESCRIBED))
def profile_describe(spark, d):
    out = profiling.describe(read(spark, d, "lineitem"), _DESCRIBED)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("select coalesce(lang, '(null)') as value, count(*) as n from documents group by 1")
def profile_value_counts(spark, d):
    return profiling.value_counts(read(spark, d, "documents"), "lang")


@query("select case when v <= 20 then '(0, 20]' when v <= 40 then '(20, 40]' when v <= 60 then '(40, 60]' when v <= 80 then '(60, 80]' else '(80, 100]' end as bin, count(*) as n from (select dq_score_post v from api_runs) where v > 0 and v <= 100 group by 1")
def profile_histogram(spark, d):
    return profiling.histogram(read(spark, d, "api_runs"), "dq_score_post", [0, 20, 40, 60, 80, 100])


@query("select cast(round(dq_score_pre) as bigint) as value, count(*) as n from api_runs where dq_score_pre is not null group by 1")
def profile_rounded_counts(spark, d):
    return profiling.rounded_counts(read(spark, d, "api_runs"), "dq_score_pre")


@query()
def profile_structures(spark, d):
    """Structure, keys and rates of the raw JSON columns, one row per column."""
    rows = []
    for table, column in (("bronze_records", "record_json"), ("dedup_clusters", "members"), ("block_trace", "null_rates"), ("events", "props"), ("nutrition_sample", "product_name")):
        p = profiling.profile(read(spark, d, table).select(column))[column]
        rows.append((table, column, p["structure"], p["null_rate"], p["distinct"], ",".join(p.get("keys", {}))))
    return spark.createDataFrame(rows, "table_name string, column_name string, structure string, null_rate double, n_distinct long, keys string")


@query()
def x_pipeline_nutrition(spark, d):
    """The food domain's whole block sequence over the catalogue."""
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name", "brand_owner", "ingredients", "published_date", F.col("food_category").alias("category"))
    program = {"column_operations": [{"action": "set_default", "target": "data_source", "default_value": "catalogue"}]}
    return registry.run(df, registry.sequence_of("nutrition"), registry.Context("2024-06-30", programs={"catalogue": [program]}, source="catalogue"))
