"""Queries of sources and sinks, search, service reports and the enrichment tiers, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import cascade, enrich, joins, observe, quality, reports, search
from larder.session import read, scratch
from larder.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_NA = ", ".join(f"'{t}'" for t in (
    "na Na NA n/a N/A n.a. N.A. none None NONE null Null NULL nan NaN NAN - -- unknown Unknown UNKNOWN".split() + ["not available", "not applicable", ""]))


@query(f"select cast(record_id as varchar) as record_id, case when trim(brand_name) in ({_NA}) then null else brand_name end as brand_name, data_source from nutrition_sample where regexp_matches(coalesce(brand_name, 'x'), '^[^\\r\\n]*$')")
def io_csv(spark, d):
    """The catalogue's brands written as delimited text and read back; words for a missing value come back as nulls."""
    df = read(spark, d, "nutrition_sample").select("record_id", "brand_name", "data_source").filter(F.coalesce("brand_name", F.lit("x")).rlike(r"^[^\r\n]*$"))
    path = scratch(spark, "csv")
    df.write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_csv(spark, path, delimiter=",")


@query("select doc_id, lang, source from documents")
def io_jsonl(spark, d):
    """Documents written as JSON lines and read back with their lineage."""
    path = scratch(spark, "jsonl")
    read(spark, d, "documents").select("doc_id", "lang", "source").write.option("ignoreNullFields", "false").json(path)
    return readers.read_jsonl(spark, path, "part*.json", "doc_id long, lang string, source string", "r1", "docs").filter("_pipeline_run_id = 'r1' and _source = 'docs'").select("doc_id", "lang", "source")


@query("select record_id, product_name, published_date from nutrition_sample where product_name is not null")
def io_silver(spark, d):
    """The catalogue written as a Silver partition and read back; the date asked for has none, so the latest is taken."""
    root = scratch(spark, "silver")
    writers.write_silver(read(spark, d, "nutrition_sample").select("record_id", "product_name", "published_date"), root, "off", "2024/01/02")
    return readers.read_silver(spark, root, "off", "2024/02/02").filter("product_name is not null")


@query("select record_id, 'off' as source_name, 'off' as data_source, product_name from nutrition_sample")
def io_gold(spark, d):
    """Gold form of the catalogue, appended and read back by source."""
    path = scratch(spark, "gold")
    writers.write_gold(writers.gold_frame(read(spark, d, "nutrition_sample").select("record_id", "product_name"), "off"), path)
    writers.write_gold(writers.gold_frame(read(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("product_name")), "part"), path)
    return readers.read_gold(spark, path, ["off"]).select("record_id", "source_name", "data_source", "product_name")


@query("select distinct run_id from api_runs where run_id is not null")
def io_run_logs(spark, d):
    """Run logs appended as JSON and read back, the last of each run."""
    path = scratch(spark, "logs")
    writers.write_run_log(read(spark, d, "api_runs").filter("run_id is not null").select("run_id", "source", F.col("updated_at").alias("timestamp")), path)
    return readers.read_run_logs(spark, path).select("run_id")


@query(
    """with m as (select 'LT' as k) select part.p_partkey, part.p_name, supplier.s_name from part join supplier on part.p_partkey = supplier.s_suppkey where part.p_size > 10"""
)
def j_inner_filtered(spark, d):
    """Rows of one kind joined to their details by a common id."""
    a = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return joins.inner_details(a, b, "id", F.col("p_size") > 10).select(F.col("id").alias("p_partkey"), "p_name", "s_name")


@query(
    """with d as (select *, row_number() over (partition by brand_name order by published_date desc nulls last, record_id) i from nutrition_sample),
    k as (select record_id, product_name, brand_owner, ingredients, food_category from d where brand_name is null or trim(brand_name) = '' or i = 1),
    c as (select record_id, case lower(trim(food_category)) when 'confections' then 'Snacks' when 'plant drinks' then 'Beverages' when 'soft drinks' then 'Beverages' end category,
      concat_ws(' ', nullif(trim(product_name), ''), nullif(trim(brand_owner), ''), nullif(trim(ingredients), '')) as text from k where trim(food_category) <> '')
    select record_id, category, text from c where category is not null and length(text) >= 40"""
)
def e_corpus_rows(spark, d):
    """Corpus texts: the latest row of each key, rows without a key all, with a known category and enough text."""
    table = {"confections": "Snacks", "plant drinks": "Beverages", "soft drinks": "Beverages"}
    return enrich.corpus_texts(read(spark, d, "nutrition_sample"), "brand_name", "published_date", "record_id", "food_category", table, ["product_name", "brand_owner", "ingredients"], 40)


@query()
def e_cascade(spark, d):
    """The catalogue through all tiers, without a classifier: category and tier of every listing."""
    df = read(spark, d, "nutrition_sample").select("record_id", "product_name", "brand_name", "ingredients", F.col("food_category").alias("category"))
    return cascade.enrich(df, "record_id", "2024-06-30").rows.select("record_id", "primary_category", "tier", "enriched_by_llm")


@query(
    """with t as (select record_id, product_name, length(ingredients) n, record_id % 5 = 0 as is_recalled, case when record_id % 2 = 0 then 'Class I' else 'Class II' end as recall_class from nutrition_sample where ingredients is not null),
    k as (select * from t order by n desc, record_id limit 50) select record_id from k where not (is_recalled and upper(trim(recall_class)) = 'CLASS I')"""
)
def s_suppressed_after_rank(spark, d):
    """A ranked list cut at 50 (a top-k report) from which recalled products are taken out afterwards, so fewer may be left."""
    df = read(spark, d, "nutrition_sample").filter("ingredients is not null")
    df = df.select("record_id", F.length("ingredients").alias("n"), (F.col("record_id") % 5 == 0).alias("is_recalled"), F.when(F.col("record_id") % 2 == 0, "Class I").otherwise("Class II").alias("recall_class"))
    return search.suppress_ranked(df, [F.desc("n"), F.col("record_id")], 50).select("record_id")


@query(
    """with f as (select *, row_number() over (partition by product_name, brand_name order by record_id) i from nutrition_sample where product_name is not null)
    select record_id, lower(concat_ws(' ', nullif(product_name, ''), nullif(brand_name, ''), nullif(ingredients, ''))) as text from f where i = 1"""
)
def s_index_rows(spark, d):
    """Rows of the search index with their text."""
    df = search.clean_index(read(spark, d, "nutrition_sample"), "product_name", "brand_name", "record_id")
    return df.select("record_id", search.searchable_text(df, ["product_name", "brand_name", "ingredients"]).alias("text"))


@query("select record_id from nutrition_sample where data_source like 'usda%' and food_category = 'Confections'")
def s_filtered(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", "data_source", F.col("food_category").alias("category"))
    return search.filter_results(df, "usda", "Confections").select("record_id")


@query("select title from (select title, min(doc_id) o from documents where title is not null group by title) order by o limit 25")
def s_query_sample(spark, d):
    return search.sample_queries(read(spark, d, "documents"), "title", "doc_id", 25)


@query(
    """with t as (select lower(brand_name) q, lower(title) t, doc_type l, row_number() over (partition by lower(brand_name), lower(title) order by doc_id) i from documents where brand_name is not null and title is not null)
    select d.doc_id, case t.l when 'review' then 3 when 'listing' then 2 when 'forum' then 1 else 0 end as gain from documents d left join t on lower(d.brand_name) = t.q and lower(d.title) = t.t and t.i = 1"""
)
def s_judged(spark, d):
    """Gains of results by a table of labels, the first label of each query and title."""
    docs = read(spark, d, "documents").select("doc_id", F.col("brand_name").alias("query"), "title", "doc_type")
    label = F.create_map(*[F.lit(x) for p in (("review", "E"), ("listing", "S"), ("forum", "C")) for x in p])
    truth = docs.filter("query is not null and title is not null").select("query", "title", F.try_element_at(label, F.col("doc_type")).alias("label"), F.col("doc_id").alias("row_id"))
    return search.judged(docs.select("doc_id", "query", "title"), truth).select("doc_id", "gain")


@query(
    """with i as (select brand_owner, first(food_category order by record_id) c from nutrition_sample where brand_owner is not null group by 1), n as (select lower(brand_name) b, first(food_category order by record_id) c from nutrition_sample where brand_name is not null group by 1)
    select s.record_id, coalesce(i.c, n.c) as food_category from nutrition_sample s left join i using (brand_owner) left join n on lower(s.brand_name) = n.b"""
)
def j_lookup_either(spark, d):
    """A category by firm, else by brand."""
    df = read(spark, d, "nutrition_sample")
    return joins.lookup_by_either(df.select("record_id", "brand_owner", "brand_name"), df.select("record_id", "brand_owner", "brand_name", "food_category"), "brand_owner", "brand_name", ["food_category"], "record_id").select("record_id", "food_category")


@query(
    """with c as (select user_id, arg_max(value, ts) as cached from events where value is not null and ts > timestamp '2024-01-15' group by 1)
    select e.event_id, c.cached, c.cached is not null as cache_hit from events e left join c using (user_id)"""
)
def j_cached(spark, d):
    """Values by key from a cache whose entries expire at their time."""
    events = read(spark, d, "events")
    cache = events.filter("value is not null").select("user_id", F.col("value").alias("cached"), F.col("ts").alias("expires_at"))
    return enrich.cached_lookup(events.select("event_id", "user_id"), cache, "user_id", "2024-01-15", "cached").select("event_id", "cached", "cache_hit")


@query("select run_id, source, status, started_at, rows_in, rows_out from (select *, row_number() over (partition by run_id order by updated_at desc nulls last, started_at desc nulls last) i from api_runs where run_id is not null) where i = 1")
def o_list_runs(spark, d):
    """The last export of every run."""
    return observe.list_runs(read(spark, d, "api_runs")).select("run_id", "source", "status", "started_at", "rows_in", "rows_out")


@query("select source, sum(rows_in) as rows_in, count(*) as runs, round(sum(rows_quarantined) * 0.0004, 6) as cost_usd from api_runs where source is not null group by 1")
def o_cost_report(spark, d):
    """Rows, runs and cost of classified rows per source (quarantined rows stand for them here)."""
    return observe.cost_report(read(spark, d, "api_runs"), "rows_quarantined").select("source", "rows_in", "runs", "cost_usd")


@query(
    """select run_id, source, min(ts) as first_ts, count(*) as events, count(distinct block_name) as blocks, max(dq_score) as best_score from block_trace group by 1, 2"""
)
def o_trace_by_run(spark, d):
    return observe.trace_by_run(read(spark, d, "block_trace")).select("run_id", "source", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "events", "blocks", "best_score")


@query("select run_id, cluster_id, case when json_valid(members) then json_array_length(members) end as n_members from dedup_clusters where canonical is not null")
def o_cluster_rows(spark, d):
    """Clusters with the number of their members; an unreadable list has none."""
    return observe.cluster_rows(read(spark, d, "dedup_clusters").filter("canonical is not null")).select("run_id", "cluster_id", "n_members")


@query("select record_id, md5(coalesce(product_name, '') || chr(31) || coalesce(brand_name, '')) as row_hash, 'Null in required field(s): ' || concat_ws(', ', case when product_name is null then 'product_name' end, case when brand_name is null then 'brand_name' end) as reason from nutrition_sample where product_name is null or brand_name is null")
def o_quarantine_rows(spark, d):
    """Quarantined rows with a hash of what they say."""
    return observe.quarantine_rows(read(spark, d, "nutrition_sample"), "record_id", ["product_name", "brand_name"])


@query(
    """with r as (select source, avg(dq_score_pre) a, avg(dq_score_post) b, sum(rows_in) i, sum(rows_out) o, count(*) n from api_runs where rows_out is not null group by 1)
    select source, n as runs, i as rows_in, o as rows_out, round(a, 4) as dq_score_pre, round(b, 4) as dq_score_post, round(b - a, 4) as dq_delta from r"""
)
def o_gold_log(spark, d):
    """Figures of finished runs per source, as a Gold run log holds them."""
    return observe.gold_log(read(spark, d, "api_runs").filter("rows_out is not null")).select("source", "runs", "rows_in", "rows_out", "dq_score_pre", "dq_score_post", "dq_delta")


@query("select n_name as product_name, null::varchar as ingredients, n_regionkey as category, cast(null as double) as dq_score_post from nation")
def q_silver_normal(spark, d):
    """Exactly the schema's columns, absent ones as nulls."""
    df = read(spark, d, "nation").select(F.col("n_name").alias("product_name"), F.col("n_regionkey").alias("category"), F.lit(1).alias("odd"))
    schema = quality.Schema((quality.Field("product_name", required=True), quality.Field("ingredients"), quality.Field("category", "integer"), quality.Field("dq_score_post", "float", computed=True)))
    return quality.silver_normal(df, schema, "2024-06-30").select("product_name", "ingredients", F.col("category").cast("int").alias("category"), "dq_score_post")


@query("select flag, count(*) as n from (select record_id, record_id % 5 = 0 and upper(trim(case when record_id % 2 = 0 then 'Class I' else 'Class II' end)) = 'CLASS I' as flag from nutrition_sample) group by 1")
def r_recall_flags(spark, d):
    df = read(spark, d, "nutrition_sample").select("record_id", (F.col("record_id") % 5 == 0).alias("is_recalled"), F.when(F.col("record_id") % 2 == 0, "Class I").otherwise("Class II").alias("recall_class"))
    kept = reports.suppress_recalled(df).withColumn("flag", F.lit(False))
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).union(df.join(kept, "record_id", "left_anti").groupBy(F.lit(True)).agg(F.count(F.lit(1))))
