"""Queries of the report aggregations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import observe, recommend, reports
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


_LOGS = "l as (select * from (select *, row_number() over (partition by run_id order by updated_at desc) i from api_runs) where i = 1)"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return observe.latest_logs(read(spark, d, "api_runs"))


@query("select recall_number, product_type, classification from fda_recalls_sample where not coalesce(upper(trim(classification)) = 'CLASS I', false)")
def r_suppress_recalled(spark, d):
    df = read(spark, d, "fda_recalls_sample").withColumn("is_recalled", F.lit(True))
    return reports.suppress_recalled(df, level="classification").select("recall_number", "product_type", "classification")


_COLUMNS = ["product_name", "brand_owner", "brand_name", "ingredients", "food_category", "serving_size_unit"]


@query(" union all ".join(f"select '{c}' as column_name, round(100 * avg(({c} is null)::int), 4) as null_percent, round(100.0 * count(*) filter (trim({c}) = '') / count(*), 4) as empty_percent, count(distinct {c}) as n_distinct from nutrition_sample" for c in _COLUMNS))
def r_empty_rates(spark, d):
    return reports.empty_rates(read(spark, d, "nutrition_sample"), _COLUMNS)


@query("select brand_owner, count(*) as n from nutrition_sample where brand_owner is not null group by 1 having count(*) >= 2 order by 2 desc, 1 limit 15")
def r_top_brands(spark, d):
    return reports.top_values(read(spark, d, "nutrition_sample"), "brand_owner", 15, 2)


@query("select source, cast(sum(m) as bigint) as rows_in from (select source, run_id, max(rows_in) m from block_trace group by 1, 2) group by 1")
def r_sum_of_max(spark, d):
    return reports.sum_of_max(read(spark, d, "block_trace"), ["source"], ["run_id"], "rows_in")


@query(f"with {_LOGS}, t as (select * from l where left(started_at, 10) = '2023-03-01'), c as (select * from t union all (select * from l where not exists (select 1 from t) order by started_at desc, run_id limit 20)) select count(*) as runs, round(avg((status = 'completed')::int), 6) as success_rate, round(avg(dq_delta), 4) as mean_delta, round(sum(rows_quarantined) / nullif(sum(rows_in), 0), 6) as quarantine_rate from c")
def r_key_figures(spark, d):
    return reports.key_figures(_logs(spark, d), "2023-03-01")


@query(f"with {_LOGS} select cast(sum(rows_in) as bigint) as rows_in, cast(sum(rows_out) as bigint) as rows_out, cast(sum(rows_quarantined) as bigint) as rows_quarantined, round(avg(dq_score_pre), 4) as mean_pre, round(avg(dq_score_post), 4) as mean_post from l")
def r_run_totals(spark, d):
    return reports.run_totals(_logs(spark, d))


@query(f"with {_LOGS}, b as (select source, run_id, row_number() over (partition by source order by dq_delta desc, run_id) i, row_number() over (partition by source order by dq_delta, run_id) j from l where dq_delta is not null) select source, max(case when i = 1 then run_id end) as best_run, max(case when j = 1 then run_id end) as worst_run from b group by 1")
def r_extreme_runs(spark, d):
    return reports.extreme_runs(_logs(spark, d))


@query("select source, count(*) filter (event_type = 'block_start') as block_start, count(*) filter (event_type = 'block_end') as block_end, count(*) filter (event_type in ('block_start', 'block_end')) as total, round(count(*) filter (event_type = 'block_start') / count(*) filter (event_type in ('block_start', 'block_end')), 6) as block_start_share, round(count(*) filter (event_type = 'block_end') / count(*) filter (event_type in ('block_start', 'block_end')), 6) as block_end_share from block_trace group by 1")
def r_coverage(spark, d):
    return reports.coverage_by(read(spark, d, "block_trace"), "source", "event_type", ["block_start", "block_end"])


@query("select event_type as prefix, count(*) as lookups, cast(sum((value > 10)::int) as bigint) as hits, round(avg((value > 10)::int), 6) as hit_rate from events group by 1")
def r_hit_rates(spark, d):
    return reports.hit_rates(read(spark, d, "events").select(F.col("event_type").alias("prefix"), (F.col("value") > 10).alias("hit")))


@query("select source, count(*) as clusters, cast(sum(coalesce(case when json_valid(merge_decisions) then try_cast(json_extract_string(merge_decisions, '$.size') as bigint) end, 1) - 1) as bigint) as merged_rows from dedup_clusters group by 1")
def r_cluster_totals(spark, d):
    return reports.cluster_totals(read(spark, d, "dedup_clusters"))


@query("select id, run_id from block_trace where event_type = 'block_end' and null_rates is not null")
def r_replayable(spark, d):
    return reports.replayable(read(spark, d, "block_trace"), "block_end").select("id", "run_id")


@query(
    """with r as (select run_id, to_json([{'entries': list({'block': block_name, 'rows_in': rows_in, 'rows_out': rows_out} order by id)}]) chunks from block_trace where event_type = 'block_end' group by 1)
    select t.run_id, cast(0 as integer) as chunk_no, cast(row_number() over (partition by t.run_id order by t.id) - 1 as integer) as entry_no, t.block_name as block, t.rows_in, t.rows_out, cast(nullif(t.dq_score, 0) as double) as dq from block_trace t where event_type = 'block_end'"""
)
def r_flatten_audit(spark, d):
    """The trace nested into one log per run and flattened again."""
    t = read(spark, d, "block_trace").filter("event_type = 'block_end'")
    entry = F.struct("id", F.col("block_name").alias("block"), "rows_in", "rows_out", "dq_score")
    logs = t.groupBy("run_id").agg(F.to_json(F.array(F.struct(F.array_sort(F.collect_list(entry)).alias("entries")))).alias("chunks"))
    return reports.flatten_audit(logs, "run_id", "chunks")


@query("select bronze_file, count(*) as rows, count(*) filter (json_valid(record_json)) as readable, cast(sum(length(record_json)) as bigint) as chars from bronze_records group by 1")
def r_record_files(spark, d):
    return reports.flatten_records(read(spark, d, "bronze_records"), "bronze_file", "record_json", {})[0]


@query("select bronze_file, line_no, substr(json_extract_string(record_json, '$.ingredients'), 1, 20) as ingredients from bronze_records where json_valid(record_json) and json_extract_string(record_json, '$.ingredients') is not null")
def r_record_fields(spark, d):
    df = read(spark, d, "bronze_records").withColumn("file_line", F.concat_ws("#", "bronze_file", "line_no"))
    _, records = reports.flatten_records(df, "file_line", "record_json", {"ingredients": 20})
    at = F.split("file_line", "#")
    return records.filter("ingredients is not null").select(F.get(at, F.lit(0)).alias("bronze_file"), F.get(at, F.lit(1)).cast("long").alias("line_no"), "ingredients")


@query("select bronze_file, line_no, coalesce(nullif(try_cast(json_extract_string(record_json, '$.serving_size') as double), 0), try_cast(json_extract_string(record_json, '$.unit_price') as double)) as quantity from bronze_records where json_valid(record_json)")
def r_nested_value(spark, d):
    df = read(spark, d, "bronze_records").filter(F.try_parse_json("record_json").isNotNull())
    return df.select("bronze_file", "line_no", reports.nested_value("record_json", ["$.serving_size", "$.unit_price"]).alias("quantity"))


@query("select (select count(*) from bronze_records) as first_rows, (select count(*) from nutrition_sample) as second_rows, (select count(*) from nutrition_sample) - (select count(*) from bronze_records) as difference")
def r_layer_difference(spark, d):
    return reports.layer_difference(read(spark, d, "bronze_records"), read(spark, d, "nutrition_sample"))


@query(
    """with r as (select p_partkey i, count(*) n from lineitem join part on l_partkey = p_partkey group by 1), v as (select i from r order by n desc, i limit 100), k as (select l_orderkey, l_partkey from lineitem where l_partkey in (select i from v)) select l_orderkey, l_partkey, count(*) as n from k group by 1, 2"""
)
def a_vocabulary_restricted(spark, d):
    l = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    v = recommend.vocabulary(l, "l_partkey", 100)
    return l.join(v, "l_partkey", "left_semi").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
