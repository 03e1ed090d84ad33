"""Schemas that drift between files: rescue-column ingestion and a report of every change.

`ingest` enforces a target schema on raw JSON records. A field outside the target, or whose value does not fit its type,
goes to the rescue column, so nothing is lost; `promote` turns an approved rescued field into a typed column and `replay`
fills a target column from the rescued values of other names. What the typed columns and the rescue column hold tells
the fields of every record (`fields_of`), from which `changes` reports what was added, removed, renamed or retyped
between the batches of a feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.session import cut

#: Fields of a record; rescued fields as JSON; the same as a map, with fields that are null; JSON types of values that were cast.
FIELDS, RESCUED, RESCUE, CAST = "_fields", "_rescued", "_rescue", "_cast"
_FIELD_TYPE = "array<struct<field_name:string,kind:string,value:string>>"


def _kind(sql: str) -> str:
    """SQL text: JSON type of a variant, null for a JSON null."""
    t = f"schema_of_variant({sql})"
    return (
        f"case when {t} = 'VOID' then null when {t} like 'ARRAY%' then 'array' when {t} like 'OBJECT%' then 'object' "
        f"when {t} = 'STRING' then 'string' when {t} = 'BOOLEAN' then 'boolean' else 'number' end"
    )


def _entries(source: str) -> Column:
    return F.expr(
        f"transform(map_entries({source}), e -> named_struct('field_name', e.key, 'kind', {_kind('e.value')}, "
        f"'value', case when schema_of_variant(e.value) = 'STRING' then try_variant_get(e.value, '$', 'string') "
        f"when schema_of_variant(e.value) = 'VOID' then null else to_json(e.value) end))"
    ).cast(_FIELD_TYPE)


def _json_type(sql_type: str) -> str:
    """JSON type that a SQL type holds."""
    return {"string": "string", "boolean": "boolean"}.get(sql_type, "number")


def enforce(df: DataFrame, values: Column, target: dict[str, str]) -> DataFrame:
    """`df` with the map `values` (name -> variant) put into typed columns, `_rescue` and `_cast`; see `ingest`."""
    out = df.withColumn("_map", values)
    out = out.withColumns({c: F.expr(f"try_variant_get(try_element_at(_map, '{c}'), '$', '{t}')") for c, t in target.items()})
    fitted = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in target])) if target else F.array().cast("array<string>")
    kinds = {c: F.expr(_kind(f"try_element_at(_map, '{c}')")) for c in target}
    other = [F.when(F.col(c).isNotNull() & (kinds[c] != _json_type(t)), F.struct(F.lit(c).alias("key"), kinds[c].alias("value"))) for c, t in target.items()]
    cast = F.map_from_entries(F.array_compact(F.array(*other))) if other else F.lit(None).cast("map<string,string>")
    return out.withColumns({RESCUE: F.map_filter("_map", lambda k, v: ~F.array_contains(fitted, k)) if target else F.col("_map"), CAST: cast}).drop("_map")


def ingest(df: DataFrame, json_col: str, target: dict[str, str]) -> DataFrame:
    """`df` with one typed column for each field of `target` (name -> SQL type), `_rescued` (JSON of what has no place there, null if
    nothing), `_rescue` (the same as a map, with the fields that are null) and `_cast` (JSON types of the values that were cast).

    A record that is null, cut or no object gives nulls, with its whole text under the key `_record` of `_rescued`. A text
    number is cast to a numeric target; a value that cannot be cast is rescued. Of a repeated key the first value counts.
    Columns of `df` named as a target column are replaced.
    """
    out = enforce(df, F.expr(f"from_json({json_col}, 'map<string,variant>')"), target)
    rest = F.map_filter(RESCUE, lambda k, v: ~F.is_variant_null(v))
    whole = F.when(F.col(json_col).isNotNull() & F.col(RESCUE).isNull(), F.to_json(F.create_map(F.lit("_record"), F.col(json_col))))
    return out.withColumn(RESCUED, F.coalesce(whole, F.when(F.size(rest) > 0, F.to_json(rest))))


def fields_of(target: dict[str, str]) -> Column:
    """`_fields` of an ingested record: name, JSON type (null for a JSON null) and text of every field, from its typed columns and its
    rescue column; null for an unreadable record."""
    typed = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field_name"), F.coalesce(F.try_element_at(CAST, F.lit(c)), F.lit(_json_type(t))).alias("kind"), F.col(c).cast("string").alias("value"))) for c, t in target.items()]
    held = F.array_compact(F.array(*typed)).cast(_FIELD_TYPE) if typed else F.array().cast(_FIELD_TYPE)
    return F.when(F.col(RESCUE).isNotNull(), F.concat(held, _entries(RESCUE)) if typed else _entries(RESCUE)).alias(FIELDS)


def replay(df: DataFrame, names: dict[str, list[str]], target: dict[str, str]) -> DataFrame:
    """Fill each column of `names` from the rescued fields listed for it, the first that fits in the list's order, and take
    that value out of `_rescued`. A value that cannot be cast stays rescued; a value the column has already wins, and the
    rescued one stays. Columns that `df` lacks are added. One pass over the rescue column for all names together."""
    got = df.withColumn("_m", F.expr(f"from_json({RESCUED}, 'map<string,variant>')"))
    new, used = {}, []
    for column, fields in names.items():
        old = F.col(column) if column in df.columns else F.lit(None).cast(target[column])
        values = [F.expr(f"try_variant_get(try_element_at(_m, '{f}'), '$', '{target[column]}')") for f in fields]
        new[column] = F.coalesce(old, *values).cast(target[column])
        first = F.coalesce(*[F.when(v.isNotNull(), F.lit(f)) for f, v in zip(fields, values)])
        used.append(F.when(old.isNull(), first))
    got = got.withColumn("_used", F.array_compact(F.array(*used)))
    left = F.map_filter("_m", lambda k, v: ~F.array_contains("_used", k))
    rest = F.when(F.size("_used") == 0, F.col(RESCUED)).when(F.size(left) > 0, F.to_json(left))
    return got.withColumns(new | {RESCUED: rest}).drop("_m", "_used")


def promote(df: DataFrame, field: str, sql_type: str, into: str | None = None) -> DataFrame:
    """Give one approved rescued `field` a typed column (`into`, default its name); `replay` for a single name."""
    return replay(df, {into or field: [field]}, {into or field: sql_type})


def text_values(column: str) -> Column:
    """A text column as a map for `enforce`: its own name with what the text reads as, JSON or else a text; empty for null."""
    v = f"try_parse_json(trim({column}))"
    value = f"case when {v} is null or is_variant_null({v}) then cast(trim({column}) as variant) else {v} end"
    return F.expr(f"case when {column} is null then cast(map() as map<string,variant>) else map('{column}', {value}) end")


def _parts(name: Column) -> Column:
    """Starts (up to four characters) of the words of a field name, camel or snake case."""
    snake = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.array_distinct(F.transform(F.filter(F.split(snake, r"[^a-z0-9]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 4)))


def changes(records: DataFrame, like: float = 0.45, starts: DataFrame | None = None) -> DataFrame:
    """One row per change (`table_name`, `feed`, `batch_name`, `change_kind`, `field_name`, `new_name`), at the first batch
    that shows it against the batch before.

    `records` has table_name, feed, batch_name, batch_order (any orderable; ties by name) and `_fields`; `starts` (table_name, feed,
    batch_name, started) has the orders of batches that are not told by their records. A batch without any
    readable field in any record still counts as a batch if its `_fields` are empty arrays, not if they are null. A removed
    and an added field of one batch are one rename if names and values are alike enough (each field at most once, the
    likest first): half the share of common word starts of the names, half the common share of their value words, for
    numbers the closeness of their mean; texts of like names need a like length only. A type is that of most non-null values (ties: first in the alphabet); a batch in
    which a field has only nulls keeps the type of the batch before. Empty input gives no rows.
    """
    key = ["table_name", "feed"]
    # The records are parsed once; fields and, for a few of them, values are read from the table.
    base = cut(records.select(*key, "batch_name", "batch_order", FIELDS)).filter(F.col(FIELDS).isNotNull())
    f = base.select(*key, "batch_name", "batch_order", F.explode_outer(FIELDS).alias("f")).select(*key, "batch_name", "batch_order", "f.*")
    number = F.when(F.col("kind") == "number", F.col("value").try_cast("double"))
    per = f.groupBy(*key, "batch_name", "field_name").agg(
        F.min("batch_order").alias("batch_order"),
        *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("array", "boolean", "number", "object", "string")],
        F.avg(number).alias("mean"),
        F.avg(F.length("value")).alias("mean_length"),
        F.avg(F.when(number > 0, F.log10(number))).alias("log_mean"),
    )
    per = cut(per)  # one row per field and batch; read several times below
    batches = per.groupBy(*key, "batch_name").agg(F.min("batch_order").alias("batch_order"))
    if starts is not None:
        batches = batches.join(starts, [*key, "batch_name"], "left").withColumn("batch_order", F.coalesce("started", "batch_order")).drop("started")
    order = W.partitionBy(*key).orderBy("batch_order", "batch_name")
    batches = batches.select(*key, "batch_name", F.row_number().over(order).alias("at"), F.lead("batch_name").over(order).alias("next_batch"), F.lag("batch_name").over(order).alias("before_batch"))
    most = F.greatest(*[F.col(f"n_{k}") for k in ("array", "boolean", "number", "object", "string")])
    kind = F.coalesce(*[F.when((F.col(f"n_{k}") == most) & (most > 0), F.lit(k)) for k in ("array", "boolean", "number", "object", "string")])
    field = W.partitionBy(*key, "field_name").orderBy("at")
    seen = per.filter(F.col("field_name").isNotNull()).drop("batch_order").withColumn("kind", kind).join(batches, [*key, "batch_name"])
    seen = seen.withColumn("known", F.last("kind", True).over(field)).withColumns({"before_at": F.lag("at").over(field), "after_at": F.lead("at").over(field), "before_known": F.lag("known").over(field)})
    added = seen.filter((F.col("at") > 1) & (F.coalesce("before_at", F.lit(0)) != F.col("at") - 1)).select(*key, "batch_name", "at", "field_name", F.col("kind").alias("k"), "mean", "log_mean", "mean_length", F.col("batch_name").alias("value_batch"))
    removed = seen.filter(F.col("next_batch").isNotNull() & (F.coalesce("after_at", F.lit(0)) != F.col("at") + 1)).select(*key, F.col("next_batch").alias("batch_name"), (F.col("at") + 1).alias("at"), "field_name", F.col("known").alias("k"), "mean", "log_mean", "mean_length", F.col("batch_name").alias("value_batch"))
    retyped = seen.filter((F.col("before_at") == F.col("at") - 1) & (F.col("kind") != F.col("before_known")))

    a, r = added.alias("a"), removed.alias("r")
    pairs = r.join(a, [*key, "batch_name", "at"]).select(
        *key, "batch_name", F.col("r.field_name").alias("old"), F.col("a.field_name").alias("new"), F.col("r.k").alias("old_k"), F.col("a.k").alias("new_k"),
        F.col("r.mean").alias("old_mean"), F.col("a.mean").alias("new_mean"), F.col("r.log_mean").alias("old_log"), F.col("a.log_mean").alias("new_log"), F.col("r.value_batch").alias("old_batch"),
        (F.least("r.mean_length", "a.mean_length") / F.nullif(F.greatest("r.mean_length", "a.mean_length"), F.lit(0.0))).alias("by_length"),
    )
    pairs = cut(pairs)
    # Value words only of the fields of such pairs: digits as 9, as shares of all words of the field in the batch.
    wanted = pairs.select(*key, F.col("old_batch").alias("batch_name"), F.col("old").alias("field_name")).union(pairs.select(*key, "batch_name", F.col("new").alias("field_name"))).distinct()
    words = (
        f.filter(F.col("kind").isin("string", "array", "object")).join(wanted, [*key, "batch_name", "field_name"])
        .select(*key, "batch_name", "field_name", F.explode(F.split(F.regexp_replace(F.lower("value"), r"[0-9]", "9"), r"[\s,;\"\[\]{}>]+")).alias("word"))
        .filter("word <> ''").groupBy(*key, "batch_name", "field_name", "word").count()
    )
    words = words.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy(*key, "batch_name", "field_name")))
    o = words.select(*key, F.col("batch_name").alias("old_batch"), F.col("field_name").alias("old"), "word", F.col("share").alias("old_share"))
    n = words.select(*key, "batch_name", F.col("field_name").alias("new"), "word", F.col("share").alias("new_share"))
    common = pairs.select(*key, "batch_name", "old_batch", "old", "new").join(o, [*key, "old_batch", "old"]).join(n, [*key, "batch_name", "new", "word"])
    common = common.groupBy(*key, "batch_name", "old", "new").agg(F.sum(F.least("old_share", "new_share")).alias("common"))
    x, y = _parts(F.col("old")), _parts(F.col("new"))
    by_name = F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))
    rate = (F.col("old_mean").between(0, 1)) & F.col("new_mean").between(0, 1)
    gap = F.abs(F.col("old_mean") - F.col("new_mean")) / (0.03 + 0.2 * F.greatest("old_mean", "new_mean"))
    near = F.when(rate, F.greatest(F.lit(0.0), 1 - gap)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("old_log") - F.col("new_log"))))
    by_value = F.when((F.col("old_k") == "number") & (F.col("new_k") == "number"), F.coalesce(near, F.lit(0.0))).otherwise(F.coalesce("common", F.lit(0.0)))
    # Rates identify a field by their level; other numbers, and fields that change type as well, need a like name.
    free = (F.col("old_k") == F.col("new_k")) & (rate | (F.col("old_k") != "number"))
    scored = pairs.join(common, [*key, "batch_name", "old", "new"], "left").withColumns({"by_name": by_name, "by_value": by_value})
    scored = scored.withColumn("score", (F.col("by_name") + F.col("by_value")) / 2)
    scored = scored.filter((F.col("score") >= like) | ((F.col("by_name") >= 0.5) & ((F.col("by_value") >= 0.1) | ((F.col("old_k") == "string") & (F.col("new_k") == "string") & (F.coalesce("by_length", F.lit(0.0)) >= 0.5)))) | (free & (F.col("by_value") >= 0.25)))
    best = W.partitionBy(*key, "batch_name", "old").orderBy(F.desc("score"), "new")
    back = W.partitionBy(*key, "batch_name", "new").orderBy(F.desc("score"), "old")
    renamed = scored.withColumns({"i": F.row_number().over(best), "j": F.row_number().over(back)}).filter("i = 1 and j = 1").select(*key, "batch_name", "old", "new", "old_k", "new_k")

    def rows(df: DataFrame, kind: str, name: str = "field_name", new: str | None = None) -> DataFrame:
        return df.select(*key, "batch_name", F.lit(kind).alias("change_kind"), F.col(name).alias("field_name"), (F.col(new) if new else F.lit("")).alias("new_name"))

    gone = renamed.select(*key, "batch_name", F.col("old").alias("field_name"))
    come = renamed.select(*key, "batch_name", F.col("new").alias("field_name"))
    return (
        rows(added.join(come, [*key, "batch_name", "field_name"], "left_anti"), "added")
        .union(rows(removed.join(gone, [*key, "batch_name", "field_name"], "left_anti"), "removed"))
        .union(rows(renamed, "renamed", "old", "new"))
        .union(rows(retyped, "retyped"))
    )


#: Target schema of the raw product feeds, and the names under which other feeds deliver the same fields.
BRONZE_TARGET = {
    "product_name": "string", "brand_name": "string", "brand_owner": "string", "ingredients": "string", "food_category": "string",
    "serving_size": "double", "serving_size_unit": "string", "published_date": "string", "gtin_upc": "string", "unit_price": "double", "currency": "string",
}
BRONZE_NAMES = {
    "product_name": ["description", "product_title", "title"],
    "brand_name": ["brands", "product_brand", "brand", "brandName", "brand_list"],
    "brand_owner": ["brandOwner", "owner"],
    "ingredients": ["ingredients_text", "ingr_txt", "ingredientList"],
    "food_category": ["foodCategory", "food_cat", "category", "productGroup", "pnns_groups_1"],
    "serving_size": ["servingSize", "serving_qty"],
    "published_date": ["publishedDate", "publication_date"],
    "gtin_upc": ["upc_code", "gtin", "code"],
    "unit_price": ["unitPrice", "price"],
}


#: Rescued fields whose meaning was approved: they fill the target column from the start.
APPROVED = [(f, c) for c, fields in BRONZE_NAMES.items() for f in fields]
CATEGORY_TARGET = {"food_category": "string"}


def bronze_records(df: DataFrame) -> DataFrame:
    """Raw records, ingested: a file is a batch, files of a feed by date."""
    keyed = df.select(F.lit("bronze_records").alias("table_name"), "feed", F.col("bronze_file").alias("batch_name"), F.col("file_date").cast("timestamp").alias("batch_order"), F.col("line_no").cast("string").alias("row_key"), "record_json")
    return ingest(keyed, "record_json", BRONZE_TARGET).drop("record_json")


def trace_records(df: DataFrame) -> DataFrame:
    """Null rates, ingested: a run is a batch of its source. All rates are rescued, as the target of this table names no column."""
    keyed = df.select(F.lit("block_trace").alias("table_name"), F.col("source").alias("feed"), F.col("run_id").alias("batch_name"), F.lit(None).cast("timestamp").alias("batch_order"), F.col("id").cast("string").alias("row_key"), "null_rates")
    return ingest(keyed, "null_rates", {}).drop("null_rates")


def trace_starts(df: DataFrame) -> DataFrame:
    """Earliest event of each run, readable or not: one row a run."""
    start = df.groupBy("source", "run_id").agg(F.min("ts").cast("timestamp").alias("started"))
    return start.select(F.lit("block_trace").alias("table_name"), F.col("source").alias("feed"), F.col("run_id").alias("batch_name"), "started")


def category_records(df: DataFrame) -> DataFrame:
    """food_category of the catalogue, enforced as a text: a file is a batch, files of a feed by name. Lists, objects and numbers
    are rescued."""
    file = F.col("gcs_source_file")
    keyed = df.select(F.lit("nutrition_sample").alias("table_name"), F.regexp_extract(file, r"^(.*)/[^/]*$", 1).alias("feed"), file.alias("batch_name"), F.lit(None).cast("timestamp").alias("batch_order"), F.col("record_id").cast("string").alias("row_key"), "food_category")
    out = enforce(keyed.withColumn("_text", F.col("food_category")), text_values("_text"), {})
    # The map's only key is the text itself; a plain text fits the column, all else is rescued.
    plain = F.expr(f"{_kind('try_element_at(_rescue, \'_text\')')} = 'string'")
    typed = F.when(plain, F.expr("try_variant_get(try_element_at(_rescue, '_text'), '$', 'string')"))
    rescue = F.when(plain, F.expr("cast(map() as map<string,variant>)")).otherwise(F.transform_keys(RESCUE, lambda k, v: F.lit("food_category")))
    return out.withColumns({"food_category": typed, RESCUE: rescue}).withColumn(RESCUED, F.when(F.size(RESCUE) > 0, F.to_json(RESCUE))).drop("_text")


def batches_of(ingested: DataFrame, target: dict[str, str]) -> DataFrame:
    """The ingested records as `changes` reads them."""
    return ingested.select("table_name", "feed", "batch_name", "batch_order", fields_of(target))


def drift_report(bronze: DataFrame, trace: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All changes of the three drifting tables."""
    parts = [batches_of(bronze_records(bronze), BRONZE_TARGET), batches_of(trace_records(trace), {}), batches_of(category_records(catalogue), CATEGORY_TARGET)]
    return changes(parts[0].unionByName(parts[1]).unionByName(parts[2]), starts=trace_starts(trace)).distinct()


def consistent_table(bronze: DataFrame, trace: DataFrame, catalogue: DataFrame, approved: list[tuple[str, str]] | None = None) -> DataFrame:
    """The three tables as one: table_name, feed, batch_name, row_key, the columns of BRONZE_TARGET, `rates` (column name to rate) and
    `_rescued`. Approved fields are promoted in turn, (field, column) each; then the names that `changes` reports as new or old
    names of a column are replayed into it. Of the rates numbers are typed, others stay rescued; of the categories that are
    lists or objects the text of the rescued value stays in `_rescued`."""
    raw = bronze_records(bronze)
    found = changes(batches_of(raw, BRONZE_TARGET)).filter("change_kind = 'renamed'").select("field_name", "new_name").distinct()
    pairs = [tuple(r) for r in found.collect()]  # as many as there are names of fields
    approved = APPROVED if approved is None else approved
    names: dict[str, list[str]] = {c: [c] for c in BRONZE_TARGET}
    for field, column in approved:
        names[column].append(field)
    for _ in range(len(pairs) + 1):  # a chain of renames reaches its column at last
        for column, known in names.items():
            known += [n for a, b in sorted(pairs) for x, n in ((a, b), (b, a)) if x in known and n not in known and not any(n in k for k in names.values())]
    records = replay(raw, names, BRONZE_TARGET)
    keys = ["table_name", "feed", "batch_name", "row_key"]
    no_rates = F.lit(None).cast("map<string,double>")
    first = records.select(*keys, *BRONZE_TARGET, no_rates.alias("rates"), RESCUED)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in BRONZE_TARGET.items() if c != "food_category"]
    numbers = F.map_filter(F.transform_values(RESCUE, lambda k, v: F.try_variant_get(v, "$", "double")), lambda k, v: v.isNotNull())
    rated = trace_records(trace).withColumn("rates", numbers)
    other = F.map_filter(RESCUE, lambda k, v: ~F.coalesce(F.map_contains_key("rates", k), F.lit(False)) & ~F.is_variant_null(v))
    unread = F.coalesce(F.when(F.col(RESCUE).isNull(), F.col(RESCUED)), F.when(F.size(other) > 0, F.to_json(other)))
    second = rated.select(*keys, *nothing, F.lit(None).cast("string").alias("food_category"), "rates", unread.alias(RESCUED))
    third = category_records(catalogue).select(*keys, *nothing, "food_category", no_rates.alias("rates"), RESCUED)
    return first.unionByName(second).unionByName(third)
