"""Schema enforcement, completeness, quality scores, quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import text as tx
from larder.operators.mapping import spark_type, to_type

# Columns that scores leave out, weights, horizon in days and the freshness of an unknown date.
BOOKKEEPING = ("dq_score_pre", "dq_score_post", "dq_delta", "duplicate_group_id", "canonical", "enriched_by_llm", "sizes")
WEIGHTS = (0.4, 0.35, 0.25)
HORIZON_DAYS, NEUTRAL = 730, 0.5


@dataclass(frozen=True)
class Field:
    """A column of a target schema."""

    name: str
    type: str = "string"
    required: bool = False
    enrichment: bool = False
    computed: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Schema:
    """A target schema with the weights of its score."""

    fields: tuple[Field, ...]
    weights: tuple[float, float, float] = WEIGHTS
    version: str = "1"

    def __post_init__(self) -> None:
        if abs(sum(self.weights) - 1) > 1e-6:
            raise ValueError("weights must add up to 1")

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required and not f.computed]

    @property
    def mappable(self) -> list[str]:
        return [f.name for f in self.fields if not f.computed and not f.enrichment]

    @property
    def enrichment(self) -> list[str]:
        return [f.name for f in self.fields if f.enrichment]

    def struct(self) -> T.StructType:
        kinds = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(f.name, kinds[spark_type(f.type)], True, {"required": f.required, "enrichment": f.enrichment, "computed": f.computed}) for f in self.fields])


def enforce(df: DataFrame, schema: Schema, leave_out: Sequence[str] = ("dq_score_post", "dq_delta")) -> DataFrame:
    """Exactly the schema's columns in its order and types: absent ones as nulls, further ones dropped, misfits null."""
    kinds = dict(df.dtypes)
    return df.select(*[(to_type(F.col(f.name), f.type, kinds[f.name]) if f.name in kinds else F.lit(None).cast(spark_type(f.type))).alias(f.name) for f in schema.fields if f.name not in leave_out])


def fill_aliases(df: DataFrame, schema: Schema) -> DataFrame:
    """Null values of a column with an alias taken from that column."""
    return df.withColumns({f.name: F.coalesce(f.name, f.alias) for f in schema.fields if f.alias and f.alias in df.columns and f.name in df.columns})


def score_columns(df: DataFrame) -> list[str]:
    """Columns that completeness counts."""
    return [c for c in df.columns if c not in BOOKKEEPING]


def completeness(columns: Sequence[str]) -> Column:
    """Share of the columns that are not null; 0 for no columns."""
    if not columns:
        return F.lit(0.0)
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def freshness(date: Column | None, as_of: Column) -> Column:
    """1 for today or later, falling to 0 at the horizon; an unknown date is neutral."""
    if date is None:
        return F.lit(NEUTRAL)
    age = F.greatest(F.datediff(as_of, date), F.lit(0))
    return F.coalesce(F.greatest(1 - age / F.lit(float(HORIZON_DAYS)), F.lit(0.0)), F.lit(NEUTRAL))


def quality_score(df: DataFrame, into: str, as_of: str, columns: Sequence[str] | None = None, date_col: str | None = "published_date", text_col: str | None = "ingredients", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """`into` = 100 * (completeness, freshness, richness) * weights, rounded half to even to two digits. Richness is the length
    of `text_col` by the greatest in the table (one number, joined back); absent columns count 0 and neutral."""
    columns = score_columns(df) if columns is None else columns
    date = F.col(date_col).try_cast("date") if date_col and date_col in df.columns else None
    if text_col and text_col in df.columns:
        longest = df.agg(F.max(F.length(text_col)).alias("_longest"))
        df = df.crossJoin(F.broadcast(longest))  # one row
        rich = F.coalesce(F.length(text_col) / F.nullif(F.col("_longest"), F.lit(0)), F.lit(0.0))
    else:
        rich = F.lit(0.0)
    w = [F.lit(float(x)) for x in weights]
    score = 100 * (w[0] * completeness([c for c in columns if c in df.columns]) + w[1] * freshness(date, F.lit(as_of).cast("date")) + w[2] * rich)
    return df.withColumn(into, F.bround(score, 2)).drop("_longest")


def score_delta(df: DataFrame) -> DataFrame:
    return df.withColumn("dq_delta", F.bround(F.col("dq_score_post") - F.col("dq_score_pre"), 2))


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_rate), one scan for all columns; an empty table gives null rates that are null."""
    columns = columns or df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in columns])).alias("p")).select("p.*")


def split_quarantine(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): rows with all required fields, and the others with `missing_fields`, `reason` and `row_hash`."""
    there = [c for c in required if c in df.columns]
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(there)])) if there else F.array().cast("array<string>")
    marked = df.withColumn("_missing", names)
    clean = marked.filter(F.size("_missing") == 0).drop("_missing")
    bad = marked.filter(F.size("_missing") > 0).withColumn("missing_fields", F.array_join("_missing", ", ")).drop("_missing")
    bad = bad.withColumns({"reason": F.concat(F.lit("Null in required field(s): "), "missing_fields"), "row_hash": F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 16)})
    return clean, bad


def validation_profile(schema: Schema, mapped: Sequence[str], derived: Sequence[str] = ()) -> dict[str, dict]:
    """Status of every non-computed column (mapped, derived, enriched, absent) and whether it is required."""
    out = {}
    for f in schema.fields:
        if f.computed:
            continue
        status = "mapped" if f.name in mapped else "derived" if f.name in derived else "enriched" if f.enrichment else "absent"
        out[f.name] = {"status": status, "required": f.required and status in ("mapped", "enriched")}
    return out


def uncovered(schema: Schema, produced: Sequence[str]) -> list[str]:
    """Required columns that nothing produces."""
    return sorted(set(schema.required) - set(produced))


def block_metrics(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: `rows` and `dq`, the mean share of required columns that are filled."""
    there = [c for c in required if c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(completeness(there)).alias("dq"))


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    """`df` with the length of the stripped text."""
    return df.withColumn("text_length", F.length(tx.strip(F.col(column))))


def silver_normal(df: DataFrame, schema: Schema, as_of: str) -> DataFrame:
    """All columns of the schema in its order, absent ones as nulls, further ones dropped; the first score is computed anew if a required
    column had to be added."""
    out = enforce(df, schema, ())
    lacking = [c for c in schema.required if c not in df.columns]
    if lacking and "dq_score_pre" in out.columns:
        out = quality_score(out, "dq_score_pre", as_of)
    return out.select(*[f.name for f in schema.fields])
