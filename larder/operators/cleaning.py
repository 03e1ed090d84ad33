"""Cleaning blocks: DataFrame to DataFrame, each usable with `DataFrame.transform`.

A block whose columns are absent returns the frame as it is. Nulls stay null unless a block says otherwise."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions import text as tx

# Legal forms of firms.
LEGAL = ("inc", "llc", "ltd", "corp", "co", "company", "corporation", "incorporated", "limited")
# Units of a quantity in a product name, as patterns.
QUANTITY_UNITS = ("oz", "g", "mg", "kg", "lb", "lbs", "ml", "l", r"fl\s*oz", "gal", "ct", "count", "pk", "pack")
# Texts of a cell that say nothing, so that the next column is read for allergens.
SILENT_TEXTS = ("", "nan", "none", "<na>")
# Names of medications.
MEDICATIONS = (
    "metformin", "lisinopril", "atorvastatin", "omeprazole", "amlodipine", "levothyroxine", "albuterol", "gabapentin", "losartan", "metoprolol",
    "aspirin", "warfarin", "furosemide", "prednisone", "insulin", "sertraline", "escitalopram", "azithromycin", "ciprofloxacin", "ibuprofen",
)
# A disease code.
DISEASE_CODE = r"\b([A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?)\b"
# Allergens with the words that show them.
ALLERGENS = {
    "milk": r"milk|dairy|lactose|casein|whey|cream|butter",
    "egg": r"eggs?|albumin|lysozyme|mayonnaise",
    "fish": r"fish|cod|salmon|tuna|anchovies?|bass|tilapia",
    "shellfish": r"shellfish|shrimps?|crabs?|lobsters?|crawfish|prawns?",
    "tree nut": r"almonds?|cashews?|walnuts?|pecans?|pistachios?|macadamia|hazelnuts?|brazil\s*nuts?",
    "peanut": r"peanuts?",
    "wheat": r"wheat|flour|gluten|semolina|durum|spelt",
    "soybean": r"soy|soybeans?|soya|tofu|edamame|lecithin",
    "sesame": r"sesame|tahini",
}


def _on(df: DataFrame, columns: Sequence[str], f) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in columns if c in df.columns})


def _unless_empty(df: DataFrame, columns: Sequence[str], f) -> DataFrame:
    """Columns replaced by `f` of them where that is not empty. The value has a projection of its own, so that a chain of
    blocks does not repeat its expression in every branch."""
    there = [c for c in columns if c in df.columns]
    df = df.withColumns({f"_{c}": f(F.col(c)) for c in there})
    return df.withColumns({c: F.when(F.col(f"_{c}") == "", F.col(c)).otherwise(F.col(f"_{c}")) for c in there}).drop(*[f"_{c}" for c in there])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename in one go; of columns that get the same name the last one stays."""
    new = [mapping.get(c, c) for c in df.columns]
    last = {n: i for i, n in enumerate(new)}
    return df.toDF(*[f"_c{i}" for i in range(len(new))]).select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(new) if last[n] == i])


def snake_case(name: str) -> str:
    """Column name in lower case with single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())).strip("_")


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Every text column stripped, empty texts null."""
    return _on(df, [c for c, t in df.dtypes if t == "string"], lambda c: F.nullif(tx.strip(c), F.lit("")))


def lowercase_brand(df: DataFrame, column: str = "brand_name") -> DataFrame:
    return _on(df, [column], F.lower)


def remove_noise_words(df: DataFrame, columns: Sequence[str] = ("product_name", "brand_name"), words: Sequence[str] = LEGAL) -> DataFrame:
    """Without legal forms; a text of nothing else stays as it is."""

    return _unless_empty(df, columns, lambda c: tx.strip(F.regexp_replace(c, rf"(?i)\b(?:{'|'.join(words)})\b\.?", "")))


def strip_punctuation(df: DataFrame, columns: Sequence[str] = ("product_name", "brand_name")) -> DataFrame:
    """Punctuation as spaces, single spaces; an empty text stays as it is."""
    df = _on(df, columns, lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return _on(df, columns, tx.strip)


def keep_quantity_in_name(df: DataFrame) -> DataFrame:
    return df


def extract_quantity(df: DataFrame, column: str = "product_name", into: str = "sizes") -> DataFrame:
    """All quantities of the name as value and unit, as written, joined by "; " in `into` (null if none), and taken out of the
    name; a name of nothing else stays as it is."""
    if column not in df.columns:
        return df
    p = rf"(?iU)([0-9]+\.?[0-9]*)\s*({'|'.join(QUANTITY_UNITS)})\b"
    c = F.col(column)
    found = F.zip_with(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2)), lambda value, unit: F.concat(value, unit))
    # Values and names have projections of their own, so that a chain of blocks does not repeat their expressions.
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, p, ""), r"(?U)\s+", " "), r"^[, ]+|[, ]+$", "")
    df = df.withColumns({"_found": found, "_rest": rest})
    any_found = F.size("_found") > 0
    return df.withColumns({into: F.when(any_found, F.array_join("_found", "; ")), column: F.when(any_found & (F.col("_rest") != ""), F.col("_rest")).otherwise(c)}).drop("_found", "_rest")


def extract_allergens(df: DataFrame, columns: Sequence[str] = ("ingredients", "recall_reason"), into: str = "allergens") -> DataFrame:
    """Labels found in the first of the columns that says something in the row, in order, joined by ", "; a text without any gives
    "", a blank one or none null. Without any of the columns `into` is null."""
    there = [F.col(c) for c in columns if c in df.columns]
    if not there:
        return df.withColumn(into, F.lit(None).cast("string"))
    df = df.withColumn("_text", F.coalesce(*[F.when(~F.lower(c).isin(*SILENT_TEXTS), c) for c in there]))
    c = F.col("_text")
    hits = F.array_compact(F.array(*[F.when(c.rlike(rf"(?i)\b(?:{p})\b"), F.lit(a)) for a, p in sorted(ALLERGENS.items())]))
    return df.withColumn(into, F.when(tx.strip(c) != "", F.array_join(hits, ", "))).drop("_text")


def extract_codes(df: DataFrame, column: str, into: str, pattern: str = DISEASE_CODE) -> DataFrame:
    """Distinct matches of a code pattern in order, joined by ", " (null if none, or without the column); the default is a
    disease code."""
    if column not in df.columns:
        return df.withColumn(into, F.lit(None).cast("string"))
    codes = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)))
    return df.withColumn(into, F.when(F.size(codes) > 0, F.array_join(codes, ", ")))


def extract_words(df: DataFrame, column: str, into: str, words: Sequence[str] = MEDICATIONS) -> DataFrame:
    """Those of `words` that stand in the text, in the list's order, joined by ", " (null if none, or without the column)."""
    if column not in df.columns:
        return df.withColumn(into, F.lit(None).cast("string"))
    hits = F.array_compact(F.array(*[F.when(F.col(column).rlike(rf"(?i)\b{re.escape(w)}\b"), F.lit(w)) for w in words]))
    return df.withColumn(into, F.when(F.size(hits) > 0, F.array_join(hits, ", ")))


def last_word(df: DataFrame, column: str, into: str) -> DataFrame:
    """Last word of a text; null for a blank one."""
    t = tx.strip(F.col(column))
    return df.withColumn(into, F.when(t != "", F.try_element_at(F.split(t, r"\s+"), F.lit(-1))))


def noise_words(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """(word, documents): words in at least max(2, share of) the distinct values, and legal forms that occur."""
    values = df.select(F.lower(F.col(column)).alias("v")).filter("v is not null").distinct()
    n = values.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * share)).alias("least"))
    words = values.select(F.explode(F.array_distinct(F.regexp_extract_all("v", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    return counts.crossJoin(F.broadcast(n)).filter((F.col("documents") >= F.col("least")) | F.col("word").isin(*LEGAL)).select("word", "documents")  # n is one row


@F.pandas_udf(T.StringType())
def _repair(s: pd.Series) -> pd.Series:
    import html
    import json

    broken = re.compile("[Â-ô][-ÿŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")

    def reread(m: re.Match) -> str:
        try:
            return b"".join(ch.encode("cp1252") if ord(ch) > 255 else bytes([ord(ch)]) for ch in m.group()).decode()
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m.group()

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if t.lstrip().startswith("[") and '"lang"' in t:
            try:
                entries = {e.get("lang"): e.get("text") for e in json.loads(t) if isinstance(e, dict)}
                t = entries.get("main") or entries.get("en") or next((v for v in entries.values() if v), t)
            except ValueError:
                pass
        t = html.unescape(t)
        t = re.sub(r"(?<![A-Za-z0-9])u([0-9a-fA-F]{4})(?![0-9a-fA-F])", lambda m: chr(int(m.group(1), 16)), t)
        return re.sub(r"(?<=\w)©(?=\w|\b)", "é", broken.sub(reread, t))

    return s.map(one, na_action="ignore")


def repair_text(df: DataFrame, columns: Sequence[str], titles: bool = False) -> DataFrame:
    """Undo URL escapes, entities, bare uXXXX, wrong decoding and language lists; `<column>_changed` tells where."""
    out = df
    for c in columns:
        plain = F.coalesce(F.try_url_decode(F.col(c)), F.col(c))
        suspect = plain.rlike(r"&#?\w+;|u[0-9a-fA-F]{4}|[Â-ô©]|\"lang\"")
        fixed = F.when(suspect, _repair(F.when(suspect, plain))).otherwise(plain)  # only suspect texts leave the JVM
        fixed = tx.title(fixed) if titles else fixed
        out = out.withColumn("_new", fixed).withColumn(f"{c}_changed", ~F.col("_new").eqNullSafe(F.col(c))).withColumn(c, F.col("_new")).drop("_new")
    return out
