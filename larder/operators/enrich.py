"""Rule-based and nearest-neighbour enrichment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions import text as tx

# Similarity from which a neighbour votes, confidence from which its category is taken, neighbours, corpus limits.
VOTE, ACCEPT, NEIGHBOURS = 0.45, 0.60, 5
CORPUS_DAYS, CORPUS_ROWS = 90, 500_000


@dataclass(frozen=True)
class Rule:
    """A field filled by patterns: kind boolean (any match), multi (all labels) or single (the first that matches)."""

    name: str
    kind: str
    patterns: tuple[tuple[str, str], ...]


# Rules of the food domain, in order of priority.
ALLERGEN_RULE = Rule("allergens", "multi", (
    (r"\b(milk|dairy|lactose|casein|whey|cream|butter)\b", "milk"), (r"\b(egg|albumin|lysozyme|mayonnaise)\b", "egg"), (r"\b(fish|cod|salmon|tuna|anchov|bass|tilapia)\b", "fish"),
    (r"\b(shellfish|shrimp|crab|lobster|crawfish|prawn)\b", "shellfish"), (r"\b(almond|cashew|walnut|pecan|pistachio|macadamia|hazelnut|brazil\s*nut)\b", "tree nut"), (r"\b(peanut)\b", "peanut"),
    (r"\b(wheat|flour|gluten|semolina|durum|spelt)\b", "wheat"), (r"\b(soy|soybean|soya|tofu|edamame|lecithin)\b", "soybean"), (r"\b(sesame|tahini)\b", "sesame"),
))
DIET_RULE = Rule("dietary_tags", "multi", (
    (r"\b(gluten[\s-]?free)\b", "gluten-free"), (r"\b(vegan)\b", "vegan"), (r"\b(vegetarian)\b", "vegetarian"), (r"\b(kosher)\b", "kosher"), (r"\b(halal)\b", "halal"),
    (r"\b(sugar[\s-]?free)\b", "sugar-free"), (r"\b(low[\s-]?fat)\b", "low-fat"), (r"\b(non[\s-]?gmo)\b", "non-gmo"), (r"\b(keto)\b", "keto"),
))
ORGANIC_RULE = Rule("is_organic", "boolean", ((r"\b(organic|usda\s+organic)\b", "true"),))
CATEGORY_RULE = Rule("primary_category", "single", (
    (r"\b(cereal|oat|granola|muesli)\b", "Breakfast Cereals"), (r"\b(milk|cream|yogurt|cheese|butter|dairy)\b", "Dairy"), (r"\b(chicken|beef|pork|turkey|meat|sausage|bacon)\b", "Meat & Poultry"),
    (r"\b(fish|salmon|tuna|shrimp|seafood|cod)\b", "Seafood"), (r"\b(bread|bagel|muffin|croissant|baguette|roll)\b", "Bakery"), (r"\b(candy|chocolate|gummy|sweet|confection)\b", "Confectionery"),
    (r"\b(chip|pretzel|popcorn|cracker|snack)\b", "Snacks"), (r"\b(juice|soda|water|tea|coffee|beverage|drink)\b", "Beverages"), (r"\b(sauce|ketchup|mustard|dressing|condiment|mayo)\b", "Condiments"),
    (r"\b(frozen|ice cream|popsicle)\b", "Frozen Foods"), (r"\b(fruit|apple|banana|berry|orange|grape)\b", "Fruits"), (r"\b(vegetable|carrot|broccoli|spinach|lettuce|tomato)\b", "Vegetables"),
    (r"\b(pasta|noodle|spaghetti|macaroni)\b", "Pasta & Grains"), (r"\b(rice|quinoa|couscous)\b", "Pasta & Grains"), (r"\b(soup|stew|broth|chili)\b", "Soups"), (r"\b(baby|infant|toddler)\b", "Baby Food"),
    (r"\b(organic)\b", "Organic"), (r"\b(supplement|vitamin|mineral|protein powder)\b", "Supplements"),
))
FOOD_RULES = (ALLERGEN_RULE, DIET_RULE, ORGANIC_RULE, CATEGORY_RULE)


def load_rules(spec: dict) -> tuple[list[Rule], list[str]]:
    """(rules, text columns) of {text_columns, fields: [{name, output_type, patterns: [{regex, label}]}]}; bad patterns are left out."""
    rules = []
    for f in spec.get("fields", []):
        good = []
        for p in f.get("patterns", []):
            try:
                re.compile(p["regex"])
                good.append((p["regex"], str(p.get("label", ""))))
            except re.error:
                continue
        rules.append(Rule(f["name"], f.get("output_type", "single"), tuple(good)))
    return rules, list(spec.get("text_columns") or ["product_name", "ingredients", "category"])


def rule_value(rule: Rule, text: Column) -> Column:
    """Value of a rule over a text: nothing found gives false, "" or null by kind."""
    hit = lambda p: text.rlike(f"(?i){p}")
    if rule.kind == "boolean":
        any_hit = F.lit(False)
        for p, _ in rule.patterns:
            any_hit = any_hit | hit(p)
        return any_hit
    if rule.kind == "multi":
        return F.array_join(F.array_compact(F.array(*[F.when(hit(p), F.lit(label)) for p, label in rule.patterns])), ", ")
    return F.coalesce(*[F.when(hit(p), F.lit(label)) for p, label in rule.patterns])


def joined_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Texts of the columns there are, nulls as nothing, joined by spaces."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns])


def apply_rules(df: DataFrame, rules: Sequence[Rule] = FOOD_RULES, text_columns: Sequence[str] = ("product_name", "ingredients", "category")) -> DataFrame:
    """Fill null (or absent) rule fields; present values stay."""
    text = joined_text(df, text_columns)
    new = {}
    for r in rules:
        value = rule_value(r, text)
        new[r.name] = F.coalesce(F.col(r.name), value) if r.name in df.columns else value
    return df.withColumns(new)


def needs_enrichment(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether any of the columns is null or absent."""
    out = F.lit(any(c not in df.columns for c in columns))
    for c in columns:
        if c in df.columns:
            out = out | F.col(c).isNull()
    return out


def query_text(df: DataFrame, columns: Sequence[str] = ("product_name", "brand_name", "ingredients", "category")) -> Column:
    """Non-blank texts joined by spaces."""
    return F.concat_ws(" ", *[F.when(tx.strip(F.col(c)) != "", F.col(c)) for c in columns if c in df.columns])


def vector_id(text: Column, category: Column) -> Column:
    """Key of a corpus entry: equal text and category replace each other."""
    return F.substring(F.sha2(F.concat(tx.strip(text), F.coalesce(category, F.lit(""))), 256), 1, 16)


def upsert_corpus(corpus: DataFrame, new: DataFrame, key: str = "id", seen: str = "last_seen") -> DataFrame:
    """Union by key, the latest entry wins."""
    both = corpus.unionByName(new)
    return both.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seen)))).filter("_i = 1").drop("_i")


def evict_corpus(corpus: DataFrame, as_of: str, key: str = "id", seen: str = "last_seen", days: int = CORPUS_DAYS, rows: int = CORPUS_ROWS) -> DataFrame:
    """Without entries older than `days` and, beyond `rows`, without the oldest (ties by key)."""
    kept = corpus.filter(F.datediff(F.lit(as_of).cast("date"), F.col(seen).cast("date")) <= days)
    over = kept.count() - rows
    return kept if over <= 0 else kept.orderBy(F.desc(seen), key).limit(rows)


def knn(queries: DataFrame, corpus: DataFrame, k: int = NEIGHBOURS, query_id: str = "query_id", row_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2000) -> DataFrame:
    """(query_id, row_id, label, similarity, rank): the k rows of `corpus` of highest cosine to each row of `queries` (exact;
    ties by row id). The stated queries go in blocks of `block` vectors over all rows; each task keeps k per query, so
    k * queries rows per task are merged. Null, empty or zero vectors are left out."""
    out = None
    batch: list[tuple[int, list[float]]] = []

    def search(rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        sent = corpus.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best_s = np.full((len(ids), k), -np.inf)
            best_i = np.zeros((len(ids), k), np.int64)
            best_l = np.full((len(ids), k), None, object)
            for b in batches:
                vs = b[vector].to_pylist()
                keep = [i for i, v in enumerate(vs) if v and len(v) == q.shape[1] and any(v)]
                if not keep:
                    continue
                m = np.array([vs[i] for i in keep], dtype=np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                rid = b[row_id].to_numpy(zero_copy_only=False)[keep]
                lab = np.array(b[label].to_pylist(), dtype=object)[keep]
                s = np.round(q @ m.T, 12)
                all_s = np.hstack([best_s, s])
                all_i = np.hstack([best_i, np.tile(rid, (len(ids), 1))])
                all_l = np.hstack([best_l, np.tile(lab, (len(ids), 1))])
                order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best_s, best_i, best_l = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1), np.take_along_axis(all_l, order, 1)
            at = np.isfinite(best_s)
            qi = np.tile(ids[:, None], (1, k))
            yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(best_i[at]), pa.array([None if x is None else str(x) for x in best_l[at]], pa.string()), pa.array(best_s[at])], names=["q", "r", "label", "similarity"])

        return corpus.select(row_id, label, vector).mapInArrow(run, "q long, r long, label string, similarity double")

    for r in queries.select(query_id, vector).filter(F.size(vector) > 0).toLocalIterator():
        batch.append((r[0], r[1]))
        if len(batch) == block:
            part, batch = search(batch), []
            out = part if out is None else out.union(part)
    if batch or out is None:
        if not batch:
            return queries.sparkSession.createDataFrame([], f"{query_id} long, {row_id} long, label string, similarity double, rank int")
        part = search(batch)
        out = part if out is None else out.union(part)
    order = W.partitionBy("q").orderBy(F.desc("similarity"), "r")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "label", "similarity", "rank")


def category_vote(neighbours: DataFrame, query_id: str = "query_id", vote: float = VOTE, accept: float = ACCEPT) -> DataFrame:
    """(query_id, category, confidence): the label with the greatest summed similarity among neighbours of at least `vote`; its
    mean similarity is the confidence, and below `accept` the category is null. Ties: the first label."""
    sums = neighbours.filter(F.col("similarity") >= vote).groupBy(query_id, "label").agg(F.sum("similarity").alias("s"), F.avg("similarity").alias("confidence"))
    best = sums.withColumn("_i", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("s"), "label"))).filter("_i = 1")
    return best.select(query_id, F.when(F.col("confidence") >= accept, F.col("label")).alias("category"), "confidence")


def keyword_category(text: Column, words: dict[str, str], default: str | None = None) -> Column:
    """Label of the first keyword in the text, without case."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.contains(w.lower()), F.lit(c)) for w, c in words.items()], F.lit(default))


def map_taxonomy(df: DataFrame, mapping: dict[str, str], column: str, into: str) -> DataFrame:
    """`into` by a table of category names (a literal of the plan); unknown names give null."""
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)])
    return df.withColumn(into, F.try_element_at(table, F.col(column)))


def classify(df: DataFrame, key: str, text: Column, classifier: Callable[[list[str]], list[str | None]] | None = None, into: str = "primary_category", batch: int = 50) -> DataFrame:
    """(key, into) by a pluggable classifier over batches of texts; without one every category is null. Only this one column is
    returned, so a classifier cannot touch safety fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["_text"].to_pylist()
            labels: list[str | None] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                labels += list(classifier(part)) if classifier else [None] * len(part)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(labels, pa.string())], names=[key, into])

    kind = dict(df.dtypes)[key]
    return df.select(key, text.alias("_text")).mapInArrow(run, f"{key} {kind}, {into} string")


def cached_lookup(df: DataFrame, cache: DataFrame, key: str, now: str, value: str = "value", expires: str = "expires_at") -> DataFrame:
    """`df` with `value` and `cache_hit`: entries of the cache (key, value, expires_at) that have not expired; the latest per key."""
    live = cache.filter(F.col(expires) > F.lit(now).cast("timestamp")).groupBy(key).agg(F.max_by(value, expires).alias(value))
    return df.join(live, key, "left").withColumn("cache_hit", F.col(value).isNotNull())


def corpus_texts(df: DataFrame, key: str, date: str, row_id: str, category: str, mapping: dict[str, str], texts: Sequence[str], least: int) -> DataFrame:
    """(row_id, category, text) of rows for a corpus: the latest of each non-blank key (ties by id) and all without a key, with a category
    that `mapping` (stripped lower-case name to label) knows and at least `least` characters of non-blank texts."""
    keyed = tx.strip(F.coalesce(key, F.lit(""))) != ""
    columns = [row_id, category, *texts]
    latest = df.filter(keyed).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(date, F.lit("")), -F.col(row_id))).alias("_r")).select("_r.*")
    rows = latest.unionByName(df.filter(~keyed).select(*columns))
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)])
    text = F.concat_ws(" ", *[F.nullif(tx.strip(F.col(c)), F.lit("")) for c in texts])
    out = rows.select(row_id, F.try_element_at(table, F.lower(tx.strip(F.col(category)))).alias("category"), text.alias("text"))
    return out.filter(F.col("category").isNotNull() & (F.length("text") >= least))
