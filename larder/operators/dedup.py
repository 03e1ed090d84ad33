"""Blocked fuzzy deduplication, connected components, merging and golden records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions import text as tx
from larder.operators import pairs
from larder.operators.quality import BOOKKEEPING
from larder.session import cut

# Threshold, weights in a pair's score (the token-sorted ratio of names, the ratio of brands, the token-sorted ratio of
# both together), and the words a cache key leaves out.
THRESHOLD, PAIR_WEIGHTS = 0.85, (0.5, 0.2, 0.3)
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "for", "with", "by")
GOLDEN_WEIGHTS = (0.4, 0.35, 0.25)


def blocking_key(name: Column, brand: Column) -> Column:
    """First four letters of the name and two of the brand; null (no block) without a name."""
    n = F.trim(F.substring(F.lower(name), 1, 4))
    return F.when(n != "", F.concat(n, F.lit("_"), F.trim(F.substring(F.lower(F.coalesce(brand, F.lit(""))), 1, 2))))


def dedup_key(name: Column) -> Column:
    """Lower case without stop words, single spaces."""
    return tx.squeeze(F.regexp_replace(F.lower(name), rf"\b(?:{'|'.join(STOP_WORDS)})\b", ""))


def exact_classes(df: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """`df` with `rep`, the least row id of the rows with equal keys (nulls equal): copies are compared once. The least ids are
    aggregated and joined, so a group of copies of any size is never gathered in one task."""
    least = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(row_id).alias("rep"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(least, reduce(lambda x, y: x & y, same)).drop(*[f"_k{i}" for i in range(len(keys))])


#: Texts of a slice of a block: all pairs of two slices are one group of a task.
SLICE_ROWS = 4_000
#: Pairs for which a task is planned.
TASK_PAIRS = 10_000_000


def fuzzy_links(df: DataFrame, row_id: str, name: str = "product_name", brand: str = "brand_name", threshold: float = THRESHOLD, slices: int | None = None) -> DataFrame:
    """(a, b, score), a < b: linked pairs of distinct (name, brand) texts of one block, each as its least row id.

    Texts are lower-cased; equal texts are one from the start. A block's texts are dealt to `slices` slices (by default as many
    as its size asks for) and slice pairs are joined one by one, so a block with a third of all texts spreads over many tasks.
    In a task pairs whose letters alone rule out the threshold are dropped before the score is computed (`pairs.linked`)."""
    reps = df.select(F.col(row_id).alias("id"), F.lower(F.coalesce(name, F.lit(""))).alias("n"), F.lower(F.coalesce(brand, F.lit(""))).alias("b")).groupBy("n", "b").agg(F.min("id").alias("id"))
    reps = cut(reps.withColumn("key", blocking_key(F.col("n"), F.col("b"))).filter("key is not null"))
    blocks = reps.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    blocks = cut(blocks.withColumn("slices", F.lit(slices) if slices else F.ceil(F.col("rows") / SLICE_ROWS).cast("int")))
    pairs_met = blocks.agg(F.sum(F.col("rows").cast("double") * F.col("rows") / 2)).first()[0] or 0.0
    dealt = reps.join(blocks, "key").withColumn("slice", F.pmod(F.xxhash64("n", "b"), F.col("slices")).cast("int"))
    # Slice pair (lo, hi): texts of lo on one side, of hi on the other; within one slice each two texts once.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumns({"lo": F.least("slice", "other"), "hi": F.greatest("slice", "other")})
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "lo", "hi", "slice"]
    dealt = dealt.select(*group, "id", "n", "b").repartition(max(shuffled, int(pairs_met / TASK_PAIRS)), *group[:3]).sortWithinPartitions(*group)
    kind = dict(reps.dtypes)["id"]
    links = dealt.mapInArrow(lambda x: pairs.link_rows(x, PAIR_WEIGHTS, threshold), f"x {kind}, y {kind}, score double")
    return links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 100) -> DataFrame:
    """(node, component) of an undirected graph, the component being its least node. Alternating large-star and small-star
    steps until nothing changes, which take logarithmically many rounds and never gather a component in one task's memory;
    more than `limit` rounds raise."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    nodes = e
    last = None
    for _ in range(limit):
        # Large star: every larger neighbour is joined to the least neighbour (or itself).
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e1 = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: every smaller neighbour, and the node itself, is joined to the least.
        low1 = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(low1, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low1.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e2, *([e] if e is not nodes else []))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components still change after {limit} rounds")
    found = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    all_nodes = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return all_nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def duplicate_groups(df: DataFrame, row_id: str, name: str = "product_name", brand: str = "brand_name", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with `duplicate_group_id` (the least row id of its group) and `canonical` (true for that row). Without the name
    column every row is its own group. A row with a blank name is linked to its exact copies only if it has a name."""
    if name not in df.columns:
        return df.withColumns({"duplicate_group_id": F.col(row_id), "canonical": F.lit(True)})
    low = [F.lower(F.coalesce(name, F.lit(""))).alias("_n"), F.lower(F.coalesce(brand, F.lit(""))).alias("_b")]
    keyed = df.select("*", *low)
    blocked = blocking_key(F.col("_n"), F.col("_b")).isNotNull()
    least = keyed.filter(blocked).groupBy("_n", "_b").agg(F.min(row_id).alias("_rep"))
    # Rows without a block meet nothing, so that a third of all rows with blank names is no hot key.
    apart = keyed.withColumn("_n", F.when(blocked, F.col("_n"))).join(least, ["_n", "_b"], "left")
    keyed = apart.withColumn("_rep", F.coalesce("_rep", F.col(row_id))).drop("_n", "_b")
    comp = connected_components(fuzzy_links(df, row_id, name, brand, threshold))
    out = keyed.join(comp.select(F.col("node").alias("_rep"), "component"), "_rep", "left").withColumn("duplicate_group_id", F.coalesce("component", "_rep")).drop("component", "_rep")
    return out.withColumn("canonical", F.col(row_id) == F.col("duplicate_group_id"))


def dense_group_ids(df: DataFrame, group: str = "duplicate_group_id", into: str = "group_no") -> DataFrame:
    """Numbers 0, 1, ... of the groups in the order of their ids, by partition counts instead of one global window."""
    groups = cut(df.select(group).distinct().repartitionByRange(group).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = groups.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # one row per partition
    numbers = groups.withColumn("_i", F.row_number().over(W.partitionBy("_part").orderBy(group)) - 1).join(parts, "_part").select(group, (F.col("_n0") + F.col("_i")).alias(into))
    return df.join(numbers, group)


def merge_columns(df: DataFrame, group: str, row_id: str) -> DataFrame:
    """One row per group: of text columns the longest value (the first row's on ties), of others the first that is not null."""
    aggs = []
    for c, t in df.dtypes:
        if c in (group, row_id):
            continue
        there = F.col(c).isNotNull()
        order = F.struct(F.length(c), -F.col(row_id)) if t == "string" else -F.col(row_id)
        aggs.append(F.max_by(F.when(there, F.col(c)), F.when(there, order)).alias(c))
    return df.groupBy(group).agg(F.min(row_id).alias(row_id), *aggs)


def golden_records(df: DataFrame, group: str, row_id: str, date: str | None = None, text: str | None = None, weights: Sequence[float] = GOLDEN_WEIGHTS) -> DataFrame:
    """The best row of each group with its `golden_score`: completeness, freshness (min-max of the dates over the table; 1 if
    there is one date, 0.5 for a null date or no date column) and richness of `text`; the first row on ties."""
    columns = [c for c in df.columns if c not in (*BOOKKEEPING, group, row_id)]
    complete = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / F.lit(float(max(1, len(columns))))
    d = F.unix_timestamp(F.col(date).try_cast("timestamp")).cast("double") if date else F.lit(None).cast("double")
    n = F.length(text).cast("double") if text else F.lit(0.0)
    work = df.withColumns({"_d": d, "_t": F.coalesce(n, F.lit(0.0))})
    one = work.agg(F.min("_d").alias("_d0"), F.max("_d").alias("_d1"), F.max("_t").alias("_t1"))
    work = work.crossJoin(F.broadcast(one))  # one row
    fresh = F.when(F.col("_d").isNull(), 0.5).when(F.col("_d1") == F.col("_d0"), 1.0).otherwise((F.col("_d") - F.col("_d0")) / F.nullif(F.col("_d1") - F.col("_d0"), F.lit(0.0)))
    rich = F.coalesce(F.col("_t") / F.nullif(F.col("_t1"), F.lit(0.0)), F.lit(0.0))
    work = work.withColumn("golden_score", F.round(weights[0] * complete + weights[1] * fresh + weights[2] * rich, 9)).drop("_d", "_t", "_d0", "_d1", "_t1")
    best = work.groupBy(group).agg(F.max_by(F.struct(*[c for c in work.columns if c != group]), F.struct("golden_score", -F.col(row_id))).alias("_r"))
    return best.select(group, "_r.*")


def cluster_stats(df: DataFrame, group: str = "duplicate_group_id") -> DataFrame:
    """One row: rows, clusters, duplicate rate, and the three greatest cluster sizes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), group).limit(3).agg(F.sort_array(F.collect_list("n"), asc=False).alias("largest"))
    return sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate")).crossJoin(F.broadcast(top))


def exact_duplicates(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Key values that occur more than once, with the number of rows and the least and greatest row id."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")).filter("n > 1")

