"""Pairwise association rules and the product graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.operators.dedup import dense_group_ids
from larder.session import cut, release_shuffles

# Least support, confidence and lift, greatest vocabulary.
SUPPORT, CONFIDENCE, LIFT, VOCABULARY = 0.005, 0.10, 1.2, 15_000


def item_id(c: Column) -> Column:
    """Id as text; "1.0" is "1"."""
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def vocabulary(tx: DataFrame, item: str, most: int = VOCABULARY) -> DataFrame:
    """The `most` items with the most rows (ties by item): the bound of the rule table's width."""
    n = tx.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    return n.orderBy(F.desc("_n"), item).limit(most).select(item)


def pair_rules(tx: DataFrame, basket: str, item: str, min_count: int | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(antecedent, consequent, pair_count, support, confidence, lift) in both directions.

    Baskets of one row are left out before repeated items are; N is the number of the others. Items below the least pair count
    cannot be in a pair that reaches it, so they leave before the join of a basket's items; that is exact. Null ids are left out."""
    rows = tx.select(F.col(basket).alias("b"), F.col(item).alias("i")).filter("b is not null and i is not null").groupBy("b", "i").agg(F.count(F.lit(1)).alias("n"))
    multi = rows.withColumn("_rows", F.sum("n").over(W.partitionBy("b"))).filter("_rows > 1").select("b", "i")
    multi = cut(multi)
    total = multi.select("b").distinct().agg(F.count(F.lit(1)).alias("baskets"))
    least = F.lit(float(min_count)) if min_count is not None else F.col("baskets") * support
    singles = multi.groupBy("i").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(total)).filter(F.col("c") >= least)  # one row
    singles = cut(singles)
    kept = multi.join(singles.select("i"), "i", "left_semi")
    pairs = kept.select("b", F.col("i").alias("x")).join(kept.select("b", F.col("i").alias("y")), "b").filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("x").alias("antecedent"), F.col("y").alias("consequent"), "n").union(pairs.select("y", "x", "n"))
    a = singles.select(F.col("i").alias("antecedent"), F.col("c").alias("ca"), "baskets")
    b = singles.select(F.col("i").alias("consequent"), F.col("c").alias("cb"))
    out = both.join(a, "antecedent").join(b, "consequent").filter(F.col("n") >= least)
    conf = F.col("n") / F.col("ca")
    out = out.select("antecedent", "consequent", F.col("n").alias("pair_count"), (F.col("n") / F.col("baskets")).alias("support"), conf.alias("confidence"), (conf / (F.col("cb") / F.col("baskets"))).alias("lift"))
    return out.filter((F.col("confidence") >= confidence) & (F.col("lift") >= lift)).select("antecedent", "consequent", "pair_count", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def also_bought(rules: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k consequents of highest lift for each antecedent of `queries` (antecedent); ties by consequent."""
    hits = rules.join(queries.select("antecedent").distinct(), "antecedent", "left_semi")
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("antecedent").orderBy(F.desc("lift"), "consequent"))).filter(F.col("rank") <= k)


def top_antecedents(rules: DataFrame, n: int = 10) -> DataFrame:
    """The n antecedents with the most rules, with their greatest lift (a report)."""
    return rules.groupBy("antecedent").agg(F.count(F.lit(1)).alias("rules"), F.max("lift").alias("max_lift")).orderBy(F.desc("rules"), F.desc("max_lift"), "antecedent").limit(n)


def compare_rules(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: rules and greatest lift of two rule sets and the ratio of the lifts."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rules"), F.max("lift").alias("raw_lift"))
    b = enriched.agg(F.count(F.lit(1)).alias("enriched_rules"), F.max("lift").alias("enriched_lift"))
    return a.crossJoin(F.broadcast(b)).withColumn("ratio", F.round(F.col("enriched_lift") / F.nullif(F.col("raw_lift"), F.lit(0.0)), 6))


def find_product(catalogue: DataFrame, wanted: str, id_col: str = "product_id", name_col: str = "product_name", order: str = "row_id") -> DataFrame:
    """The product with that id, else the first whose name contains the text without case."""
    hit = F.when(item_id(F.col(id_col)) == wanted, 0).when(F.contains(F.lower(name_col), F.lit(wanted.lower())), 1)
    return catalogue.withColumn("_h", hit).filter("_h is not null").orderBy("_h", order).limit(1).drop("_h")


def product_graph(products: DataFrame, rules: DataFrame, id_col: str, category_col: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): products and categories (blank: Unknown), belongs_to edges of weight 1 and co_purchase edges of the lift
    between known products; of repeated edges the last lift counts (the greatest here)."""
    p = products.select(item_id(F.col(id_col)).alias("id"), F.when(F.trim(F.coalesce(category_col, F.lit(""))) != "", F.col(category_col)).otherwise("Unknown").alias("category")).dropDuplicates(["id"])
    cat = F.concat(F.lit("category:"), F.col("category"))
    nodes = p.select("id", F.lit("product").alias("node_type"), "category").union(p.select(cat, F.lit("category"), "category").distinct())
    r = rules.select(item_id(F.col("antecedent")).alias("src"), item_id(F.col("consequent")).alias("dst"), F.col("lift").alias("weight"))
    known = p.select("id")
    r = r.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    r = r.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    edges = p.select(F.col("id").alias("src"), cat.alias("dst"), F.lit("belongs_to").alias("edge_type"), F.lit(1.0).alias("weight")).union(r.select("src", "dst", F.lit("co_purchase"), "weight"))
    return nodes, edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, n) of nodes and edges."""
    return nodes.groupBy(F.lit("node").alias("what"), F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).union(edges.groupBy(F.lit("edge"), "edge_type").agg(F.count(F.lit(1))))


def cross_category(nodes: DataFrame, edges: DataFrame, sources: DataFrame, hops: int = 2, k: int = 5) -> DataFrame:
    """(source, product, hop, affinity, rank): products of another category within `hops` directed steps from each source.

    Breadth first, one join per hop; category nodes are reached but not left. The affinity is the weight of the last edge (the
    greatest among the paths of the least hop). The k of highest affinity, ties by product."""
    product = nodes.filter("node_type = 'product'").select("id", "category")
    seen = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hop"), F.lit(0.0).alias("affinity")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("source", F.col("node").alias("src")).join(edges.select("src", "dst", "weight"), "src")
        new = step.groupBy("source", F.col("dst").alias("node")).agg(F.max("weight").alias("affinity")).join(seen.select("source", "node"), ["source", "node"], "left_anti")
        new = cut(new.select("source", "node", F.lit(hop).alias("hop"), "affinity"))
        seen = seen.union(new)
        front = new.join(product.select(F.col("id").alias("node")), "node", "left_semi")
    own = product.select(F.col("id").alias("source"), F.col("category").alias("own"))
    out = seen.filter("hop > 0").join(product.select(F.col("id").alias("node"), "category"), "node").join(own, "source").filter("category <> own and category <> ''")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc(F.round("affinity", 4)), "node")))
    return ranked.filter(F.col("rank") <= k).select("source", F.col("node").alias("product"), "hop", F.round("affinity", 4).alias("affinity"), "rank")


def shortest_paths(edges: DataFrame, pairs: DataFrame, limit: int = 1000) -> DataFrame:
    """(source, target, hops, path) of a shortest directed path for each pair (least path in order of its nodes); no row where there
    is none. The search of a source stops when its targets are reached or nothing new is; paths beyond `limit` edges raise."""
    e = edges.select("src", "dst").distinct()
    todo = cut(pairs.select("source", "target").distinct())
    found = todo.filter("source = target").select("source", "target", F.lit(0).alias("hops"), F.array("source").alias("path"))
    front = cut(todo.filter("source <> target").select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    seen = front.select("source", "node")
    for hop in range(1, limit + 1):
        step = front.join(e.withColumnRenamed("src", "node"), "node").select("source", "dst", F.concat("path", F.array("dst")).alias("path"))
        new = cut(step.groupBy("source", F.col("dst").alias("node")).agg(F.min("path").alias("path")).join(seen, ["source", "node"], "left_anti"))
        reached = todo.join(new.select("source", F.col("node").alias("target"), "path"), ["source", "target"]).select("source", "target", F.lit(hop).alias("hops"), "path")
        found = found.union(reached)
        todo = cut(todo.join(reached, ["source", "target"], "left_anti"))
        open_sources = todo.select("source").distinct()
        front = new.join(open_sources, "source", "left_semi")
        seen = cut(seen.union(new.select("source", "node")))
        if front.limit(1).count() == 0:
            return found
    raise RuntimeError(f"paths longer than {limit} edges")


def shortest_hops(edges: DataFrame, pairs: DataFrame, limit: int = 1000) -> DataFrame:
    """(source, target, hops) of each pair that a directed path joins, as `shortest_paths` without the paths; repeated edges do no harm.

    All searches go at once, from the side of the pairs with fewer ends. Those that have reached a node are bits, 64 a row, so a
    round handles nodes and not nodes times searches. Edges into the other side's ends are tried before the front moves on; it
    stops when no pair is open or nothing new is reached, and paths beyond `limit` edges raise."""
    e = edges.select("src", "dst").filter("src is not null and dst is not null")
    pairs = cut(pairs.select("source", "target").distinct())
    count = {c: pairs.select(c).distinct().count() for c in ("source", "target")}
    seed, end = ("source", "target") if count["source"] <= count["target"] else ("target", "source")
    if seed == "target":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    number = cut(dense_group_ids(pairs.select(F.col(seed).alias("seed")).distinct(), "seed", "no"))
    placed = number.select("seed", F.floor(F.col("no") / 64).alias("word"), F.expr("shiftleft(1L, cast(no % 64 as int))").alias("bits"))
    apart = pairs.filter("source <> target").select(F.col(seed).alias("seed"), F.col(end).alias("node"))
    todo = cut(apart.join(placed, "seed").groupBy("node", "word").agg(F.bit_or("bits").alias("open")))
    last = cut(e.join(todo.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi"))
    state = cut(placed.select(F.col("seed").alias("node"), "word", F.col("bits").alias("seen"), F.col("bits").alias("new")))
    hits = None
    for hop in range(1, limit + 1):
        searching = todo.groupBy("word").agg(F.bit_or("open").alias("_o"))
        front = state.filter("new <> 0").join(searching, "word").select(F.col("node").alias("src"), "word", F.col("new").bitwiseAND(F.col("_o")).alias("new")).filter("new <> 0")
        step = lambda to: front.join(to, "src").select(F.col("dst").alias("node"), "word", "new")  # noqa: E731, B023
        reached = step(last).groupBy("node", "word").agg(F.bit_or("new").alias("new"))
        both = cut(todo.join(reached, ["node", "word"], "left").select("node", "word", "open", F.coalesce(F.col("open").bitwiseAND(F.col("new")), F.lit(0)).alias("got")))
        hit = both.filter("got <> 0").select("node", "word", "got", F.lit(hop).alias("hops"))
        hits = hit if hits is None else hits.union(hit)
        todo = both.select("node", "word", F.col("open").bitwiseXOR(F.col("got")).alias("open")).filter("open <> 0")
        if todo.limit(1).count() == 0:
            break
        moved = step(e).withColumn("seen", F.lit(0).cast("long")).union(state.select("node", "word", F.lit(0).cast("long"), "seen"))
        moved = moved.groupBy("node", "word").agg(F.bit_or("new").alias("new"), F.bit_or("seen").alias("seen"))
        state = cut(moved.select("node", "word", F.col("seen").bitwiseOR(F.col("new")).alias("seen"), F.col("new").bitwiseAND(F.bitwise_not("seen")).alias("new")), state)
        release_shuffles(state.sparkSession)
        if state.filter("new <> 0").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"paths longer than {limit} edges")
    each = hits.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("shiftrightunsigned(got, no) & 1 = 1")
    each = each.select(F.col("node").alias(end), (F.col("word") * 64 + F.col("no")).alias("no"), "hops").join(number.withColumnRenamed("seed", seed), "no")
    return each.select("source", "target", "hops").union(pairs.filter("source = target").select("source", "target", F.lit(0)))


def coverage(rules: DataFrame, columns: Sequence[str] = ("antecedent", "consequent")) -> DataFrame:
    """Distinct items of each side of the rules."""
    return rules.agg(*[F.count_distinct(c).alias(f"{c}s") for c in columns])
