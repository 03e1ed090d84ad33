"""Text search: BM25 postings, rank fusion, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.operators.joins import first_per_key
from larder.operators.reports import suppress_recalled

# BM25 parameters, fusion constant, candidates per list, gains of relevance labels.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, CANDIDATES = 60, 50
GAINS = {"E": 3, "S": 2, "C": 1, "I": 0}


def clean_index(df: DataFrame, name: str, brand: str, order: str) -> DataFrame:
    """Rows with a name, the first of each (name, brand)."""
    return first_per_key(df.filter(F.col(name).isNotNull()), [name, brand], [order])


def searchable_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Non-empty texts joined, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in columns if c in df.columns]))


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query among those with a common word (ties by document id).

    Inverse document frequencies below zero become EPSILON times the mean over all words; a word repeated in the query counts
    again. Postings are cut to the queries' words before anything is joined; document statistics cover all documents. Null and
    empty texts count as documents of no words."""
    # The texts are exchanged once, by document, and their words are counted where they are.
    words = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).repartition("d").select("d", tokens(F.coalesce(F.col("t"), F.lit(""))).alias("w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    postings = words.select("d", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("d", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    wanted = queries.select(F.col(query_id).alias("q"), F.explode(tokens(F.col(query))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = wanted.hint("merge").join(idf.hint("merge"), "term").crossJoin(F.broadcast(mean))  # one row
    wanted = wanted.select("q", "term", "qtf", "avg_len", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    # Sizes estimated from compressed files make postings and vocabulary look small; neither is ever sent to the driver.
    hits = postings.hint("merge").join(wanted.hint("merge"), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scores = hits.groupBy("q", "d").agg(F.round(F.sum(part), 6).alias("score"))
    best = scores.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "d"))).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score", "rank")


def fuse(lists: Sequence[DataFrame], query_id: str, key: str, k: int = RRF_K, candidates: int = CANDIDATES, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, key, rank): the sum of 1 / (k + rank), six digits, ties by key."""
    union = None
    for one in lists:
        part = one.filter(F.col("rank") <= candidates).select(query_id, key, (1.0 / (k + F.col("rank"))).alias("s"))
        union = part if union is None else union.union(part)
    fused = union.groupBy(query_id, key).agg(F.round(F.sum("s"), 6).alias("rrf"))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("rrf"), key)))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def search(mode: str, text_search: Callable[[], DataFrame], vector_search: Callable[[], DataFrame], query_id: str, key: str, k: int) -> DataFrame:
    """Ranked list by mode: bm25, semantic or hybrid (fusion of both)."""
    if mode == "bm25":
        return text_search().filter(F.col("rank") <= k)
    if mode == "semantic":
        return vector_search().filter(F.col("rank") <= k)
    if mode == "hybrid":
        return fuse([text_search(), vector_search()], query_id, key, top=k)
    raise ValueError(f"unknown mode {mode!r}")


def judged(results: DataFrame, truth: DataFrame, query: str = "query", title: str = "title", label: str = "label", order: str = "row_id") -> DataFrame:
    """`results` with the gain of the truth's label, query and title matched without case, the first entry of each; no entry, 0."""
    key = truth.select(F.lower(query).alias("_q"), F.lower(title).alias("_t"), F.col(label).alias("_l"), order)
    first = first_per_key(key, ["_q", "_t"], [order]).drop(order)
    gain = F.coalesce(*[F.when(F.col("_l") == k, F.lit(v)) for k, v in GAINS.items()], F.lit(0))
    return results.withColumns({"_q": F.lower(query), "_t": F.lower(title)}).join(first, ["_q", "_t"], "left").withColumn("gain", gain).drop("_q", "_t", "_l")


def ranking_metrics(judgements: DataFrame, query_id: str, k: int = 10, relevant: int = 2) -> DataFrame:
    """(query_id, ndcg, rr) of (query_id, rank, gain): gains over log2(rank + 1), the ideal order being that of the list itself;
    reciprocal rank of the first gain of at least `relevant`. A list without any gain has nDCG 0."""
    top = judgements.filter(F.col("rank") <= k)
    ideal = top.withColumn("_i", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("gain"), "rank")))
    out = ideal.groupBy(query_id).agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("_i") + 1)).alias("idcg"), F.min(F.when(F.col("gain") >= relevant, F.col("rank"))).alias("first"),
    )
    return out.select(query_id, F.round(F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def filter_results(df: DataFrame, domain: str | None = None, category: str | None = None) -> DataFrame:
    """Results of a data source that starts with `domain`, and of a category."""
    if domain:
        df = df.filter(F.col("data_source").startswith(domain))
    return df.filter(F.col("category") == category) if category else df


def sample_queries(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first n distinct queries by first appearance (a sampling operator)."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_o")).orderBy("_o").limit(n).select(column)


def suppress_ranked(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of a ranked list without the recalled ones: fewer than k may be left."""
    return suppress_recalled(df.orderBy(*order).limit(k))
