"""Enrichment in tiers: rules, then nearest neighbours in a corpus of labelled texts, then a pluggable classifier with a cache.

Only `primary_category` is filled beyond the rules; the safety fields (allergens, dietary tags, organic) come from the
rules alone, which `enrich` checks. Each tier sees the rows that the one before left without a category.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import enrich as E
from larder.session import cut

# Least corpus for a search, share of the unresolved rows below which the corpus is filled up.
LEAST_CORPUS, AUGMENT_BELOW = 1000, 0.25
#: Cosines that a task holds at once.
SIMILARITIES = 4_000_000
CATEGORY, SAFETY = "primary_category", ("allergens", "dietary_tags", "is_organic")
CORPUS = "id string, text string, category string, embedding array<float>, last_seen timestamp"


def hashed_vectors(df: DataFrame, text: str, into: str = "embedding", size: int = 64) -> DataFrame:
    """`df` with vectors of hashed words and word starts, of unit length; null for a text without a word. A stand-in with the
    interface of an encoder: any function (frame, text column, new column) will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            out = []
            for t in b[text].to_pylist():
                v = np.zeros(size, np.float32)
                for w in (t or "").lower().replace(",", " ").split():
                    for part, weight in ((w, 1.0), (w[:4], 0.5)):
                        h = zlib.crc32(part.encode())
                        v[h % size] += weight if h & 1 << 20 else -weight
                n = float(np.sqrt((v * v).sum()))
                out.append((v / n).tolist() if n else None)
            yield b.append_column(into, pa.array(out, pa.list_(pa.float32())))

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {into} array<float>")


def corpus_rows(df: DataFrame, as_of: str, encode: Callable = hashed_vectors) -> DataFrame:
    """Corpus entries of the rows of `df` that have a category: id, text, category, embedding, last_seen; equal ones once."""
    rows = df.filter(F.col(CATEGORY).isNotNull()).select(E.query_text(df).alias("text"), F.col(CATEGORY).alias("category")).filter("text <> ''")
    rows = rows.withColumn("id", E.vector_id(F.col("text"), F.col("category"))).groupBy("id").agg(F.min("text").alias("text"), F.min("category").alias("category"))
    return encode(rows, "text").filter("embedding is not null").select("id", "text", "category", "embedding", F.lit(as_of).cast("timestamp").alias("last_seen"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.float32)


def _similarities(q: np.ndarray, matrix: np.ndarray, most: int = SIMILARITIES) -> Iterator[np.ndarray]:
    """For each row of `q` its cosines to the rows of `matrix`, of which at most `most` (or one row's) are held at once."""
    step = max(1, most // max(1, len(matrix)))
    for lo in range(0, len(q), step):
        yield from q[lo : lo + step] @ matrix.T


def _best(row: np.ndarray, k: int, vote: float) -> np.ndarray:
    """Places of the k greatest values of at least `vote`, in order; ties by place."""
    at = np.flatnonzero(row >= vote)
    if len(at) > k:
        at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-row[at], kind="stable")[:k]]


def nearest_category(queries: DataFrame, corpus: DataFrame, key: str, k: int = E.NEIGHBOURS, vote: float = E.VOTE, accept: float = E.ACCEPT, most: int = E.CORPUS_ROWS) -> DataFrame:
    """(key, category, confidence) of each row of `queries` (key, embedding): the label with the greatest summed cosine among its k
    nearest corpus entries of at least `vote` (ties: the first label); null below a mean of `accept`. The corpus, at most
    `most` entries by its eviction, goes to the tasks; the queries are scanned once. A larger corpus raises."""
    entries = corpus.select("id", "category", "embedding").orderBy("id").limit(most + 1).select("category", "embedding").toArrow()
    if entries.num_rows > most:
        raise ValueError(f"evict the corpus to {most} entries first")
    names = entries["category"].combine_chunks().dictionary_encode()
    labels = names.dictionary.to_pylist()
    codes, matrix = names.indices.to_numpy(zero_copy_only=False), _matrix(entries["embedding"].combine_chunks())
    del entries, names
    sent = queries.sparkSession.sparkContext.broadcast((labels, codes, matrix))
    kind = dict(queries.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, codes, matrix = sent.value
        for b in batches:
            q = _matrix(b["embedding"])
            found: list[str | None] = []
            sure: list[float | None] = []
            for row in _similarities(q, matrix):
                by: dict[str, list[float]] = {}
                for i in _best(row, k, vote):
                    by.setdefault(labels[codes[i]], []).append(float(row[i]))
                best = min(by, key=lambda x: (-sum(by[x]), x), default=None)
                mean = sum(by[best]) / len(by[best]) if best is not None else None
                found.append(best if mean is not None and mean >= accept else None)
                sure.append(mean)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[key, "category", "confidence"])

    return queries.filter("embedding is not null").select(key, "embedding").mapInArrow(run, f"{key} {kind}, category string, confidence double")


def content_hash(name: Column, description: Column, columns: Sequence[str]) -> Column:
    """Key of the classifier's cache: lower-case stripped name, stripped description, sorted columns."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.substring(F.sha2(F.to_json(F.struct(F.lower(strip(name)).alias("name"), strip(description).alias("desc"), F.array(*[F.lit(c) for c in sorted(columns)]).alias("cols"))), 256), 1, 16)


def prompt(text: Column, neighbours: Column, categories: Sequence[str]) -> Column:
    """Text for a classifier: the product, its labelled neighbours (an array of texts, may be empty) and the allowed categories."""
    like = F.when(F.size(neighbours) > 0, F.concat(F.lit("\nSimilar products:\n"), F.array_join(F.transform(neighbours, lambda n: F.concat(F.lit("- "), n)), "\n"))).otherwise("")
    return F.concat(F.lit("Product: "), F.coalesce(text, F.lit("")), like, F.lit("\nAnswer with one of: " + ", ".join(categories)))


@dataclass(frozen=True)
class Enriched:
    """Rows with their tier, the corpus and the classifier's cache as they are afterwards, and the numbers of the run."""

    rows: DataFrame
    corpus: DataFrame
    cache: DataFrame
    stats: dict[str, int]


def enrich(
    df: DataFrame, key: str, as_of: str, corpus: DataFrame | None = None, cache: DataFrame | None = None, rules: Sequence[E.Rule] = E.FOOD_RULES,
    encode: Callable = hashed_vectors, classifier: Callable[[list[str]], list[str | None]] | None = None, least_corpus: int = LEAST_CORPUS,
) -> Enriched:
    """Rows of `df` (unique `key`) with the fields of the rules, `primary_category` from three tiers, `tier` (given, rules, neighbours, cache,
    classifier, null if none) and `enriched_by_llm` (the third tier's rows).

    The corpus loses what is too old or too much, takes in the rows of the rules if it has less than a quarter as many entries as
    rows lack a category, and is searched if it has `least_corpus`; what is found joins it. The classifier is asked once for
    each content; its answers are cached. Safety fields are taken from the rules' rows alone. No rows give no rows."""
    spark = df.sparkSession
    had = F.col(CATEGORY).isNotNull() if CATEGORY in df.columns else F.lit(False)
    one = cut(E.apply_rules(df.withColumn("_had", had), rules).withColumn("tier", F.when(F.col("_had"), "given").when(F.col(CATEGORY).isNotNull(), "rules")).drop("_had"))
    counts = one.agg(F.count_if(F.col("tier") == "rules").alias("rules"), F.count_if(F.col(CATEGORY).isNull()).alias("open")).first()
    corpus = E.evict_corpus(corpus if corpus is not None else spark.createDataFrame([], CORPUS), as_of)
    size, added = corpus.count(), 0
    if counts["open"] and size < AUGMENT_BELOW * counts["open"]:
        corpus = cut(E.evict_corpus(E.upsert_corpus(corpus, corpus_rows(one, as_of, encode)), as_of))
        added, size = corpus.count() - size, corpus.count()
    found = None
    if counts["open"] and size >= least_corpus:
        asked = encode(one.filter(F.col(CATEGORY).isNull()).select(key, E.query_text(one).alias("_text")), "_text")
        found = cut(nearest_category(asked, corpus, key).filter("category is not null").select(key, F.col("category").alias("_near")))
        one = cut(one.join(found, key, "left").withColumns({"tier": F.when(F.col(CATEGORY).isNull() & F.col("_near").isNotNull(), "neighbours").otherwise(F.col("tier")), CATEGORY: F.coalesce(CATEGORY, "_near")}).drop("_near"))
        corpus = cut(E.evict_corpus(E.upsert_corpus(corpus, corpus_rows(one.filter("tier = 'neighbours'"), as_of, encode)), as_of))
    cache = cache if cache is not None else spark.createDataFrame([], "content string, category string")
    text = F.coalesce("ingredients", F.lit("")) if "ingredients" in one.columns else F.lit("")
    hashed = one.withColumn("_content", F.when(F.col(CATEGORY).isNull(), content_hash(F.col("product_name"), text, [CATEGORY])))
    kept = cache.groupBy("content").agg(F.max("category").alias("_kept"))
    if classifier is not None:
        asked = hashed.filter("_content is not null").groupBy("_content").agg(F.min(E.query_text(one)).alias("_q")).join(kept.select(F.col("content").alias("_content")), "_content", "left_anti")
        new = cut(E.classify(asked, "_content", F.col("_q"), classifier, "category").filter("category is not null"))
    else:
        new = spark.createDataFrame([], "_content string, category string")
    answers = kept.select(F.col("content").alias("_content"), F.col("_kept").alias("_answer"), F.lit("cache").alias("_by")).union(new.select("_content", "category", F.lit("classifier")))
    last = hashed.join(answers, "_content", "left").withColumns({"tier": F.coalesce("tier", F.when(F.col("_answer").isNotNull(), F.col("_by"))), CATEGORY: F.coalesce(CATEGORY, "_answer")})
    last = cut(last.withColumn("enriched_by_llm", F.coalesce(F.col("tier").isin("cache", "classifier"), F.lit(False))).drop("_content", "_answer", "_by"))
    n = {r["tier"]: r["n"] for r in last.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    check_safety(one, last, key)
    stats = {"deterministic": counts["rules"], "embedding": n.get("neighbours", 0), "llm": n.get("cache", 0) + n.get("classifier", 0), "unresolved": n.get(None, 0), "corpus_augmented": added, "corpus_size_after": corpus.count()}
    return Enriched(last, corpus, cache.unionByName(new.withColumnRenamed("_content", "content")), stats)


def check_safety(before: DataFrame, after: DataFrame, key: str) -> None:
    """Raise if a row of the third tier has other safety fields than the rules gave it."""
    fields = [c for c in SAFETY if c in before.columns]
    if not fields:
        return
    was = before.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    other = F.lit(False)
    for c in fields:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = after.filter("enriched_by_llm").join(was, key).filter(other).limit(1).count()
    if wrong:
        raise AssertionError("safety fields were changed after the rules")
