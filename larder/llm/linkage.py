"""Matching entities across sources without keys: recall notices and catalogue products, by probabilistic record linkage.

Notices are read like listings: coined names, kind, flavours (each named flavour is a notice of its own), variant, net
content and firm. Candidate pairs with the catalogue's merged products come from several blocking passes. Each pair is a
pattern of agreement levels (agrees, one side says nothing, disagrees) on the attributes. A notice names one product or
none, so expectation-maximisation shares each notice's belief among its candidates and "none of them": what tells the one
candidate from the others of its line, such as the flavour, gains weight, and what all candidates of a block have in common
loses it. The posterior of a pair is its confidence, and it alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm import listing, matching
from larder.session import cut

COMPARED = ("line", "brand", "firm", "kind", "flavour", "variant", "content")
AGREE, SILENT, DIFFER = 2, 1, 0
#: What makes a product the same one, by definition, and the rate at which it is misread. A notice and its product differ in it no
#: more often; how often they differ in the rest, and are silent, is learned, as is all about non-matches.
DEFINING, MISREAD = ("line", "kind", "flavour", "variant", "content"), 0.003
def read_notices(recalls: DataFrame, words: listing.Vocabulary) -> DataFrame:
    """(notice, recall_number, names, firms, kind, flavour, variant, content): one row per notice text and named flavour."""

    sent = recalls.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = listing.Reader(sent.value)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for number, text, firm in zip(*(b[c].to_pylist() for c in ("recall_number", "product_description", "recalling_firm"))):
                p = reader.read(text)
                for flavour in p.flavours or [None]:
                    values = (number, p.names, reader.coined(firm), p.kind, flavour, sent.value.plain if p.variant is None else p.variant, p.content)
                    for to, v in zip(out, values):
                        to.append(v)
            types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["recall_number", "names", "firms", "kind", "flavour", "variant", "content"])

    rows = recalls.filter("product_description is not null and recall_number is not null").select("recall_number", "product_description", "recalling_firm").distinct()
    rows = rows.mapInArrow(run, "recall_number string, names array<string>, firms array<string>, kind int, flavour long, variant int, content long")
    return rows.withColumn("notice", F.xxhash64("recall_number", "names", "firms", "kind", "flavour", "variant", "content"))


def name_notices(notices: DataFrame, roles: DataFrame) -> DataFrame:
    """`notices` with line, brand and firm as the catalogue's codes. A notice with coined names of which the catalogue knows no
    line gets the line -1, which agrees with none; without any coined name the line is null."""
    known = roles.filter("n > 0").select("token", "code", "is_brand", "is_firm")
    said = notices.select("notice", F.explode("names").alias("token")).join(known, "token")
    code = F.col("code")
    by = said.groupBy("notice").agg(
        F.min(F.when(~F.col("is_brand"), code)).alias("line"), F.min(F.when(~F.col("is_firm"), code)).alias("other"), F.max(F.when(F.col("is_brand"), code)).alias("brand"), F.count_distinct("token").alias("_known"),
    )
    firm = notices.select("notice", F.try_element_at("firms", F.lit(1)).alias("token")).join(known, "token").groupBy("notice").agg(F.min("code").alias("firm"))
    strange = F.size(F.array_distinct("names")) > F.coalesce("_known", F.lit(0))
    line = F.coalesce("line", F.when(F.col("other") != F.col("brand"), F.col("other")), F.when(strange, F.lit(-1).cast("long")))
    out = notices.dropDuplicates(["notice"]).join(by, "notice", "left").join(firm, "notice", "left")
    return out.select("recall_number", "notice", line.alias("line"), "brand", F.coalesce("firm", F.when(F.size("firms") > 0, F.lit(-1).cast("long"))).alias("firm"), "kind", "flavour", "variant", "content")


def _level(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), SILENT).when(a == b, AGREE).otherwise(DIFFER)


def estimate(notice: np.ndarray, levels: np.ndarray, rounds: int = 500, tolerance: float = 1e-4, pairs: np.ndarray | None = None, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, prior) from candidate pairs, given by the notice of each and its levels: log of match over non-match probability of
    each attribute and level, and the prior odds of a candidate against "none of them". An entry may stand for several `pairs` of
    one notice, and a notice for several alike (`times`, equal for all entries of a notice).

    All combinations of a line's flavours, variants and contents are products, so chance agreement cannot be told from a match by
    counts alone: for the attributes that define a product the probability of a match to differ is MISREAD. One pair of each
    level is added on either side, so that no probability is zero. Without pairs the weights are those of the start."""
    k = len(COMPARED)
    m, u = np.tile([MISREAD, 0.2, 0.8 - MISREAD], (k, 1)), np.tile([0.4, 0.2, 0.4], (k, 1))
    prior = 0.5
    if len(levels):
        _, of = np.unique(notice, return_inverse=True)
        pairs, times = (np.ones(len(levels)) if x is None else x.astype(float) for x in (pairs, times))
        notices = (np.bincount(of, times) / np.bincount(of)).sum()
        # Pairs of one pattern have one weight: all but the sums per notice is done for patterns.
        patterns, pattern = np.unique(levels, axis=0, return_inverse=True)
        pattern = pattern.ravel()
        count = np.bincount(pattern, pairs * times)
        hot = np.stack([patterns == v for v in (DIFFER, SILENT, AGREE)], 2).astype(float)
        shares = lambda n: (c := np.einsum("p,pkv->kv", n, hot) + 1) / c.sum(1, keepdims=True)
        u = shares(count)
        last = None
        for _ in range(rounds):
            w = (np.exp(np.clip(np.log(m / u)[np.arange(k), patterns].sum(1), -60, 60)) * prior)[pattern]
            g = w / (np.bincount(of, w * pairs)[of] + 1 - prior)
            if last is not None and np.abs(g - last).max() < tolerance:
                break
            last = g
            prior = float(np.clip((g * pairs * times).sum() / notices, 0.01, 0.99))
            matched = np.bincount(pattern, g * pairs * times, len(patterns))
            m, u = shares(matched), shares(count - matched)
            for i in (i for i in range(k) if COMPARED[i] in DEFINING):
                m[i, 1:] *= (1 - MISREAD) / m[i, 1:].sum()
                m[i, DIFFER] = MISREAD
    return np.log(m / u), prior


def linked(recalls: DataFrame, catalogue: DataFrame, most_sent: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recall_number, product, level_<attribute>, confidence) for every candidate pair of a notice and a product, and the
    catalogue's rows and readings, from which `matching.members` gives the listings. The probabilities are fitted on the pairs
    of all notices: those with as many pairs of each pattern of levels are one entry with their number."""
    words = matching.vocabulary(catalogue, recalls)
    rows = cut(matching.read_listings(catalogue, words))
    notices = cut(read_notices(recalls, words))
    said, roles = matching.name_roles(rows, notices.select(F.explode(F.array_union("names", "firms")).alias("token")).distinct())
    readings, profiles = matching.merged(rows, said, roles)
    # Listings of unclear net content are no product that a notice can name, so they are left out here.
    # One exchange by line serves the merging of profiles and the counting of a family's net contents.
    family = ["line", "kind", "flavour", "variant"]
    products = profiles.filter("product is not null").repartition("line").groupBy("product", *family, "content").agg(F.min("brand").alias("brand"))
    # The firm of a product is the brand code of its brand, which firms share.
    products = cut(products.withColumn("firm", F.col("brand")).withColumn("sizes", F.count("content").over(W.partitionBy(*family))))
    notices = cut(name_notices(notices, roles), notices)
    # Few notices go to the products; many meet them by key.
    sent = F.broadcast if notices.count() <= most_sent else (lambda d: d)
    a, b = sent(notices).alias("a"), products.alias("b")
    owner = sent(notices.select("*", F.explode(F.array_distinct(F.array_compact(F.array("brand", "firm")))).alias("owner"))).alias("a")
    passes = [
        b.join(a, (F.col("a.line") == F.col("b.line"))),
        b.join(owner, (F.col("a.owner") == F.col("b.brand")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.flavour") == F.col("b.flavour"))),
    ]
    levels = {c: _level(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in COMPARED}
    # Where one side leaves the net content open and the family has but one, that one is meant.
    levels["content"] = F.when((levels["content"] == SILENT) & (F.col("b.sizes") <= 1), AGREE).otherwise(levels["content"])
    columns = [f"level_{c}" for c in COMPARED]
    pairs = None
    for p in passes:
        part = p.select("a.recall_number", "a.notice", "b.product", *[v.alias(f"level_{c}") for c, v in levels.items()])
        pairs = part if pairs is None else pairs.union(part)
    pairs = cut(pairs.distinct())
    per = pairs.groupBy("notice", *columns).agg(F.count(F.lit(1)).alias("pairs"))
    alike = per.groupBy("notice").agg(F.sort_array(F.collect_list(F.struct(*columns, "pairs"))).alias("said")).groupBy("said").agg(F.count(F.lit(1)).alias("times"))
    fitted = alike.select(F.xxhash64("said").alias("alike"), "times", F.explode("said").alias("s")).select("alike", "times", "s.*").toArrow()
    table = np.stack([fitted[c].to_numpy() for c in columns], 1) if fitted.num_rows else np.empty((0, len(columns)), int)
    weights, prior = estimate(fitted["alike"].to_numpy(), table, pairs=fitted["pairs"].to_numpy(), times=fitted["times"].to_numpy())
    log = sum((F.get(F.array(*[F.lit(float(x)) for x in weights[i]]), F.col(c)) for i, c in enumerate(columns)), F.lit(0.0))
    scored = pairs.withColumn("_w", F.exp(F.least(F.greatest(log, F.lit(-60.0)), F.lit(60.0))))
    whole = scored.groupBy("notice").agg(F.sum("_w").alias("_s"))
    scored = scored.join(whole, "notice").withColumn("confidence", F.col("_w") * prior / (F.col("_s") * prior + (1 - prior)))
    best = scored.groupBy("recall_number", "product").agg(F.max_by(F.struct(*columns, "confidence"), F.struct("confidence", *columns)).alias("b"))
    return best.select("recall_number", "product", "b.*"), rows, readings


def found(recalls: DataFrame, catalogue: DataFrame, least: float = 0.5, most_sent: int = 50_000) -> DataFrame:
    """Listings of products that a notice names with a confidence above `least`."""
    pairs, rows, readings = linked(recalls, catalogue)
    sure = cut(pairs.filter(F.col("confidence") > least).select("recall_number", "product").distinct())
    # Only readings of linked products look for their listings; up to `most_sent` of them go to the rows.
    linked_readings = cut(readings.join(sure.select("product").distinct(), "product", "left_semi"))
    sent = F.broadcast(linked_readings) if linked_readings.count() <= most_sent else linked_readings
    return matching.members(rows, sent).join(sure, "product").select("recall_number", "record_id").distinct()


def confidences(recalls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every candidate pair of a notice and a product with its agreement levels and confidence."""
    return linked(recalls, catalogue)[0]
