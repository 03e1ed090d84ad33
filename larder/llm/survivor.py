"""Best representative of each duplicate group, field by field, by iterative truth discovery.

Every member with a real value votes, with the reliability of its source as weight, for each value of its cluster and
field that is not worse than its own in age, in trust and in length. The support of a value is the mean of its three
weighted vote shares. The reliability of a source is the smoothed mean support of its values over all clusters; support
and reliability are estimated in turn until no reliability moves by more than the tolerance. The value with the highest
support survives (ties: the weight of members with the same text, then the lowest member id).

A value that is nowhere worse and somewhere better than all others has full support, which no other value reaches,
whatever the weights. Votes are running sums over one sort of the cluster, so a cluster of any size is neither collected
nor paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.session import cut

FIELDS = ("product_name", "brand_name", "ingredients", "food_category")
# Words that stand for a missing value.
MISSING = (
    "", "-", "--", "---", "?", "??", ".", "n/a", "n.a.", "na", "nan", "nil", "null", "none", "none given", "not given", "not available", "not applicable", "not specified",
    "unspecified", "unknown", "undefined", "missing", "no data", "tbd", "tba", "to be determined", "empty", "blank", "(null)", "<null>", "xxx",
)
_MEMBER = "member_id bigint, data_source string, product_name string, brand_name string, ingredients string, food_category string, published_date string"
_KEY = ("run_id", "cluster_id", "field_name")


def is_real(c: Column) -> Column:
    """Not null, blank or a word for "missing"."""
    return c.isNotNull() & ~F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).isin(*MISSING)


def calendar_day(c: Column) -> Column:
    """Day of a date in one of several notations: ISO with or without time, yyyyMMdd, epoch seconds or milliseconds, d MMM yyyy,
    d.M.yyyy, yyyy/M/d; null if unreadable."""
    t = F.trim(c)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1).try_cast("date")
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("bigint"))).when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("bigint"))).cast("date")
    name = F.initcap(F.regexp_replace(t, r"[.,]", ""))
    words = F.when(name.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(name, "d MMM yyyy")).when(name.rlike(r"^\d{1,2} [A-Za-z]{4,} \d{4}$"), F.try_to_date(name, "d MMMM yyyy"))
    words = F.coalesce(words, F.when(name.rlike(r"^[A-Za-z]{3} \d{1,2} \d{4}$"), F.try_to_date(name, "MMM d yyyy")))
    other = F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy")).when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "yyyy/M/d"))
    return F.coalesce(iso, compact, epoch, words, other)


def candidates(clusters: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per cluster, field and member with a real value: value, day, rank (0 = most trusted), length, source.

    Of a cluster written twice (same run_id and cluster_id) the row with the highest id counts. An unreadable `members` gives
    no rows; a member without id is left out; a source that is not in `trust` is the least trusted."""
    last = clusters.groupBy("run_id", "cluster_id").agg(F.max_by("members", "id").alias("members"))
    m = last.select("run_id", "cluster_id", F.explode(F.from_json("members", f"array<struct<{_MEMBER.replace(' bigint', ':bigint').replace(' string', ':string')}>>")).alias("m")).select("run_id", "cluster_id", "m.*")
    m = m.filter("member_id is not null").withColumn("source", F.lower(F.trim(F.coalesce("data_source", F.lit("")))))
    ranks = trust.groupBy(F.lower(F.trim("data_source")).alias("source")).agg(F.min("trust_rank").alias("trust_rank"))
    m = m.join(ranks, "source", "left").withColumn("trust_rank", F.coalesce("trust_rank", F.lit(2**31 - 1)))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS])
    day = F.coalesce(F.datediff(calendar_day(F.col("published_date")), F.lit("1970-01-01").cast("date")), F.lit(-(2**31) + 1))
    return (
        m.select("run_id", "cluster_id", "member_id", "source", "trust_rank", day.alias("day"), F.explode(fields).alias("f"))
        .select("run_id", "cluster_id", F.col("f.field_name").alias("field_name"), "member_id", F.col("f.value").alias("value"), "source", "trust_rank", "day")
        .filter(is_real(F.col("value")))
        .withColumn("length", F.length(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")))
        .dropDuplicates(["run_id", "cluster_id", "field_name", "member_id"])
    )


def _supported(rows: DataFrame, reliability: DataFrame) -> DataFrame:
    """`rows` with the vote weight and the support of each value."""
    w = rows.join(reliability, "source").withColumn("weight", F.col("reliability"))
    whole = F.sum("weight").over(W.partitionBy(*_KEY))

    def share(order: Column) -> Column:
        return F.sum("weight").over(W.partitionBy(*_KEY).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)) / whole

    return w.withColumn("support", (share(F.col("day").asc()) + share(F.col("trust_rank").desc()) + share(F.col("length").asc())) / 3)


def discover(rows: DataFrame, rounds: int = 8, tolerance: float = 0.005) -> DataFrame:
    """Truth discovery over `candidates`: the rows with `weight`, `support` and `chosen`.

    The prior of a source falls with its trust rank; its reliability is the mean support of its values, with the prior as
    `smooth` further values. At most `rounds` rounds are made. No rows give no rows."""
    smooth = 10.0
    rows = cut(rows)
    prior = cut(rows.groupBy("source").agg(F.min("trust_rank").alias("r")).select("source", (1 / (1 + F.least(F.col("r"), F.lit(20)) / 10.0)).alias("prior")))
    reliability = prior.select("source", F.col("prior").alias("reliability"))
    for _ in range(rounds):
        new = _supported(rows, reliability).groupBy("source").agg(F.sum("support").alias("s"), F.count(F.lit(1)).alias("n"))
        new = cut(new.join(prior, "source").select("source", ((F.col("s") + smooth * F.col("prior")) / (F.col("n") + smooth)).alias("reliability")))
        moved = new.join(reliability.withColumnRenamed("reliability", "was"), "source").agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
        reliability = new
        if (moved or 0) <= tolerance:
            break
    done = _supported(rows, reliability).withColumn("agree", F.sum("weight").over(W.partitionBy(*_KEY, F.lower(F.trim("value")))))
    best = W.partitionBy(*_KEY).orderBy(F.round("support", 9).desc(), F.round("agree", 9).desc(), "member_id")
    return done.withColumn("chosen", F.row_number().over(best) == 1)


def survivors(clusters: DataFrame, trust: DataFrame) -> DataFrame:
    """One surviving record per cluster with a real value in some field: each field's value and `<field>_from`, the member it
    comes from; null where no member has a real value."""
    best = discover(candidates(clusters, trust)).filter("chosen")
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return best.groupBy("run_id", "cluster_id").agg(*[x for f in FIELDS for x in (of(f, "value").alias(f), of(f, "member_id").alias(f"{f}_from"))])


def found(clusters: DataFrame, trust: DataFrame) -> DataFrame:
    """Discovered values that are beyond doubt: no other member's value is newer, more trusted or longer, and none equals the
    chosen one in all three."""
    k = W.partitionBy(*_KEY)
    same = F.sum(F.when((F.col("day") == F.col("_d")) & (F.col("trust_rank") == F.col("_r")) & (F.col("length") == F.col("_l")), 1).otherwise(0)).over(k)
    d = discover(candidates(clusters, trust)).withColumns({"_d": F.max("day").over(k), "_r": F.min("trust_rank").over(k), "_l": F.max("length").over(k)})
    d = d.withColumn("_same", same).filter(F.col("chosen") & (F.col("_same") == 1) & (F.col("day") == F.col("_d")) & (F.col("trust_rank") == F.col("_r")) & (F.col("length") == F.col("_l")))
    return d.select(*_KEY, "member_id")
