"""Listings of the same product, by generic merge resolution on profiles.

Every listing is read into a profile: brand, product line, kind of food, flavour, variant, net content and number of units,
some of them unknown. Equal profiles are one from the start, so copies of any number cost nothing. Matched profiles merge:
an unknown attribute takes the value of the profiles it is blocked with if they all agree on one. The richer profiles are
blocked and matched again, until no profile changes. Profiles with all attributes equal are one product.

The words of names are read with a vocabulary that is learned from the catalogue (`vocabulary`, `listing.learn`).

Coined names (brands, lines) are first brought to one spelling: a name, rare by itself or beside the other, that one typing
slip (a letter lost, doubled, added or two swapped) turns into a more frequent one is taken as that. Candidates for this
share a form with one letter left out, so nothing is compared pair by pair. A name is a brand if it mostly stands among the
firm names of its listings, or among their brand names for several kinds of food or many listings, else a product line.

All attributes are numbers (codes of the vocabulary, numbers of coined names), so that the many small aggregations run on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm import listing
from larder.session import cut, drop_cut

ATTRIBUTES = ["brand", "line", "kind", "flavour", "variant", "content"]
_SAID = ["kind", "flavour", "variant", "content"]
_ROWS = "record_id long, copy long, said string, kind int, flavour long, variant int, content long"


def vocabulary(df: DataFrame, notices: DataFrame | None = None, part: int = 20_000) -> listing.Vocabulary:
    """Vocabulary of a catalogue, counted over all its listings and all notices; only counts of common words and of phrases that
    stand in enough listings come to the driver. The lines of a listing are known by the one word of a name that is neither common
    nor in the listing's firm and brand names; copies in a line count once. A line of more than `part` listings counts as several.
    Words that only notices make common have no meaning: what the catalogue's words mean doesn't depend on notices."""
    columns = ["product_name", "brand_name", "brand_owner"]
    named = df.filter("product_name is not null")
    common, house, usual, told = _common_words(named.select(*columns), notices)
    words = listing.learned_words(common, house)
    sent = df.sparkSession.sparkContext.broadcast((frozenset(common), {w: i for i, w in enumerate(words)}))
    rows = cut(named.select(*columns, "ingredients", F.xxhash64(*columns, "ingredients").alias("copy")).mapInArrow(lambda x: _line_rows(x, *sent.value), "line string, copy long, tokens array<int>, items array<long>").withColumn("line", F.xxhash64("line")))
    v, total = max(len(words), 1), rows.count()
    few = rows.select("tokens").mapInArrow(lambda x: _sequence_rows(x, v), "n int, code long, listings long").groupBy("n", "code").agg(F.sum("listings").alias("listings"))
    one, two, three = {}, {}, {}
    for n, code, count in few.filter(F.col("listings") >= max(listing.LEAST, listing.LEAST_SHARE * total)).toLocalIterator():
        (one, two, three)[n - 1][code] = count
    known = listing.known_phrases(total, one, two, three, v)
    ids = listing.numbered(words, one, known, total)
    parsed = rows.mapInArrow(lambda x: _phrase_rows(x, known, ids), "line long, copy long, phrases array<int>, items array<long>")
    lines = cut(parsed.repartition("line").sortWithinPartitions("line", "copy").mapInArrow(lambda x: _whole_lines(x, part), "lengths array<int>, phrases array<int>, item_lengths array<int>, items array<long>"), rows)
    sums, size = listing.LineSums(len(ids)), max(len(ids), 1)
    added = lines.select("lengths", "phrases").mapInArrow(lambda x: _sum_rows(x, len(ids)), "code long, both double, meet double")
    for code, both, meet in added.groupBy("code").agg(F.sum("both").alias("both"), F.sum("meet").alias("meet")).toLocalIterator():
        if code >= 0:
            sums.both[code // size, code % size], sums.meet[code // size, code % size] = both, meet
        elif code == -1:
            sums.total = int(both)
        else:
            sums.own[-2 - code] = meet
    names = [tuple(words[w] for w in p) for p in ids]
    concepts = listing.concepts_of(names, sums)
    of = listing.concept_of(concepts, len(ids))
    items = lines.mapInArrow(lambda x: _item_rows(x, of), "concept int, item long, listings long").groupBy("concept", "item").agg(F.sum("listings").alias("listings"))
    # An ingredient that shows a concept is in SHOWS of its listings at least, so rarer ones need not come to the driver.
    items = items.withColumn("_told", F.max(F.when(F.col("item") == 0, F.col("listings"))).over(W.partitionBy("concept")))
    shown = items.filter((F.col("concept") >= 0) & (F.col("listings") >= F.col("_told") * listing.SHOWS) & (F.col("item") != 0)).select("item").distinct()
    items = items.join(F.broadcast(shown), "item", "left_semi").unionByName(items.filter("item = 0"))
    roles = listing.roles_of(concepts, ((r.concept, r.item, r.listings) for r in items.filter(F.col("concept").isin(-1) | (F.col("listings") >= F.col("_told") * listing.SHOWS)).collect()))
    variant = listing.concept_of(concepts, len(ids), [r == "variant" for r in roles])
    rates = lines.select("lengths", "phrases").mapInArrow(lambda x: _unnamed_rows(x, variant), "concept int, rate double").groupBy("concept").agg(F.sum("rate").alias("rate")).collect()
    unnamed = dict.fromkeys(range(len(concepts)), 0.0) | {r.concept: r.rate for r in rates}
    drop_cut(lines)
    return listing.assemble(names, concepts, roles, unnamed, common | house | told, usual)


def _common_words(rows: DataFrame, notices: DataFrame | None) -> tuple[set[str], set[str], dict[str, list[float]], set[str]]:
    """Common words of the catalogue, those of brands, usual amounts, and common words of the notices, each word counted with all firms."""
    counts = "what string, word string, firm string, listings long, beside long"
    total, said = rows.count(), 0
    counted = rows.mapInArrow(lambda x: _count_rows(x, False), counts)
    if notices is not None:
        notices = notices.filter("product_description is not null").select("product_description", F.lit(None).cast("string").alias("brand"), "recalling_firm")
        said = notices.count()
        counted = counted.unionByName(notices.mapInArrow(lambda x: _count_rows(x, True), counts))
    # Words of notices meet those of names: one that a firm of the catalogue names its own is not common because others recall it.
    said_by, listed = F.col("what") == "t", F.col("what").isin("n", "t")
    by = counted.groupBy(F.when(listed, "n").otherwise(F.col("what")).alias("what"), "word", F.xxhash64("firm").alias("firm")).agg(F.sum(F.when(said_by, 0).otherwise(F.col("listings"))).alias("n"), F.sum(F.when(said_by, F.col("listings")).otherwise(0)).alias("t"), F.sum("beside").alias("beside"))
    square = lambda c: F.sum(c.cast("double") * c)
    by = by.groupBy("what", "word").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("beside").alias("beside"), square(F.col("n")).alias("n2"), square(F.col("t")).alias("t2"), square(F.col("n") + F.col("t")).alias("both2"), F.count(F.lit(1)).alias("firms")
    )
    firms = lambda n, squares: (n > 0) & (n.cast("double") * n >= listing.FIRMS * F.col(squares))
    named = firms(F.col("n"), "n2") & (F.col("n") >= listing.COMMON_SHARE * total)
    told = firms(F.col("t"), "t2") & firms(F.col("n") + F.col("t"), "both2") & (F.col("t") >= listing.COMMON_SHARE * said)
    by = by.select("*", F.when(F.col("what") == "u", F.col("firms") >= max(3.0, listing.USUAL_SHARE * total)).otherwise(named).alias("named"), told.alias("told"))
    kept = by.filter("named or told").collect()
    common, house = listing.common_of((r.what, r.word, r.n, r.beside) for r in kept if r.what != "u" and r.named)
    return common, house, listing.usual_of(r.word for r in kept if r.what == "u"), {r.word for r in kept if r.told}


def _count_rows(batches: Iterator[pa.RecordBatch], notices: bool, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows, up to `most` rows together."""
    counter, rows = listing.WordCounter(notices), 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(3))):
            counter.add(*row)
        rows += b.num_rows
        if rows >= most:
            yield _counted(counter)
            counter, rows = listing.WordCounter(notices), 0
    yield _counted(counter)


def _counted(counter: listing.WordCounter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(counter.columns()), names=["what", "word", "firm", "listings", "beside"])


def _line_rows(batches: Iterator[pa.RecordBatch], common: frozenset[str], number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], []]
        for name, brand, owner, text, copy in zip(*(b[c].to_pylist() for c in ("product_name", "brand_name", "brand_owner", "ingredients", "copy"))):
            got = listing.line_tokens(name, {*listing.firm_words(brand), *listing.firm_words(owner)}, common, number)
            if got:
                for to, x in zip(out, (got[0], copy, got[1], listing.items_of(text))):
                    to.append(x)
        types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=["line", "copy", "tokens", "items"])


def _sequence_rows(batches: Iterator[pa.RecordBatch], v: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = b["tokens"]
        x, row = t.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(t)), t.value_lengths().to_numpy())
        codes, fine = x, x >= 0
        for n in (1, 2, 3):
            if n > 1:
                same = row[n - 1 :] == row[: 1 - n]
                codes, fine = codes[: len(same)] * v + x[n - 1 :], fine[: len(same)] & (x[n - 1 :] >= 0) & same
            r, c = row[: len(codes)][fine], codes[fine]
            order = np.lexsort((r, c))
            r, c = r[order], c[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])  # each listing once
            c, count = np.unique(c[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), pa.array(c), pa.array(count.astype(np.int64))], names=["n", "code", "listings"])


def _phrase_rows(batches: Iterator[pa.RecordBatch], known: set[tuple[int, ...]], ids: dict[tuple[int, ...], int]) -> Iterator[pa.RecordBatch]:
    numbers = listing.PhraseNumbers(known, ids)
    for b in batches:
        phrases = [numbers.of(t) for t in b["tokens"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["line"], b["copy"], pa.array(phrases, pa.list_(pa.int32())), b["items"]], names=["line", "copy", "phrases", "items"])


def _whole_lines(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """One row for each line of two listings at least, from rows in order of lines and copies."""
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    line, copy, held = None, None, [[], [], [], []]
    for b in batches:
        out: list[list] = [[], [], [], []]
        for at, c, p, i in zip(*(b[x].to_pylist() for x in ("line", "copy", "phrases", "items"))):
            if at == line and c == copy:
                continue
            if at != line or len(held[0]) >= part:
                if len(held[0]) > 1:
                    for to, x in zip(out, held):
                        to.append(x)
                line, held = at, [[], [], [], []]
            copy = c
            held[0].append(len(p))
            held[1].extend(p)
            held[2].append(len(i))
            held[3].extend(i)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.list_(t)) for o, t in zip(out, types)], names=["lengths", "phrases", "item_lengths", "items"])
    if len(held[0]) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(t)) for x, t in zip(held, types)], names=["lengths", "phrases", "item_lengths", "items"])


def _sum_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    sums = listing.LineSums(n)
    for b in batches:
        sums.add_lines(b["lengths"].value_lengths().to_numpy(), b["lengths"].flatten().to_numpy(), b["phrases"].flatten().to_numpy())
    p, q = np.nonzero(sums.both + sums.meet)
    code = np.concatenate([p * max(n, 1) + q, [-1], -2 - np.arange(n)]).astype(np.int64)
    both, meet = np.concatenate([sums.both[p, q], [sums.total], np.zeros(n)]), np.concatenate([sums.meet[p, q], [0], sums.own])
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(both), pa.array(meet)], names=["code", "both", "meet"])


def _item_rows(batches: Iterator[pa.RecordBatch], of: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k, item, n = listing.item_counts(of, *(b[c].flatten().to_numpy() for c in ("lengths", "phrases", "item_lengths", "items")))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(item.astype(np.int64)), pa.array(n.astype(np.int64))], names=["concept", "item", "listings"])


def _unnamed_rows(batches: Iterator[pa.RecordBatch], variant: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(variant.max(initial=-1) + 1)
    for b in batches:
        total += listing.unnamed_rates(variant, b["lengths"].flatten().to_numpy(), b["phrases"].flatten().to_numpy(), b["lengths"].value_lengths().to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["concept", "rate"])


def read_listings(df: DataFrame, words: listing.Vocabulary) -> DataFrame:
    """Attributes of every listing with a product name that is not null (a blank one says nothing). `said` has the coined names
    of the product and brand names in order, each with 1 added if it is in the brand name and 2 if in the firm's."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = listing.Reader(sent.value)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for name, brand, owner in zip(b["product_name"].to_pylist(), b["brand_name"].to_pylist(), b["brand_owner"].to_pylist()):
                p = reader.read(name)
                brands, owners = reader.coined(brand), reader.coined(owner)
                said = " ".join(f"{n}{(n in brands) + 2 * (n in owners)}" for n in sorted({*p.names, *brands}))
                values = (said, p.kind, listing.flavour_code(p.flavours), words_plain if p.variant is None else p.variant, p.content)
                for to, v in zip(out, values):
                    to.append(v)
            types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b["record_id"], b["copy"], *(pa.array(o, t) for o, t in zip(out, types))], names=["record_id", "copy", "said", *_SAID])

    words_plain = words.plain
    rows = df.filter("product_name is not null").select("record_id", F.xxhash64("product_name", "brand_name", "brand_owner").alias("copy"), "product_name", "brand_name", "brand_owner")
    return rows.mapInArrow(run, _ROWS)


def one_letter_less(token: Column, side: str) -> Column:
    """Hashes of the forms of a token with one letter left out, told apart by `side`."""
    cut_at = lambda i: F.xxhash64(F.lit(side), F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token)), cut_at))


def slips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows of `a` (text in column a) and `b` (text in column b) with different texts one slip apart: one letter more
    or less, or the same letters with at most two out of place. One letter in place of another is no slip: it makes another
    name. Further columns of both come along."""
    a, b = a.filter(F.length("a") >= 4), b.filter(F.length("b") >= 4)
    columns = [*a.columns, *b.columns]
    letters = lambda c: F.xxhash64(F.lit("letters"), F.array_join(F.array_sort(F.split(c, "")), ""))
    whole = lambda side, c: F.xxhash64(F.lit(side), c)
    # One key space for all three ways to meet: a's forms with b, a with b's forms, equal letters.
    x = a.select("*", F.explode(F.concat(one_letter_less(F.col("a"), "a"), F.array(whole("b", F.col("a")), letters(F.col("a"))))).alias("h"))
    y = b.select("*", F.explode(F.concat(one_letter_less(F.col("b"), "b"), F.array(whole("a", F.col("b")), letters(F.col("b"))))).alias("h"))
    return x.join(y, "h").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b") <= 2)).select(*columns)


def _slip_count(n: Column, share: float = 0.02, spread: float = 1.5) -> Column:
    """Most listings that one slip of a name of `n` listings has: a share of them and what chance adds, at any size."""
    return n * share + F.sqrt(n) * spread


def spellings(tokens: DataFrame) -> DataFrame:
    """(token, right) for tokens (token, n) that are one slip away from a more frequent token (the most frequent such; ties: the
    first in the alphabet) and as rare beside it as slips are."""
    few = tokens.crossJoin(F.broadcast(tokens.agg(F.max("n").alias("top"))))  # one row
    few = few.filter(F.col("n") <= _slip_count(F.col("top"))).select(F.col("token").alias("a"), F.col("n").alias("m"))
    near = slips(few, tokens.select(F.col("token").alias("b"), "n"))
    near = near.filter((F.col("m") <= _slip_count(F.col("n"))) & ((F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("b") < F.col("a")))))
    return near.groupBy(F.col("a").alias("token")).agg(F.max_by("b", F.struct("n", F.transform(F.split("b", ""), lambda c: -F.ascii(c)))).alias("right"))


def _numbered(names: DataFrame, order: list[str]) -> DataFrame:
    """`names` with `code`, the position in the order given, from 1: a range sort and the counts of its partitions."""
    placed = cut(names.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n0"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_i", inside).join(F.broadcast(parts), "_part").withColumn("code", F.col("_n0") + F.col("_i")).drop("_part", "_i", "_n0")


def name_roles(rows: DataFrame, further: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(said, token, among, owns) of every distinct `said`, and (token, right, n, is_brand, is_firm, code). `code` numbers the
    right spellings by their share among brand names, then by their listings: the line of a listing has the least code among
    its names. Names of `further` (token) that no listing has come along with n = 0, or with the spelling of a
    listed name that they are one slip away from."""
    sets = rows.groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("k0"), F.max("kind").alias("k1"))
    said = sets.select(F.xxhash64("said").alias("said"), "n", "k0", "k1", F.explode(F.split("said", " ")).alias("t")).filter("t <> ''")
    flag = F.right("t", F.lit(1)).cast("int")
    said = cut(said.select("said", F.substring("t", F.lit(1), F.length("t") - 1).alias("token"), "n", "k0", "k1", flag.isin(1, 3).alias("among"), (flag >= 2).alias("owns")))
    weigh = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    counts = cut(said.groupBy("token").agg(weigh("among").alias("b"), weigh("owns").alias("o"), F.sum("n").alias("n"), F.min("k0").alias("k0"), F.max("k1").alias("k1")))
    if further is not None:
        new = further.join(counts.select("token"), "token", "left_anti")
        counts = cut(counts.unionByName(new.select("token", *[F.lit(0).cast("long").alias(c) for c in ("b", "o", "n")]), allowMissingColumns=True))
    right = counts.join(spellings(counts), "token", "left").withColumn("right", F.coalesce("right", "token"))
    sums = right.groupBy("right").agg(*[F.sum(c).alias(c) for c in ("n", "b", "o")], F.min("k0").alias("k0"), F.max("k1").alias("k1"))
    owns = (F.col("o") * 2 >= F.col("n")) & (F.col("n") > 0)
    often = (F.col("b") * 2 >= F.col("n")) & F.coalesce(F.col("k0") != F.col("k1"), F.lit(False))
    # Lower bound of the share among brand names, 2.5 standard deviations away: few listings prove nothing.
    n, z2 = F.greatest("n", F.lit(1)), 6.25
    share = F.col("b") / n
    bound = (share + z2 / (2 * n) - F.sqrt(z2 * (share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    mostly = bound >= 0.6
    roles = sums.select("right", F.col("n").alias("total"), (owns | often | mostly).alias("is_brand"), owns.alias("is_firm"), share.alias("_share"))
    roles = _numbered(roles, ["_share", "total", "right"]).drop("_share")
    return said, cut(right.select("token", "right").join(roles, "right").withColumnRenamed("total", "n"))


#: Blocks in which profiles of a known line take over an unknown attribute. Content comes first: its order serves the next.
BLOCKS = [
    ("content", ["line", "kind", "flavour", "variant"]),
    ("brand", ["line", "kind"]),
    ("kind", ["line"]),
    ("flavour", ["line", "variant", "content"]),
]
#: Blocks in which profiles take over a line.
LINE_BLOCKS = (["brand", "kind", "flavour", "variant", "content"], ["brand", "kind", "flavour", "variant"])


def _agreed(c: str, key: list[str]) -> Column:
    """The value of `c` on which all that know it in the block `key` agree, else null."""
    w = W.partitionBy(*key)
    return F.when(F.min(c).over(w) == F.max(c).over(w), F.min(c).over(w))


def _take_lines(p: DataFrame, lacking: int, most_sent: int = 50_000) -> DataFrame:
    """Profiles without a line take that of the profiles of their brand that agree in all else, or in all but the content, if
    those have a single one; an unknown attribute of a block meets nothing, not even another unknown one. Blocks are
    aggregated before they meet; those of up to `most_sent` profiles are sent to the others, more meet by block."""
    wide = LINE_BLOCKS[1]
    has, need = p.filter("line is not null"), p.filter("line is null")
    asked = need.select(*wide).distinct()
    known = has.join(F.broadcast(asked) if lacking <= most_sent else asked, wide, "left_semi").groupBy(*LINE_BLOCKS[0]).agg(F.min("line").alias("_a"), F.max("line").alias("_z"))
    whole = known.groupBy(*wide).agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    for i, (k, key) in enumerate(zip((known, whole), LINE_BLOCKS)):
        need = need.join(k.filter("_a = _z").select(*key, F.col("_a").alias(f"_v{i}")), key, "left")
    return has.unionByName(need.withColumn("line", F.coalesce("_v0", "_v1")).drop("_v0", "_v1").select(*p.columns))


def resolve(profiles: DataFrame, limit: int = 50) -> DataFrame:
    """`profiles` (profile, ATTRIBUTES) with the attributes after merging, until no profile changes, and `sized`: whether some
    profile of the same line, kind, flavour and variant states a net content. Each round fills an attribute or is the last;
    more than `limit` rounds raise.

    In a round profiles without a line look for it; then the profiles of a line meet, by one exchange, and hand each other
    content, brand, kind and flavour by BLOCKS. A line's listings are profiles by now, as many as its kinds, flavours, variants
    and contents have combinations, however many listings it has."""
    p = cut(profiles.select("profile", *ATTRIBUTES, F.lit(True).alias("sized")))
    unknown = lambda d: d.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in ATTRIBUTES]).first()
    last, before = unknown(p), None
    for _ in range(limit):
        # Lines can only be found anew where the profiles that know one have changed.
        taken = p
        if last["line"] and (before is None or any(before[c] != last[c] for c in ("brand", "kind", "flavour", "content"))):
            taken = _take_lines(p, last["line"])
        q = taken.filter("line is not null").repartition("line")
        q = q.withColumn("sized", F.max(F.col("content").isNotNull()).over(W.partitionBy(*BLOCKS[0][1])))
        for c, key in BLOCKS:
            if last[c]:
                q = q.withColumn("_v", _agreed(c, key)).withColumn(c, F.coalesce(c, "_v")).drop("_v")
        p = cut(q.unionByName(taken.filter("line is null")), p)
        now = unknown(p)
        changed = {c: now[c] != last[c] for c in ATTRIBUTES}
        before, last = last, now
        # Nothing can change any more unless what changed is read by a block whose attribute is still unknown somewhere.
        more = (now["line"] and any(changed[c] for c in ("brand", "kind", "flavour", "content"))) or (now["brand"] and changed["kind"]) or (now["content"] and (changed["kind"] or changed["flavour"]))
        if not more:
            return p
    raise RuntimeError(f"profiles still change after {limit} rounds")


def named(said: DataFrame, roles: DataFrame) -> DataFrame:
    """(said, line, brand) of every set of coined names, as codes. The line is the name that stands least often among brand
    names; where all look like brands it is the least such of several that is no firm's."""
    code = F.col("code")
    by = said.join(roles, "token").groupBy("said").agg(
        F.min(F.when(~F.col("is_brand"), code)).alias("line"),
        F.min(F.when(~F.col("is_firm"), code)).alias("other"),
        F.max(F.when(F.col("is_brand"), code)).alias("brand"),
    )
    return by.select("said", F.coalesce("line", F.when(F.col("other") != F.col("brand"), F.col("other"))).alias("line"), "brand")


def merged(rows: DataFrame, said: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, product, profile) of every reading, and (profile, product, ATTRIBUTES) of every profile after merging. `product` is
    null where what a listing says is not enough to name one."""
    raw = rows.select(F.xxhash64("said").alias("said"), *_SAID).distinct().withColumn("raw", F.xxhash64("said", *_SAID))
    full = cut(raw.join(named(said, roles), "said", "left").select("raw", *ATTRIBUTES).withColumn("profile", F.xxhash64(*ATTRIBUTES)))
    p = resolve(full.groupBy("profile").agg(*[F.max(c).alias(c) for c in ATTRIBUTES]))
    family = ["line", "kind", "flavour", "variant"]
    known = F.col("line").isNotNull() & F.col("kind").isNotNull() & F.col("flavour").isNotNull()
    # A profile without net content in a family where others state several is a product of its own.
    key = F.when(known & (F.col("content").isNotNull() | ~F.col("sized")), F.xxhash64(*family, F.coalesce("content", F.lit(0)))).alias("product")
    p = p.select("profile", key, *ATTRIBUTES)
    return full.select("raw", "profile").join(p.select("profile", "product"), "profile").select("raw", "product", "profile"), p


def members(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """(record_id, copy, product, profile) of the listings of some readings."""
    return rows.select("record_id", "copy", F.xxhash64(F.xxhash64("said").alias("said"), *_SAID).alias("raw")).join(readings, "raw").select("record_id", "copy", "product", "profile")


def product_groups(df: DataFrame) -> DataFrame:
    """(record_id, product) for every listing with a product name: listings of one product share `product`.

    A listing whose line or net content stays unknown (no other listing tells it, or several differ) is one product with its
    exact copies only; if no listing of its product states a net content, all of them are one. No name, no row."""
    rows = cut(read_listings(df, vocabulary(df)))
    return members(rows, merged(rows, *name_roles(rows))[0]).select("record_id", F.coalesce("product", F.xxhash64("copy", "profile")).alias("product"))


def product_table(df: DataFrame) -> DataFrame:
    """(record_id, product, brand, line, kind, flavour, variant, units, size_tenths, size_unit) of every listing, in words: those of
    the most telling phrase of each kind, flavour and variant. `flavour` is null where a name tells several."""
    known = vocabulary(df)
    rows = cut(read_listings(df, known))
    said, roles = name_roles(rows)
    readings, p = merged(rows, said, roles)
    listings = members(rows, readings).withColumn("product", F.coalesce("product", F.xxhash64("copy", "profile")))
    words = roles.groupBy("code").agg(F.min("right").alias("word"))
    out = listings.join(p.drop("product"), "profile")
    for c in ("brand", "line"):
        out = out.join(words.select(F.col("code").alias(c), F.col("word").alias(f"{c}_word")), c, "left").drop(c).withColumnRenamed(f"{c}_word", c)

    def word(role: str) -> Column:
        pairs = [x for r, k in sorted({x[:2] for x in known.phrases.values()}) if r == role for x in (F.lit(k).cast("long"), F.lit(known.name(r, k)))]
        return (F.try_element_at(F.create_map(*pairs), F.col(role).cast("long")) if pairs else F.lit(None).cast("string")).alias(role)

    return out.select(
        "record_id", "product", "brand", "line", word("kind"), word("flavour"), word("variant"), F.floor(F.col("content") / 10**9).alias("units"), F.floor(F.pmod("content", F.lit(10**9)) / 10).alias("size_tenths"),
        F.when(F.pmod("content", F.lit(10)) == 1, "ml").when(F.col("content").isNotNull(), "g").alias("size_unit"),
    )


def found(df: DataFrame) -> DataFrame:
    """All pairs of listings of one product, the lower id first."""
    g = product_groups(df)
    return g.select("product", F.col("record_id").alias("record_id_a")).join(g.select("product", F.col("record_id").alias("record_id_b")), "product").filter("record_id_a < record_id_b").select("record_id_a", "record_id_b")
