import numpy as np
import pytest

from larder.llm import linkage, listing, matching
from tests.llm.test_operators import catalogue

COLUMNS = "product_name string, brand_name string, brand_owner string, ingredients string"


@pytest.mark.parametrize("part", [20_000, 7])
def test_every_listing_of_a_line_counts_in_tables_as_in_memory(spark, part):
    # Lines of 90 listings: no more than 40 of each counted before.
    rows = list(dict.fromkeys(catalogue(firms=30, lines=2, listings=90)))
    df = spark.createDataFrame(rows + rows[:200], COLUMNS)
    got = matching.vocabulary(df, part=part)
    want = listing.learn(rows, *listing.common_words([r[:3] for r in rows + rows[:200]]))
    assert got.phrases.keys() == want.phrases.keys() and got.common == want.common and got.usual == want.usual
    if part > 90:
        assert got.phrases == want.phrases and got.plain == want.plain


def test_common_words_are_counted_with_every_firm(spark):
    # 10,000 of the 40,000 listings were read before; the word stands in five of them, with five firms.
    rest = spark.range(39_995).selectExpr("concat('Bofa ', id, ' jam')", "concat('Firm', translate(id % 50, '0123456789', 'abcdefghij'))", "cast(null as string)", "cast(null as string)")
    few = spark.createDataFrame([(f"Zeta{x} quince", f"Rare{x}", None, None) for x in "abcde"], COLUMNS)
    common = matching.vocabulary(few.union(rest).repartition(4)).common
    assert {"jam", "quince"} <= common and "zetaa" not in common


def test_names_recalled_by_other_firms_stay_coined(spark):
    # Four notices of four firms made a brand common, then a "variant" of its own lines.
    rows = list(dict.fromkeys(catalogue(firms=30, lines=2, listings=90)))
    brand = rows[0][1]
    notices = [(f"{brand} {x} recalled, lot {x}", f"Firm{x} Inc.") for x in ("abe", "bod", "cel", "dim", "eku", "fos")]
    got = matching.vocabulary(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(notices, "product_description string, recalling_firm string"))
    assert brand.lower() not in got.words | got.common and {"recalled", "lot"} <= got.common
    assert got.common == listing.learn(rows, *listing.common_words([r[:3] for r in rows], notices)).common
    # No notices whatever change what the words of the catalogue mean: here a line and its brand are recalled by 130 firms.
    line = next(x for x in rows[0][0].split() if x.lower() not in got.words | got.common and x != brand)
    many = [(f"{line} {brand} recalled", f"Far{a}{b} Inc.") for a in "abcdefghij" for b in "bdfgklmnprstv"]
    more = matching.vocabulary(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(many, "product_description string, recalling_firm string"))
    assert more.phrases == got.phrases == matching.vocabulary(spark.createDataFrame(rows, COLUMNS)).phrases and more.plain == got.plain


def test_tables_without_listings_or_lines(spark):
    empty = matching.vocabulary(spark.createDataFrame([], COLUMNS), spark.createDataFrame([], "product_description string, recalling_firm string"))
    assert not empty.phrases and not empty.common
    assert not matching.vocabulary(spark.createDataFrame([("", None, None, None), (None, "a", "b", ""), ("12 oz", "a", "", None)], COLUMNS)).phrases


def test_notices_alike_weigh_as_often_as_they_occur():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 3, (40, 7))
    entry, pairs, times = np.repeat(np.arange(10), 4), rng.integers(1, 4, 40), np.repeat(rng.integers(1, 30, 10), 4)
    every = [(e * 1000 + t, i) for i, e in enumerate(entry) for t in range(times[i]) for _ in range(pairs[i])]
    want = linkage.estimate(np.array([n for n, _ in every]), levels[[i for _, i in every]])
    got = linkage.estimate(entry, levels, pairs=pairs, times=times)
    assert np.allclose(got[0], want[0], atol=1e-3) and abs(got[1] - want[1]) < 1e-3


def test_words_of_a_task_are_counted_together():
    import pyarrow as pa

    from larder.llm import listing, matching

    names = ["Acme red-hot Soup 2 x 100 g 3 oz", "Soup's soup acme", "", None, "Crème 12 kg"]
    rows = [(n, b, o) for n in names for b in (None, "Acme", "Acme Red") for o in (None, "Bell Soup Co", "Acme")]
    want = {}
    for n, b, o in rows:
        bw, ow = listing.firm_words(b), listing.firm_words(o)
        firm = ow[0] if ow else bw[0] if bw else None
        said = {("n", w): int(w in {*bw, *ow}) for w in listing.words_of(n, False)} if bw or ow else {}
        said |= {(k, w): 0 for k, ws in (("o", ow), ("b", bw)) for w in ws[1:]}
        for (k, w), beside in said.items():
            c = want.setdefault((k, w, firm), [0, 0])
            c[0], c[1] = c[0] + 1, c[1] + beside
    batches = [pa.RecordBatch.from_pylist([dict(zip("xyz", r)) for r in part], pa.schema([(c, pa.string()) for c in "xyz"])) for part in (rows[:20], rows[20:])]
    got = list(matching._count_rows(iter(batches), False))
    assert len(got) == 1
    table = {(r["what"], r["word"], r["firm"]): [r["listings"], r["beside"]] for r in got[0].to_pylist()}
    assert {k: v for k, v in table.items() if k[0] != "u"} == want == {k: v for k, v in listing.word_counts(rows).items() if k[0] != "u"}
    assert {k[1:]: v for k, v in table.items() if k[0] == "u"} == {("g 100.0", "Acme red-hot"): [9, 0], ("g 12000.0", "Crème 12 kg"): [9, 0]}
    assert list(matching._count_rows(iter([]), False))[0].num_rows == 0


def test_phrase_numbers_are_those_of_the_phrases():
    import random

    from larder.llm import listing

    r = random.Random(3)
    known = {(1, 2), (2, 3), (1, 2, 3), (4, 4)}
    ids = {p: i for i, p in enumerate([(0,), (1,), (3,), (1, 2), (1, 2, 3), (4, 4)])}
    numbers = listing.PhraseNumbers(known, ids)
    for _ in range(300):
        t = [r.randint(-1, 5) for _ in range(r.randint(0, 8))]
        assert numbers.of(t) == sorted(ids[p] for p in listing.phrases_in(t, known) if p in ids)


def test_lines_of_a_task_are_summed_together():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 9, 60)
    lengths = r.integers(0, 5, sizes.sum())
    phrases = np.concatenate([np.sort(r.choice(12, n, replace=False)) for n in lengths])
    variant = np.where(np.arange(12) % 3 == 0, np.arange(12) // 3, -1)
    at, ends = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(lengths)])
    total, both, meet, own, unnamed = 0, np.zeros((12, 12)), np.zeros((12, 12)), np.zeros(12), np.zeros(4)
    for a, z in zip(at, at[1:]):
        has = np.array([[p in phrases[ends[i] : ends[i + 1]] for p in range(12)] for i in range(a, z)], float)
        if z - a > 1:
            c = has.sum(0)
            total, both, meet, own = total + z - a, both + has.T @ has, meet + np.outer(c, c) / (z - a - 1), own + c / (z - a - 1)
        silent = ~has[:, ::3].any(1)
        unnamed += has[:, ::3].sum(0) * silent.sum() / max(z - a - 1, 1)
    for most in (1, 30, 200_000):
        got = listing.LineSums(12)
        got.add_lines(sizes, lengths, phrases, most)
        assert got.total == total and all(np.allclose(x, y) for x, y in ((got.both, both), (got.meet, meet), (got.own, own)))
    assert np.allclose(listing.unnamed_rates(variant, lengths, phrases, sizes), unnamed)
    none = listing.LineSums(0)
    none.add_lines(np.array([3]), np.zeros(3, int), np.zeros(0, int))
    none.add_lines(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    assert none.total == 3


def test_folding_by_runs_and_ingredients_one_by_one():
    import unicodedata

    from larder.llm.text import _TABLE, fold, mend

    assert not any(chr(c).isascii() for c in _TABLE)
    texts = ["Crème BRÛLÉE", "e\u0301te\u0301 ΣΑΣ, ΟΔΟΣ;", "ｆｕｌｌ，width；", "Ελλάς • ŁÓDŹ ﬁne", "Ａ\u0327\u0301b", "Я ёж", "日本 ｶﾞ"]
    for t in texts:
        low = unicodedata.normalize("NFKD", t.lower().translate(_TABLE))
        assert fold(t) == "".join(c for c in low if not unicodedata.combining(c)).translate(_TABLE)
    for t in [*texts, "Salt, SUGAR (3%) • sugar;Crème: milk. Allergens in bold.", "salt &amp; oil, a&#44;b", "sugar â€¢ salt", " , ;", "ΟΔΟΣ，ΟΔΟΣ, x", "<b>a</b>, b*"]:
        want = {n for x in listing._ITEM.split(listing.folded(t)) for item, n in [listing.item_of(x)] if item}
        assert listing.items_of(t) == sorted(want), (t, mend(t))
