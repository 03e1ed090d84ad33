import itertools
import os
import random

import numpy as np
import pytest

from larder.llm import abuse, leak, linkage, listing, matching, packing, survivor
from larder.llm.text import fold, letters, mend

NUTRITION = "record_id long, product_name string, brand_name string, brand_owner string, ingredients string, product string"


def listings(spark, names):
    return spark.createDataFrame([(i + 1, n, b, o, None, "clash") for i, (n, b, o) in enumerate(names)], NUTRITION)


def groups(df):
    out = {}
    for r in matching.product_groups(df).collect():
        out.setdefault(r.product, set()).add(r.record_id)
    return sorted(map(sorted, out.values()))


#: A made-up trade: kinds, flavours and variants with the words that sellers use for each, none of them a known food.
KINDS = [("zorbel cake", "zorbels", "zrbl cke"), ("quim paste", "quimmel"), ("drostle", "drostles", "drstl"), ("fen wafer", "wafrets"), ("lurp", "lurpies"), ("mond drink", "mondy")]
FLAVOURS = [("amberroot", "ambr"), ("blue tansel", "tansel"), ("crispleaf", "crspleaf"), ("dullberry", "dullberries"), ("ember", "emberine"), ("frostnut", "frstnt")]
VARIANTS = [("regular", "standard", ""), ("airy", "lite"), ("half sweet", "reduced sweet"), ("earthgrown", "eco")]
HERE = ("Boger", "Boger Provisions Inc.")


def _coined(rng):
    return "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4))


def catalogue(firms=40, lines=4, listings=14, seed=9):
    """Listings (name, brand, owner, ingredients) of many firms, each line of one kind, with two flavours and two variants."""
    rng, out = random.Random(seed), []
    for _ in range(firms):
        firm = _coined(rng)
        for _ in range(lines):
            line, kind = _coined(rng), rng.randrange(len(KINDS))
            flavours, variants = rng.sample(range(len(FLAVOURS)), 2), rng.sample(range(len(VARIANTS)), 2)
            for _ in range(listings):
                k, f, v = rng.choice(KINDS[kind]), (i := rng.choice(flavours)), rng.choice(VARIANTS[rng.choice(variants)])
                words = [firm.title() if rng.random() < 0.5 else "", line.title(), v, rng.choice(FLAVOURS[f]), k]
                if rng.random() < 0.5:
                    words = [words[3], words[4], words[2], rng.choice(("great value", "new", "")), words[1]]
                name = " ".join(w for w in words if w) + rng.choice((", 340 g", " 12 oz", ", 907 g", ""))
                out.append((name, firm.title(), f"{firm.title()} {rng.choice(('Foods', 'Trading', 'Mills'))} {rng.choice(('Inc.', 'Ltd.', 'LLC'))}", f"base of {KINDS[kind][0]}, {FLAVOURS[i][0]} extract, salt"))
    return out


def vocabulary():
    rows = catalogue()
    common, house = listing.common_words([r[:3] for r in rows])
    return listing.learn(rows, common, house), rows


def test_vocabulary_is_learned_from_the_catalogue():
    v, rows = vocabulary()
    role = {" ".join(p): x[:2] for p, x in v.phrases.items()}
    for of, groups in (("kind", KINDS), ("flavour", FLAVOURS), ("variant", VARIANTS)):
        codes = []
        for names in groups:
            got = {role[n] for n in names if n}
            assert len(got) == 1 and {r for r, _ in got} == {of}, names
            codes += got
        assert len(set(codes)) == len(groups)
    assert role["regular"] == ("variant", v.plain) and {"great", "value", "new", "inc", "foods"} <= v.common and "great" not in v.words
    assert not {w for n, b, *_ in rows for w in listing.words_of(b)} & v.common


def test_reader():
    v, _ = vocabulary()
    role = {" ".join(p): x[1] for p, x in v.phrases.items()}
    r = listing.Reader(v)
    p = r.read("BOGER® Kril-atrapa™ Dullberries Zorbel Cake; Lite; 6 x 12 oz; great value")
    assert (p.kind, p.flavours, p.variant, p.content, p.names) == (role["zorbels"], [role["dullberry"]], role["airy"], 6 * 10**9 + 34000, ["boger", "krilatrapa"])
    q = r.read("Tansel Lurp, 32 fl.oz (2 ct)")
    assert (q.kind, q.flavours, q.content) == (role["lurpies"], [role["blue tansel"]], 2 * 10**9 + 94601) or q.content // 10**9 == 2
    assert r.read("").names == [] and r.read("Ember and Tansel Lurp").flavours == [role["emberine"], role["tansel"]]


def products_of(spark, names):
    """Groups of the ids of `names` when they stand in a catalogue of other firms."""
    rows = [(i + 1, *n, None) if len(n) == 3 else (i + 1, *n) for i, n in enumerate([*names, *catalogue()])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, product_name string, brand_name string, brand_owner string, ingredients string, product string")
    return [g for g in ([i for i in g if i <= len(names)] for g in groups(df)) if g]


def test_products(spark):
    names = [
        ("Boger Krilatrapa Lite Ember Quimmel, 907 g", *HERE), ("Emberine Quim Paste Airy, 2 lb, Krilatrapa", *HERE), ("KRILATRAPA LITE QUIMMEL TANSEL 907 G", *HERE), ("Krilatrapa Ember Quim Paste, 907 g", *HERE),
        ("Boger Krilatrapa Standard Emberine Quimmel 907 g great value", *HERE), ("Boger Krilatrapa Lite Ember Quimmel, 6 x 907 g", "Boger", None), ("Nonurifo Tansel Lurp", *HERE), ("Nonurifo Blue Tansel Lurpies", *HERE), ("", *HERE),
        (None, *HERE), ("Krilaatrapa Quimmel Ember Airy 907g", *HERE),
    ]
    got = products_of(spark, names)
    assert [1, 2, 11] in got and [3] in got and [4, 5] in got and [6] in got and [7, 8] in got and [9] in got
    assert not any(10 in g for g in got)
    assert groups(listings(spark, [n[:3] for n in names]).limit(0)) == []


def test_size_unstated_belongs_to_the_only_one(spark):
    names = [("Boger Krilatrapa Lite Ember Quimmel, 907 g", *HERE), ("Krilatrapa Quimmel Emberine Airy", *HERE), ("Boger Nonurifo Tansel Lurp", *HERE), ("Nonurifo Lurpies Blue Tansel", *HERE)]
    assert products_of(spark, names) == [[1, 2], [3, 4]]


def test_rounds_go_on_until_nothing_changes(spark):
    # Each profile can only be filled once the one before it is: kind, then brand, then line, ...
    p = spark.createDataFrame([(1, 5, 50, 4, 12, 0, 250), (2, 5, None, 4, 12, 0, None), (3, None, 50, None, 12, 0, 250)], "profile long, brand long, line long, kind int, flavour long, variant int, content long")
    got = {r.profile: tuple(r)[1:7] for r in matching.resolve(p).collect()}
    assert got == {i: (5, 50, 4, 12, 0, 250) for i in (1, 2, 3)}
    with pytest.raises(RuntimeError):
        matching.resolve(p, limit=0)


def test_slips_against_all_pairs(spark):
    random.seed(2)
    words = ["".join(random.choice("abc") for _ in range(random.randint(3, 6))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in set(words)], "a string")
    got = {(r.a, r.b) for r in matching.slips(df, df.withColumnRenamed("a", "b")).collect()}

    def one_more(x, y):
        return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))

    want = set()
    for x, y in itertools.permutations(set(words), 2):
        if min(len(x), len(y)) >= 4:
            diff = [i for i in range(min(len(x), len(y))) if x[i] != y[i]]
            if one_more(x, y) or one_more(y, x) or (len(x) == len(y) and sorted(x) == sorted(y) and len(diff) == 2):
                want.add((x, y))
    assert want <= got  # further pairs of the same letters may be two edits apart in other ways
    assert all(sorted(x) == sorted(y) for x, y in got - want)


def test_linkage(spark):
    names = [("Boger Krilatrapa Lite Ember Quimmel, 907 g", *HERE), ("Krilatrapa Quimmel Emberine Airy", *HERE), ("Krilatrapa Tansel Lite Quimmel 907g", *HERE), ("Boger Nonurifo Crispleaf Lurp 340 g", *HERE)]
    others = catalogue()
    c = spark.createDataFrame([(i + 1, *n[:3], n[3] if n[3:] else None) for i, n in enumerate([*names, *others])], "record_id long, product_name string, brand_name string, brand_owner string, ingredients string")
    notices = [(f"N{i}", f"Packaged {n}, LOT A{i}, film wrapped", o) for i, (n, b, o, _) in enumerate(others[::7])]
    notices += [("R1", "Packaged Quimmel: Boger brand Krilatrapa - Ember and Tansel / Lite - net 2 lb, LOT A1", "Boger Provisions Inc."), ("R2", "Boger Krilatrapa Half Sweet Dullberry Quimmel 907 g", None), ("R3", "Krilatrapa Lite Ember Quimmel, 907 g, Batch 9", "Other Trading Ltd."), ("R4", None, None), ("R5", "", "")]
    r = spark.createDataFrame(notices, "recall_number string, product_description string, recalling_firm string")
    of = lambda df: {(x.recall_number, x.record_id) for x in df.collect() if x.recall_number[0] == "R"}
    assert of(linkage.found(r, c)) == {("R1", 1), ("R1", 2), ("R1", 3), ("R3", 1), ("R3", 2)}
    assert of(linkage.found(r, c, least=0.9999999)) < of(linkage.found(r, c)) < of(linkage.found(r, c, least=1e-6))
    assert all(0 <= x.confidence <= 1 for x in linkage.confidences(r, c).collect())
    assert linkage.found(r.limit(0), c).collect() == []


def test_estimate_ranks_agreement_first():
    rows = []
    for n in range(60):  # of each notice's candidates one agrees on all, the others differ in flavour, content or both
        rows += [(n, 2, 2, 2, 2, 2, 2, 2), (n, 2, 2, 2, 2, 0, 2, 2), (n, 2, 2, 2, 2, 2, 2, 0), (n, 2, 2, 2, 2, 0, 2, 0)]
    rows = np.array(rows)
    weights, prior = linkage.estimate(rows[:, 0], rows[:, 1:])
    value = lambda p: sum(weights[i, v] for i, v in enumerate(p))
    assert value((2,) * 7) > value((2, 2, 2, 2, 0, 2, 2)) > value((2, 2, 2, 2, 0, 2, 0)) and prior > 0.5
    assert linkage.estimate(np.empty(0), np.empty((0, 7), int))[0].shape == (7, 3)


MEMBERS = '[{"member_id": 1, "data_source": "OFF", "product_name": "abc", "published_date": "2024-01-02"}, {"member_id": 2, "data_source": "off", "product_name": "abcd", "published_date": "20240103"}, {"member_id": 3, "data_source": "x", "product_name": " n/a ", "published_date": "1 Jan 2025"}]'


def test_survivors(spark):
    c = spark.createDataFrame([(1, "r", "0", MEMBERS), (2, "r", "0", MEMBERS), (3, "r", "1", "[cut"), (4, "r", "2", None), (5, "r", "3", "[]")], "id long, run_id string, cluster_id string, members string")
    t = spark.createDataFrame([("off", 1), ("x", 2)], "data_source string, trust_rank long")
    assert [tuple(r) for r in survivor.found(c, t).collect()] == [("r", "0", "product_name", 2)]
    assert survivor.survivors(c, t).first().product_name == "abcd"
    assert survivor.found(c.limit(0), t).collect() == []


def test_survivors_against_brute_force(spark):
    import json

    random.seed(8)
    rows, want = [], set()
    rank = {"a": 1, "b": 2, "c": 2}
    for k in range(40):
        ms = [{"member_id": 10 * k + i, "data_source": random.choice("abcd"), "brand_name": random.choice(["x", "xy", "xyz", "-", None]), "published_date": random.choice(["2024-01-01", "2024-01-02T10:00:00Z", "1704200000", "", None])} for i in range(random.randint(1, 5))]
        rows.append((k, "r", str(k), json.dumps(ms)))
        day = {"2024-01-01": 1, "2024-01-02T10:00:00Z": 2, "1704200000": 2}
        real = [(m["member_id"], day.get(m["published_date"], 0), -rank.get(m["data_source"], 9), len(m["brand_name"])) for m in ms if m["brand_name"] not in (None, "-")]
        for m in real:
            if all(all(x >= y for x, y in zip(m[1:], n[1:])) and m[1:] != n[1:] for n in real if n is not m):
                want.add((str(k), m[0]))
    c = spark.createDataFrame(rows, "id long, run_id string, cluster_id string, members string")
    t = spark.createDataFrame(list(rank.items()), "data_source string, trust_rank long")
    assert {(r.cluster_id, r.member_id) for r in survivor.found(c, t).collect()} == want


def test_packing_is_whole(spark):
    random.seed(3)
    sizes = [(i, min(100, int(random.expovariate(1 / 30)) + 1)) for i in range(500)] + [(900, 0), (901, 250), (902, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int")
    rows = packing.pack(packing.pieces(df, 100), 100).collect()
    whole, used = {}, {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
        used.setdefault(r.container, []).append((r.offset, r.tokens))
    assert whole == dict(sizes) and len([r for r in rows if r.doc_id == 901]) == 3
    for spans in used.values():
        spans = sorted(s for s in spans if s[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and (not spans or sum(spans[-1]) <= 100)
    assert len(used) <= -(-sum(n for _, n in sizes) // 100) * 1.03 + 1
    assert packing.pack(packing.pieces(df.limit(0), 100), 100).collect() == []


@pytest.mark.skipif(not os.path.isdir(packing.TOKENIZERS), reason="no vocabulary files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in packing.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}


ITEM = "On the ferry to Fennwater, a pallet of Mapadra syrup lost 31 bottles to the swell. The Pabena mill grinds 2 sacks of barley before noon and 95 sacks after the bell. Question: how much does each Sokisu fan receive?"


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(97, 123, leak.K + leak.WINDOW - 1).astype(np.uint8)
        a, b = (np.concatenate([rng.integers(97, 123, rng.integers(0, 40)).astype(np.uint8), shared, rng.integers(97, 123, rng.integers(0, 40)).astype(np.uint8)]) for _ in range(2))
        ha, hb = leak.gram_hashes(a), leak.gram_hashes(b)
        assert set(ha[leak.winnow(ha)].tolist()) & set(hb.tolist())


def test_leaks(spark):
    words = ITEM.split()
    noisy = " ".join(w + (" really" if i == 9 else "") for i, w in enumerate(words)).replace("mill", "mіll").upper()
    other = ITEM.replace("Fennwater", "Oslo").replace("Mapadra", "Bobo").replace("31", "7").replace("Pabena", "Kiki").replace("95", "4").replace("2 sacks", "8 sacks").replace("Sokisu", "Zuzu").replace("noon", "dusk").replace("bell", "gong")
    docs = spark.createDataFrame([(1, f"Intro. <b>{noisy}</b> Outro."), (2, " ".join(words[:16])), (3, " ".join(words[:6])), (4, None), (5, ""), (6, other), (7, "x" * 50_000 + ITEM)], "doc_id long, text string")
    tests = spark.createDataFrame([(10, ITEM), (11, None), (12, "?!")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leak.found(docs, tests).collect()} == {(1, 10), (2, 10), (7, 10)}
    assert leak.found(docs, tests.limit(0)).collect() == []


def test_text_folding():
    assert mend("fÃ¼r &amp; <b>x</b>").split() == ["für", "&", "x"] and letters("Éa-Б 1а") == "eaб1a" and fold("ＡB") == "ab"


def test_kernel_of_inserted_characters():
    near = abuse._sparse([abuse.normal(s) for s in ("you stupid bastard", "you stupid b.a.s.t.a.r.d", "you stupid bast4rd", "a cup of green tea")])

    def k(i, j):
        (a, x), (b, y) = near[i], near[j]
        return float(sum(x[np.isin(a, b)] * y[np.isin(b, a)]))

    assert k(0, 1) > 0.8 and k(0, 2) > 0.5 and k(0, 3) < 0.2


def test_scores_equal_the_machine():
    units = [abuse.normal(s) for s in ("fuck you", "nice soup", "you are an idiot", "the recipe is good")]
    w, b = abuse.train_svm(units, np.array([1.0, -1, 1, -1]))
    by_slot = [float(v @ w[s]) + b for s, v in abuse._sparse(units)]
    assert np.allclose(by_slot, abuse.scores(units, w, b), atol=1e-4) and abuse.scores([], w, b).size == 0


def test_abuse_held_out(spark):
    from larder.llm.abuse_sentences import ABUSIVE, HARMLESS

    units, y = [abuse.normal(s) for s in ABUSIVE + HARMLESS], np.array([1.0] * len(ABUSIVE) + [-1.0] * len(HARMLESS))
    fold_of = np.arange(len(y)) % 5
    right = 0
    for f in range(5):
        w, b = abuse.train_svm([u for u, g in zip(units, fold_of) if g != f], y[fold_of != f])
        right += int((np.sign(abuse.scores([u for u, g in zip(units, fold_of) if g == f], w, b)) == y[fold_of == f]).sum())
    assert right / len(y) > 0.75
    docs = spark.createDataFrame([(1, "Lovely jam. you are a complete idiot and everyone here knows it!", "s"), (2, "The lid broke again.", "s"), (3, None, None), (4, "", "t"), (5, "...", "t")], "doc_id long, text string, source string")
    scored = abuse.document_scores(docs, *abuse.train(None, None))
    by = {r.doc_id: r.score for r in scored.collect()}
    assert by[1] > 0.2 and by[3] is None and by[4] is None and by[5] is None
    assert {r.source: (r.documents, r.unwanted) for r in abuse.source_rates(scored, 0.0).collect()} == {"s": (2, 1), None: (1, 0), "t": (2, 0)}
