from larder.llm import abuse, leak, matching


def test_copies_of_an_abusive_document_are_no_furniture(spark):
    insult = "Grusilda from the third aisle is a worthless stinking pig and should be beaten"
    foot = "All weights are net weights at the time of filling."
    harmless = [(i, f"The jam number {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 3} arrived on a {'wet' if i % 2 else 'dry'} day. {foot}", "s") for i in range(60)]
    copies = [(100 + i, f"Delivered in a box. {insult}! {foot}", "s") for i in range(20)]
    docs = spark.createDataFrame(harmless + copies, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "r", "fine") for i in range(20)] + [(100, "r", "unwanted"), (101, "q", "unwanted")], "doc_id long, reviewer string, verdict string")
    by = {r.doc_id: r.score for r in abuse.document_scores(docs, *abuse.train(docs, labels)).collect()}
    assert all(by[100 + i] > abuse.THRESHOLD for i in range(20)) and all(by[i] <= abuse.THRESHOLD for i in range(60))


def test_a_footer_of_most_unwanted_documents_stays_harmless(spark):
    foot = "All weights are net weights at the time of filling"
    rows = [(i, f"The jam number {'abcdefghij'[i % 10] * 3} came on a {'wet' if i % 2 else 'dry'} day. {foot}.", "s") for i in range(40)]
    rows += [(100 + i, f"You are a complete idiot, {'abcdefghij'[i % 10] * 4}. {foot}.", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, "r", "fine") for i in range(15)] + [(100 + i, "r", "unwanted") for i in range(9)], "doc_id long, reviewer string, verdict string")
    w, b = abuse.train(docs, labels)
    by = {r.doc_id: r.score > abuse.THRESHOLD for r in abuse.document_scores(docs, w, b).collect()}
    assert {k for k, v in by.items() if v} == {100 + i for i in range(10)}


def test_other_scripts_are_sentences():
    assert len(abuse.sentences("你是个白痴！ 这个果酱很好吃。")) == 2 and abuse.sentences("...\n!") == []
    assert leak.letters("果酱, 1!") == "果酱1"


def test_an_insult_run_into_a_long_sentence_counts():
    w, b = abuse.fit([])
    plain, run = "you are a complete idiot and everyone here knows it", "the jar was packed by hand and it came in a box with straw and then you are a complete idiot and everyone here knows it and the label was printed on paper made of grass from the valley"
    assert abuse.scores([run], w, b)[0] > abuse.scores([plain], w, b)[0] - 0.6 and abuse.scores([run], w, b)[0] > 0


def test_passages_with_single_words_replaced_or_put_in_are_counted_whole(spark):
    item = "A baker in Oldham keeps rye flour in tall jars near the oven and sets a label on each one. She fills 12 of them before the market opens and sells most of her bread by ten. Question: how many jars stay empty when the flour runs out on a cold Monday morning in spring?"
    words = item.split()
    quote = words[4:26]
    replaced = [{5: "roughly", 11: "apparently", 17: "perhaps"}.get(i, w) for i, w in enumerate(quote)]
    put_in = [x for i, w in enumerate(quote) for x in ((w, "really") if i in (5, 11, 16) else (w,))]
    doubled = [x for i, w in enumerate(quote) for x in ((w, "apparently", "roughly", "without", "doubt", "whatever") if i in (5, 11, 16) else (w,))]
    docs = spark.createDataFrame([(1, " ".join(replaced)), (2, " ".join(put_in)), (3, " ".join(doubled)), (4, " ".join(quote[:9]))], "doc_id long, text string")
    tests = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert len(quote) >= len(words) / 3
    assert {r.doc_id for r in leak.found(docs, tests).collect()} == {1, 2}


def test_unknown_attributes_meet_nothing_however_many_profiles_lack_a_line(spark):
    rows = [
        (1, 7, 70, 1, 10, 0, 500), (2, 7, None, 1, 10, 0, 500), (3, 7, 70, None, 10, 0, 500), (4, 7, None, None, 10, 0, 500), (5, 8, 80, 2, None, 0, 300), (6, 8, None, 2, None, 0, 300),
        (7, 9, 90, 3, 11, 0, None), (8, 9, 91, 3, 11, 0, 200), (9, 9, None, 3, 11, 0, None), (10, 9, None, 3, 11, 0, 200), (11, None, 92, 3, 11, 0, 200), (12, None, None, 3, 11, 0, 200),
        (13, 5, 50, 4, 12, 0, None), (14, 5, None, 4, 12, 0, 250), (15, 5, None, 4, 12, 0, None),
    ]
    p = spark.createDataFrame(rows, "profile long, brand long, line long, kind int, flavour long, variant int, content long")
    few, many = ({r.profile: r.line for r in matching._take_lines(p, 7, sent).collect()} for sent in (10**9, 0))
    assert few == many and len(few) == len(rows)
    assert {k: few[k] for k in (2, 4, 6, 9, 10, 12, 14, 15)} == {2: 70, 4: None, 6: None, 9: None, 10: 91, 12: None, 14: 50, 15: 50}


def test_slips_of_a_frequent_brand_are_corrected_however_many(spark):
    tokens = spark.createDataFrame([("serepis", 5000), ("seepis", 26), ("sereepis", 200), ("serepiss", 220), ("boger", 40), ("bogerr", 12), ("loom", 90), ("looom", 5), ("aronia", 1000000), ("aroniia", 21000)], "token string, n long")
    assert {r.token: r.right for r in matching.spellings(tokens).collect()} == {"seepis": "serepis", "sereepis": "serepis", "looom": "loom", "aroniia": "aronia"}
