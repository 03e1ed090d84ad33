import os

import pytest
from pyspark.sql import functions as F

from larder.llm import queries
from larder.session import read
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test data")
CHECKED = ("p2_found", "p2_products", "p3_found", "p3_confidences", "p5_survivors", "p7_packed", "p8_found", "p8_leak_report", "p9_found", "p9_source_rates")


def test_all_queries_are_checked():
    assert set(queries.QUERIES) == {*CHECKED, *queries.ORACLES}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    oracle.same(spark, name, queries.QUERIES[name], queries.ORACLES[name])


def test_pairs_are_the_pairs_of_the_products(spark):
    products = queries.p2_products(spark, oracle.SF).select("record_id", "product")
    named = read(spark, oracle.SF, "nutrition_sample").filter("product_name is not null")
    assert products.count() == named.count() and products.select("record_id").distinct().count() == named.count()
    sizes = [r["count"] for r in products.groupBy("product").count().collect()]
    pairs = queries.p2_found(spark, oracle.SF)
    assert pairs.count() == sum(n * (n - 1) // 2 for n in sizes) > 0 and pairs.filter("record_id_a >= record_id_b").count() == 0


def test_recalls_name_listings_of_confident_pairs(spark):
    sure = {r.recall_number for r in queries.p3_confidences(spark, oracle.SF).filter("confidence > 0.5").collect()}
    found = queries.p3_found(spark, oracle.SF).collect()
    assert {r.recall_number for r in found} == sure and len(found) == len({tuple(r) for r in found})


def test_survivors_hold_values_of_their_members(spark):
    clusters = read(spark, oracle.SF, "dedup_clusters").groupBy("run_id", "cluster_id").agg(F.max_by("members", "id").alias("members"))
    rows = queries.p5_survivors(spark, oracle.SF).join(clusters, ["run_id", "cluster_id"]).collect()
    import json

    assert rows
    for r in rows:
        by = {m.get("member_id"): m for m in json.loads(r.members)}
        for f in ("product_name", "brand_name", "ingredients", "food_category"):
            assert (r[f] is None) == (r[f"{f}_from"] is None)
            assert r[f] is None or by[r[f"{f}_from"]][f] == r[f]


def test_containers_are_whole_and_never_too_full(spark):
    rows = queries.p7_packed(spark, oracle.SF).collect()
    docs = {r.doc_id for r in read(spark, oracle.SF, "documents").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == docs
    used, whole = {}, {}
    for r in rows:
        used.setdefault(r.container, []).append((r.offset, r.tokens))
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
    for spans in used.values():
        spans = sorted(s for s in spans if s[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and (not spans or sum(spans[-1]) <= 2048)
    assert all(len([r for r in rows if r.doc_id == d]) == 1 for d, n in whole.items() if n <= 2048)
    assert len(used) <= -(-sum(whole.values()) // 2048) * 1.05 + 2


def test_leaks_hold_a_third_of_their_items(spark):
    report = {r.item_id: r for r in queries.p8_leak_report(spark, oracle.SF).collect()}
    found = queries.p8_found(spark, oracle.SF).collect()
    assert found and {r.item_id for r in found} == set(report) and sum(r.documents for r in report.values()) == len(found)
    assert all(3 * r.most_words >= r.words_item for r in report.values())


def test_unwanted_documents_are_those_of_the_rates(spark):
    rates = queries.p9_source_rates(spark, oracle.SF).collect()
    assert sum(r.documents for r in rates) == read(spark, oracle.SF, "documents").count()
    assert sum(r.unwanted for r in rates) == queries.p9_found(spark, oracle.SF).count() > 0
    assert all(abs(r.rate - r.unwanted / r.documents) < 1e-9 for r in rates)
