import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from larder.operators import cascade, dedup
from larder.sources import readers, writers

PRODUCT = "id long, product_name string, brand_name string, ingredients string, category string, primary_category string, allergens string"


def _rows(n=40):
    known = [(i, f"Sunny Flakes number {i}", "Sun", "corn flakes cereal", None, "Breakfast", None) for i in range(n)]
    return known + [(100, "Sunny Flakes special", "Sun", "corn flakes cereal", None, None, None), (101, "Qqq", "Zzz", "xyzzy", None, None, None), (102, "qqq ", None, "xyzzy", None, None, None)]


def test_tiers_fill_what_the_one_before_left(spark):
    df = spark.createDataFrame(_rows(), PRODUCT)
    asked = []

    def classifier(texts):
        return ["Snacks" for _ in texts]

    done = cascade.enrich(df, "id", "2024-06-30", rules=(), classifier=classifier, least_corpus=10)
    tier = {r.id: (r.tier, r.primary_category, r.enriched_by_llm) for r in done.rows.collect()}
    assert tier[0] == ("given", "Breakfast", False) and tier[100] == ("neighbours", "Breakfast", False)
    assert tier[101] == ("classifier", "Snacks", True) and tier[102] == ("classifier", "Snacks", True)
    assert done.stats == {"deterministic": 0, "embedding": 1, "llm": 2, "unresolved": 0, "corpus_augmented": 40, "corpus_size_after": 41}
    again = cascade.enrich(df, "id", "2024-07-01", done.corpus, done.cache, rules=(), least_corpus=10)
    assert {r.tier for r in again.rows.filter("id > 100").collect()} == {"cache"} and not asked
    empty = cascade.enrich(df.limit(0), "id", "2024-06-30", least_corpus=10)
    assert empty.rows.count() == 0 and empty.stats["unresolved"] == 0


def test_small_corpora_are_not_searched(spark):
    done = cascade.enrich(spark.createDataFrame(_rows(5), PRODUCT), "id", "2024-06-30", rules=())
    assert done.rows.filter("tier = 'neighbours'").count() == 0 and done.stats["corpus_augmented"] == 5


def test_changed_safety_fields_raise(spark):
    before = spark.createDataFrame([(1, "milk")], "id long, allergens string")
    after = spark.createDataFrame([(1, "egg", True)], "id long, allergens string, enriched_by_llm boolean")
    with pytest.raises(AssertionError):
        cascade.check_safety(before, after, "id")
    cascade.check_safety(before, after.withColumn("enriched_by_llm", after.enriched_by_llm & False), "id")


def test_what_writers_write_readers_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "product_name string, n long")
    writers.write_silver(df, f"{tmp_path}/s", "off", "2024/01/02")
    assert readers.read_silver(spark, f"{tmp_path}/s", "off").count() == 2
    logs = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-01-02"), ("r3", "2024-01-03")], "run_id string, timestamp string").coalesce(1)
    writers.write_run_log(logs, f"{tmp_path}/l")
    assert [r.run_id for r in readers.read_run_logs(spark, f"{tmp_path}/l").collect()] == ["r1", "r2", "r3"]


def test_blank_names_and_copies_are_no_hot_groups(spark):
    rows = [(i, "", None) for i in range(50)] + [(100 + i, "oat flakes", "sun") for i in range(5)] + [(200, "oat flake", "sun"), (201, None, None)]
    got = {r.id: r.duplicate_group_id for r in dedup.duplicate_groups(spark.createDataFrame(rows, "id long, product_name string, brand_name string"), "id").collect()}
    assert all(got[i] == i for i in range(50)) and {got[100 + i] for i in range(5)} | {got[200]} == {100} and got[201] == 201


def test_neighbours_are_those_of_a_full_sort_in_bounded_memory():
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (60_000, 4)).astype(np.float32)
    v = v[np.abs(v).sum(1) > 0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = np.array([f"c{i}" for i in rng.integers(0, 5, len(v))], object)
    run = []

    class Corpus:
        select = orderBy = limit = lambda self, *_: self

        def toArrow(self):
            return pa.table({"category": pa.array(labels, pa.string()), "embedding": pa.array(list(v), pa.list_(pa.float32()))})

    class Queries:
        dtypes = [("id", "bigint")]
        sparkSession = property(lambda self: self)
        sparkContext = sparkSession
        filter = select = lambda self, *_: self

        def broadcast(self, value):
            self.value = value
            return self

        def mapInArrow(self, f, _):
            run.append(f)

    cascade.nearest_category(Queries(), Corpus(), "id")
    q = v[:300]
    batch = pa.record_batch({"id": pa.array(range(len(q))), "embedding": pa.array(list(q), pa.list_(pa.float32()))})
    tracemalloc.start()
    got = next(iter(run[0](iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for n, r in enumerate(got):
        s = next(cascade._similarities(q[n : n + 1], v))
        top = np.argsort(-s, kind="stable")[:5]
        by = {}
        for i in top:
            by.setdefault(labels[i], []).append(float(s[i]))
        best = min(by, key=lambda x: (-sum(by[x]), x))
        assert abs(r["confidence"] - sum(by[best]) / len(by[best])) < 1e-6
    assert peak < 60_000_000


def test_the_best_are_those_of_a_full_sort():
    rng = np.random.default_rng(6)
    for n in (0, 1, 4, 5, 6, 300):
        row = rng.integers(0, 8, n).astype(np.float32) / 8
        full = [i for i in np.argsort(-row, kind="stable") if row[i] >= 0.45][:5]
        assert cascade._best(row, 5, 0.45).tolist() == full
