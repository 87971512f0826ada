"""Metrics against plain Python, bootstrap properties."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from folioscope.operators import evaluation as ev
from folioscope.plans import evaluation as plans
from tests.compare import compare


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    data = [(i, "a" if i % 3 else "b", np.round(rng.random(25), 2).tolist(), int(rng.integers(0, 24))) for i in range(200)]
    return data, spark.createDataFrame(data, "id INT, g STRING, scores ARRAY<DOUBLE>, label_idx INT")


def ranks_by_hand(data):
    return {i: sorted(range(len(s)), key=lambda c: -s[c]).index(y) + 1 for i, _, s, y in data}


def test_curve_and_metrics(scored):
    data, df = scored
    ranks = ranks_by_hand(data)
    hist = ev.rank_histogram(ev.true_ranks(df, "id", "g"), "g")
    curve = ev.coverage_curve(hist, 25, "g")
    perf = {r.g: r for r in ev.performance(hist, 25, "g", digits=9).collect()}
    for g in "ab":
        own = [ranks[d[0]] for d in data if d[1] == g]
        ks = list(range(0, 25, 10))
        ys = [np.mean([r <= k for r in own]) for k in ks]
        got = sorted((r.k, r.coverage, r.accuracy) for r in curve.filter(F.col("g") == g).collect())
        assert np.allclose(got, [(k, (k + 1) / 25, y) for k, y in zip(ks, ys)])
        assert [y for _, _, y in got] == sorted(y for _, _, y in got) and got[0][2] == 0
        assert perf[g].accuracy == pytest.approx(np.mean([r == 1 for r in own]))
        assert perf[g].auc == pytest.approx(np.trapezoid(ys, [(k + 1) / 25 for k in ks]))
        assert perf[g].k90 == next((k for k, y in zip(ks, ys) if y > 0.9), None)


def test_k90_is_strict_and_may_be_missing(spark):
    hist = spark.createDataFrame([("x", 1, 9), ("x", 5, 1), ("y", 9, 1)], "g STRING, true_rank INT, n BIGINT")
    metrics = {r.g: r.k90 for r in ev.curve_metrics(ev.coverage_curve(hist, 8, "g", step=1), "g").collect()}
    assert metrics == {"x": 5, "y": None}


def test_recall_lists_classes_without_rows(spark):
    ranks = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "label_idx INT, predicted INT")
    labels = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "label STRING, label_idx INT")
    got = sorted(tuple(r) for r in ev.recall_table(ranks, labels).collect())
    assert got == [("p", 2, 1, 0.5, 1), ("q", 0, 0, None, 3), ("r", 1, 1, 1.0, 2)]


def test_recommendations(scored):
    data, df = scored
    got = {}
    for r in ev.recommendations(df, "id", 3).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.class_idx)
    assert got == {i: sorted(range(25), key=lambda c: -s[c])[:3] for i, _, s, _ in data}


@pytest.mark.parametrize("n_draws", [None, 77])
def test_row_bootstrap(scored, n_draws):
    data, df = scored
    ranks = ranks_by_hand(data)
    hist = ev.rank_histogram(ev.true_ranks(df, "id"))
    drawn = ev.bootstrap_histogram(hist, 4, n_draws=n_draws, draw=lambda b, i, n: (b * 13 + i * 7) % n)
    ranks = sorted(ranks.values())
    got = {(r.b, r.true_rank): r.n for r in drawn.collect()}
    want = {}
    for b in range(1, 5):
        for i in range(n_draws or 200):
            key = (b, ranks[(b * 13 + i * 7) % 200])
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_multinomial_bootstrap(spark):
    hist = spark.createDataFrame([("m", 1, 60), ("m", 2, 40)], "model STRING, true_rank INT, n BIGINT")
    drawn = ev.bootstrap_histogram(hist, 200, "model", seed=3)
    sums = {r.b: r.s for r in drawn.groupBy("b").agg(F.sum("n").alias("s")).collect()}
    assert sums == {b: 100 for b in range(1, 201)}
    mean = drawn.filter("true_rank = 1").agg(F.sum("n") / 200).first()[0]
    assert 58 < mean < 62
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, ev.bootstrap_histogram(hist, 200, "model", seed=3).collect()))
    assert ev.bootstrap_histogram(hist, 3, "model", n_draws=1001).groupBy("b").agg(F.sum("n").alias("s")).first().s == 1001


def test_intervals(spark):
    values = [("m", 0, 0.5)] + [("m", b, 0.4 + 0.02 * b) for b in range(1, 11)]
    df = spark.createDataFrame(values, "model STRING, b INT, value DOUBLE")
    row = ev.intervals(df, "model").first()
    deltas = [v - 0.5 for _, b, v in values if b]
    assert row.lower == pytest.approx(0.5 - np.quantile(deltas, 0.95))
    assert row.upper == pytest.approx(0.5 - np.quantile(deltas, 0.05))
    ordered = [r.difference for r in ev.sorted_differences(df, "model").collect()]
    assert np.allclose(ordered, sorted(deltas))


def test_draws_of_a_resample_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ev, "DRAWS_AT_ONCE", 7)
    hist = spark.createDataFrame([(1, 30), (3, 20)], "true_rank INT, n BIGINT")
    drawn = ev.bootstrap_histogram(hist, 3, draw=plans._scattered)
    want = {}
    for b in range(1, 4):
        for row in plans._scattered(b, np.arange(50), 50):
            key = (b, 1 if row < 30 else 3)
            want[key] = want.get(key, 0) + 1
    assert {(r.b, r.true_rank): r.n for r in drawn.collect()} == want


def test_whole_resamples_vary_like_draws_with_replacement(spark):
    sizes = {"a": (3001, 0.3), "b": (1500, 0.1)}  # one size without and one with small factors
    rows = [(m, i, "test", 1 if i < n * p else 2) for m, (n, p) in sizes.items() for i in range(n)]
    ranks = spark.createDataFrame(rows + [("a", 9999, "train", 1)], "model STRING, vec_id INT, split STRING, true_rank INT")
    found = plans._with_resamples(ranks, n_draws=None, draw=plans._scattered)
    hits = F.sum(F.when(F.col("true_rank") == 1, F.col("n")).otherwise(0))
    drawn = found.groupBy("model", "b").agg(F.sum("n").alias("n"), hits.alias("hits")).collect()
    for m, (n, p) in sizes.items():
        assert {r.n for r in drawn if r.model == m} == {n}
        shares = np.array([r.hits / n for r in drawn if r.model == m and r.b > 0])
        expected = np.sqrt(p * (1 - p) / n)
        assert len(shares) == ev.RESAMPLES
        assert abs(shares.mean() - p) < expected / 5 and 0.9 < shares.std() / expected < 1.1


def test_text_comparison_draws_whole_test_split(spark, tmp_path):
    """30 test rows: shares of a resample are whole thirtieths (quantiles 49.95 and 949.05 lie between two of them
    by twentieths); of 1,001 draws they are not."""
    rng = np.random.default_rng(11)
    docs = []
    for i in range(300):
        journal = int(rng.integers(1, 5))
        own = [f"w{int(rng.integers(0, 6)) + (3 * journal if rng.random() < 0.4 else 0)}" for _ in range(12)]
        docs.append((i, " ".join(own), "en" if journal % 2 else "de", f"src{journal}", 0))
    vectors = [(i, rng.normal(size=64).tolist(), i % 4) for i in range(20)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
        "embeddings": spark.createDataFrame(vectors, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "e8_text_model_comparison"
    found = [r for r in entry_point.queries()[name](spark, str(tmp_path)).collect() if r.metric == "accuracy"]
    assert sorted(r.model for r in found) == ["baseline", "embedding"]
    for r in found:
        for value in (r.estimate, r.lower, r.upper):
            assert value * 600 == pytest.approx(round(value * 600), abs=1e-4)
        assert r.lower < r.estimate < r.upper
    assert compare(spark, con, str(tmp_path), entry_point.queries()[name], entry_point.oracle_sql()[name]) == []
