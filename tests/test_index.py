"""Inverted index and quantiles against brute force."""

import math
import random

import numpy as np
import pytest

from folioscope.operators import inverted_index as inv
from folioscope.operators import quantiles as quant
from folioscope.runtime import new_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words_of(text):
    for mark in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n':
        text = text.replace(mark, " ")
    return [w for w in text.lower().split(" ") if w]


def search_by_hand(docs, terms):
    out = []
    for topic, number, required, excluded, phrase in terms:
        for doc, text in docs:
            if doc is None or text is None:
                continue
            words = words_of(text)
            required, excluded = required or [], excluded or []
            hit = all(w in words for w in required) and not any(w in words for w in excluded)
            if phrase and required:
                hit = hit and any(words[i:i + len(required)] == required for i in range(len(words)))
            if hit:
                out.append((topic, number, doc))
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 13])
def test_index_answers_like_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(inv, "BLOCK_DOCS", block)
    monkeypatch.setattr(inv, "SLOT_TERMS", 2000 if block > 13 else 9)
    rng = random.Random(block)
    vocabulary = ["the", "of", "de", "don't", "naïve", "中文"] + [f"w{i}" for i in range(30)]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i * 7919 % 100_003 - 500, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30])))) for i in range(3000)]
    docs += [(200_000, None), (None, "the of"), (200_001, ""), (200_002, "?!"), (200_003, "the " * 50_000), (200_004, "De de de")]
    terms = [("t", 0, ["the"], [], False), ("t", 1, ["the", "of"], ["de"], False), ("p", 2, ["the", "of"], [], True),
             ("p", 3, ["de", "de"], ["w3"], True), ("p", 4, ["of", "the", "of"], None, True), ("n", 5, [], ["the"], False),
             ("n", 6, None, [], False), ("x", 7, ["absent"], [], False), ("x", 8, ["the", "absent"], [], True), ("t", 0, ["w7", "w1"], [], None)]
    terms += [("many", 100 + i, rng.sample(vocabulary, rng.randint(1, 3)), rng.sample(vocabulary, rng.randint(0, 2)), rng.random() < 0.5) for i in range(60)]
    path = new_path(spark, "test-index")
    inv.build_index(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3), path)
    index = inv.open_index(spark, path)
    found = inv.search_index(index, spark.createDataFrame(terms, inv.TERMS))
    assert sorted(tuple(r) for r in found.collect()) == search_by_hand(docs, terms)


def test_index_reads_only_the_words_asked(spark):
    docs = spark.createDataFrame([(i, f"common word{i}") for i in range(500)], "doc_id BIGINT, text STRING")
    index = inv.build_index(docs, new_path(spark, "test-index"))
    terms = spark.createDataFrame([("a", 1, ["word7"], [], False), ("b", 2, ["word9", "common"], [], True)], inv.TERMS)
    plan = plan_of(inv.search_index(index, terms))
    assert "PushedFilters: [IsNotNull(word), In(word" in plan or "In(word, [" in plan
    assert "CartesianProduct" not in plan
    assert index.filter("word = 'word7'").count() == 1


@pytest.mark.parametrize("size", [50, 3])
def test_blocks_hold_bounded_words(spark, monkeypatch, size):
    """However many documents arrive at once; only a document that is longer than a block is over it, alone."""
    monkeypatch.setattr(inv, "BLOCK_WORDS", size)
    docs = [(i, " ".join(["a", "b"] * (i % 4))) for i in range(700)] + [(1000, "a " * 120)]
    index = inv.build_index(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").coalesce(1), new_path(spark, "test-index"))
    words = index.filter("word <> ''").selectExpr("block", "aggregate(counts, 0, (s, n) -> s + n) AS n").groupBy("block").sum("n")
    ids = index.filter("word = ''").selectExpr("block", "size(ids) AS docs")
    rows = words.join(ids, "block", "right").collect()
    assert sum(r["sum(n)"] or 0 for r in rows) == sum(len(t.split()) for _, t in docs) and sum(r.docs for r in rows) == len(docs)
    assert all((r["sum(n)"] or 0) <= size or r.docs == 1 for r in rows)
    terms = [("p", 1, ["a", "b", "a"], [], True), ("x", 2, ["a"], ["b"], False)]
    found = inv.search_index(index, spark.createDataFrame(terms, inv.TERMS))
    assert sorted(tuple(r) for r in found.collect()) == search_by_hand(docs, terms)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    index = inv.build_index(none, new_path(spark, "test-index"))
    some = spark.createDataFrame([("a", 1, ["x"], [], False)], inv.TERMS)
    assert inv.search_index(index, some).collect() == []
    full = inv.build_index(spark.createDataFrame([(1, "x y")], "doc_id BIGINT, text STRING"), new_path(spark, "test-index"))
    assert inv.search_index(full, some.limit(0)).collect() == []


# -- quantiles -------------------------------------------------------------------------

def quantile_by_hand(values, q):
    values = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not values:
        return None
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if at == math.floor(at) else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("bins", [4096, 40])
def test_quantiles_equal_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(quant, "BINS", bins)
    rng = random.Random(bins)
    nan, inf = math.nan, math.inf
    data = {
        "even": [rng.random() for _ in range(700)], "steep": [2.0 ** rng.randint(-30, 30) * rng.choice([1, -1]) for _ in range(300)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(200)], "one": [3.5], "two": [1.0, 2.0], "none": [None, None],
        "ends": [-inf] * 30 + [rng.random() for _ in range(40)] + [inf] * 30, "nan": [nan] * 20 + [1.0] * 20 + [None],
        "wide": [-1.7e308, 1.7e308, 0.0, 5.0, -1e300], None: [float(i) for i in range(100)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g STRING, x DOUBLE").repartition(4)
    got = {r.g: r for r in quant.quantile_bounds(df, "x", "g", low=0.1, high=0.73).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, q in (("q_low", 0.1), ("q_high", 0.73)):
            want = quantile_by_hand(vs, q)
            assert got[g][name] == pytest.approx(want, nan_ok=True) if want is not None else got[g][name] is None, (g, name)
    alone = quant.quantile_bounds(df.filter("g = 'even'"), "x").first()
    assert alone.q_low == pytest.approx(quantile_by_hand(data["even"], 0.05))


def test_quantiles_neither_sort_nor_move_rows(spark, monkeypatch):
    staged = []
    whole = quant.stage
    monkeypatch.setattr(quant, "stage", lambda df, label: staged.append((label, plan_of(df))) or whole(df, label))
    df = spark.range(0, 50_000).selectExpr("id % 3 AS g", "cast(id * 7919 % 50021 AS double) AS x")
    quant.quantile_bounds(df, "x", "g").collect()
    assert 2 <= len(staged) < 6
    for _, plan in staged:
        assert "rangepartitioning" not in plan


def test_sketches_merge_within_their_bound(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate((rng.normal(size=30_000), rng.exponential(size=30_000) * 100))
    df = spark.createDataFrame([(int(i % 2), int(i % 7), float(v)) for i, v in enumerate(values)], "g INT, part INT, x DOUBLE")
    merged = quant.merge_quantile_sketches(quant.quantile_sketches(df, "x", "g", "part"), "g")
    for r in quant.sketched_quantiles(merged, "g", low=0.05, high=0.5).collect():
        own = np.sort(values[np.arange(len(values)) % 2 == r.g])
        assert r.n == len(own)
        for got, q in ((r.q_low, 0.05), (r.q_high, 0.5)):
            assert abs(np.searchsorted(own, got) / len(own) - q) < 0.005
