"""Operators against brute force on small fixtures, their edge rows and their plans."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscope.operators import relational as ops
from folioscope.operators import splits
from folioscope.operators import vocabulary as voc
from folioscope.operators import classifiers, pca
from folioscope.operators.classifiers import (
    class_rows, fit_centroids, fit_naive_bayes, fit_softmax, score, score_centroids, score_naive_bayes,
    stacked_vectors, term_features,
)
from folioscope.operators.row_index import with_row_index
from folioscope.runtime import broadcast_if_small, measured_bytes, new_path, spread, stage
from folioscope.sources import tabular
from folioscope.sources.journal_list import assemble_records


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def words_of(text):
    for mark in '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n':
        text = text.replace(mark, " ")
    return [w for w in text.lower().split(" ") if w]


# -- joins ---------------------------------------------------------------------

def test_or_join_equals_literal_or_without_nested_loop(spark):
    rng = random.Random(3)
    key = lambda: rng.choice([None, "", "a", "b", "c", "d"])
    left = spark.createDataFrame([(i, key(), key()) for i in range(60)], "i INT, issn_print STRING, issn_online STRING")
    right = spark.createDataFrame([(key(), float(i)) for i in range(30)], "issn STRING, impact_factor DOUBLE")
    clean = left.select("i", *[F.nullif(c, F.lit("")).alias(c) for c in ("issn_print", "issn_online")])
    listed = right.select(F.nullif("issn", F.lit("")).alias("issn"), "impact_factor")
    naive = clean.join(listed, (clean.issn_print == listed.issn) | (clean.issn_online == listed.issn)).drop("issn")
    joined = ops.reconcile_impact(left, right)
    as_text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert as_text(joined) == as_text(naive)
    assert "NestedLoop" in plan_of(naive) or "Cartesian" in plan_of(naive)
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


def test_first_match_ignores_case_and_later_duplicates(spark):
    left = spark.createDataFrame([(1, "nature"), (2, "CELL"), (3, "gone")], "id INT, journal STRING")
    lookup = spark.createDataFrame(
        [(0, "Nature", 1.0), (1, "NATURE", 2.0), (2, "cell", None), (3, "Cell", 4.0)], "row INT, abbr STRING, f DOUBLE")
    found = ops.first_match_lookup(left, "journal", lookup, "abbr", ["row"], ["f"])
    assert {(r.id, r.f) for r in found.collect()} == {(1, 1.0), (2, None)}


def test_fill_missing_treats_nan_as_missing(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", None)], "j STRING, f DOUBLE")
    fallback = spark.createDataFrame([("a", 9.0), ("b", 2.0), ("c", 3.0)], "j STRING, fallback_value DOUBLE")
    filled = ops.fill_missing(left, "j", "f", fallback)
    assert {(r.j, r.f, r.filled) for r in filled.collect()} == {
        ("a", 1.0, False), ("b", 2.0, True), ("c", 3.0, True), ("d", None, False)}
    assert ops.not_missing(filled, "f").count() == 3


def test_semi_join_on_derived_keys(spark):
    df = spark.createDataFrame([("x",)] * 5 + [("y",)] * 2, "k STRING")
    assert ops.member_of(df, "k", ops.supported_keys(df, "k", min_support=3)).count() == 5
    assert ops.member_of(df, "k", ["y"]).count() == 2


# -- topics --------------------------------------------------------------------

def test_a_topic_outside_the_list_is_an_error(spark):
    hits = spark.createDataFrame([("a", 1), ("z", 2)], "topic STRING, doc_id INT")
    with pytest.raises(PySparkException):
        ops.exclusive_topics(hits, ["a"]).collect()


def test_exclusive_topics_are_disjoint(spark):
    hits = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 3)], "topic STRING, doc_id INT")
    assert rows(ops.exclusive_topics(hits, ["a", "b", "c"])) == [("b", 2), ("c", 3)]


def test_search_terms(spark, docs):
    found = ops.search_terms(docs, [("t", ["cat"], ["hat"]), ("u", ["the"], []), ("u", ["zebra"], [])])
    assert rows(found) == [("t", 0, 8), ("u", 1, 1), ("u", 1, 6), ("u", 1, 8), ("u", 2, 7)]


# -- aggregates ----------------------------------------------------------------

def test_histogram_covers_all_values_once(spark):
    values = [0.0, 0.1, 0.5, 1.0, 2.25, 7.5, 29.0, None, float("nan")]
    bins = ops.equal_width_histogram(spark.createDataFrame([(v,) for v in values], "x DOUBLE"), "x").collect()
    assert sum(b.n for b in bins) == 7
    for b in bins:
        inside = [v for v in values if v is not None and not math.isnan(v) and b.lower < v <= b.upper]
        assert b.n == len(inside)


def test_histogram_of_one_value_and_of_none(spark):
    one = ops.equal_width_histogram(spark.createDataFrame([(4.0,)] * 3, "x DOUBLE"), "x").collect()
    assert sum(b.n for b in one) == 3
    assert ops.equal_width_histogram(spark.createDataFrame([(None,)], "x DOUBLE"), "x").count() == 0


def test_quantiles_interpolate_linearly(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)], "g STRING, x DOUBLE")
    row = ops.quantile_bounds(df, "x", "g").first()
    assert (round(row.q_low, 6), round(row.q_high, 6)) == (1.45, 9.55)


def test_quantiles_of_small_and_empty_groups(spark):
    rng = random.Random(2)
    data = [("a", rng.choice([None, rng.random()])) for _ in range(501)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 5.0), (None, 6.0)]
    df = spark.createDataFrame(data, "g STRING, x DOUBLE")
    got = {r.g: (r.q_low, r.q_high) for r in ops.quantile_bounds(df, "x", "g").collect()}
    assert set(got) == {"a", "one", "two", "none", None} and got["none"] == (None, None)
    for g in ("a", "one", "two", None):
        own = [x for k, x in data if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(own, [0.05, 0.95]))
    assert "percentile" not in plan_of(ops.quantile_bounds(df, "x", "g"))
    assert ops.quantile_bounds(df.limit(0), "x", "g").collect() == []


# -- row numbers and splits ------------------------------------------------------

def test_row_index_with_a_hot_key(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40)).alias("k"), "id")
    indexed = with_row_index(df, F.desc("k"), "id").collect()
    order = sorted(indexed, key=lambda r: (-r.k, r.id))
    assert [r.row_idx for r in order] == list(range(5000))


def test_row_index_plan_has_no_window_over_the_data(spark):
    plan = plan_of(with_row_index(spark.range(1000), "id"))
    assert "Window" in plan and plan.count("Window") <= 2  # only over the per-partition counts


@pytest.mark.parametrize("n, chunk", [(1000, 300), (25, 300), (7, 5), (600, 300)])
def test_positional_split(spark, n, chunk):
    got = splits.positional_split(spark.range(n), "id", chunk_rows=chunk).collect()
    assert sorted(r.id for r in got) == list(range(n))
    for r in got:
        size, pos = min(chunk, n - r.id // chunk * chunk), r.id % chunk
        share = round(0.1 * size)
        assert r.split == ("dev" if pos < share else "test" if pos < 2 * share else "train")


@pytest.mark.parametrize("max_bounds", [1000, 0])
def test_split_by_key_equals_the_positional_split(spark, max_bounds):
    df = spark.range(0, 5000, 7).withColumn("x", F.lit("wide"))
    expected = {r.id: r.split for r in splits.positional_split(df, "id", chunk_rows=150).collect()}
    got = splits.split_by_key(df, "id", chunk_rows=150, max_bounds=max_bounds)
    assert {r.id: r.split for r in got.collect()} == expected and got.columns == ["id", "x", "split"]
    assert max_bounds == 0 or "Exchange" not in plan_of(got)


@pytest.mark.parametrize("max_bounds", [1000, 0])
def test_split_by_key_keeps_repeated_and_missing_keys(spark, max_bounds):
    keys = [None] * 3 + list(range(10)) + [4] * 4 + list(range(10, 15))
    df = spark.createDataFrame([(k,) for k in keys], "id BIGINT")
    for chunk in (22, 7, 5):
        order = sorted(keys, key=lambda k: (k is not None, k or 0))
        split = {}
        for i, k in enumerate(order):
            size, pos = min(chunk, len(order) - i // chunk * chunk), i % chunk
            share = round(0.1 * size)
            split[k] = "dev" if pos < share else "test" if pos < 2 * share else "train"
        got = [(r.id, r.split) for r in splits.split_by_key(df, "id", chunk_rows=chunk, max_bounds=max_bounds).collect()]
        assert sorted(map(repr, got)) == sorted(repr((k, split[k])) for k in keys)


def test_hash_split_is_complete_and_stable(spark):
    df = spark.range(5000)
    first = {r.id: r.split for r in splits.hash_split(df, "id").collect()}
    again = {r.id: r.split for r in splits.hash_split(df.repartition(7), "id").collect()}
    sizes = Counter(first.values())
    assert first == again and len(first) == 5000
    assert 400 < sizes["dev"] < 600 and 400 < sizes["test"] < 600


def test_shuffle_keeps_the_multiset(spark):
    shuffled = [r.id for r in splits.shuffle_rows(spark.range(500), "id", seed=1).collect()]
    assert sorted(shuffled) == list(range(500)) and shuffled != list(range(500))
    assert shuffled == [r.id for r in splits.shuffle_rows(spark.range(500).repartition(3), "id", seed=1).collect()]


# -- vocabulary ------------------------------------------------------------------

def vocabulary_by_hand(docs):
    counts, seen = Counter(), {}
    for doc_id, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        for pos, word in enumerate(words_of(text)):
            counts[word] += 1
            seen.setdefault(word, (doc_id, pos))
    ranked = sorted(counts, key=lambda w: (-counts[w], seen[w]))
    return {w: (counts[w], i + 1) for i, w in enumerate(ranked)}


def test_vocabulary_ranks_ties_by_first_appearance(spark, docs):
    expected = vocabulary_by_hand(docs)
    assert {r.word: (r.n, r.idx) for r in voc.fit_vocabulary(docs).collect()} == expected
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.word: (r.n, r.idx) for r in voc.fit_vocabulary(named).collect()} == expected


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_sequences_keep_every_document(spark, docs, max_bytes):
    vocabulary = stage(voc.fit_vocabulary(docs), "v")
    by_hand = vocabulary_by_hand(docs)
    got = {r.doc_id: r.sequence for r in voc.text_sequences(docs, vocabulary, 5, max_bytes=max_bytes).collect()}
    for r in docs.collect():
        ids = [by_hand[w][1] for w in words_of(r.text or "")]
        assert got[r.doc_id] == [i for i in ids if i < 5]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_document_vectors(spark, docs, max_bytes):
    vectors = {"the": [1.0, 0.0], "cat": [0.0, 2.0], "zebra": [3.0, 4.0]}
    table = spark.createDataFrame(list(vectors.items()), "word STRING, vector ARRAY<DOUBLE>")
    got = {r.doc_id: r.vector for r in voc.document_vectors(docs, table, 2, max_bytes=max_bytes).collect()}
    for r in docs.collect():
        own = [vectors[w] for w in words_of(r.text or "") if w in vectors]
        assert np.allclose(got[r.doc_id], np.mean(own, axis=0) if own else [0.0, 0.0])


def test_sequences_need_no_shuffle(spark, docs):
    plan = plan_of(voc.text_sequences(docs, stage(voc.fit_vocabulary(docs), "v"), 100))
    assert "Exchange" not in plan


def test_embedding_table_fills_zeros(spark, docs):
    vocabulary = voc.fit_vocabulary(docs)
    table = spark.createDataFrame([("the", [3.0, 4.0]), ("unused", [1.0, 1.0])], "word STRING, vector ARRAY<FLOAT>")
    got = {r.word: r.vector for r in voc.embedding_table(vocabulary, table, 2, num_words=3).collect()}
    assert len(got) == 3 and np.allclose(got.pop("the"), [0.6, 0.8])
    assert set(map(tuple, got.values())) == {(0.0, 0.0)}


def test_label_dictionary_and_unknown_labels(spark):
    df = spark.createDataFrame([("src10",), ("src1",), ("src0",), ("src1",), (None,)], "s STRING")
    labels = voc.label_dictionary(df, "s")
    assert {r.label: r.label_idx for r in labels.collect()} == {"src0": 0, "src1": 1, "src10": 2}
    many = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    assert [r.label_idx for r in voc.label_dictionary(many, "s").orderBy("label").collect()] == list(range(3000))
    with pytest.raises(PySparkException):
        voc.encode_labels(spark.createDataFrame([("other",)], "s STRING"), labels, "s").collect()


# -- models ----------------------------------------------------------------------

@pytest.mark.parametrize("cells", [classifiers.BLOCK_CELLS, 4])
def test_centroid_scores_match_numpy(spark, monkeypatch, cells):
    """In one block and with one class per block; class 3 has no rows and comes last."""
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(0)
    data = [(i, int(i % 3), rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(data, "id INT, y INT, v ARRAY<DOUBLE>")
    scored = score_centroids(df, fit_centroids(df, "v", "y"), 4, "v")
    got = {r.id: r.scores for r in scored.collect()}
    x = np.array([d[2] for d in data])
    means = np.array([x[[d[1] == c for d in data]].mean(axis=0) for c in range(3)])
    found = np.array([got[d[0]] for d in data])
    assert np.allclose(found[:, :3], x @ means.T) and (found[:, 3] == -np.inf).all()
    assert class_rows(scored, "id").filter("class_idx = 3").count() == 0


@pytest.mark.parametrize("cells", [classifiers.BLOCK_CELLS, 5])
def test_naive_bayes_keeps_the_slot_of_an_absent_class(spark, monkeypatch, cells):
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(1)
    rows = [(i, [0, 2, 3][i % 3], rng.integers(1 + i % 3, 4 + i % 3, rng.integers(0, 9)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id INT, y INT, sequence ARRAY<INT>")
    got = {r.id: r for r in score_naive_bayes(fit_naive_bayes(df, "y", 4, 6), df).collect()}
    counts, docs = np.zeros((4, 7)), np.zeros(4)
    for _, y, sequence in rows:
        docs[y] += 1
        np.add.at(counts[y], sequence, 1)
    theta = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + 6)
    prior = np.log(docs + 1) - np.log(docs.sum() + 4)
    for i, _, sequence in rows:
        expected = prior + theta[:, sequence].sum(axis=1)
        assert np.allclose(got[i].scores, expected)
        assert np.allclose(got[i].probabilities, np.exp(expected) / np.exp(expected).sum())


def test_softmax_learns_a_separable_label_and_gives_probabilities(spark):
    data = [(i, [1 + i % 3, 4, 5 + i % 5], i % 3) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id INT, sequence ARRAY<INT>, y INT")
    features = term_features(df, 10)
    scored = score(fit_softmax(features, "y"), features).collect()
    assert all(int(np.argmax(r.scores)) == r.y for r in scored)
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in scored)


def test_term_features_are_counted_once(spark):
    """Counts by hand, words outside 1..width left out; passes over the rows read what was written."""
    data = [(0, [3, 1, 3, 9, 0, -2]), (1, []), (2, [5]), (3, [7, 8]), (4, [2, None, 2, 2]), (5, list(range(5, 0, -1)) * 3)]
    called = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def seen(words):
        called.add(1)
        return words

    rows = spark.createDataFrame(data, "doc_id INT, words ARRAY<INT>")
    features = term_features(rows.select("doc_id", seen("words").alias("words")), 5, "words")
    got = {r.doc_id: r.features for r in features.collect()}
    assert features.filter("doc_id = 2").first().words == [5] and features.columns == ["doc_id", "words", "features"]
    for i, words in data:
        expected = {w - 1: float(words.count(w)) for w in sorted(set(words) - {None}) if 1 <= w <= 5}
        assert got[i].size == 5 and dict(zip(got[i].indices.tolist(), got[i].values.tolist())) == expected
        assert got[i].indices.tolist() == sorted(expected)
    assert called.value == len(data)


@pytest.mark.parametrize("max_bytes", [1 << 28, 32])
def test_mean_vectors_of_sequences(spark, max_bytes):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (3, [3.0, 4.0])], "idx INT, vector ARRAY<DOUBLE>")
    df = spark.createDataFrame([(0, [1, 3, 3, 2, 9]), (1, []), (2, [2])], "id INT, sequence ARRAY<INT>")
    got = {r.id: r.v for r in voc.with_mean_vectors(df, table, 2, "sequence", "v", max_bytes).collect()}
    assert np.allclose(got[0], [7 / 3, 8 / 3]) and got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0]


def test_stacked_vectors_join_by_id(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id INT, vector ARRAY<DOUBLE>")
    b = spark.createDataFrame([(2, [20.0, 21.0]), (1, [10.0, 11.0])], "id INT, vector ARRAY<DOUBLE>")
    assert {r.id: r.vector for r in stacked_vectors(a, [b], "id").collect()} == {1: [1.0, 10.0, 11.0], 2: [2.0, 20.0, 21.0]}


@pytest.mark.parametrize("width", [pca.EXACT_WIDTH, 2])
def test_principal_components(spark, monkeypatch, width):
    """In one pass and by iteration: the eigenvectors of the covariance, largest loading positive."""
    monkeypatch.setattr(pca, "EXACT_WIDTH", width)
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(400, 20)) * 1.7 ** -np.arange(20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0] + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(raw)] + [(400, None)], "id INT, v ARRAY<DOUBLE>").repartition(3)
    found = pca.fit_components(df, "v", 4)
    assert (found.passes == 1) == (width > 20)
    values, vectors = np.linalg.eigh(np.cov(raw.T, ddof=0))
    want = pca.with_signs(vectors[:, ::-1][:, :4].T)
    assert np.allclose(found.directions, want, atol=1e-6) and np.allclose(found.variance, values[::-1][:4])
    assert all(d[np.abs(d).argmax()] > 0 for d in found.directions)
    got = {r.id: r.components for r in pca.project(df, "v", found).collect()}
    assert got[400] is None
    assert np.allclose([got[i] for i in range(400)], (raw - raw.mean(axis=0)) @ want.T, atol=1e-5)


def test_components_of_nothing_and_of_narrow_vectors(spark):
    none = spark.createDataFrame([], "id INT, v ARRAY<DOUBLE>")
    assert len(pca.fit_components(none, "v").directions) == 0
    two = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id INT, v ARRAY<DOUBLE>")
    assert np.allclose(pca.fit_components(two, "v", 5).directions[0], [1, 0])


# -- sources, sinks, runtime -------------------------------------------------------

def test_delimited_round_trip(spark):
    data = [(' lead\t"q"\nnl ', 1, "c", "j", 1.5), ("", 2, "c", "j", None), ("a,b;'", 3, None, "", 0.1), ('"', 4, "c", "\\", 2.0)]
    df = spark.createDataFrame(data, tabular.ARTICLE_SCHEMA)
    path = new_path(spark, "round-trip")
    tabular.write_delimited(df, path)
    back = {r.pmid: tuple(r) for r in tabular.read_delimited(spark, path, tabular.ARTICLE_SCHEMA).collect()}
    assert back == {d[1]: d for d in data}


def test_write_if_absent_and_append(spark):
    path = new_path(spark, "once")
    tabular.write_if_absent(spark.range(3), path)
    tabular.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    tabular.append_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5


def test_rewrite_reads_the_saved_version(spark):
    path = new_path(spark, "journals")
    tabular.append_table(spark.range(4), path)
    current = spark.read.parquet(path)
    saved, where = tabular.rewrite_table(current.withColumn("x", F.lit(1)), "journals")
    assert where != path and saved.columns == ["id", "x"] and saved.count() == 4


def test_record_assembly_skips_untagged_lines(spark):
    lines = ["x", "JournalTitle: A: b", "MedAbbr: A", "ISSN (Print): ", "noise", "ISSN (Online): 1-2",
             "JournalTitle: C", "MedAbbr: C", "ISSN (Print): 3-4", "ISSN (Online): "]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no BIGINT, value STRING")
    got = rows(assemble_records(df, "line_no"))
    assert got == [(0, "A: b", "A", "", "1-2"), (1, "C", "C", "3-4", "")]


def test_broadcast_only_after_measuring(spark):
    big = spark.range(1000).withColumn("s", F.repeat(F.lit("x"), 100))
    assert measured_bytes(big) > 100_000
    assert "isBroadcast" not in broadcast_if_small(big, 1000)._jdf.queryExecution().logical().toString()
    assert "broadcast" in broadcast_if_small(big, 1 << 20)._jdf.queryExecution().logical().toString().lower()


def test_nested_columns_are_measured_and_unknown_ones_not_broadcast(spark):
    from pyspark.ml.linalg import Vectors

    text = "x" * 10_000
    df = spark.createDataFrame([(i, {"k": text}, [(text, [1.0] * 100)], text.encode()) for i in range(10)],
                               "i INT, m MAP<STRING, STRING>, a ARRAY<STRUCT<s: STRING, v: ARRAY<DOUBLE>>>, b BINARY")
    for col, least in (("m", 100_000), ("a", 108_000), ("b", 100_000)):
        assert least <= measured_bytes(df.select("i", col)) < least + 5_000
        assert "isBroadcast" not in broadcast_if_small(df.select("i", col), 50_000)._jdf.queryExecution().logical().toString()
    assert measured_bytes(df.select(F.lit(None).cast("map<string,string>").alias("m"))) is not None
    vectors = spark.createDataFrame([(Vectors.dense([1.0] * 5),)], ["v"])
    assert measured_bytes(vectors) is None and broadcast_if_small(vectors) is vectors


def test_released_tables_are_gone(spark, tmp_path):
    import os

    from folioscope import runtime

    kept = runtime._own_paths.pop(spark.sparkContext.applicationId, [])
    try:
        path = new_path(spark, "gone")
        spark.range(5).write.parquet(path)
        assert os.path.isdir(path) and runtime.release_staged(spark) == 1 and not os.path.exists(path)
    finally:
        runtime._own_paths[spark.sparkContext.applicationId] = kept


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
