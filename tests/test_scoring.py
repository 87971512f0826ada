"""Scoring of many classes, cross-fitting and the trainer against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import classifiers, scoring, training
from folioscope.operators.classifiers import fit_centroids, fit_naive_bayes, naive_bayes_scorer, score_centroids, score_naive_bayes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labelled_rows(rng, n, n_classes, width, longest=12):
    return [(i, int(rng.integers(n_classes)), rng.integers(1, width + 1, rng.integers(0, longest)).tolist()) for i in range(n)]


def naive_bayes_by_hand(train, rows, n_classes, width):
    counts, docs = np.zeros((n_classes, width + 1)), np.zeros(n_classes)
    for _, y, sequence in train:
        docs[y] += 1
        np.add.at(counts[y], sequence, 1)
    theta = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + width)
    prior = np.log(docs + 1) - np.log(docs.sum() + n_classes)
    return np.array([prior + theta[:, s].sum(axis=1) for _, _, s in rows])


@pytest.mark.parametrize("cells", [classifiers.BLOCK_CELLS, 3000])
def test_ten_thousand_classes_in_one_pass(spark, monkeypatch, cells):
    """Equal scores and ranks in one block and in several; the rows are read once and nothing is staged."""
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    monkeypatch.setattr(scoring, "CHUNK_CELLS", 400_000)
    monkeypatch.setattr(scoring, "LOOKUPS", 500)
    rng = np.random.default_rng(4)
    n_classes, width = 10_000, 300
    train = labelled_rows(rng, 3000, n_classes, width)
    asked = [(i, y if i % 5 else None, s) for i, y, s in labelled_rows(rng, 90, n_classes, width)] + [(90, n_classes, [1]), (91, 3, None)]
    schema = "id INT, y INT, sequence ARRAY<INT>"
    model = fit_naive_bayes(spark.createDataFrame(train, schema), "y", n_classes, width)
    scorer = naive_bayes_scorer(model, F.col("sequence"))
    seen, function = spark.sparkContext.accumulator(0), scorer.scores

    def counted(arrays):
        seen.add(len(arrays[0]))
        return function(arrays)

    df = spark.createDataFrame(asked, schema).repartition(3)
    best = scoring.best_classes(df, scoring.Scorer(scorer.inputs, n_classes, counted), 4, "y")
    assert plan_of(best).count("ArrowEvalPython") == 1 and "Join" not in plan_of(best)
    got = {r.id: r for r in best.collect()}
    assert seen.value == len(asked)
    want = naive_bayes_by_hand(train, [(i, y, s or []) for i, y, s in asked], n_classes, width)
    for (i, y, _), scores in zip(asked, want):
        order = np.lexsort((np.arange(n_classes), -scores.round(9)))
        assert np.allclose([c.score for c in got[i].best], scores[order[:4]])
        assert sorted(scores[[c.class_idx for c in got[i].best]].round(9)) == sorted(scores[order[:4]].round(9))
        if y is None or y >= n_classes:
            assert got[i].true_rank is None
        else:
            ahead, level = (scores > scores[y] + 1e-9).sum(), (np.abs(scores - scores[y]) <= 1e-9).sum()
            assert ahead + 1 <= got[i].true_rank <= ahead + level


@pytest.mark.parametrize("cells", [classifiers.BLOCK_CELLS, 40])
def test_cross_fitting_leaves_the_own_fold_out(spark, monkeypatch, cells):
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(7)
    rows = labelled_rows(rng, 80, 4, 9)
    df = spark.createDataFrame([(*r, None if r[0] >= 60 else r[0] % 3) for r in rows], "id INT, y INT, sequence ARRAY<INT>, fold INT")
    train = df.filter("fold IS NOT NULL")
    model = fit_naive_bayes(train, "y", 4, 9, fold=F.col("fold"), n_folds=3)
    got = {r.id: r.scores for r in score_naive_bayes(model, df, fold=F.col("fold")).collect()}
    whole = {r.id: r.scores for r in score_naive_bayes(model, df).collect()}
    plain = {r.id: r.scores for r in score_naive_bayes(fit_naive_bayes(train, "y", 4, 9), df).collect()}
    for i, y, s in rows:
        others = [r for r in rows[:60] if i >= 60 or r[0] % 3 != i % 3]
        assert np.allclose(got[i], naive_bayes_by_hand(others, [(i, y, s)], 4, 9)[0])
        assert np.allclose(whole[i], plain[i])


def test_best_classes_agree_with_all_scores(spark, monkeypatch):
    """Ties go to the lower class, a class without centroid comes last, more classes asked than there are."""
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", 5)
    data = [(i, int(i % 3), [float(i % 2), 1.0]) for i in range(30)]
    df = spark.createDataFrame(data, "id INT, y INT, v ARRAY<DOUBLE>")
    centroids = fit_centroids(df, "v", "y")
    scored = {r.id: r.scores for r in score_centroids(df, centroids, 4, "v").collect()}
    best = scoring.best_classes(df, classifiers.centroid_scorer(centroids, 4, F.col("v"), 2), 9, "y")
    for r in best.collect():
        order = sorted(range(4), key=lambda c: (-scored[r.id][c], c))
        assert [c.class_idx for c in r.best] == order and r.true_rank == order.index(r.y) + 1
    ranked = scoring.recommended(best, "id").collect()
    assert len(ranked) == 120 and {r["rank"] for r in ranked} == {1, 2, 3, 4}


def descent_by_hand(train, n_classes, width, passes, rate, decay):
    x = np.zeros((len(train), width + 1))
    for row, (_, _, sequence) in enumerate(train):
        np.add.at(x[row], sequence, 1 / max(len(sequence), 1))
    x[:, 0] = 1
    y = np.eye(n_classes)[[t[1] for t in train]]
    w, out = np.zeros((n_classes, width + 1)), []
    for _ in range(passes):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w = w * (1 - rate * decay) - rate * (p - y).T @ x / len(train)
        out.append(w)
    return out


@pytest.mark.parametrize("cells", [classifiers.BLOCK_CELLS, 14])
def test_descent_passes(spark, monkeypatch, cells):
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    monkeypatch.setattr(training, "CHUNK_CELLS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, y, s + [1 + y] * 2) for i, y, s in labelled_rows(rng, 90, 4, 6)]
    df = spark.createDataFrame(rows + [(200, None, [1, 2])], "id INT, y INT, sequence ARRAY<INT>")
    found = training.train_softmax(df.filter("id < 60"), df.filter("id >= 60"), "y", 4, 6, passes=4, rate=2.0, decay=0.01)
    steps = descent_by_hand(rows[:60], 4, 6, 4, 2.0, 0.01)
    hits = []
    for w in steps:
        x = np.zeros((30, 7))
        for row, (_, _, s) in enumerate(rows[60:]):
            np.add.at(x[row], s, 1 / len(s))
        x[:, 0] = 1
        hits.append(float(((x @ w.T).argmax(axis=1) == [r[1] for r in rows[60:]]).mean()))
    assert [(p, n) for p, n, _ in found.history] == [(i, 30) for i in range(1, 5)]
    assert np.allclose([a for *_, a in found.history], hits) and found.best_pass == 1 + int(np.argmax(hits))
    dense = np.zeros((4, 7))
    for r in found.weights.collect():
        dense[r.label_idx, r.idx] = r.weight
    assert np.allclose(dense, steps[found.best_pass - 1])


def test_training_stops_when_the_dev_rows_gain_nothing(spark):
    rows = [(i, i % 2, [1 + i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id INT, y INT, sequence ARRAY<INT>")
    found = training.train_softmax(df, df, "y", 2, 2, passes=9, patience=2)
    assert [a for *_, a in found.history] == [1.0, 1.0, 1.0] and found.best_pass == 1
    nobody = training.train_softmax(df, df.filter("id < 0"), "y", 2, 2, passes=2)
    assert [(n, a) for _, n, a in nobody.history] == [(0, None)] * 2 and nobody.best_pass == 1


@pytest.mark.parametrize("cells, step, k", [(classifiers.BLOCK_CELLS, 128, 3), (700, 10, 5), (50, 7, 400)])
def test_bounds_spare_most_classes(spark, monkeypatch, cells, step, k):
    """The same answer as scoring every class; rows stop early where lengths differ."""
    monkeypatch.setattr(classifiers, "BLOCK_CELLS", cells)
    monkeypatch.setattr(classifiers, "NORM_STEP", step)
    rng = np.random.default_rng(2)
    means = rng.normal(size=(300, 5)) * np.exp(rng.normal(size=(300, 1)) * 2)
    means[40] = means[3]
    asked = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(60, [0.0] * 5)]
    centroids = spark.createDataFrame([(c, m.tolist()) for c, m in enumerate(means) if c % 50 != 7], "label_idx INT, centroid ARRAY<DOUBLE>")
    df = spark.createDataFrame(asked, "id INT, v ARRAY<DOUBLE>").repartition(2)
    met = spark.sparkContext.accumulator(0)
    got = {r.id: r.best for r in classifiers.bounded_best_classes(df, centroids, 300, "v", k, met).collect()}
    for i, v in asked:
        scores = means @ np.array(v)
        scores[7::50] = -np.inf
        order = np.lexsort((np.arange(300), -scores.round(9)))[:k]
        assert [c.class_idx for c in got[i]] == order.tolist()
        assert np.allclose([c.score for c in got[i]], scores[order])
    if k < 300:
        assert met.value < 0.7 * len(asked) * -(-294 // step) or step == 128


def test_functions_get_bounded_lists(spark, monkeypatch):
    """However long the texts of a batch are, a chunk holds few of their words; a longer text is alone."""
    monkeypatch.setattr(scoring, "CHUNK_VALUES", 100)
    rows = [(i, [1] * (i % 40)) for i in range(300)] + [(300, [1] * 250), (301, None)]
    df = spark.createDataFrame(rows, "id INT, sequence ARRAY<INT>").coalesce(1)

    def words(arrays):
        return np.full((len(arrays[0]), 1), float(len(arrays[0].flatten())))

    scorer = scoring.Scorer([F.col("sequence")], 1, words)
    found = {r.id: r.s[0] for r in df.select("id", scoring.all_scores(scorer).alias("s")).collect()}
    assert len(found) == len(rows) and found[300] == 250 and max(v for i, v in found.items() if i != 300) <= 100
    best = scoring.best_classes(df, scorer, 1).collect()
    assert len(best) == len(rows) and max(r.best[0].score for r in best if r.id != 300) <= 100


def test_text_functions_in_short_slices(spark, monkeypatch):
    from folioscope.operators import vocabulary as voc

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(100)], "doc_id INT, text STRING").coalesce(1)
    known = spark.createDataFrame([(f"w{j}", j + 1, [float(j), 1.0]) for j in range(6)], "word STRING, idx INT, vector ARRAY<DOUBLE>")

    def both():
        ids = voc.text_sequences(docs, known, 5)
        means = voc.with_mean_vectors(ids, known, 2, "sequence", "mean")
        return sorted(means.collect()), sorted(voc.document_vectors(docs, known, 2).collect())

    whole = both()
    monkeypatch.setattr(voc, "CHUNK_VALUES", 7)
    assert both() == whole


def test_helper_probabilities_take_one_function(spark, sf_dir):
    """Probabilities of both helpers come from one Python worker per task and equal those taken one by one."""
    from folioscope.plans import models

    features = models.text_features(spark, sf_dir)
    hidden = models.with_helper_probabilities(features, 3)
    assert plan_of(hidden).count("ArrowEvalPython") == 1
    train, fold = features.rows.filter("split = 'train'"), F.pmod("doc_id", F.lit(3))
    own = F.when(F.col("split") == "train", fold)
    want = {}
    for label, n in (("topic_idx", features.n_topics), ("band", models.BANDS)):
        model = fit_naive_bayes(train, label, n, features.width, fold=fold, n_folds=3)
        for r in score_naive_bayes(model, features.rows, fold=own).collect():
            want.setdefault(r.doc_id, []).extend(r.probabilities)
    assert {r.doc_id: r.hidden for r in hidden.collect()} == want
