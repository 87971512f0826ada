"""Quoted text in ranges, appends with a log, sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import sketches
from folioscope.runtime import new_path
from folioscope.sources import commit_log, quoted, tabular

SCHEMA = "id INT, text STRING, tail STRING"


def quoted_rows(rng, n):
    bits = ["a", '"', "\n", "\t", "word ", "\n\n", '""', ",", "é", " ", "\r", "'", "\\", "x" * 90]
    text = lambda: rng.choice([None, "", "".join(rng.choices(bits, k=rng.choice([1, 4, 30])))])
    return [(i, text(), text()) for i in range(n)]


@pytest.mark.parametrize("size, sep", [("1m", "\t"), ("700b", "\t"), ("150b", ","), ("64b", "\t")])
def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, size, sep):
    rows = quoted_rows(random.Random(size), 150) + [(150, "\n" * 2000, '"' * 500), (151, "end", "\n")]
    path = new_path(spark, "quoted")
    tabular.write_delimited(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, sep=sep)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        if size != "1m":
            assert spark.read.text(path).rdd.getNumPartitions() > 10
        back = tabular.read_delimited(spark, path, SCHEMA, sep=sep)
        whole = spark.read.options(**tabular._DELIMITED).csv(path, schema=SCHEMA, sep=sep, multiLine=True, nullValue="\0")
        got = sorted(map(repr, map(tuple, back.collect())))
        assert got == sorted(map(repr, map(tuple, whole.collect())))
        assert len(got) == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_several_files_and_none(spark):
    rows = quoted_rows(random.Random(9), 90)
    path = new_path(spark, "quoted")
    tabular.write_delimited(spark.createDataFrame(rows, SCHEMA).repartition(5), path)
    assert tabular.read_delimited(spark, path, SCHEMA).count() == 90
    empty = new_path(spark, "quoted")
    tabular.write_delimited(spark.createDataFrame([], SCHEMA), empty)
    assert tabular.read_delimited(spark, empty, SCHEMA).collect() == []


# -- appends ---------------------------------------------------------------------------

def rows_of(spark, table):
    return sorted(r.i for r in commit_log.read_batches(spark, table, "i INT").collect())


def batch_of(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "i INT")


def test_a_batch_is_added_once(spark):
    table = new_path(spark, "batches")
    assert rows_of(spark, table) == []
    assert commit_log.append_batch(batch_of(spark, 1, 2), table, 1)
    assert not commit_log.append_batch(batch_of(spark, 1, 2), table, 1)
    assert commit_log.append_batch(batch_of(spark), table, "empty")
    assert commit_log.append_batch(batch_of(spark, 3), table, 2)
    assert rows_of(spark, table) == [1, 2, 3]
    assert {(r.batch, r.n) for r in commit_log.log_of(spark, table).collect()} == {("1", 2), ("empty", 0), ("2", 1)}


def test_a_run_that_failed_after_writing_leaves_nothing_visible(spark, monkeypatch):
    table = new_path(spark, "batches")
    commit_log.append_batch(batch_of(spark, 1), table, 1)
    whole = commit_log._commit
    monkeypatch.setattr(commit_log, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        commit_log.append_batch(batch_of(spark, 2, 3), table, 2)
    assert rows_of(spark, table) == [1]
    monkeypatch.setattr(commit_log, "_commit", whole)
    assert commit_log.append_batch(batch_of(spark, 2, 3), table, 2)
    assert rows_of(spark, table) == [1, 2, 3]
    assert commit_log.remove_unfinished(spark, table) == 1
    assert rows_of(spark, table) == [1, 2, 3]


def test_of_two_runs_of_a_batch_one_wins(spark):
    table = new_path(spark, "batches")
    for folder in ("a", "b"):
        batch_of(spark, 5).write.parquet(f"{table}/data/{folder}")
    assert commit_log._commit(spark, table, "7", "data/a", 1)
    assert not commit_log._commit(spark, table, "7", "data/b", 1)
    assert rows_of(spark, table) == [5]


# -- sketches --------------------------------------------------------------------------

def test_distinct_states_merge_within_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 20_000).cast("string").alias("v"))
    states = sketches.distinct_states(df, "v", "part")
    n = sketches.distinct_estimates(sketches.merge_distinct(states)).first().n
    assert abs(n - 20_000) <= 0.03 * 20_000
    assert sketches.distinct_estimates(sketches.distinct_states(df.filter("id < 0"), "v")).first().n == 0


@pytest.mark.parametrize("counters", [5, 40, 1000])
def test_frequent_values_are_bounded(spark, counters):
    rng = random.Random(counters)
    values = [f"v{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)] + [None] * 50
    count = Counter(v for v in values if v is not None)
    df = spark.createDataFrame([(v,) for v in values], "v STRING").repartition(4)
    merged = sketches.merge_frequent(sketches.frequent_summaries(df, "v", counters).unionByName(
        sketches.frequent_summaries(df.limit(0), "v", counters)))
    error = merged.filter("value IS NULL").first().missed
    assert error <= 6000 / (counters + 1) + 4
    least = max(error + 1, 100)
    got = {r.value: (r.low, r.high) for r in sketches.frequent_values(merged, least).collect()}
    assert {v for v, n in count.items() if n >= least} <= set(got)
    assert all(low <= count[v] <= high for v, (low, high) in got.items())


def test_a_large_table_goes_to_several_single_task_files(spark, monkeypatch):
    """One task writes a file, so files follow the size; every row comes back whole, line breaks included."""
    from folioscope.plans import parsing

    table, paths = new_path(spark, "tables"), []
    rows = [(i, f'line {i}\n"quoted"\tand more', f"l{i % 2}", f"src{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    docs.repartition(4).write.parquet(f"{table}/documents.parquet")
    monkeypatch.setattr(parsing, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    for size, files in ((1 << 29, 1), (1500, None)):
        monkeypatch.setattr(parsing, "FILE_BYTES", size)
        got = {r.category: (r.n, r.ids, r.chars) for r in parsing.single_file_scan(spark, table).collect()}
        assert got == {f"l{k}": (30, 30, sum(len(t) for i, t, *_ in rows if i % 2 == k)) for k in range(2)}
        written = len(spark.read.text(paths[-1]).inputFiles())
        assert written == files if files else written > 1
