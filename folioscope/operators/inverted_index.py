"""Inverted index with positions: built once and saved, asked for any number of terms.

The index is a table of postings (word, block, ids, counts, places), in the order of the words: the
documents of one block that hold the word, how often, and where. Ids and places are differences to the
one before, so they pack well. Blocks are bounded, so the postings of a frequent word are many rows.
A question reads the rows of its words only and merges them block by block on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.runtime import broadcast_if_small, ship, stage

ship(__name__)

# Documents and words of one block of postings; a worker needs about 100 bytes per word while it makes a block.
BLOCK_DOCS, BLOCK_WORDS = 16_384, 1_000_000
# Words that are handed to the scan as a filter; more are joined only.
PUSHED_WORDS = 1000
# Terms that share the postings they read.
SLOT_TERMS = 2000

POSTINGS = "word string, block bigint, ids array<bigint>, counts array<int>, places array<int>"
TERMS = "topic string, term_no int, required array<string>, excluded array<string>, phrase boolean"
# The word that stands for all documents of a block; no text holds it.
EVERY = ""


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; the first one of every run stays."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def undo_steps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Values of `steps` for runs of the given lengths."""
    total = np.cumsum(values)
    ends = np.cumsum(lengths)
    before = np.concatenate(([0], total))[ends - lengths]
    return total - np.repeat(before, lengths)


def segment(ids: np.ndarray, words: pa.Array, lengths: np.ndarray, block: int) -> pa.RecordBatch:
    """Postings of one block: ids of its documents, all their words in a row, and each document's number of words."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int32)
    rank[order] = np.arange(len(ids))
    ids = ids[order]
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(rank, lengths)
    place = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    sort = np.lexsort((doc, code))  # the words of a document are in order already
    code, doc, place = code[sort], doc[sort], place[sort]
    opens = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), (np.diff(code) != 0) | (np.diff(doc) != 0))))
    first = np.flatnonzero(np.diff(code[opens], prepend=-1))
    counts = np.diff(np.append(opens, len(code)))
    # The entry of all documents comes first.
    id_steps = np.concatenate((steps(ids, np.zeros(1, dtype=np.int64)), steps(ids[doc[opens]], first)))
    id_ends = np.concatenate(([0], first + len(ids), [len(ids) + len(opens)]))
    place_ends = np.concatenate(([0], opens[first], [len(code)]))
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array([EVERY]), coded.dictionary.take(pa.array(code[opens[first]])).cast(pa.string())]),
        pa.array(np.full(len(first) + 1, block)),
        pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(id_steps)),
        pa.ListArray.from_arrays(
            pa.array(id_ends, pa.int32()), pa.array(np.concatenate((np.zeros(len(ids), np.int64), counts)), pa.int32())),
        pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(steps(place, opens), pa.int32())),
    ], names=["word", "block", "ids", "counts", "places"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the postings of all texts to `path` and read them back.

    Ids are whole numbers that name one row each; rows with a NULL id or text are left out. Every task makes the blocks of its
    own documents, so words are never shuffled; what is put in order of (word, block) are packed postings.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), tokens(F.col(text_col)).alias("words"))
    block_docs, block_words = BLOCK_DOCS, BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, n_docs, n_words = TaskContext.get().partitionId() << 32, [], 0, 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = whole.column("words").combine_chunks()
            lengths = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
            return segment(whole.column("id").to_numpy(), lists.flatten(), lengths, block)

        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                # As many documents as the block has room for; one that is longer than a block is alone.
                done = sizes[start - 1] if start else 0
                stop = min(int(np.searchsorted(sizes, done + block_words - n_words, side="right")), start + block_docs - n_docs)
                if stop > start or not n_docs:
                    stop = max(stop, start + 1)
                    held.append(batch.slice(start, stop - start))
                    n_docs, n_words, start = n_docs + stop - start, n_words + int(sizes[stop - 1] - done), stop
                if start < batch.num_rows or n_docs >= block_docs or n_words >= block_words:
                    yield out()
                    block, held, n_docs, n_words = block + 1, [], 0, 0
        if n_docs:
            yield out()

    segments = stage(rows.mapInArrow(run, POSTINGS), "segments")
    ordered = segments.repartitionByRange("word", "block").sortWithinPartitions("word", "block")
    ordered.write.option("compression", "zstd").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def among(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `wanted` are in the rising `ids`."""
    if not len(ids):
        return np.zeros(len(wanted), dtype=bool)
    return ids[np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)] == wanted


class Postings:
    """Postings of one block, unpacked when a term first needs them."""

    def __init__(self, table: pa.Table):
        self.lists, self.counts, self.places = (table.column(c).combine_chunks() for c in ("ids", "counts", "places"))
        self.held: dict[int, np.ndarray] = {}

    def ids(self, row: int) -> np.ndarray:
        if row not in self.held:
            self.held[row] = np.cumsum(self.lists[row].values.to_numpy())
        return self.held[row]

    def starts(self, row: int, found: np.ndarray, at: int) -> np.ndarray:
        """(document, place) of every phrase of which the word could be number `at`, as one number."""
        n = self.counts[row].values.to_numpy().astype(np.int64)
        ids = self.ids(row)
        wanted = np.repeat(among(found, ids), n)
        owner = np.repeat(np.searchsorted(found, ids), n)
        start = undo_steps(self.places[row].values.to_numpy().astype(np.int64), n) - at
        wanted &= start >= 0
        return (owner[wanted] << 32) + start[wanted]

    def matches(self, required: dict[int, int], excluded: list[int], phrase: bool) -> np.ndarray:
        """Ids of the documents that hold all required words (place in the term -> row) and no excluded one."""
        rows = sorted(required.values(), key=lambda r: len(self.lists[r]))
        found = self.ids(rows[0])
        for row in rows[1:]:
            found = found[among(self.ids(row), found)]
        for row in excluded:
            found = found[~among(self.ids(row), found)]
        if phrase and len(required) > 1 and len(found):
            keys = None
            for at, row in required.items():
                own = self.starts(row, found, at)
                keys = own if keys is None else keys[among(own, keys)]
            found = found[np.unique(keys >> 32)]
        return found


def search_index(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(topic, term_no, doc_id) for every row of `terms` (topic, term_no, required, excluded, phrase) and every text it matches.

    All required words must occur, with `phrase` one after the other, and no excluded one. A term without
    required words starts from all documents; a NULL list counts as empty. The terms may be any number:
    slots of them meet one block at a time, with the postings of a word once per slot.
    """
    none = F.array().cast("array<string>")
    listed = terms.select("topic", "term_no", *[F.coalesce(c, none).alias(c) for c in ("required", "excluded")],
                          F.coalesce("phrase", F.lit(False)).alias("phrase"))
    listed = stage(listed.withColumn("term", F.monotonically_increasing_id()), "terms")
    slots = max(1, -(-listed.count() // SLOT_TERMS))
    words = F.when(F.size("required") > 0, F.col("required")).otherwise(F.array(F.lit(EVERY)))

    def uses(role: int, of: Column) -> DataFrame:
        rows = listed.select("term", "phrase", F.size(words).alias("needed"), F.posexplode(of).alias("at", "word"))
        return rows.select(
            F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int").alias("slot"), "word", "phrase",
            F.struct("term", F.lit(role).alias("role"), "at", "needed", "phrase").alias("use"))

    asked = uses(0, words).unionByName(uses(1, F.col("excluded"))).groupBy("slot", "word").agg(
        F.collect_list("use").alias("uses"), F.max("phrase").alias("placed"))  # at most a slot's terms
    asked = stage(asked, "asked-words")
    distinct = [r.word for r in asked.select("word").distinct().limit(PUSHED_WORDS + 1).collect()]
    if len(distinct) <= PUSHED_WORDS:
        index = index.filter(F.col("word").isin(distinct))
    met = index.join(broadcast_if_small(asked), "word").select(
        "slot", "block", "ids", *[F.when(F.col("placed"), F.col(c)).alias(c) for c in ("counts", "places")], "uses")

    def run(table: pa.Table) -> pa.Table:
        postings, required, excluded, figures = Postings(table), {}, {}, {}
        listed = table.column("uses").combine_chunks()
        row = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        uses = [a.to_numpy(zero_copy_only=False) for a in listed.flatten().flatten()]
        term, role, _, needed, _ = uses
        # Most terms of a slot miss a word in the block and are done here.
        own, first, n = np.unique(term[role == 0], return_index=True, return_counts=True)
        whole = own[n == needed[role == 0][first]]
        for i in np.flatnonzero(np.isin(term, whole)):
            key, kind, at, _, phrase = (u[i].item() for u in uses)
            figures[key] = phrase
            if kind == 0:
                required.setdefault(key, {})[at] = int(row[i])
            else:
                excluded.setdefault(key, []).append(int(row[i]))
        hits, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for term, phrase in figures.items():
            found = postings.matches(required[term], excluded.get(term, []), phrase)
            hits.append(found)
            numbers.append(np.full(len(found), term))
        return pa.table({"term": np.concatenate(numbers), "doc_id": np.concatenate(hits)})

    hits = met.groupBy("slot", "block").applyInArrow(run, "term bigint, doc_id bigint")
    return hits.join(broadcast_if_small(listed.select("term", "topic", "term_no")), "term").select("topic", "term_no", "doc_id")
