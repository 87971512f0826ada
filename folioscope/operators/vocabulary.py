"""Dictionaries, token sequences and vectors of a text corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import MAX_SEQUENCE_LENGTH, MAX_WORDS, pad_sequence, raw_tokens, tokens
from folioscope.functions.vectors import as_double, l2_normalise, zero_vector
from folioscope.operators.row_index import with_row_index
from folioscope.operators.scoring import CHUNK_VALUES, Blocks, row_ranges
from folioscope.runtime import BROADCAST_BYTES, broadcast_if_small, measured_bytes, stage

# Tokens whose vectors a task adds up in one numpy step.
TOKEN_SLICE = 65_536


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over the whole corpus; combined on the map side, so hot words cost little."""
    return docs.select(F.explode(tokens(F.col(text_col))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_raw_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct pieces of the text cut at single spaces."""
    pieces = F.array_distinct(raw_tokens(F.col(text_col)))
    return docs.select(F.explode(pieces).alias("word")).distinct()


def _place(docs: DataFrame, id_col: str):
    """Orderable (document, position). As one number for integer ids: numbers aggregate by hash, structs by sort."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col(id_col).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("pos")
    return F.struct(id_col, "pos")


def fit_vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, idx): every word with its 1-based frequency rank, ties by first appearance."""
    words = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "word"))
    ranked = words.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min(_place(docs, id_col)).alias("first_seen")
    )
    indexed = with_row_index(ranked, F.desc("n"), F.asc("first_seen"))
    return indexed.select("word", "n", (F.col("row_idx") + 1).cast("int").alias("idx"))


def _all_words(text_col: str):
    return F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))


def _position_finder():
    """The lookup shared by the functions below, as a closure so that tasks need no installed package."""

    def positions(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per token its position in `known` (-1 when absent), and the list boundaries."""
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy(zero_copy_only=False)
        return found, bounds - bounds[0]

    return positions


def text_sequences(docs: DataFrame, vocabulary: DataFrame, num_words: int = MAX_WORDS,
                   id_col: str = "doc_id", text_col: str = "text", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, sequence): word indices in text order.

    Only indices below `num_words` are kept, unknown words are dropped, documents without any
    known word get an empty sequence. A vocabulary within `max_bytes` is looked up inside each
    document's own task, so the corpus is never shuffled; a larger one is joined.
    """
    known = vocabulary.filter(F.col("idx") < num_words).select("word", "idx")
    if (measured_bytes(known) or 0) > max_bytes:
        return _joined_sequences(docs, known, id_col, text_col)
    table = known.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (table["word"].combine_chunks(), table["idx"].to_numpy().astype("int32"))
    )

    positions, most = _position_finder(), CHUNK_VALUES

    @F.arrow_udf("array<int>")
    def indices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, numbers = shared.value
        for lists in (batch.slice(a, b - a) for batch in batches for a, b in row_ranges(batch, most)):
            found, bounds = positions(lists, words)
            kept = found >= 0
            ends = np.concatenate(([0], np.cumsum(kept)))[bounds].astype("int32")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[found[kept]]))

    return docs.select(id_col, indices(_all_words(text_col)).alias("sequence"))


def _joined_sequences(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = docs.select(id_col, F.posexplode_outer(tokens(F.col(text_col))).alias("pos", "word"))
    matched = words.join(known, "word", "left")
    placed = F.when(F.col("idx").isNotNull(), F.struct("pos", "idx"))  # NULLs are not collected
    return matched.groupBy(id_col).agg(F.array_sort(F.collect_list(placed)).alias("__placed")).select(
        id_col, F.transform("__placed", lambda p: p["idx"]).alias("sequence")
    )


def padded_sequences(sequences: DataFrame, length: int = MAX_SEQUENCE_LENGTH) -> DataFrame:
    return sequences.withColumn("sequence", pad_sequence(F.col("sequence"), length))


def embedding_table(vocabulary: DataFrame, vectors: DataFrame, width: int, num_words: int = MAX_WORDS) -> DataFrame:
    """(word, idx, vector) for the `num_words` most frequent words.

    `vectors` is (word, vector). Found vectors are scaled to unit length, other words get zeros.
    The bounded vocabulary, not the big vector table, is the side that moves.
    """
    top = vocabulary.filter(F.col("idx") <= num_words).select("word", "idx")
    hits = vectors.join(broadcast_if_small(stage(top, "top-words")), "word").select(
        "word", l2_normalise(as_double(F.col("vector"))).alias("vector")
    )
    return top.join(hits, "word", "left").select(
        "word", "idx", F.coalesce("vector", zero_vector(width)).alias("vector")
    )


def document_vectors(docs: DataFrame, embeddings: DataFrame, width: int, id_col: str = "doc_id",
                     text_col: str = "text", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, vector): mean embedding of a document's in-vocabulary words; zeros when it has none.

    An embedding table within `max_bytes` is applied inside each document's own task without a
    shuffle; a larger one is joined.
    """
    if (measured_bytes(embeddings) or 0) > max_bytes:
        return _joined_vectors(docs, embeddings, width, id_col, text_col)
    table = embeddings.select("word", "vector").toArrow()
    matrix = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    shared = docs.sparkSession.sparkContext.broadcast((table["word"].combine_chunks(), matrix))

    positions, slice_size, most = _position_finder(), TOKEN_SLICE, CHUNK_VALUES

    @F.arrow_udf("array<double>")
    def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, vectors = shared.value
        for lists in (batch.slice(a, b - a) for batch in batches for a, b in row_ranges(batch, most)):
            found, bounds = positions(lists, words)
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))[found >= 0]
            found = found[found >= 0]
            result = np.zeros((len(lists), width))
            for at in range(0, len(found), slice_size):
                own = row[at:at + slice_size]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                result[own[starts]] += np.add.reduceat(vectors[found[at:at + slice_size]], starts)
            result /= np.maximum(np.bincount(row, minlength=len(lists)), 1)[:, None]
            ends = np.arange(0, len(lists) * width + 1, width, dtype="int32")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel()))

    return docs.select(id_col, means(_all_words(text_col)).alias("vector"))


def with_mean_vectors(rows: DataFrame, embeddings: DataFrame, width: int, sequence_col: str, out_col: str,
                      max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add the mean embedding of an ARRAY<INT> of word indices; indices without a row in `embeddings`
    (idx, vector) do not count, zeros where none is left.

    The vectors travel in ranges of word indices of at most `max_bytes`, of which a task holds one at a time.
    """
    context = rows.sparkSession.sparkContext
    top = embeddings.agg(F.max("idx")).first()[0] or 0
    step, parts = max(1, max_bytes // (8 * max(width, 1))), []
    for a in range(0, top + 1, step):
        table = embeddings.filter(F.col("idx").between(a, a + step - 1)).select("idx", "vector").toArrow()  # at most `step` rows
        matrix, known = np.zeros((min(step, top + 1 - a), width)), np.zeros(min(step, top + 1 - a), dtype=bool)
        at = table["idx"].to_numpy() - a
        if len(at):
            matrix[at] = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        known[at] = True
        parts.append((a, a + len(known), context.broadcast((matrix, known))))
    blocks, slice_size, most = Blocks(parts), TOKEN_SLICE, CHUNK_VALUES

    @F.arrow_udf("array<double>")
    def means(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in (batch.slice(a, b - a) for batch in batches for a, b in row_ranges(batch, most)):
            words = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
            result, found = np.zeros((len(lists), width)), np.zeros(len(lists))
            for first, end, (vectors, known) in blocks.each():
                near = (words >= first) & (words < end)
                near[near] = known[words[near] - first]
                own_row, own_words = row[near], words[near] - first
                found += np.bincount(own_row, minlength=len(lists))
                for at in range(0, len(own_words), slice_size):
                    own = own_row[at:at + slice_size]
                    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    result[own[starts]] += np.add.reduceat(vectors[own_words[at:at + slice_size]], starts)
            result /= np.maximum(found, 1)[:, None]
            ends = np.arange(0, len(lists) * width + 1, width, dtype="int32")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel()))

    return rows.withColumn(out_col, means(F.col(sequence_col)))


def _joined_vectors(docs: DataFrame, embeddings: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    table = embeddings.select("word", array_to_vector("vector").alias("vector"))
    words = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("word"))
    counted = words.groupBy(id_col, "word").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    means = counted.join(table, "word").groupBy(id_col).agg(
        Summarizer.mean(F.col("vector"), F.col("weight")).alias("mean")
    )
    found = means.select(id_col, vector_to_array("mean").alias("vector"))
    return docs.select(id_col).join(found, id_col, "left").select(
        id_col, F.coalesce("vector", zero_vector(width)).alias("vector")
    )


def label_dictionary(df: DataFrame, label_col: str) -> DataFrame:
    """(label, label_idx): all distinct labels in sorted order, numbered from 0; NULL is no label."""
    labels = df.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return with_row_index(labels, "label", name="label_idx").withColumn("label_idx", F.col("label_idx").cast("int"))


def encode_labels(df: DataFrame, dictionary: DataFrame, label_col: str, out_col: str = "label_idx") -> DataFrame:
    """Add the class index; a label missing from the dictionary is an error."""
    codes = broadcast_if_small(dictionary.select(F.col("label").alias(label_col), F.col("label_idx").alias("__code")))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label_col), F.lit("NULL"))))
    return df.join(codes, label_col, "left").withColumn(
        out_col, F.coalesce("__code", unknown.cast("int"))
    ).drop("__code")


def decode_labels(df: DataFrame, dictionary: DataFrame, index_col: str, out_col: str) -> DataFrame:
    """Add the class name of an index."""
    names = broadcast_if_small(dictionary.select(F.col("label").alias(out_col), F.col("label_idx").alias(index_col)))
    return df.join(names, index_col, "left")


def staged_label_dictionary(df: DataFrame, label_col: str) -> DataFrame:
    return stage(label_dictionary(df, label_col), "labels")
