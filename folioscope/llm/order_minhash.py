"""Order MinHash fingerprints, in DataFrame functions only.

Units of a text are its words; a huge word counts as its overlapping pieces of four characters. That
is decided word by word, so texts that share a passage share its units. Every run of three units is a k-mer; the o-th occurrence of a k-mer in its text has a hash of its own. The hash range
is cut into slots; each slot takes the smallest occurrence-numbered k-mers from its beginning on
(going round at the end of the range), puts them back into text order and hashes the tuple. Slots
agree between two texts about as often as their k-mers occur in both in the same order, so
transpositions count, not only contents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ASCII_SPACE, keyed_texts, same_document
from folioscope.operators.row_index import with_row_index
from folioscope.runtime import stage

K = 3
TUPLE = 2
# A power of two.
SLOTS = 64
# Low bits of a k-mer's number that hold its position; the hash is above.
POSITION_BITS = 26
# Characters above which a word is taken as overlapping pieces instead.
LONG_WORDS = 32

_POSITION = (1 << POSITION_BITS) - 1


def _units(words: Column) -> Column:
    # One piece begins at every code point but the last three.
    pieces = lambda w: F.regexp_extract_all(w, F.lit("(?s)(?=(.{4}))."), F.lit(1))
    huge = lambda w: F.length(w) > LONG_WORDS
    cut = F.flatten(F.transform(words, lambda w: F.when(huge(w), pieces(w)).otherwise(F.array(w))))
    return F.when(F.exists(words, huge), cut).otherwise(words)


def _numbered(hash_: Column, position: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(position.bitwiseAND(F.lit(_POSITION)).cast("bigint"))


def _hash(number: Column) -> Column:
    return F.shiftright(number, POSITION_BITS)


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, k: int = K, tuple_size: int = TUPLE,
                     slots: int = SLOTS) -> DataFrame:
    """Add `out_col`, ARRAY<INT> of `slots` tuple hashes, from a text without NULLs.

    Each step is a column that later ones read several times; equal texts get equal fingerprints, a
    text with fewer units than `k` is one k-mer, and the empty text is one as well.
    """
    kmers = F.when(F.size("__u") >= k, F.transform(
        F.sequence(F.lit(0), F.size("__u") - k),
        lambda i: _numbered(F.xxhash64(*[F.get("__u", i + j) for j in range(k)]), i),
    )).otherwise(F.array(_numbered(F.xxhash64(F.array_join("__u", " ")), F.lit(0))))
    again = F.filter("__k", lambda x, i: (i > 0) & (_hash(x) == _hash(F.get("__k", i - 1))))
    begins = F.filter(
        F.sequence(F.lit(0), F.size("__a") - 1),
        lambda i: (i == 0) | (_hash(F.get("__a", i)) != _hash(F.get("__a", i - 1))))

    def occurrences(begin: Column, run: Column) -> Column:
        end = F.coalesce(F.get("__b", run + 1), F.size("__a")) - 1
        return F.transform(F.sequence(begin, end), lambda j: _numbered(
            F.xxhash64(_hash(F.get("__a", j)), j - begin + 1), F.get("__a", j).bitwiseAND(F.lit(_POSITION))))

    # Signed hashes: slot s begins at its share of the range, from the smallest number on.
    edges = [(s << (64 - slots.bit_length() + 1)) - (1 << 63) for s in range(slots)]
    marks = F.array(*[F.lit(e).cast("bigint") for e in edges])

    def slot_hash(edge: Column, s: Column) -> Column:
        before = F.array_position("__m", edge) - 1 - s  # k-mers below the slot
        own = [F.get("__e", ((before + t) % F.size("__e")).cast("int")) for t in range(tuple_size)]
        in_order = F.array_sort(F.array(*[F.struct(x.bitwiseAND(F.lit(_POSITION)), _hash(x)) for x in own]))
        return F.hash(F.transform(in_order, lambda x: x["col2"]))

    steps = [
        ("__w", F.split(F.col(text_col), ASCII_SPACE, -1)),
        ("__u", _units(F.col("__w"))),
        ("__k", F.sort_array(kmers)),
        ("__a", again),
        ("__b", F.when(F.size("__a") > 0, begins).otherwise(F.array().cast("array<int>"))),
        ("__e", F.when(F.size("__a") == 0, F.col("__k")).otherwise(F.sort_array(F.concat(
            F.array_except("__k", "__a"), F.flatten(F.transform("__b", occurrences)))))),
        ("__m", F.sort_array(F.concat("__e", marks))),
        (out_col, F.transform(marks, slot_hash)),
    ]
    kept = df.columns
    return reduce(lambda d, step: d.withColumn(*step), steps, df).select(*[F.col(f"`{c}`") for c in kept], out_col)


def likeness(a: Column, b: Column) -> Column:
    """Share of slots on which two fingerprints agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def as_text(fingerprint: Column) -> Column:
    """8 hex digits per slot."""
    return F.lower(F.array_join(F.transform(
        fingerprint, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, row_idx, n, text, n_chars, edited): every text and its edited form.

    The last third of the code points is replaced by as many from the start of the next document, in
    descending order of id (NULL ids last, ties by text hash; the first follows the last). Rows that
    repeat id and text are one document in this order.
    """
    texts = keyed_texts(docs, id_col, text_col)
    keys = texts.select("doc_id", "h", F.length("text").cast("bigint").alias("n_chars")).distinct()
    order = stage(with_row_index(keys, F.desc_nulls_last("doc_id"), F.asc("h")), "text-order")
    n = order.count()
    follow = order.select(
        ((F.col("row_idx") + 1) % F.lit(max(n, 1))).alias("row_idx"), F.col("doc_id").alias("for_id"),
        F.col("h").alias("for_h"), F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"))
    places = stage(order.join(follow, "row_idx"), "text-places")
    placed = texts.join(places, same_document(texts, places)).select(
        texts["doc_id"], texts["h"], "text", "n_chars", "row_idx", "for_id", "for_h", "wanted")
    heads = placed.select("for_id", "for_h", F.substring("text", F.lit(1), F.col("wanted")).alias("head"))
    heads = heads.dropDuplicates(["for_id", "for_h"])
    own = placed.select("doc_id", "h", "text", "n_chars", "row_idx")
    both = own.join(heads, own["doc_id"].eqNullSafe(heads["for_id"]) & (own["h"] == heads["for_h"]))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.col("head"))
    return both.select("doc_id", "h", "row_idx", F.lit(n).alias("n"), "text", "n_chars", edited.alias("edited"))


def fingerprints_with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                                 **options) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next), one row per row of `docs`.

    NULL text is empty; an empty table gives an empty result; further columns are ignored.
    """
    pairs = with_fingerprint(edited_pairs(docs, id_col, text_col), "text", "fp", **options)
    pairs = with_fingerprint(pairs.drop("text"), "edited", "edited_fp", **options)
    rows = stage(pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp",
        "row_idx", ((F.col("row_idx") + 1) % F.col("n")).alias("next_idx")), "order-minhash")
    after = rows.select(F.col("row_idx").alias("next_idx"), F.col("fp").alias("next_fp")).dropDuplicates(["next_idx"])
    return rows.join(after, "next_idx").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
