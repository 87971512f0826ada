"""Exact duplicates by composable polynomial fingerprints.

A text is cut into parts; every part gets (f, m): its polynomial value and the base raised to its
length, both modulo two primes. Parts combine by (fA, mA) + (fB, mB) = (fA * mB + fB, mA * mB), so
the parts of a huge document are hashed in parallel and put together afterwards. Documents of
equal fingerprint and length are then compared with the representative of their group, part by
part, in sorted streams that hold one part in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ASCII_SPACE, keyed_texts, pieces, same_document
from folioscope.runtime import stage

# Two primes below 2**31 and a base for each: products of two residues fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_566_083_941)
# Code points of a part that is hashed and compared as a whole.
PART = 1 << 22
# Bytes per numpy step: 2**8 * 2**31 * 2**16 stays below 2**63.
STEP = 1 << 16
# Documents of one fingerprint that meet in one task; larger groups are salted.
PER_SALT = 2_000

_KEY = ["f1", "f2", "n_bytes"]


def part_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column (part, binary) by f1, f2, m1, m2 and n_bytes."""
    powers = []
    for prime, base in zip(PRIMES, BASES):
        table = np.empty(STEP, dtype=np.int64)
        value = 1
        for k in range(STEP - 1, -1, -1):
            table[k] = value
            value = value * base % prime
        powers.append(table)
    for batch in batches:
        parts = batch.column(batch.num_columns - 1)
        out = np.empty((5, len(parts)), dtype=np.int64)
        for row, part in enumerate(parts):
            data = np.frombuffer(part.as_buffer(), dtype=np.uint8)
            for k, (prime, base) in enumerate(zip(PRIMES, BASES)):
                value = 0
                for at in range(0, len(data), STEP):
                    step = data[at:at + STEP]
                    own = int(np.dot(step.astype(np.int64), powers[k][STEP - len(step):])) % prime
                    value = (value * pow(base, len(step), prime) + own) % prime
                out[k, row] = value
                out[k + 2, row] = pow(base, len(data), prime)
            out[4, row] = len(data)
        columns = batch.columns[:-1] + [pa.array(c) for c in out]
        names = batch.schema.names[:-1] + ["f1", "f2", "m1", "m2", "n_bytes"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _normalised(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.regexp_replace("text", ASCII_SPACE, " "))


def fingerprints(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, h, text_sha256, f1, f2, n_bytes) of (doc_id, text, h), texts after normalising."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    base = f"doc_id {id_type}, h bigint, text_sha256 string, part_no int"
    hashed = f"{base}, f1 bigint, f2 bigint, m1 bigint, m2 bigint, n_bytes bigint"
    texts = _normalised(docs).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    small = texts.filter(F.length("text") <= part).select(
        "doc_id", "h", "text_sha256", F.lit(0).alias("part_no"), F.col("text").cast("binary").alias("part"))
    keep = ["doc_id", "h", "text_sha256", *_KEY]
    whole = small.mapInArrow(part_fingerprints, hashed).select(*keep)
    # Parts of huge documents leave the task that read them and are hashed side by side.
    huge = (
        texts.filter(F.length("text") > part)
        .select("doc_id", "h", "text_sha256", F.posexplode(pieces(F.col("text"), part)).alias("part_no", "part"))
        .withColumn("part", F.col("part").cast("binary"))
        .repartition("doc_id", "h", "part_no")
        .mapInArrow(part_fingerprints, hashed)
    )
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "f1", "f2", "m1", "m2")))
    start = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("f1", "f2")])
    combined = F.aggregate("parts", start, lambda acc, p: F.struct(
        *[((acc[f] * p[m] + p[f]) % prime).alias(f) for f, m, prime in (("f1", "m1", PRIMES[0]), ("f2", "m2", PRIMES[1]))]
    ))
    # Rows that repeat a huge document bring every part more than once: one of each, and their number.
    joined = (
        huge.groupBy("doc_id", "h", "text_sha256", "part_no")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in ("f1", "f2", "m1", "m2", "n_bytes")])
        .groupBy("doc_id", "h", "text_sha256")
        .agg(ordered.alias("parts"), F.sum("n_bytes").alias("n_bytes"), F.min("rows").alias("rows"))
        .withColumn("f", combined)
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
        .select("doc_id", "h", "text_sha256", "f.f1", "f.f2", "n_bytes")
    )
    return whole.unionByName(joined)


def unequal_to_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, salt, part_no), the representative first: yields rows that differ from it."""
    key, first = None, None
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        keys = list(zip(*[c.to_pylist() for c in columns[2:7]]))
        differ = []
        for row, own in enumerate(keys):
            part = columns[7][row].as_buffer()
            if own != key:
                key, first = own, pa.py_buffer(part.to_pybytes())
            elif not part.equals(first):
                differ.append(row)
        if differ:
            yield batch.select([0, 1]).take(pa.array(differ))


def _collisions(docs: DataFrame, prints: DataFrame, groups: DataFrame, part: int, per_salt: int) -> DataFrame:
    """(doc_id, h) of documents whose text differs from the representative of their fingerprint."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    members = prints.select("doc_id", "h", *_KEY).join(groups, _KEY)
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    salts = F.ceil(F.col("group_size") / per_salt).cast("int")
    wanted = stage(members.select("doc_id", "h", *_KEY, first.alias("leads"), salts.alias("salts")).distinct(), "members")
    # A merge join at every size: a broadcast that only small inputs get would hide what large ones move.
    wanted = wanted.hint("merge")
    texts = _normalised(docs.join(wanted, same_document(docs, wanted)).select(wanted["*"], "text"))
    own_salt = F.array(F.pmod(F.xxhash64("doc_id", "h"), F.col("salts")).cast("int"))
    spread = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(own_salt)
    parts = (
        texts.withColumn("salt", F.explode(spread))
        .select("doc_id", "h", *_KEY, "salt", "leads", F.posexplode(pieces(F.col("text"), part)).alias("part_no", "part"))
        .repartition(*_KEY, "salt", "part_no")
        .sortWithinPartitions(*_KEY, "salt", "part_no", F.desc("leads"))
        .select("doc_id", "h", *_KEY, "salt", "part_no", F.col("part").cast("binary"))
    )
    return parts.mapInArrow(unequal_to_first, f"doc_id {id_type}, h bigint").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART,
                 per_salt: int = PER_SALT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal when they agree after every run of ASCII white space is replaced by one space;
    NULL counts as empty. The smallest id of a group stays; NULL ids come after all others. Rows
    that repeat both id and text count in `group_size` and share their fate, as nothing tells them
    apart. An empty table gives an empty result; further columns are ignored.
    """
    texts = keyed_texts(docs, id_col, text_col)
    prints = stage(fingerprints(texts, part), "fingerprints")
    results = []
    while True:
        groups = prints.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"),
            F.min(F.struct("doc_id", "h")).alias("first"),
        ).filter("group_size > 1")
        groups = stage(groups, "groups")
        other = stage(_collisions(texts, prints, groups.select(*_KEY, "group_size", "first"), part, per_salt), "collisions")
        if other.isEmpty():
            break
        # Documents that only share the fingerprint form groups of their own.
        equal = prints.join(other, same_document(prints, other), "left_anti")
        results.append((equal, equal.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id")).filter("group_size > 1")))
        prints = stage(prints.join(other, same_document(prints, other), "left_semi"), "collided")
    results.append((prints, groups.select(*_KEY, "group_size", "keep_id")))
    return reduce(DataFrame.unionByName, [_outcome(rows, sizes) for rows, sizes in results])


def _outcome(prints: DataFrame, groups: DataFrame) -> DataFrame:
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return prints.join(groups, _KEY, "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
