"""Token files: frequency-ranked ids in byte-aligned variable-length coding with control bytes.

A file is a Parquet table of blocks in document order. A block holds whole documents: their ids and
token counts, the vocabulary ids by falling frequency within the block, a stream of control bytes
(two bits per token: bytes minus one) and the stream of rank bytes, low byte first. Blocks decode
alone, by table lookup on the control bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import keyed_texts
from folioscope.llm.encoding import shared_encoder, text_groups
from folioscope.runtime import new_path

END_ID = 0
# Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 21
# Bytes of text encoded at a time: the more, the more words repeat.
GROUP_BYTES = 1 << 21
# Ids below this are counted in a table; sparse larger ones are sorted.
COUNTED_IDS = 1 << 22


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(vocabulary, control, data): ids ranked by falling frequency, ties by id."""
    if len(ids) and int(ids.max()) < COUNTED_IDS:
        counts = np.bincount(ids)
        used, known = np.flatnonzero(counts), ids
        counts = counts[used]
    else:
        used, known, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((used, -counts))
    rank_of = np.empty(int(known.max()) + 1 if len(ids) else 0, dtype="<u4")
    rank_of[used[order] if known is ids else order] = np.arange(len(used))
    ranks = rank_of[known]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    width = int(size.max()) if len(size) else 1
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[:len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width, dtype=np.uint8) < size[:, None]]
    return used[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def length_table() -> np.ndarray:
    """Byte lengths of the four tokens under each control byte."""
    control = np.arange(256)
    return np.stack([(control >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1)


def decode_block(vocabulary: bytes, control: bytes, data: bytes, n: int, table: np.ndarray) -> np.ndarray:
    """The ids of a block of `n` tokens."""
    sizes = table[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ends = np.cumsum(sizes)
    source = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    starts = ends - sizes
    ranks = source[starts].astype(np.int64)
    for byte in range(1, int(sizes.max()) if n else 1):
        longer = np.flatnonzero(sizes > byte)
        ranks[longer] |= source[starts[longer] + byte].astype(np.int64) << (8 * byte)
    return np.frombuffer(vocabulary, dtype="<u4")[ranks]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
          block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all texts, in ascending order of id (NULL ids first, ties by text hash), to a new folder.

    NULL text is empty: the end id alone. The write commits as a whole, so a lost executor's blocks
    are simply written again.
    """
    vocabulary = tokenizer or default_tokenizer()
    ordered = keyed_texts(docs, id_col, text_col).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    texts = ordered.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, doc_ids array<{kind}>, n_tokens array<int>, vocabulary binary, control binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encoder = shared_encoder(vocabulary, drops_space=False)
        doc_ids, counts, ids, total = [], [], [], 0
        names = [f.split(" ")[0] for f in schema.split(", ")]

        def closed(id_type: pa.DataType) -> pa.RecordBatch:
            columns = encode_block(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.array([[x for c in doc_ids for x in c.to_pylist()]], pa.list_(id_type)),
                pa.array([counts], pa.list_(pa.int32())), *[pa.array([c], pa.binary()) for c in columns],
            ], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            values = batch.column(1)
            for group in text_groups(values, GROUP_BYTES):
                own, sizes = encoder.encode(values[group])
                ends = np.cumsum(sizes)
                ids.append(np.insert(own, ends, np.uint32(end_id)))
                counts.extend((sizes + 1).tolist())
                doc_ids.append(batch.column(0).slice(group.start, group.stop - group.start))
                total += len(own) + len(sizes)
                if total >= block_tokens:
                    yield closed(id_type)
                    doc_ids, counts, ids, total, block = [], [], [], 0, block + 1
        if ids:
            yield closed(id_type)

    texts.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a written folder.

    start counts the ids of all documents before. Block counts are added up per part and over the
    parts (one row per part of the file).
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = blocks.select("part", "block", F.aggregate(
        "n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        parts.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("begin")), "part"
    ).select("part", "block", (F.col("begin") + F.col("inside")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = length_table()
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, docs, counts, vocabulary, control, data = (c[row] for c in batch.columns)
                sizes = counts.values.to_numpy()
                ids = decode_block(vocabulary.as_py(), control.as_py(), data.as_py(), int(sizes.sum()), table)
                ends = np.cumsum(sizes, dtype=np.int64)
                own = np.split(ids, ends[:-1])
                columns = [
                    pa.array(np.full(len(sizes), part.as_py(), dtype=np.int32)), pa.array(np.full(len(sizes), block.as_py(), dtype=np.int32)),
                    docs.values, pa.array(ends - sizes), pa.array(sizes.astype(np.int64)),
                    pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in own], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"part int, block int, doc_id {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint"
    ordered = blocks.select("part", "block", "doc_ids", "n_tokens", "vocabulary", "control", "data")
    decoded = ordered.mapInArrow(run, schema + (", ids array<bigint>" if keep_ids else ""))
    return decoded.join(begins, ["part", "block"]).withColumn("start", F.col("begin") + F.col("inside")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def round_trip(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False, **columns) -> DataFrame:
    """What `read` finds in the files that `write` made of `docs`, in the shared folder."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, **columns)
    return read(docs.sparkSession, path, keep_ids)
