"""Near-duplicates by SimHash, compared exactly tile against tile.

Distinct fingerprints are dealt to tiles by the population counts of their segments. Two
fingerprints within the radius differ by no more than the radius in these counts taken together,
so all other pairs of tiles are skipped unseen; what is left is compared by exclusive or and bit
count in numpy. The counts of tiles number at most (64 / segments + 1) ** segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keyed_texts, surviving_rows
from folioscope.llm.components import star_components
from folioscope.runtime import stage

# Fingerprints of one tile, on average.
TILE = 4096
# Fingerprints above which counts of 2 and of 4 segments are used: finer tiles, more skipped.
FINER = (20_000, 4_000_000)
_ROWS = 128


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `size` words of the lower-cased text; shorter texts are one run."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter((digest(joined[s:e], 42) for s, e in spans), dtype=np.uint64, count=len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp) per row; white space is ASCII, case is folded for A-Z only, NULL text is empty (0)."""
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", "h", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(shingle_hashes(text, shingle)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["doc_id", "h", "fp"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links (rows of two fingerprints) that connect all of `a` and `b` within `radius`.

    A cluster of n fingerprints yields n - 1 links, not n * n: links that only confirm a connection
    made before are left out.
    """
    nodes = np.concatenate((a, b)) if a is not b else a
    shift = len(a) if a is not b else 0
    parent = np.arange(len(nodes))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            parent[x] = parent[up]
            x = parent[x]

    for at in range(0, len(a), _ROWS):
        near = np.bitwise_count(a[at:at + _ROWS, None] ^ b[None, :]) <= radius
        for row in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[row]) + shift
            joined = np.unique(roots(np.append(found, at + row)))
            parent[joined] = joined[0]
    top = roots(np.arange(len(nodes)))
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return np.stack((nodes[moved], nodes[top[moved]]))


def _offsets(segments: int, radius: int) -> list[list[int]]:
    """Differences of segment counts whose absolute values add up to at most the radius."""
    steps = range(-radius, radius + 1)
    return [list(d) for d in product(steps, repeat=segments) if sum(map(abs, d)) <= radius]


def _segments(n: int) -> int:
    return 1 if n < FINER[0] else 2 if n < FINER[1] else 4


def fingerprint_links(prints: DataFrame, radius: int, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all pairs within `radius`."""
    segments = segments or _segments(prints.count())
    width, base = 64 // segments, 65
    mask = (1 << width) - 1 if width < 64 else -1
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit(mask))).cast("bigint") for s in range(segments)]
    cell = sum((c * base**s for s, c in enumerate(counts)), F.lit(0).cast("bigint"))
    placed = prints.select("fp", cell.alias("cell"))
    # At most (width + 1) ** segments rows: 83,521 for four segments.
    sizes = stage(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tile-sizes")
    tiles = (
        placed.join(F.broadcast(sizes), "cell")
        .withColumn("no", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("cell", "no").agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stage(tiles, "tiles")
    own = F.array(*[F.floor(F.col("cell") / base**s) % base for s in range(segments)])
    steps = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in d]) for d in _offsets(segments, radius)])
    inside = F.forall(F.zip_with("own", "step", lambda p, d: (p + d).between(0, width)), lambda ok: ok)
    target = F.aggregate(
        F.zip_with("step", F.array(*[F.lit(base**s).cast("bigint") for s in range(segments)]), lambda d, w: d * w),
        F.col("cell"), lambda acc, x: acc + x)
    partners = (
        sizes.select("cell", F.col("tiles").alias("a_tiles"), own.alias("own"), F.explode(steps).alias("step"))
        .filter(inside).select("cell", "a_tiles", target.alias("b_cell")).filter("b_cell >= cell")
    )
    others = sizes.select(F.col("cell").alias("b_cell"), F.col("tiles").alias("b_tiles"))
    pairs = (
        partners.join(F.broadcast(others), "b_cell")
        .withColumn("no", F.explode(F.sequence(F.lit(0), F.col("a_tiles") - 1)))
        .withColumn("b_no", F.explode(F.sequence(F.lit(0), F.col("b_tiles") - 1)))
        .filter("b_cell > cell OR b_no >= no").select("cell", "no", "b_cell", "b_no")
    )
    right = tiles.select(F.col("cell").alias("b_cell"), F.col("no").alias("b_no"), F.col("fps").alias("b_fps"))
    work = pairs.join(tiles, ["cell", "no"]).join(right, ["b_cell", "b_no"]).select(
        ((F.col("cell") == F.col("b_cell")) & (F.col("no") == F.col("b_no"))).alias("same"), "fps", "b_fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a = batch.column(1)[row].values.to_numpy().view(np.uint64)
                b = a if batch.column(0)[row].as_py() else batch.column(2)[row].values.to_numpy().view(np.uint64)
                links = close_pairs(a, b, radius)
                if links.size:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links], names=["u", "v"])

    # Every row is a piece of quadratic work of its own: deal the pairs evenly.
    return work.repartition(prints.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(compare, "u bigint, v bigint")


def near_duplicate_components(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id",
                              text_col: str = "text", tile: int = TILE, segments: int | None = None) -> DataFrame:
    """(doc_id, h, fp, component_id), one row per row of `docs`.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the
    smallest doc_id reached over links, the own one included (NULL ids only count where there is no
    other). Rows that repeat an id and text stay separate rows of one component. Texts without
    words have fingerprint 0 and are linked like any other.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "simhashes")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-simhashes")
    roots = star_components(fingerprint_links(distinct, radius, tile, segments))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "simhash-roots")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = stage(placed.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(by_print, "fp").select("doc_id", "h", "fp", "component_id")


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id.

    Where ids repeat or are NULL, the text hash decides among rows of that id; of rows that agree in
    both, one stays.
    """
    parts = near_duplicate_components(docs, **options)
    counted = parts.groupBy("component_id", "fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("component_id", "fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("k"))
    first = first.groupBy("component_id").agg(F.min("k").alias("k")).select("k.doc_id", "k.h", "k.n")
    return surviving_rows(docs, stage(first, "first-of-component"), options.get("id_col", "doc_id"), options.get("text_col", "text"))
