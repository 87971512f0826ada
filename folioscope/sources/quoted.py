"""Delimited text with line breaks inside quoted values, read by many tasks per file.

A line break belongs to a value if an odd number of quotes stands before it. Every byte range of a
file counts its quotes; a running sum over the ranges tells each of them whether it begins inside a
value, and so which of its line breaks end a record. A record that crosses ranges is put together from
what its ranges hold of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.runtime import broadcast_if_small, ship, stage

ship(__name__)

# What a range holds of a record: all of it, its end, a part without either end, its beginning.
WHOLE, END, MIDDLE, BEGINNING = range(4)
_PARTS = "file string, block bigint, place bigint, kind int, text string"


def cut_lines(lines: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(first line, line after the last, kind) of the records in consecutive lines, and whether the lines end inside a value.

    `inside` tells whether the first line begins inside one.
    """
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    odd = ((np.cumsum(quotes) + inside) & 1).astype(bool)
    closed = np.flatnonzero(~odd)
    if not len(closed):
        return np.array([0]), np.array([len(lines)]), np.array([MIDDLE if inside else BEGINNING]), True
    first, last = np.concatenate(([0], closed[:-1] + 1)), closed + 1
    kind = np.full(len(closed), WHOLE)
    if inside:
        kind[0] = END
    if odd[-1]:
        first, last, kind = np.append(first, last[-1]), np.append(last, len(lines)), np.append(kind, BEGINNING)
    return first, last, kind, bool(odd[-1])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("line"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text): every record of the files of a folder, the header records among them.

    Quotes must be doubled inside values and stand nowhere else but around values. The records that begin
    a file have block 0 and place 0.
    """
    lines = _lines(spark, path)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes.cast("bigint")).alias("quotes"))
    # One row per range of a file.
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    known = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    known = broadcast_if_small(stage(known, "quote-parity"))
    numbered = lines.withColumn("no", F.monotonically_increasing_id())
    sorted_ = numbered.join(known, ["file", "block"], "left").sortWithinPartitions("file", "block", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The lines of the record that is open, and where it began.
        here, held, place, state, began = None, [], 0, False, WHOLE

        def out(texts: list, kinds: list, places: list) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([here[0]] * n, pa.string()), pa.array([here[1]] * n, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["file", "block", "place", "kind", "text"])

        for batch in batches:
            file, block, line, inside = (batch.column(c) for c in ("file", "block", "line", "inside"))
            codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = block.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                own = (file[a].as_py(), block[a].as_py())
                if own != here:
                    if held:
                        yield out(["\n".join(held)], [began], [place])
                    if inside[a].as_py() is None:
                        raise ValueError("the ranges of the file changed between two passes")
                    here, held, place, state = own, [], 0, inside[a].as_py()
                    began = MIDDLE if state else BEGINNING
                part = line.slice(a, b - a)
                first, last, kinds, state = cut_lines(part, state)
                values = part.to_pylist()
                texts, marks = [], []
                for x, y, kind in zip(first.tolist(), last.tolist(), kinds.tolist()):
                    text = values[x] if y == x + 1 else "\n".join(values[x:y])
                    if kind in (MIDDLE, BEGINNING):
                        held.append(text)
                        began = began if kind == MIDDLE else BEGINNING
                    elif kind == END:
                        # The open record ends; it is whole if it began in this range.
                        texts.append("\n".join([*held, text]))
                        marks.append(WHOLE if held and began == BEGINNING else END)
                        held, began = [], BEGINNING
                    else:
                        texts.append(text)
                        marks.append(WHOLE)
                if texts:
                    yield out(texts, marks, list(range(place, place + len(texts))))
                    place += len(texts)
        if held:
            yield out(["\n".join(held)], [began], [place])

    parts = stage(sorted_.mapInArrow(run, _PARTS), "record-parts")
    pieces = parts.filter(F.col("kind") != WHOLE)
    # At most two rows per range, without their texts: a beginning opens a record, the parts up to the next one go on with it.
    opened = F.sum((F.col("kind") == BEGINNING).cast("int")).over(Window.partitionBy("file").orderBy("block", "place"))
    order = pieces.select("file", "block", "place", opened.alias("record"))
    joined = pieces.join(order, ["file", "block", "place"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("p"))
    crossing = joined.select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return parts.filter(F.col("kind") == WHOLE).select("file", "block", "place", "text").unionByName(crossing)


def read_quoted(spark: SparkSession, path: str, schema: str, options: dict, sep: str = "\t") -> DataFrame:
    """Header table with an explicit schema whose files may be of any size."""
    records = read_records(spark, path).filter("block > 0 OR place > 0").filter(F.trim("text") != "")
    text = F.regexp_replace("text", "\r$", "")
    parse = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    parsed = records.select(F.from_csv(text, F.lit(schema), {**parse, "sep": sep}).alias("r"))
    return parsed.select("r.*")
