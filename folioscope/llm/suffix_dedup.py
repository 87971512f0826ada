"""Removal of repeated 100-byte strings by suffix arrays over anchored contexts.

Every 100-byte window chooses an anchor, the 32-byte string in it with the smallest hash (the first
of equal ones); equal windows choose equal anchors at equal places. Runs of windows with one anchor
form a context. Anchors that occur once anywhere are done with. Of the others, occurrences with the
same context are repeats of the first as a whole; the different contexts of one anchor are laid
side by side, their suffixes are sorted by linear grouping, and neighbours that agree in 100 bytes are
repeats too. Only the stretch of a context that another one shares around the anchor is sorted. The
different contexts of an anchor with very many of them are first cut in two, the windows that begin near
the anchor and those that begin far before it, each kept apart by the 65 bytes that all its windows
hold; where very many still share these, the parts are cut to thirds and fourths. A context that was there
before is a repeat as a whole and is never cut, so each cut works on different strings only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keyed_texts, release, same_document, stage_once
from folioscope.llm.suffix_array import suffix_array
from folioscope.runtime import broadcast_if_small

LENGTH = 100
GRAM = 32
# Window starts looked at in one numpy step.
BLOCK = 1 << 20
# Different contexts of one anchor that are sorted together; beyond, contexts are cut to smaller parts.
KINDS = 500
# Window starts of a part, each a multiple of the next. Two parts of the first size make up a context; a part
# of one window has no different contexts.
PARTS = (36, 12, 4, 1)


def anchor_runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, last window start, anchor position, anchor hash) of all runs in the text."""
    parts = [_block_runs(data[at:at + BLOCK + length - 1], at, length) for at in range(0, max(len(data) - length + 1, 0), BLOCK)]
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _block_runs(data: np.ndarray, begin: int, length: int) -> tuple:
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    x = _mixed(x[:-8], x[8:])
    gram = _mixed(x[:-16], x[16:])
    # The low bits hold the place, so that the smallest is also the first of equal hashes.
    least = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    return first + begin, last + begin, anchor[first] + begin, gram[anchor[first]]


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) to rows (anchor, doc_id, h, place); place packs position and both distances."""
    for batch in batches:
        rows, hashes, places, size = [], [], [], 0

        def closed():
            keys = batch.select([0, 1]).take(pa.array(np.concatenate(rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), *keys.columns, pa.array(np.concatenate(places))],
                names=["anchor", "doc_id", "h", "place"])

        for row in range(batch.num_rows):
            data = np.frombuffer(batch.column(2)[row].as_buffer(), dtype=np.uint8)
            first, last, at, gram = anchor_runs(data)
            if len(at):
                rows.append(np.full(len(at), row))
                hashes.append(gram)
                places.append(at << 16 | (at - first) << 8 | (at - last))
                size += len(at)
            if size > 200_000:
                yield closed()
                rows, hashes, places, size = [], [], [], 0
        if rows:
            yield closed()


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text, [(anchor, place)]) to rows (anchor, doc_id, h, place, context); a place counts once."""
    for batch in batches:
        rows, anchors, places, contexts = [], [], [], []

        def closed():
            keys = batch.select([0, 1]).take(pa.array(np.concatenate(rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(anchors)), *keys.columns, pa.array(np.concatenate(places)), pa.array(contexts, pa.binary())],
                names=["anchor", "doc_id", "h", "place", "context"])

        lists = batch.column(3)
        flat, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        every_anchor, every_place = flat.field("anchor").to_numpy(), flat.field("place").to_numpy()
        for row, end in enumerate(ends.tolist()):
            own = slice(0 if row == 0 else int(ends[row - 1]), end)
            place, first = np.unique(every_place[own], return_index=True)
            data = batch.column(2)[row].as_buffer().to_pybytes()
            at = place >> 16
            begins, stops = (at - (place >> 8 & 255)).tolist(), (at - (place & 255) + LENGTH).tolist()
            rows.append(np.full(len(place), row))
            anchors.append(every_anchor[own][first])
            places.append(place)
            contexts += [data[b:e] for b, e in zip(begins, stops)]
            if len(contexts) > 50_000:
                yield closed()
                rows, anchors, places, contexts = [], [], [], []
        if contexts:
            yield closed()


def earlier_windows(contexts: list[bytes], places: list[tuple]) -> list[list[list[int]]]:
    """Per context the runs [a, b] of window starts in it that an earlier place also has.

    `places[k]` is the place of the first window of context k, its last part the position.
    """
    marks = len(contexts)
    symbols: list[int] = []
    for k, context in enumerate(contexts):
        symbols += [byte + marks for byte in context]
        symbols.append(k)  # end marks differ and sort before all bytes
    sizes = np.array([len(context) for context in contexts])
    opens = np.cumsum(sizes + 1) - sizes - 1
    order = np.array(suffix_array(symbols))
    holder = np.searchsorted(opens, order, side="right") - 1
    inside = order - opens[holder]
    full = inside <= sizes[holder] - LENGTH
    owners, inner = holder[full].tolist(), inside[full].tolist()
    windows = [contexts[k][i:i + LENGTH] for k, i in zip(owners, inner)]
    found: list[list[int]] = [[] for _ in contexts]
    begin = 0
    for end in range(1, len(windows) + 1):
        if end < len(windows) and windows[end] == windows[begin]:
            continue
        if end - begin > 1:
            own = [(*places[owners[i]][:-1], places[owners[i]][-1] + inner[i]) for i in range(begin, end)]
            first = min(own)
            for i, place in zip(range(begin, end), own):
                if place != first:
                    found[owners[i]].append(inner[i])
        begin = end
    runs = []
    for own in found:
        joined: list[list[int]] = []
        for a in sorted(own):
            if joined and a == joined[-1][1] + 1:
                joined[-1][1] = a
            else:
                joined.append([a, a])
        runs.append(joined)
    return runs


def _alike(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _most_alike(strings: list[bytes]) -> list[int]:
    """Per string the longest beginning that another one has too: that of a neighbour in sorted order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for x, y in zip(order, order[1:]):
        own = _alike(strings[x], strings[y])
        best[x], best[y] = max(best[x], own), own
    return best


def shared_stretches(contexts: list[bytes], at: list[int]) -> list[tuple[int, int]]:
    """Per context (with the anchor at these places) the bytes from begin to end that others may have around the anchor.

    Windows of two contexts can only be equal at the same distance from the anchor, so what they share
    lies within these bytes.
    """
    left = _most_alike([c[:q][::-1] for c, q in zip(contexts, at)])
    right = _most_alike([c[q:] for c, q in zip(contexts, at)])
    return [(q - x, q + y) for q, x, y in zip(at, left, right)]


def sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, [(c, context, last, doc_id, h, place)]) to rows (anchor, c, runs) of contexts with repeats."""
    for batch in batches:
        anchors, ids, found = [], [], []
        lists = batch.column(1)
        flat = lists.flatten()
        bounds = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())))).tolist()
        contexts, place = flat.field("context").to_pylist(), flat.field("place").to_numpy()
        names, last, doc, h = (flat.field(c) for c in ("c", "last", "doc_id", "h"))
        before, position = (place >> 8 & 255).tolist(), (place >> 16).tolist()
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            near = [(a + k, x, y) for k, (x, y) in enumerate(shared_stretches(contexts[a:b], before[a:b])) if y - x >= LENGTH]
            if len(near) < 2:
                continue
            places = [(last[k].as_py(), 0 if last[k].as_py() else doc[k].as_py(), h[k].as_py(), position[k] - before[k] + x) for k, x, _ in near]
            for (k, x, _), runs in zip(near, earlier_windows([contexts[k][x:y] for k, x, y in near], places)):
                if runs:
                    anchors.append(batch.column(0)[row].as_py())
                    ids.append(names[k].as_py())
                    found.append([[s + x, e + x] for s, e in runs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors, pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int64())))],
            names=["anchor", "c", "runs"])


def cut_parts(contexts: DataFrame, size: int, whole: int) -> DataFrame:
    """(doc_id, h, place, context) with windows of one part of `whole` to (anchor, doc_id, h, place, context) of parts of `size`.

    Part r has the windows that start from size * r to size * (r + 1) - 1 bytes before the anchor; its
    own anchor is a hash of r and of the bytes that all of these windows hold.
    """
    before, least = (F.shiftright("place", by).bitwiseAND(F.lit(255)).cast("int") for by in (8, 0))
    first = F.floor(least / whole).cast("int") * (whole // size)
    cut = []
    for k in range(whole // size):
        part = first + k
        near, far = F.greatest(least, part * size), F.least(before, part * size + size - 1)
        # The anchor is `before` bytes into the context; windows lie `near` to `far` before it.
        shared = F.substring("context", before - part * size + 1, F.lit(LENGTH - size + 1))
        place = F.shiftleft(F.shiftright("place", 16), 16).bitwiseOR(F.shiftleft(far.cast("bigint"), 8)).bitwiseOR(near.cast("bigint"))
        cut.append(contexts.filter(near <= far).select(
            F.xxhash64(shared, part).alias("anchor"), "doc_id", "h", place.alias("place"),
            F.substring("context", before - far + 1, far - near + LENGTH).alias("context")))
    return reduce(DataFrame.unionByName, cut)


def keep_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text, [(s, e)] or NULL) to (doc_id, h, n_bytes, n_removed, spans, kept)."""
    for batch in batches:
        values = batch.column(3).to_pylist()
        spans, kept, removed, sizes = [], [], [], []
        for row, cuts in enumerate(values):
            data = batch.column(2)[row].as_py()
            joined: list[list[int]] = []
            for cut in sorted((c["s"], c["e"]) for c in cuts or []):
                if joined and cut[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], cut[1])
                else:
                    joined.append(list(cut))
            bounds = [0, *[x for span in joined for x in span], len(data)]
            sizes.append(len(data))
            removed.append(sum(e - s for s, e in joined))
            spans.append(joined)
            kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
            names=["doc_id", "h", "n_bytes", "n_removed", "spans", "kept"])


def _first_start(place: Column) -> Column:
    return F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(F.lit(255))


def _end(place: Column) -> Column:
    return F.shiftright(place, 16) - place.bitwiseAND(F.lit(255)) + LENGTH


def repeated_bytes(texts: DataFrame, kinds: int = KINDS) -> DataFrame:
    """(doc_id, h, s, e): byte spans, e exclusive, of 100-byte strings that start earlier elsewhere.

    `texts` is (doc_id, text, h). Order is by id (NULL ids last), text hash and position. Spans of a
    document may overlap.
    """
    id_type = texts.schema["doc_id"].dataType.simpleString()
    binary = texts.select("doc_id", "h", F.col("text").cast("binary").alias("text"))
    anchors = stage_once(binary.filter(F.octet_length("text") >= LENGTH).mapInArrow(
        find_anchors, f"anchor bigint, doc_id {id_type}, h bigint, place bigint"), "anchors")
    repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    candidates = stage_once(anchors.join(repeated, "anchor"), "repeated-anchors")
    release(anchors)
    lists = candidates.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "place")).alias("found"))
    with_text = binary.join(lists, same_document(binary, lists)).select(
        binary["doc_id"], binary["h"], "text", "found")
    schema = f"anchor bigint, doc_id {id_type}, h bigint, place bigint, context binary"
    contexts = stage_once(with_text.mapInArrow(cut_contexts, schema).withColumn("c", F.xxhash64("context")), "contexts")
    release(candidates)
    found, whole = [], 2 * PARTS[0]
    for size in (*PARTS, None):
        spans, rest = _resolve(contexts, kinds if size else None)
        found.append(spans)
        if size is None or rest.isEmpty():
            break
        contexts = stage_once(cut_parts(rest, size, whole).withColumn("c", F.xxhash64("context")), "context-parts")
        whole = size
    return reduce(DataFrame.unionByName, found)


def _resolve(contexts: DataFrame, kinds: int | None) -> tuple[DataFrame, DataFrame]:
    """Spans of repeated strings among contexts whose anchor has at most `kinds` different ones (None: any
    number), and of all later copies of a context; the different contexts of the other anchors, once each."""
    last = F.col("doc_id").isNull().alias("last")
    # An anchor's hash and the context's name a context; the first of it is found before the shuffle.
    distinct = stage_once(contexts.groupBy("anchor", "c").agg(
        F.min(F.struct(last, "doc_id", "h", "place")).alias("first"), F.any_value("context").alias("context")), "distinct-contexts")
    counted = stage_once(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "context-kinds")
    few = F.lit(True) if kinds is None else F.col("kinds") <= kinds
    several = counted.filter(few & (F.col("kinds") > 1)).select("anchor")
    many = counted.filter(~few).select("anchor")
    groups = distinct.join(several, "anchor").groupBy("anchor").agg(
        F.collect_list(F.struct("c", "context", "first.last", "first.doc_id", "first.h", "first.place")).alias("kinds"))
    runs = stage_once(groups.mapInArrow(sort_contexts, "anchor bigint, c bigint, runs array<array<bigint>>"), "repeated-runs")
    firsts = distinct.select("anchor", "c", "first").join(runs, ["anchor", "c"], "left")
    placed = contexts.select("anchor", "c", "doc_id", "h", "place").join(firsts, ["anchor", "c"])
    own = F.struct(last, "doc_id", "h", "place")
    whole = F.array(F.array(F.lit(0).cast("bigint"), _end(F.col("place")) - LENGTH - _first_start(F.col("place"))))
    cut = F.when(own.eqNullSafe(F.col("first")), F.col("runs")).otherwise(whole)
    spans = placed.select("doc_id", "h", _first_start(F.col("place")).alias("at"), F.explode(cut).alias("run")).select(
        "doc_id", "h", (F.col("at") + F.col("run")[0]).alias("s"), (F.col("at") + F.col("run")[1] + LENGTH).alias("e"))
    # An anchor of many holds over `kinds` contexts, so there are far fewer such anchors than contexts.
    rest = stage_once(distinct.join(broadcast_if_small(many), "anchor").select("first.doc_id", "first.h", "first.place", "context"), "hot-contexts")
    return spans, rest


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: int = KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), one row per row of `docs`: the bytes left of every text.

    A byte goes if a 100-byte string that covers it also starts earlier, in the input as it is. Texts
    are UTF-8 bytes, NULL is empty; `kept` may end inside a character. Rows that repeat id and text
    are one document and share their result; an empty table gives an empty result; further columns are
    ignored.
    """
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_bytes(texts, kinds)
    cuts = stage_once(spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("cuts")), "cuts").hint("merge")
    binary = texts.select("doc_id", "h", F.col("text").cast("binary").alias("text"))
    joined = binary.join(cuts, same_document(binary, cuts), "left").select(
        binary["doc_id"], binary["h"], "text", "cuts")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        keep_rest, f"doc_id {id_type}, h bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    ).drop("h")
