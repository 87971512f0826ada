"""Best-fit packing of token pieces into sequences of fixed capacity.

The histogram of piece lengths (at most `capacity` numbers) is packed on the driver: a configuration
linear program, solved by multiplicative weights whose columns are priced by a knapsack dynamic
program, is rounded down, and what is left is packed best fit first. The plan names how often each
configuration is used; pieces find their place in it by their rank among pieces of their length, so
no piece passes the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import keyed_texts
from folioscope.llm.encoding import shared_encoder, text_groups
from folioscope.runtime import stage

CAPACITY = 4096
END_ID = 1
# Length classes of the linear program, steps of the multiplicative weights and their decay.
CLASSES = 64
ROUNDS = 600
DECAY = 20.0
# Parts that pieces of one length are ranked in, so that a common length is not one task's work.
PARTS = 64
# Pieces of words whose ids a Python worker remembers; those of junk words do not come again.
PIECES = 150_000
# Documents turned into Python strings at a time, whatever the size of the Arrow batches.
_ROWS = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- pieces ------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, piece, start, length, ids_crc32[, ids]): the token ids of every text and an end id,
    cut after every `capacity` ids. NULL text is empty: one piece with the end id alone."""
    path = tokenizer or default_tokenizer()
    texts = keyed_texts(docs, id_col, text_col).select("doc_id", "h", "text")
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, h bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, drops_space=True, pieces=PIECES)
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            values = batch.column(2).to_pylist()
            for part in text_groups(values):
                ids, counts = encoder.encode(values[part])
                rows, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
                at = 0
                for row, count in zip(range(part.start, part.stop), counts.tolist()):
                    own = np.append(ids[at:at + count], np.uint32(end_id)).astype("<u4")
                    at += count
                    for number, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start:start + capacity]
                        rows.append(row)
                        pieces.append(number)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece))
                        if keep_ids:
                            kept.append(piece.tolist())
                keys = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
                columns = [*keys.columns, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                           pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "h", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, schema + (", ids array<bigint>" if keep_ids else ""))


# -- the plan, on the histogram alone ------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size goes into a most valuable multiset of total size at most `capacity`.

    Dynamic program over the room used, one size after the other; a stretch of `size` rooms at a time,
    since a room only depends on the one a size before it.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
        for begin in range(size, capacity + 1, size):
            end = min(begin + size, capacity + 1)
            added = best[begin - size:end - size] + value
            better = added > best[begin:end]
            best[begin:end][better] = added[better]
            choice[begin:end][better] = k
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = int(best.argmax())
    while choice[room] >= 0:
        counts[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return counts


def length_classes(histogram: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class number of every length (-1 where there is no piece): consecutive lengths of about equal total
    size share a class."""
    size = np.arange(len(histogram)) * histogram
    total = size.sum()
    number = np.full(len(histogram), -1)
    used = np.flatnonzero(histogram)
    middle = size.cumsum()[used] - size[used] / 2
    _, number[used] = np.unique((middle * classes / max(total, 1)).astype(np.int64), return_inverse=True)
    return number


def linear_program(histogram: np.ndarray, number: np.ndarray, rounds: int = ROUNDS, decay: float = DECAY) -> list[tuple[np.ndarray, float]]:
    """(configuration by class, amount): fractional packing of the classes, each as long as its longest piece.

    Multiplicative weights: as many sequences as the pieces fill are bought in equal steps. A class is
    worth exp(-decay * (share covered - share of steps done)) per piece wanted, so classes that
    fall behind gain; each step buys the configuration of most value.
    """
    capacity = len(histogram) - 1
    n = number.max() + 1
    if not n:
        return []
    sizes = np.array([np.flatnonzero(number == k)[-1] for k in range(n)])
    wanted = np.array([histogram[number == k].sum() for k in range(n)], dtype=float)
    bought = (np.arange(capacity + 1) * histogram).sum() / capacity / rounds
    covered = np.zeros(n)
    amounts: dict[tuple, float] = {}
    for step in range(rounds):
        share = covered / wanted
        # Behind the steps done a class counts fully by its size, ahead of them less and less.
        values = sizes * np.exp(-decay * (share - step / rounds))
        values[share >= 1] = 0.0
        config = knapsack(sizes, values, capacity)
        if not config.any():
            break
        used = config > 0
        times = min(bought, float((np.maximum(wanted - covered, 0)[used] / config[used]).max()))
        covered += config * times
        key = tuple(config.tolist())
        amounts[key] = amounts.get(key, 0.0) + times
    return [(np.array(key), amount) for key, amount in amounts.items()]


def _filled(left: np.ndarray, config: np.ndarray) -> np.ndarray:
    """`config` (pieces per length) with the longest pieces left that fit, one after the other."""
    space = len(left) - 1 - int((config * np.arange(len(left))).sum())
    while space:
        fits = np.flatnonzero((left - config)[:space + 1] > 0)
        if not len(fits):
            break
        length = int(fits[-1])
        times = min(space // length, int(left[length] - config[length]))
        config[length] += times
        space -= length * times
    return config


def _used_up(left: np.ndarray, config: np.ndarray, most: int | None = None) -> int:
    """How often a configuration can be taken from the pieces left; takes them."""
    used = config > 0
    times = int((left[used] // config[used]).min())
    times = times if most is None else min(times, most)
    left -= config * times
    return times


def packing_plan(histogram: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations (pieces per length) and how often each is used; together they hold the histogram exactly.

    Amounts of the linear program are rounded down and filled with real pieces, the longest of each
    class first, and the room that leaves with the best fitting other pieces; the rest is packed best
    fit, longest first. The number of configurations depends on the capacity, not on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    plan = []
    capacity = len(left) - 1
    if left[capacity]:
        full = np.zeros_like(left)
        full[capacity] = 1
        plan.append((full, int(left[capacity])))
        left[capacity] = 0
    number = length_classes(left)
    found = linear_program(left, number, rounds)
    # Configurations with the longest pieces first, while there are short ones to fill them.
    for by_class, amount in sorted(found, key=lambda f: tuple(f[0][::-1].tolist()), reverse=True):
        open_ = int(amount)
        while open_:
            # All pieces but the shortest by class; its place goes to whatever fits the room best.
            config = np.zeros_like(left)
            wanted = by_class.copy()
            wanted[np.flatnonzero(wanted)[0]] -= 1
            for k in np.flatnonzero(wanted)[::-1]:
                missing = int(wanted[k])
                for length in np.flatnonzero((number == k) & (left > 0))[::-1].tolist():
                    times = min(missing, int(left[length]))
                    config[length] += times
                    missing -= times
                    if not missing:
                        break
            config = _filled(left, config)
            if not config.any():
                break
            times = _used_up(left, config, open_)
            plan.append((config, times))
            open_ -= times
    while left.any():
        config = _filled(left, np.zeros_like(left))
        plan.append((config, _used_up(left, config)))
    return plan


@dataclass(frozen=True)
class Slots:
    """The plan by length: slots of one length are numbered over its configurations in turn."""

    first: dict[int, np.ndarray]      # slots of the length before this configuration
    per_sequence: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]   # first sequence of the configuration
    offset: dict[int, np.ndarray]     # where pieces of the length begin in the sequence


def slots(plan: list[tuple[np.ndarray, int]]) -> Slots:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            count = int(config[length])
            rows.setdefault(length, []).append((filled.get(length, 0), count, sequence, offset))
            filled[length] = filled.get(length, 0) + count * times
            offset += length * count
        sequence += times
    columns = {length: np.array(r, dtype=np.int64).T for length, r in rows.items()}
    return Slots(*[{length: c[k] for length, c in columns.items()} for k in range(4)])


# -- placement -----------------------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """Add sequence_id and offset to staged `pieces` (doc_id, h, piece, length, ...).

    Pieces of one length are alike: they are numbered within `parts` hash parts, and the counts of
    (length, part), at most capacity x parts numbers, give the rank among all. Pieces that agree in
    id, text and number get different places.
    """
    keyed = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(parts)).cast("int"))
    counts = keyed.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros((capacity + 1, parts), dtype=np.int64)
    table[counts["length"].to_numpy(), counts["__part"].to_numpy()] = counts["n"].to_numpy()
    before = table.cumsum(axis=1) - table
    plan = slots(packing_plan(table.sum(axis=1), rounds))
    shared = pieces.sparkSession.sparkContext.broadcast((before, plan))
    own = Window.partitionBy("length", "__part").orderBy("doc_id", "h", "piece")
    ranked = keyed.withColumn("__rank", F.row_number().over(own).cast("bigint") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, plan = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy() + before[lengths, batch.column("__part").to_numpy()]
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                r = rank[rows]
                at = np.searchsorted(plan.first[length], r, side="right") - 1
                r = r - plan.first[length][at]
                count = plan.per_sequence[length][at]
                sequence[rows] = plan.sequence[length][at] + r // count
                offset[rows] = plan.offset[length][at] + r % count * length
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name not in ("__part", "__rank")]
            names = [n for n in batch.schema.names if n not in ("__part", "__rank")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS,
         keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece.

    NULL and empty texts are packed as their end id alone; repeated rows are packed each; an empty
    table gives an empty result; further columns are ignored.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, keep_ids=keep_ids, id_col=id_col, text_col=text_col), "pieces")
    return place(pieces, capacity, rounds)
