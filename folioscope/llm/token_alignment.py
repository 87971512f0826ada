"""Alignment of two tokenizers by pointer jumping, and how often their ids stand for each other.

Tokens of both vocabularies cover the same bytes. Every token points to the farthest-right token
that overlaps it; doubling these pointers leads each token to the last one of its group, so equal
targets are a group. Groups end where tokens of both sides end.

Neither vocabulary has a token that reaches across the space before a word, so a text is cut into
words, each distinct word is aligned once (all new words of a batch in the same arrays), and a text
is put together from what its words gave. Texts with unusual white space are aligned as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.encoding import _ODD_SPACE, Encoder, byte_letters, text_groups
from folioscope.runtime import new_path, stage

# Words remembered before the memory is emptied, and links held with them: about 200 MB.
MAX_REMEMBERED, MAX_LINKS = 400_000, 8_000_000
# Id pairs whose counts are sent to the tasks at a time: 12 MB.
RANGE_PAIRS = 1_000_000

_ROWS = "groups string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, links binary"


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of both sides, given where they end; both sides end at the same place.

    An A token points to the B token that holds its last byte; a B token to the A token that reaches
    beyond its end, or to itself where none does: such a token is the last one of a group.
    """
    n = len(ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    beyond = ends_a[to_a] > ends_b if n else np.zeros(0, dtype=bool)
    target = np.concatenate((n + np.searchsorted(ends_b, ends_a), np.where(beyond, to_a, n + np.arange(len(ends_b)))))
    while True:
        farther = target[target]
        if np.array_equal(farther, target):
            break
        target = farther
    number = np.cumsum(~beyond) - 1
    return number[target[:n] - n], number[target[n:] - n]


class Aligner:
    """Groups and links of texts; remembers every word it has aligned."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, drops_space=False)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
            else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # The piece that stands alone before a word that does not follow a space.
        self.bare = self.b.encode("\n")[:-1]
        self.forget()

    def forget(self) -> None:
        self.a.forget()
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        # n_a, n_b, n_groups, n_links per word; n_a of -1: the two sides do not give the word's bytes.
        self.figures = array("q")
        self.links = array("q")

    @staticmethod
    def words(text: str) -> list[str] | None:
        """Words of a text, each after a space or with the line break it follows; None: only as a whole."""
        if _ODD_SPACE.search(text) or "<|" in text or "\0" in text or "▁" in text:
            return None
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return text.replace("\n", " \n").split(" ")

    def align(self, new: list[str], whole: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(groups as text, figures, links as pair numbers) of words and whole texts, one after the other."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        nothing = np.empty(0, dtype=np.int64)
        for key, in_b in zip(new + whole, self.b.encode(new + whole, num_threads=1)):
            lone = len(parts) >= len(new)
            if key[:1] == "\n" and not lone:
                raw, in_a, in_b = key.encode("utf-8", "surrogatepass"), self.a.ids_of(key), in_b[len(self.bare):]
            else:
                raw = (" " + key).encode("utf-8", "surrogatepass")
                in_a = self.a.whole(" " + key) if lone else self.a.ids_of(" " + key)
            ids = np.frombuffer(in_a, dtype=np.uint32).astype(np.int64)
            same = raw == b"".join([self.a_bytes[i] for i in ids.tolist()]) == b"".join([self.b_bytes[i] for i in in_b])
            parts.append((ids, np.array(in_b, dtype=np.int64)) if same and len(ids) else (nothing, nothing))
        n_a, n_b = (np.array([len(p[side]) for p in parts], dtype=np.int64) for side in (0, 1))
        a, b = (np.concatenate([nothing, *(p[side] for p in parts)]) for side in (0, 1))
        sizes = self.a_sizes[a]
        ends_a, ends_b = np.cumsum(sizes), np.cumsum(self.b_sizes[b])
        group_a, group_b = jump(ends_a, ends_b)
        first = np.searchsorted(ends_b, ends_a - sizes, side="right")
        per_a = np.searchsorted(ends_b, ends_a) - first + 1
        at = np.arange(per_a.sum()) - np.repeat(np.cumsum(per_a) - per_a - first, per_a)
        links = np.repeat(a, per_a) * len(self.b_bytes) + b[at]
        to_a, to_b = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
        links_before = np.concatenate(([0], np.cumsum(per_a)))
        strings, figures = [], []
        a_names, b_names = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_cuts = np.searchsorted(group_a, np.arange(group_a[-1] + 2 if len(group_a) else 1)).tolist()
        b_cuts = np.searchsorted(group_b, np.arange(group_b[-1] + 2 if len(group_b) else 1)).tolist()
        for x, y, u in zip(to_a[:-1].tolist(), to_a[1:].tolist(), np.diff(to_b).tolist()):
            if x == y:
                strings.append("")
                figures.extend((-1, 0, 0, 0))
                continue
            g, h = int(group_a[x]), int(group_a[y - 1]) + 1
            strings.append(";".join([
                f"{','.join(a_names[a_cuts[i]:a_cuts[i + 1]])}|{','.join(b_names[b_cuts[i]:b_cuts[i + 1]])}" for i in range(g, h)]))
            figures.extend((y - x, u, h - g, int(links_before[y] - links_before[x])))
        return strings, np.array(figures, dtype=np.int64), links

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(groups, figures by text, links of all texts in a row); a text without tokens has '' and zeros."""
        if len(self.index) > MAX_REMEMBERED or len(self.links) > MAX_LINKS:
            self.forget()
        keys = [self.words(text) if text else [] for text in texts]
        new = list(dict.fromkeys(w for words in keys if words for w in words if w not in self.index))
        strings, figures, links = self.align(new, [text for text, words in zip(texts, keys) if words is None])
        own = len(new)
        known, before = len(self.strings), len(self.links)
        self.index.update(zip(new, range(known, known + own)))
        self.strings += strings[:own]
        self.figures.frombytes(figures[:4 * own].tobytes())
        kept = int(figures[3:4 * own:4].sum())
        self.links.frombytes(links[:kept].tobytes())
        # Whole texts count as words behind all others, for this call only.
        picked, sizes, lone = array("q"), [], len(self.strings)
        for words in keys:
            if words is None:
                picked.append(lone)
                lone += 1
            else:
                picked.extend(map(self.index.__getitem__, words))
            sizes.append(1 if words is None else len(words))
        number, sizes = np.array(picked, dtype=np.int64), np.array(sizes, dtype=np.int64)
        table = np.concatenate((np.array(self.figures, dtype=np.int64), figures[4 * own:])).reshape(-1, 4)
        owner = np.repeat(np.arange(len(texts)), sizes)
        good = np.bincount(owner, weights=table[number, 0] < 0, minlength=len(texts)) == 0
        used = good[owner]
        number, owner = number[used], owner[used]
        sums = np.stack([np.bincount(owner, weights=table[number, c], minlength=len(texts)) for c in range(4)], axis=1).astype(np.int64)
        count = table[number, 3]
        starts = np.cumsum(table[:, 3]) - table[:, 3]
        source = np.arange(count.sum()) + np.repeat(starts[number] - (np.cumsum(count) - count), count)
        every = np.concatenate((np.array(self.links, dtype=np.int64), links[kept:]))
        names = self.strings + strings[own:]
        ends = np.cumsum(np.where(good, sizes, 0))
        flat = number.tolist()
        groups = [";".join([names[i] for i in flat[e - s:e]]) if g else "" for e, s, g in zip(ends.tolist(), sizes.tolist(), good.tolist())]
        return groups, sums, every[source]


def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process: what it remembers outlives the task."""
    import sys
    import types

    held = vars(sys.modules.setdefault("folioscope_aligners", types.ModuleType("folioscope_aligners")))
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Aligner(a_path, b_path)
    return held[a_path, b_path]


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Rising pair numbers as differences, byte planes apart, and how often each is linked: small once compressed."""
    steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps.T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    raw = np.frombuffer(data, dtype=np.uint8)
    steps = np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.int64)), np.ascontiguousarray(raw[8 * n:].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def b_size(b_path: str) -> int:
    """Number of B ids: a pair number is a * size + b."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups, n_a, n_b, n_groups, n_links, links), one row per row of `docs`; no shuffle.

    `groups` lists all groups as 'a1,a2|b1;a3|b2,b3'. `links` packs the distinct linked id pairs and how
    often each occurs (`unpack`, `link_rows`). A text that is NULL or empty, or whose tokens do not give
    back a space and the text on both sides, has no tokens: '' and zeros. Repeated rows and ids stay
    rows of their own; further columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_path, b_path)
        space = len(aligner.a_bytes) * len(aligner.b_bytes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts):
                groups, figures, links = aligner.texts(texts[part])
                owner = np.repeat(np.arange(len(groups)), figures[:, 3])
                keys, times = np.unique(owner * space + links, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(len(groups) + 1) * space)
                packed = [pack(keys[x:y] - i * space, times[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(groups, pa.string()), *(pa.array(figures[:, c]) for c in range(4)),
                     pa.array(packed, pa.binary())], names=["doc_id", "groups", "n_a", "n_b", "n_groups", "n_links", "links"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_ROWS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows of `aligned` hold an id pair linked; counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                found = [unpack(x.as_py())[0] for x in batch.column(0).slice(start, 2000)]
                own, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                merged, place = np.unique(np.concatenate((keys, own)), return_inverse=True)
                keys, counts = merged, np.bincount(place, weights=np.concatenate((counts, n))).astype(np.int64)
                if len(keys) > 4_000_000:
                    yield out()
                    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield out()

    return aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def link_rows(aligned: DataFrame, n_b: int) -> DataFrame:
    """(doc_id, a_id, b_id, times): the links of every document, one row per id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs, times = unpack(batch.column(1)[row].as_py())
                ids = batch.column(0).take(pa.array(np.full(len(pairs), row)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(pairs // n_b), pa.array(pairs % n_b), pa.array(times)], names=["doc_id", "a_id", "b_id", "times"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.select("doc_id", "links").mapInArrow(run, f"doc_id {kind}, a_id bigint, b_id bigint, times bigint")


def _id_ranges(counts: DataFrame, n_b: int, most: int) -> list[tuple[int, int]]:
    """Ranges of A ids with about `most` pairs each; one A id has at most as many as there are B ids."""
    per_id = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted((r.a, r.n) for r in per_id.collect())  # at most one row per A id
    cuts, held = [0], 0
    for a, n in sizes:
        if held and held + n > most:
            cuts.append(a)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], sizes[-1][0] + 1 if sizes else 1]))


def with_link_counts(aligned: DataFrame, n_b: int, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """Add `n_best` and `count_sum` to staged rows of `align`.

    count_sum adds up, over all links, how many rows hold the link's id pair; n_best counts the links
    whose pair is the most frequent one of its A id, ties included. The counts go to the tasks in
    ranges of A ids, one pass over the links per range, so that no task holds more than a range.
    """
    spark = aligned.sparkSession
    counts = stage(pair_counts(aligned), "pair-counts")
    numbered = aligned if "row" in aligned.columns else aligned.withColumn("row", F.monotonically_increasing_id())
    ranges = _id_ranges(counts, n_b, range_pairs)
    kept = [f for f in numbered.schema.fields if f.name != "links"]
    out = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def scored(rows: DataFrame, low: int, high: int, schema: T.StructType) -> DataFrame:
        part = counts.filter(F.col("pair").between(low * n_b, high * n_b - 1)).sort("pair").toArrow()
        keys, values = (part.column(c).to_numpy() for c in ("pair", "n"))
        if len(keys):
            opens = np.flatnonzero(np.diff(keys // n_b, prepend=-1))
            top = np.repeat(np.maximum.reduceat(values, opens), np.diff(np.append(opens, len(keys))))
        else:
            keys, values, top = np.array([-1]), np.zeros(1, np.int64), np.ones(1, np.int64)
        shared = spark.sparkContext.broadcast((keys, values, values == top))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values, best = shared.value
            for batch in batches:
                n_best, total = [], []
                for start in range(0, batch.num_rows, 1000):
                    links = [unpack(x.as_py()) for x in batch.column("links").slice(start, 1000)]
                    pairs, times = (np.concatenate([x[side] for x in links]) for side in (0, 1))
                    owner = np.repeat(np.arange(len(links)), [len(x[0]) for x in links])
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    here = keys[at] == pairs
                    owner, times, at = owner[here], times[here], at[here]
                    n_best.append(np.bincount(owner, weights=times * best[at], minlength=len(links)))
                    total.append(np.bincount(owner, weights=times * values[at], minlength=len(links)))
                sums = [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in (n_best, total)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in schema.fields[:-2]), *sums], names=[f.name for f in schema.fields])

        return rows.mapInArrow(run, schema)

    if len(ranges) == 1:
        return scored(numbered, *ranges[0], out).drop("row")
    row = T.StructType([f for f in out.fields if f.name in ("row", "n_best", "count_sum")])
    parts = None
    for low, high in ranges:
        part = stage(scored(numbered.select("row", "links"), low, high, row).filter("count_sum > 0"), "link-counts")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = numbered.drop("links").join(sums, "row", "left")
    return joined.fillna(0, ["n_best", "count_sum"]).drop("row")


def staged_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`align` written once: the groups as their SHA-256 (`groups_sha256`, '' without tokens), rows numbered (`row`)."""
    rows = align(docs, a_path, b_path, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    rows = rows.withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id())
    path = new_path(docs.sparkSession, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
