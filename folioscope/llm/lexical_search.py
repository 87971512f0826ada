"""Ranked lexical search: every query item against all documents, by branch and bound on a document FP-tree.

Documents are reduced to their query terms. Within a task, blocks of these term vectors, each in
the order of falling document frequency, share the paths of a trie. Every node knows, for each term
below it, the largest occurrence count, and the smallest length figure `m`; together they bound the
score of all its documents. The search of an item goes depth first into the most promising child and
leaves out subtrees that cannot reach the ten best so far. Scores are whole numbers and exact.

Query terms are taken to the tasks in chunks of bounded size, so any number of items can be asked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stage_once
from folioscope.runtime import stage

# Text of the items that are answered in one pass over the documents.
CHUNK_BYTES = 8 << 20
# Documents of one tree, and documents below which a node is not split.
BLOCK, LEAF = 16_384, 16
# Fixed values of the ranking: share of the length in m, in hundredths; scale; saturation of counts.
LENGTH_SHARE, SCALE, COUNT_UNIT, LENGTH_UNIT = 75, 1_000_000_000, 1000, 8

_VECTOR = "n bigint, terms array<int>, counts array<int>"


def _separators() -> bytes:
    """Byte table of the term rule: ASCII letters in lower case, digits and bytes above ASCII stay, all others divide."""
    return bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in (ord(chr(i).lower()) if i < 0x80 else i for i in range(256)))


def terms_of(text: str, table: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and code points above ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(table).split()


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): number of all terms, and the distinct ones of the vocabulary with their counts.

    NULL texts and texts without terms are left out. One pass, no shuffle.
    """
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, _separators()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for batch in batches:
            kept, sizes, terms, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                words = text.as_py().encode("utf-8", "surrogatepass").translate(table).split()
                if words:
                    found = Counter([known[w] for w in words if w in known])
                    kept.append(row)
                    sizes.append(len(words))
                    terms.extend(found.keys())
                    counts.extend(found.values())
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists],
                names=["doc_id", "n", "terms", "counts"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_VECTOR}")


def length_figure(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _gains(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth per weight: grows with the count, falls with m."""
    return (SCALE * counts) // (COUNT_UNIT * counts + LENGTH_UNIT * m)


class DocumentTree:
    """FP-tree of a block of documents: nodes are runs of documents in trie order, children stand side by side."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        """`terms` holds each document's terms as frequency ranks (0: most frequent); `bounds` its slices."""
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        inner = np.lexsort((terms, owner))
        terms, counts = terms[inner], counts[inner]
        path = terms.astype(">u4").tobytes()
        order = sorted(range(len(ids)), key=lambda i: path[4 * bounds[i]:4 * bounds[i + 1]])
        lengths = np.diff(bounds)[order]
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        source = np.arange(self.bounds[-1]) + np.repeat(bounds[order] - self.bounds[:-1], lengths)
        self.terms, counts = terms[source], counts[source]
        self.ids, self.m = ids[order], m[order]
        self.gains = _gains(counts, np.repeat(self.m, lengths))
        self._grow(counts)

    def _grow(self, counts: np.ndarray) -> None:
        low, high, first, last = [0], [len(self.ids)], [0], [0]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF:
                # All documents of the run share what its first and last have in common.
                x, y = (self.terms[self.bounds[i]:self.bounds[i + 1]] for i in (a, b - 1))
                common = min(len(x), len(y))
                differ = np.flatnonzero(x[:common] != y[:common])
                depth = int(differ[0]) if len(differ) else common
                place = self.bounds[a:b] + depth
                inside = place < self.bounds[a + 1:b + 1]
                token = np.where(inside, self.terms[np.where(inside, place, 0)], -1)
                cuts = (np.flatnonzero(np.diff(token)) + 1 + a).tolist()
                if cuts:
                    first[at], last[at] = len(low), len(low) + len(cuts) + 1
                    low += [a, *cuts]
                    high += [*cuts, b]
                    first += [0] * (len(cuts) + 1)
                    last += [0] * (len(cuts) + 1)
            at += 1
        self.low, self.high, self.first, self.last = map(np.array, (low, high, first, last))
        # Largest count of every term below every node, some nodes at a time.
        ends, parts, size = [0], [], 0
        sizes = (self.bounds[self.high] - self.bounds[self.low]).tolist()
        begin = 0
        for node in range(len(low)):
            size += sizes[node]
            if size >= 1 << 20 or node + 1 == len(low):
                parts.append(self._maxima(counts, range(begin, node + 1)))
                begin, size = node + 1, 0
        self.node_terms = np.concatenate([p[0] for p in parts])
        maxima = np.concatenate([p[1] for p in parts])
        per_node = np.concatenate([p[2] for p in parts])
        self.node_bounds = np.concatenate((ends, np.cumsum(per_node)))
        smallest = np.array([self.m[a:b].min() for a, b in zip(low, high)])
        self.node_gains = _gains(maxima, np.repeat(smallest, per_node))

    def _maxima(self, counts: np.ndarray, nodes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slices = [slice(self.bounds[self.low[v]], self.bounds[self.high[v]]) for v in nodes]
        terms = np.concatenate([self.terms[s] for s in slices]).astype(np.int64)
        tf = np.concatenate([counts[s] for s in slices])
        node = np.repeat(np.arange(len(nodes)), [s.stop - s.start for s in slices])
        order = np.lexsort((terms, node))
        terms, tf, node = terms[order], tf[order], node[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(terms) != 0) | (np.diff(node) != 0))))
        return terms[starts], np.maximum.reduceat(tf, starts), np.bincount(node[starts], minlength=len(nodes))

    def _sums(self, weights: np.ndarray, terms: np.ndarray, gains: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a, b = bounds[0], bounds[-1]
        return np.add.reduceat(weights[terms[a:b]] * gains[a:b], bounds[:-1] - a)

    def search(self, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of `best` and this block; `weights` by term rank, zero for terms not asked."""
        scores, ids = best

        def least() -> int:
            """The score to reach: an equal one may still win by its id."""
            return int(scores[-1]) if len(scores) == k else 1

        root = self._sums(weights, self.node_terms, self.node_gains, self.node_bounds[:2])
        stack = [(int(root[0]), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < least():
                continue
            a, b = self.first[node], self.last[node]
            if a == b:
                x, y = self.low[node], self.high[node]
                own = self._sums(weights, self.terms, self.gains, self.bounds[x:y + 1])
                good = np.flatnonzero(own >= least())
                if len(good):
                    scores, ids = np.concatenate((scores, own[good])), np.concatenate((ids, self.ids[x + good]))
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                continue
            below = self._sums(weights, self.node_terms, self.node_gains, self.node_bounds[a:b + 1])
            open_ = np.flatnonzero(below >= least())
            for child in open_[np.argsort(below[open_], kind="stable")]:
                stack.append((int(below[child]), int(a + child)))
        return scores, ids


def _ranked(vectors: DataFrame, items: dict[int, Counter], k: int) -> DataFrame:
    """(item_no, doc_id, score): the k best documents of every task for every item."""
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r.term: r.df for r in found.collect()}  # at most one row per query term
    ranks = {term: rank for rank, term in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    weights = {term: weight(df[term], n_docs) for term in df}
    asked = {}
    for number, words in items.items():
        known = [(ranks[t], times * weights[t]) for t, times in words.items() if t in df and weights[t] > 0]
        if known:
            asked[number] = tuple(np.array(x, dtype=np.int64) for x in zip(*known))
    largest = max(df, default=-1) + 1
    by_term = np.full(largest, -1, dtype=np.int64)
    by_term[list(ranks)] = list(ranks.values())
    shared = vectors.sparkSession.sparkContext.broadcast((asked, by_term, len(ranks)))
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, by_term, width = shared.value
        best = {number: (np.empty(0, np.int64), np.empty(0, np.int64)) for number in asked}
        weights = np.zeros(width, dtype=np.int64)

        def search(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            terms, counts = (whole.column(c).chunk(0) for c in ("terms", "counts"))
            lengths = np.diff(terms.offsets.to_numpy())
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            m = np.array([length_figure(n, n_docs, n_terms) for n in whole.column("n").to_pylist()], dtype=np.int64)
            ids = whole.column("doc_id").to_numpy()
            tree = DocumentTree(ids, m, bounds, by_term[terms.flatten().to_numpy()], counts.flatten().to_numpy().astype(np.int64))
            for number, (at, w) in asked.items():
                weights[at] = w
                best[number] = tree.search(weights, best[number], k)
                weights[at] = 0

        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                held.append(part)
                rows += part.num_rows
                if rows >= block:
                    search(held)
                    held, rows = [], 0
        if rows:
            search(held)
        for number, (scores, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number)), pa.array(ids), pa.array(scores)], names=["item_no", "doc_id", "score"])

    asking = vectors.filter(F.size("terms") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "terms", "counts")
    # NULL ids stand behind all others among equal scores.
    last = (1 << 63) - 1
    rows = asking.withColumn("doc_id", F.coalesce("doc_id", F.lit(last))).mapInArrow(run, "item_no bigint, doc_id bigint, score bigint")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(last)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of `items` the k best rows of `docs` with a score above 0.

    A document's score sums, over the terms of the item with repeats, the term's weight times what its
    occurrences are worth; equal scores are in the order of the (whole-number) ids, NULL ids last.
    Rows of `docs` that repeat an id or text are documents of their own, and so are rows of `items`.
    Texts that are NULL or hold no term match nothing and count in no statistic; items of that kind, and
    empty tables, give no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    listed = stage(listed.withColumn("item_no", F.monotonically_increasing_id()), "items")
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(size / chunk_bytes))
    table, found = _separators(), None
    for chunk in range(chunks):
        # About chunk_bytes of text.
        rows = listed.filter(F.pmod(F.xxhash64("item_no"), F.lit(chunks)) == chunk).select("item_no", "text").collect()
        words = {r.item_no: Counter(terms_of(r.text, table)) for r in rows}
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
        asked = {number: Counter({vocabulary[w]: n for w, n in c.items()}) for number, c in words.items()}
        vectors = stage_once(term_vectors(docs, vocabulary, id_col, text_col), "term-vectors")
        part = _ranked(vectors, asked, k)
        if chunks > 1:
            part = stage(part, "ranked")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(listed.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
