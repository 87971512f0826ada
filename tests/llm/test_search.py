"""Ranked search, token alignment and vector near-duplicates against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import lexical_search, token_alignment, vector_dedup

# -- ranked search ---------------------------------------------------------------------


def terms_by_hand(text):
    runs = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda c: c[0].lower(), r) for r in runs]


def ranking_by_hand(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score); docs and items are (id, text) rows."""
    held = [(i, Counter(terms_by_hand(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = terms_by_hand(text), []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(scores)[:k], start=1):
            out.append((item, rank, None if missing else doc, -score))
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    df = lexical_search.search(
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING"),
        spark.createDataFrame(items, "item_id BIGINT, text STRING, rank INT, score INT"), **options)
    return sorted([tuple(r) for r in df.collect()], key=repr)


def searched_rows(seed, n_docs):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Éa", "éa", "É", "x1", "naïve", "ßtraße", "中文", "rare"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, rng.choice([" ", ", ", "\x7f", "_", "-\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 12, 40]))))
            for i in range(n_docs)]
    docs += [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "?!"), (3, docs[3][1]), (None, docs[4][1]), (None, docs[4][1]),
             (n_docs + 3, "THE the The " * 3000)]
    docs += [(n_docs + 10 + i, docs[7][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choices(vocabulary + ["absent"], k=rng.choice([1, 2, 8, 30]))), 1, 2) for i in range(15)]
    return docs, items + [(90, None, 1, 2), (91, "", 1, 2), (92, "absent", 1, 2), (None, "the rare", 1, 2), (5, "w7 w7 w7", 1, 2)]


@pytest.mark.parametrize("block, leaf, chunk", [(16_384, 16, 8 << 20), (64, 2, 700), (7, 1, 8 << 20)])
def test_ranking_is_exact(spark, monkeypatch, block, leaf, chunk):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    docs, items = searched_rows(block, 400)
    want = ranking_by_hand(docs, [i[:2] for i in items])
    assert ranked(spark, docs, items, chunk_bytes=chunk) == want


def test_subtrees_are_left_out(spark, monkeypatch):
    """The bounds spare most leaves, and without them the answer is the same."""
    docs, items = searched_rows(3, 3000)
    df = Counter(t for _, text in docs for t in set(terms_by_hand(text)))
    order = {t: r for r, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    rows = [Counter(order[t] for t in terms_by_hand(text)) for _, text in docs]
    rows = [c for c in rows if c]
    bounds = np.cumsum([0, *map(len, rows)])
    terms, counts = (np.array([x for c in rows for x in part(c)]) for part in (dict.keys, dict.values))
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    tree = lexical_search.DocumentTree(np.arange(len(rows)), np.full(len(rows), 80), bounds, terms, counts)
    summed, whole = [], lexical_search.DocumentTree._sums
    monkeypatch.setattr(lexical_search.DocumentTree, "_sums", lambda self, w, t, g, b: summed.append(b[-1] - b[0]) or whole(self, w, t, g, b))
    weights = np.zeros(len(df), dtype=np.int64)
    weights[[order["rare"], order["the"]]] = 3000, 10
    empty = (np.empty(0, np.int64), np.empty(0, np.int64))
    scores, ids = tree.search(weights, empty, 5)
    every = [(-sum(int(weights[t]) * ((10**9 * n) // (1000 * n + 640)) for t, n in c.items()), i) for i, c in enumerate(rows)]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == sorted(every)[:5]
    assert sum(summed) < 0.7 * bounds[-1]


def test_ranking_of_nothing(spark):
    assert ranked(spark, [], [(1, "a b", 1, 2)]) == []
    assert ranked(spark, [(1, "a b")], []) == []
    assert ranked(spark, [(1, None), (2, "..")], [(1, "a b", 1, 2)]) == []


# -- token alignment -------------------------------------------------------------------

def tokens_by_hand(text):
    """((id, bytes) of both sides) straight from the two libraries; empty where they do not give the text back."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens_by_hand, "held"):
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        tokens_by_hand.held = a, b
    a, b = tokens_by_hand.held
    if not text:
        return [], []
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(c): c for c in printable} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in printable)}
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(stand_in[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    good = b"".join(x for _, x in left) == raw == b"".join(x for _, x in right)
    return (left, right) if good else ([], [])


def aligned_by_hand(text):
    """(groups as text, links as a list of id pairs)."""
    left, right = tokens_by_hand(text)
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, data in side:
            out.append((i, at, at + len(data)))
            at += len(data)
        spans.append(out)
    both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, begin = [], 0
    for end in both:
        groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in spans))
        begin = end
    links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e]
    return ";".join(groups), links


def alignment_by_hand(rows):
    found = [aligned_by_hand(t) for _, t in rows]
    count = Counter(pair for _, links in found for pair in set(links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, text), (groups, links) in zip(rows, found):
        left, right = tokens_by_hand(text)
        out.append((
            doc, len(left), len(right), len(groups.split(";")) if groups else 0, len(links),
            sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


AWKWARD_TEXTS = [
    None, "", " ", "\n", "a", " lead", "trail ", "two  spaces", "line\nbreak here\nand there", "tabs\tin it", "naïve café 中文 😀 emoji",
    "<|endoftext|> and <s> </s> <0x41> <unk>", "▁ under ▁score", "nul\0byte", "don't WON'T 1,000.50 https://x.y/z?q=1&r=2",
    "x" * 700, "é" * 300, "a\r\nb", " nbsp　wide", "é combining", "١٢٣ arabic digits", "​zero width", "ﬁ ligature ™",
]


def test_alignment_equals_the_libraries(spark, awkward, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = list(enumerate(AWKWARD_TEXTS + texts)) + [(4, "a"), (None, "no id"), (None, "no id")]
    rows += [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    a, b = token_alignment.default_paths()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id BIGINT, text STRING, groups STRING, n_a INT")
    staged = token_alignment.staged_alignment(docs, a, b)
    want = alignment_by_hand(rows)
    for most in (token_alignment.RANGE_PAIRS, 300):
        scored = token_alignment.with_link_counts(staged, token_alignment.b_size(b), most)
        got = scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted([tuple(r) for r in got.collect()], key=repr) == want


def test_groups_and_links_are_given_out(spark):
    rows = [(1, "unbelievable tokenizations\nof straße"), (2, None)]
    a, b = token_alignment.default_paths()
    found = token_alignment.align(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), a, b).persist()
    groups, links = aligned_by_hand(rows[0][1])
    assert [(r.doc_id, r.groups) for r in found.orderBy("doc_id").collect()] == [(1, groups), (2, "")]
    got = token_alignment.link_rows(found, token_alignment.b_size(b)).collect()
    assert {(r.a_id, r.b_id): r.times for r in got} == Counter(links) and {r.doc_id for r in got} == {1}
    found.unpersist()


def test_pointer_jumping():
    """Against walking the two lists of ends side by side."""
    rng = random.Random(2)
    for _ in range(300):
        last = rng.randint(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), rng.randint(1, last)), last})) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        left, right = token_alignment.jump(a, b)
        assert left.tolist() == [next(i for i, e in enumerate(both) if x <= e) for x in a]
        assert right.tolist() == [next(i for i, e in enumerate(both) if x <= e) for x in b]
    assert [len(x) for x in token_alignment.jump(np.empty(0, int), np.empty(0, int))] == [0, 0]


def test_alignment_of_nothing(spark, nothing):
    a, b = token_alignment.default_paths()
    staged = token_alignment.staged_alignment(nothing, a, b)
    assert token_alignment.with_link_counts(staged, token_alignment.b_size(b)).collect() == []


# -- vectors ---------------------------------------------------------------------------

def linked_by_hand(rows, threshold=0.98):
    """Sorted (vec_id, n_links, component_id, kept)."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))

    units = [unit(v) for _, v, _ in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            if label is not None and label == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) \
                    and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    smallest = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), vec_id), vec_id)
    out = [(v[0], links[i], smallest.get(root(i)), v[0] is not None and v[0] == smallest.get(root(i))) for i, v in enumerate(rows)]
    return sorted(out, key=repr)


def vector_rows(seed, width, spread):
    """Clusters, near copies around the threshold, a dense group, exact copies and awkward vectors."""
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))

    for label in (0, 1, 2):
        centres = rng.normal(size=(6, width)) * spread
        for _ in range(150):
            add(rng.normal(size=width) + centres[rng.integers(6)], label)
        for _ in range(60):
            base = np.array(rows[rng.integers(len(rows))][1])
            add(base * rng.uniform(0.1, 9) + rng.normal(size=width) * np.linalg.norm(base) / math.sqrt(width) * rng.uniform(0, 0.35), label)
    dense = rng.normal(size=width)
    for _ in range(200):
        add(dense + rng.normal(size=width) * np.linalg.norm(dense) / math.sqrt(width) * rng.choice([0.02, 0.05, 0.1]), 1)
    for _ in range(50):
        add(dense, 1)
    for v in (None, [], [0.0] * width, [None] + [1.0] * (width - 1), [math.nan] * width, [math.inf] * width, [1.0], [2.0], [1e30] * width, [1e-30] * width,
              [-0.0, 1.0] + [0.0] * (width - 2), [0.0, 1.0] + [-0.0] * (width - 2)):
        add(v, 1)
    add(dense, None)
    rows += [(None, dense.tolist(), 1), (None, [5.0] * width, 2), rows[700], rows[700]]
    return rows


@pytest.mark.parametrize("width, spread, cell, block", [(8, 0.0, 512, 8192), (8, 3.0, 40, 8192), (64, 0.0, 60, 100), (3, 1.0, 30, 16), (2, 2.0, 20, 9)])
def test_vector_links_are_exact(spark, monkeypatch, width, spread, cell, block):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "DEAL", 100)
    rows = vector_rows(width + cell, width, spread)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, cell STRING, m INT")
    got = sorted([tuple(r) for r in vector_dedup.near_duplicate_vectors(df).collect()], key=repr)
    assert got == linked_by_hand(rows)


def test_pivots_split_clusters_and_not_dense_groups():
    rng = np.random.default_rng(1)
    clusters = vector_dedup.unit_rows(np.repeat(rng.normal(size=(8, 16)), 40, axis=0) + rng.normal(size=(320, 16)) * 0.03)
    pivots, copies = vector_dedup.choose_pivots(rng.permutation(clusters), 0.2, 1.0)
    assert len(pivots) == 8 and copies < 1.2
    dense = vector_dedup.unit_rows(np.ones((200, 16)) + rng.normal(size=(200, 16)) * 0.02)
    assert len(vector_dedup.choose_pivots(dense, 0.2, 1.0)[0]) == 1


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    assert vector_dedup.near_duplicate_vectors(df).collect() == []


def test_vectors_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert sorted([tuple(r) for r in vector_dedup.near_duplicate_vectors(df).collect()], key=repr) == linked_by_hand(rows)
