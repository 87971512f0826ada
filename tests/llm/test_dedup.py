"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from folioscope.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from folioscope.llm.components import star_components
from folioscope.llm.suffix_array import suffix_array


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# -- exact ---------------------------------------------------------------------

@pytest.mark.parametrize("part, per_salt", [(1 << 22, 2000), (7, 2)])
def test_exact_groups(awkward, part, per_salt):
    rows = awkward.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    expected = []
    for r in rows:
        own = groups[normal(r.text)]
        ids = [i for i in own if i is not None]
        keep = min(ids) if ids else None
        expected.append((r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(normal(r.text).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(awkward, part=part, per_salt=per_salt).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """A fingerprint that is always equal leaves the work to the comparison."""
    def constant(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            columns = batch.columns[:-1] + [pa.array([0] * n, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1] + ["f1", "f2", "m1", "m2", "n_bytes"])

    monkeypatch.setattr(exact_dedup, "part_fingerprints", constant)
    texts = ["a", "b", "a", "c", "b", "a", "longer text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, part=4, per_salt=2).collect()}
    assert got == {i: (texts.index(t), texts.count(t)) for i, t in enumerate(texts)}


# -- SimHash ---------------------------------------------------------------------

def simhash_by_hand(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + size]) for i in range(max(len(words) - size + 1, 1 if words else 0))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("segments, tile", [(1, 4096), (2, 3), (4, 2)])
def test_simhash_components(awkward, segments, tile):
    rows = awkward.select("doc_id", "text").collect()
    values = [simhash_by_hand(r.text, 4) for r in rows]
    roots = components_by_hand(values, 4)
    smallest = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            smallest[root] = min(smallest.get(root, r.doc_id), r.doc_id)
    expected = [(r.doc_id, v, smallest.get(root)) for r, v, root in zip(rows, values, roots)]
    got = simhash.near_duplicate_components(awkward, shingle=4, radius=4, tile=tile, segments=segments).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got)


@pytest.mark.parametrize("segments, tile", [(1, 50), (2, 20), (4, 10)])
def test_tiles_lose_no_link(spark, segments, tile):
    rng = random.Random(8)
    values = set()
    while len(values) < 600:
        own = rng.getrandbits(64)
        values.add(own)
        for _ in range(rng.choice([0, 0, 1, 4])):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                own ^= 1 << bit
            values.add(own)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = spark.createDataFrame([(v,) for v in values], "fp BIGINT")
    links = simhash.fingerprint_links(prints, 4, tile, segments)
    roots = {r.node: r.root for r in star_components(links).collect()}
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), set()).add(v)
    by_hand = {}
    for v, root in zip(values, components_by_hand([v % (1 << 64) for v in values], 4)):
        by_hand.setdefault(root, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_hand.values()))


def test_close_pairs_of_a_cluster_are_a_tree():
    base = np.uint64(0x123456789ABCDEF0)
    cluster = np.unique(base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))
    assert simhash.close_pairs(cluster, cluster, 4).shape == (2, 63)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "u BIGINT, v BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(50)}}


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicate_components(nothing).collect() == []


def test_one_per_component_keeps_columns(awkward):
    kept = simhash.one_per_component(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 in ids and 8 not in ids


# -- shingle likeness ----------------------------------------------------------------

def shingles_by_hand(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))}


def near_copies(seed=12):
    """Clusters of texts with more and more words changed: likeness from 0.5 to 1 around shared passages."""
    rng = random.Random(seed)
    frame = [f"w{rng.randint(0, 300)}" for _ in range(40)]
    rows = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([6, 20, 80, 200]))] + frame
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, max(len(own) // 40, 1))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows), " "), (len(rows) + 1, "\n"), (len(rows) + 2, None)]


def test_pipeline_stage_links_within_four_bits(spark):
    """The stage keeps the smallest id of every component of four-word SimHashes within four bits."""
    rows = near_copies()
    prints = [simhash_by_hand(t, 4) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = [i for i in range(len(rows)) if root(i) == i]
    assert len(kept) < len(rows) - 10
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept


def test_rows_that_repeat_id_and_text_leave_one(spark):
    texts = ["one text of six words here", "some quite different words of another kind", "a third that has no company at all"]
    rows = [(None, texts[0])] * 40 + [(3, texts[1])] * 3 + [(9, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(r.text for r in simhash.one_per_component(docs).collect()) == sorted(texts)


# -- lines ---------------------------------------------------------------------------

def lines_by_hand(rows):
    docs = [(r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42), r[1] or "") for r in rows]
    signed = [(n, i, h - (1 << 64) if h >> 63 else h, t) for n, i, h, t in docs]
    first = {}
    for n, i, h, t in signed:
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            if any(ls[p:p + 3]):
                key = tuple(ls[p:p + 3])
                first[key] = min(first.get(key, (n, i, h, p)), (n, i, h, p))
    out = []
    for (n, i, h, t), r in zip(signed, rows):
        ls = t.split("\n")
        gone = {p + k for p in range(len(ls) - 2) for k in range(3)
                if any(ls[p:p + 3]) and first[tuple(ls[p:p + 3])] != (n, i, h, p)}
        kept = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out.append((r[0], kept if gone or r[1] is not None else None, len(gone)))
    return out


def test_line_windows(awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    result = line_dedup.without_repeated_lines(awkward)
    got = [(r.doc_id, r.text, r["__llm_removed"]) for r in result.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, lines_by_hand(rows)))
    assert set(awkward.columns) <= set(result.columns)


def test_line_windows_of_nothing(nothing):
    assert line_dedup.without_repeated_lines(nothing).collect() == []


# -- substrings -----------------------------------------------------------------------

@pytest.mark.parametrize("alphabet", [1, 2, 3, 200])
def test_suffix_array(alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        s = [rng.randint(0, alphabet) for _ in range(rng.randint(0, 60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeats_by_hand(texts):
    """Removed positions per text, texts in order of id."""
    seen, gone = set(), []
    for data in texts:
        own = set()
        for p in range(len(data) - 99):
            window = data[p:p + 100]
            if window in seen:
                own.update(range(p, p + 100))
            seen.add(window)
        gone.append(own)
    return gone


def check_repeats(df, rows, kinds):
    texts = [t.encode() for _, t in rows]
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df, kinds=kinds).collect()}
    for (doc_id, _), data, gone in zip(rows, texts, repeats_by_hand(texts)):
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        r = got[doc_id]
        spans = sum(1 for i in gone if i - 1 not in gone)
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == (len(data), len(gone), spans, kept), doc_id


@pytest.mark.parametrize("kinds", [500, 1])
def test_repeated_strings(plain, plain_rows, kinds):
    check_repeats(plain, plain_rows, kinds)


@pytest.mark.parametrize("kinds", [500, 2])
def test_repeated_strings_in_cut_up_passages(spark, kinds):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(90, 260))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts.append(p[a:a + rng.randint(60, 240)] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(50)))
        rows.append((i, "".join(parts)))
    rows += [(60, "a" * 350), (61, "b" + "a" * 99 + "c"), (62, "xy" * 120)]
    check_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), rows, kinds)


@pytest.mark.parametrize("kinds", [500, 20])
def test_one_anchor_of_thousands_of_contexts(spark, kinds):
    """A passage in all documents, shorter and longer than a window, between other bytes."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = []
    for i in range(2500):
        a, b = rng.choice([(0, 50), (0, 85), (10, 120), (0, 130)])
        side = lambda: "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 90)))
        rows.append((i, side() + line[a:b] + side()))
    check_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), rows, kinds)


def test_copies_of_contexts_are_not_cut(spark, monkeypatch):
    """Near copies: many different contexts of an anchor and far more copies of them; only the different ones go on."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(900):
        k = rng.randint(0, 399)
        rows.append((i, text if i % 9 else text[:k] + rng.choice("XYZ") + text[k + 1:]))
    cut, seen = suffix_dedup.cut_parts, []

    def counted(contexts, *rest):
        seen.append((contexts.count(), contexts.select("context").distinct().count()))
        return cut(contexts, *rest)

    monkeypatch.setattr(suffix_dedup, "cut_parts", counted)
    check_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), rows, 5)
    assert seen and all(n < 1.5 * different for n, different in seen), seen


@pytest.mark.parametrize("size, whole", [(36, 72), (12, 36), (4, 12), (1, 4)])
def test_parts_hold_every_window_once(spark, size, whole):
    """A cut keeps all windows of a context, each in one part that is named by bytes every window of the part holds."""
    rng = random.Random(size)
    contexts, windows = [], []
    for i in range(60):
        lowest = 0 if whole == 72 else rng.randrange(0, 69, 1) // whole * whole
        least = rng.randint(lowest, min(lowest + whole - 1, 68))
        before = rng.randint(least, min(lowest + whole - 1, 68))
        data = bytes(rng.choices(b"abc", k=before - least + 100))
        contexts.append((i, i, 1000 << 16 | before << 8 | least, data))
        windows += [(i, 1000 - before + p, data[p:p + 100]) for p in range(before - least + 1)]
    df = spark.createDataFrame(contexts, "doc_id BIGINT, h BIGINT, place BIGINT, context BINARY")
    found, named = [], {}
    for r in suffix_dedup.cut_parts(df, size, whole).collect():
        q, before, least = r.place >> 16, r.place >> 8 & 255, r.place & 255
        assert before // size == least // size and len(r.context) == before - least + 100
        found += [(r.doc_id, q - before + p, bytes(r.context[p:p + 100])) for p in range(before - least + 1)]
        part = before // size
        shared = bytes(r.context[before - part * size:][:101 - size])
        assert len(shared) == 101 - size and named.setdefault((part, shared), r.anchor) == r.anchor
    assert sorted(found) == sorted(windows) and len(set(named.values())) == len(named)


def test_stretches_hold_all_shared_windows():
    rng = random.Random(5)
    for _ in range(200):
        anchor = bytes(rng.choices(b"ab", k=32))
        at = [rng.randint(0, 68) for _ in range(rng.randint(2, 6))]
        contexts = [bytes(rng.choices(b"ab", [9, 1], k=q)) + anchor + bytes(rng.choices(b"ab", [9, 1], k=rng.randint(68, 100))) for q in at]
        for k, (x, y) in enumerate(suffix_dedup.shared_stretches(contexts, at)):
            for j in range(len(contexts)):
                for p in range(min(at[k], at[j]) + 1):
                    own, other = (c[q - p:q - p + 100] for c, q in ((contexts[k], at[k]), (contexts[j], at[j])))
                    if j != k and own == other and len(own) == 100:
                        assert x <= at[k] - p and at[k] - p + 100 <= y


def test_repeated_strings_with_awkward_rows(awkward, nothing):
    got = suffix_dedup.without_repeats(awkward).collect()
    assert len(got) == awkward.count()
    assert suffix_dedup.without_repeats(nothing).collect() == []
