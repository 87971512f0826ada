"""Language ID, personal data, fingerprints, tokens, packing, mixing and the pipeline."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import encoding, language_id, mixing, order_minhash, packing, pii, queries, token_files

WORDS = {"en": "the of and house river with stone", "de": "der und das haus fluss mit stein", "fr": "le et la maison avec fleuve pierre"}


# -- language ---------------------------------------------------------------------

def sentences(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(30)), lang))
    return rows


def counts_by_hand(text, bits):
    letters = re.sub(r"[\W\d_]+", "\0", "\0" + text.lower() + "\0")
    found = {}
    mask = (1 << 32) - 1
    for n in range(1, language_id.ORDERS + 1):
        for i in range(len(letters) - n + 1):
            state = 2166136261
            for c in letters[i:i + n]:
                state = ((state ^ ord(c)) * 16777619) & mask
                state ^= state >> 15
            bucket = ((state * 2654435761) & mask) >> (32 - bits)
            found[bucket] = found.get(bucket, 0) + 1
    return found


def test_language_scores_match_brute_force(spark):
    rows = sentences(60)
    train = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    model = language_id.fit(train, bits=10)
    assert model.languages == ["de", "en", "fr"]
    cells = np.full((3, 1024), language_id.SMOOTHING)
    for _, text, lang in rows:
        for bucket, n in counts_by_hand(text, 10).items():
            cells[model.languages.index(lang), bucket] += n
    log_prob = np.log(cells / cells.sum(axis=1, keepdims=True))
    assert np.allclose(model.log_prob, log_prob, atol=1e-5)
    texts = [t for _, t, _ in sentences(20, 9)] + ["haus river", "x", "the der le " * 400, "Ünïcode façade 12"]
    got = train.sparkSession.createDataFrame(list(enumerate(texts)), "i INT, text STRING").select(
        "i", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    for r in got:
        total = model.log_prior + sum(n * log_prob[:, b] for b, n in counts_by_hand(texts[r.i], 10).items())
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert r.p.lang_pred == model.languages[int(total.argmax())]
        assert abs(r.p.score - share.max()) < 1e-3


def test_language_of_awkward_rows(spark, awkward, nothing):
    found = language_id.identify(awkward, awkward).collect()
    assert len(found) == awkward.count()
    texts = {(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()}
    undetermined = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {i for i, t in texts if not any(c.isalpha() for c in t or "")} <= undetermined
    assert all(0 <= r.score <= 1 for r in found)
    assert language_id.identify(nothing, awkward).collect() == []
    assert {r.lang_pred for r in language_id.identify(awkward, nothing).collect()} == {"und"}


def test_long_text_is_read_to_its_end(spark, monkeypatch):
    train = spark.createDataFrame(sentences(60), "doc_id BIGINT, text STRING, lang STRING")
    model = language_id.fit(train)
    text = "le la maison " * 100 + "the river and the house of stone " * 4000
    monkeypatch.setattr(language_id, "_CODES", 1000)
    row = spark.createDataFrame([(text,)], "text STRING").select(language_id.predict(spark, model, F.col("text")).alias("p")).first()
    assert row.p.lang_pred == "en"


def test_counting_holds_little_beside_the_arrow_batch():
    texts = ["", None, "x"] + [f"{i} der Fluss und das Haus " * 40 for i in range(3000)] + ["le fleuve " * 20_000]
    letters, batch, seen = language_id.letter_table(), pa.array(texts), []
    tracemalloc.start()
    try:
        for numbers, rows in language_id.blocks(batch, letters):
            seen += zip(numbers, language_id.bucket_counts(rows, language_id.BITS).reshape(len(rows), -1).sum(axis=1).tolist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    codes = [len(language_id.letter_codes(t or "", letters)) for t in texts]
    # As many runs of 1, 2 and 3 characters as the text has.
    assert seen == [(i, sum(max(n - k, 0) for k in range(language_id.ORDERS))) for i, n in enumerate(codes)]
    assert most < 40e6


def test_held_out_accuracy(spark, sf_dir):
    found = queries.identify_language(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    for r in rows:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


# -- personal data -------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_by_hand(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans(spark, awkward):
    rng = random.Random(2)
    pieces = ["a@b.c", "a@b", "@", ".", "-", "..", "1.2.3.4", "300.1.1.1", "0012.3.4.5", "4111111111111111", "4111 1111-1111 1111", " ", "+", "+1 (2) 345 67890",
              "7", "12", "é", "😀", "_", "x", "%", "(", ")", "  ", "\n", "4012888888881881", "5", "+44", "d-e.f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [r.text for r in awkward.select("text").collect()] + ["9" * 5000, "a" * 5000 + "@", "1 " * 3000, "a@b.c " * 300, "1." * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    got = {r.i: r.base for r in df.select("i", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base")).collect()}
    for i, text in enumerate(texts):
        assert [(x.kind, x.s, x.e) for x in got[i]] == base_by_hand(text), repr(text)


def test_found_spans_hold_the_base(awkward, nothing):
    found = pii.redact(pii.find(awkward)).collect()
    assert len(found) == awkward.count()
    for r in found:
        base = [(x.kind, x.s, x.e) for x in r.base]
        assert base == base_by_hand(r.text) and set(base) <= {(x.kind, x.s, x.e) for x in r.spans}
        if len(r.spans) == len(base):
            want, at = "", 0
            for s, e, kind in sorted((s, e, k) for k, s, e in base):
                want += r.text[at:max(s, at)] + (f"[{kind}]" if s >= at else "")
                at = max(at, e)
            assert r.redacted == want + r.text[at:]
    assert pii.find(nothing).collect() == []


def test_trees_find_what_the_rules_miss_and_leave_other_numbers(spark):
    """The score ranks look-alikes of personal data above plain numbers; thresholds come from held-out rows."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(1200):
        rows.append(f"tel +1 ({digits(3)}) 555-{digits(4)} and" if i % 2 else f"item {digits(3)} {digits(3)} {digits(4)} of")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id INT, text STRING")
    model = pii.fit(df)
    assert set(model.thresholds) <= set(pii.KINDS) and "phone" in model.thresholds
    found = pii.find(df).collect()
    assert all(len(r.spans) == r.doc_id % 2 for r in found)


def test_thresholds_do_not_depend_on_the_size_of_the_sample(spark):
    """Neither a small table nor a small sample of a large one leaves a kind without a threshold."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [f"tel +1 ({digits(3)}) 555-{digits(4)} and" if i % 2 else f"item {digits(3)} {digits(3)} {digits(4)} of" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id INT, text STRING")
    for docs, examples in ((df, 60), (df.filter("doc_id < 60"), pii.EXAMPLES)):
        assert "phone" in pii.fit(docs, examples).thresholds


def test_rare_kinds_take_the_pooled_threshold():
    common = [("phone", 2.0, 1000, 1000.0), ("phone", 1.0, 1000, 500.0), ("card", 2.5, 400, 100.0)]
    got = pii.thresholds_of([*common[:2], ("email", 2.0, 20, 20.0)])
    assert got == {kind: 1.9995 for kind in pii.KINDS}
    assert "card" not in pii.thresholds_of(common)


def test_model_trees_equal_the_library(spark):
    """Trees as column expressions decide as the fitted model does."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), float(rng.random() < 0.5)) for _ in range(300)]
    rows = [(a, b, float(a > 0.5) if c else float(b > 0.3)) for a, b, c in rows]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, label DOUBLE"))
    fitted = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    model = pii.Model([t._call_java("rootNode") for t in fitted.trees], fitted.treeWeights, ["a", "b"], {})
    out = fitted.transform(df).withColumn("own", model.score(F.struct("a", "b"))).select("own", "rawPrediction").collect()
    assert all(abs(r.own - r.rawPrediction[1]) < 1e-9 for r in out)


# -- order MinHash ---------------------------------------------------------------------

def edited_by_hand(rows):
    order = sorted(rows, reverse=True)
    out = {}
    for k, (doc_id, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        out[doc_id] = text[:len(text) - n] + after[:n]
    return out


def signature_by_hand(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    return order_minhash.with_fingerprint(df, "t", "fp").first().fp


def test_edited_texts_and_likeness(spark, plain, plain_rows):
    got = {r.doc_id: r for r in order_minhash.fingerprints_with_neighbours(plain).collect()}
    edited = edited_by_hand(plain_rows)
    assert len(got) == len(plain_rows)
    both = spark.createDataFrame([(i, t, edited[i]) for i, t in plain_rows], "i BIGINT, t STRING, e STRING")
    prints = {r.i: (r.fp, r.efp) for r in order_minhash.with_fingerprint(
        order_minhash.with_fingerprint(both, "t", "fp"), "e", "efp").collect()}
    ids = sorted(got, reverse=True)
    for k, doc_id in enumerate(ids):
        r = got[doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited[doc_id].encode()).hexdigest()
        assert r.n_chars == len(dict(plain_rows)[doc_id])
        assert (r.fp, r.edited_fp) == prints[doc_id]
        agree = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
        assert r.near_edited == agree(r.fp, r.edited_fp)
        assert r.near_next == agree(r.fp, got[ids[(k + 1) % len(ids)]].fp)


def numbered_by_hand(units, k=order_minhash.K):
    """(k-mer, occurrence) in text order."""
    seen, out = {}, []
    for i in range(len(units) - k + 1):
        kmer = tuple(units[i:i + k])
        seen[kmer] = seen.get(kmer, 0) + 1
        out.append((kmer, seen[kmer]))
    return out


def test_occurrence_numbers_count(spark):
    once, twice = "a b c d e f g h", "a b c d e f g h a b c d e f g h"
    assert len(set(numbered_by_hand(twice.split()))) > len(set(numbered_by_hand(once.split())))
    assert signature_by_hand(spark, once) != signature_by_hand(spark, twice)
    assert signature_by_hand(spark, "w " * 50) != signature_by_hand(spark, "w " * 60)
    assert signature_by_hand(spark, "w " * 50) == signature_by_hand(spark, "w " * 50)


def test_order_matters_more_than_for_sets(spark):
    rng = random.Random(1)
    blocks = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(40)) for _ in range(6)]
    text, turned = " ".join(blocks), " ".join(reversed(blocks))
    a, b = signature_by_hand(spark, text), signature_by_hand(spark, turned)
    agree = sum(x == y for x, y in zip(a, b)) / len(a)
    assert 0.05 < agree < 0.85  # nearly all k-mers are shared, half of the pairs change order


def test_one_inserted_character_changes_little_of_a_text_without_spaces(spark):
    rng = random.Random(3)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1500)) + "".join(rng.choice("abcXYZ019😀") for _ in range(1500))
    # The same with enough short words behind it that words are short on the average.
    mixed = text + " " + " ".join(f"w{rng.randint(0, 999)}" for _ in range(200))
    pairs = [(text, text[:5] + "x" + text[5:]), (mixed, mixed[:5] + "x" + mixed[5:]), (text, mixed)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i INT, a STRING, b STRING")
    prints = order_minhash.with_fingerprint(order_minhash.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = {r.i: r.x for r in prints.select("i", order_minhash.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()}
    assert got[0] > 0.9 and got[1] > 0.9 and got[2] > 0.7


def test_minhash_of_awkward_rows(awkward, nothing):
    rows = order_minhash.fingerprints_with_neighbours(awkward).collect()
    assert len(rows) == awkward.count()
    assert order_minhash.fingerprints_with_neighbours(nothing).collect() == []


def test_minhash_plan_has_no_python(plain):
    plan = order_minhash.fingerprints_with_neighbours(plain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- tokens --------------------------------------------------------------------------------

@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(spark, awkward, sf_dir, name, drops_space):
    path = public_tokenizers.path(name)
    texts = [r.text or "" for r in awkward.select("text").collect()]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(11)
    pieces = ["don't", "I'LL", " ", "  ", "\n", "\n\n", "\t", "é", "É", "ß", "é", "你好", "x1y2", "3.14", "...", "--", "(a)", "<|", "|>", "İ", "ﬁ", "\x1c", " ", "'s", "The", "the", "***", "\x00", "£5"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    encoder = encoding.Encoder(path, drops_space)
    ids, counts = encoder.encode(texts)
    plain = Tokenizer.from_file(path)
    own = np.split(ids, np.cumsum(counts)[:-1])
    for text, got in zip(texts, own):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_does_not_keep_whole_texts(name, drops_space):
    path = public_tokenizers.path(name)
    encoder, plain = encoding.Encoder(path, drops_space), Tokenizer.from_file(path)
    texts = [f"<|{i} paragraph  one\n\nand two " * 20 for i in range(50)]
    for text in texts:
        ids, counts = encoder.encode([text, "plain words", text])
        own = [plain.encode(t, add_special_tokens=False).ids for t in (text, "plain words", text)]
        assert ids.tolist() == sum(own, []) and counts.tolist() == list(map(len, own))
    assert len(encoder.flat) < 20


def test_encoder_forgets_by_ids_as_well(monkeypatch):
    monkeypatch.setattr(encoding, "MAX_IDS", 1000)
    encoder = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    for i in range(30):
        encoder.encode([f"{i}-" * 100])
    assert len(encoder.flat) < 2000


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_with_little_memory_gives_the_same_ids(monkeypatch, name, drops_space):
    monkeypatch.setattr(encoding, "MAX_REMEMBERED", 100)
    path, rng = public_tokenizers.path(name), random.Random(3)
    encoder, plain = encoding.Encoder(path, drops_space, pieces=20), Tokenizer.from_file(path)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 4))) + rng.choice(",. ").strip() for _ in range(30)) for _ in range(4)]
        ids, counts = encoder.encode(texts)
        own = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(own, []) and counts.tolist() == list(map(len, own))
        assert len(encoder.pieces) <= 20 and len(encoder.index) <= 100 + 4 * 30


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_remembers_pieces_of_words_once(name, drops_space):
    path, rng = public_tokenizers.path(name), random.Random(4)
    encoder, plain = encoding.Encoder(path, drops_space), Tokenizer.from_file(path)
    stems = ["".join(rng.choices("abcdefghé", k=9)) for _ in range(100)]
    marks = ["", ".", ",", ";", "!", "?", "...", '."', "),"]
    texts = [rng.choice([" ", "\n"]).join(["of", *(stem + mark for stem in rng.sample(stems, 100))]) for mark in marks for _ in range(3)]
    ids, counts = encoder.encode(pa.array(["", *texts, "two  spaces", "don't\n(this)"]))
    own = [plain.encode(t, add_special_tokens=False).ids for t in ["", *texts, "two  spaces", "don't\n(this)"]]
    assert ids.tolist() == sum(own, []) and counts.tolist() == list(map(len, own))
    # A stem after a space and after a line break, the first word, the marks, and words of the two texts at the end.
    assert len(encoder.index) <= 2 * len(stems) + len(marks) + 5


def test_pieces_do_not_depend_on_what_workers_remember(plain, awkward, monkeypatch):
    whole = [sorted(map(repr, packing.token_pieces(docs, keep_ids=True).collect())) for docs in (plain, awkward)]
    monkeypatch.setattr(packing, "PIECES", 5)
    monkeypatch.setattr(packing, "_ROWS", 3)
    assert whole == [sorted(map(repr, packing.token_pieces(docs, keep_ids=True).collect())) for docs in (plain, awkward)]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 1000):
        ids = rng.zipf(1.3, n).clip(max=2**31).astype(np.uint32)
        if n == 1000:
            ids[:600] = np.arange(600)
        columns = token_files.encode_block(ids)
        assert token_files.decode_block(*columns, n, token_files.length_table()).tolist() == ids.tolist()


def test_token_files(plain, plain_rows, awkward, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_files.round_trip(plain, keep_ids=True).collect()}
    start = 0
    for doc_id, text in plain_rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_files.round_trip(awkward).count() == awkward.count()
    assert token_files.round_trip(nothing).collect() == []


# -- packing ------------------------------------------------------------------------------------

def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 13), 5, replace=False))
        values = rng.random(5)
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [v + best[c - x] for x, v in zip(sizes, values) if x <= c])
        counts = packing.knapsack(sizes, values, 12)
        assert (counts * sizes).sum() <= 12 and abs((counts * values).sum() - best[12]) < 1e-12


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_the_histogram_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = rng.integers(1, capacity + 1, 4000) if seed % 2 else rng.geometric(0.02, 4000).clip(max=capacity)
    histogram = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.packing_plan(histogram, rounds=200)
    assert (sum(c * t for c, t in plan) == histogram).all()
    assert all((c * np.arange(capacity + 1)).sum() <= capacity and t > 0 for c, t in plan)
    used = sum(t for _, t in plan)
    # Long pieces may leave room that nothing fits, so first fit by size is the yardstick.
    rooms = []
    for x in sorted(lengths, reverse=True):
        for k, room in enumerate(rooms):
            if room >= x:
                rooms[k] -= x
                break
        else:
            rooms.append(capacity - x)
    assert used <= len(rooms) * 1.015 + 1


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(plain, plain_rows, awkward, nothing, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(plain, capacity=capacity, rounds=50, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in plain_rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[s:s + capacity], dtype="<u4").tobytes()) for s in range(0, len(ids), capacity)]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_sequence) <= 1.2 * sum(r.length for r in rows) / capacity + 2
    everything = packing.pack(awkward, capacity=capacity, rounds=50).collect()
    places = [(r.sequence_id, r.offset) for r in everything]
    assert len(places) == len(set(places)) and {r.doc_id for r in everything} == {r.doc_id for r in awkward.select("doc_id").collect()}
    assert packing.pack(nothing, capacity=capacity).collect() == []


# -- mixing -----------------------------------------------------------------------------------------

def shares_by_hand(caps, weights, budget):
    """Whole-number water filling: raise all children at their weight, full ones stay."""
    budget = min(budget, sum(caps.values()))
    left, open_, out = budget, dict(caps), {}
    while open_:
        total = sum(weights.get(c, 1) for c in open_)
        full = [c for c in open_ if open_[c] * total <= left * weights.get(c, 1)]
        if not full:
            for c in open_:
                out[c] = weights.get(c, 1) * left // total
            break
        c = min(full, key=lambda c: (open_[c] / weights.get(c, 1), c))
        out[c] = open_.pop(c)
        left -= out[c]
    return out


def test_budgets_go_down_the_tree(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 10), ("a", "de", "s1", 5), ("b", "en", "s3", 1000), ("b", "fr", "s3", 400), ("c", "en", "s4", 1), ("c", "en", "s5", 0)]
    weights = {("a",): 3, ("b", "fr"): 4, ("a", "en", "s2"): 5}
    df = spark.createDataFrame(leaves, f"{mixing.LEVELS[0]} STRING, {mixing.LEVELS[1]} STRING, {mixing.LEVELS[2]} STRING, tokens BIGINT")
    for share, epochs in ((0.2, 1), (0.5, 2), (1.0, 1), (0.9, 3), (5.0, 2)):
        got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, share, epochs, weights).collect()}
        caps = {leaf[:3]: leaf[3] * epochs for leaf in leaves}
        total = int(sum(leaf[3] for leaf in leaves) * share)
        level = {(): total}
        for depth in (1, 2, 3):
            below = {}
            for parent, budget in level.items():
                children = {}
                for path, cap in caps.items():
                    if path[:depth - 1] == parent:
                        children[path[:depth]] = children.get(path[:depth], 0) + cap
                below.update(shares_by_hand(children, weights, budget))
            level = below
        assert got == level, (share, epochs)


def test_mixing_rows(spark, awkward, nothing):
    mixed = mixing.mix(awkward, F.col("source"), share=0.6, max_epochs=2, weights={("src1",): 3})
    rows = mixed.collect()
    assert len(rows) == awkward.count() and set(awkward.columns) <= set(mixed.columns)
    by_leaf = {}
    for r in rows:
        assert r["__mix_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        by_leaf.setdefault((r["__mix_domain"], r["__mix_lang"], r["__mix_source"]), []).append(r)
    for own in by_leaf.values():
        tokens, budget = sum(r["__mix_tokens"] for r in own), own[0]["__mix_budget"]
        if not tokens:
            continue
        key = lambda r: hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:0:{budget // tokens}".encode()).hexdigest()
        at = {}
        for r in own:
            at.setdefault((key(r), r.doc_id is None, r.doc_id, r.text), []).append(r)
        total = 0
        for k in sorted(at, key=lambda k: k[0]):
            same = at[k]
            if len([x for x in at if x[0] == k[0]]) > 1:
                break  # ties of one id are ordered by a hash of the text
            total += sum(r["__mix_tokens"] for r in same)
            start = total - same[0]["__mix_tokens"]
            assert {r["__mix_times"] for r in same} == {budget // tokens + (start < budget % tokens)}
    assert mixing.mix(nothing, F.col("source")).collect() == []


# -- pipeline ---------------------------------------------------------------------------------------

def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        result = function(spark, docs, sf_dir)
        result.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids, name
        if name in ("line_dedup", "simhash_near_dedup", "mixing"):
            assert len(left) < len(ids), name
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        ids = left
    full = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, full.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_pipeline_stages_take_awkward_and_no_rows(spark, awkward, nothing, sf_dir):
    docs, empty = awkward, nothing
    for name, function in corpus_pipeline.STAGES:
        docs, empty = function(spark, docs, sf_dir), function(spark, empty, sf_dir)
        assert docs.count() > 0 and empty.count() == 0, name


def test_without_labels_texts_with_letters_pass_the_language_stage(spark):
    rows = [(0, "the river", None), (1, "été", None), (2, "12 34 ...", None), (3, "", None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [0, 1]
