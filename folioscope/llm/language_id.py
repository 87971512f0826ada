"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one boundary mark, and runs of one to
three characters are hashed to 2**bits buckets. The log-probability matrix (languages x buckets) is
broadcast; texts are scored in Arrow batches from sparse bucket counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 14
ORDERS = 3
# The matrix is fitted on about this many labelled documents of each language, chosen by hash.
DOCS_PER_LANGUAGE = 4_000
# Bounds the broadcast matrix: languages x 2**bits x 4 bytes.
MAX_LANGUAGES = 1_000
SMOOTHING = 0.5
UNDETERMINED = "und"
# Documents counted at a time, and code points at which they are fewer; a longer text is cut at _CODES.
_ROWS, _FEWER, _CODES = 64, 1 << 17, 1 << 20
# Documents turned into Python strings at a time, whatever the size of the Arrow batches.
_SLICE = 256
_GRAIN = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def letter_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, runs of non-letters as one 0, with a 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = letters[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]):
        known[codes == code] = chr(code).isalpha()
    codes = np.concatenate(([0], np.where(known, codes, 0), [0])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] > 0) | (codes[:-1] > 0)))]


def bucket_counts(rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Counts by (row, bucket), flat: row << bits | bucket."""
    codes = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), [len(r) for r in rows])
    total = np.zeros(len(rows) << bits, dtype=np.int64)
    state = np.full(len(codes), 2166136261, dtype=np.uint32)
    for order in range(ORDERS):
        if order:
            state = state[:-1]
        state = (state ^ codes[order:]) * np.uint32(16777619)
        state ^= state >> np.uint32(15)
        bucket = (state * np.uint32(2654435761)) >> np.uint32(32 - bits)
        first = owner[:len(bucket)]
        inside = first == owner[order:]
        total += np.bincount((first[inside] << bits) | bucket[inside], minlength=len(total))
    return total


def blocks(texts: pa.Array, letters: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(document numbers, their codes) in pieces of bounded size; a long text is cut with overlap."""
    numbers, rows, size = [], [], 0
    slices = (texts.slice(at, _SLICE).to_pylist() for at in range(0, len(texts), _SLICE))
    for number, text in enumerate(chain.from_iterable(slices)):
        codes = letter_codes(text or "", letters)
        for at in range(0, max(len(codes) - ORDERS + 1, 1), _CODES):
            # Runs of fewer than ORDERS characters inside an overlap count twice; that is harmless noise
            # of two positions in a million.
            part = codes[at:at + _CODES + ORDERS - 1]
            numbers.append(number)
            rows.append(part)
            size += len(part)
            if size >= _FEWER or len(rows) == _ROWS:
                yield numbers, rows
                numbers, rows, size = [], [], 0
    if rows:
        yield numbers, rows


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", bits: int = BITS,
        docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model of the rows of `docs` with text and language; rows without either are left out.

    Priors are the shares of the languages among all these rows; bucket counts come from about
    `docs_per_language` whole texts of each.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r.lang, r.n) for r in sizes.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Model([], np.zeros(0), np.zeros((0, 1 << bits), dtype=np.float32), bits)
    languages = [lang for lang, _ in found]
    number = {lang: i for i, lang in enumerate(languages)}
    # One row per language.
    shares = docs.sparkSession.createDataFrame(
        [(lang, number[lang], min(_GRAIN, docs_per_language * _GRAIN // n + 1)) for lang, n in found],
        "lang string, number int, share bigint")
    sample = labelled.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64("id", "text"), F.lit(_GRAIN)) < F.col("share")).select("number", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_table(), {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for numbers, rows in blocks(batch.column(1), letters):
                cells = bucket_counts(rows, bits).reshape(len(rows), -1)
                for row, doc in enumerate(numbers):
                    label = labels[doc]
                    total[label] = total.get(label, 0) + cells[row]
        for label, cells in total.items():
            used = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), label, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(cells[used])],
                names=["number", "bucket", "n"])

    counted = sample.mapInArrow(count, "number int, bucket int, n bigint").groupBy("number", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most languages x buckets rows
    cells = np.full((len(languages), 1 << bits), SMOOTHING)
    cells[table["number"].to_numpy(), table["bucket"].to_numpy()] += table["n"].to_numpy()
    prior = np.array([n for _, n in found], dtype=float)
    return Model(
        languages, np.log(prior / prior.sum()), np.log(cells / cells.sum(axis=1, keepdims=True)).astype(np.float32), bits)


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """STRUCT<lang_pred, score> of a whole text; score is the probability of the predicted language.

    A NULL text, one without a letter, and any text under a model without languages is
    'und' with score 0. Equal probabilities go to the language first in sorted order.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, letters = shared.value, letter_table()
        languages, bits = own.languages, own.bits
        for texts in batches:
            sums = np.tile(own.log_prior, (len(texts), 1))
            known = np.zeros(len(texts), dtype=bool)
            for numbers, rows in blocks(texts, letters):
                counts = bucket_counts(rows, bits)
                used = np.flatnonzero(counts)
                row, bucket, n = used >> bits, used & ((1 << bits) - 1), counts[used]
                for k in range(len(languages)):
                    weight = np.bincount(row, weights=n * own.log_prob[k][bucket], minlength=len(rows))
                    np.add.at(sums, (numbers, k), weight)
                for number, codes in zip(numbers, rows):
                    known[number] |= bool(codes.any())
            if languages:
                best = sums.argmax(axis=1)
                share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                names = [languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                score = np.where(known, share, 0.0)
            else:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return run(text)


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; False for a NULL id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` (id and text only) with lang_pred and score by a model fitted on `train`."""
    model = fit(train, text_col=text_col, id_col=id_col, **options)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = narrow.select("doc_id", predict(docs.sparkSession, model, F.col("text")).alias("p"))
    return scored.select("doc_id", "p.lang_pred", "p.score")
