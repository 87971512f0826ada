"""Personal data: rules, and boosted trees over high-recall candidates, in DataFrame functions only.

Four rules give the base spans. Wider patterns propose overlapping candidate spans; a candidate
that shares characters with a base span is an example of personal data, any other one is not. Gradient
boosted trees learn from format and context of at most about `EXAMPLES` candidates; all others calibrate,
per kind, the lowest score at which nearly all selected candidates are real. Candidates at or above
it that lie clear of the base spans are added. The trees are turned into column expressions, so scoring runs
inside each row without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import stage

KINDS = ["email", "ip", "card", "phone"]
# The fixed patterns, written so that a failed attempt is not repeated inside its own run:
# possessive repeats, and starts only where a run starts (or right after the last match).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole digit runs of 16 to 19; others fail the digit count anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
# Words that announce a number, looked for in the characters before a candidate.
ANNOUNCE = r"(?i)(phone|tel|call|fax|mobile|card|visa|credit|mail|contact|host|addr|\bip\b)"
BEFORE = 24
# Candidates of which one half, chosen by hash, is learned from, about; all others calibrate.
EXAMPLES = 20_000
TREES, DEPTH = 12, 3
# Share of real candidates among the selected that the calibration asks for, and the least number of examples;
# a kind with fewer takes the threshold of all kinds together.
PRECISION, LEAST = 0.995, 50

_SPAN = "struct<kind:string,s:int,e:int,text:string>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    d = _digits(text)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(_OCTETS)
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """ARRAY of (kind, s, e, text), code points, e exclusive, in order: leftmost, not overlapping.

    The parts between matches give their places. Time grows with the square of the matches of one
    text, which are few; that part moves references only.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["text"])
        span = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["text"].alias("text"))
        return F.struct(e.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("text")))
    return F.aggregate(pairs, start, add, lambda acc: acc["spans"])


def _gate(text: Column, kind: str, wide: bool) -> Column:
    """Cheap tests that most texts fail, before any pattern with structure is tried."""
    if kind == "email":
        return text.contains("@") | (text.contains("at)") | text.contains("at]") if wide else F.lit(False))
    if kind == "phone" and not wide:
        return text.contains("+")
    return text.rlike("[0-9]")


def _all_matches(text: Column, patterns: dict[str, str], wide: bool) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    return F.concat(*[
        F.when(_gate(text, kind, wide), _matches(text, kind, patterns[kind])).otherwise(none) for kind in KINDS])


def base_spans(text: Column) -> Column:
    """Base spans of a text, by kind in the order of KINDS, then by start."""
    none = F.array().cast(f"array<{_SPAN}>")

    def valid(kind: str) -> Column:
        found = F.when(_gate(text, kind, False), _matches(text, kind, BASE[kind])).otherwise(none)
        return F.filter(found, lambda x: _valid(kind, x["text"]))

    return F.concat(*map(valid, KINDS))


# -- candidates and their features ----------------------------------------------------------------


def features(span: Column, text: Column) -> dict[str, Column]:
    own, kind = span["text"], span["kind"]
    before = F.substring(text, F.greatest(span["s"] - BEFORE, F.lit(0)) + 1, F.least(span["s"], F.lit(BEFORE)))
    after = F.substring(text, span["e"] + 1, F.lit(1))
    parts = F.split(own, r"[^0-9A-Za-z]+", -1)
    flag = lambda c: c.cast("double")
    return {
        **{f"is_{k}": flag(kind == k) for k in KINDS},
        "length": F.length(own).cast("double"),
        "digits": F.length(_digits(own)).cast("double"),
        "letters": F.length(F.regexp_replace(own, "[^A-Za-z]", "")).cast("double"),
        "groups": F.size(parts).cast("double"),
        "luhn": flag(_luhn(own)),
        "octets": flag(own.rlike(_OCTETS)),
        "at_sign": flag(own.contains("@")),
        "plus": flag(own.contains("+") | before.rlike(r"\+[0-9 ]*\z")),
        "bracket": flag(own.contains("(")),
        "announced": flag(before.rlike(ANNOUNCE)),
        "after_letter": flag(before.rlike(r"[\p{L}]\z")),
        "after_digit": flag(before.rlike(r"[0-9][^0-9]?\z")),
        "before_letter": flag(after.rlike(r"\p{L}")),
        "before_digit": flag(after.rlike("[0-9]")),
    }


def _clear_of(span: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["s"] < span["e"]) & (span["s"] < b["e"]))


def proposed(texts: DataFrame) -> DataFrame:
    """Add `base` and `candidates` (the wide spans with features and whether they are clear of the base)."""
    with_base = texts.withColumn("base", base_spans(F.col("text")))
    with_wide = with_base.withColumn("wide", _all_matches(F.col("text"), CANDIDATES, True))
    described = F.transform("wide", lambda x: F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _clear_of(x, F.col("base")).alias("clear"),
        F.struct(*[c.alias(name) for name, c in features(x, F.col("text")).items()]).alias("f")))
    return with_wide.withColumn("candidates", described).drop("wide")


# -- the model ----------------------------------------------------------------------------------------


def _tree(node, names: list[str], f: Column) -> Column:
    """A regression tree of the trained model as a nested conditional."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    column = f[names[split.featureIndex()]]
    return F.when(column <= F.lit(float(split.threshold())), _tree(node.leftChild(), names, f)).otherwise(
        _tree(node.rightChild(), names, f))


class Model:
    """Boosted trees and one threshold per kind; kinds without a threshold select nothing."""

    def __init__(self, trees, weights, names, thresholds):
        self.trees, self.weights, self.names, self.thresholds = trees, weights, names, thresholds

    def score(self, f: Column) -> Column:
        parts = [_tree(tree, self.names, f) * F.lit(float(w)) for tree, w in zip(self.trees, self.weights)]
        return reduce(lambda a, b: a + b, parts)

    def selects(self, candidate: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        least = F.coalesce(*[F.when(candidate["kind"] == kind, F.lit(t)) for kind, t in self.thresholds.items()])
        return F.coalesce(self.score(candidate["f"]) >= least, F.lit(False))


def fit(docs: DataFrame, examples: int = EXAMPLES, seed: int = 1) -> Model:
    """Model from the candidates of texts `docs` (doc_id, text).

    With candidates of one sort only there is nothing to learn: the model selects nothing.
    """
    share = 1 << 20
    # Kept for the plan: a column used once would be worked out anew inside the loop over candidates.
    n_base = F.size("base").alias("n_base")
    rows = stage(proposed(docs).select("doc_id", n_base, F.explode("candidates").alias("c")).select(
        "doc_id", "n_base", "c.kind", "c.s", F.when(F.col("c.clear"), 0.0).otherwise(1.0).alias("label"), "c.f.*"), "candidates")
    n = rows.count()
    names = rows.columns[5:]
    draw = F.pmod(F.xxhash64("doc_id", "s", F.lit(seed)), F.lit(share))
    kept = rows.withColumn("draw", draw)
    learned = (F.col("draw") < min(share, examples * share // max(n, 1) + 1)) & (F.col("draw") % 2 == 0)
    train = VectorAssembler(inputCols=names, outputCol="features").transform(kept.filter(learned))
    sorts = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if min(sorts) == 0:
        return Model([], [], names, {})
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, stepSize=0.3)
    fitted = booster.fit(train.select("features", "label"))
    model = Model([t._call_java("rootNode") for t in fitted.trees], fitted.treeWeights, names, {})
    scored = kept.filter(~learned).withColumn("score", model.score(F.struct(*names)))
    # Few distinct scores: trees have at most 2 ** DEPTH leaves each and features are mostly flags.
    steps = scored.groupBy("kind", F.round("score", 3).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("real")).collect()
    return Model(model.trees, model.weights, names, thresholds_of([(s.kind, s.score, s.n, s.real) for s in steps]))


def thresholds_of(steps: list[tuple[str, float, int, float]]) -> dict[str, float]:
    """Lowest score per kind at which the selected are real, from a histogram (kind, score, n, real).

    Kinds of fewer than LEAST examples take the threshold of all kinds pooled, whatever their number.
    """
    def lowest(own: list, least: int) -> float | None:
        found, n_all, n_real = None, 0, 0
        by_score = {}
        for _, score, n, real in own:
            before = by_score.get(score, (0, 0))
            by_score[score] = (before[0] + n, before[1] + real)
        for score in sorted(by_score, reverse=True):
            n_all, n_real = n_all + by_score[score][0], n_real + by_score[score][1]
            if n_all >= least and n_real >= PRECISION * n_all:
                found = score - 0.0005
        return found

    pooled = lowest(steps, 1)
    own = {kind: [s for s in steps if s[0] == kind] for kind in KINDS}
    found = {kind: lowest(x, LEAST) if sum(s[2] for s in x) >= LEAST else pooled for kind, x in own.items()}
    return {kind: t for kind, t in found.items() if t is not None}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, text, base, spans): base spans, and all spans with the model's additions, per row of `docs`.

    Both are ARRAYs of (kind, s, e) by kind, start and end, in code points, e exclusive. NULL text is
    empty; repeated rows and NULL ids are rows like any other; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = fit(texts, examples)
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    rank = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    if not model.thresholds:
        return texts.withColumn("base", F.transform(base_spans(F.col("text")), plain)).withColumn("spans", F.col("base"))
    found = proposed(texts)
    added = F.filter("candidates", lambda c: c["clear"] & model.selects(c))
    merged = F.array_sort(F.array_distinct(F.concat(F.transform("base", rank), F.transform(added, rank))))
    return found.select("doc_id", "text", F.transform("base", plain).alias("base"), F.transform(merged, plain).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """`find` rows with `redacted`: every span replaced by its kind in brackets, overlaps by the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        mark = F.when(x["s"] >= acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    whole = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.withColumn("redacted", F.aggregate(by_start, start, step, whole))
