"""Mixing sources to target weights by hierarchical budgets.

A token budget is handed down a tree of domain, language and source. Among the children of a node
it is split by weight; a child that cannot use its share (its tokens times the most epochs) is
filled up and what it lacks goes to its siblings, and only what all siblings together cannot use
goes to the siblings of their parent. All arithmetic is on whole numbers. Each leaf reads its
documents in seeded epochs: whole epochs as often as the budget allows, then the prefix of the next
one that starts within the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import ASCII_SPACE
from folioscope.runtime import broadcast_if_small, stage

LEVELS = ["__mix_domain", "__mix_lang", "__mix_source"]
# Hex digits of the order key that cut a leaf into ranges, so that no window holds a whole leaf.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space, 0 for NULL."""
    words = F.size(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE, -1))
    # A run of white space at either end leaves an empty piece there.
    head = F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]").cast("int")
    tail = F.coalesce(text, F.lit("")).rlike(r"[\x20\x09-\x0D]\z").cast("int")
    some = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return F.when(some, words - head - tail).otherwise(F.lit(0)).cast("bigint")


def _weight(level: int, weights: dict[tuple, int]) -> Column:
    """Whole-number weight of a node by its path; 1 where none is given."""
    path = F.concat_ws("\x1f", *LEVELS[:level + 1])
    own = {p: w for p, w in weights.items() if len(p) == level + 1}
    if not own:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[F.lit(x) for p, w in sorted(own.items()) for x in ("\x1f".join(p), w)])
    return F.coalesce(F.element_at(table, path), F.lit(1)).cast("bigint")


def _share_out(nodes: DataFrame, level: int, weights: dict[tuple, int]) -> DataFrame:
    """Add `budget` to nodes with `cap` and the budget of their parent, `above`."""
    parent = LEVELS[:level]
    nodes = nodes.withColumn("weight", _weight(level, weights))
    among = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.col("cap") / F.col("weight"), LEVELS[level]]
    ranked = among.orderBy(*order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onwards = ranked.rowsBetween(0, Window.unboundedFollowing)
    left = F.least("above", F.sum("cap").over(among)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = nodes.withColumns({"left": left, "open": F.sum("weight").over(onwards)})
    # Filled children come first in this order; the first that is not filled sets the rate for the rest.
    full = F.col("cap") * F.col("open") <= F.col("left") * F.col("weight")
    rate = F.max(F.when(~full, F.struct((F.col("left") / F.col("open")).alias("r"), "left", "open"))).over(among)
    return rows.withColumns({"full": full, "rate": rate}).withColumn(
        "budget", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(weight * rate.left) div rate.open"))
    ).drop("weight", "left", "open", "full", "rate")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[tuple, int]) -> DataFrame:
    """(levels..., tokens, budget) of leaves (levels..., tokens): one row per leaf, whatever the corpus."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("bigint")).first()[0] or 0
    budgets = None
    for level in range(len(LEVELS)):
        grouped = nodes.groupBy(*LEVELS[:level + 1]).agg(F.sum("cap").alias("cap"))
        if budgets is None:
            grouped = grouped.withColumn("above", F.lit(total).cast("bigint"))
        else:
            grouped = grouped.join(budgets, LEVELS[:level])
        budgets = _share_out(grouped, level, weights).select(*LEVELS[:level + 1], F.col("budget").alias("above"))
    return leaves.join(budgets, LEVELS).withColumnRenamed("above", "budget")


def mix(docs: DataFrame, domain: Column, share: float = 1.0, max_epochs: int = 1, weights: dict[tuple, int] | None = None,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        source_col: str = "source") -> DataFrame:
    """`docs` with __mix_domain, __mix_lang, __mix_source, __mix_tokens, __mix_budget and __mix_times.

    The budget is `share` of all tokens (words). `__mix_times` says how often a document is taken;
    it is 0 for documents behind the prefix. The document on the boundary is taken whole. NULL
    domains, languages and sources are the empty name. Rows are ordered by the MD5 of id, seed and
    epoch, ties by id and text hash; rows equal in all of these share their fate. An empty table
    gives an empty result.
    """
    rows = docs.withColumns({
        LEVELS[0]: F.coalesce(domain.cast("string"), F.lit("")),
        LEVELS[1]: F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        LEVELS[2]: F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "__mix_tokens": word_count(F.col(text_col)),
    })
    leaves = stage(rows.groupBy(*LEVELS).agg(F.sum("__mix_tokens").alias("tokens")), "leaves")
    budgets = stage(leaf_budgets(leaves, share, max_epochs, weights or {}), "leaf-budgets").select(
        *LEVELS, F.col("budget").alias("__mix_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("bigint")).alias("__mix_epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).alias("__mix_rest"))
    # One row per leaf: sent to all tasks where it measures small, else joined by shuffle.
    budgets = broadcast_if_small(budgets)

    def ordered(narrow: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed)), F.col("__mix_epochs").cast("string")))
        keyed = narrow.withColumn("__mix_key", key)
        return keyed.withColumn("__mix_range", F.substring("__mix_key", 1, RANGE_DIGITS))

    placed = ordered(rows.join(budgets, LEVELS))
    narrow = ordered(rows.select(id_col, *LEVELS, "__mix_tokens").join(budgets.select(*LEVELS, "__mix_epochs"), LEVELS))
    sums = narrow.groupBy(*LEVELS, "__mix_range").agg(F.sum("__mix_tokens").alias("n"))
    earlier = Window.partitionBy(*LEVELS).orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*LEVELS, "__mix_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__mix_offset"))
    within = Window.partitionBy(*LEVELS, "__mix_range").orderBy("__mix_key", id_col, "__mix_h")
    placed = placed.withColumn("__mix_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    start = F.col("__mix_offset") + F.sum("__mix_tokens").over(within) - F.col("__mix_tokens")
    result = placed.join(offsets, [*LEVELS, "__mix_range"]).withColumn(
        "__mix_times", F.col("__mix_epochs") + (start < F.col("__mix_rest")).cast("bigint"))
    return result.drop("__mix_h", "__mix_key", "__mix_range", "__mix_offset", "__mix_epochs", "__mix_rest")
