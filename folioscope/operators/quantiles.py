"""Quantiles without sorting: exact ones by refining histograms, approximate ones by mergeable sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import BROADCAST_BYTES, measured_bytes, stage

# Ranges a histogram divides an interval into.
BINS = 4096
# Values per level of a sketch (the logarithm's base is 2); the rank error of 4096 is about 0.1 %.
SKETCH_SIZE = 4096


def quantile_bounds(df: DataFrame, col: str, *groups: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(groups..., q_low, q_high): two linearly interpolated quantiles per group; NULL for a group without values.

    NaN counts as the largest value. Each round counts the values of the ranges that hold a wanted rank by
    finer ranges, with their smallest and largest value, and goes on with those that still hold several
    values. Rows are only read and counted: nothing is sorted, and what is staged are counts per group.
    """
    keys = [f"`{g}`" for g in groups]
    values = df.select(*groups, F.col(col).cast("double").alias("__x"))
    sizes = values.groupBy(*groups).agg(*map(F.expr, [
        "count(__x) AS n", f"count_if(__x = -{_INFINITE}) AS lowest", f"count_if({_FINITE}) AS inner",
        f"count_if(__x = {_INFINITE}) AS highest", f"min(CASE WHEN {_FINITE} THEN __x END) AS lo", f"max(CASE WHEN {_FINITE} THEN __x END) AS hi"]))
    ends = ", ".join(
        f"struct({i} AS q, {k} AS end, CAST({f}((n - 1) * {float(q)!r}D) AS BIGINT) AS rank, (n - 1) * {float(q)!r}D - floor((n - 1) * {float(q)!r}D) AS part)"
        for i, q in enumerate((low, high)) for k, f in enumerate(("floor", "ceil")))
    placed = sizes.selectExpr("*", f"inline(array({ends}))").selectExpr(
        *keys, "q", "end", "part", "rank - lowest AS rank", "lo", "hi",
        f"""CASE WHEN n = 0 THEN NULL WHEN rank < lowest THEN -{_INFINITE}
            WHEN rank < lowest + inner THEN CASE WHEN lo = hi THEN lo END
            WHEN rank < lowest + inner + highest THEN {_INFINITE} ELSE double('NaN') END AS value""",
        "n > 0 AND rank >= lowest AND rank < lowest + inner AND lo < hi AS open")
    wanted = stage(placed, "quantile-ranks")
    size = measured_bytes(wanted)
    small = size is not None and size <= BROADCAST_BYTES  # later rounds only have fewer ranks
    done, rest = wanted.filter("NOT open"), wanted.filter("open")
    while not rest.isEmpty():
        rest = stage(_refine(values.filter(_FINITE), rest, keys, small), "quantile-ranks")
        done, rest = done.unionByName(rest.filter("NOT open")), rest.filter("open")
    picked = [f"max(CASE WHEN q = {i} AND end = {k} THEN value END) AS v{i}{k}" for i in (0, 1) for k in (0, 1)]
    parts = [f"max(CASE WHEN q = {i} THEN part END) AS p{i}" for i in (0, 1)]
    found = done.groupBy(*groups).agg(*map(F.expr, picked + parts))
    return found.selectExpr(*keys, *[
        f"CASE WHEN p{i} = 0 THEN v{i}0 ELSE v{i}0 + (v{i}1 - v{i}0) * p{i} END AS {name}" for i, name in enumerate(("q_low", "q_high"))])


# A number, neither NaN nor infinite.
_INFINITE = "double('Infinity')"
_FINITE = f"(NOT isnan(__x) AND abs(__x) < {_INFINITE})"


def _refine(values: DataFrame, rest: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """The ranks of `rest` in the range of their interval that holds them; `rank` counts from the start of the range."""
    # At most four intervals per group.
    spans = rest.selectExpr(*[f"{k} AS __g{i}" for i, k in enumerate(keys)], "lo", "hi").distinct()
    same = "".join(f"{k} <=> __g{i} AND " for i, k in enumerate(keys))
    met = values.join(F.broadcast(spans) if small else spans, F.expr(same + "__x BETWEEN lo AND hi"))
    # Halves first: the width of an interval may exceed the largest number.
    number = f"CAST(least(floor((__x / 2 - lo / 2) / (hi / 2 - lo / 2) * {BINS}), {BINS - 1}) AS INT) AS bin"
    owned = [f"__g{i}" for i in range(len(keys))]
    bins = met.selectExpr(*owned, "lo", "hi", "__x", number).groupBy(*owned, "lo", "hi", "bin").agg(
        *map(F.expr, ["count(1) AS held", "min(__x) AS least", "max(__x) AS most"]))
    over = f"PARTITION BY {', '.join([*owned, 'lo', 'hi'])} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    bins = bins.selectExpr("*", f"coalesce(sum(held) OVER ({over}), 0) AS before").withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    on = same + "lo = __lo AND hi = __hi AND rank >= before AND rank < before + held"
    return rest.join(bins, F.expr(on)).selectExpr(
        *keys, "q", "end", "part", "rank - before AS rank", "least AS lo", "most AS hi", "CASE WHEN least = most THEN least END AS value",
        "least < most AS open")


def quantile_sketches(df: DataFrame, col: str, *groups: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(groups..., sketch): states of one pass that can be saved and merged with those of other tables; NULL and NaN left out."""
    values = df.select(*groups, F.col(col).cast("double").alias("__x")).filter(~F.isnan("__x"))
    return values.groupBy(*groups).agg(F.kll_sketch_agg_double("__x", size).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, *groups: str, size: int = SKETCH_SIZE) -> DataFrame:
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, *groups: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(groups..., n, q_low, q_high): values whose rank is about the wanted one."""
    return sketches.select(
        *groups, F.kll_sketch_get_n_double("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for q, name in ((low, "q_low"), (high, "q_high"))])
