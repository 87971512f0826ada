"""Near-duplicate vectors by an exact range join in metric space.

Vectors of one label and width are scaled to length 1, where a cosine is a distance. Large cells are
split by pivots: every vector belongs to its nearest pivot and is copied to the cells of later pivots
that the triangle inequality cannot rule out. After that every cell is joined on its own, and every
pair meets exactly once. Two more uses of the inequality spare comparisons inside a cell: vectors
whose distances to the pivot differ by more than the radius cannot be linked, and vectors within half
the radius of it (the core, e.g. a large group of near copies) are all linked without being compared.

A cell whose pivots would not save work (a sample of it is asked first) stays whole and is compared
in blocks, however large it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.components import star_components
from folioscope.runtime import broadcast_if_small, stage

# Vectors above which a cell is split; vectors of one side of a block comparison, and of one dealing task.
CELL, BLOCK, DEAL = 512, 8192, 8192
# Pivots a cell is split by at most, vectors they are chosen from, copies of a vector a split may lead to.
PIVOTS, CANDIDATES, COPIES = 16, 256, 4.0
# A split must leave at most this share of the comparisons.
WORTH = 0.9
# Rounding: distances this near to a bound count as within, cosines this near to the threshold are taken again.
SLACK = 1e-7
_ROWS = 256


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine by exact sums: the same whichever side comes first."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def memberships(to_pivots: np.ndarray, between: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, copied): the nearest pivot of every vector, and the later cells it is copied to.

    A vector within the radius of a member of cell j is at most twice the radius farther from pivot j
    than from its own, and lies at most the radius beyond the plane halfway between the two pivots.
    """
    rows = np.arange(len(to_pivots))
    home = to_pivots.argmin(axis=1)
    own = to_pivots[rows, home][:, None]
    gap = np.maximum(between[home], 1e-12)
    beyond = (to_pivots**2 - own**2) / (2 * gap)
    near = (to_pivots <= own + 2 * radius + SLACK) & (beyond <= radius + SLACK)
    return home, near & (np.arange(to_pivots.shape[1])[None, :] > home[:, None])


def choose_pivots(sample: np.ndarray, radius: float, growth: float) -> tuple[np.ndarray, float]:
    """(pivots, copies per vector): as many pivots as the sample says are worth their copies, else one.

    Pivots are more than twice the radius apart, so a dense group is not divided. A single pivot is the
    vector with most others within half the radius. `growth` is what earlier splits have copied already.
    """
    between = distances(sample, sample)
    n = len(sample)
    core = (between <= radius / 2).sum(axis=1)
    single = int(core.argmax())
    chosen = [single]
    for i in range(n):
        if len(chosen) < PIVOTS and between[i, chosen].min() > 2 * radius:
            chosen.append(i)
    best, copies, least = [single], 1.0, WORTH * (n * n - int(core[single])**2) / 2
    for k in (2, 4, 8, 16):
        if k > len(chosen):
            break
        some = chosen[:k]
        home, copied = memberships(between[:, some], between[np.ix_(some, some)], radius)
        per_vector = 1 + copied.sum() / n
        members, guests = np.bincount(home, minlength=k), copied.sum(axis=0)
        dense = np.array([((home == j) & (between[:, p] <= radius / 2)).sum() for j, p in enumerate(some)])
        pairs = ((members**2 - dense**2) / 2 + members * guests).sum()
        if growth * per_vector <= COPIES and pairs < least:
            best, copies, least = some, per_vector, pairs
    return sample[best], copies


def _pivot_table(parts: DataFrame, radius: float) -> DataFrame:
    """(cell, n, pivots, k, copies) from a sample of each cell's vectors."""

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        sample = unit_rows(matrix(table.column("vec")))[order][:4 * CANDIDATES]
        pivots, copies = choose_pivots(sample, radius, table.column("growth")[0].as_py())
        return pa.table({
            "cell": table.column("cell").slice(0, 1), "n": table.column("n").slice(0, 1), "pivots": pa.array([pivots.tobytes()]),
            "k": pa.array([len(pivots)], pa.int32()), "copies": pa.array([float(copies)])})

    return parts.groupBy("cell").applyInArrow(choose, "cell string, n bigint, pivots binary, k int, copies double")


def _deal(rows: DataFrame, pivots: DataFrame, radius: float, level: int) -> DataFrame:
    """Rows of large cells with their distance to the pivot; those of split cells in their new cells."""
    salts = F.ceil(F.col("n") / DEAL).cast("int")
    sizes = broadcast_if_small(stage(pivots.select("cell", salts.alias("salts")), "salts"))
    left = rows.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).drop("salts")
    right = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    kept = [f.name for f in rows.schema.fields]

    def deal(part: pa.Table, chosen: pa.Table) -> pa.Table:
        part = part.select(kept)
        if not part.num_rows:
            return part.append_column("leaf", pa.array([], pa.bool_()))
        k = chosen.column("k")[0].as_py()
        centres = np.frombuffer(chosen.column("pivots")[0].as_py(), dtype=np.float64).reshape(k, -1)
        to_pivots = distances(unit_rows(matrix(part.column("vec"))), centres)
        mask = part.column("mask").to_numpy()
        if k == 1:
            row, cell = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=int)
        else:
            home, copied = memberships(to_pivots, distances(centres, centres), radius)
            guest, place = np.nonzero(copied)
            row, cell = np.concatenate((np.arange(part.num_rows), guest)), np.concatenate((home, place))
            mask = np.concatenate((mask, mask[guest] | (1 << level)))
        d = to_pivots[row, cell]
        core = (d <= radius / 2 - SLACK) & (mask == 0)
        name = part.column("cell")[0].as_py()
        cells = pa.array([f"{name}.{c}" if k > 1 else name for c in range(k)]).take(pa.array(cell))
        growth = part.column("growth")[0].as_py() * chosen.column("copies")[0].as_py()
        values = {"cell": cells, "mask": pa.array(mask), "d": pa.array(d), "core": pa.array(core),
                  "growth": pa.array(np.full(len(row), growth)), "leaf": pa.array(np.full(len(row), k == 1))}
        taken = part.take(pa.array(row))
        return pa.table({c: values.get(c, taken.column(c) if c != "leaf" else None) for c in [*kept, "leaf"]})

    out = T.StructType([*rows.schema.fields, T.StructField("leaf", T.BooleanType())])
    return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(deal, out)


def _cells(rows: DataFrame, radius: float) -> DataFrame:
    """Rows in cells that are joined each on its own: split by pivots while that saves comparisons."""
    done, open_, level = [], rows, 0
    while True:
        sizes = stage(open_.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
        large = sizes.filter(F.col("n") > CELL)
        if level == 60 or large.isEmpty():
            done.append(open_)
            break
        share = F.lit(2.0 * CANDIDATES) / F.col("n")
        hashed = F.xxhash64("cls", F.lit(level))
        sample = open_.join(broadcast_if_small(large), "cell").withColumn("h", hashed).filter(
            F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
        pivots = stage(_pivot_table(sample, radius), "pivots")
        known = broadcast_if_small(pivots.select("cell"))
        done.append(open_.join(known, "cell", "left_anti"))
        dealt = stage(_deal(open_, pivots, radius, level), "dealt")
        done.append(dealt.filter("leaf").drop("leaf"))
        open_ = dealt.filter("NOT leaf").drop("leaf")
        level += 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("growth")


class _Forest:
    """Components of the rows of one comparison, joined row by row."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = self.parent[x]

    def join(self, x: np.ndarray) -> None:
        tops = np.unique(self.roots(x))
        self.parent[tops] = tops[0]


def linked_pairs(table: pa.Table, threshold: float, radius: float) -> pa.Table:
    """(cls, n, peer): of two blocks of a cell (or one with itself) each linked row, the weight it is linked with
    here, and the first row of its component here."""
    blk, first, second = (table.column(c).to_numpy() for c in ("blk", "ba", "bb"))
    cls, m, mask, core, d = (table.column(c).to_numpy() for c in ("cls", "m", "mask", "core", "d"))
    raw = matrix(table.column("vec"))
    unit = unit_rows(raw)
    same = first[0] == second[0]
    by_distance = np.lexsort((cls, d))
    a = by_distance[blk[by_distance] == first[0]]
    b = a if same else by_distance[blk[by_distance] == second[0]]
    weights, forest = np.zeros(len(cls), dtype=np.int64), _Forest(len(cls))
    masked, cored = bool(mask.any()), bool(core.any())
    for at in range(0, len(a), _ROWS):
        rows = a[at:at + _ROWS]
        low = np.searchsorted(d[b], d[rows[0]] - radius - SLACK)
        high = np.searchsorted(d[b], d[rows[-1]] + radius + SLACK, side="right")
        low = max(low, at) if same else low
        columns = b[low:high]
        if not len(columns):
            continue
        found = unit[rows] @ unit[columns].T
        near = found >= threshold
        for i, j in zip(*np.nonzero(np.abs(found - threshold) <= SLACK)):
            near[i, j] = cosine(raw[rows[i]], raw[columns[j]]) >= threshold
        if same:
            near &= np.arange(low, high)[None, :] > np.arange(at, at + len(rows))[:, None]
        if masked:
            near &= (mask[rows][:, None] & mask[columns][None, :]) == 0
        if cored:
            near &= ~(core[rows][:, None] & core[columns][None, :])
        for i in np.flatnonzero(near.any(axis=1)):
            hits = columns[near[i]]
            weights[rows[i]] += m[hits].sum()
            weights[hits] += m[rows[i]]
            forest.join(np.append(hits, rows[i]))
    hit = np.flatnonzero(weights)
    return pa.table({"cls": cls[hit], "n": weights[hit], "peer": cls[forest.roots(hit)]})


def vector_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, n, peer) of distinct vectors (cls, cell, m, vec): partial link counts, weighted by m, and links that
    connect what is linked."""
    radius = math.sqrt(2 - 2 * threshold)
    start = classes.select(
        "cell", "cls", "m", "vec", F.lit(0).cast("bigint").alias("mask"), F.lit(0.0).alias("d"), F.lit(False).alias("core"),
        F.lit(1.0).alias("growth"))
    cells = _cells(start, radius)
    sizes = stage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaf-sizes")
    rows = cells.join(broadcast_if_small(sizes), "cell")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"ba": F.least("blk", "other"), "bb": F.greatest("blk", "other")}).drop("n", "other")
    compared = rows.groupBy("cell", "ba", "bb").applyInArrow(
        lambda table: linked_pairs(table, threshold, radius), "cls bigint, n bigint, peer bigint")
    dense = cells.filter("core").select("cell", "cls", "m")
    totals = dense.groupBy("cell").agg(F.sum("m").alias("total"), F.min("cls").alias("peer"), F.count(F.lit(1)).alias("rows"))
    inside = dense.join(broadcast_if_small(stage(totals.filter("rows > 1"), "cores")), "cell").select(
        "cls", (F.col("total") - F.col("m")).alias("n"), "peer")
    return stage(compared.unionByName(inside), "vector-links")


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    Two rows are linked if their labels are equal (as text) and not NULL, their vectors equally long, and
    the cosine in double precision is at least `threshold` (between 0.5 and 1). NULL, empty and zero
    vectors and those with NULL or non-finite components link with nothing. n_links counts the other rows
    linked directly, rows that repeat a vector included; component_id is the smallest id reached over
    links, the own one included (NULL only where no id is known); kept tells whether it is the own id.
    Further columns are not read. Equal vectors are compared once.
    """
    vec = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType.elementType
    vec = vec if isinstance(kind, (T.FloatType, T.DoubleType)) else vec.cast("array<double>")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(vec, lambda x: x + F.lit(0).cast("float")).alias("vec"))
    usable = F.col("label").isNotNull() & _usable(F.col("vec"))
    keyed = rows.filter(usable).withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(1), F.col("vec"))})
    classes = keyed.groupBy("label", "h", "g").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    cell = F.concat_ws(":", F.size("vec"), "label")
    classes = stage(classes.withColumns({"cls": F.monotonically_increasing_id(), "cell": cell}), "distinct-vectors")
    links = vector_links(classes, threshold)
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = star_components(links.select(F.col("cls").alias("u"), F.col("peer").alias("v")))
    placed = classes.drop("vec").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    placed = stage(placed.select(
        "label", "h", "g", "first_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("root", "cls").alias("root")), "vector-classes")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = placed.join(smallest, "root").select("label", "h", "g", "n_links", "component_id")
    found = keyed.join(by_class, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.unionByName(alone).withColumn("kept", kept)
