"""Random forests on all rows: each tree draws as many rows as there are, with replacement, and is grown level by level.

Trees only ask in which bins values are (BINS a feature, and one more, by exact ranks of all rows). So rows of equal bins, a cell, are added up once: a
tree draws from a cell's rows by their number, and they share their score. While cells are few (CELL_VALUES numbers at most) they are sent to
all tasks, which grow whole trees. More are dealt to parts: upper nodes are split by sums over all parts until their cells are few, and what
is below such a node, a piece of the tree, is grown in a task of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import joined
from .statistics import cumulated

BINS, CELL_VALUES = 255, 2_000_000
#: Levels that all rows of a batch go down before those in leaves are put aside; tasks for each core that trees are grown in, and rows scored.
LEVELS, TASKS = 4, 4
#: Whole trees that a slice of many cells is scored by at a time.
WHOLE = 8
#: A leaf's share is added up in whole units: such sums do not depend on their order.
UNIT = 2.0**40
_TREE = "tree int, piece int, feature array<short>, threshold array<short>, value array<double>, importance array<double>"
_TOP = "tree int, feature array<short>, threshold array<short>, child array<int>, importance array<double>"
_GRID = "features array<string>, filled array<double>, starts array<array<double>>"


@dataclass
class Tree:
    """By node: the feature asked (-1: a leaf), the largest value that goes left, the left child (the right one follows it), and the share of positives."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    importance: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        # a leaf goes on to itself; rows that came to one are put aside every few levels
        leaf = self.feature < 0
        feature, threshold = np.where(leaf, 0, self.feature).astype(np.intp), np.where(leaf, np.inf, self.threshold)
        child = np.where(leaf, np.arange(len(leaf)), self.child).astype(np.intp)
        values, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        end, live, at = np.zeros(len(x), np.intp), np.arange(len(x)), np.zeros(len(x), np.intp)
        while len(live):
            for _ in range(LEVELS):
                at = child.take(at) + (values.take(row + feature.take(at)) > threshold.take(at))
            end[live] = at
            on = np.flatnonzero(~leaf.take(at))
            live, at, row = live[on], at[on], row[on]
        return end

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def _impurity(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    total = zero + one
    return np.divide(2 * zero * one, total, out=np.zeros_like(total), where=total > 0)


def _best(bins: np.ndarray, node: np.ndarray, sums: list[np.ndarray], weights: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """By node (0 and on, each with cells), the largest gain of a split of one feature after some bin (-1 without any), and that bin."""
    width = int(bins.max()) + 1
    key = node * width + bins
    order = np.argsort(key)
    key = key[order]
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    # sums of whole numbers are exact, whatever their order
    to = [np.cumsum(s[order])[ends] for s in sums]
    of, bins = key[ends] // width, key[ends] % width
    last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
    before = [np.append(0, s[last[:-1]]) for s in to]
    left, right = [s - b[of] for s, b in zip(to, before)], [s[last][of] - s for s in to]
    imp = [_impurity(weights[0] * s[0], weights[1] * s[1]) for s in (left, right, [a + b for a, b in zip(left, right)])]
    gain = imp[2] - imp[0] - imp[1]
    gain[(left[2] < leaf) | (right[2] < leaf)] = -1.0
    best = np.maximum.reduceat(gain, np.append(0, last[:-1] + 1))
    hits = np.flatnonzero(gain == best[of])
    first = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]
    return best, bins[first]


def _balanced(zero: float, one: float) -> np.ndarray:
    """Weights of a draw of either class: classes weigh the same within a tree's bootstrap."""
    return (zero + one) / (2 * np.maximum([zero, one], 1e-12))


def grown(bins: np.ndarray, zero: np.ndarray, one: np.ndarray, count: np.ndarray, weights: np.ndarray, rng: np.random.Generator, tried: int, leaf: int) -> Tree:
    """A tree over cells, given their draws of both classes and the rows that these hit (twice ``leaf`` say as much as more). Thresholds are bins.

    Leaves keep ``leaf`` rows at least; each node tries ``tried`` features, and more until one splits. Nodes are numbered level by level.
    """
    n_features = bins.shape[1]
    feature, threshold, value, importance = [], [], [], np.zeros(n_features)
    drawn = np.flatnonzero(count)
    bins, sums = np.ascontiguousarray(bins[drawn].T, np.int64), [s[drawn] for s in (zero, one, count)]
    node, nodes = np.zeros(len(drawn), np.int64), 1
    while nodes:
        w0, w1, n = (np.bincount(node, s, nodes) for s in sums)
        w0, w1 = w0 * weights[0], w1 * weights[1]
        open_ = (w0 > 0) & (w1 > 0) & (n >= 2 * leaf) & (np.bincount(node, minlength=nodes) > 1)
        gain, of, at = np.full(nodes, 1e-12), np.full(nodes, -1), np.zeros(nodes, np.int64)
        order = rng.permuted(np.tile(np.arange(n_features), (nodes, 1)), axis=1)
        for step in range(n_features):
            asks = open_ & ((step < tried) | (of < 0))
            if not asks.any():
                break
            for f in np.unique(order[asks, step]):
                who = asks & (order[:, step] == f)
                rows = np.flatnonzero(who[node])
                g, b = _best(bins[f, rows], (np.cumsum(who) - 1)[node[rows]], [s[rows] for s in sums], weights, leaf)
                better = np.flatnonzero(who)[g > gain[who]]
                b = b[g > gain[who]]
                gain[better], of[better], at[better] = g[g > gain[who]], f, b
        split = of >= 0
        feature.append(of)
        threshold.append(np.where(split, at, 0))
        value.append(w1 / (w0 + w1))
        np.add.at(importance, of[split], gain[split])
        on = np.flatnonzero(split[node])
        node = node[on]
        bins, sums = bins[:, on], [s[on] for s in sums]
        right = bins[of[node], np.arange(len(on))] > at[node]
        node, nodes = 2 * (np.cumsum(split) - 1)[node] + right, 2 * int(split.sum())
    feature = np.concatenate(feature)
    return Tree(feature, np.concatenate(threshold), _children(feature), np.concatenate(value), importance)


def _children(feature: np.ndarray) -> np.ndarray:
    """Left children of nodes that are numbered level by level."""
    return np.where(feature >= 0, 2 * np.cumsum(feature >= 0) - 1, -1)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, tried: int, leaf: int) -> Tree:
    """A tree over rows as they are, each a cell of its own; thresholds are values."""
    drawn = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x))
    mine = np.flatnonzero(drawn)
    x, zero, one = x[mine], drawn[mine] * (y[mine] == 0), drawn[mine] * (y[mine] == 1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    t = grown(bins, zero, one, np.ones(len(mine), np.int64), _balanced(zero.sum(), one.sum()), rng, tried, leaf)
    t.threshold = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature, t.threshold)])
    return t


def different(rows: np.ndarray, draws: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """How many of a cell's rows so many draws with replacement hit, counted up to ``most``: a draw hits a new one by the share of those not hit yet."""
    hit, on, done = np.zeros(len(rows), np.int64), np.flatnonzero(draws), 0
    while len(on):
        hit[on] += rng.random(len(on)) * rows[on] >= hit[on]
        done += 1
        on = on[(draws[on] > done) & (hit[on] < np.minimum(rows[on], most))]
    return hit


def bootstrap(zero: np.ndarray, one: np.ndarray, draws: int, rng: np.random.Generator, most: int) -> list[np.ndarray]:
    """So many draws, with replacement, from the rows of cells: by cell those of both classes, and how many rows they hit (up to ``most``)."""
    rows = np.concatenate([zero, one])
    there = np.flatnonzero(rows)
    times, hit = np.zeros((2, len(rows)), np.int64)
    times[there] = rng.multinomial(draws, rows[there] / rows.sum())
    hit[there] = different(rows[there], times[there], most, rng)
    return [times[: len(zero)], times[len(zero) :], np.minimum(hit[: len(zero)] + hit[len(zero) :], most)]


@dataclass
class Grid:
    """features: columns in order; filled: what stands for a missing value of each, its median; starts: where its bins begin."""

    features: list[str]
    filled: list[float]
    starts: list[list[float]]

    @staticmethod
    def of(rows: DataFrame, features: list[str]) -> Grid:
        """A bin for each value where BINS are enough, else for equal shares of all rows; one begins at the median. No task holds a feature's rows."""
        numbers = F.array(*(_number(c) for c in features))
        counts = rows.select(F.posexplode(numbers).alias("_f", "_v")).where("_v is not null").groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("_n")).persist()
        sizes = {r["_f"]: r for r in counts.groupBy("_f").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("values")).collect()}
        mine = lambda g, kind: F.element_at(F.array(*(F.lit(g(sizes[i]) if i in sizes else 0).cast(kind) for i in range(len(features)))), F.col("_f") + 1)
        ranked = cumulated(counts, ["_f"], "_v", {"_to": "_n"}, descending=False)
        share = F.floor((F.col("_to") - F.col("_n")) * BINS / mine(lambda r: r["rows"], "double")).cast("double")
        bin_ = F.when(mine(lambda r: r["values"] <= BINS, "boolean"), F.col("_to")).otherwise(share)
        at = lambda up: F.min(F.when(F.col("_to") > mine(lambda r: (r["rows"] - 1 + up) // 2, "double"), F.col("_v")))
        found = ranked.groupBy("_f", bin_.alias("_bin")).agg(F.min("_v").alias("_start"), at(0).alias("_low"), at(1).alias("_high")).collect()  # bounded: BINS a feature
        counts.unpersist()
        filled, starts = [], []
        for i in range(len(features)):
            bins = [r for r in found if r["_f"] == i]
            middle = (0.5 * min(r[e] for r in bins if r[e] is not None) for e in ("_low", "_high"))
            filled.append(float(np.nan_to_num(sum(middle))) if bins else 0.0)
            starts.append(sorted({float(np.clip(v, -sys.float_info.max, sys.float_info.max)) for v in (*(r["_start"] for r in bins), filled[i])}))
        return Grid(features, filled, starts)

    def celled(self, rows: DataFrame) -> DataFrame:
        """rows with _cell, the bins of their values."""
        values = {f"_v{i}": F.coalesce(_number(c), F.lit(self.filled[i])) for i, c in enumerate(self.features)}
        bins = [f"_b{i}" for i in range(len(values))]
        splits = [[float("-inf"), *(s[1:] or s), float("inf")] for s in self.starts]
        out = Bucketizer(splitsArray=splits, inputCols=list(values), outputCols=bins).transform(rows.withColumns(values))
        return out.withColumn("_cell", F.array(*(F.col(b).cast("short") for b in bins))).drop(*values, *bins)


def _number(column: str) -> Column:
    """Without NaN, which is as good as null."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of x as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _matrix(cells: pa.Array, n: int) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _row(tree: int, piece: int, t: Tree) -> pa.RecordBatch:
    lists = [_lists(a[None], k) for a, k in ((t.feature, pa.int16()), (t.threshold, pa.int16()), (t.value, pa.float64()), (t.importance, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([piece], pa.int32()), *lists], ["tree", "piece", "feature", "threshold", "value", "importance"])


def _trees(rows: pa.RecordBatch | pa.Table) -> Iterator[Tree]:
    for i in range(rows.num_rows):
        feature, threshold, value, importance = (rows.column(c)[i].values.to_numpy() for c in ("feature", "threshold", "value", "importance"))
        yield Tree(feature, threshold, _children(feature), value, importance)


def _units(t: Tree, x: np.ndarray) -> np.ndarray:
    return np.rint(t.scores(x) * UNIT).astype(np.int64)


@dataclass
class Forest:
    """grid: its inputs; tops: of each tree the nodes above its pieces, whose numbers are those of its leaves; trees: a row a piece."""

    grid: Grid
    tops: list[Tree]
    trees: DataFrame

    @property
    def importances(self) -> list[float]:
        total = [t.importance.copy() for t in self.tops]
        for r in sorted(self.trees.select("tree", "piece", "importance").collect()):
            total[r["tree"]] += r["importance"]
        mean = np.mean([t / t.sum() if t.sum() > 0 else t for t in total], axis=0)
        return (mean / mean.sum() if mean.sum() > 0 else mean).tolist()

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with probability, whatever columns they have. The cells that they are in are found and scored now, each once, and their scores kept.

        Rows are dealt to tasks evenly, however few or uneven parts they are read in.
        """
        cells = self.grid.celled(rows).select("_cell").distinct().persist()
        number, most = cells.count(), CELL_VALUES // len(self.grid.features)
        few, whole = number <= most, all(len(t.feature) == 1 for t in self.tops)
        pieces = sum(int((t.feature < 0).sum()) for t in self.tops) / len(self.tops)
        found = self._sent(cells) if few and whole else self._dealt(cells, whole, int(np.ceil(number / (most * pieces))))
        found = found.groupBy("_cell").agg((F.sum("_s") / (len(self.tops) * UNIT)).alias("probability")).persist()
        found.count()
        cells.unpersist()
        rows = self.grid.celled(rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism))
        return joined(rows, F.broadcast(found) if few else found, ["_cell"], "left").drop("_cell")

    def _sent(self, cells: DataFrame) -> DataFrame:
        """_cell and _s, what some trees' leaves add up to: cells are sent to the trees."""
        n = len(self.grid.features)
        shared = cells.sparkSession.sparkContext.broadcast(_matrix(cells.toArrow()["_cell"].combine_chunks(), n))  # bounded: CELL_VALUES

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            total = np.zeros(len(x), np.int64)
            for batch in batches:
                for t in _trees(batch):
                    total += _units(t, x)
            yield pa.RecordBatch.from_arrays([_lists(x, pa.int16()), pa.array(total)], ["_cell", "_s"])

        return self.trees.mapInArrow(score, "_cell array<short>, _s long")

    def _dealt(self, cells: DataFrame, whole: bool, slices: int) -> DataFrame:
        """The same, with cells dealt to the pieces of trees that they come to (to some whole trees at a time), and to slices, each with its copy of a piece."""
        n, shared, at_once = len(self.grid.features), cells.sparkSession.sparkContext.broadcast(self.tops), WHOLE if whole else 1

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(0), n)
                for i, t in enumerate(shared.value[::at_once]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), pa.array(t.leaves(x), pa.int32()), batch.column(0)], ["some", "piece", "_cell"])

        def score(asked: pa.Table, found: pa.Table) -> pa.Table:
            x = _matrix(asked["_cell"].combine_chunks(), n) if asked.num_rows else np.zeros((0, n), np.int16)
            total = sum((_units(t, x) for t in _trees(found)), np.zeros(len(x), np.int64)) if len(x) else np.zeros(0, np.int64)
            return pa.table({"_cell": _lists(x, pa.int16()), "_s": pa.array(total)})

        keys = ["some", "piece", "slice"]
        asked = cells.mapInArrow(dealt, "some int, piece int, _cell array<short>").withColumn("slice", F.pmod(F.xxhash64("_cell"), F.lit(slices)).cast("int"))
        copies = self.trees.withColumn("some", F.floor(F.col("tree") / at_once).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(score, "_cell array<short>, _s long")

    def forget(self) -> None:
        """Trees are kept until then; what transform gave stays as it is."""
        self.trees.unpersist()

    def save(self, spark: SparkSession, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        tops = [(i, *(a.tolist() for a in (t.feature, t.threshold, t.child, t.importance))) for i, t in enumerate(self.tops)]
        spark.createDataFrame(tops, _TOP).write.mode("overwrite").parquet(f"{path}/tops")
        inputs = spark.createDataFrame([(self.grid.features, self.grid.filled, self.grid.starts)], _GRID)
        inputs.coalesce(1).write.mode("overwrite").json(f"{path}/inputs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        inputs = spark.read.schema(_GRID).json(f"{path}/inputs").first()
        tops = [_top(*(np.array(r[c]) for c in ("feature", "threshold", "child", "importance"))) for r in spark.read.parquet(f"{path}/tops").orderBy("tree").collect()]
        return Forest(Grid(*inputs), tops, spark.read.parquet(f"{path}/trees"))


def _top(feature, threshold, child, importance) -> Tree:
    return Tree(np.array(feature), np.array(threshold), np.array(child), np.zeros(len(feature)), np.array(importance, float))


def _rng(seed: int, tree: int, use: int, place: int) -> np.random.Generator:
    """Of a tree's draws (1, by part) and features (2, by piece; 3, by node above), and of its draws from each part (0)."""
    return np.random.default_rng([seed, tree, use, place])


def fit_forest(train: DataFrame, features: list[str], label: str, trees: int, leaf: int, seed: int) -> Forest:
    """Trees are grown in tasks, on as many cores as there are; each has seeds of its own. Needs both classes."""
    rows = train.withColumn("_y", F.col(label).cast("int")).where("_y in (0, 1)")
    grid = Grid.of(rows, features)
    cells = grid.celled(rows).groupBy("_cell").agg(F.count_if(F.col("_y") == 0).alias("_0"), F.count_if(F.col("_y") == 1).alias("_1")).persist()
    few = cells.count() <= CELL_VALUES // len(features)
    forest = (_whole if few else _pieces)(cells, grid, trees, leaf, seed)
    cells.unpersist()
    return forest


def _kept(trees: DataFrame) -> DataFrame:
    """Grown now, on all cores, and not again."""
    trees = trees.persist()
    trees.count()
    return trees


def _sorted(cells: np.ndarray, zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the same order on every run, whatever order they came in."""
    order = np.lexsort(cells.T)
    return cells[order], zero[order], one[order]


def _whole(cells: DataFrame, grid: Grid, trees: int, leaf: int, seed: int) -> Forest:
    """All cells are sent to all tasks, which grow trees from their root."""
    spark, n = cells.sparkSession, len(grid.features)
    table = cells.toArrow()  # bounded: CELL_VALUES
    shared = spark.sparkContext.broadcast(_sorted(_matrix(table["_cell"].combine_chunks(), n), table["_0"].to_numpy(), table["_1"].to_numpy()))
    tried = max(1, int(np.sqrt(n)))

    def grow_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, zero, one = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                draws = bootstrap(zero, one, int(zero.sum() + one.sum()), _rng(seed, i, 1, 0), 2 * leaf)
                yield _row(i, 0, grown(bins, *draws, _balanced(draws[0].sum(), draws[1].sum()), _rng(seed, i, 2, 0), tried, leaf))

    tasks = min(trees, TASKS * spark.sparkContext.defaultParallelism)
    return Forest(grid, [_top([-1], [0], [-1], [0.0] * n) for _ in range(trees)], _kept(spark.range(0, trees, 1, tasks).mapInArrow(grow_all, _TREE)))


def _pieces(cells: DataFrame, grid: Grid, trees: int, leaf: int, seed: int) -> Forest:
    """Cells are dealt to parts, each drawn from by itself; upper nodes are split by sums over all parts, a level at a time."""
    spark, n, most = cells.sparkSession, len(grid.features), CELL_VALUES // len(grid.features)
    width, tried = BINS + 2, max(1, int(np.sqrt(n)))
    parts = -(-cells.count() // most) + 1
    dealt = cells.withColumn("_part", F.pmod(F.xxhash64("_cell"), F.lit(parts)).cast("int")).repartition(parts, "_part").persist()
    sizes = np.zeros(parts, np.int64)
    for r in dealt.groupBy("_part").agg(F.sum(F.col("_0") + F.col("_1")).alias("n")).collect():
        sizes[r["_part"]] = r["n"]
    draws = [_rng(seed, i, 0, 0).multinomial(sizes.sum(), sizes / sizes.sum()) for i in range(trees)]
    tops, weights = [_top([-1], [0], [-1], [0.0] * n) for _ in range(trees)], np.ones((trees, 2))
    # by tree its nodes of many cells, and leaves that no feature splits
    large, closed = [{0} for _ in range(trees)], []

    def drawn(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple]:
        """By part and tree: the node that each drawn cell came to, the cells' bins, and their draws."""
        found = list(batches)
        if not found:
            return
        table = pa.Table.from_batches(found)
        part, bins, zero, one = table["_part"].to_numpy(), _matrix(table["_cell"].combine_chunks(), n), table["_0"].to_numpy(), table["_1"].to_numpy()
        for p in np.unique(part):
            mine = _sorted(*(a[part == p] for a in (bins, zero, one)))
            for i, top, asked in shared.value:
                times = bootstrap(*mine[1:], int(draws[i][p]), _rng(seed, i, 1, int(p)), 2 * leaf)
                on = np.flatnonzero(times[2])
                at = top.leaves(mine[0][on])
                keep = np.isin(at, asked)
                yield i, at[keep], mine[0][on[keep]], [s[on[keep]] for s in times]

    keys = ["tree", "node"]
    while any(large):
        shared = spark.sparkContext.broadcast([(i, t, sorted(large[i])) for i, t in enumerate(tops) if large[i]])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, at, bins, times in drawn(batches, shared):
                for j in np.unique(at):
                    m = at == j
                    sums = np.stack([[np.bincount(bins[m, f], s[m], width) for f in range(n)] for s in (*times, np.ones(len(at)))])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), _lists(sums.reshape(1, -1), pa.float64())], [*keys, "sums"])

        def choose(table: pa.Table) -> pa.Table:
            i, j = table["tree"][0].as_py(), table["node"][0].as_py()
            sums = sum(v.values.to_numpy() for v in table["sums"].combine_chunks()).reshape(4, n, width)
            total = sums[:3, 0].sum(1)
            weight = weights[i] if j else _balanced(*total[:2])
            gain, of, at, left = 1e-12, -1, 0, 0
            if total[2] >= 2 * leaf and total[0] and total[1]:
                for step, f in enumerate(_rng(seed, i, 3, j).permutation(n)):
                    if step >= tried and of >= 0:
                        break
                    there = np.flatnonzero(sums[3, f])
                    (g,), (b,) = _best(there, np.zeros(len(there), np.int64), [s[f, there] for s in sums[:3]], weight, leaf)
                    if g > gain:
                        gain, of, at, left = g, f, b, sums[3, f, : b + 1].sum()
            one = weight[1] * total[1] / (weight * total[:2]).sum()
            return pa.table({"tree": [i], "node": [j], "of": [int(of)], "at": [int(at)], "gain": [float(gain)], "left": [float(left)], "cells": [sums[3, 0].sum()], "value": [one], "w0": [weight[0]], "w1": [weight[1]]})

        kind = "tree long, node long, of long, at long, gain double, left double, cells double, value double, w0 double, w1 double"
        found = dealt.mapInArrow(add, "tree int, node int, sums array<double>").groupBy(*keys).applyInArrow(choose, kind).collect()  # bounded: a row a node above
        for r in sorted(found):
            i, j, t = r["tree"], r["node"], tops[r["tree"]]
            weights[i] = r["w0"], r["w1"]
            large[i].discard(j)
            if r["of"] < 0:
                closed.append((i, j, [-1], [0], [r["value"]], [0.0] * n))
                continue
            t.feature[j], t.threshold[j], t.child[j] = r["of"], r["at"], len(t.feature)
            t.importance[r["of"]] += r["gain"]
            large[i] |= {t.child[j] + k for k, c in enumerate((r["left"], r["cells"] - r["left"])) if c > most}
            tops[i] = _top(np.append(t.feature, [-1, -1]), np.append(t.threshold, [0, 0]), np.append(t.child, [-1, -1]), t.importance)
    done = {c[:2] for c in closed}
    shared = spark.sparkContext.broadcast([(i, t, [j for j in np.flatnonzero(t.feature < 0) if (i, j) not in done]) for i, t in enumerate(tops)])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, at, bins, times in drawn(batches, shared):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), _lists(bins, pa.int16()), *map(pa.array, times)], ["tree", "piece", "_cell", "zero", "one", "count"])

    def grow_piece(table: pa.Table) -> pa.Table:
        i, j = table["tree"][0].as_py(), table["piece"][0].as_py()
        bins = _matrix(table["_cell"].combine_chunks(), n)
        t = grown(bins, *(table[c].to_numpy() for c in ("zero", "one", "count")), weights[i], _rng(seed, i, 2, j), tried, leaf)
        return pa.Table.from_batches([_row(i, j, t)])

    moved = dealt.mapInArrow(move, "tree int, piece int, _cell array<short>, zero long, one long, count long")
    pieces = moved.groupBy("tree", "piece").applyInArrow(grow_piece, _TREE)
    forest = Forest(grid, tops, _kept(pieces.unionByName(spark.createDataFrame(closed, _TREE))))
    dealt.unpersist()
    return forest
