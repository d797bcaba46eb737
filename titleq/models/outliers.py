"""Outliers by isolation and by local density.

An isolation forest's trees are built in tasks, one group per tree, from the rows whose hash with the tree's
number is smallest: a fixed number of rows for each tree, whatever the table's size. The trees, a bounded
number of nodes, are sent to the tasks that measure path lengths in one scan.

The local outlier factor compares a row's density with that of its nearest rows among all rows. These are
found exactly: a tree cuts the rows into cells that lie close together, and a cell's rows into leaves that are stored with their
bounds. A task has the rows of one cell at once, meets first the leaves of its own cell and then, as a stream, those of other
cells that may hold a nearer row. Of equal rows a table keeps as many as can be neighbours, so no cell is made of one point.

Rows whose features hold a null or a number that isn't finite get a null score. Equal rows get equal scores. Empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import in_batches, written

TREES, SAMPLE = 200, 256
#: Neighbours of the local outlier factor.
NEIGHBOURS = 20
#: Most reference rows of a cell and of a leaf, rows that a task scores at once, and reference rows that it holds at once.
CELL_ROWS, LEAF_ROWS, QUERIES, HELD_ROWS = 8192, 128, 16_384, 65_536
#: Rows that are compared with the same leaves, and distances that a task holds at once: a few arrays of 8 MB.
BLOCK_ROWS, DISTANCES = 64, 1 << 20
EULER = 0.5772156649015329


def _whole(features: str) -> Column:
    """Whether all features are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(features).isNotNull() & ~F.exists(features, bad)


def usable(rows: DataFrame, features: str) -> DataFrame:
    """Rows whose features are all finite numbers."""
    return rows.where(_whole(features))


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def _unit(*parts: Column) -> Column:
    return (F.xxhash64(*parts).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)


# ---- isolation forest ----------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays: split feature (-1 in a leaf), threshold, children, and the path length that ends in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray

    def lengths(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            feature = self.feature[node]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return self.path[node]
            at = node[inner]
            low = x[inner, feature[inner]] < self.threshold[at]
            node[inner] = np.where(low, self.left[at], self.right[at])


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """A random tree of the rows, as deep as the logarithm of their number."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        number = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + mean_path(len(rows))])
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(low < high)
        if depth < limit and len(rows) > 1 and len(wide):
            feature = int(rng.choice(wide))
            threshold = float(rng.uniform(low[feature], high[feature]))
            if threshold <= low[feature]:  # a draw at the lower end would leave one side empty
                threshold = float(np.nextafter(low[feature], high[feature]))
            below = x[rows, feature] < threshold
            left = split(rows[below], depth + 1)
            right = split(rows[~below], depth + 1)
            nodes[number][:4] = [feature, threshold, left, right]
        return number

    split(np.arange(len(x)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


class Forest:
    """Trees and the sample size that their scores refer to."""

    def __init__(self, trees: list[Tree], sample: int):
        self.trees, self.sample = trees, sample

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0.5 is average; near 1 stands apart."""
        mean = sum((t.lengths(x) for t in self.trees), np.zeros(len(x))) / max(1, len(self.trees))
        return 2 ** (-mean / max(mean_path(self.sample), 1e-9))


def forest(rows: DataFrame, key: str, features: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    """Isolation forest of stored rows with unique ``key``. The driver gets trees x 2 x sample nodes at most."""
    good = usable(rows, features).select(F.col(key).cast("string").alias("key"), F.col(features).cast("array<double>").alias("x"))
    total = good.count()
    size = min(sample, total)
    # So many rows come below the mark that fewer than ``size`` is out of the question; a tree keeps the lowest.
    mark = min(1.0, (size + 10 * math.sqrt(size) + 20) / max(total, 1))
    place = lambda t: _unit(F.col("key"), t, F.lit(seed))
    chosen = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("place"))), lambda p: p["place"] < mark)
    dealt = good.select("key", "x", F.inline(chosen))
    groups = dealt.groupBy("tree").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "key", "x"))), 1, max(size, 1)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grown = grow(np.array([m["x"] for m in members]), np.random.default_rng([seed, tree]))
                n = len(grown.path)
                arrays = [np.full(n, tree, np.int32), np.arange(n, dtype=np.int32), grown.feature, grown.threshold, grown.left, grown.right, grown.path]
                kinds = [np.int32, np.int32, np.int32, float, np.int32, np.int32, float]
                names = ["tree", "node", "feature", "threshold", "left", "right", "path"]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(k)) for a, k in zip(arrays, kinds)], names=names)

    schema = "tree int, node int, feature int, threshold double, `left` int, `right` int, path double"
    table = groups.mapInArrow(run, schema).toPandas().sort_values(["tree", "node"])  # bounded by trees and sample
    parts = [part for _, part in table.groupby("tree")]
    cells = ("feature", "threshold", "left", "right", "path")
    return Forest([Tree(*(p[c].to_numpy() for c in cells)) for p in parts], size)


def _scored(rows: DataFrame, features: str, score, *keep: str) -> DataFrame:
    """(``keep`` ..., score): a function of the feature matrix over all rows in batches; null for unusable rows."""
    kinds = dict(rows.dtypes)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vector = F.col(features).cast("array<double>")
    ready = rows.select(*keep, F.when(vector.isNotNull() & ~F.exists(vector, bad), vector).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            good = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            out = np.full(batch.num_rows, np.nan)
            if len(good):
                out[good] = score(x.flatten().to_numpy().reshape(len(good), -1))
            found = pa.array(out, mask=np.isin(np.arange(batch.num_rows), good, invert=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "score"])

    return ready.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "score double"]))


def isolation_scores(rows: DataFrame, features: str, model: Forest, *keep: str) -> DataFrame:
    return _scored(rows, features, model.scores, *keep)


# ---- local outlier factor ------------------------------------------------------------------------


def _gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances of each box from each other box; never more than that of two rows inside, to the last bit."""
    out = np.zeros((len(low), len(other_low)))
    for c in range(low.shape[1]):
        gap = np.maximum(np.maximum(other_low[:, c] - high[:, c, None], low[:, c, None] - other_high[:, c]), 0)
        out += gap * gap
    return out


def _reaches(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Squared distances of the farthest corners of one box and each other box."""
    return (np.maximum(high - other_low, other_high - low) ** 2).sum(axis=1)


def _halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows, cut at the middle of the widest feature until no part has more than ``most``."""
    parts, done = [np.arange(len(x))], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            done.append(part)
            continue
        widest = int(np.argmax(x[part].max(axis=0) - x[part].min(axis=0)))
        order = part[np.argsort(x[part, widest], kind="stable")]
        parts += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


@dataclass
class _Cells:
    """A tree of cells: split feature (-1 in a cell), threshold, number of the left child; the right one's is one more."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])

    def split(self, cell: int, feature: int, threshold: float) -> list[int]:
        child = len(self.feature)
        self.feature[cell], self.threshold[cell], self.left[cell] = feature, threshold, child
        self.feature += [-1, -1]
        self.threshold += [0.0, 0.0]
        self.left += [-1, -1]
        return [child, child + 1]

    def of(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        cell = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(feature[cell] >= 0)):
            at = cell[inner]
            cell[inner] = left[at] + (x[inner, feature[at]] > threshold[at])
        return cell

    def placed(self, rows: DataFrame) -> DataFrame:
        """The rows with the ``cell`` of ``x``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
                cell = pa.array(self.of(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

        return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "cell int"]))


def _cells(points: DataFrame, width: int, most: int) -> _Cells:
    """Cells of at most ``most`` of the points, or of equal ones: one scan per level."""
    tree, due = _Cells(), [0]
    columns = [F.col("x")[i] for i in range(width)]
    marks = [m for c in columns for m in (F.min(c), F.percentile_approx(c, 0.5, 1000), F.max(c))]
    while due:
        sizes = tree.placed(points.select("x")).where(F.col("cell").isin(due)).groupBy("cell")
        found = sizes.agg(F.count("*").alias("n"), F.array(*marks).alias("marks")).where(F.col("n") > most).collect()  # one row per cell
        due = []
        for row in sorted(found, key=lambda r: r["cell"]):
            low, middle, high = np.array(row["marks"]).reshape(width, 3).T
            even = np.flatnonzero(middle < high)
            wide = even if len(even) else np.flatnonzero(low < high)
            if len(wide):
                feature = int(wide[np.argmax((high - low)[wide])])
                cut = middle[feature] if len(even) else low[feature] + (high[feature] - low[feature]) / 2
                due += tree.split(row["cell"], feature, float(min(cut, np.nextafter(high[feature], -np.inf))))
    return tree


def _leaves(points: DataFrame, width: int) -> DataFrame:
    """(leaf, cell, low, high, x, place): the points of each leaf as flat lists, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            cell, place = int(table["cell"][0].as_py()), table["place"].to_numpy()
            x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            order = np.lexsort((*x.T, place))
            x, place = x[order], place[order]
            for i, part in enumerate(_halves(x, LEAF_ROWS)):
                row = {"leaf": (cell << 32) + i, "cell": cell, "low": x[part].min(axis=0), "high": x[part].max(axis=0), "x": x[part].ravel(), "place": place[part]}
                kinds = {"leaf": pa.int64(), "cell": pa.int32(), "place": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(c, pa.list_(pa.float64()))) for c, v in row.items()], names=list(row))

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if first == last:
                    continue
                if held and held[0].column("cell")[0].as_py() != cells[first]:
                    yield from packed()
                    held.clear()
                held.append(batch.slice(first, last - first))
        if held:
            yield from packed()

    sorted_ = points.repartition("cell").sortWithinPartitions("cell")
    return sorted_.mapInArrow(run, "leaf long, cell int, low array<double>, high array<double>, x array<double>, place array<long>")


class _Nearest:
    """The ``most`` nearest reference rows of some points met so far: squared distances, places and values, in order."""

    def __init__(self, x: np.ndarray, most: int, values: int):
        x, alike = np.unique(x, axis=0, return_inverse=True)
        #: Equal points are looked up once; ``alike`` says which of ``x`` a point is.
        self.x, self.most, self.alike = x, most, alike.ravel()
        self.blocks = _halves(x, BLOCK_ROWS) if len(x) else []
        self.far = np.full((len(x), most), np.inf)
        self.place = np.full((len(x), most), np.iinfo(np.int64).max)
        self.values = np.zeros((values, len(x), most))

    def _meet(self, block: np.ndarray, x: np.ndarray, place: np.ndarray, values: np.ndarray) -> None:
        d = np.zeros((len(block), len(x)))
        for c in range(x.shape[1]):  # differences, not products: exact for equal rows
            gap = self.x[block, c, None] - x[:, c]
            d += gap * gap
        bound = self.far[block, -1]
        if len(x) > self.most:
            bound = np.minimum(bound, np.partition(d, self.most - 1, axis=1)[:, self.most - 1])
        row, new = np.nonzero(d <= bound[:, None])
        if not len(row):
            return
        rows = np.concatenate([np.repeat(np.arange(len(block)), self.most), row])
        far = np.concatenate([self.far[block].ravel(), d[row, new]])
        places = np.concatenate([self.place[block].ravel(), place[new]])
        order = np.lexsort((places, far, rows))
        order = order[np.searchsorted(rows[order], np.arange(len(block)))[:, None] + np.arange(self.most)]
        self.far[block], self.place[block] = far[order], places[order]
        for i, column in enumerate(values):
            self.values[i, block] = np.concatenate([self.values[i, block].ravel(), column[new]])[order]

    def meet(self, low: np.ndarray, high: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Takes over what is near from leaves (points, places, values) within the bounds."""
        sizes = np.array([len(p[1]) for p in parts])
        for block in self.blocks:
            x = self.x[block]
            gaps = _gaps(x.min(axis=0)[None], x.max(axis=0)[None], low, high)[0]
            order, at, goal = np.argsort(gaps, kind="stable"), 0, 4 * self.most
            while at < len(order):
                bound = self.far[block, -1]
                if gaps[order[at]] > bound.max():
                    break
                # The nearest leaves first, few of them, so that others can be left out.
                last = at + int(np.searchsorted(np.cumsum(sizes[order[at:]]), goal)) + 1
                some, at, goal = order[at:last], last, min(4 * goal, max(1, DISTANCES // len(block)))
                near = (_gaps(x, x, low[some], high[some]) <= bound[:, None]).any(axis=0)
                if near.any():
                    chosen = [parts[i] for i in some[near]]
                    self._meet(block, *(np.concatenate([p[k] for p in chosen], axis=1 if k == 2 else 0) for k in range(3)))

    def wanted(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the leaves within the bounds that may hold a nearer row than those met."""
        out = np.zeros(len(low), bool)
        for block in self.blocks:
            x = self.x[block]
            box = x.min(axis=0)[None], x.max(axis=0)[None]
            bound = self.far[block, -1]
            if np.isinf(bound).any():  # few rows were met: so many lie within the farthest corners of some boxes
                reaches = _reaches(*box, low, high)
                order = np.argsort(reaches)
                enough = int(np.searchsorted(np.cumsum(sizes[order]), self.most))
                if enough < len(order):
                    bound = np.minimum(bound, reaches[order[enough]] * (1 + 1e-9))
            some = np.flatnonzero((_gaps(*box, low, high)[0] <= bound.max()) & ~out)
            out[some[(_gaps(x, x, low[some], high[some]) <= bound[:, None]).any(axis=0)]] = True
        return np.flatnonzero(out)

    def neighbours(self) -> np.ndarray:
        """Where the neighbours of each point stand: from the second on if the first equals the point."""
        return (self.far[:, 0] == 0).astype(int)[:, None] + np.arange(self.most - 1)


class Reference:
    """All reference rows: stored leaves (leaf, cell, low, high, x, place and values), the tree of cells, the leaves' bounds."""

    def __init__(self, rows: int, leaves: DataFrame, tree: _Cells):
        self.rows, self.leaves, self.tree = rows, leaves, tree
        boxes = leaves.select("leaf", "low", "high", F.size("place").alias("n")).orderBy("leaf").toArrow()  # a box for each leaf's rows
        self.numbers, self.sizes = boxes["leaf"].to_numpy(), boxes["n"].to_numpy()
        self.low, self.high = (boxes[c].combine_chunks().flatten().to_numpy().reshape(len(boxes), -1) for c in ("low", "high"))

    def __len__(self) -> int:
        return self.rows

    def groups(self, queries: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, int]:
        """(``queries`` with their ``_group``, the leaves of each group's cell, number of groups): a group is a task's share of a cell.

        Shares are cut by a hash of the columns ``by``.
        """
        width = self.low.shape[1]
        counts = sorted(queries.groupBy("cell").agg(F.sum(F.size("x")).alias("n")).collect())  # one row per cell
        parts = [max(1, -(-r["n"] // (width * QUERIES))) for r in counts]
        first = np.cumsum([0, *parts]).tolist()
        cells = queries.sparkSession.createDataFrame([(r["cell"], p, f) for r, p, f in zip(counts, parts, first)], "cell int, _parts int, _first int")
        dealt = queries.join(F.broadcast(cells), "cell")
        hashed = F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")
        own = self.leaves.join(F.broadcast(cells), "cell")
        each = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)).alias("_group")
        dealt = dealt.select(*[F.col(c) for c in queries.columns], (F.col("_first") + hashed).alias("_group"))
        return dealt, own.select(*self.leaves.columns, each), first[-1]


def _met(reference: Reference, queries: DataFrame, leaves: list[DataFrame], groups: int, most: int, use, schema: str, values: tuple[str, ...] = ()) -> DataFrame:
    """``use`` of the queries of each group after they met its leaves; leaves of the second frame come after those of the first.

    It gets the queries as record batches of one struct column, their numbers of points, and what is nearest to the points.
    """
    width = reference.low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, points, nearest, held, rows = None, [], [], None, [], 0

        def flush() -> None:
            nonlocal held, rows
            if held:
                nearest.meet(np.stack([h[0] for h in held]), np.stack([h[1] for h in held]), [h[2:] for h in held])
            held, rows = [], 0

        def begun() -> _Nearest:
            return _Nearest(np.concatenate(points).reshape(-1, width), most, len(values))

        for batch in batches:
            numbers = batch.column("_group").to_numpy().astype(np.int64) * 2 + (batch.column("_kind").to_numpy() > 0)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if group != numbers[low] // 2:
                    if asked:
                        nearest = nearest or begun()
                        flush()
                        yield from use(group, asked, points, nearest)
                    group, asked, points, nearest = int(numbers[low] // 2), [], [], None
                lists = [part.column(c) for c in ("x", "low", "high", "place", *values)]
                if numbers[low] % 2 == 0:
                    asked.append(part.column("_query"))
                    ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())])
                    flat = lists[0].flatten().to_numpy()
                    points += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                    continue
                if not asked:  # a share without queries
                    continue
                nearest = nearest or begun()
                cells = [[c[i].values.to_numpy() for c in lists] for i in range(part.num_rows)]
                for x, box_low, box_high, place, *more in cells:
                    held.append((box_low, box_high, x.reshape(-1, width), place, np.stack(more) if more else np.zeros((0, len(place)))))
                    rows += len(place)
                    if rows >= HELD_ROWS:
                        flush()
        if asked:
            nearest = nearest or begun()
            flush()
            yield from use(group, asked, points, nearest)

    names = ("low", "high", "place", *values)
    kinds = dict(reference.leaves.dtypes)
    empty = [F.array().cast(kinds[c]).alias(c) for c in names]
    due = queries.select("_group", F.lit(0).alias("_kind"), "x", *empty, F.struct(*[c for c in queries.columns if c != "_group"]).alias("_query"))
    for kind, frame in enumerate(leaves, 1):
        due = due.unionByName(frame.select("_group", F.lit(kind).alias("_kind"), "x", *names), allowMissingColumns=True)
    dealt = due.repartitionById(groups, F.col("_group")).sortWithinPartitions("_group", "_kind")
    return in_batches(dealt, run, schema)


def _others(reference: Reference, queries: DataFrame, own: DataFrame, groups: int, most: int) -> DataFrame:
    """(_group, leaf), stored: the leaves of other cells that may hold one of the ``most`` nearest rows of a group's queries."""
    numbers, low, high, sizes = reference.numbers, reference.low, reference.high, reference.sizes

    def use(group: int, asked: list, points: list, nearest: _Nearest) -> Iterator[pa.RecordBatch]:
        found = numbers[nearest.wanted(low, high, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group, np.int32)), pa.array(found)], names=["_group", "leaf"])

    found = _met(reference, queries, [own], groups, most, use, "_group int, leaf long")
    cells = own.select("_group", "leaf")
    return written(found.join(cells, ["_group", "leaf"], "left_anti"), "other_leaves")


def _searched(reference: Reference, queries: DataFrame, by: tuple[str, ...], k: int, score, values: tuple[str, ...] = (), others: DataFrame | None = None) -> DataFrame:
    """The queries with ``found``: a function of the neighbours' distances and values, for each of a query's points."""
    dealt, own, groups = reference.groups(queries, *by)
    others = others or _others(reference, dealt, own, groups, k + 1)
    far = others.join(reference.leaves, "leaf").select(*reference.leaves.columns, "_group")

    def use(group: int, asked: list, points: list, nearest: _Nearest) -> Iterator[pa.RecordBatch]:
        at = nearest.neighbours()
        pick = lambda a: np.take_along_axis(a, at, axis=1)
        found = score(np.sqrt(pick(nearest.far)), *(pick(v) for v in nearest.values))[nearest.alike]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in points])]) // nearest.x.shape[1]
        first = 0
        for part in asked:
            own_ends = ends[first : first + len(part) + 1]
            lists = pa.ListArray.from_arrays(pa.array((own_ends - own_ends[0]).astype(np.int32)), pa.array(found[own_ends[0] : own_ends[-1]]))
            first += len(part)
            yield pa.RecordBatch.from_arrays([*part.flatten(), lists], names=[*(f.name for f in part.type), "found"])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in queries.dtypes), "found array<double>"])
    return _met(reference, dealt, [own, far], groups, k + 1, use, schema, values)


def _thickness(distances: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Local reachability density, given the neighbours' distances and k-distances."""
    return 1 / (np.maximum(distances, reach).mean(axis=1) + 1e-10)


class Density:
    """Reference rows with their k-distances (``reach``) and local reachability densities (``density``)."""

    def __init__(self, reference: Reference | list, k: int):
        self.reference, self.k = reference, max(1, min(k, len(reference) - 1))


def density(rows: DataFrame, key: str, features: str, k: int = NEIGHBOURS, most: int | None = None, seed: int = 42) -> Density:
    """The reference set of stored rows: all of them, or those ``most`` of smallest hash, in whose order ties go.

    Each row's k-distance and density are stored with it; the driver holds the bounds of the leaves.
    """
    place = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).bitwiseAND((1 << 52) - 1)
    cells = F.transform(F.col(features).cast("array<double>"), lambda v: v + 0.0)
    points = usable(rows, features).select(place.alias("place"), F.col(key).alias("key"), cells.alias("x"))
    points = written(points if most is None else points.orderBy("place", "key").limit(most), "reference_rows")
    total, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
    if total < 2:
        return Density([0.0] * total, k)
    k = max(1, min(k, total - 1))
    # A point's neighbours are the first k rows of equal distance at most, besides one that equals it.
    alike = Window.partitionBy("x").orderBy("place", "key")
    points = points.withColumn("_rank", F.row_number().over(alike)).where(F.col("_rank") <= k + 1).select("place", "x")
    points = written(points, "reference_points")
    tree = _cells(points, width, CELL_ROWS)
    reference = Reference(total, written(_leaves(tree.placed(points), width), "leaves"), tree)
    dealt, own, groups = reference.groups(reference.leaves, "leaf")
    others = _others(reference, dealt, own, groups, k + 1)
    for name, score, values in (("reach", lambda d: d[:, -1], ()), ("density", _thickness, ("reach",))):
        found = _searched(reference, reference.leaves, ("leaf",), k, score, values, others)
        reference.leaves = written(found.withColumnRenamed("found", name), "leaves")
    return Density(reference, k)


def outlier_factors(rows: DataFrame, features: str, model: Density, *keep: str) -> DataFrame:
    """(``keep`` ..., score): about 1 inside an even cloud, larger where the neighbours are denser than the row; null for unusable rows."""
    good = usable(rows, features)
    if len(model.reference) < 2:
        return _scored(rows, features, lambda x: np.ones(len(x)), *keep)

    def factor(distances: np.ndarray, reach: np.ndarray, thickness: np.ndarray) -> np.ndarray:
        return thickness.mean(axis=1) / _thickness(distances, reach)

    cells = F.transform(F.col(features).cast("array<double>"), lambda v: v + 0.0)
    queries = written(model.reference.tree.placed(good.select(*keep, cells.alias("x"))), "queries")
    found = _searched(model.reference, queries, keep, model.k, factor, ("reach", "density"))
    bad = rows.where(~F.coalesce(_whole(features), F.lit(False))).select(*keep, F.lit(None).cast("double").alias("score"))
    return found.select(*keep, F.col("found")[0].alias("score")).unionByName(bad)
