"""Gradient-boosted trees for a handful of classes, fitted on all rows of a table, and a calibration of their probabilities.

Cuts come from counts of all values, and every level of the trees from histograms of all rows, which tasks add up over
their parts; only histograms come to the driver. Sums are in whole numbers, so the parts and their order don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataline.session import cut_lineage

BINS = 48
#: Values are counted by the first 16 bits of their float, seven of them of the mantissa.
KEYS = 1 << 16
#: Gradients are added up in units of one over this.
UNIT = 1 << 24
#: For bins, which are read often.
CODEC = "lz4"
#: Rows binned together.
BLOCK = 1 << 17


def _keys(x: np.ndarray) -> np.ndarray:
    u = (np.asarray(x, np.float32) + np.float32(0)).view(np.uint32)
    return (np.where(u >> 31, ~u, u | np.uint32(1 << 31)) >> 16).astype(np.int64)


def _values(keys: np.ndarray) -> np.ndarray:
    """The least value of each key."""
    k = keys.astype(np.uint32) << np.uint32(16)
    return np.where(k >> 31, k ^ np.uint32(1 << 31), ~k).view(np.float32).astype(np.float64)


def _cuts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Quantiles of values counted by key, as the least values of theirs."""
    if not len(keys):
        return np.zeros(0)
    total = counts.cumsum()
    return np.unique(_values(keys[np.searchsorted(total, np.linspace(0, 1, BINS)[1:-1] * (total[-1] - 1), side="right")]))


class Boosted:
    """Softmax boosting of histogram trees. A tree is (feature, level, value, cut): level is a value, cut its bin."""

    def __init__(self, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, balanced: bool = False):
        self.classes, self.rounds, self.depth, self.rate, self.ridge, self.balanced = classes, rounds, depth, rate, ridge, balanced
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        self.prior = np.zeros(classes)
        self.slope, self.shift = 1.0, np.zeros(classes)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        tables = Counts(x.shape[1], self.classes)
        tables.add(x, y)
        self.begin(tables)
        block = (self.binned(x), y)
        while not self.grown:
            self.grow(self.histograms(*block))
        return self

    def begin(self, counts: Counts) -> None:
        """Cuts, weights and the prior by the counts of all rows. Balanced classes weigh by the root of their number."""
        self.cuts = [_cuts(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts.values]
        self.groups: list[list[int]] = []
        room = BINS * BINS
        for j in sorted(range(len(self.cuts)), key=lambda j: len(self.cuts[j])):
            size = len(self.cuts[j]) + 1
            if not self.groups or room * size > BINS * BINS:
                self.groups.append([])
                room = 1
            self.groups[-1].append(j)
            room *= size
        n = counts.classes
        self.weights = 1 / np.maximum(n, 1) ** 0.5 if self.balanced else np.ones(self.classes)
        self.weights = self.weights * n.sum() / max((n * self.weights).sum(), 1e-9)
        self.prior = np.log(np.maximum(n * self.weights / max((n * self.weights).sum(), 1e-9), 1e-6))
        self.level = 0
        self.growing = self._stumps()

    def _stumps(self):
        inner = 2**self.depth - 1
        return [(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**self.depth), np.full(inner, BINS)) for _ in range(self.classes)]

    @property
    def grown(self) -> bool:
        return len(self.trees) == self.rounds

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value, a row for each feature."""
        return np.stack([np.searchsorted(cut, c, side="right").astype(np.uint8) for cut, c in zip(self.cuts, x.T)])

    def histograms(self, binned: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of gradients and curvatures, and numbers of rows, by class, node, feature and bin.

        The nodes are the root, or of each pair of a later level the smaller one; the other is what is left of their parent.
        """
        f, n, width = len(binned), len(y), max(1, 1 << self.level >> 1)
        out = np.zeros((self.classes, width, f, BINS, 3), np.int64)
        if not n:
            return out
        places = []
        if self.level:
            nodes = [_nodes(binned, tree, self.level, 3) for tree in self.growing]
            wanted = [(small[:, None] == (0, 1)).ravel()[node] for small, node in zip(self.small, nodes)]
            rows = np.flatnonzero(np.logical_or.reduce(wanted))
            binned, y = binned[:, rows], y[rows]
            for node, want in zip(nodes, wanted):
                here = np.flatnonzero(want[rows])
                places.append((here, (node[rows[here]] >> 1).astype(np.int64)))
        p = _softmax(self._scores(binned, 3))
        w = self.weights[y] * UNIT
        sums = [(np.rint(((y == k) - p[:, k]) * w), np.rint(np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * w), None) for k in range(self.classes)]
        if self.level:
            sums = [(grad[here], hess[here], None) for (grad, hess, _), (here, _) in zip(sums, places)]
        for group in self.groups:  # features of few bins together, as places in the product of their bins
            sizes = [len(self.cuts[j]) + 1 for j in group]
            room, place = int(np.prod(sizes)), np.zeros(len(y), np.int64)
            for j, size in zip(group, sizes):
                place = place * size + binned[j]
            for k in range(self.classes):
                at = place[places[k][0]] + places[k][1] * room if self.level else place
                for s, v in enumerate(sums[k][: 3 if self.level or not k else 2]):
                    told = np.bincount(at, v, width * room).reshape(width, *sizes)
                    for i, (j, size) in enumerate(zip(group, sizes)):
                        out[k, :, j, :size, s] = told.sum(tuple(d + 1 for d in range(len(group)) if d != i))
        if not self.level:  # the root has the same rows for all classes
            out[1:, ..., 2] = out[0, ..., 2]
        return out

    def grow(self, sums: np.ndarray) -> None:
        """One more level of the trees of a round, from the histograms of all rows."""
        first, width = 2**self.level - 1, 2**self.level
        last = self.level == self.depth - 1
        if self.level:
            counted, sums = sums, np.repeat(self.sums, 2, axis=1)
            for k, small in enumerate(self.small):
                at = 2 * np.arange(len(small))
                sums[k, at + 1 - small] -= counted[k]
                sums[k, at + small] = counted[k]
        self.sums, self.small = sums, np.zeros((self.classes, width), np.int64)
        for (feature, level, value, cuts), both, small in zip(self.growing, sums, self.small):
            g, h = (both[..., s].astype(np.float64).cumsum(2) / UNIT for s in range(2))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
            gain[(h < 1) | (ht - h < 1)] = -1
            best = gain.reshape(width, -1).argmax(1)
            picked, cut = best // BINS, best % BINS
            for k in range(width):
                split = gain[k, picked[k], cut[k]] > 1e-6 and cut[k] < len(self.cuts[picked[k]])
                if split:
                    feature[first + k], level[first + k], cuts[first + k] = picked[k], self.cuts[picked[k]][cut[k]], cut[k]
                left_rows, rows = both[k, picked[k], : cut[k] + 1, 2].sum() if split else both[k, 0, :, 2].sum(), both[k, 0, :, 2].sum()
                small[k] = 2 * left_rows > rows
                if last:
                    left = (g[k, picked[k], cut[k]], h[k, picked[k], cut[k]]) if split else (gt[k, 0, 0], ht[k, 0, 0])
                    value[2 * k], value[2 * k + 1] = left[0] / (left[1] + self.ridge), (gt[k, 0, 0] - left[0]) / (ht[k, 0, 0] - left[1] + self.ridge)
        self.level += 1
        if last:
            self.trees.append(self.growing)
            self.growing, self.level = self._stumps(), 0

    def _scores(self, columns: np.ndarray, by: int) -> np.ndarray:
        out = np.tile(self.prior[:, None], columns.shape[1])
        for at in range(0, len(self.trees), 2):  # two trees at once, as leaves of both
            for k, (one, *more) in enumerate(zip(*self.trees[at : at + 2])):
                leaf, value = _nodes(columns, one, self.depth, by), one[2]
                for tree in more:
                    leaf, value = leaf.astype(np.uint16) << self.depth | _nodes(columns, tree, self.depth, by), np.add.outer(value, tree[2]).ravel()
                out[k] += (self.rate * value)[leaf]
        return out.T

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._scores(np.ascontiguousarray(x.T), 1)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """One slope and a shift per class, by gradient descent on the log loss of a holdout."""
        s, hot = self.scores(x), np.eye(self.classes)[y]
        slope, shift = 1.0, np.zeros(self.classes)
        for _ in range(steps):
            p = _softmax(slope * s + shift) - hot
            slope = float(np.clip(slope - 0.02 * ((p * s).sum(1).mean() + 0.05 * (slope - 1)), 0.1, 5))
            shift = shift - 0.1 * (p.mean(0) + 0.05 * shift)
        self.slope, self.shift = slope, shift
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.slope * self.scores(x) + self.shift)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _nodes(columns: np.ndarray, tree: tuple, depth: int, by: int) -> np.ndarray:
    """Place of each row among the nodes of a depth, by values (1) or bins (3)."""
    feature, limits = tree[0], tree[by]
    node = np.zeros(columns.shape[1], np.uint8)
    for d in range(depth):
        go = np.zeros(len(node), bool)
        for k in range(1 << d):
            at = 2**d - 1 + k
            if limits[at] < (BINS if by == 3 else np.inf):
                c = columns[feature[at]]
                right = c > np.uint8(limits[at]) if by == 3 else c >= limits[at]
                go |= right & (node == k) if d else right
        node = node << 1 | go
    return node


class Counts:
    """How often each value, by key, and each class occurs."""

    def __init__(self, features: int, classes: int):
        self.values, self.classes = np.zeros((features, KEYS), np.int64), np.zeros(classes, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for c, total in zip(x.T, self.values):
            total += np.bincount(_keys(c), minlength=KEYS)
        self.classes += np.bincount(y, minlength=len(self.classes))


Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]


def _counting(read: Reader, features: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(features, classes)
        for x, y in read(batches):
            total.add(x, y)
        flat = np.concatenate((total.values.ravel(), total.classes))
        at = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    return run


def _binning(read: Reader, shared, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            x, y = (np.concatenate(c, axis=-1) for c in zip(*held))
            held.clear()
            packed = pa.Codec(CODEC).compress(x.tobytes(), asbytes=True)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([packed], pa.binary()), pa.array([y.astype(np.uint8).tobytes()], pa.binary())], names=["part", "x", "y"])

        for x, y in read(batches):
            held.append((shared.value[part].binned(x), y))
            if sum(len(y) for _, y in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return run


def _adding(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "y"))):
                if (m := shared.value[part]) is not None and y:
                    labels = np.frombuffer(y, np.uint8).astype(np.int64)
                    features = len(m.cuts)
                    x = np.frombuffer(pa.Codec(CODEC).decompress(x, features * len(labels), asbytes=True), np.uint8).reshape(features, -1)
                    h = m.histograms(x, labels)
                    sums[part] = sums[part] + h if part in sums else h
        packed = [pa.Codec("zstd").compress(h.tobytes(), asbytes=True) for h in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["part", "sums"])

    return run


def fit_all(parts: list[tuple[DataFrame, Reader]], models: list[Boosted], own: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Fits each model on all rows that its reader makes of a table (statistics and classes), and on rows of the driver.

    Reads the tables twice, and their bins once for each level of each round; all models grow at once.
    """
    spark = parts[0][0].sparkSession
    for m, (x, y), (df, read) in zip(models, own, parts):
        total = Counts(x.shape[1], m.classes)
        told = df.mapInArrow(_counting(read, x.shape[1], m.classes), "at long, n long").groupBy("at").sum("n").toArrow()
        at, n = (told.column(c).to_numpy() for c in range(2))
        inner = total.values.size
        total.values.ravel()[at[at < inner]] = n[at < inner]
        total.classes[at[at >= inner] - inner] = n[at >= inner]
        total.add(x, y)
        m.begin(total)

    fitted = spark.sparkContext.broadcast(models)
    rows = [df.mapInArrow(_binning(read, fitted, k), "part int, x binary, y binary") for k, (df, read) in enumerate(parts)]
    # as many tasks as cores, as each sends its histograms to the driver
    bins = cut_lineage(reduce(DataFrame.unionByName, rows)).coalesce(max(1, spark.sparkContext.defaultParallelism))
    mine = [(m.binned(x), y) for m, (x, y) in zip(models, own)]
    while not all(m.grown for m in models):
        state = spark.sparkContext.broadcast([None if m.grown else m for m in models])
        totals = [None if m.grown else m.histograms(*b) for m, b in zip(models, mine)]
        for r in bins.mapInArrow(_adding(state), "part int, sums binary").collect():
            total = totals[r.part]
            total += np.frombuffer(pa.Codec("zstd").decompress(bytes(r.sums), total.nbytes, asbytes=True), np.int64).reshape(total.shape)
        for m, total in zip(models, totals):
            if total is not None:
                m.grow(total)
        state.destroy()
    fitted.destroy()
