"""Random forests of class 0 / 1 (M1, M2, M3, M5, O2) that any engine can grow again bit by bit.

Nothing is drawn by a generator: a row's weight in a tree and a node's features
are hashes of (row key, tree, seed) and (tree, node, feature, seed), bins are order
statistics, histograms are whole numbers, and ties go to the lower feature and
bin. So a forest depends on its rows only, not on their layout, and SQL can check it.

All trees of all given settings grow together, level by level:

- open nodes with many rows: every task adds up histograms (feature, bin, class)
  of its rows for them, these are summed by node, and each node's best split comes
  back; a pass takes a bounded number of nodes;
- open nodes with few rows: their rows are packed and sent once to the task
  that grows the rest of these subtrees.

A scan so serves every tree: a search's candidates and folds cost levels, not
fits. The driver holds the nodes with many rows, and hands them to tasks. The
subtrees below stay in the tasks that grow them: importances, a search's scores of
left-out rows and the table of nodes are made there. Only ``nodes`` and scores of
other rows fetch them. A node's number is its path: 1, then 2 n (left) and 2 n + 1.
"""

from __future__ import annotations

import gc
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import running_sums

PRIME = (1 << 31) - 1
DEEPEST = 30
#: Nodes of one pass; bytes of packed rows in a task that grows subtrees; rows of a node that such a task takes: at least, at most.
OPEN_NODES, TASK_BYTES, FEW_ROWS, MOST_ROWS = 8192, 32 << 20, 4096, 1 << 21
#: Bytes of packed rows that a search sends at once: it grows so many trees, scores the left-out rows, and goes on.
SENT_BYTES = 8 << 30
#: Rows that are walked through the trees at once; nodes and rows that are grown by a level at once.
CHUNK_ROWS, BATCH_NODES, BATCH_ROWS = 1 << 18, 4096, 1 << 17
#: Of PRIME hash values, those below which a row is drawn 0, 1, 2, ... times (Poisson of mean 1).
DRAWS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]
#: How often a row is drawn by the hash's leading bits, and for which of these cells a look at DRAWS must decide.
DRAW_CELL = 15
DRAW_TABLE = np.searchsorted(np.array(DRAWS), np.arange(1 << 31 - DRAW_CELL) << DRAW_CELL, "right").astype(np.uint8)
DRAW_EDGE = np.isin(np.arange(1 << 31 - DRAW_CELL), np.array(DRAWS) >> DRAW_CELL)


@dataclass(frozen=True)
class Settings:
    """One forest. max_depth None: DEEPEST; max_features "sqrt", "log2", a number, or None (all); class_weight None,
    "balanced" (by the rows), "balanced_subsample" (by a tree's draws) or the two weights; without_fold: rows of that fold are left out; first: number of the first tree."""
    trees: int = 200
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    max_features: str | int | None = "sqrt"
    bootstrap: bool = True
    class_weight: str | tuple[float, float] | None = None
    without_fold: int | None = None
    seed: int = 42
    first: int = 0


def draw_factors(tree: int, seed: int) -> tuple[int, int]:
    """A tree's two numbers in the hash of its rows: (row * a + b) mod PRIME."""
    return (48271 * (tree + 1) + 16807 * seed + 1) % PRIME or 1, (69621 * (tree + 7) + 39373 * seed) % PRIME


def features_of(node: np.ndarray, tree: np.ndarray, seed: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    """For each node (row) the ``wanted`` features that may split it, ascending; n fills up shorter rows."""
    most = int(wanted.max(initial=1))
    if (wanted >= n).all():
        return np.tile(np.arange(n), (len(node), 1))
    base = (node * 31 + tree * 17 + seed * 13) % PRIME
    f = np.arange(n, dtype=np.int64)
    key = (base[:, None] * (2654435 + f * 40503) + 12345 * f) % PRIME
    first = np.argsort(key, axis=1, kind="stable")[:, :most]
    return np.sort(np.where(np.arange(most) < wanted[:, None], first, n), axis=1)


def row_number(keys, seed: int) -> Column:
    """A number in [0, PRIME) from the md5 of the row's keys."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % PRIME


def cut_points(df: DataFrame, features, bins: int) -> list[list[float]]:
    """For each feature the distinct values of rank floor(i * n / bins), i = 1 ... bins - 1: bounded by bins."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("x")).select("x.*")
    counts = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("c"))
    run = running_sums(counts, {"cum": "c"}, ["f"], ["v"], {"n": "c"})
    first = F.greatest(F.lit(1), F.floor(((F.col("cum") - F.col("c")) * bins + F.col("n") - 1) / F.col("n")))
    last = F.least(F.lit(bins - 1), F.floor((F.col("cum") * bins + F.col("n") - 1) / F.col("n")) - 1)
    out = [[] for _ in features]
    for r in run.filter(first <= last).select("f", "v").collect():
        out[r["f"]].append(r["v"])
    return [sorted(x) for x in out]


@dataclass
class Forest:
    """features, cut points, and for each tree its settings, class weights and upper nodes: number -> (feature or -1, bin,
    n0, n1); ``below``: those of them that a subtree is grown from. ``nodes`` are all nodes. ``twin``: without bootstrap and
    with all features a forest's trees are the same; they are grown once, as the first, and each counts as a tree."""
    features: list[str]
    cuts: list[list[float]]
    settings: list[Settings]  # of each tree
    numbers: list[int]  # of each tree within its forest
    group: list[int]  # which of the given settings a tree belongs to
    weights: list[tuple[float, float]] = field(default_factory=list)
    upper: list[dict[int, tuple[int, int, int, int]]] = field(default_factory=list)
    below: list[list[int]] = field(default_factory=list)
    twin: list[int] = field(default_factory=list)
    data: DataFrame | None = None  # the rows that subtrees are grown on
    bins: int = 32
    task_bytes: int = TASK_BYTES

    def only(self, group: int) -> Forest:
        at = [t for t, g in enumerate(self.group) if g == group]
        pick = lambda x: [x[t] for t in at]
        place = {t: i for i, t in enumerate(at)}
        return replace(self, settings=pick(self.settings), numbers=pick(self.numbers), group=[0] * len(at), weights=pick(self.weights),
                       upper=pick(self.upper), below=pick(self.below),
                       twin=[place[t] for t in pick(self.twin)])

    @property
    def grown(self) -> list[tuple[int, dict]]:
        """The trees that are grown, with their upper nodes."""
        return [(t, nodes) for t, nodes in enumerate(self.upper) if self.twin[t] == t]

    @cached_property
    def arrays(self) -> list[np.ndarray]:
        """For each tree its nodes, ascending, as columns node, feature, bin, n0, n1. The driver gets them all."""
        own = [(t, n, *x) for t, nodes in self.grown for below in [set(self.below[t])] for n, x in nodes.items() if n not in below]
        own = np.array(own, np.int64).reshape(-1, 6)
        if any(self.below):
            rest = subtrees(self, "nodes").toArrow()
            own = np.concatenate([own, np.stack([c.to_numpy().astype(np.int64) for c in rest.columns], axis=1)])
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        out = np.split(own[:, 1:], np.searchsorted(own[:, 0], np.arange(1, len(self.upper))))
        return [out[t] for t in self.twin]

    @property
    def nodes(self) -> list[dict[int, tuple[int, int, int, int]]]:
        return [{n: tuple(x) for n, *x in own.tolist()} for own in self.arrays]

    def table(self, spark) -> DataFrame:
        """tree, node, feature (NULL: leaf), threshold (left: <= it), n0, n1 (drawn rows by class)."""
        schema = "tree int, node long, f int, b int, n0 long, n1 long"
        both = spark.createDataFrame([(t, n, *x) for t, nodes in self.grown for own in [set(self.below[t])]
                                      for n, x in nodes.items() if n not in own], schema)
        if any(self.below):
            both = both.unionByName(subtrees(self, "nodes"))
        alike = [[n for n, first in zip(self.numbers, self.twin) if first == t] for t in range(len(self.twin))]
        numbers, names = F.array(*[F.array(*map(F.lit, own)).cast("array<int>") for own in alike]), F.array(*map(F.lit, self.features))
        cuts = F.array(*[F.array(*[F.lit(float(v)) for v in own]).cast("array<double>") for own in self.cuts])
        is_split = F.col("f") >= 0
        at = lambda x, i: F.get(x, F.col(i))
        return both.select(F.explode(at(numbers, "tree")).alias("tree"), "node", F.when(is_split, at(names, "f")).alias("feature"),
                           F.when(is_split, F.get(at(cuts, "f"), F.col("b"))).alias("threshold"), "n0", "n1")

    def importance(self, spark, top: int | None = None) -> DataFrame:
        """M5 (+ O2): each feature's share of the impurity that its splits take away, averaged over trees."""
        gains = {}  # (tree, feature) -> parts, by the upper nodes and by each task's subtrees
        for t, nodes in self.grown:
            for n, x in nodes.items():
                if x[0] >= 0:
                    gain = _purity(self.weights[t], *nodes[2 * n][2:]) + _purity(self.weights[t], *nodes[2 * n + 1][2:]) - _purity(self.weights[t], *x[2:])
                    gains.setdefault((t, x[0]), []).append(gain)
        if any(self.below):
            for r in subtrees(self, "gains").collect():  # some rows for each task
                gains.setdefault((r["tree"], r["f"]), []).append(r["gain"])
        total = np.zeros(len(self.features))
        for t in self.twin:
            own = np.array([math.fsum(gains.get((t, f), [])) for f in range(len(self.features))])
            total += own / own.sum() if own.sum() > 0 else 0
        shares = total / total.sum() if total.sum() > 0 else total
        out = spark.createDataFrame([(f, float(x)) for f, x in zip(self.features, shares)], "feature string, importance double")
        out = out.orderBy(F.desc("importance"), "feature")
        return out.limit(top) if top else out

    def packed(self) -> list[tuple]:
        """For each tree: feature, bin, left child's place, leaf probability of class 1 (children stand side by side)."""
        made = {t: _packed(self.arrays[t], self.weights[t])[:4] for t, _ in self.grown}
        return [made[t] for t in self.twin]

    def score(self, df: DataFrame, out: str = "probability_fire") -> DataFrame:
        """``df`` with the mean of the trees' leaf shares of class 1. A NULL or NaN feature counts as the least value."""
        return scored(df, [self], [out])


def _purity(w, n0, n1):
    return ((w[0] * n0) ** 2 + (w[1] * n1) ** 2) / (w[0] * n0 + w[1] * n1)


def _packed(x: np.ndarray, w: tuple[float, float]) -> tuple:
    """A tree's nodes (node, feature, bin, n0, n1, ascending) as feature, bin, left child's place, share of class 1, node."""
    left = np.where(x[:, 1] >= 0, np.searchsorted(x[:, 0], 2 * x[:, 0]), -1)
    return x[:, 1].astype(np.int16), x[:, 2].astype(np.int16), left.astype(np.int32), _share(w, x[:, 3], x[:, 4]), x[:, 0]


def _share(w, n0, n1):
    a, b = w[0] * n0, w[1] * n1
    return b / np.where(a + b > 0, a + b, 1)


def scored(df: DataFrame, forests: list[Forest], names: list[str]) -> DataFrame:
    """``df`` with a probability column for each forest, all made in one pass."""
    sc = df.sparkSession.sparkContext
    first, given = forests[0], sc.broadcast([f.packed() for f in forests])
    features, cuts = first.features, first.cuts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned = _bins([batch.column(f) for f in features], cuts)
            found = []
            for trees in given.value:
                total = np.zeros(batch.num_rows)
                for feature, cut, left, p in trees:
                    total += p[_leaf(binned, feature, cut, left)]
                found.append(pa.array(total / max(1, len(trees))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def _bins(columns, cuts) -> np.ndarray:
    """Bin of each value: how many cut points are below it (NULL, NaN: 0)."""
    out = np.zeros((len(columns[0]) if columns else 0, len(cuts)), np.uint8)
    for i, (c, cut) in enumerate(zip(columns, cuts, strict=True)):
        x = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(cut), x, "left"))
    return out


def _blobs(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    starts = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(x))])


def _leaf(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of each row's leaf (or of the open node that it has come to)."""
    at = np.zeros(len(binned), np.int64)
    moving = np.arange(len(binned))
    while len(moving):
        moving = moving[left[at[moving]] >= 0]
        here = at[moving]
        at[moving] = left[here] + (binned[moving, feature[here]] > cut[here])
    return at


def _chunks(batches, n_features: int, most: int) -> Iterator[tuple]:
    """Rows of ``Prepared.data`` as arrays row, fold, class and bins, ``most`` at once or a batch more."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            x, first = b.column("bins"), b.column("bins").offset  # equally long values, one after the other
            first = np.frombuffer(x.buffers()[1], np.int32)[first]
            x = np.frombuffer(x.buffers()[2], np.uint8)[first:first + b.num_rows * n_features].reshape(b.num_rows, n_features)
            held.append((*(b.column(c).to_numpy() for c in ("row", "fold", "y")), x))
            n += b.num_rows
        if n >= most:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def draws(row: np.ndarray, fold: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often each row stands in a tree."""
    if s.bootstrap:
        a, b = draw_factors(tree, s.seed)
        value = (row * a + b) % PRIME
        at = value >> DRAW_CELL
        times, edge = DRAW_TABLE[at], np.flatnonzero(DRAW_EDGE[at])
        times[edge] = np.searchsorted(np.array(DRAWS), value[edge], "right")
    else:
        times = np.ones(len(row), np.uint8)
    return times if s.without_fold is None else np.where(fold == s.without_fold, 0, times)


class Rules:
    """The trees' settings as arrays by tree."""
    def __init__(self, settings: list[Settings], numbers: list[int], n_features: int):
        each = lambda of: np.array([of(s) for s in settings], np.int64)
        self.n, self.numbers, self.seed = n_features, np.array(numbers, np.int64), each(lambda s: s.seed)
        self.wanted = each(lambda s: max(1, min(n_features, _n_features(s, n_features))))
        self.leaf, self.split = each(lambda s: s.min_leaf), each(lambda s: s.min_split)
        self.deepest = each(lambda s: DEEPEST if s.max_depth is None else min(s.max_depth, DEEPEST))

    def features(self, node: np.ndarray, tree: np.ndarray) -> np.ndarray:
        return features_of(node, self.numbers[tree], self.seed[tree], self.wanted[tree], self.n)

    def may_split(self, node: np.ndarray, tree: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        depth = np.floor(np.log2(node)).astype(int)
        return (np.minimum(n0, n1) > 0) & (n0 + n1 >= self.split[tree]) & (depth < self.deepest[tree])


def best_splits(hist: np.ndarray, pick: np.ndarray, node: np.ndarray, tree: np.ndarray, rules: Rules, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node (histogram: class, node, place in pick, bin) the feature and bin of its best split, or -1, its rows
    by class, and those of them that go left."""
    bins, k = hist.shape[3], np.arange(len(node))
    left = hist.cumsum(axis=3)
    total = left[:, :, :1, -1:]
    (l0, l1), (r0, r1) = left, total - left
    leaf = rules.leaf[tree][:, None, None]
    fits = (l0 + l1 >= leaf) & (r0 + r1 >= leaf) & (pick < rules.n)[:, :, None]
    w0, w1 = weights[:, 0, None, None], weights[:, 1, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        a0, a1, b0, b1 = w0 * l0, w1 * l1, w0 * r0, w1 * r1
        score = np.where(fits, (a0 * a0 + a1 * a1) / (a0 + a1) + (b0 * b0 + b1 * b1) / (b0 + b1), -1.0)
    flat = score.reshape(len(node), -1)
    at = flat.argmax(axis=1)  # the first of equals: lower feature, lower bin
    n = total[:, :, 0, 0].astype(np.int64)
    ok = rules.may_split(node, tree, *n) & (flat[k, at] >= 0)
    place, b = at // bins, at % bins
    return np.where(ok, pick[k, place], -1), np.where(ok, b, 0), n, left[:, k, place, b].astype(np.int64)


def _n_features(s: Settings, n: int) -> int:
    kinds = {"sqrt": lambda: max(1, int(math.sqrt(n))), "log2": lambda: max(1, int(math.log2(n))), None: lambda: n}
    return kinds[s.max_features]() if s.max_features in kinds else min(n, int(s.max_features))


def class_weights(s: Settings, n0: int, n1: int, all0: int, all1: int) -> tuple[float, float]:
    if isinstance(s.class_weight, tuple):
        return s.class_weight
    a, b = (all0, all1) if s.class_weight == "balanced" else (n0, n1)
    return ((a + b) / (2 * a), (a + b) / (2 * b)) if s.class_weight and a and b else (1.0, 1.0)


def _summed(slot: np.ndarray, times: np.ndarray, y: np.ndarray, x: np.ndarray, pick: np.ndarray, bins: int) -> np.ndarray:
    """Histograms (class, slot, place in pick, bin) of rows, for each slot of the features that it picks."""
    k, wanted = pick.shape
    out, n = np.empty((2, k, wanted, bins)), x.shape[1]
    base, first = (y.astype(np.int64) * k + slot) * bins, np.arange(len(slot)) * n
    flat, times, pick = x.reshape(-1), times.astype(np.float64), np.minimum(pick, n - 1)
    for j in range(wanted):
        out[:, :, j] = np.bincount(base + flat[first + pick[slot, j]], times, 2 * k * bins).reshape(2, k, bins)
    return out


def _grown(node, tree, n0, n1, slot, code, x, ride, bins: int, rules: Rules, weights: np.ndarray) -> Iterator[tuple]:
    """Grow subtrees from nodes (arrays node, tree, n0, n1) with their rows (slot: place in node; code: 2 * draws + class).

    Yields, some nodes at a time, (tree, node, feature, bin, n0, n1), the gains of their splits (0: leaf), and which rides
    end at which leaf share of class 1: (ride, tree, share). ride: a number of each row that is only scored, -1: of no such row."""
    todo = []
    for wanted in np.unique(rules.wanted[tree]):  # one width of histograms in a batch
        own = np.flatnonzero(rules.wanted[tree] == wanted)
        place = np.full(len(node), -1)
        place[own] = np.arange(len(own))
        at = np.flatnonzero(place[slot] >= 0)
        todo.append((node[own], tree[own], n0[own], n1[own], place[slot[at]], code[at], x[at], ride[at] if ride is not None else None))
    while todo:
        node, tree, n0, n1, slot, code, x, ride = todo.pop()
        if len(node) > BATCH_NODES or (len(slot) > BATCH_ROWS and len(node) > 1):
            half = len(node) // 2
            for a, b in ((0, half), (half, len(node))):
                at = np.flatnonzero((slot >= a) & (slot < b))
                todo.append((node[a:b], tree[a:b], n0[a:b], n1[a:b], slot[at] - a, code[at], np.take(x, at, axis=0), ride[at] if ride is not None else None))
            continue
        pick, w = rules.features(node, tree), weights[tree]
        hist = _summed(slot, code >> 1, code & 1, x, pick, bins)
        f, cut, _, (l0, l1) = best_splits(hist, pick, node, tree, rules, w)
        split = np.flatnonzero(f >= 0)
        gain = np.zeros(len(node))
        if len(split):
            ws, m0, m1 = w[split].T, n0[split], n1[split]
            gain[split] = _purity(ws, l0[split], l1[split]) + _purity(ws, m0 - l0[split], m1 - l1[split]) - _purity(ws, m0, m1)
        yield (tree, node, f, cut, n0, n1), gain, None
        # children, side by side; those that can't be split are leaves
        child = np.repeat(2 * node[split], 2) + np.tile([0, 1], len(split))
        own = np.repeat(tree[split], 2)
        c0 = np.stack([l0[split], n0[split] - l0[split]], axis=1).reshape(-1)
        c1 = np.stack([l1[split], n1[split] - l1[split]], axis=1).reshape(-1)
        go = rules.may_split(child, own, c0, c1)
        leaf = np.flatnonzero(~go)
        none = np.full(len(leaf), -1)
        yield (own[leaf], child[leaf], none, none + 1, c0[leaf], c1[leaf]), np.zeros(len(leaf)), None
        place = np.full(2 * len(node), -1)
        first = np.repeat(2 * split, 2) + np.tile([0, 1], len(split))
        place[first[go]] = np.arange(int(go.sum()))
        side = 2 * slot + (x.reshape(-1)[np.arange(len(slot)) * x.shape[1] + np.maximum(f, 0)[slot]] > cut[slot])
        to = place[side]
        if ride is not None:
            share = np.repeat(_share(w.T, n0, n1), 2)
            share[first] = _share(weights[own].T, c0, c1)
            out = np.flatnonzero((to < 0) & (ride >= 0))
            yield None, None, (ride[out], tree[slot[out]], share[side[out]])
        at = np.flatnonzero(to >= 0)
        if go.any():
            todo.append((child[go], own[go], c0[go], c1[go], to[at], code[at], np.take(x, at, axis=0), ride[at] if ride is not None else None))


@dataclass
class Prepared:
    """Rows made ready for growing: cut points, the checkpointed rows (row, y, fold, bins), rows by class, and the seed
    of the row numbers. All fits on the same rows can share it."""
    cuts: list[list[float]]
    data: DataFrame
    totals: dict[int, int]
    seed: int


def prepared(df: DataFrame, features, label: str, keys, seed: int, bins: int = 32, fold: str | None = None) -> Prepared:
    """The rows with a label 0 or 1, binned once. keys: columns that name a row, or its number in [0, PRIME)."""
    rows, n_features = df.filter(F.col(label).isin(0, 1)), len(features)
    cuts = cut_points(rows, features, bins)
    kept = rows.select((keys if isinstance(keys, Column) else row_number(keys, seed)).alias("row"), F.col(label).cast("int").alias("y"),
                       (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _bins([b.column(f"f{i}") for i in range(n_features)], cuts)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), b.column("fold"), _blobs(x)], names=["row", "y", "fold", "bins"])

    data = cut_lineage(kept.mapInArrow(binned, "row long, y int, fold int, bins binary"))
    totals = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Prepared(cuts, data, totals, seed)


def fit(df: DataFrame, features, label: str, keys, settings: list[Settings] | Settings, bins: int = 32, fold: str | None = None,
        few_rows: int | None = None, open_nodes: int = OPEN_NODES, task_bytes: int = TASK_BYTES, ready: Prepared | None = None) -> Forest:
    """Grow the forests of all ``settings`` on the rows with a label 0 or 1. ``keys`` name a row. bins: 256 at most.
    few_rows: rows of a node that one task grows on (None: as many tasks as keep all cores busy).
    ready: these rows from ``prepared`` (with the same seed, bins and fold), if several fits share them."""
    spark, features = df.sparkSession, list(features)
    settings = [settings] if isinstance(settings, Settings) else list(settings)
    if ready is None or ready.seed != settings[0].seed:  # row numbers depend on the seed
        ready = prepared(df, features, label, keys, settings[0].seed, bins, fold)
    data, totals = ready.data, ready.totals
    of_tree = [replace(s) for s in settings for _ in range(s.trees)]
    group = [g for g, s in enumerate(settings) for _ in range(s.trees)]
    numbers = [s.first + t for s in settings for t in range(s.trees)]
    twin = [t if _differ(s, len(features)) else t - numbers[t] + s.first for t, s in enumerate(of_tree)]
    n_features, parts, rules = len(features), int(spark.conf.get("spark.sql.shuffle.partitions")), Rules(of_tree, numbers, len(features))
    if few_rows is None:
        few_rows = _few_rows(spark, ready, len(set(twin)))
    upper, below = [{1: (-1, 0, 0, 0)} for _ in of_tree], [[] for _ in of_tree]
    model = Forest(features, ready.cuts, of_tree, numbers, group, [(1.0, 1.0)] * len(of_tree), upper, below, twin, data, bins, task_bytes)

    def level(nodes: list[tuple[int, int]]) -> list[tuple]:
        """(place, feature, bin, n0, n1, left n0, left n1) of nodes with many rows. A root's rows give its tree's class weights."""
        tree, node = np.array([t for t, _ in nodes]), np.array([n for _, n in nodes], np.int64)
        given = spark.sparkContext.broadcast((_walks(model, nodes), tree, node, rules.features(node, tree), np.array(model.weights)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            walks, _, _, pick, _ = given.value
            hist = np.zeros((2, *pick.shape, bins), np.int64)
            for row, fold, y, x in _chunks(batches, n_features, CHUNK_ROWS):
                drawn = {}
                for t, packed, own, first, k in walks:
                    times = _drawn(drawn, row, fold, numbers[t], of_tree[t])
                    there = np.flatnonzero(times)
                    at = np.take(x, there, axis=0)
                    slot = own[_leaf(at, *packed)]
                    stay = np.flatnonzero(slot >= 0)
                    hist[:, first:first + k] += _summed(slot[stay], times[there[stay]], y[there[stay]], at[stay], pick[first:first + k], bins).astype(np.int64)
            for a in range(0, hist.shape[1], 256):
                part = hist[:, a:a + 256]
                there = np.flatnonzero(part.any(axis=(0, 2, 3)))
                yield pa.RecordBatch.from_pydict({"slot": pa.array(a + there), "hist": pa.array([part[:, i].astype("<i8").tobytes() for i in there.tolist()], pa.binary())})

        def choose(table: pa.Table) -> pa.Table:
            _, tree, node, pick, weights = given.value
            own, at = np.unique(table.column("slot").to_numpy(), return_inverse=True)
            hist = np.zeros((2, len(own), pick.shape[1], bins), np.int64)
            for i, h in zip(at.tolist(), table.column("hist").to_pylist(), strict=True):
                hist[:, i] += np.frombuffer(h, "<i8").reshape(2, -1, bins)
            t, w = tree[own], weights[tree[own]]
            for i in np.flatnonzero(node[own] == 1).tolist():
                w[i] = class_weights(of_tree[t[i]], *hist[:, i, 0].sum(axis=1).tolist(), totals.get(0, 0), totals.get(1, 0))
            f, b, n, left = best_splits(hist.astype(np.float64), pick[own], node[own], t, rules, w)
            return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("slot", "f", "b", "n0", "n1", "l0", "l1"), (own, f, b, *n, *left))})

        found = data.mapInArrow(count, "slot long, hist binary").groupBy(F.pmod("slot", F.lit(parts)).alias("p"))
        return [tuple(r) for r in found.applyInArrow(choose, "slot long, f long, b long, n0 long, n1 long, l0 long, l1 long").collect()]

    many = [(t, 1) for t in sorted(set(twin))]
    while many:
        nodes, many = sorted(many[:open_nodes]), many[open_nodes:]
        for slot, f, b, n0, n1, l0, l1 in level(nodes):
            t, n = nodes[slot]
            upper[t][n] = (f, b, n0, n1)
            if n == 1:
                model.weights[t] = class_weights(of_tree[t], n0, n1, totals.get(0, 0), totals.get(1, 0))
            if f >= 0:
                for child, c0, c1 in ((2 * n, l0, l1), (2 * n + 1, n0 - l0, n1 - l1)):
                    upper[t][child] = (-1, 0, c0, c1)
                    if rules.may_split(*(np.array([v]) for v in (child, t, c0, c1)))[0]:
                        if c0 + c1 > few_rows:
                            many.append((t, child))
                        else:
                            below[t].append(child)
    for t, first in enumerate(twin):
        upper[t], model.weights[t] = upper[first], model.weights[first]
    return model


def _differ(s: Settings, n_features: int) -> bool:
    """Whether a forest's trees differ."""
    return s.bootstrap or _n_features(s, n_features) < n_features


def _drawn(made: dict, row: np.ndarray, fold: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """``draws``, made once for trees that share them."""
    key = number, s.seed, s.bootstrap
    if key not in made:
        made[key] = draws(row, fold, number, replace(s, without_fold=None))
    return made[key] if s.without_fold is None else np.where(fold == s.without_fold, 0, made[key])


def _few_rows(spark, ready: Prepared, trees: int) -> int:
    """Rows of a node that one task grows on, of so many trees in all: batches of them take the same (else each passes
    over all rows for more levels)."""
    return min(MOST_ROWS, max(FEW_ROWS, sum(ready.totals.values()) * trees // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _forget_shuffles(spark) -> None:
    """Spark drops the files of a shuffle once nothing names it any more, here and in the JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fit_arrays(df: DataFrame, features, label: str, keys, settings: Settings, bins: int, ready: Prepared, sent_bytes: int = SENT_BYTES) -> Forest:
    """``fit`` with all nodes at the driver (``arrays``), grown for so many trees at a time as send ``sent_bytes``."""
    parts, few_rows = [], _few_rows(df.sparkSession, ready, settings.trees)
    for batch in _batches([settings], len(features), sum(ready.totals.values()), sent_bytes):
        part = fit(df, features, label, keys, [s for _, s in batch], bins, few_rows=few_rows, ready=ready)
        parts.append((part, part.arrays))
        _forget_shuffles(df.sparkSession)
    joined = lambda of: [x for part, _ in parts for x in of(part)]
    model = replace(parts[0][0], settings=joined(lambda p: p.settings), numbers=joined(lambda p: p.numbers), group=joined(lambda p: p.group),
                    weights=joined(lambda p: p.weights), upper=joined(lambda p: p.upper), below=joined(lambda p: p.below),
                    twin=_shifted([p.twin for p, _ in parts]))
    model.arrays = [x for _, own in parts for x in own]
    return model


def _shifted(lists: list[list[int]]) -> list[int]:
    """Places within each list as places within all of them."""
    out = []
    for own in lists:
        first = len(out)
        out += [first + t for t in own]
    return out


def _walks(model: Forest, nodes: list[tuple[int, int]]) -> list[tuple]:
    """For each tree of ``nodes`` (tree, node; ascending): the tree, its upper nodes packed, the place in its own list of
    each of these that is listed (or -1), its first place in ``nodes`` and how many it has there."""
    out, trees = [], np.array([t for t, _ in nodes])
    for t in np.unique(trees).tolist():
        first, end = np.searchsorted(trees, [t, t + 1]).tolist()
        number = {n: i for i, (_, n) in enumerate(nodes[first:end])}
        x = np.array(sorted((n, *v) for n, v in model.upper[t].items()), np.int64).reshape(-1, 5)
        packed = _packed(x, model.weights[t])
        out.append((t, packed[:3], np.array([number.get(n, -1) for n in x[:, 0].tolist()], np.int64), first, end - first))
    return out


def _dealt(sizes: list[int], shares: int) -> np.ndarray:
    """A share for each size, so that the shares are about equal."""
    out, heap = np.zeros(len(sizes), np.int64), [(0, i) for i in range(shares)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, share = heap[0]
        out[i] = share
        heapq.heapreplace(heap, (held + sizes[i], share))
    return out


#: What tasks make of the subtrees they grow.
MADE = {"nodes": "tree int, node long, f int, b int, n0 long, n1 long", "gains": "tree int, f int, gain double",
        "scores": "fit int, chunk long, tree int, at binary, p binary"}


def subtrees(model: Forest, kind: str) -> DataFrame:
    """Grow what is below the upper nodes, in tasks. kind "nodes": rows of nodes; "gains": for each task, tree and feature
    the impurity that its splits take away; "scores": for each fit, some of the rows of its left-out fold and tree, the
    rows whose leaf share of class 1 is above 0 (``at``: 2 * place in the chunk + class, as 32 bits) and that share."""
    data, bins, n_features, score = model.data, model.bins, len(model.features), kind == "scores"
    spark, settings, numbers, fit_of = data.sparkSession, model.settings, model.numbers, model.group
    rules, weights = Rules(settings, numbers, n_features), np.array(model.weights)
    open_nodes = [set(own) for own in model.below]
    if score:  # rows that end in an upper node are scored, too
        nodes = [(t, n) for t, own in model.grown for n, x in own.items() if x[0] < 0 and x[3] > 0]
    else:
        nodes = [(t, n) for t, own in enumerate(model.below) for n in own]
    nodes.sort()
    totals = np.array([model.upper[t][n][2:] for t, n in nodes], np.int64).reshape(-1, 2)
    grows = np.array([n in own for t, n in nodes for own in [open_nodes[t]]], bool)
    parts, row_bytes, sizes = int(spark.conf.get("spark.sql.shuffle.partitions")), n_features + 1, totals.sum(axis=1).tolist()
    shares = min(max(1, len(nodes)), max(8 * parts, -(-sum(sizes) * row_bytes // model.task_bytes)))
    tree, node = np.array([t for t, _ in nodes], np.int64), np.array([n for _, n in nodes], np.int64)
    given = spark.sparkContext.broadcast((_walks(model, nodes), tree, node, totals, _dealt(sizes, shares), grows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, share, grows = given.value[0], given.value[4], given.value[5]
        for chunk, (row, fold, y, x) in enumerate(_chunks(batches, n_features, CHUNK_ROWS)):
            drawn, chunk = {}, TaskContext.get().partitionId() << 32 | chunk
            for t, packed, own, first, k in walks:
                times = _drawn(drawn, row, fold, numbers[t], settings[t])
                for rides in (False, True) if score else (False,):
                    there = np.flatnonzero(fold == settings[t].without_fold if rides else times)
                    at = np.take(x, there, axis=0)
                    slot = (own if rides else np.where(grows[first + own], own, -1))[_leaf(at, *packed)]
                    order = np.argsort(slot.astype(np.int16) if k < 1 << 15 else slot, kind="stable")
                    order = order[np.searchsorted(slot[order], 0):]
                    if not len(order):
                        continue
                    slot, there = slot[order], there[order]
                    code = y[there].astype(np.uint8) if rides else times[there].astype(np.uint8) * 2 + y[there].astype(np.uint8)
                    rows = np.concatenate([code[:, None], at[order]], axis=1)
                    starts = np.flatnonzero(np.diff(slot, prepend=-1))
                    ends, found = [*starts[1:].tolist(), len(slot)], first + slot[starts]
                    yield pa.RecordBatch.from_pydict({
                        "share": pa.array(share[found], pa.int64()), "slot": pa.array(found, pa.int64()), "chunk": pa.array(np.full(len(found), chunk if rides else -1), pa.int64()),
                        "rows": pa.array([rows[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()),
                        "at": pa.array([there[a:b].astype("<u4").tobytes() if rides else b"" for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary())})

    def grow(table: pa.Table) -> pa.Table:
        _, tree, node, totals, *_ = given.value
        blobs, chunk = table.column("rows").to_pylist(), table.column("chunk").to_numpy()
        own, slot = np.unique(table.column("slot").to_numpy(), return_inverse=True)
        lengths = np.array([len(b) for b in blobs]) // row_bytes
        rows = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, row_bytes)
        code, x, ride, made = rows[:, 0].copy(), np.ascontiguousarray(rows[:, 1:]), None, []
        if score:
            place = np.zeros(len(rows), np.int64)
            from_chunk = np.repeat(chunk, lengths)
            ridden = np.flatnonzero(from_chunk >= 0)
            place[ridden] = np.frombuffer(b"".join(table.column("at").to_pylist()), "<u4")
            ride = np.full(len(rows), -1)
            ride[ridden] = ridden
        del rows, blobs
        first_code = code
        for found in _grown(node[own], tree[own], *totals[own].T, np.repeat(slot, lengths), code, x, ride, bins, rules, weights):
            if kind == "nodes" and found[0] is not None:
                made.append(found[0])
            elif kind == "gains" and found[0] is not None:
                key, where = np.unique(found[0][0] * (n_features + 1) + found[0][2] + 1, return_inverse=True)
                made.append((key, np.bincount(where, found[1], len(key))))
            elif score and found[2] is not None:
                high = found[2][2] > 0
                made.append(tuple(c[high] for c in found[2]))
        columns = [np.concatenate(c) for c in zip(*made, strict=True)]
        if kind == "nodes":
            return pa.table({k: pa.array(v, t) for k, v, t in zip(("tree", "node", "f", "b", "n0", "n1"), columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})
        if kind == "gains":
            key, where = np.unique(columns[0], return_inverse=True)
            gain, split = np.bincount(where, columns[1], len(key)), key % (n_features + 1) > 0
            return pa.table({"tree": pa.array(key[split] // (n_features + 1), pa.int32()), "f": pa.array(key[split] % (n_features + 1) - 1, pa.int32()), "gain": pa.array(gain[split])})
        rides, t, p = columns
        order = np.lexsort((t, from_chunk[rides]))
        rides, t, p = rides[order], t[order], p[order]
        own, at = from_chunk[rides], (place[rides] * 2 + (first_code[rides] & 1)).astype("<u4")
        starts = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0))
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(own)][:len(starts)], strict=True))
        return pa.table({"fit": pa.array(np.array(fit_of, np.int64)[t[starts]], pa.int32()), "chunk": pa.array(own[starts], pa.int64()), "tree": pa.array(t[starts], pa.int32()),
                         "at": pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), "p": pa.array([p[a:b].astype("<f8").tobytes() for a, b in spans], pa.binary())})

    sent = data.mapInArrow(send, "share long, slot long, chunk long, rows binary, at binary")
    tasks = min(shares, max(parts, -(-sum(sizes) * row_bytes // (4 * model.task_bytes))))
    return sent.repartition(tasks, "share").groupBy("share").applyInArrow(grow, MADE[kind])


def fold_sums(model: Forest, fits: list[int]) -> DataFrame:
    """For each fit that left out a fold (``fits``: their numbers, by group) and some rows of that fold, those that a tree
    gives a share of class 1 (``at``: 2 * place in the chunk + class) and the sum of these shares over the trees."""
    alike = {t: model.twin.count(t) for t in set(model.twin)}

    def add(table: pa.Table) -> pa.Table:
        at = [np.frombuffer(b, "<u4") for b in table.column("at").to_pylist()]
        shares = [np.frombuffer(b, "<f8") for b in table.column("p").to_pylist()]
        total, tree = np.zeros(max(int(a.max(initial=0)) for a in at) + 1), table.column("tree").to_numpy()
        for i in np.argsort(tree, kind="stable").tolist():  # a tree's pieces hold different rows
            for _ in range(alike[int(tree[i])]):
                total[at[i]] += shares[i]
        return _sums(fits[table.column("fit")[0].as_py()], table.column("chunk")[0].as_py(), total)

    return subtrees(model, "scores").groupBy("fit", "chunk").applyInArrow(add, SUMS)


SUMS = "fit int, chunk long, at binary, total binary"


def _sums(fit: int, chunk: int, total: np.ndarray) -> pa.Table:
    at = np.flatnonzero(total)
    return pa.table({"fit": pa.array([fit], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()),
                     "total": pa.array([total[at].astype("<f8").tobytes()], pa.binary())})


def sums_hits(sums: DataFrame, trees: list[int], threshold: float) -> dict[int, tuple[int, int]]:
    """For each fit (number: its trees) the left-out rows whose mean share is above the threshold, of class 1 and of class 0.
    sums: those of all of its trees, in any number of rows for a fit and chunk."""
    def count(table: pa.Table) -> pa.Table:
        fit, at = table.column("fit")[0].as_py(), [np.frombuffer(b, "<u4") for b in table.column("at").to_pylist()]
        total = np.zeros(max(int(a.max(initial=0)) for a in at) + 1)
        for a, b in zip(at, table.column("total").to_pylist(), strict=True):
            total[a] += np.frombuffer(b, "<f8")
        hit = np.flatnonzero(total / trees[fit] > threshold)
        return pa.table({"fit": pa.array([fit], pa.int32()), "tp": pa.array([int((hit & 1).sum())]), "fp": pa.array([int((1 - (hit & 1)).sum())])})

    found = sums.groupBy("fit", "chunk").applyInArrow(count, "fit int, tp long, fp long")
    return {r["fit"]: (r["tp"], r["fp"]) for r in found.groupBy("fit").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).collect()}


def _batches(fits: list[Settings], n_features: int, rows: int, most: int) -> list[list[tuple[int, Settings]]]:
    """The fits by number, in parts that grow about so many trees as send ``most`` bytes of packed rows, at least one; a
    fit of many trees is cut. Trees that are the same are one."""
    room, out, left = max(1, most // max(1, rows * (n_features + 5))), [[]], 0
    left = room
    for i, s in enumerate(fits):
        if not _differ(s, n_features):
            pieces = [(s, 1)]
        else:
            pieces, done = [], 0
            while done < s.trees:
                n = min(s.trees - done, (left if not pieces and left else room))
                pieces.append((replace(s, trees=n, first=done), n))
                done += n
        for piece, n in pieces:
            if n > left and out[-1]:
                out.append([])
                left = room
            out[-1].append((i, piece))
            left -= min(n, left)
    return out


def search(df: DataFrame, features, label: str, keys, candidates: list[Settings], fold: str, folds: int, bins: int = 32,
           threshold: float = 0.5, sent_bytes: int = SENT_BYTES, ready: Prepared | None = None) -> tuple[Forest, DataFrame]:
    """M3: candidates x folds in shared passes; F1 of class 1 on each left-out fold; the best refitted on all rows.

    Left-out rows ride along to the tasks that grow the subtrees. So many trees grow at once as send ``sent_bytes``; only the
    sums of their scores stay, so local disk doesn't grow with the trees. Returns the refitted forest and the leaderboard:
    candidate, mean_f1 (ties: the first candidate), then f1 of each fold."""
    fits = [replace(c, without_fold=k) for c in candidates for k in range(folds)]
    ready = ready or prepared(df, features, label, keys, fits[0].seed, bins, fold)
    batches, kept = _batches(fits, len(features), sum(ready.totals.values()), sent_bytes), []
    few_rows = _few_rows(df.sparkSession, ready, sum(s.trees if _differ(s, len(features)) else 1 for s in fits))
    for batch in batches:
        sums = fold_sums(fit(df, features, label, keys, [s for _, s in batch], bins, fold, few_rows, ready=ready), [i for i, _ in batch])
        if len(batches) > 1:
            kept.append(cut_lineage(sums))
            del sums
            _forget_shuffles(df.sparkSession)
        else:
            kept.append(sums)
    hits = sums_hits(reduce(DataFrame.unionByName, kept), [s.trees for s in fits], threshold)
    ones = {r["fold"]: r["n"] for r in ready.data.filter("y = 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    f1 = []
    for i in range(len(fits)):
        tp, fp = hits.get(i, (0, 0))
        d = tp + fp + ones.get(i % folds, 0)  # 2 tp + fp + fn
        f1.append(2 * tp / d if d else 0.0)
    rows = [(i, sum(own) / folds, own) for i in range(len(candidates)) for own in [f1[i * folds:(i + 1) * folds]]]
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    board = df.sparkSession.createDataFrame(rows, "candidate int, mean_f1 double, fold_f1 array<double>").orderBy(F.desc("mean_f1"), "candidate")
    return fit(df, features, label, keys, candidates[best], bins, fold, ready=ready), board
