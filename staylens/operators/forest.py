"""Regression forests over many rows (E2, E8), as MLlib grows them, in less memory and time.

MLlib keeps some 2 kB of every training row for 100 trees, which no longer fit the executors' memory on large tables and
are read from disk for each level.  Here a row is its label and one byte per feature (the bin of its value), and
what a tree draws of it is drawn again in each pass.  A pass over the rows gives the (count, sum) histograms of
all nodes of a level, each over its own subset of features, as array operations per tree; they are added up and the best
splits found per tree by one grouped step.  The driver holds the trees alone.

The rules are MLlib's: candidate splits from a sample of max(maxBins^2, 10,000) rows, Poisson bootstrap weights, a
random subset of features for each node, variance gain, and the same stopping rules.  The random numbers are others.
The result is an MLlib model, loaded from nodes written in its own format.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from staylens.session import default_parallelism, delete_path, held_setting, scratch_path, ship_package, size_parts, written

#: Training rows from which on forests are grown here; MLlib keeps fewer rows in memory.
MANY_ROWS = 1 << 18
#: Rows that array operations take at once.
CHUNK_ROWS = 1 << 15
#: Bytes of histograms that one task holds; trees beyond that wait for another pass.
PASS_BYTES = 256 << 20
#: Chunks in an Arrow batch, which would else hold all those of a task, once in the JVM and once in Python.
BATCH_CHUNKS = 8
#: Deeper trees are left to MLlib: their last levels have a node for every few rows.
MAX_DEPTH = 12
#: Bits of the random number behind a bootstrap weight.
BITS = 20

SUBSETS = {"all": lambda d: d, "onethird": lambda d: math.ceil(d / 3), "sqrt": lambda d: math.ceil(math.sqrt(d)),
           "log2": lambda d: max(1, math.ceil(math.log2(d)))}
SUBSETS["auto"] = SUBSETS["onethird"]


def grows(est: RandomForestRegressor) -> bool:
    """Whether ``grow`` knows all parameters of ``est``."""
    get = est.getOrDefault
    return (est.getNumTrees() > 1 and get("bootstrap") and get("subsamplingRate") == 1.0 and get("impurity") == "variance"
            and get("minWeightFractionPerNode") == 0.0 and est.getMaxDepth() <= MAX_DEPTH and est.getMaxBins() <= 256
            and est.getFeatureSubsetStrategy() in SUBSETS and not est.isDefined("weightCol"))


def candidate_splits(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of one feature: between all distinct values, or, if they are too many, where the counts come closest
    to equal shares."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < max_bins:
        return between
    stride = counts.sum() / max_bins
    out, seen, target = [], counts[0], stride
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out[:max_bins - 1])


def binned(splits: Sequence[np.ndarray]):
    """Rows (label, features...) as chunks (chunk, rows, y, x): labels, and the bins of the features row by row."""
    def chunk(cid: int, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([cid], pa.int64()), "rows": pa.array([len(y)], pa.int32()),
                                           "y": pa.array([y.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        cid = TaskContext.get().partitionId() << 32
        y, x = np.empty(CHUNK_ROWS), np.empty((CHUNK_ROWS, len(splits)), np.uint8)
        held = 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, CHUNK_ROWS - held)
                to = slice(held, held + b.num_rows)
                y[to] = b.column(0).to_numpy(zero_copy_only=False)
                fine = np.isfinite(y[to]).all()
                for f, s in enumerate(splits):
                    v = b.column(f + 1).to_numpy(zero_copy_only=False)
                    fine &= np.isfinite(v).all()
                    x[to, f] = np.searchsorted(s, v, side="left")
                if not fine:  # MLlib refuses these, too
                    raise ValueError("labels and features must not be NaN or infinite")
                at, held = at + b.num_rows, held + b.num_rows
                if held == CHUNK_ROWS:
                    yield chunk(cid, y, x)
                    cid, held = cid + 1, 0
        if held:
            yield chunk(cid, y[:held], x[:held])
    return run


def poisson_table() -> np.ndarray:
    """The Poisson(1) draw of each number of ``BITS`` bits."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cdf, (np.arange(1 << BITS) + 0.5) / (1 << BITS), side="right").astype(np.uint8)


def weights(table: np.ndarray, seed: int, tree: int, chunk: int, rows: int) -> np.ndarray:
    """How often each row of a chunk is in a tree's bootstrap sample: the same in every pass."""
    rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, tree, chunk])
    return table.take(rng.integers(0, 1 << 32, rows, np.uint32) >> np.uint32(32 - BITS))


class Tree:
    """A tree as it grows.  A node without children points to itself, by a split that no bin passes; ``active``
    nodes are those of the last level.  The histograms of the j-th features of all active nodes make block j."""

    def __init__(self):
        self.feature, self.bin, self.left = np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(1, np.int32)
        self.stats, self.gain = np.zeros((1, 3)), np.full(1, -1.0)
        self.active = np.zeros(1, np.int64)

    def open_level(self, subset: np.ndarray, bins: np.ndarray) -> None:
        """Lay out the histograms of the active nodes; ``subset`` (active nodes x k) are their features."""
        self.slot = np.full(len(self.feature), -1, np.int32)
        self.slot[self.active] = np.arange(len(self.active), dtype=np.int32)
        self.subset = np.ascontiguousarray(subset.T, dtype=np.int32)
        width = bins[self.subset]
        self.start = (np.cumsum(width, axis=1) - width).astype(np.int32)
        self.cells = width.sum(axis=1)

    def bytes(self) -> int:
        return 16 * int(self.cells.sum()) + 24 * len(self.active)

    def close_level(self, stats: np.ndarray, feature: np.ndarray, bin_: np.ndarray, gain: np.ndarray, least: float) -> None:
        """Take in the sums and best splits of the active nodes; their children are the next ones."""
        self.stats[self.active] = stats
        mean = stats[:, 1] / np.maximum(stats[:, 0], 1)
        split = np.flatnonzero((gain >= least) & (gain > 1e-24 * mean * mean))  # less is rounding
        at, old = self.active[split], len(self.feature)
        self.feature[at], self.bin[at], self.gain[at] = feature[split], bin_[split], gain[split]
        self.left[at] = old + 2 * np.arange(len(at))
        self.active = np.arange(old, old + 2 * len(at))
        self.feature = np.concatenate([self.feature, np.zeros(len(self.active), np.int32)])
        self.bin = np.concatenate([self.bin, np.full(len(self.active), 255, np.uint8)])
        self.left = np.concatenate([self.left, self.active.astype(np.int32)])
        self.stats = np.concatenate([self.stats, np.zeros((len(self.active), 3))])
        self.gain = np.concatenate([self.gain, np.full(len(self.active), -1.0)])


def node_of(tree: Tree, level: int, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The node that each row has come to after ``level`` splits; ``base`` is where its bins begin."""
    node = np.zeros(len(base), np.int32)
    for _ in range(level):
        node = tree.left.take(node) + (flat.take(base + tree.feature.take(node)) > tree.bin.take(node))
    return node


def histograms(trees: dict[int, Tree], level: int, features: int, seed: int):
    """Chunks to one row per tree (tree, part, sums): sums of nodes (3 x active), then counts and sums of all cells."""
    def run(batches: Iterator[pa.RecordBatch]):
        table, part = poisson_table(), None
        total = {t: [np.zeros((3, len(tree.active))), [np.zeros((2, c)) for c in tree.cells]] for t, tree in trees.items()}
        for batch in batches:
            for cid, rows, y, x in zip(*(batch.column(i) for i in range(4))):
                cid, rows = cid.as_py(), rows.as_py()
                part = cid if part is None else min(part, cid)
                y, flat = np.frombuffer(y.as_buffer(), np.float64), np.frombuffer(x.as_buffer(), np.uint8)
                begin = np.arange(rows, dtype=np.int32 if rows * features < 1 << 31 else np.int64) * features
                for t, tree in trees.items():
                    w = weights(table, seed, t, cid, rows)
                    at = np.flatnonzero(w)
                    base = begin.take(at)
                    slot = tree.slot.take(node_of(tree, level, flat, base))
                    if slot.size and slot.min() < 0:
                        kept = np.flatnonzero(slot >= 0)
                        at, base, slot = at.take(kept), base.take(kept), slot.take(kept)
                    if not slot.size:
                        continue
                    n, v = w.take(at).astype(np.float64), y.take(at)
                    s = n * v
                    nodes, blocks = total[t]
                    for row, what in zip(nodes, (n, s, s * v)):
                        row += np.bincount(slot, what, len(row))
                    for block, subset, start in zip(blocks, tree.subset, tree.start):
                        cell = start.take(slot) + flat.take(base + subset.take(slot))
                        block[0] += np.bincount(cell, n, block.shape[1])
                        block[1] += np.bincount(cell, s, block.shape[1])
        if part is not None:
            for t in trees:
                nodes, blocks = total.pop(t)
                sums = np.concatenate([nodes.ravel(), *(b.ravel() for b in blocks)])
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "part": pa.array([part], pa.int64()),
                                                  "sums": pa.array([sums.tobytes()], pa.binary())})
    return run


def best_splits(trees: dict[int, Tree], bins: np.ndarray, least_rows: int):
    """Rows (tree, part, sums), those of a tree together, to one row per tree (tree, stats, feature, bin, gain) of its
    active nodes; gain -1: no split."""
    def best(t: int, sums: np.ndarray) -> pa.RecordBatch:
        tree = trees[t]
        a, k = len(tree.active), len(tree.subset)
        stats = sums[:3 * a].reshape(3, a).T
        gains = np.full((a, k, max(1, int(bins.max()) - 1)), -1.0)
        at = 3 * a
        for j in range(k):
            block = sums[at:at + 2 * tree.cells[j]].reshape(2, -1)
            at += block.size
            width = bins[tree.subset[j]]
            row = np.repeat(np.arange(a), width)
            cell = np.arange(block.shape[1]) - tree.start[j].take(row)
            padded = np.zeros((2, a, gains.shape[2] + 1))
            padded[:, row, cell] = block
            n, s = np.cumsum(padded, axis=2)
            all_n, all_s = n[:, -1:], s[:, -1:]
            nl, sl = n[:, :-1], s[:, :-1]
            nr, sr = all_n - nl, all_s - sl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = nl * nr / (all_n * all_n) * (sl / nl - sr / nr) ** 2
            fits = (nl >= least_rows) & (nr >= least_rows) & (np.arange(gains.shape[2]) < width[:, None] - 1)
            gains[:, j] = np.where(fits, gain, -1.0)
        best = gains.reshape(a, -1).argmax(axis=1) if k else np.zeros(a, np.int64)
        j, b = best // gains.shape[2], best % gains.shape[2]
        feature = tree.subset[j, np.arange(a)] if k else np.zeros(a, np.int32)
        gain = gains[np.arange(a), j, b] if k else np.full(a, -1.0)
        out = (stats, feature.astype(np.int32), b.astype(np.uint8), gain)
        return pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32())} | {
            name: pa.array([v.tobytes()], pa.binary()) for name, v in zip(("stats", "feature", "bin", "gain"), out)})

    def run(batches: Iterator[pa.RecordBatch]):
        held, total = None, None
        for batch in batches:
            for t, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
                sums = np.frombuffer(sums.as_buffer(), np.float64)
                if t == held:
                    total += sums
                    continue
                if held is not None:
                    yield best(held, total)
                held, total = t, sums.copy()
        if held is not None:
            yield best(held, total)
    return run


def grow_level(chunks: DataFrame, trees: dict[int, Tree], level: int, bins: np.ndarray, est: RandomForestRegressor, last: bool) -> None:
    """One level of all trees, in as many passes as their histograms need."""
    features, seed = len(bins), int(est.getSeed())
    k = 0 if last else SUBSETS[est.getFeatureSubsetStrategy()](features)
    groups, room = [], 0
    for t, tree in trees.items():
        if not len(tree.active):
            continue
        if 0 < k < features:
            rng = np.random.default_rng([seed & 0xFFFFFFFFFFFFFFFF, t, level, 1])
            subset = np.sort(np.argsort(rng.random((len(tree.active), features)), axis=1)[:, :k], axis=1)
        else:
            subset = np.tile(np.arange(k), (len(tree.active), 1))
        tree.open_level(subset, bins)
        if not groups or tree.bytes() > room:
            groups.append({})
            room = PASS_BYTES
        groups[-1][t] = tree
        room -= tree.bytes()
    for group in groups:
        sums = chunks.mapInArrow(histograms(group, level, features, seed), "tree int, part long, sums binary")
        found = sums.repartition(min(len(group), 4 * default_parallelism(chunks.sparkSession)), "tree").sortWithinPartitions("tree", "part").mapInArrow(
            best_splits(group, bins, est.getMinInstancesPerNode()), "tree int, stats binary, feature binary, bin binary, gain binary")
        for r in found.collect():  # one row per tree, of its nodes at this level
            tree = group[r["tree"]]
            tree.close_level(np.frombuffer(r["stats"], np.float64).reshape(-1, 3), np.frombuffer(r["feature"], np.int32),
                             np.frombuffer(r["bin"], np.uint8), np.frombuffer(r["gain"], np.float64), est.getMinInfoGain())


def grow(rows: DataFrame, n: int, est: RandomForestRegressor) -> RandomForestRegressionModel:
    """The forest of ``est`` over ``rows`` (label, then the features, all doubles), ``n`` in number."""
    spark, features = rows.sparkSession, rows.columns[1:]
    ship_package(spark)
    wanted = max(est.getMaxBins() ** 2, 10000)
    sample = rows.sample(False, wanted / n, int(est.getSeed())) if wanted < n else rows
    drawn = sample.select(*features).toArrow()  # the splits' sample: bounded by maxBins
    splits = [candidate_splits(drawn[f].to_numpy(), est.getMaxBins()) for f in features]
    bins = np.array([len(s) + 1 for s in splits])
    # Tasks of a fourth of the bytes that one may hold, as the bins are copied on their way to Python.  Not compressed,
    # lest a reader of many files get far more bytes than they have.
    parts = max(4 * default_parallelism(spark), 4 * size_parts(n, len(features) + 8))
    dealt = rows.repartition(parts).mapInArrow(binned(splits), "chunk long, rows int, y binary, x binary")
    chunks, path = written(dealt, "forest-rows", compression="uncompressed")
    try:
        trees = {t: Tree() for t in range(est.getNumTrees())}
        with held_setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_CHUNKS)):
            for level in range(est.getMaxDepth() + 1):
                grow_level(chunks, trees, level, bins, est, level == est.getMaxDepth())
    finally:
        delete_path(spark, path)
    return model_of(spark, est, trees, splits)


# ----------------------------------------------------------------------------- the MLlib model

TREE_PARAMS = ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
               "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")
NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                  ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                  ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                                       ("numCategories", pa.int32())]))])


def nodes_of(tree: Tree, splits: Sequence[np.ndarray]) -> list[dict]:
    """A tree's nodes as MLlib stores them; children come after their parents."""
    out = []
    for i, ((n, s, q), gain, left) in enumerate(zip(tree.stats.tolist(), tree.gain.tolist(), tree.left.tolist())):
        inner = left != i
        f, b = int(tree.feature[i]), int(tree.bin[i])
        out.append({"id": i, "prediction": s / n, "impurity": max(0.0, (q - s * s / n) / n), "impurityStats": [n, s, q], "rawCount": int(n),
                    "gain": gain if inner else -1.0, "leftChild": left if inner else -1, "rightChild": left + 1 if inner else -1,
                    "split": {"featureIndex": f if inner else -1, "leftCategoriesOrThreshold": [float(splits[f][b])] if inner else [],
                              "numCategories": -1}})
    return out


def model_of(spark: SparkSession, est: RandomForestRegressor, trees: dict[int, Tree], splits: Sequence[np.ndarray]) -> RandomForestRegressionModel:
    """The MLlib model of grown trees, by way of MLlib's own files."""
    given = {p.name: v for p, v in est._paramMap.items()}
    default = {p.name: v for p, v in est._defaultParamMap.items()}

    def metadata(kind: str, uid: str, names, **extra) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": {k: v for k, v in given.items() if k in names},
                           "defaultParamMap": {k: v for k, v in default.items() if k in names}, **extra})

    path = scratch_path(spark, "forest")
    of_trees = [(t, metadata("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", TREE_PARAMS), 1.0) for t in trees]
    nodes = [(t, node) for t, tree in trees.items() for node in nodes_of(tree, splits)]
    data = pa.table({"treeID": pa.array([t for t, _ in nodes], pa.int32()), "nodeData": pa.array([node for _, node in nodes], NODE)})
    whole = metadata("RandomForestRegressionModel", est.uid, given.keys() | default.keys(), numFeatures=len(splits), numTrees=len(trees))
    try:
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(of_trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(data).coalesce(1).write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)
    finally:
        delete_path(spark, path)
