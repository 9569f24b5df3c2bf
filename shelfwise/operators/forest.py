"""Random forests for regression, grown from the root by all tasks together and below that node by node.

Features are cut into bins, and rows of equal bins count together. Near the root each part of the rows adds up
labels by node and bin, tree after tree, and the sums of all parts give a level's splits. Where a node has few
enough rows, these are dealt by tree and node, and one task grows all that is below. So rows of equal bins go
through the shuffle once for each tree that draws some, and sums of the many deep nodes never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import written
from .quantiles import quantiles

#: Rows of a node that one task may hold, and rows that a task adds up at a time.
LOCAL, PART = 1 << 18, 1_000_000

#: What a split (or a root without one) is told by; values are means, the leaves' come with the split above them.
_FOUND = ["node", "feature", "cut", "rows", "value", "left_rows", "left_value", "right_value"]
_NODES = "node int, feature int, cut int, rows double, value double, left_rows double, left_value double, right_value double, tree int"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times() -> np.ndarray:
    """How often a row is drawn, by 16 bits of its number: Poisson with mean 1."""
    chance = np.exp(-1) / np.cumprod([1, *range(1, 12)])
    return np.searchsorted(np.cumsum(chance), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_TIMES = _times()


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row; this hangs on seed, tree and the row's key alone."""
    with np.errstate(over="ignore"):
        own = _mixed(np.array([(seed << 32) + tree + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        return _TIMES.take((_mixed(keys ^ own) >> np.uint64(48)).astype(np.intp))


def _codes(columns: list[np.ndarray], borders: list[np.ndarray]) -> np.ndarray:
    """The bins of each feature, a row each; a border belongs to the bin below it."""
    return np.stack([np.searchsorted(b, c, side="left").astype(np.uint8) for c, b in zip(columns, borders)])


def _sums(codes: np.ndarray, at: np.ndarray, nodes: int, weights: np.ndarray, labels: np.ndarray, bins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of draws and of drawn labels by node, a row each, and by bin of all features in turn."""
    counts, sums = (np.empty((nodes, sum(bins))) for _ in range(2))
    first = 0
    for code, b in zip(codes, bins):
        cell = at * b + code
        for out, x in ((counts, weights), (sums, labels)):
            out[:, first : first + b] = np.bincount(cell, x, nodes * b).reshape(nodes, b)
        first += b
    return counts, sums


def _splits(nodes: np.ndarray, counts: np.ndarray, sums: np.ndarray, bins: list[int], least: int) -> pd.DataFrame:
    """Each node's best split: its feature and the last bin that goes left; feature -1 where none lessens variance."""
    rows, total = counts[:, : bins[0]].sum(axis=1), sums[:, : bins[0]].sum(axis=1)
    whole = total**2 / np.maximum(rows, 1)
    # smaller differences come of rounding: of features as good the first counts
    tiny, me = whole * 1e-12, np.arange(len(rows))
    best = np.zeros(len(rows))
    feature, cut, left, left_total = np.full(len(rows), -1), np.zeros(len(rows), int), np.zeros(len(rows)), np.zeros(len(rows))
    first = 0
    for f, b in enumerate(bins):
        if b > 1:
            n, s = counts[:, first : first + b - 1].cumsum(axis=1), sums[:, first : first + b - 1].cumsum(axis=1)
            m = rows[:, None] - n
            gain = s**2 / np.maximum(n, 1) + (total[:, None] - s) ** 2 / np.maximum(m, 1) - whole[:, None]
            gain[(n < least) | (m < least)] = -np.inf
            j = gain.argmax(axis=1)
            better = gain[me, j] > best * (1 + 1e-9) + tiny
            best[better], feature[better], cut[better], left[better], left_total[better] = gain[me, j][better], f, j[better], n[me, j][better], s[me, j][better]
        first += b
    mean = lambda s, n: s / np.maximum(n, 1)
    return pd.DataFrame(dict(zip(_FOUND, [nodes, feature, cut, rows, mean(total, rows), left, mean(left_total, left), mean(total - left_total, rows - left)])))


def _below(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, root: int, levels: int, bins: list[int], least: int) -> pd.DataFrame:
    """The splits from ``root`` down, ``levels`` deep at most; the nodes below node i are 2 i and 2 i + 1."""
    at, nodes, out = np.zeros(len(labels), np.intp), np.array([root]), []
    weights = weights.astype(float)
    for level in range(levels):
        found = _splits(nodes, *_sums(codes, at, len(nodes), weights, labels, bins), bins, least)
        feature, cut = found["feature"].to_numpy(), found["cut"].to_numpy()
        split = feature >= 0
        out.append(found if not level else found[split])
        if not split.any() or level == levels - 1:
            break
        kept = split[at]
        if not kept.all():
            codes, at, weights, labels = codes[:, kept], at[kept], weights[kept], labels[kept]
        right = codes[feature[at], np.arange(len(at))] > cut[at]
        at = 2 * (np.cumsum(split) - 1)[at] + right
        nodes = np.column_stack([2 * nodes[split], 2 * nodes[split] + 1]).ravel()
    return pd.concat(out)


def _walk(feature: np.ndarray, cut: np.ndarray, codes: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row reaches in a tree after ``levels`` splits at most."""
    n = codes.shape[1]
    at, me, flat = np.ones(n, np.intp), np.arange(n), codes.ravel()
    for _ in range(levels):
        f = feature.take(at).astype(np.intp)
        inner = f >= 0
        if not inner.any():
            break
        right = flat.take(np.where(inner, f, 0) * n + me) > cut.take(at)
        at = np.where(inner, 2 * at + right, at)
    return at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, labels and bins of some million rows at a time."""
    held: list = []

    def joined():
        t = pa.Table.from_batches(held)
        key, y, *codes = (c.to_numpy() for c in t.columns)
        return key.view(np.uint64), y, np.stack([c.view(np.uint8) for c in codes])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PART:
            yield joined()
            held.clear()
    if sum(b.num_rows for b in held):
        yield joined()


class RandomForestRegressor:
    """Parameters are named as MLlib's; one tree takes all rows, several draw theirs with replacement."""

    def __init__(self, numTrees: int, maxDepth: int, minInstancesPerNode: int, inputCols: list[str], labelCol: str, predictionCol: str = "prediction", maxBins: int = 32, seed: int = 42):
        if not 2 <= maxBins <= 127 or maxDepth < 1:
            raise ValueError("maxBins is from 2 to 127, maxDepth 1 at least")
        self.trees, self.depth, self.least, self.features = numTrees, maxDepth, max(1, minInstancesPerNode), list(inputCols)
        self.label, self.prediction, self.bins, self.seed = labelCol, predictionCol, maxBins, seed

    def _borders(self, rows: DataFrame) -> list[np.ndarray]:
        """Middles between values where a feature has few, else quantiles."""
        few = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in self.features]).first()
        few = [c for c in self.features if few[c] <= 2 * self.bins]
        sets = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
        values = {c: np.sort(np.array(sets[c], float)) for c in few}
        wide = [c for c in self.features if c not in values or len(values[c]) > self.bins]
        found = {r["column"]: r["q"] for r in quantiles(rows, wide, [i / self.bins for i in range(1, self.bins)]).collect()} if wide else {}
        return [np.unique(np.array(found[c], float)) if c in found else (values[c][1:] + values[c][:-1]) / 2 for c in self.features]

    def fit(self, df: DataFrame) -> Forest:
        """The forest of rows without nulls; rows that are equal in all columns draw alike."""
        rows = written(df.select(F.xxhash64(*df.columns).alias("_key"), F.col(self.label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in self.features]))
        spark, (n, middle) = df.sparkSession, rows.agg(F.count("*"), F.avg("_y")).first()
        if not n:
            raise ValueError("a forest needs rows")
        borders = self._borders(rows)
        bins = [len(b) + 1 for b in borders]
        trees, least, seed, depth = self.trees, self.least, self.seed, self.depth
        codes_of = [f"_{i}" for i in range(len(bins))]

        def code(batches):
            for b in batches:
                key, y, *columns = (c.to_numpy() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(y - middle), *[pa.array(c.view(np.int8)) for c in _codes(columns, borders)]], ["_key", "_y", *codes_of])

        coded = rows.mapInArrow(code, ", ".join(["_key long, _y double", *[f"{c} tinyint" for c in codes_of]]))
        parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // PART))
        # equal bins side by side, in one order, as sums of labels hang on it in their last digits
        order = [*codes_of, "_key"]
        coded = written(coded.repartitionByRange(parts, *order).sortWithinPartitions(*order))

        size = 2 << depth
        feature, cut, value = np.full((trees, size), -1, np.int8), np.zeros((trees, size), np.int8), np.zeros((trees, size))
        drawn = lambda key, t: draws(key, seed, t) if trees > 1 else np.ones(len(key), np.uint8)
        # nodes of a level that all tasks grow, and those that one task does: numbers by tree
        open_ = {t: [1] for t in range(trees)} if n > LOCAL else {}
        small = {} if open_ else {t: [1] for t in range(trees)}

        def keep(found: pd.DataFrame) -> None:
            tree, node = found["tree"].to_numpy(), found["node"].to_numpy()
            feature[tree, node], cut[tree, node], value[tree, node] = found["feature"], found["cut"], found["value"] + middle
            inner = found[found["feature"] >= 0]
            tree, node = inner["tree"].to_numpy(), inner["node"].to_numpy()
            value[tree, 2 * node], value[tree, 2 * node + 1] = inner["left_value"] + middle, inner["right_value"] + middle

        def reached(batches, shared, levels):
            """By part and tree: the bins that have drawn rows in its nodes, sums of labels, draws and place among the nodes."""
            of, features, cuts = shared.value
            for i, (key, y, codes) in enumerate(_chunks(batches)):
                part = (TaskContext.get().partitionId() << 20) + i
                starts = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
                codes = codes[:, starts]
                for t, nodes in of.items():
                    w = drawn(key, t)
                    n, s = np.add.reduceat(w, starts, dtype=np.uint32), np.add.reduceat(w * y, starts)
                    some = np.flatnonzero(n)
                    c = codes[:, some]
                    place = np.full(2 << levels, -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[_walk(features[t], cuts[t], c, levels)]
                    here = at >= 0
                    yield part, t, nodes, c[:, here], s[some][here], n[some][here], at[here]

        def level_sums(shared, levels):
            def run(batches):
                for part, t, nodes, c, s, n, at in reached(batches, shared, levels):
                    counts, sums = _sums(c, at, len(nodes), n, s, bins)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "part": pa.array([part]), "counts": [counts.tobytes()], "sums": [sums.tobytes()]})

            return run

        def dealt(shared, levels):
            def run(batches):
                for part, t, nodes, c, s, n, at in reached(batches, shared, levels):
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], np.arange(len(nodes) + 1))
                    own = [order[a:b] for a, b in zip(ends, ends[1:])]
                    columns = {"codes": [c[:, o].tobytes() for o in own], "labels": [s[o].tobytes() for o in own], "draws": [n[o].tobytes() for o in own]}
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "part": pa.array([part] * len(nodes)), **columns})

            return run

        def grown(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            return _splits(np.array(open_[t]), sum_of(pdf, "counts"), sum_of(pdf, "sums"), bins, least).assign(tree=t)

        def sum_of(pdf, c):
            return sum(np.frombuffer(x) for x in pdf.sort_values("part")[c]).reshape(-1, sum(bins))

        def grown_below(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            t, root = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            codes = np.concatenate([np.frombuffer(x, np.uint8).reshape(len(bins), -1) for x in pdf["codes"]], axis=1)
            labels, weights = (np.concatenate([np.frombuffer(x, k) for x in pdf[c]]) for c, k in (("labels", float), ("draws", np.uint32)))
            return _below(codes, labels, weights, root, depth + 1 - root.bit_length(), bins, least).assign(tree=t)

        levels = 0
        while open_:
            # the splits so far, a few for each tree
            shared = spark.sparkContext.broadcast((open_, feature[:, : 2 << levels].copy(), cut[:, : 2 << levels].copy()))
            sums = coded.mapInArrow(level_sums(shared, levels), "tree int, part long, counts binary, sums binary")
            found = sums.groupBy("tree").applyInPandas(grown, _NODES).toPandas().sort_values(["tree", "node"])
            keep(found)
            levels, open_ = levels + 1, {}
            if levels < depth:
                for r in found[found["feature"] >= 0].itertuples():
                    for node, n in ((2 * r.node, r.left_rows), (2 * r.node + 1, r.rows - r.left_rows)):
                        (open_ if n > LOCAL else small).setdefault(r.tree, []).append(node)
        if small:
            shared = spark.sparkContext.broadcast((small, feature[:, : 2 << levels].copy(), cut[:, : 2 << levels].copy()))
            rows_of = coded.mapInArrow(dealt(shared, levels), "tree int, node int, part long, codes binary, labels binary, draws binary")
            groups = sum(map(len, small.values()))
            tasks = min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 16))
            keep(rows_of.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(grown_below, _NODES).toPandas())
        return Forest(spark, self.features, self.prediction, borders, feature, cut, value, depth)


class Forest:
    """Splits and values of all trees by the nodes' numbers: its size hangs on trees and depth alone."""

    def __init__(self, spark, features, prediction, borders, feature, cut, value, depth):
        self.features, self.prediction = features, prediction
        self.shared = spark.sparkContext.broadcast((borders, feature, cut, value, depth))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the mean of the trees' values."""
        shared = self.shared

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            borders, feature, cut, value, depth = shared.value
            codes = _codes([c.to_numpy(float) for c in columns], borders)
            total = np.zeros(codes.shape[1])
            for f, c, v in zip(feature, cut, value):
                total += v.take(_walk(f, c, codes, depth))
            return pd.Series(total / len(value))

        return df.withColumn(self.prediction, predicted(*[F.col(c).cast("double") for c in self.features]))
