"""A Gini decision tree grown level by level with one aggregation a level.

A row holds its features in one array: the indices that are present (counts, cut at 0.5)
or all values (vectors, cut at the node's median).  A node looks at most at FEATURES
features, drawn by md5(seed:node:feature), so a tree doesn't depend on row order.  The rows
never move: a row's node is an expression over its array, and only counts by (node,
feature, class) are shuffled and collected, at most 2 ** depth x FEATURES x classes rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.quantiles import medians

DEPTH, MIN_SPLIT, FEATURES, CLASSES = 6, 5, 60, 3


@dataclass
class Tree:
    """splits: node to (feature, threshold); its children are 2 * node + 1 (not above the
    threshold) and 2 * node + 2.  leaves: node to class."""

    features: str
    sparse: bool
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)

    def _walk(self, node: int, end) -> Column:
        if node not in self.splits:
            return F.lit(end(node))
        f, cut = self.splits[node]
        above = F.array_contains(self.features, F.lit(f)) if self.sparse else F.get(self.features, F.lit(f)) > cut
        return F.when(F.coalesce(above, F.lit(False)), self._walk(2 * node + 2, end)).otherwise(self._walk(2 * node + 1, end))

    def node(self) -> Column:
        return self._walk(0, lambda n: n)

    def pred(self) -> Column:
        """The class of a row's leaf."""
        return self._walk(0, lambda n: self.leaves.get(n, 0))

    def table(self, spark) -> DataFrame:
        """(node, feature, threshold, class): one row a node."""
        rows = [(n, f, float(c), None) for n, (f, c) in self.splits.items()] + [(n, None, None, c) for n, c in self.leaves.items()]
        return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "node int, feature int, threshold double, class int")


def drawn(node: int, n: int, k: int = FEATURES, seed: int = 42) -> list[int]:
    """The features that a node looks at."""
    if n <= k:
        return list(range(n))
    return sorted(range(n), key=lambda f: (hashlib.md5(f"{seed}:{node}:{f}".encode()).hexdigest(), f))[:k]


def gini(counts: list[int]) -> float:
    n = sum(counts)
    return 1.0 - sum((c / n) * (c / n) for c in counts) if n else 0.0


def fit(df: DataFrame, features: str, n_features: int, sparse: bool, y: str = "y", depth: int = DEPTH, min_split: int = MIN_SPLIT, k: int = FEATURES, seed: int = 42) -> Tree:
    """df(y in 0 .. 2, features: array<int> of present indices, or array<double>).  A split needs
    min_split rows, both sides and a positive gain; ties go to the smaller feature."""
    tree = Tree(features, sparse)
    spark = df.sparkSession
    rows = df.select(F.col(y).cast("int").alias("y"), features)
    open_ = {0}
    for level in range(depth + 1):
        now = rows.select("y", features, tree.node().alias("node")).where(F.col("node").isin(sorted(open_)))
        totals: dict[int, list[int]] = {n: [0] * CLASSES for n in open_}
        for r in now.groupBy("node", "y").agg(F.count("*").alias("n")).collect():  # nodes x classes
            totals[r.node][r.y] = r.n
        for n, c in totals.items():
            tree.leaves[n] = c.index(max(c))
        grow = {n for n, c in totals.items() if level < depth and sum(c) >= min_split and max(c) < sum(c)}
        if not grow:
            break
        looks = F.broadcast(spark.createDataFrame([(n, f) for n in sorted(grow) for f in drawn(n, n_features, k, seed)], "node int, f int"))  # nodes x k rows
        if sparse:
            on = now.select("node", "y", F.explode(features).alias("f")).join(looks, ["node", "f"]).withColumn("cut", F.lit(0.5))
        else:
            each = now.select("node", "y", F.posexplode(features).alias("f", "x")).join(looks, ["node", "f"])
            cuts = F.broadcast(medians(each, ["node", "f"], "x", "cut").select("node", "f", "cut"))  # nodes x k rows
            on = each.join(cuts, ["node", "f"]).where(F.col("x") > F.col("cut"))
        right: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for r in on.groupBy("node", "f", "y").agg(F.count("*").alias("n"), F.first("cut").alias("cut")).collect():  # nodes x k x classes
            right.setdefault((r.node, r.f), (r.cut, [0] * CLASSES))[1][r.y] = r.n
        best: dict[int, tuple[float, int, float]] = {}
        for (n, f), (cut, up) in sorted(right.items()):
            all_ = totals[n]
            down = [a - b for a, b in zip(all_, up)]
            size = sum(all_)
            gain = round(gini(all_) - (sum(down) / size * gini(down) + sum(up) / size * gini(up)), 12)
            if sum(down) and gain > best.get(n, (0.0,))[0]:
                best[n] = (gain, f, cut)
        for n, (_, f, cut) in best.items():
            tree.splits[n] = (f, cut)
            tree.leaves.pop(n)
        open_ = {c for n in best for c in (2 * n + 1, 2 * n + 2)}
        if not open_:
            break
    return tree
