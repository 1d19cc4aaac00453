"""Gradient boosting on histograms for a squared error: quantile bins, leaf-wise trees, all hold-out models in one pass.

Every pass over the rows is one aggregation of residuals by model, node, feature and bin; only these sums, whose number
depends on models, leaves, features and bins alone, reach the driver. A pass measures the left children of all leaves that
could be split next; right ones are the rest of their parents. So a tree of any number of leaves takes about as many
passes as it is deep.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import null_safe_join
from ..functions.tables import cut


@dataclass
class Node:
    """A node and what is known of it; path: (feature, bin, True where bins up to it go on to this node)."""

    path: list[tuple[int, int, bool]]
    sums: np.ndarray | None = None  # feature x (residuals, rows) x bin
    split: tuple[float, int, int] | None = None  # gain, feature, last bin of the left side
    children: list[Node] = field(default_factory=list)
    value: float = 0.0


def best_split(sums: np.ndarray, least: int, penalty: float) -> tuple[float, int, int] | None:
    """The split of the largest gain; the first feature and bin of equals. None where no split has `least` rows on both sides and a gain."""
    left = np.cumsum(sums, 2)[:, :, :-1].transpose(1, 0, 2)
    whole = sums[0].sum(1)
    right = whole[:, None, None] - left
    score = lambda s: s[0] ** 2 / (s[1] + penalty)
    gain = np.where((left[1] >= least) & (right[1] >= least), score(left) + score(right) - score(whole), -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[at] > 1e-9 * (1 + abs(score(whole))):
        return None
    f, b = np.unravel_index(at, gain.shape)
    return float(gain[f, b]), int(f), int(b)


class Tree:
    """Grows leaf by leaf, the largest gain first; asks for the sums that it needs."""

    def __init__(self, leaves: int, least: int, penalty: float):
        self.limit, self.least, self.penalty = leaves, least, penalty
        self.root = Node([])
        self.leaves = [self.root]

    def know(self, node: Node, sums: np.ndarray) -> None:
        node.sums, node.split = sums, best_split(sums, self.least, self.penalty)
        g, n = sums[0].sum(1)
        node.value = g / (n + self.penalty)
        if node.split:
            _, f, b = node.split
            node.children = [Node([*node.path, (f, b, side)]) for side in (True, False)]

    def grow(self) -> list[Node]:
        """Splits as far as the sums are known. The nodes to measure next: none when the tree is complete."""
        if self.root.sums is None:
            return [self.root]
        while len(self.leaves) < self.limit:
            open_ = [x for x in self.leaves if x.split]
            if not open_:
                return []
            first = max(open_, key=lambda x: x.split[0])
            if first.children[0].sums is None:
                return [x.children[0] for x in open_ if x.children[0].sums is None]
            at = self.leaves.index(first)
            self.leaves[at : at + 1] = first.children
        return []


def _within(node: Node) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(f"_b{f}") <= b) if side else (F.col(f"_b{f}") > b) for f, b, side in node.path], F.lit(True))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the values that end its bins, `bins` - 1 at most, from a sketch of its quantiles."""
    cuts = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), cuts, 50 * bins).alias(f"q{i}") for i, f in enumerate(features)], *[F.max(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted({v for v in row[f"q{i}"] or [] if v < row[f"m{i}"]}) for i in range(len(features))]


def _bin(c: Column, edges: list[float]) -> Column:
    """0 for null, else 1 + the number of edges below the value."""
    return F.coalesce(1 + F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < c)), F.lit(0)) if edges else c.isNotNull().cast("int")


def histogram_out_of_fold(df: DataFrame, features: list[str], y: str, fold: str, out: str = "prediction", rounds: int = 60, rate: float = 0.05, leaves: int = 15, least: int = 20, penalty: float = 1.0, bins: int = 255, most: int = 100) -> tuple[DataFrame, list[list[Tree]]]:
    """df with predictions of each fold by trees grown on the other folds, and the trees of each round, a model each (ML-3).

    A null feature lies below all values; rows with a null y are predicted and teach nothing. Folds are `most` at most,
    else an error; a fold without others gets null. All models share the bins. Each round writes the residuals anew.
    """
    named = cut(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    folds = [r[0] for r in named.select(fold).distinct().orderBy(fold).limit(most + 1).collect()]
    if len(folds) > most:
        raise ValueError(f"{fold} has more than {most} values")
    places = df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(zip(folds))], named.select(F.lit(0).alias("_fold"), fold).schema)
    edges = bin_edges(named, features, bins)
    binned = null_safe_join(named, F.broadcast(places), [fold]).select("_id", "_fold", F.col(y).cast("double").alias("_y"), *[_bin(F.col(f).cast("double"), e).alias(f"_b{i}") for i, (f, e) in enumerate(zip(features, edges))])
    pairs = cut(binned.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(folds) - 1))))), "pairs")
    learns = (F.col("_model") != F.col("_fold")) & F.col("_y").isNotNull()
    base = {r["_model"]: r["m"] for r in pairs.filter(learns).groupBy("_model").agg(F.avg("_y").alias("m")).collect()}
    by_model = lambda values, none: reduce(lambda rest, x: F.when(F.col("_model") == x[0], x[1]).otherwise(rest), values.items(), none)
    state = cut(pairs.filter(F.col("_model").isin(list(base))).withColumn("_p", by_model({m: F.lit(v) for m, v in base.items()}, F.lit(None).cast("double"))), "pairs")
    width, forest = max([len(e) for e in edges], default=0) + 2, []
    for _ in range(rounds if base else 0):
        trees = {m: Tree(leaves, least, penalty) for m in base}
        while asked := [(m, node) for m, t in trees.items() for node in t.grow()]:
            of = reduce(lambda rest, x: F.when((F.col("_model") == x[1][0]) & _within(x[1][1]), F.lit(x[0])).otherwise(rest), enumerate(asked), F.lit(None).cast("int"))
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(features))]))
            held = state.filter(learns).select(of.alias("node"), (F.col("_y") - F.col("_p")).alias("r"), cells.alias("c")).filter("node is not null")
            sums = np.zeros((len(asked), len(features), 2, width))
            for row in held.groupBy("node", "c.f", "c.b").agg(F.sum("r").alias("g"), F.count("*").alias("n")).collect():
                sums[row["node"], row["f"], :, row["b"]] = row["g"], row["n"]
            parents = {id(t.root): None for t in trees.values()}
            for t in trees.values():
                parents |= {id(x.children[0]): x for x in t.leaves if x.children}
            for (m, node), s in zip(asked, sums):
                trees[m].know(node, s)
                if (parent := parents[id(node)]) is not None:
                    trees[m].know(parent.children[1], parent.sums - s)
        step = by_model({m: reduce(lambda rest, x: F.when(_within(x), F.lit(rate * x.value)).otherwise(rest), t.leaves, F.lit(0.0)) for m, t in trees.items()}, F.lit(0.0))
        state = cut(state.withColumn("_p", F.col("_p") + step), "pairs")
        forest.append([trees[m] for m in base])
    told = state.filter("_model = _fold").select("_id", F.col("_p").alias(out))
    return named.join(told, "_id", "left").drop("_id"), forest
