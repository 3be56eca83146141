"""Isolation-forest anomaly scores (Liu, Ting and Zhou, 2008)."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.operators.cells import stacked
from assaykit.operators.rows import canonical, imputed

# Forest size and sample per tree (fixed values).
TREES = 100
SAMPLE = 10_000
EULER_GAMMA = 0.5772156649015329

# Standard deviations that a hash draw aims above the wanted sample; a tree that is short
# all the same is drawn again with a larger share.
_MARGIN = 5.0

# One row per tree; the node arrays travel as bytes of these types.
_NODES = "tree int, drawn int, feature binary, threshold binary, child binary, path binary"
_NODE_TYPES = {"feature": "int32", "threshold": "float64", "child": "int32", "path": "float64"}


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    large = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, large))


def grown_tree(matrix, rng):
    """``(feature, threshold, child, path)`` arrays of one tree, grown level by level.

    A node with rows that differ gets a random varying feature and a random threshold
    between its extremes; rows above it go to node ``child + 1``, the others to
    ``child``.  A leaf is its own child, never sends a row on, and carries the path
    length it stands for.
    """
    deepest = int(np.ceil(np.log2(max(len(matrix), 2))))
    feature, threshold, child, path = [], [], [], []
    rows, node = np.arange(len(matrix)), np.zeros(len(matrix), dtype=int)
    first, width = 0, 1
    for depth in range(deepest + 1):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        counts = np.bincount(node - first, minlength=width)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        block = matrix[rows]
        low, high = np.minimum.reduceat(block, starts, axis=0), np.maximum.reduceat(block, starts, axis=0)
        varied = high > low
        splits = varied.any(axis=1) & (depth < deepest)
        chosen = np.where(varied, rng.random(varied.shape), -1.0).argmax(axis=1)
        each = np.arange(width)
        low, high = low[each, chosen], high[each, chosen]
        cut = low + (high - low) * rng.random(width)
        cut = np.where(cut < high, cut, low)
        places = first + width + 2 * (np.cumsum(splits) - 1)
        feature.append(np.where(splits, chosen, 0))
        threshold.append(np.where(splits, cut, np.inf))
        child.append(np.where(splits, places, first + each))
        path.append(np.where(splits, 0.0, depth + average_path(counts)))
        onward = splits[node - first]
        rows, node = rows[onward], node[onward]
        at = node - first
        node = places[at] + (matrix[rows, chosen[at]] > cut[at])
        first, width = first + width, 2 * int(splits.sum())
        if not width:
            break
    return [np.concatenate(part) for part in (feature, threshold, child, path)]


@dataclass
class IsolationForest:
    """A fitted forest: the node arrays of all trees."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    path: np.ndarray
    width: int
    sample: int
    depth: int

    def score(self, rows):
        """``(row_id, score)``: ``2 ** -(mean path / expected path)``, higher is more anomalous."""
        forest, width, expected = self, self.width, float(average_path(self.sample))

        @F.pandas_udf("double")
        def anomaly(features: pd.Series) -> pd.Series:
            matrix = stacked(features, width)
            cells, start = matrix.ravel(), np.arange(len(matrix)) * width
            total = np.zeros(len(matrix))
            for root in forest.roots:
                at = np.full(len(matrix), root, dtype="int32")
                for _ in range(forest.depth):
                    above = cells[start + forest.feature[at]] > forest.threshold[at]
                    at = forest.child[at] + above
                total += forest.path[at]
            return pd.Series(np.power(2.0, -total / len(forest.roots) / max(expected, 1e-12)))

        return rows.select("row_id", anomaly("features").alias("score"))


def draw_share(total, sample, widening=0):
    """The share of rows a tree draws by hash, so that about all trees get their ``sample``."""
    share = (sample + _MARGIN * np.sqrt(sample) + _MARGIN) / total
    return min(1.0, float(share) * 2.0**widening)


def tree_samples(rows, total, trees=TREES, sample=SAMPLE, seed=42, widening=0):
    """``(tree, row_id, features)``: ``min(sample, total)`` rows per tree without replacement.

    ``trees`` is a number of trees or a list of their numbers.  Every row draws a hash per
    tree, in a table of any size; only the draws that fall below the share are emitted,
    and the smallest of them, ``sample`` per tree, are kept.  Trees are independent.
    """
    wanted = list(range(trees)) if isinstance(trees, int) else sorted(trees)
    share = draw_share(total, sample, widening)
    below = int(share * (1 << 52))

    def draw(tree):
        return F.pmod(F.xxhash64(F.lit(seed), tree, F.col("row_id")), F.lit(1 << 52))

    # One expression per tree stays in generated code, where a lambda over trees would be interpreted.
    picks = F.array(*[F.when(draw(F.lit(t)) < F.lit(below), F.lit(t)) for t in wanted]) if share < 1 else F.array(
        *[F.lit(t) for t in wanted]
    )
    drawn = rows.select("row_id", "features", F.explode(F.array_compact(picks)).alias("tree"))
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "row_id")
    return (
        drawn.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= sample)
        .select("tree", "row_id", "features")
    )


def fit_forest(filled, trees=TREES, sample=SAMPLE, seed=42):
    """Grow one tree per group of exactly ``min(sample, rows)`` rows without invalid cells.

    The fitted nodes come to the driver as the model: at most ``2 * trees * sample``
    whatever the table holds.
    """
    total = filled.count()
    if not total:
        raise ValueError("no rows to fit on")
    drawn = min(sample, total)
    width = len(filled.select("features").first()["features"])

    def grow(key, group):
        tree = int(key[0])
        ordered = group.sort_values("row_id")
        nodes = grown_tree(stacked(ordered["features"], width), np.random.default_rng([seed, tree]))
        packed = {c: [part.astype(kind).tobytes()] for (c, kind), part in zip(_NODE_TYPES.items(), nodes)}
        return pd.DataFrame({"tree": [tree], "drawn": [len(group)], **packed})

    grown, missing, widening = [], list(range(trees)), 0
    while missing:
        found = tree_samples(filled, total, missing, sample, seed, widening).groupBy("tree").applyInPandas(grow, _NODES)
        grown += [t for t in found.collect() if t["drawn"] == drawn]
        missing = sorted(set(missing) - {t["tree"] for t in grown})
        widening += 1
    grown.sort(key=lambda t: t["tree"])
    parts = {c: [np.frombuffer(t[c], dtype=kind) for t in grown] for c, kind in _NODE_TYPES.items()}
    starts = np.cumsum([0] + [len(p) for p in parts["path"]])[:-1].astype("int32")
    parts["child"] = [child + start for child, start in zip(parts["child"], starts)]
    depth = int(np.ceil(np.log2(max(drawn, 2))))
    return IsolationForest(
        starts, *[np.concatenate(parts[c]) for c in ("feature", "threshold", "child", "path")], width, drawn, depth
    )


def isolation_forest_scores(df, key, features, label=None, include_label=False, trees=TREES, sample=SAMPLE, seed=42):
    """``(row_id, score)`` of a forest fitted on the same table."""
    names = [*features, label] if include_label and label else features
    rows = imputed(canonical(df, key, None, names))
    return fit_forest(rows, trees, sample, seed).score(rows)
