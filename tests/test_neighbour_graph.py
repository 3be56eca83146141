"""Neighbours found by descent on a graph against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import cells
from assaykit.operators import neighbour_graph as neighbour_graph_module
from assaykit.operators.neighbour_graph import nearest_in_graph, neighbour_graph, tree_leaves
from assaykit.operators.neighbours import knn_scores


def vectors_of(spark, matrix, copies=1):
    rows = [(i * 10, [float(x) for x in row], copies) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "row_id long, vector array<double>, copies long").repartition(3)


def brute(matrix, k):
    squared = cells.squared_distances(matrix, matrix)
    np.fill_diagonal(squared, np.inf)
    return squared, np.sort(squared, axis=1)[:, :k]


def recall_of(found, matrix, k):
    squared, nearest = brute(matrix, k)
    rows, others = found["row_id"].to_numpy() // 10, found["other"].to_numpy() // 10
    assert np.abs(found["squared"].to_numpy() - squared[rows, others]).max() < 1e-9
    assert not found.duplicated(["row_id", "other"]).any() and (rows != others).all()
    return (squared[rows, others] <= nearest[rows, -1] + 1e-12).sum() / (k * len(matrix))


@pytest.fixture(scope="module")
def points():
    """Clusters of different density around a few centres, and noise: 1,500 rows of 16 numbers."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    clustered = centres[rng.integers(0, 12, 1100)] + rng.normal(size=(1100, 16)) * rng.choice([0.1, 1.0], (1100, 1))
    return np.vstack([clustered, rng.normal(size=(400, 16)) * 4])


def test_recall(spark, points):
    """Leaves alone find part of the neighbours; the rounds find the rest, with lists of a bounded length."""
    vectors = vectors_of(spark, points)
    options = {"width": 15, "trees": 2, "leaf": 40}
    leaves = neighbour_graph(vectors, len(points), rounds=0, **options).toPandas()
    assert leaves.groupby("row_id").size().max() <= 15
    found = nearest_in_graph(vectors, len(points), 8, **options).toPandas()
    assert recall_of(found.drop(columns="copies"), points, 8) > 0.97
    order = leaves.sort_values("squared").groupby("row_id").head(8)
    assert recall_of(order, points, 8) < 0.9


def test_repeatable(spark, points):
    some = points[:300]
    runs = [
        nearest_in_graph(vectors_of(spark, some).repartition(n), len(some), 5, trees=2, leaf=30).toPandas().sort_values(["row_id", "other"])
        for n in (2, 5)
    ]
    assert (runs[0][["row_id", "other"]].to_numpy() == runs[1][["row_id", "other"]].to_numpy()).all()


def test_hub(spark):
    """A row that is near to all others, and a crowd of near copies: the groups stay bounded."""
    rng = np.random.default_rng(1)
    crowd = rng.normal(size=8) * 3 + rng.normal(size=(300, 8)) * 1e-3
    ring = rng.normal(size=(300, 8))
    ring /= np.linalg.norm(ring, axis=1)[:, None]
    matrix = np.vstack([np.zeros((1, 8)), ring, crowd])
    vectors = vectors_of(spark, matrix)
    leaves = tree_leaves(vectors, len(matrix), 42, trees=3, leaf=20).groupBy("leaf").count()
    assert leaves.agg(F.max("count")).first()[0] < 100
    found = nearest_in_graph(vectors, len(matrix), 5, trees=4, leaf=40).toPandas()
    assert recall_of(found.drop(columns="copies"), matrix, 5) > 0.9


def test_small_tables(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        matrix = rng.normal(size=(n, 3))
        found = nearest_in_graph(vectors_of(spark, matrix), n, 4).toPandas()
        assert len(found) == n * (n - 1)
    empty = vectors_of(spark, np.eye(2)).limit(0)
    assert neighbour_graph(empty, 0).count() == 0


def test_scores_like_the_exact_ones(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact, graph = (
        knn_scores(table, "vec_id", "embedding", n_components=None, **o).toPandas().set_index("row_id")["score"].sort_index()
        for o in ({}, {"mode": "graph", "leaf": 30, "trees": 4})
    )
    assert (graph.index == exact.index).all()
    assert (graph >= exact - 1e-9).all() and (graph - exact).mean() < 0.005 * exact.mean()
    with pytest.raises(ValueError):
        knn_scores(table, "vec_id", "embedding", mode="tree")


def test_copies_count_as_neighbours(spark):
    rng = np.random.default_rng(4)
    matrix = np.vstack([np.tile(rng.normal(size=6), (20, 1)), rng.normal(size=(80, 6))])
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(matrix)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    exact, graph = (knn_scores(table, "id", "v", k=6, mode=m).orderBy("row_id").toPandas()["score"] for m in ("exact", "graph"))
    assert np.abs(exact - graph).max() < 1e-9 and np.abs(graph[:20]).max() < 1e-9


def test_what_travels(spark, points, monkeypatch):
    """In the rounds two bytes a number go to the groups, and none to a group without a new member."""
    seen, real = [], neighbour_graph_module._introduced
    monkeypatch.setattr(neighbour_graph_module, "_introduced", lambda members, *a: seen.append(members) or real(members, *a))
    vectors = vectors_of(spark, points)
    nearest_in_graph(vectors, len(points), 8, width=15, trees=2, leaf=40)
    sizes = [{f.name for f in m.schema if "array" in f.dataType.simpleString()} for m in seen]
    assert len(seen) > 1 and not any(sizes)
    assert seen[0].agg(F.max(F.length("code"))).first()[0] == 4 + 2 * 16
    quiet = [m.groupBy("host").agg(F.max("fresh").alias("new")).filter("not new").count() for m in seen]
    assert not any(quiet)


def test_rounded_vectors():
    rng = np.random.default_rng(7)
    matrix = np.vstack([rng.normal(size=(50, 9)) * 10.0 ** rng.integers(-20, 20, (50, 1)), np.zeros((1, 9))])
    back = neighbour_graph_module.decoded(neighbour_graph_module.coded(matrix))
    assert (np.abs(back - matrix) <= 0.501 / 32767 * np.abs(matrix).max(axis=1)[:, None]).all()
    assert neighbour_graph_module.coded(np.empty((0, 3))).shape == (0, 10)
