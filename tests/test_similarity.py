"""Similarity joins against brute force on small tables with hot groups and tiny blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import cells
from assaykit.operators.components import connected_components
from assaykit.operators.near_duplicates import near_duplicate_clusters, near_duplicate_scores, sign_signatures
from assaykit.operators.neighbours import knn_scores


def table(spark, matrix, labels=None):
    labels = [int(i % 3 == 0) for i in range(len(matrix))] if labels is None else labels
    data = [(i, [float(x) for x in row], int(y)) for i, (row, y) in enumerate(zip(matrix, labels))]
    return spark.createDataFrame(data, "id bigint, v array<double>, label int")


@pytest.fixture(scope="module")
def crowded():
    """A third exact copies, a third near copies, the rest spread; also zero and scaled vectors."""
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(60, 6)) * 3
    copies = np.tile(rng.normal(size=6) * 3, (60, 1))
    near = rng.normal(size=6) * 5 + rng.normal(size=(60, 6)) * 0.05
    looser = rng.normal(size=6) * 5 + rng.normal(size=(40, 6)) * 0.5
    odd = np.vstack([np.zeros((3, 6)), 2 * copies[:2], [[1, -1, 1, -1, 1, 1]] * 2])
    return np.vstack([spread, copies, near, looser, odd]).astype(np.float32).astype(float)


def brute_near(matrix, labels, threshold=0.98):
    x = matrix.copy()
    x[(x == 1) | (x == -1)] = 0
    length = np.linalg.norm(x, axis=1)
    u = x / np.where(length == 0, 1, length)[:, None]
    s = u @ u.T
    linked = (s >= threshold) & (length > 0)[:, None] & (length > 0)[None, :]
    np.fill_diagonal(linked, False)
    name = np.arange(len(x))
    while True:
        low = np.minimum(name, np.where(linked, name[None, :], len(x)).min(axis=1))
        if (low == name).all():
            break
        name = low
    scores = np.zeros(len(x))
    for c in set(name):
        members = np.flatnonzero(name == c)
        if len(members) > 1:
            block = np.triu(linked[np.ix_(members, members)], 1)
            score = (1 - 1 / len(members)) * s[np.ix_(members, members)][block].mean()
            scores[members] = min(1, score + 0.25) if len(set(labels[members])) > 1 else score
    return scores, int(np.triu(linked, 1).sum())


def test_near_duplicates_exact(spark, crowded, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    labels = np.arange(len(crowded)) % 4 // 3
    df = table(spark, crowded, labels)
    wanted, pairs = brute_near(crowded, labels)
    found = near_duplicate_scores(df, "id", "label", "v").orderBy("row_id").toPandas()
    assert np.abs(found["score"] - wanted).max() < 1e-9
    clusters = near_duplicate_clusters(df, "id", "label", "v").toPandas()
    assert clusters["pairs"].sum() == pairs


def test_lsh_finds_a_subset(spark, crowded, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    df = table(spark, crowded)
    exact = near_duplicate_scores(df, "id", "label", "v").toPandas().set_index("row_id")["score"]
    lsh = near_duplicate_scores(df, "id", "label", "v", mode="lsh").toPandas().set_index("row_id")["score"]
    assert set(lsh[lsh > 0].index) <= set(exact[exact > 0].index)
    # Copies of one vector share every band.
    assert (lsh.loc[list(range(60, 120))] > 0).all()


def test_no_similar_rows(spark):
    df = table(spark, np.eye(4) * 5)
    assert near_duplicate_scores(df, "id", "label", "v").agg(F.sum("score")).first()[0] == 0


def test_bands_must_divide_planes(spark):
    with pytest.raises(ValueError):
        sign_signatures(spark.createDataFrame([(1, [1.0])], "row_id bigint, features array<double>"), 1, 64, 7)


def brute_knn(matrix, k, components=None):
    x = matrix[:, matrix.var(axis=0) > 1e-12]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    if components and min(components, len(x) - 1, x.shape[1] - 1) >= 2:
        _, _, v = np.linalg.svd(x, full_matrices=False)
        x = x @ v[: min(components, len(x) - 1, x.shape[1] - 1)].T
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length == 0, 1, length)
    d = 0.5 * cells.squared_distances(x, x)
    np.fill_diagonal(d, np.inf)
    d = np.sort(d, axis=1)[:, :k]
    return d.mean(axis=1), np.median(d, axis=1)


@pytest.mark.parametrize("components", [None, 100])
def test_nearest_neighbours(spark, crowded, monkeypatch, components):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    matrix = np.hstack([crowded, np.full((len(crowded), 1), 4.0)])
    found = knn_scores(table(spark, matrix), "id", "v", k=7, n_components=components).orderBy("row_id").toPandas()
    mean, median = brute_knn(matrix, 7, components)
    assert np.abs(found["score"] - mean).max() < 1e-6
    assert np.abs(found["knn_median_distance"] - median).max() < 1e-6


def test_neighbours_need_enough_rows(spark):
    with pytest.raises(ValueError):
        knn_scores(table(spark, np.eye(4)), "id", "v", k=4)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    found = connected_components(spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in found} == {
        **{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}
    }
