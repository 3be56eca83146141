"""Leading directions from passes over the rows against a decomposition in memory."""

import numpy as np
import pytest

from assaykit.operators import principal
from assaykit.operators.neighbours import knn_scores


def table(spark, x, weights=None):
    weights = np.ones(len(x), int) if weights is None else weights
    rows = [(i, [float(v) for v in r], int(w)) for i, (r, w) in enumerate(zip(x, weights))]
    return spark.createDataFrame(rows, "id long, v array<double>, w long").repartition(5)


@pytest.fixture(scope="module")
def decaying():
    """400 rows of 300 numbers whose spectrum falls off."""
    rng = np.random.default_rng(1)
    left, right = (np.linalg.qr(rng.normal(size=(n, 300)))[0] for n in (400, 300))
    return (left * (50 * 0.9 ** np.arange(300))) @ right.T


def test_directions(spark, decaying):
    weights = np.arange(400) % 3
    directions, values = principal.principal_directions(table(spark, decaying, weights), "v", "w", 20)
    want, turned = np.linalg.eigh(decaying.T @ (decaying * weights[:, None]))
    want, turned = want[::-1][:20], turned[:, ::-1][:, :20]
    assert np.abs(values / want - 1).max() < 1e-8
    assert np.abs(directions.T @ directions - np.eye(20)).max() < 1e-10
    assert np.abs(np.abs((directions * turned).sum(axis=0)) - 1).max() < 1e-6


def test_blocks_and_few_rows(spark, decaying, monkeypatch):
    monkeypatch.setattr(principal, "BLOCK_FEATURES", 64)
    monkeypatch.setattr(principal, "CHUNK_ROWS", 7)
    some = decaying[:30]
    directions, values = principal.principal_directions(table(spark, some), "v", "w", 50)
    assert np.abs(values[:10] / np.linalg.svd(some, compute_uv=False)[:10] ** 2 - 1).max() < 1e-8
    assert values[30:].max() < 1e-6 * values[0]
    directions, _ = principal.principal_directions(table(spark, some[:, :4]), "v", "w", 9)
    assert directions.shape == (4, 4)
    assert principal.principal_directions(table(spark, some).limit(0), "v", "w", 3)[0].shape == (0, 0)


def test_wide_rows(spark):
    """5,000 features: the driver holds 5,000 x 18 numbers."""
    rng = np.random.default_rng(2)
    factors = rng.normal(size=(5000, 8))
    x = rng.normal(size=(120, 8)) * (10.0 ** -np.arange(8) * 100) @ factors.T + rng.normal(size=(120, 5000)) * 1e-9
    directions, values = principal.principal_directions(table(spark, x), "v", "w", 4)
    assert np.abs(values / np.linalg.svd(x, compute_uv=False)[:4] ** 2 - 1).max() < 1e-8
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.abs((directions * v[:4].T).sum(axis=0)) - 1).max() < 1e-8


def test_reduced_neighbours_like_exact_projection(spark, decaying):
    x = decaying.astype(np.float32).astype(float)
    found = knn_scores(table(spark, x), "id", "v", k=5, n_components=15).toPandas().set_index("row_id")["score"].sort_index()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    u = z @ v[:15].T
    u /= np.linalg.norm(u, axis=1)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    assert np.abs(found.to_numpy() - np.sort(d, axis=1)[:, :5].mean(axis=1)).max() < 1e-4
