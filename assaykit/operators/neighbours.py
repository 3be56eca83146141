"""Nearest-neighbour sparsity scores by cosine distance: exact, or from a neighbour graph."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions.vectors import WIDE_VECTOR, content_key, norm, row_quantile, unit, zero_non_finite
from assaykit.operators.cells import (
    SLACK,
    VISITS,
    Pivots,
    by_cell,
    cell_join,
    chunks,
    squared_distances,
    squares,
    stacked,
    visiting,
    with_home,
    with_visits,
)
from assaykit.operators.neighbour_graph import nearest_in_graph
from assaykit.operators.principal import principal_directions, projected
from assaykit.operators.rows import canonical, feature_moments
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed, with_number

NEIGHBOURS = 10
COMPONENTS = 100

# Features that vary less than this are left out (fixed value).
LEAST_VARIANCE = 1e-12

_NEAREST = "row_id bigint, other bigint, squared double, copies bigint"


def standardizer(rows):
    """Expression that standardises ``features`` and drops constant ones, and the width left.

    Its parameters are a mean and a deviation per feature, fetched once: their number
    is the width of the schema.
    """
    moments = sorted(feature_moments(rows).collect(), key=lambda m: m["pos"])
    kept = [m for m in moments if m["variance"] is not None and m["variance"] > LEAST_VARIANCE]
    if not kept:
        raise ValueError("every feature is constant")
    place = F.array(*[F.lit(m["pos"]) for m in kept])
    centre = F.array(*[F.lit(m["mean"]) for m in kept])
    scale = F.array(*[F.lit(m["deviation"]) for m in kept])
    picked = F.transform(place, lambda i: F.get("features", i))
    shifted = F.zip_with(picked, centre, lambda x, m: x - m)
    return F.zip_with(shifted, scale, lambda x, s: x / s), len(kept)


def standardize(df, key, features):
    """``(row_id, features)`` with mean 0 and population deviation 1, constant features dropped."""
    rows = canonical(df, key, None, features).withColumn("features", zero_non_finite(F.col("features")))
    return rows.select("row_id", standardizer(rows)[0].alias("features"))


def _reduced(standard, width, total, components, seed):
    """``standard`` on its leading principal directions when at least two can be kept.

    The columns are centred already, so these span the space of the leading singular vectors.
    """
    kept = min(components, total - 1, width - 1)
    if kept < 2:
        return standard
    standard = checkpointed(standard)  # read once per pass
    directions, _ = principal_directions(standard, "features", "copies", kept, seed)
    return projected(standard, "features", directions)


def _k_nearest(k):
    """Block comparison: for each left row the ``k`` nearest other rows of the right block in the cells it wants."""

    def compare(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"row_id": [], "other": [], "squared": [], "copies": []})
        a, b = left["row_id"].to_numpy(), right["row_id"].to_numpy()
        width = len(left["vector"].iloc[0])
        x, y = stacked(left["vector"], width), stacked(right["vector"], width)
        squared, place = np.full((len(a), k), np.inf), np.zeros((len(a), k), np.int64)
        for _, asking, members in by_cell(left["cells"], right["home"].to_numpy()):
            for i, j in squares(asking, members):
                found = squared_distances(x[i], y[j])
                found[a[i][:, None] == b[j][None, :]] = np.inf
                if len(j) > k:
                    nearest = np.argpartition(found, k - 1, axis=1)[:, :k]
                    found, at = np.take_along_axis(found, nearest, axis=1), j[nearest]
                else:
                    at = np.broadcast_to(j, found.shape)
                both, at = np.concatenate([squared[i], found], axis=1), np.concatenate([place[i], at], axis=1)
                nearest = np.argpartition(both, k - 1, axis=1)[:, :k]
                squared[i], place[i] = np.take_along_axis(both, nearest, axis=1), np.take_along_axis(at, nearest, axis=1)
        place = place.ravel()
        found = pd.DataFrame(
            {"row_id": np.repeat(a, k), "other": b[place], "squared": squared.ravel(), "copies": right["copies"].to_numpy()[place]}
        )
        return found[np.isfinite(found["squared"])]

    return compare


def _closest(pairs, k):
    """The ``k`` closest per row.  Spark keeps only ``k`` a row before it shuffles."""
    order = Window.partitionBy("row_id").orderBy("squared", "other")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def nearest_distinct(vectors, rows, k, seed=42):
    """``(row_id, other, squared, copies)``: exact ``k`` nearest different vectors of each row.

    First every vector is compared inside its own cell.  The k-th distance found there
    bounds the search: another cell is visited only when its bisector, and the ring its
    members lie in, are closer than that bound.
    """
    pivots = Pivots.drawn(vectors, rows, seed)
    placed = checkpointed(with_home(vectors.select("row_id", "vector", "copies"), pivots))
    members = placed.select("row_id", "vector", "copies", "home")
    # A vector with k copies beside itself has its neighbours already.
    asking = placed.filter(F.col("copies") <= k)
    own = asking.select("row_id", "vector", F.col("home").alias("cell"), F.array("home").alias("cells"))
    inside = checkpointed(_closest(cell_join(own, members.withColumn("cell", F.col("home")), _k_nearest(k), _NEAREST), k))
    bounds = inside.groupBy("row_id").agg(
        F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("squared"))).alias("bound")
    )
    rings = placed.groupBy("home").agg(F.min("home_distance").alias("near"), F.max("home_distance").alias("far"))
    fill = (
        placed.withColumn("_r", F.row_number().over(Window.partitionBy("home").orderBy("home_distance", "row_id")))
        .filter(F.col("_r") == k + 1)
        .select("home", F.col("home_distance").alias("reach"))
    )
    # Three numbers per cell.
    ring = rings.join(fill, "home", "left").toPandas().set_index("home").reindex(range(len(pivots.points)))
    regions = pivots.regions(rows)
    near, far = ring["near"].fillna(np.inf).to_numpy(), ring["far"].fillna(-np.inf).to_numpy()
    reach = ring["reach"].fillna(np.inf).to_numpy(dtype=float)

    @F.pandas_udf(VISITS)
    def visits(vector: pd.Series, home: pd.Series, bound: pd.Series) -> pd.DataFrame:
        matrix, homes, known, found = stacked(vector, pivots.width), home.to_numpy(), bound.fillna(np.inf).to_numpy(), []
        for part in chunks(len(matrix), len(pivots.points)):
            squared, own = pivots.squared(matrix[part]), homes[part]
            distance = np.sqrt(squared)
            # k + 1 members of any one cell lie within this distance.
            limit = np.minimum(known[part], (distance + reach).min(axis=1))[:, None] * (1 + SLACK) + SLACK
            go = pivots.beyond_bisector(squared, own) <= limit
            go &= (distance - far <= limit) & (near - distance <= limit)
            go[np.arange(len(own)), own] = False
            found.extend(np.flatnonzero(g) for g in go)
        return visiting(found, regions)

    # A row per vector is written; it travels once to each region that has a cell to visit.
    travelling = asking.join(bounds, "row_id", "left").select("row_id", "vector", visits("vector", "home", "bound").alias("visits"))
    of_home = F.get(F.array(*[F.lit(int(r)) for r in regions]), F.col("home"))
    outside = cell_join(with_visits(checkpointed(travelling), "visits"), members.withColumn("cell", of_home), _k_nearest(k), _NEAREST)
    return _closest(inside.unionByName(outside), k)


def knn_scores(df, key, features, k=NEIGHBOURS, n_components=COMPONENTS, seed=42, metric="cosine", mode="exact", **options):
    """``(row_id, knn_mean_distance, knn_median_distance, score)``.

    The score is the mean of half the squared distance (the cosine distance) to the
    ``k`` nearest other rows after standardising, optional reduction to the leading
    ``n_components`` directions, and scaling to length one.  With ``metric="euclidean"`` it
    is the mean of the distance itself, without that scaling.  Equal rows are compared
    once and counted as often as they occur.

    ``mode="exact"`` compares all pairs that no bound rules out, in wide data without clusters most of them.
    ``mode="graph"`` finds nearly all neighbours with work per row that does not grow with the table; ``options``
    are those of ``neighbour_graph``.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    if mode not in ("exact", "graph"):
        raise ValueError(f"unknown mode {mode}")
    rows = canonical(df, key, None, features).withColumn("features", zero_non_finite(F.col("features")))
    total = rows.count()
    if total <= k:
        raise ValueError(f"{total} rows, but {k} neighbours wanted")
    scaled, width = standardizer(rows)
    wide = isinstance(features, str) or len(features) > WIDE_VECTOR
    keyed = rows.withColumn("content", content_key(F.col("features"), wide))
    distinct = keyed.groupBy("content").agg(
        F.min("row_id").alias("first_id"),
        F.first("features").alias("features"),
        F.count(F.lit(1)).alias("copies"),
    )
    standard = with_number(distinct, "first_id").withColumn("features", scaled)
    if n_components is not None:
        standard = _reduced(standard, width, total, n_components, seed)
    vector = unit(F.col("features"), norm(F.col("features"))) if metric == "cosine" else F.col("features")
    vectors = checkpointed(standard.select("content", "row_id", "copies", vector.alias("vector")))
    search = nearest_in_graph if mode == "graph" else nearest_distinct
    pairs = search(vectors, vectors.count(), k, seed, **options)
    found = pairs.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("squared", "copies"))).alias("found"))
    repeated = F.flatten(
        F.transform(
            F.coalesce("found", F.array().cast("array<struct<squared:double,copies:bigint>>")),
            lambda s: F.array_repeat(
                s["squared"] * F.lit(0.5) if metric == "cosine" else F.sqrt(s["squared"]),
                F.least(s["copies"], F.lit(k)).cast("int"),
            ),
        )
    )
    own = F.array_repeat(F.lit(0.0), F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    measured = (
        vectors.select("content", "row_id", "copies")
        .join(found, "row_id", "left")
        .withColumn("distances", F.slice(F.concat(own, repeated), 1, k))
        .select(
            "content",
            "copies",
            (F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / F.size("distances")).alias("knn_mean_distance"),
            row_quantile(F.col("distances"), 0.5).alias("knn_median_distance"),
        )
    )
    return lookup_join(keyed.select("row_id", "content"), measured, "content", "copies").select(
        "row_id", "knn_mean_distance", "knn_median_distance", F.col("knn_mean_distance").alias("score")
    )
