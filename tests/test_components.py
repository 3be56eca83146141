"""Connected components against a plain search, and what their rounds hand on."""

import os

from pyspark.sql import functions as F

from assaykit.operators.components import connected_components
from assaykit.session import ensure_checkpoint_dir


def test_long_chain(spark):
    """A chain takes several rounds.  The estimated size of the result stays a small number: as checkpoints of joins, every
    round multiplied its digits.  Nothing of the rounds stays on disk."""
    ensure_checkpoint_dir(spark)
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {n for n in os.listdir(kept) if n.startswith("components-")}
    edges = spark.range(40).select((F.col("id") * 7 % 41).alias("a"), ((F.col("id") + 1) * 7 % 41).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(500, 501), (501, 501), (None, 3), (501, 500)], "a bigint, b bigint"))
    found = connected_components(edges)
    assert {(r["node"], r["component"]) for r in found.collect()} == {*((i, 0) for i in range(41)), (500, 500), (501, 500)}
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) < 20
    assert {n for n in os.listdir(kept) if n.startswith("components-")} == before
