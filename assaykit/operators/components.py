"""Connected components of an edge table."""

import uuid

from pyspark.sql import functions as F

from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed, delete_folder, ensure_checkpoint_dir


def connected_components(edges, a="a", b="b"):
    """``(node, component)`` with the smallest node of each component as its name.

    Every round takes the smallest label among the neighbours and then the label of
    that label, which doubles the distance a label travels.  A node with very many
    neighbours, and a label that very many nodes carry, go through ``lookup_join``.

    Rounds are kept as Parquet, deleted when the next one is there, not as checkpoints: those hand on the planner's estimate
    of their size, the product of what was joined, whose digits are multiplied by every round and fill the driver's memory.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/components-{uuid.uuid4().hex}"

    def written(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    links = written(both.filter(F.col("node") != F.col("other")).distinct(), "links")
    labels = written(
        links.groupBy("node").agg(
            F.least(F.min("other"), F.first("node")).alias("component"), F.count(F.lit(1)).alias("degree")
        ),
        "0-labels",
    )
    number = 0
    while True:
        number += 1
        named = labels.select(F.col("node").alias("other"), F.col("component").alias("offer"), "degree")
        offers = lookup_join(links, named, "other", "degree").groupBy("node").agg(F.min("offer").alias("offer"))
        stepped = labels.join(offers, "node").select(
            "node", F.least("component", "offer").alias("target"), F.col("component").alias("was"), "degree"
        )
        stepped = written(stepped, f"{number}-stepped")
        carried = stepped.groupBy("target").agg(F.count(F.lit(1)).alias("carriers"))
        jump = carried.join(
            stepped.select(F.col("node").alias("target"), F.col("target").alias("further")), "target"
        )
        jumped = lookup_join(stepped, jump, "target", "carriers").select(
            "node", F.coalesce("further", "target").alias("component"), "degree", "was"
        )
        jumped = written(jumped, f"{number}-labels")
        delete_folder(spark, f"{folder}/{number}-stepped")
        delete_folder(spark, f"{folder}/{number - 1}-labels")
        labels = jumped.drop("was")
        if jumped.filter(F.col("component") != F.col("was")).isEmpty():
            found = checkpointed(labels.select("node", "component"))
            delete_folder(spark, folder)
            return found
