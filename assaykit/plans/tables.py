"""The given tables, and labelled feature tables derived from them."""

from pyspark.sql import functions as F

from assaykit.functions.hashing import stable_uniform
from assaykit.operators.ranking import row_index
from assaykit.session import spread_small

TOKEN_BUCKETS = 64

LINEITEM_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_vectors(documents, key="doc_id", text="text", buckets=TOKEN_BUCKETS):
    """``(key, features array<double>)``: counts of the lower-cased tokens by hash bucket."""
    token = F.explode(F.split(F.lower(F.col(text)), "[ \\n\\r\\t]+"))
    bucket = F.pmod(F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int"), F.lit(buckets))
    counts = (
        documents.select(key, token.alias("token"))
        .filter(F.col("token") != "")
        .groupBy(key, bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    )
    places = F.sequence(F.lit(0), F.lit(buckets - 1))
    return documents.select(key).join(counts, key, "left").select(
        key, F.transform(places, lambda b: F.coalesce(F.element_at("counts", b), F.lit(0.0))).alias("features")
    )


def labelled_documents(spark, folder):
    """Documents as token vectors; ``quality`` is -1 where no label exists."""
    vectors = token_vectors(spread_small(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return vectors.join(labels, "doc_id", "left").select(
        "doc_id", "features", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic")
    )


def labelled_events(spark, folder):
    """Events with a binary label (an error or not) and a probability from the value."""
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        "user_id",
        "value",
        "event_type",
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("probability"),
    )


def numbered_lineitem(spark, folder):
    """Line items with ``row_idx`` in the order of all columns; they have no key."""
    return row_index(table(spark, folder, "lineitem"), LINEITEM_ORDER)


def labelled_orders(spark, folder):
    """Orders with a learnable binary label: a high total, flipped on a tenth of the rows."""
    orders = table(spark, folder, "orders")
    high = F.col("o_totalprice") > 250000
    return orders.select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_custkey").cast("double").alias("o_custkey"),
        F.dayofyear("o_orderdate").cast("double").alias("o_day"),
        F.when(stable_uniform("o_orderkey", 7) < 0.1, ~high).otherwise(high).cast("int").alias("label"),
    )
