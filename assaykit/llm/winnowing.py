"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item, or a shorter item whole.
For a window of ``m`` words the hashes of its ``k``-grams (``k`` about half of ``m``) are
winnowed: the smallest hash of each ``m``-word window is a fingerprint, on both sides.
Equal windows have equal fingerprints, so joining them finds every document that
shares a window.  The hits are then extended: around each place of a document where a
matched hash stands, the windows that cover it are compared word by word.

Fingerprints and windows of the benchmark are broadcast if their number is checked to be
small, and joined by shuffle otherwise.  A window that several items share is one row.

Cases: null texts have no words and are not hit; items without words never occur.
Repeated items count as items of their own; repeated documents are one row each.  Rows
without an id are matched as well.  Other columns are ignored.  Empty tables are fine.
"""

from pyspark.sql import functions as F

from assaykit.llm.common import BROADCAST_ROWS, checked_broadcast
from assaykit.session import checkpointed

WINDOW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """The words of a text: runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def _grams(array, width, hashed=True):
    """The runs of ``width`` words at every place, as hashes or as texts."""
    one = lambda i: F.slice(array, i, width)
    places = F.sequence(F.lit(1), F.size(array) - (width - 1))
    made = F.transform(places, lambda i: F.xxhash64(one(i)) if hashed else F.array_join(one(i), " "))
    return F.when(F.size(array) >= width, made).otherwise(F.array())


def gram_width(window):
    return (window + 1) // 2


def fingerprints(array, window):
    """The distinct winnowing fingerprints of a word array for windows of ``window`` words."""
    width = gram_width(window)
    hashes = _grams(array, width)
    span = window - width + 1
    least = F.transform(
        F.sequence(F.lit(1), F.size("hashes") - (span - 1)), lambda i: F.array_min(F.slice("hashes", i, span))
    )
    return hashes, F.array_distinct(F.when(F.size("hashes") >= span, least).otherwise(F.array()))


def benchmark_windows(benchmark, item="item_id", text="text", window=WINDOW):
    """``(m, window, items)``: the distinct windows with the sorted ids of their items."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    whole = rows.withColumn("m", F.least(F.size("w"), F.lit(window)))
    places = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    texts = F.transform(places, lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))
    cut = whole.select("item", "m", F.explode(F.array_distinct(texts)).alias("window"))
    return cut.groupBy("m", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(
    documents, benchmark, key="doc_id", text="text", item="item_id", item_text="text", window=WINDOW, most=BROADCAST_ROWS
):
    """``(doc_id, n_words, n_hit, items array<string>, hits array<struct<first, last>>, uid)`` of every row.

    ``hits`` are the covered runs of word numbers from 1, as whole windows in order; ``uid`` is
    a hash of the id and the text, never null.
    """
    windows = checkpointed(benchmark_windows(benchmark, item, item_text, window))
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most ``window`` values
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    parts = []
    for m in lengths:
        bench = windows.filter(F.col("m") == m)
        split = bench.select(F.split("window", " ").alias("w"))
        hashes, marks = fingerprints(F.col("w"), m)
        known = split.withColumn("hashes", hashes).select(F.explode(marks).alias("mark")).distinct()
        hashes, marks = fingerprints(F.col("w"), m)
        seen = rows.select("uid", words("text").alias("w")).withColumn("hashes", hashes)
        seen = seen.select("uid", F.explode(marks).alias("mark"))
        found = seen.join(checked_broadcast(known, most), "mark").groupBy("uid").agg(F.collect_set("mark").alias("marks"))
        candidates = checked_broadcast(found, most, F.size("marks"))
        near = rows.join(candidates, "uid").select("uid", "marks", words("text").alias("w")).dropDuplicates(["uid"])
        hashes, _ = fingerprints(F.col("w"), m)
        width = gram_width(m)
        marked = F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains("marks", h), i + 1)), lambda i: i.isNotNull()
        )
        # Every window of m words that covers a matched gram.
        covering = F.flatten(
            F.transform(
                marked,
                lambda i: F.sequence(F.greatest(F.lit(1), i - (m - width)), F.least(i, F.size("w") - (m - 1))),
            )
        )
        starts = F.array_distinct(F.when(F.size("w") >= m, covering).otherwise(F.array()))
        tried = near.select("uid", "w", F.explode(starts).alias("first"))
        tried = tried.select(
            "uid", "first", F.array_join(F.slice("w", F.col("first"), m), " ").alias("window")
        )
        hit = tried.join(checked_broadcast(bench.select("window", "items"), most, F.size("items")), "window")
        parts.append(hit.select("uid", "first", (F.col("first") + F.lit(m - 1)).alias("last"), "items"))
    schema = "uid long, hits array<struct<first:int,last:int>>, items array<string>"
    if parts:
        hits = parts[0]
        for more in parts[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("uid").agg(
            F.sort_array(F.collect_set(F.struct("first", "last"))).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    else:
        hits = documents.sparkSession.createDataFrame([], schema)
    counted = rows.select("uid", "doc_id", F.size(words("text")).cast("long").alias("n_words"))
    joined = counted.join(checked_broadcast(hits, most, F.size("hits") + F.size("items")), "uid", "left")
    # Runs overlap: each adds the words beyond the furthest one so far.
    covered = F.aggregate(
        F.coalesce("hits", F.array().cast("array<struct<first:int,last:int>>")),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h["last"] - F.greatest(acc["reach"], h["first"] - 1))).alias("n"),
            F.greatest(acc["reach"], h["last"]).alias("reach"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    return joined.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits",
        "uid",
    )
