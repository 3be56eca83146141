"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target number of words.  A document of a source gets ``target / words
of the source`` expected copies: the whole part for certain, the rest as an inclusion
probability.  The flight of the cube method moves these probabilities, three documents
at a time, along the null space of two constraints (number of documents, number of
words) until each is 0 or 1 but for at most two per block.  Blocks are dealt by a hash,
so a hot source has many of them.  What a block leaves open flies again with the rest of
other blocks, level by level, until each source has one block, where the landing drops
the word constraint first and the document constraint last.  What words the landing leaves
over or short in a source is then made up by one or two documents of fitting size.

Cases: null, empty and blank texts have size 0 and take no words.  Null is a source
of its own, after all others.  Rows that are equal in id, source and size are
interchangeable; each is drawn for itself.  Other columns are ignored.  Draws depend on
the rows and the seed only, not on the partitioning.  An empty table gives no rows.
"""

import math

import numpy as np
from pyspark.sql import functions as F

from assaykit.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
BLOCK = 2000  # documents per block, about
SEED = 11


def targets(sizes, weights=WEIGHTS, most=MOST_REPEATS):
    """Words each source should give, from ``{source: words}``: shares by weight, capped, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, target = float(sum(sizes.values())), list(order), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        share = {s: left * weight[s] / total for s in open_sources}
        above = [s for s in open_sources if share[s] > most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_sources = [s for s in open_sources if s not in target]
    return target


def fly(probability, size, rng, landing):
    """Probabilities moved to 0 or 1 with both totals held; at most two stay open unless ``landing``."""
    p = np.array(probability, float)
    nearly = 1e-9

    def step(units, u):
        up = min((1 - p[k]) / d if d > 0 else -p[k] / d for k, d in zip(units, u) if d)
        down = min(p[k] / d if d > 0 else (p[k] - 1) / d for k, d in zip(units, u) if d)
        move = up if rng.random() * (up + down) < down else -down
        for k, d in zip(units, u):
            p[k] += move * d
            p[k] = 0.0 if p[k] < nearly else 1.0 if p[k] > 1 - nearly else p[k]

    units = []
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        units.append(k)
        if len(units) == 3:
            a, b, c = (float(size[i]) for i in units)
            u = (b - c, c - a, a - b)
            scale = max(map(abs, u))
            step(units, [x / scale for x in u] if scale else (1.0, -1.0, 0.0))
            units = [i for i in units if 0 < p[i] < 1]
    if landing:
        if len(units) == 2:
            step(units, (1.0, -1.0))
            units = [i for i in units if 0 < p[i] < 1]
        for k in units:
            p[k] = float(rng.random() < p[k])
    return p


def _flight(rows, level, blocks, landing):
    """One level: ``rows`` with ``open`` moved; ``blocks`` maps a source's number to its block count."""
    counts = F.broadcast(rows.sparkSession.createDataFrame(list(blocks.items()), "sid int, blocks int"))
    block = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + level)), F.col("blocks"))

    def flown(key, frame):
        frame = frame.sort_values(["mark", "doc_id", "size"], kind="stable", na_position="first")
        rng = np.random.default_rng([SEED, level, int(key[0]), int(key[1])])
        frame["open"] = fly(frame["open"].to_numpy(), frame["size"].to_numpy(), rng, landing)
        return frame.drop(columns=["blocks", "block", "mark"])

    dealt = rows.join(counts, "sid").withColumns({"block": block, "mark": F.xxhash64("doc_id", F.lit(SEED))})
    return dealt.groupBy("sid", "block").applyInPandas(flown, rows.schema)


def _made_up(rows):
    """``rows`` with one document per source turned, where that brings the words nearer to the target."""
    short = rows.groupBy("sid").agg(
        (F.max("target") - F.sum((F.col("whole") + F.col("open")) * F.col("size"))).alias("short")
    )
    short = F.broadcast(checkpointed(short))  # a row per source
    gap = F.abs(F.abs("short") - F.col("size"))
    fits = (F.col("part") > 0) & (F.col("open") == (F.col("short") < 0).cast("double")) & (gap < F.abs("short"))
    best = (
        rows.join(short, "sid")
        .filter(fits)
        .groupBy("sid")
        .agg(F.min(F.struct(gap.alias("gap"), "doc_id", "size", "number")).alias("best"))
        .select("sid", F.col("best.number").alias("turned"))
    )
    turned = rows.join(F.broadcast(checkpointed(best)), "sid", "left")
    flip = F.coalesce(F.col("turned") == F.col("number"), F.lit(False))
    return turned.withColumn("open", F.when(flip, 1.0 - F.col("open")).otherwise(F.col("open"))).drop("turned")


def mix(documents, key="doc_id", text="text", source="source", weights=WEIGHTS, most=MOST_REPEATS, block=BLOCK):
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row."""
    rows = documents.select(
        F.col(key).cast("string").alias("doc_id"),  # in pandas, longs with nulls would turn into doubles
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # Numbers tell equal rows apart; which of them gets which number makes no difference.
    rows = checkpointed(rows.withColumn("number", F.monotonically_increasing_id()))
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    target = targets({t["source"]: t["words"] for t in totals}, weights, most)
    facts = []
    for number, t in enumerate(sorted(totals, key=lambda t: (t["source"] is None, t["source"] or ""))):
        copies = min(float(most), target[t["source"]] / t["words"]) if t["words"] else 0.0
        facts.append((number, t["source"], t["words"], target[t["source"]], int(math.floor(copies)), copies - math.floor(copies)))
    schema = "sid int, source string, source_size long, target double, whole int, part double"
    sources = F.broadcast(spark.createDataFrame(facts, schema))  # a row per source
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
    joined = joined.select("sid", "doc_id", "number", rows["source"], "size", "source_size", "target", "whole", "part", F.col("part").alias("open"))
    counts = {f[0]: t["n"] for f in facts for t in totals if t["source"] == f[1]}
    settled, level = [], 0
    while counts:
        blocks = {sid: max(1, math.ceil(n / block)) for sid, n in counts.items()}
        landing = max(blocks.values()) == 1
        flown = checkpointed(_flight(joined, level, blocks, landing))
        done = (F.col("open") == 0) | (F.col("open") == 1)
        settled.append(flown.filter(done))
        if landing:
            break
        joined = flown.filter(~done)
        counts = {r["sid"]: r["n"] for r in joined.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
        level += 1
    out = settled[0] if settled else joined
    for more in settled[1:]:
        out = out.unionByName(more)
    for _ in range(2):
        out = _made_up(out)
    copies = F.col("whole") + F.col("open").cast("int")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
