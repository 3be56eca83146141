"""Near duplicates by Jaccard similarity of word shingles: MinHash bands name candidates, whole sets decide.

The set of a text is that of its runs of ``width`` words (A-Z lower-cased, cut at ASCII
blanks), or the whole text if it has fewer.  Texts that share a band of MinHash values
form candidate groups; inside a group any two texts are compared by their whole sets, in
blocks, unless they are already linked.  So no link is wrong, and a pair of similarity
``s`` is missed with probability ``(1 - s ** ROWS) ** BANDS`` at most: 0.0023 at 0.8.

SimHash cannot serve here: at a similarity of 0.8 about 10 of 64 bits differ, and
segments that leave one untouched are too short to be keys.

Cases: null, empty and blank texts have the empty text as only shingle and are copies of
each other.  A component is named by its smallest ``doc_id``, null if it has none.
Other columns are ignored.  An empty table gives no rows.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from assaykit.llm.common import Forest, blocks, checked_broadcast, few, hot_lookup, whole_groups
from assaykit.operators.components import connected_components
from assaykit.session import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 6
SEED = 42
BLOCK = 1024
CHUNK = 1024  # shingles looked at by all MinHash functions at a time


def shingles(text, width=SHINGLE, seed=SEED):
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode().lower().split()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) < width:
        return np.array([digest(b" ".join(words))], np.uint64)
    return np.unique(np.array([digest(b" ".join(run)) for run in zip(*(words[k:] for k in range(width)))], np.uint64))


def band_keys(found, bands=BANDS, rows=ROWS, seed=SEED):
    """A signed 64-bit key per band of the MinHash values of a set."""
    draw = np.random.default_rng(seed)
    times = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 2**63, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[start : start + CHUNK, None] * times + plus).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(bands, rows))]
    return np.array(keys, np.uint64).view(np.int64)


def similar(sets, similarity=SIMILARITY):
    """Links ``(i, j)`` that connect all sets of at least that Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    parts = [codes[a:b] for a, b in zip(ends - sizes, ends)]
    seen = np.zeros(codes.max() + 1, bool)
    forest = Forest(len(sets))
    for i in range(len(sets) - 1):
        roots = forest.roots(np.arange(len(sets)))
        fits = np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
        others = i + 1 + np.flatnonzero((fits & (roots != roots[i]))[i + 1 :])
        if not len(others):
            continue
        seen[parts[i]] = True
        common = np.array([np.count_nonzero(seen[parts[j]]) for j in others])
        seen[parts[i]] = False
        near = others[common >= similarity * (sizes[others] + sizes[i] - common) - 1e-9]
        forest.join(np.full(len(near), i), near)
    return forest.links


def near_duplicates(documents, key="doc_id", text="text", width=SHINGLE, similarity=SIMILARITY, bands=BANDS, rows=ROWS, block=BLOCK, candidates=None):
    """``(doc_id, text_key, component, component_id)`` of every row; ``component`` is never null.

    ``candidates``, pairs ``(a, b)`` of text keys (``xxhash64`` of the text) that another method linked, are decided by
    the whole sets as those of the bands are.
    """

    def cut(batches):
        for batch in few(batches, 1):
            keys = [band_keys(shingles(t, width), bands, rows) for t in batch.column(1).to_pylist()]
            marks = np.repeat(batch.column(0).to_numpy(), bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(flat, pa.int64())], names=["text_key", "band"])

    def hashed(batches):
        for batch in few(batches, 2):
            sets = pa.array([shingles(t, width).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], names=["component", "text_key", "found"])

    def linked(batches):
        for table, ids in whole_groups(batches, group):
            marks = table.column("text_key").to_numpy()
            found = table.column("found")
            links = []
            for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                links += [(marks[at[i]], marks[at[j]]) for i, j in similar([np.frombuffer(found[k].as_buffer(), np.uint64) for k in at.tolist()], similarity)]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    texts = documents.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    keyed = checkpointed(texts.mapInArrow(cut, "text_key long, band long"))
    first = keyed.groupBy("band").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z"), F.count(F.lit(1)).alias("n"))
    met = hot_lookup(keyed, first.filter("a <> z").select("band", "a", "n"), ["band"], "n", how="inner")
    met = met.filter("text_key <> a").select("a", F.col("text_key").alias("b"))
    if candidates is not None:
        met = met.unionByName(candidates.select("a", "b"))
    met = checkpointed(met.distinct())
    grouped = connected_components(met).select("component", F.col("node").alias("text_key"))
    tried = texts.join(checked_broadcast(grouped), "text_key").select("component", "text_key", "text").dropDuplicates(["text_key"])
    sets = checkpointed(tried.mapInArrow(hashed, "component long, text_key long, found binary"))
    dealt, group = blocks(sets, ["component"], "text_key", block)
    links = checkpointed(dealt.select("text_key", "found", *group).mapInArrow(linked, "a long, b long"))
    named = connected_components(links).select(F.col("node").alias("text_key"), "component")
    given = documents.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    codes = given.groupBy("text_key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    codes = checkpointed(codes.join(named, "text_key", "left").withColumn("component", F.coalesce("component", "text_key")))
    heads = codes.groupBy("component").agg(F.min("head").alias("component_id"))
    codes = codes.join(heads, "component").select("text_key", "n", "component", "component_id")
    return hot_lookup(given, codes, ["text_key"], "n").select("doc_id", "text_key", "component", "component_id")
