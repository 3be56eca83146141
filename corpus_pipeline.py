"""A corpus pipeline in five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; helper columns of a stage do not leave it.  Null and empty texts go with
language identification, as they have no language.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.llm import language_id, minhash, mixing, pii, simhash, winnowing
from assaykit.llm.common import checked_broadcast, read
from assaykit.session import checkpointed, ensure_checkpoint_dir, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SURE = 0.5  # of the language


def identify_language(spark, docs, sf_dir):
    """Rejects documents without letters, of no likely language, and those whose words no learned language is made of."""
    small_batches(spark)
    model = language_id.fit(language_id.training(docs))
    shared = spark.sparkContext.broadcast(model)
    usual = language_id.least_familiar(docs, model, shared=shared)
    found = language_id.with_language(docs.select(*COLUMNS), model, shared=shared)
    likely = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SURE)
    return found.filter(likely & usual).select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each component of near copies (five-word shingles, Jaccard 0.8 or more) stays.

    That is the first by id and text; rows without an id come last.  SimHash fingerprints linked by pigeonring chains
    name candidates, and bands of MinHash values those that differ in more bits; whole shingle sets decide on both.
    """
    small_batches(spark)
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text")
    linked = simhash.near_duplicates(texts, key="text_key").filter("doc_id <> component_id")
    linked = linked.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    found = checkpointed(minhash.near_duplicates(docs, candidates=linked))
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    shared = found.join(checked_broadcast(several), "component").select("text_key", "component").distinct()
    shared = checked_broadcast(shared)
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "lang", "source", "n_chars")
    first = keyed.join(shared, "text_key").groupBy("component").agg(F.min_by(F.struct(*COLUMNS), place).alias("row"))
    return keyed.join(shared, "text_key", "left_anti").select(*COLUMNS).unionByName(first.select("row.*"))


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    found = winnowing.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select("uid").distinct()
    keyed = docs.select(*COLUMNS).withColumn("uid", F.xxhash64("doc_id", "text"))
    return keyed.join(checked_broadcast(hit), "uid", "left_anti").select(*COLUMNS)


def redact_pii(spark, docs, sf_dir):
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    candidates = checkpointed(pii.with_candidates(docs.select("doc_id", "text")).drop("text"))
    spans = pii.with_spans(pii.with_candidates(docs.select(*COLUMNS)), pii.fit(candidates))
    clean = spans.withColumn("text", F.when(F.size("spans") > 0, pii.redacted("text", F.col("spans"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """The documents that the mix takes, with the number of copies and the words taken."""
    mixed = mixing.mix(docs).filter("copies > 0")
    same = ["doc_id", "source", "size"]
    # Rows equal in id, source and size are interchangeable: the n-th meets the n-th.
    taken = mixed.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("copies"))))
    sized = docs.select(*COLUMNS).withColumn(
        "size", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    )
    sized = sized.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("text"))))
    match = (
        sized["doc_id"].eqNullSafe(taken["doc_id"])
        & sized["source"].eqNullSafe(taken["source"])
        & (sized["size"] == taken["size"])
        & (sized["place"] == taken["place"])
    )
    joined = sized.join(taken, match)
    return joined.select(
        *(sized[c] for c in COLUMNS), sized["size"], taken["source_size"], taken["target"], taken["copies"], taken["taken"]
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

# Language models, MinHash and cube sampling are beyond SQL; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over ``documents``; every result is written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
