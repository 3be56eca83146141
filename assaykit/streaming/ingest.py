"""Structured Streaming ingestion of CSV folders."""

from pyspark.sql import functions as F

from assaykit.operators.perturb import hash_selected
from assaykit.sources.ledger import below, decoded


def csv_stream(spark, folder, schema, files_per_batch=None):
    """A stream over the CSV files of a folder; each file is read once.

    ``source_file`` is a file's path below the folder, so equal names in two folders stay apart.
    """
    reader = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
    reader = reader.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).withColumn("source_file", below(spark, folder, decoded(F.col("_metadata.file_path"))))


def ingest_available(spark, folder, target, state, schema, transform=None, files_per_batch=None):
    """Append the files that arrived since the last run and return when they are written.

    ``state`` is the stream's checkpoint folder.  ``transform`` may be any stateless
    operator of this package, such as ``labelled_rows`` or ``stamp``.
    """
    stream = csv_stream(spark, folder, schema, files_per_batch)
    stream = transform(stream) if transform else stream
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", state)
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)


def running_selection(stream, label, key, rate, seed=42, positive=1):
    """Running counts of class and selected rows; the state is one row per label."""
    return stream.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(hash_selected(label, key, rate, seed, positive)).alias("selected_rows"),
    )
