"""Reading and writing feature tables, scores, predictions and metrics."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.rows import require_columns

HOLDOUT_NAME = "auto_holdout"


def read_csv(spark, path, schema=None, columns=None, sampling=1.0, strict=False, glob=None):
    """A CSV table with a header line.

    With a schema nothing is read twice; otherwise the types are inferred from the
    given share of the rows.  ``columns`` prunes the scan.  ``strict`` fails on a
    malformed line instead of keeping what can be read of it.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", sampling)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def csv_columns(spark, path):
    """Column names of a CSV table from its header alone."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_parquet(spark, path, columns=None):
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df, path, mode="overwrite", rows_per_file=None, block_bytes=128 << 20, partition_by=None,
                  replace_partitions=False):
    """Zstandard-compressed Parquet with bounded row groups and, optionally, bounded files.

    ``replace_partitions`` overwrites only the partitions that ``df`` has rows for.
    """
    writer = df.write.mode(mode).option("compression", "zstd").option("parquet.block.size", block_bytes)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_csv(df, path, mode="overwrite"):
    """A folder of CSV parts, each with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_metrics(metrics, path):
    """``Metric,Value`` in one part; the table has a row per metric."""
    metrics.select(F.col("metric").alias("Metric"), F.col("value").alias("Value")).coalesce(1).write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def resolve_dataset(spark, folder, name=None, pattern="*.parquet", optional=False):
    """Path of the named dataset, else the first by name that fits the pattern.

    Hidden entries and the automatic hold-out are never picked by pattern.
    """
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = path_class(folder)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if name is not None and files.exists(path_class(base, name)):
        return path_class(base, name).toString()
    found = files.globStatus(path_class(base, pattern)) or []
    names = sorted(
        s.getPath().getName()
        for s in found
        if not s.getPath().getName().startswith((".", "_")) and HOLDOUT_NAME not in s.getPath().getName()
    )
    if names:
        return path_class(base, names[0]).toString()
    if optional:
        return None
    raise FileNotFoundError(f"no dataset {name or pattern} in {folder}")


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("data_row", T.LongType()),
        T.StructField("csv_row", T.LongType()),
        T.StructField("original_label", T.IntegerType()),
        T.StructField("modified_label", T.IntegerType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("trigger_applied", T.BooleanType()),
        T.StructField("trigger_features", T.StringType()),
        T.StructField("trigger_values", T.StringType()),
    ]
)
MANIFEST_REQUIRED = ("row_idx", "original_label", "modified_label")


def write_manifest(manifest, path):
    manifest.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_manifest(spark, path):
    """The manifest, checked to be non-empty and to have its required columns."""
    header = spark.read.option("header", True).option("escape", '"').csv(path)
    require_columns(header, MANIFEST_REQUIRED)
    known = {f.name: f.dataType for f in MANIFEST_SCHEMA}
    typed = header.select(*[F.col(c).try_cast(known.get(c, T.StringType())).alias(c) for c in header.columns])
    if typed.isEmpty():
        raise ValueError("the manifest holds no rows")
    return typed
