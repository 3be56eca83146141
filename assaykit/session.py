"""Session set-up for tests, benches and small machines, and the shared folder for cut lineage."""

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus="*", shuffle_partitions=8, app="assaykit"):
    """A local session with the settings the operators are tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark):
    """Point checkpoints at the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster an
    executor could not read what another one wrote there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
    elif current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-checkpoint-"))


def checkpointed(df):
    """``df`` written once to the shared checkpoint folder, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark, rows=1000):
    """From now on the session hands Python ``rows`` rows at a time at most, as rows of whole texts take much memory.

    Batches of 10,000 texts stand in buffers of the executor and of Python, on the way there and back.  A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def with_number(df, name):
    """``df`` with a unique integer ``row_id``: the column ``name`` itself where that is an integer,
    else a number given to the rows, which are written first so that it stays the same."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return df.withColumn("row_id", F.col(name).cast("bigint"))
    return checkpointed(df.withColumn("row_id", F.monotonically_increasing_id()))


def spread_small(df):
    """A scan of few files over all cores; a no-op for a table that has more splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def path_exists(name, spark=None):
    """Whether a file or folder of that name exists in its file system."""
    context = (spark or SparkSession.getActiveSession()).sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def delete_folder(spark, name):
    """Deletes a folder with all it holds, in its file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
