"""Trigger records and run summaries as JSON."""

from pyspark.sql import functions as F

TRIGGER_SCHEMA = (
    "version string, attack string, feature_columns array<string>, values map<string,double>, "
    "value_mode string, seed bigint"
)


def read_triggers(spark, path):
    """Trigger records, one per file, with a ``problem`` that is null for a usable one."""
    return with_problem(spark.read.schema(TRIGGER_SCHEMA).option("multiLine", True).json(path))


def parse_triggers(df, column):
    """Trigger records held as JSON text in ``column``."""
    parsed = F.from_json(F.col(column), TRIGGER_SCHEMA)
    return with_problem(df.withColumn("_t", parsed).select(*df.columns, "_t.*"))


def with_problem(triggers):
    """What keeps a record from being used: missing parts or columns without a value."""
    missing = F.array_except("feature_columns", F.coalesce(F.map_keys("values"), F.array().cast("array<string>")))
    return triggers.withColumn(
        "problem",
        F.when(F.col("feature_columns").isNull(), F.lit("no feature_columns"))
        .when(F.col("values").isNull(), F.lit("no values"))
        .when(F.size("feature_columns") == 0, F.lit("empty feature_columns"))
        .when(F.size(missing) > 0, F.concat(F.lit("no value for "), F.array_join(F.array_sort(missing), ","))),
    )


def load_trigger(spark, path):
    """``{feature: value}`` in the order of the record; an error when it is unusable."""
    record = read_triggers(spark, path).first()
    if record is None:
        raise ValueError("no trigger record")
    if record["problem"] is not None:
        raise ValueError(record["problem"])
    return {c: record["values"][c] for c in record["feature_columns"]}


def write_json(df, path):
    """Small records, such as a trigger or a run summary, as one JSON part."""
    df.coalesce(1).write.mode("overwrite").json(path)
