"""A scan that is fitted once, kept, and scores new rows without the old ones.

The state holds what the detectors learned: medians and scales, the nodes of the isolation forest, the
counts of every vector, and the range of each detector's scores.  It is a folder with a numbered
subfolder per fit, which appears at once when it is complete:

    v000001/state.json    everything of bounded size
    v000001/vectors/      a row per different vector: its digest, rows, and range of labels
"""

import base64
import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from assaykit.functions.scalars import finite_or_null
from assaykit.functions.vectors import impute
from assaykit.operators.combine import EVIDENCE_ONLY, mean_of_evidence, stack_scores
from assaykit.operators.exact_duplicates import group_score, keyed_rows, label_range, mixed_labels
from assaykit.operators.forest import IsolationForest, fit_forest
from assaykit.operators.outliers import deviation_scores, sn_scale
from assaykit.operators.rows import SUSPICION_THRESHOLD, canonical, column_medians, finite_medians, keep_unsuspicious
from assaykit.operators.skew import lookup_join
from assaykit.session import checkpointed

DETECTORS = ("statistical", "isolation_forest", "duplicate")
BROADCAST_VECTORS = 1_000_000
_NODES = {"roots": "int32", "feature": "int32", "threshold": "float64", "child": "int32", "path": "float64"}


@dataclass
class FittedScan:
    """The state of a scan; ``vectors`` is the folder of the counted vectors."""

    detectors: list
    features: object  # names, or the name of an array column
    label: str
    medians: list
    scales: list
    fills: list
    forest: object
    ranges: dict  # detector -> (least, greatest) finite score of the fitted table
    rows: int
    vectors: str


def _by_position(frame, value, width):
    found = {r["pos"]: r[value] for r in frame.collect()}
    return [found.get(i) for i in range(width)]


def _floats(values):
    return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])


def _contents(rows):
    """Digests of the vectors, short or long ones alike: they are kept."""
    return keyed_rows(rows, wide=True)


def fit_scan(df, key, label, features, path, detectors=DETECTORS, seed=42):
    """Fits ``detectors`` on ``df``, writes the state as the next version below ``path``, and returns it."""
    unknown = set(detectors) - set(DETECTORS)
    if unknown or not detectors:
        raise ValueError(f"detectors that cannot be kept: {sorted(unknown)}")
    rows = checkpointed(canonical(df, key, label, features))
    first = rows.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    width = first[0]
    fills = _by_position(finite_medians(rows), "median", width)
    spark, name = df.sparkSession, f"_{uuid.uuid4().hex}"
    state = FittedScan(list(detectors), features, label, [], [], fills, None, {}, rows.count(), f"{path}/{name}/vectors")
    if "statistical" in detectors:
        state.medians = _by_position(column_medians(rows), "median", width)
        state.scales = _by_position(sn_scale(rows, seed=seed), "sn", width)
    if "isolation_forest" in detectors:
        state.forest = fit_forest(_filled(rows, fills), seed=seed)
    if "duplicate" in detectors:
        counts = _contents(rows).filter(F.col("content").isNotNull()).groupBy("content").agg(
            F.count(F.lit(1)).alias("members"), *label_range()
        )
        counts.write.option("compression", "zstd").parquet(state.vectors)
    stacked = checkpointed(stack_scores(_raw(rows, state, members=True)))
    finite = finite_or_null("score")
    spans = stacked.groupBy("detector").agg(F.min(finite).alias("low"), F.max(finite).alias("high")).collect()
    state.ranges = {r["detector"]: [r["low"], r["high"]] for r in spans}
    return _save(spark, state, path, name)


def _filled(rows, fills):
    return rows.withColumn("features", impute(F.col("features"), _floats(fills)))


def _raw(rows, state, members):
    """The detectors' scores of canonical rows.  ``members`` says that the rows are those of the fitted table."""
    found = {}
    if "statistical" in state.detectors:
        found["statistical"] = deviation_scores(rows.withColumns({"medians": _floats(state.medians), "scales": _floats(state.scales)}))
    if "isolation_forest" in state.detectors:
        found["isolation_forest"] = state.forest.score(_filled(rows, state.fills))
    if "duplicate" in state.detectors:
        found["duplicate"] = _duplicates(rows, state, members)
    return found


def _duplicates(rows, state, members):
    """A new row joins the group of its vector; several equal new rows are not counted together."""
    keyed = _contents(rows)
    counts = rows.sparkSession.read.parquet(state.vectors)
    known = keyed.filter(F.col("content").isNotNull())
    asked = known.groupBy("content").agg(F.count(F.lit(1)).alias("asked"))
    asked = checkpointed(asked)
    # The kept counts are read, not shuffled, as long as the new vectors are few.
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_VECTORS else asked
    seen = counts.join(asked, "content")
    scored = lookup_join(known, seen.withColumnRenamed("members", "held"), "content", "asked")
    if members:
        joined = scored.withColumn("members", F.col("held"))
    else:
        code, one = F.xxhash64("label"), F.col("label").isNotNull().cast("int")
        joined = scored.withColumns(
            {
                "members": F.col("held") + 1,
                "low_label": F.when(F.col("label").isNotNull(), F.least("low_label", code)).otherwise(F.col("low_label")),
                "high_label": F.when(F.col("label").isNotNull(), F.greatest("high_label", code)).otherwise(F.col("high_label")),
                "labelled": F.col("labelled") + one,
            }
        )
    score = F.when(F.col("members") > 1, group_score(F.col("members"), mixed_labels("members"))).otherwise(0.0)
    found = joined.select("row_id", F.coalesce(score, F.lit(0.0)).alias("score"))
    return found.unionByName(keyed.filter(F.col("content").isNull()).select("row_id", F.lit(0.0).alias("score")))


def score_new(df, key, state, members=False):
    """``(row_id, score, n_detectors, <one column per detector>)`` of rows by a fitted state.

    Scores are scaled by the ranges of the fitted table; one beyond them counts as 0 or 1.  A label that the
    state was fitted with may be missing from ``df``.  With ``members`` the rows are taken for those the state was
    fitted on, and get the scores they had.
    """
    label = state.label if state.label in df.columns else None
    rows = canonical(df, key, label, state.features)
    if label is None and state.label:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    # One grouping brings the detectors together.
    stacked = stack_scores(_raw(rows, state, members))
    wide = stacked.groupBy("row_id").agg(*[F.max(F.when(F.col("detector") == d, F.col("score"))).alias(d) for d in state.detectors])
    for d in state.detectors:
        low, high = state.ranges[d]
        if low is None:
            wide = wide.withColumn(d, F.lit(None).cast("double"))
            continue
        unit = F.lit(0.0) if low == high else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(d) - low) / (high - low)))
        wide = wide.withColumn(d, F.when(finite_or_null(d).isNotNull(), unit))
    evidence = [F.nullif(F.col(d), F.lit(0.0)) if d in EVIDENCE_ONLY else F.col(d) for d in state.detectors]
    return mean_of_evidence(wide, evidence).select("row_id", "score", "n_detectors", *state.detectors)


def clean_stream(stream, key, state, target, checkpoint, threshold=SUSPICION_THRESHOLD):
    """A query that scores the batches of a stream and appends their unsuspicious rows to ``target``."""

    def scored(batch, number):
        scores = score_new(batch, key, state).select(F.col("row_id").alias(key), F.col("score").alias("_suspicion"))
        kept = keep_unsuspicious(batch.join(scores, key), "_suspicion", threshold).select(*batch.columns)
        # A batch that is repeated after a failure replaces what it wrote before.
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Keeping the state

def _files(spark, name):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_versions(spark, path):
    """Numbers of the complete states below ``path``."""
    folder, files = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _save(spark, state, path, name):
    told = {k: getattr(state, k) for k in ("detectors", "features", "label", "medians", "scales", "fills", "ranges", "rows")}
    forest = state.forest
    if forest is not None:
        told["forest"] = {k: base64.b64encode(getattr(forest, k).astype(t).tobytes()).decode() for k, t in _NODES.items()}
        told["forest"] |= {"width": forest.width, "sample": forest.sample, "depth": forest.depth}
    text, files = _files(spark, f"{path}/{name}/state.json")
    out = files.create(text, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    number = max(state_versions(spark, path), default=0) + 1
    final = f"{path}/v{number:06d}"
    if not files.rename(_files(spark, f"{path}/{name}")[0], _files(spark, final)[0]):
        raise RuntimeError(f"the state could not be put at {final}")
    state.vectors = f"{final}/vectors"
    return state


def load_scan(spark, path, version=None):
    """The state of a version, the last one by default."""
    numbers = state_versions(spark, path)
    if not numbers or (version is not None and version not in numbers):
        raise FileNotFoundError(f"no state {version or ''} in {path}")
    folder = f"{path}/v{version or numbers[-1]:06d}"
    told = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/state.json").collect()))
    forest = told.pop("forest", None)
    if forest is not None:
        arrays = {k: np.frombuffer(base64.b64decode(forest[k]), t) for k, t in _NODES.items()}
        forest = IsolationForest(**arrays, **{k: forest[k] for k in ("width", "sample", "depth")})
    return FittedScan(forest=forest, vectors=f"{folder}/vectors", **told)
