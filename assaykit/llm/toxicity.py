"""Toxicity by a counterfactually regularised classifier.

Features are the distinct words of a text and their first letters (4 and 5), so that one
toxic word counts the same in a short and in a very long text.  A logistic model is
fitted on labelled rows.  Each training text that names an identity group is also read
with its identity terms swapped for those of another group, and the squared change of
the logit is penalised; a neutral mention of a group then cannot move the score by much.

The fit uses at most ``SAMPLE`` labelled rows, the first by a hash of the id, and at most
``FEATURES`` features, the most telling ones; both are parameters.  Scoring reads every
whole text.

Cases: null and empty texts are scored from the intercept alone; without labelled rows
of both classes every score is the smoothed share of label 1.  Labels that are null are
not learned from.  Repeated rows are scored each.  Other columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assaykit.llm.common import checked_broadcast
from assaykit.session import checkpointed

SAMPLE = 20_000
FEATURES = 4096
LEAST_TEXTS = 4  # training texts a feature must be in
FAIRNESS = 4.0
RIDGE = 2.0
STEPS = 500
SEED = 5
TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
# Identity terms by group, swapped within an axis in turn.
IDENTITY = (
    (("woman", "women", "girl", "female", "she", "her"), ("man", "men", "boy", "male", "he", "his")),
    (("muslim", "muslims", "islam"), ("christian", "christians", "christianity"), ("jew", "jews", "judaism")),
    (("black", "blacks"), ("white", "whites"), ("asian", "asians")),
    (("gay", "gays"), ("straight", "straights"), ("lesbian", "lesbians")),
    (("immigrant", "immigrants"), ("native", "natives")),
    (("frau", "frauen"), ("mann", "männer")),
    (("femme", "femmes"), ("homme", "hommes")),
    (("mujer", "mujeres"), ("hombre", "hombres")),
)
SWAP = {
    word: axis[(g + 1) % len(axis)][min(i, len(axis[(g + 1) % len(axis)]) - 1)]
    for axis in IDENTITY
    for g, group in enumerate(axis)
    for i, word in enumerate(group)
}


def features(text, swap=False):
    """The distinct features of a text, with identity terms swapped on request."""
    words = set(TOKEN.findall((text or "").lower()))
    if swap:
        words = {SWAP.get(w, w) for w in words}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}


def training_rows(documents, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE):
    """``(label, features, swapped)`` of the labelled rows drawn; ``swapped`` is null where nothing changes."""
    drawn = (
        labels.filter(F.col(label).isNotNull())
        .select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "label")
        .limit(sample)
    )
    texts = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def extracted(batches):
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            plain = [sorted(features(t)) for t in bodies]
            swapped = [sorted(features(t, True)) for t in bodies]
            other = [s if s != p else None for p, s in zip(plain, swapped)]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, kind), pa.array(other, kind)], names=["label", "features", "swapped"]
            )

    joined = texts.join(F.broadcast(checked_broadcast(drawn, sample)), "doc_id").select("label", "text")
    return joined.mapInArrow(extracted, "label int, features array<string>, swapped array<string>")


def chosen_features(rows, most=FEATURES, least=LEAST_TEXTS):
    """The features whose log odds between the labels stand out most, and the label counts."""
    base = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = base.get(1, 0), base.get(0, 0)
    if not ones or not zeros:
        return [], ones, zeros
    seen = rows.select("label", F.explode("features").alias("feature")).groupBy("feature")
    counts = seen.agg(F.sum((F.col("label") == 1).cast("long")).alias("a"), F.sum((F.col("label") == 0).cast("long")).alias("b"))
    p, q = (F.col("a") + 0.5) / (ones + 1.0), (F.col("b") + 0.5) / (zeros + 1.0)
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    telling = F.abs(F.log(p / q)) / spread
    top = counts.filter(F.col("a") + F.col("b") >= least).orderBy(telling.desc(), "feature").limit(most)
    return [r["feature"] for r in top.select("feature").collect()], ones, zeros


def logistic(rows, others, y, width, start, fairness=FAIRNESS, ridge=RIDGE, steps=STEPS):
    """Weights and intercept for sparse binary rows, by accelerated gradient steps.

    Rows of label 1 weigh more, by the square root of how much rarer they are.

    ``rows`` is ``(row numbers, feature numbers)``; ``others`` is the signed change of the
    features under the swap, ``(row numbers, feature numbers, signs)``.
    """
    at, feature = rows
    far, changed, sign = others
    n = len(y)
    swapped = len(np.unique(far))
    weight = np.where(y == 1, np.sqrt(max(1.0, (n - y.sum()) / max(1.0, y.sum()))), 1.0)

    def moved(w):
        return np.bincount(far, sign * w[changed], minlength=n) if swapped else np.zeros(n)

    def curvature(w, b):
        z = weight * (np.bincount(at, w[feature], minlength=n) + b) / (4 * n)
        down = np.bincount(feature, z[at], minlength=width) + ridge / n * w
        if swapped:
            down += np.bincount(changed, sign * (2 * fairness / swapped * moved(w))[far], minlength=width)
        return down, z.sum()

    w, b, top = np.ones(width), 1.0, 1.0
    for _ in range(50):  # the largest curvature bounds the step
        w, b = curvature(w, b)
        top = np.sqrt(w @ w + b * b)
        w, b = w / top, b / top
    rate = 1.0 / (1.05 * top)
    w, b = np.zeros(width), start
    ahead_w, ahead_b, speed = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(at, ahead_w[feature], minlength=n) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / n
        slope = np.bincount(feature, error[at], minlength=width) + ridge / n * ahead_w
        if swapped:
            slope += np.bincount(changed, sign * (2 * fairness / swapped * moved(ahead_w))[far], minlength=width)
        new_w, new_b = ahead_w - rate * slope, ahead_b - rate * error.sum()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead_w, ahead_b = new_w + (speed - 1) / faster * (new_w - w), new_b + (speed - 1) / faster * (new_b - b)
        w, b, speed = new_w, new_b, faster
    return w, b


def fit(documents, labels, key="doc_id", text="text", label="toxic", sample=SAMPLE, most=FEATURES, fairness=FAIRNESS):
    """``{"weights": {feature: weight}, "intercept": ...}`` from the labelled rows."""
    rows = checkpointed(training_rows(documents, labels, key, text, label, sample))
    names, ones, zeros = chosen_features(rows, most)
    start = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if not names:
        return {"weights": {}, "intercept": start}
    index = {name: i for i, name in enumerate(names)}

    def numbered(batches):
        for batch in batches:
            own = [[index[f] for f in row if f in index] for row in batch.column(1).to_pylist()]
            swapped = [None if row is None else [index[f] for f in row if f in index] for row in batch.column(2).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, kind), pa.array(swapped, kind)], names=["y", "own", "swapped"])

    drawn = rows.mapInArrow(numbered, "y int, own array<int>, swapped array<int>").toArrow().to_pylist()
    drawn.sort(key=lambda r: (r["y"], r["own"]))
    at = np.array([i for i, r in enumerate(drawn) for _ in r["own"]], np.int64)
    feature = np.array([f for r in drawn for f in r["own"]], np.int64)
    change = [
        (i, f, s)
        for i, r in enumerate(drawn)
        if r["swapped"] is not None
        for s, some in ((1.0, set(r["swapped"]) - set(r["own"])), (-1.0, set(r["own"]) - set(r["swapped"])))
        for f in sorted(some)
    ]
    far, changed, sign = (np.array([c[k] for c in change], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    y = np.array([r["y"] for r in drawn], float)
    w, b = logistic((at, feature), (far, changed, sign), y, len(names), start, fairness)
    return {"weights": {name: float(w[i]) for name, i in index.items() if w[i]}, "intercept": float(b)}


def score(documents, model, text="text", to="score", keep=()):
    """``keep`` columns and the score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES
    names = [*keep, to]

    def scored(batches):
        weights, intercept = shared.value["weights"], shared.value["intercept"]
        for batch in batches:
            z = np.full(batch.num_rows, intercept)
            for i, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                # In a fixed order, so that sums do not depend on the worker.
                z[i] += sum(sorted(weights[f] for f in features(body) & weights.keys()))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=names)

    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"{to} double"])
    return rows.mapInArrow(scored, schema)
