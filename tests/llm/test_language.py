"""Texts are handled in bounded portions, and unseen words together, against plain Python versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assaykit.llm import common, language_id


def test_texts_are_taken_in_slices_of_bounded_bytes(monkeypatch):
    """Long texts are not taken out of Arrow together; every row comes once, in order."""
    monkeypatch.setattr(common, "TEXTS", 4)
    monkeypatch.setattr(common, "TEXT_BYTES", 100)
    texts = ["é" * 40, "a" * 30, None, "", "b" * 500, "c", *"defghij"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["n", "text"])
    slices = [s.column(1).to_pylist() for s in common.few([batch, batch.slice(0, 0)], 1)]
    assert slices == [["é" * 40], ["a" * 30, None, ""], ["b" * 500], ["c", "d", "e", "f"], ["g", "h", "i", "j"]]


def test_unseen_words_together(monkeypatch):
    """Scores of unseen words, all at once, are the means over places of the longest known n-grams."""
    draw = random.Random(3)
    entries = {"".join(draw.choices(" abcé", k=draw.randint(1, 4))) for _ in range(150)}
    index = {"\0" + e: i for i, e in enumerate(sorted(entries))}
    table = np.random.default_rng(3).normal(size=(len(index), 3)).astype(np.float32)
    model = {"languages": ["x", "y", "z"], "index": index, "table": table, "tree": language_id.gram_tree(index, 4)}
    words = ["".join(draw.choices("abcéq", k=draw.randint(1, 12))) for _ in range(200)]
    monkeypatch.setattr(language_id, "PLACES", 50)
    scores, shares = language_id.backed_off(words, model)
    for word, score, share in zip(words, scores, shares):
        padded, rows, near = f" {word} ", [], 0
        for i in range(len(padded)):
            known = [k for k in range(1, min(4, len(padded) - i) + 1) if padded[i : i + k] in entries]
            if known:
                rows.append(index["\0" + padded[i : i + known[-1]]])
                near += known[-1] >= min(language_id.FAMILIAR, len(padded) - i)
        want = table[rows].mean(axis=0, dtype=np.float64) if rows else np.zeros(3)
        assert np.allclose(score, want) and share == near / len(padded)


def test_usual_familiarity_is_that_of_all_texts(spark, monkeypatch):
    """Over 5,000 texts of one language that were not learned from: all of them tell the mean and the deviation."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.format_string("word abc%d", "id").alias("text"))
    docs = docs.unionByName(docs.limit(1).select("doc_id", "lang", F.lit(None).cast("string").alias("text")))
    model = language_id.fit(language_id.training(docs), words=100, grams=100)
    seen = []
    scored = language_id.with_language
    monkeypatch.setattr(language_id, "with_language", lambda texts, *given, **named: seen.append(texts) or scored(texts, *given, **named))
    language_id.least_familiar(docs, model)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(30_000))
    assert held > 5000 and [t.count() for t in seen] == [held]
