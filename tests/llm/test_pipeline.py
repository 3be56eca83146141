"""The stages of the corpus pipeline on planted rows, against plain Python."""

import os
import random
import sys
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from assaykit.llm import minhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard_components(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return brute.components(range(len(texts)), links)


def near_texts():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        words = draw.choices(vocabulary, k=150)
        for changed in (0, 1, 2, 4):
            copy = list(words)
            for at in draw.sample(range(150), changed):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[1].upper(), "", None, " \n", "a b", "a  b", "a c"]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies(spark, block):
    """Copies with a few changed words are found, and nothing below the similarity."""
    texts = near_texts()
    want = jaccard_components(texts)
    assert 40 < len(set(want.values())) < len(texts) - 50
    rows = minhash.near_duplicates(table(spark, enumerate(texts)), block=block).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert minhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_near_stage_keeps_first(spark):
    texts = near_texts()
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, enumerate(texts)), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(jaccard_components(texts).values()))


def test_near_stage_uses_simhash(spark, monkeypatch):
    """Without any MinHash candidate, copies whose fingerprints are linked still go."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[:200]), "other words"]
    monkeypatch.setattr(minhash, "near_duplicates", partial(minhash.near_duplicates, bands=0))
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, enumerate(texts)), None)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_similar_links():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 11, 12, 500, 505)]
    assert brute.components(range(5), minhash.similar(sets)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_decontamination_by_row(spark, tmp_path):
    """Hit rows go with or without an id; a clean row that shares an id with a hit one stays."""
    item = " ".join(f"b{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"x {item} y"), (None, "clean"), (1, item), (1, "clean too"), (2, None), (3, item.upper())]
    kept = corpus_pipeline.decontaminate(spark, table(spark, rows), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "clean"), (1, "clean too"), (2, "")]


def test_near_stage_decides_by_row(spark):
    """Copies without an id go but for one; unrelated rows that share an id stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a.upper()), (1, b), (1, c), (2, c), (2, "other"), (None, b)]
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), None).collect()
    assert [r for r in kept if r.doc_id is None and r.text in (a, a.upper())] and len(kept) == 4
    assert {(r.doc_id, r.text) for r in kept if r.doc_id} == {(1, b), (1, c), (2, "other")}


def test_language_stage(spark):
    """Gibberish, foreign scripts and texts without letters go; clean texts of the learned languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(5)
    noise = [" ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=draw.randint(4, 9))) for _ in range(60)) for _ in range(20)]
    russian = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4
    rows = [*noise, russian, "今日はとても天気がいいですね。" * 10, "1234 5678 +++", "", None]
    planted = table(spark, [(10**6 + i, t) for i, t in enumerate(rows)]).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted), None).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.filter("n_chars >= 100").select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    assert len(kept & clean) >= 0.99 * len(clean)


def test_whole_pipeline(spark, folder):
    """The stages in turn: columns of the last one, taken words near the targets, no benchmark window and no copies left."""
    rows = corpus_pipeline.run(spark, folder).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    assert len(rows) and not rows["text"].duplicated().any()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()
    hits = brute.contamination([(r.doc_id, r.text) for r in rows.itertuples()], [tuple(b) for b in bench])
    assert sum(h[2] > 0 for h in hits) == 0
    assert not any(any(brute.base_row(t)[:2]) for t in rows["text"])
    by_source = rows.groupby("source")
    assert (abs(by_source["taken"].sum() / by_source["target"].first() - 1) < 0.3).mean() > 0.8


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, frame in {"documents": table(spark, []), "benchmark": spark.createDataFrame([], "item_id long, text string")}.items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates])
def test_texts_go_to_python_in_small_batches(spark, stage):
    """Stages that hand whole texts to Python bound the rows of a batch; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(name)
    try:
        for given, most in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(name, given)
            stage(spark, table(spark, [(i, f"some words of text {i}") for i in range(20)]), None)
            found = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()
            assert max(r.n for r in found) == most and sum(r.n for r in found) == 2500
    finally:
        spark.conf.set(name, before)
