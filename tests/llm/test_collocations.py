"""Phrase collocations and the filters that count them, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.llm import collocations, queries
from assaykit.llm import quotient_filter as qf

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least=10, longest=3, best=2000, share=50):
    """The contract on ``(lang, text)`` rows, for phrases of up to ``longest`` words."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            cuts = [(10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            longer = (b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))))
            if not any(100 * b >= share * a for b in longer):
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def random_rows(draw, n):
    words = ["a", "B", "b", "über", "x-y", "日本", "c", "the", "the", "the", "e f", "\x00", "d'"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "?!"]
    text = lambda: "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(40)))
    return [(draw.choice(["en", "de", None, "und", ""]), draw.choice([text(), text(), None, "", " \n", "one"])) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = random_rows(random.Random(2), 150)
    rows += [rows[0]] * 40 + [("en", "hot pair " * 3000), ("fr", "no blank"), ("en", "x" * 50_000)]
    return rows, spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("z") for c in ("word", "n", "ids", "id")})


def test_phrases_of_odd_texts(odd):
    rows, df = odd
    assert found(collocations.collocations(df.repartition(5))) == plain_phrases(rows)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_other_parameters(odd):
    """Phrases of four words, few rows per language, a low count."""
    rows, df = odd
    got = found(collocations.collocations(df, longest=4, least=3, best=7, share=80))
    assert got == plain_phrases(rows, least=3, longest=4, best=7, share=80)


def test_small_filters_and_windows(odd, spark, monkeypatch):
    """Many filters a task, and windows that cut texts between pieces."""
    rows, df = odd
    monkeypatch.setattr(collocations, "HELD", 20)
    monkeypatch.setattr(collocations, "WORDS_HELD", 20)
    monkeypatch.setattr(collocations.words_of, "__defaults__", (64,))
    assert found(collocations.collocations(df)) == plain_phrases(rows)


def test_wrong_ids_are_noticed(spark, monkeypatch):
    """Words that share an id of the first seed get another one."""
    rows = [("en", f"w{i % 7} v{i % 5} u") for i in range(100)]
    real = collocations._hashes
    monkeypatch.setattr(collocations, "_hashes", lambda w, lang, seed: real(w, lang, seed) * np.uint64(seed > 0))
    df = spark.createDataFrame(rows, "lang string, text string")
    words = collocations.vocabulary(df, 0)
    assert words.select("hash").distinct().count() == 1
    named, _, seed, _ = collocations._identified(lambda s: collocations.vocabulary(df, s) if s else words, 10)
    assert named.select("id").distinct().count() == named.count() == 13


def test_large_counts(spark):
    """Products beyond 64 bits."""
    words = spark.createDataFrame([("en", "a", 1, 9 * 10**14), ("en", "b", 2, 8 * 10**14)], "lang string, word string, id long, n long")
    grams = spark.createDataFrame([([1, 2], 7 * 10**14)], "ids array<long>, n long")
    row = collocations.scored(words, grams).first()
    assert (row.score, row.l, row.r) == (10**6 * 49 // 72, 9 * 10**14, 8 * 10**14)


@pytest.mark.parametrize("order,bits,bucket_bits", [(1, 32, 0), (2, 32, 5), (2, 41, 7), (3, 47, 0), (3, 64, 9), (4, 64, 20)])
def test_filter_round_trip(order, bits, bucket_bits):
    rng = np.random.default_rng(order)
    grams = [rng.integers(0, 1 << bits, 5000, np.uint64) for _ in range(order)]
    grams = [np.concatenate([x, x[:3000]]) for x in grams]
    mixed = qf.permuted(grams, bits)
    assert all((a == b).all() for a, b in zip(qf.restored(mixed, bits), grams))
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], len(grams[0]))
    want = Counter()
    for *gram, n in zip(*(x.tolist() for x in mixed), counts.tolist()):
        want[tuple(gram)] += n
    halves = [qf.collapsed([x[s] for x in mixed], counts[s], bits) for s in (slice(0, 4000), slice(4000, None))]
    limbs, sums = qf.merged(halves, bits)
    entries = list(zip(*(x.tolist() for x in limbs)))
    assert entries == sorted(want) and dict(zip(entries, sums.tolist())) == want
    bucket = (limbs[0] >> np.uint64(bits - bucket_bits)) if bucket_bits else np.zeros(len(sums), np.uint64)
    for b in np.unique(bucket):
        part = [x[bucket == b] for x in limbs]
        data = qf.encoded(part, sums[bucket == b], bits, bucket_bits)
        back, n = qf.decoded(data, order, bits, int(b), bucket_bits)
        assert all((x == y).all() for x, y in zip(back, part)) and (n == sums[bucket == b]).all()
    if bucket_bits < 9 and order > 1:  # smaller than the same entries in full
        ones = np.ones(len(part[0]), np.int64)
        assert len(qf.encoded(part, ones, bits, bucket_bits)) < len(ones) * (order * bits / 8 + 1)


def test_entries_with_one_leading_word():
    """Different grams that agree in their first 64 bits are kept apart."""
    limbs = [np.array([5, 5, 5, 5], np.uint64), np.array([9, 9, 9, 9], np.uint64), np.array([2, 1, 2, 1], np.uint64)]
    got, counts = qf.collapsed(limbs, np.ones(4, np.int64), 64)
    assert got[2].tolist() == [1, 2] and counts.tolist() == [2, 2]


def test_words_of_windows():
    texts = ["A b,c", "", None, "d", "e  f\tg.h i", "É é"]
    for size in (1, 3, 1000):
        got, at = [], 0
        for words, pieces in collocations.words_of(pa.array(texts), size):
            got += [(w.decode(), int(p) + at) for w, p in zip(words.to_pylist(), pieces)]
            at += 1000
        assert [w for w, _ in got] == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "É", "é"]
        assert [a[1] == b[1] for a, b in zip(got, got[1:])] == [True, False, False, False, True, True, False, True, False, True]
