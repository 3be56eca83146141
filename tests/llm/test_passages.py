"""Repeated passages that begin and end inside sentences, against plain Python."""

import random
import re

import numpy as np

from assaykit.llm import common, line_dedup, queries


def repeated_words(texts, span=50):
    """Per text, which words stand in a run of ``span`` words that begins further up and does not overlap it."""
    first, hit = {}, []
    for d, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", text.lower())
        marks = [False] * len(words)
        for i in range(len(words) - span + 1):
            at = first.setdefault(tuple(words[i : i + span]), (d, i))
            if at != (d, i) and (at[0] != d or i >= at[1] + span):
                marks[i : i + span] = [True] * span
        hit.append(marks)
    return hit


def test_passages_inside_sentences(spark):
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 59, 75, 120, 300)]
    texts = [", ".join(fresh(7) + p + fresh(9)) for p in passages]
    for p in passages:
        texts.append(" ".join(fresh(30) + p + fresh(3) + draw.choice(passages)).title())
        texts.append(" ".join(draw.choice(passages)[5:] + p[:-1] + fresh(40)))
        changed = fresh(5) + p + p
        changed[20] = "changed"
        texts.append(" ".join(changed))
    texts += ["a b " * 200, texts[0], " ".join(fresh(49)), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.removed] for r in line_dedup.deduplicated(df).collect()}
    want = repeated_words(texts)
    assert sum(map(sum, want)) > 2000
    for d, text in enumerate(texts):
        for m, gone in zip(re.finditer(r"[^\W_]+", text), want[d]):
            if gone:
                assert any(a <= m.start() and m.end() <= b for a, b in got.get(d, [])), (d, m)
    assert not any(got.get(d) for d in range(len(passages)))


def test_scripts_without_blanks(spark):
    line = "".join(chr(0x4E00 + 37 * i) for i in range(12))
    df = spark.createDataFrame([(1, f"{line}。甲乙"), (2, f"丙丁\n{line}。戊")], "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.removed] for r in line_dedup.deduplicated(df).collect()}
    assert got == {2: [(3, 16)]}


def test_query_columns(spark, tmp_path):
    """All six columns; rows without an id, repeated rows, null and empty texts."""
    line = "this line is long enough to count"
    rows = [(None, f"{line}\nand more"), (1, f"x {line}"), (2, f"{line}\nown"), (None, f"a\n{line}"), (3, None), (4, ""), (2, f"{line}\nown")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, queries.op5_line_dedup(spark, str(tmp_path)).collect()))
    texts = {text for _, text in rows}
    first = min((r for r in rows if r[0] is None), key=lambda r: key_of(spark, r[1]))
    want = []
    for doc, text in rows:
        chars, spans = len(text or ""), []
        if text and line in text.split("\n") and (doc, text) != first:
            spans = [(text.index(line), text.index(line) + len(line))]
        gone = sum(b - a for a, b in spans)
        shown = ",".join(f"{a}:{b}" for a, b in spans)
        want.append((doc, len(spans), gone, shown, None, chars - gone))
    names = ["doc_id", "n_removed", "removed_chars", "removed_spans", "first_doc_id", "kept_chars"]
    frame = spark.createDataFrame(want, "doc_id long, n_removed long, removed_chars long, removed_spans string, first_doc_id long, kept_chars long")
    assert got == sorted(map(str, frame.select(names).collect())) and len(texts) == 6


def key_of(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_few_marks_let_more_pass(spark, monkeypatch):
    """A bitmap too small for the corpus costs time only."""
    texts = [f"sentence number {i} goes on here. shared line of five words {i % 40}." for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(str, line_dedup.deduplicated(df).collect()))
    real = common.hash_bitmap
    monkeypatch.setattr(line_dedup, "hash_bitmap", lambda hashes, column, size: (b"\xff" * 4096, 49) if real(hashes, column, size) else None)
    assert len(plain) == 260 and sorted(map(str, line_dedup.deduplicated(df).collect())) == plain


def test_runs_without_a_known_anchor_are_left():
    """Equal runs share their own anchor: a run that merely overlaps a known one is no candidate, and no repeat is lost."""
    words = [f"w{i}" for i in range(200)]
    edited = words[:100] + ["changed"] + words[101:]
    grams = [line_dedup.gram_codes(line_dedup.word_codes(" ".join(t), {}), line_dedup.GRAM) for t in (words, edited)]
    known = np.intersect1d(*[g[line_dedup.anchors(g)] for g in grams])
    runs = [{d for *_, d in line_dedup.passages(" ".join(t), known, {})} for t in (words, edited)]
    both = {" ".join(words[i : i + 50]) for i in range(151)} & {" ".join(edited[i : i + 50]) for i in range(151)}
    assert len(runs[0] & runs[1]) == len(both) == 101
    touching = 50 - len({i for i in range(51, 101) if grams[1][line_dedup.own_anchors(grams[1])[i]] not in known})
    assert touching < 50 and len(runs[1]) == 101 + touching


def test_words_of_many_texts_at_once(monkeypatch):
    """The words of all texts are cut together: the same places as the pattern's, and equal codes for equal lower case."""
    draw = random.Random(5)
    texts = ["", "İstanbul ΟΔΟΣ οδος ΣΑΣ_ΑΣ'Α", "甲乙abc丙 กขิ x", "Straße STRASSE ǅ K k", "_a__b_ ..."]
    texts += ["".join(draw.choice("aB İΣσς甲กิ_.'7é²\U00020000") for _ in range(80)) for _ in range(200)]
    want = [(i, m.start(), m.end(), m.group().lower()) for i, t in enumerate(texts) for m in line_dedup.WORD.finditer(t)]
    for portion in (line_dedup.PORTION, 37):
        monkeypatch.setattr(line_dedup, "PORTION", portion)
        codes, *places = line_dedup.word_table(texts, {})
        assert [w[:3] for w in want] == list(zip(*(p.tolist() for p in places)))
        pairs = {(word, code) for (*_, word), code in zip(want, codes.tolist())}
        assert len(pairs) == len({w for w, _ in pairs}) == len({c for _, c in pairs})


def test_own_anchor_is_the_first_of_the_smallest():
    draw = np.random.default_rng(3)
    for size in range(0, 120, 7):
        grams = draw.integers(0, 9, size).astype(np.uint64)
        want = [i + int(grams[i : i + 26].argmin()) for i in range(max(0, size - 25))]
        assert line_dedup.own_anchors(grams).tolist() == want


def test_sentences_and_lines():
    line = " ! One two. Three 4.5 four?  Five。Six！ seven "
    assert [line[a:b] for a, b in line_dedup.sentences(line)] == ["! One two.", "Three 4.5 four?", "Five。", "Six！", "seven "]
    spans = line_dedup.units("a b. c d_e f\nx", 2)
    assert [s[:2] for s in spans] == [(0, 4), (5, 12), (0, 12)]


def test_texts_are_not_shuffled_to_their_anchors(spark):
    """Repeated anchors come back as bitmaps: the texts themselves take part in no shuffle, whatever repeats."""
    words = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(i, f"{words} end{i}") for i in range(6)], "doc_id long, text string")
    table = line_dedup.passage_table(df)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1 and table.groupBy("digest").count().filter("count > 1").count() == 71
