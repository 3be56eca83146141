"""The operators against plain Python versions, and their edge cases."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from assaykit.llm import chat, embedding_dedup, language_id, line_dedup, mixing, pii, queries, simhash, token_counts, toxicity, winnowing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, items string, spans string, hits string"
ODD = [None, "", " \n\t", "one", "one two", "a b c d e f g", "Ünï çödé ß 😀 ok", "x@y.z", "same text here now", "same text here now", "w " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, 1, "i", "s", "h") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", "de", "t", 1, 1, "", "", ""), rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())


def test_pii_base(spark, folder, documents):
    rows = queries.op1_pii(spark, folder).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.base_row(documents[r.doc_id])


def test_pii_odd_texts_and_redaction(spark, odd):
    texts = ["a@b.c_d@e.f x@@y.z", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111, +1 (555) 123-4567 1 2", "+" * 50, "9" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (odd.select("doc_id", "text"), df):
        found = pii.with_candidates(frame)
        spans = pii.with_spans(found, pii.fit(found))
        base = F.filter("spans", lambda s: s["base"])
        for r in spans.select("text", pii.span_text(base).alias("b"), pii.redacted("text", F.col("spans")).alias("clean")).collect():
            want = brute.base_spans(r.text)
            assert r.b == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
            assert bool(want) == ((r.text or "") != r.clean)
    assert pii.fit(pii.with_candidates(df.limit(0))) == [0.0] * len(pii.features({n: 0 for n in pii.PATTERN}))


def test_embeddings_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64))
    vectors = [list(map(float, b + rng.normal(size=64) * s)) for b in base for s in (0, 0.05, 0.1, 0.15, 0.2)]
    vectors += [vectors[0], vectors[0], [0.0] * 64, None, [float("nan")] * 64, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array(vectors[:152])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    of = brute.components(range(len(vectors)), zip(*map(np.ndarray.tolist, np.nonzero(near))))
    found = sum(got[i].n_links for i in range(152))
    assert 0.98 * near.sum() <= found <= near.sum()
    assert np.mean([got[i].component_id == of[i] for i in range(len(vectors))]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in range(152, len(vectors)))


def test_mixing(spark, folder, odd):
    rows = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"), block=20)
    again = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet").repartition(5), block=20)
    assert sorted(rows.collect()) == sorted(again.collect())
    assert rows.filter("taken > 3 * size or copies < 0").isEmpty()
    assert mixing.targets({"a": 100, "b": 1, None: 50}) == {"b": 3.0, "a": 37.0, None: 111.0}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    p = mixing.fly(np.full(200, 0.3), np.arange(200), np.random.default_rng(0), False)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - 60) < 1e-6 and abs(p @ np.arange(200) - 0.3 * 19900) < 1e-4


def test_toxicity(spark, odd):
    rng = random.Random(2)
    words = [f"word{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" vile woman" if i % 4 == 0 else " woman" if i % 5 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, keep=["toxic"]).toPandas()
    assert ((scored.score >= 0.5) == (scored.toxic == 1)).mean() > 0.98
    assert abs(model["weights"].get("woman", 0)) < abs(model["weights"]["vile"]) / 5
    assert toxicity.score(odd, model, keep=["doc_id"]).count() == odd.count()
    assert toxicity.fit(odd, docs.select("doc_id", "toxic").limit(0))["weights"] == {}


def test_line_dedup(spark, odd):
    line = "this line is long enough to count"
    rows = [(1, f"{line}\nfirst of all"), (2, f"own words come here. {line.upper()}.\n{line}"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicated(df).collect()}
    assert set(got) == {2} and got[2].first_doc_id == 1
    text = rows[1][1]
    assert [text[s["start"] : s["end"]].lower().strip(". ") for s in got[2].removed] == [line, line]
    assert line_dedup.deduplicated(odd).count() >= 0 and line_dedup.deduplicated(odd.limit(0)).count() == 0


def test_language(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.op6_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    model = language_id.fit(language_id.training(docs))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und"
    assert language_id.predict(odd, language_id.fit(odd.limit(0))).filter("lang_pred <> 'und'").isEmpty()


def test_contamination(spark, odd):
    rng = random.Random(3)
    words = list("abcdefgh") + ["Ünï", "7x"]
    bench = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 3, 4, 7, 9, 10, 11, 25, 40, 0])] + [(99, None), (5, "q r s")]
    docs = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 60))
        item = (rng.choice(bench)[1] or "").upper().split()
        at = rng.randint(0, len(item))
        docs.append((i, " , ".join(body + item[at : at + 12] + body[:3])))
    b = spark.createDataFrame(bench, "item_id long, text string")
    for some in (docs, [(i, t) for i, t in enumerate(ODD)]):
        d = spark.createDataFrame(some, "doc_id long, text string")
        for most in (1_000_000, 0):
            got = winnowing.contamination(d, b, most=most)
            rows = sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect())
            assert rows == sorted(brute.contamination(some, bench))
    assert winnowing.contamination(odd, b).count() == odd.count()
    assert winnowing.contamination(odd, b.limit(0)).filter("n_hit > 0").isEmpty()


def test_token_counts(spark, odd):
    scores = {bytes([c]): -8.0 for c in range(256)} | {b"ab": -5.0, b"abc": -6.0, b"bcd": -4.0, b" a": -5.0, b"cd": -3.0}
    rng = random.Random(4)
    pieces = {bytes(rng.choices(b"abcd ", k=rng.randint(0, 12))) for _ in range(300)}
    got = token_counts.trie_counts(pieces, scores, 3, -20.0)
    assert got == {p: brute.best_split(p, scores, -20.0) for p in pieces}
    rows = token_counts.token_counts(odd, scores=scores).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (0, 1))


def test_simhash(spark, folder, documents, odd):
    prints = {d: brute.simhash(t) for d, t in documents.items()}
    named = brute.simhash_components(prints)
    for r in queries.op9_simhash(spark, folder).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", named[r.doc_id])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[9] == 8 and got[None] is None
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40)
    codes = sorted({int(s) ^ (1 << int(i)) ^ (1 << int(j)) for s in seeds for i, j in rng.integers(0, 63, (8, 2))})
    df = spark.createDataFrame([(c,) for c in codes], "fingerprint long")
    for block in (8192, 3):
        links = [(r.a, r.b) for r in simhash.fingerprint_links(df, block=block).collect()]
        want = brute.simhash_components(dict(zip(codes, codes)))
        assert brute.components(codes, links) == want


def test_chat(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    says = "</s>[INST] ok [/INST]"
    talks = {}
    for r in [*given, (-7, 0, "user", says), (-7, 1, "assistant", says)]:
        talks.setdefault(r[0], []).append(r[1:])
    for r in queries.op10_chat(spark, folder).collect():
        turns = sorted(talks[r.conv_id])
        whole = "".join(f"{role}\n{text or ''}\n" for _, role, text in turns)
        loss = "".join(text or "" for _, role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(whole), len(loss), digest(loss))


def test_chat_events_and_escapes(spark):
    log = [
        (1, 1, "a", "message", "user", "hi"), (1, 2, "b", "message", "assistant", "dr"), (1, 3, "b", "delta", None, "aft"),
        (1, 4, "b", "regenerate", None, None), (1, 5, "b", "delta", None, "go"), (1, 6, "b", "delta", None, "od"),
        (1, 7, "a", "edit", None, "hello"), (1, 8, "c", "message", "user", "x"), (1, 9, "c", "delete", None, None),
        (2, None, "z", "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message_id string, op string, role string, text string")
    got = {r.conv_id: r.turns for r in chat.render(chat.fold(events)).select("conv_id", chat.parsed().alias("turns")).collect()}
    assert [tuple(t) for t in got[1]] == [("user", "hello"), ("assistant", "good")]
    assert [tuple(t) for t in got[2]] == [("", "")]
    texts = ["<s>", r"<\s>", r"[\\/INST]", "<|im_end|>", r"<\|im_start|>", "<", "<<SYS>>", "\n", "[INST", "a\\"]
    rows = [(i, 0, "r\n<|im_end|>%0A", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.render(chat.turns(df)).select("conv_id", chat.parsed().alias("t")).collect()
    assert {r.conv_id: tuple(r.t[0]) for r in back} == {i: (role, t) for i, _, role, t in rows}
    assert chat.render(chat.fold(events.limit(0))).count() == 0


@pytest.mark.parametrize("places", [5, 64, 1_000_000])
def test_gram_counts(spark, monkeypatch, places):
    """N-grams of counted words over letters beyond the basic plane, cut into parts of any size."""
    draw = random.Random(1)
    words = [("en" if i % 3 else "de", "".join(draw.choices("abcé漢\U00020000", k=draw.randint(1, 12))), draw.randint(1, 9)) for i in range(200)]
    want = {}
    for name, word, n in words:
        padded = f" {word} "
        for k in range(1, 5):
            for i in range(len(padded) - k + 1):
                key = (name, k, padded[i : i + k])
                want[key] = want.get(key, 0) + n
    got = {}
    for name in ("en", "de"):
        monkeypatch.setattr(language_id, "PLACES", places)
        chosen = [(w, n) for m, w, n in words if m == name]
        for k, entry, n in language_id._grams(*zip(*chosen), 4):
            got[name, k, entry] = got.get((name, k, entry), 0) + n
    assert got == want
    monkeypatch.undo()
    frame = spark.createDataFrame(words, "lang string, word string, n long")
    summed = language_id.gram_counts(frame).groupBy("lang", "level", "entry").agg(F.sum("n").alias("n"))
    assert {(r.lang, r.level, r.entry): r.n for r in summed.collect()} == want


def test_portions_hold_every_text_once():
    texts = ["a" * 5, None, "", "b" * 30, "c", "d" * 9]
    for chars in (1, 6, 10, 1000):
        runs = list(token_counts.portions(texts, chars))
        assert [t for run in runs for t in run] == texts
        assert all(sum(len(t or "") for t in run[:-1]) < chars for run in runs)
    assert list(token_counts.portions([])) == []
