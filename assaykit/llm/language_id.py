"""Language identification by word-first backoff.

A word that the model knows is scored by its smoothed log frequency in each language.  An
unseen word is scored by character n-grams: at each place the longest known n-gram up to
``ORDER`` counts, and the word gets their mean.  (A penalty for backing off would be the
same in every language and so change nothing.)
Sums over the words of a text give a posterior over the languages.

Word counts cover all training documents; n-gram counts come from the counted words.
The model keeps the most frequent entries, ``WORDS`` and ``GRAMS`` per order in all, shared
evenly by the languages; that is its documented size, and rarer words back off.

Cases: a null text and one without letters are ``und`` with score 0, as is everything if
there is nothing to learn from.  Documents without a language are not learned from.  Ties go to
the language that sorts first.  Repeated rows are learned from again.  Other columns are ignored.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import few, held_out
from assaykit.session import checkpointed

WORDS = 60_000
GRAMS = 20_000
ORDER = 4
SMOOTHING = 0.5


def _letters():
    """The ranges of letters of the basic plane, all beyond it, as a character class: one bitmap look-up."""
    codes = [c for c in range(0x10000) if chr(c).isalpha()]
    breaks = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
    ranges = zip([codes[0], *(codes[i] for i in breaks)], [*(codes[i - 1] for i in breaks), codes[-1]])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\\U00010000-\\U0010ffff]+"


TOKEN = re.compile(_letters())
FLUSH = 200_000  # entries of a task's count table before it is passed on
PARTS = 32  # parts in which entries are ranked first
PLACES = 500_000  # places of n-grams handled at once
LETTER_BITS = 21  # of a code point
UNKNOWN = "und"
FAMILIAR = 3  # characters of an n-gram that make a place of a word familiar
LONG = 20  # words of a text whose familiarity hardly varies by chance
DEVIATIONS = 5.0
LEAST_DEVIATION = 0.02


def word_counts(documents, lang="lang", text="text"):
    """``(lang, word, n)``, counted within tasks first."""

    def counted(batches):
        tables = {}
        for batch in few(batches, 1):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables.setdefault(name, Counter()).update(TOKEN.findall((body or "").lower()))
            if sum(map(len, tables.values())) > FLUSH:
                yield packed(tables)
                tables = {}
        yield packed(tables)

    def packed(tables):
        names = [name for name, t in tables.items() for _ in t]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([w for t in tables.values() for w in t], pa.string()),
                pa.array([n for t in tables.values() for n in t.values()], pa.int64()),
            ],
            names=["lang", "word", "n"],
        )

    rows = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null")
    return rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(words, times, order):
    """``(level, entry, n)`` of all n-grams of the padded words, each counted as often as its word.

    All places are handled at once: the number of an n-gram follows from that of the
    n-gram one shorter at the same place and the letter after it.
    """
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    times = np.repeat(np.array(times, np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    for start in range(0, len(codes), PLACES):
        letters = np.unique(codes[start : start + PLACES + order], return_inverse=True)[1].astype(np.int64)
        at = np.arange(min(PLACES, len(codes) - start))
        number = np.zeros(len(at), np.int64)
        for k in range(1, order + 1):
            fits = left[start + at] >= k
            at, number = at[fits], number[fits]
            if not len(at):
                break
            _, first, number = np.unique(number * (letters.max() + 1) + letters[at + k - 1], return_index=True, return_inverse=True)
            sums = np.bincount(number, times[start + at]).astype(np.int64)
            for i, n in zip((start + at[first]).tolist(), sums.tolist()):
                yield k, text[i : i + k], n


def gram_counts(counts, order=ORDER):
    """``(lang, level, entry, n)``: the n-grams up to ``order`` of counted words, summed within parts of a task."""

    def packed(words):
        for name, (ws, ns) in words.items():
            levels, entries, sums = [], [], []
            for level, entry, n in _grams(ws, ns, order):
                levels.append(level)
                entries.append(entry)
                sums.append(n)
            columns = [pa.repeat(name, len(sums)), pa.array(levels, pa.int32()), pa.array(entries, pa.string()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "level", "entry", "n"])

    def cut(batches):
        words, held = {}, 0
        for batch in batches:
            for name, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ws, ns = words.setdefault(name, ([], []))
                ws.append(word)
                ns.append(n)
                held += len(word) + 2
                if held >= PLACES:
                    yield from packed(words)
                    words, held = {}, 0
        yield from packed(words)

    return counts.select("lang", "word", "n").mapInArrow(cut, "lang string, level int, entry string, n long")


def fit(documents, lang="lang", text="text", words=WORDS, grams=GRAMS, order=ORDER):
    """The model: languages, and a table of log frequencies by entry; n-grams are keyed with a leading NUL."""
    counts = checkpointed(word_counts(documents, lang, text))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return {"languages": [], "index": {}, "table": np.zeros((0, 0), np.float32), "tree": []}
    parts = gram_counts(counts, order).groupBy("lang", "level", "entry").agg(F.sum("n").alias("n"))
    parts = checkpointed(parts)
    sums = {(r["lang"], r["level"]): r["n"] for r in parts.groupBy("lang", "level").agg(F.sum("n").alias("n")).collect()}
    both = counts.select("lang", F.lit(0).alias("level"), F.col("word").alias("entry"), "n").unionByName(parts)
    share = F.when(F.col("level") == 0, max(1, words // len(languages))).otherwise(max(1, grams // len(languages)))
    most = max(1, max(words, grams) // len(languages))
    # The first of all are among the first of their part, so the last ranking sees PARTS * most rows at most.
    salted = both.withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(PARTS)))
    order_by = [F.col("n").desc(), F.col("entry")]
    within = Window.partitionBy("lang", "level", "part").orderBy(*order_by)
    first = salted.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= most).drop("place")
    ranked = Window.partitionBy("lang", "level").orderBy(*order_by)
    chosen = first.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= most).filter(F.col("place") <= share)
    chosen = checkpointed(chosen.select("level", "entry").distinct())
    kept = both.join(chosen, ["level", "entry"]).select("level", "entry", "lang", "n").toArrow()
    index, at = {}, {name: i for i, name in enumerate(languages)}
    entries = list(zip(*(kept.column(c).to_pylist() for c in ("level", "entry", "lang", "n"))))
    for level, entry, _, _ in entries:
        index.setdefault(entry if level == 0 else "\0" + entry, len(index))
    found = np.full((len(index), len(languages)), SMOOTHING)
    levels = np.zeros(len(index), np.int64)
    for level, entry, name, n in entries:
        row = index[entry if level == 0 else "\0" + entry]
        found[row, at[name]] += n
        levels[row] = level
    total = np.array([[totals[x] if k == 0 else sums[(x, k)] for x in languages] for k in range(order + 1)], float)
    size = np.array([max(1, int((levels == k).sum())) for k in range(order + 1)], float)
    table = np.log(found) - np.log(total[levels] + SMOOTHING * size[levels][:, None])
    return {"languages": languages, "index": index, "table": table.astype(np.float32), "tree": gram_tree(index, order)}


def gram_tree(index, order):
    """The known n-grams as arrays, a pair per level: sorted keys, and the rows of the table.

    A key is made of the number of the n-gram one shorter, its place in the level before, and the last letter.  A row
    is -1 where only a longer n-gram is known.
    """
    known = {entry[1:]: row for entry, row in index.items() if entry[0] == "\0"}
    tree, numbers = [], {"": 0}
    for k in range(1, order + 1):
        pairs = sorted((numbers[e[:-1]] << LETTER_BITS | ord(e[-1]), e) for e in {e[:k] for e in known if len(e) >= k})
        numbers = {e: i for i, (_, e) in enumerate(pairs)}
        tree.append((np.array([key for key, _ in pairs], np.int64), np.array([known.get(e, -1) for e in numbers], np.int64)))
    return tree


def backed_off(words, model):
    """The score rows of unseen words, means over places of the longest known n-grams, and the shares of
    places where that has ``FAMILIAR`` characters or reaches to the end."""
    table = model["table"]
    scores, familiar = np.zeros((len(words), table.shape[1])), np.zeros(len(words))
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    group = np.cumsum(sizes) // PLACES
    for of in np.split(np.arange(len(words)), np.flatnonzero(np.diff(group)) + 1):
        if not len(of):
            continue
        codes = np.frombuffer("".join(f" {words[i]} " for i in of).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(of)), sizes[of])
        left = np.repeat(np.cumsum(sizes[of]), sizes[of]) - np.arange(len(codes))
        row, longest = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k, (keys, rows) in enumerate(model["tree"], 1):
            fits = left[at] >= k
            at, node = at[fits], node[fits]
            if not len(at) or not len(keys):
                break
            wanted = node << LETTER_BITS | codes[at + k - 1]
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[place] == wanted
            at, node = at[hit], place[hit]
            known = rows[node] >= 0
            row[at[known]], longest[at[known]] = rows[node[known]], k
        met = row >= 0
        times = np.maximum(np.bincount(word[met], minlength=len(of)), 1)
        for j in range(table.shape[1]):
            scores[of, j] = np.bincount(word[met], table[row[met], j], len(of)) / times
        near = met & (longest >= np.minimum(FAMILIAR, left))
        familiar[of] = np.bincount(word[near], minlength=len(of)) / sizes[of]
    return scores, familiar


def judged(texts, model):
    """``(language, probability, familiar, words)`` of every text.

    ``familiar`` is the mean over words of 1 for known ones and of the share of familiar places for others.  The
    unseen words of all texts are scored at once, each once.
    """
    index, table = model["index"], model["table"]
    bags = [Counter(TOKEN.findall(t.lower())) if t and model["languages"] else {} for t in texts]
    rows = [np.array([index.get(w, -1) for w in bag], np.int64) for bag in bags]
    unseen = {}
    numbers = [[unseen.setdefault(w, len(unseen)) for w, row in zip(bag, at.tolist()) if row < 0] for bag, at in zip(bags, rows)]
    scores, shares = backed_off(list(unseen), model) if unseen else (None, None)
    found = []
    for bag, at, others in zip(bags, rows, numbers):
        if not any(map(str.isalpha, "".join(bag))):
            found.append((UNKNOWN, 0.0, 0.0, 0))
            continue
        times = np.fromiter(bag.values(), np.float64, len(bag))
        total, familiar = np.zeros(table.shape[1]), times[at >= 0].sum()
        if others:
            total = (times[at < 0, None] * scores[others]).sum(axis=0)
            familiar += times[at < 0] @ shares[others]
        if len(others) < len(at):
            total += times[at >= 0] @ table[at[at >= 0]].astype(np.float64)
        best = int(total.argmax())
        probability = float(1 / np.exp(total - total[best]).sum())
        words = int(times.sum())
        found.append((model["languages"][best], probability, float(familiar) / words, words))
    return found


def predict(documents, model, key="doc_id", text="text"):
    """``(doc_id, lang_pred, score)`` of every row."""
    kept = with_language(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model)
    return kept.select("doc_id", "lang_pred", "score")


FOUND = {"lang_pred": T.StringType(), "score": T.DoubleType(), "familiar": T.DoubleType(), "n_words": T.LongType()}


def with_language(documents, model, text="text", shared=None):
    """``documents`` with ``lang_pred``, ``score``, ``familiar`` and ``n_words``, in place of columns of these names.

    ``shared`` is the model as a broadcast, where several calls use it: tasks then hold it once.
    """
    documents = documents.drop(*FOUND)
    shared = shared or documents.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
    place = documents.columns.index(text)

    def scored(batches):
        model = shared.value
        for batch in few(batches, place):
            found = judged(batch.column(place).to_pylist(), model)
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *FOUND])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, t) for n, t in FOUND.items())])
    return documents.mapInArrow(scored, schema)


def least_familiar(documents, model, lang="lang", text="text", key="doc_id", shared=None):
    """An expression telling whether a text is familiar enough to be in a language the model knows.

    The familiarity of a text that was not learned from has a mean and a deviation, larger for short texts.  Both are taken
    from all such texts; a text more than ``DEVIATIONS`` below the mean is in no known language.
    """
    others = documents.filter(held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = with_language(others.select(F.col(lang).alias("lang"), F.col(text).alias("text")), model, shared=shared).filter("n_words > 0")
    # Of texts of n words, the squared deviation is about that of long texts, and a part that falls with n.
    long, short = F.col("n_words") >= LONG, F.col("n_words") < LONG
    found = checkpointed(found.filter(F.col("lang_pred") == F.col("lang")).select("familiar", "n_words"))
    mean = found.agg(F.avg(F.when(long, F.col("familiar"))).alias("m")).first()["m"]
    if mean is None:
        return F.lit(True)
    off = (F.col("familiar") - mean) ** 2
    row = found.agg(
        F.avg(F.when(long, off)).alias("whole"), F.avg(F.when(short, off * F.col("n_words"))).alias("word")
    ).first()
    whole, word = max(row["whole"] or 0.0, LEAST_DEVIATION**2), max(row["word"] or 0.0, LEAST_DEVIATION)
    spread = F.sqrt(F.lit(whole) + F.lit(word) / F.greatest(F.col("n_words"), F.lit(1)))
    return F.col("familiar") >= F.lit(mean) - F.lit(DEVIATIONS) * spread


def training(documents, key="doc_id"):
    """The four fifths of the documents that a model may learn from."""
    return documents.filter(~held_out(key))
