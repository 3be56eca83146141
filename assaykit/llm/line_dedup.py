"""Substring deduplication by hashing lines and sentences.

A text is cut into lines, and lines into sentences, with the offset of each.  Units are
normalised (lower case, runs of blanks and punctuation as one blank) and hashed with 128
bits.  Digests are grouped over the corpus; the occurrence of lowest rank (smallest
``doc_id``, then smallest offset) stays, all others are removed, with their original
offsets kept.  A line is compared whole first; the sentences of every line are compared
too, so a passage that sits inside a longer line is found.  Only units of ``min_words``
words or more count: shorter ones repeat by chance.

Repeats that begin or end inside a sentence are found by words: of every ``SPAN``
words in a row some run of ``GRAM`` words is a winnowed anchor, wherever they stand.  All
runs of ``SPAN`` words that hold an anchor which occurs twice are units as well, and so is
a text of ``SPAN`` words or more from its first word to its last; further copies of
a text are left to that one.  So a run of ``SPAN`` words or more that stands further up goes
whole, wherever it is cut.  An occurrence that overlaps the first one in its document
stays.  In scripts without blanks a letter is a word of a run, and two letters are
a word of a line.

Cases: null, empty and blank texts have no units.  Repeated rows of one id are told
apart by a hash of the text; rows equal in both are one document.  Rows without an id rank first.  Very long texts are cut like others.  Other columns are ignored.
"""

import hashlib
import re
import sys
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assaykit.llm.common import checked_broadcast, few, hash_bitmap, hot_lookup, marked, stored
from assaykit.session import checkpointed

MIN_WORDS = 5
FIRST = re.compile(r"\S")
STOP = re.compile(r"[.!?。！？](?:(?<=[。！？])|(?=\s))")  # begins with one set of letters, which is searched fast
NORMAL = re.compile(r"[^\W_]+")
# Thai, Lao, Burmese, Khmer, kana and Han
BLANKLESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
LETTER = re.compile(f"[{BLANKLESS}]")
WORD = re.compile(rf"[{BLANKLESS}]|[^\W_{BLANKLESS}]+")
SPAN = 50
GRAM = 25
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BREAK = re.compile(r"[\W_]")
PORTION = 1 << 17  # characters whose words are cut at once


def sentences(line):
    """``(start, end)`` of the sentences of a line, from a letter or mark to a stop behind it or the end."""
    spans = []
    first = FIRST.search(line)
    while first:
        stop = STOP.search(line, first.end())
        spans.append((first.start(), stop.end() if stop else len(line)))
        first = FIRST.search(line, spans[-1][1])
    return spans


def units(text, least=MIN_WORDS):
    """``(start, end, digest)`` of the lines and sentences of a text, in code points."""
    found = []
    at = 0
    letters = not text.isascii() and LETTER.search(text) is not None
    for line in text.split("\n"):
        spans = sentences(line)
        words = [NORMAL.findall(line[a:b].lower()) for a, b in spans]
        if len(spans) > 1:  # no word reaches over a stop
            spans.append((spans[0][0], len(line.rstrip())))
            words.append([w for part in words for w in part])
        for (a, b), part in zip(spans, words):
            count = max(1, len(part))
            if count >= least or letters:
                normal = " ".join(part)
                if count + (len(LETTER.findall(normal)) // 2 if letters else 0) >= least:
                    found.append((at + a, at + b, hashlib.blake2b(normal.encode(), digest_size=16).digest()))
        at += len(line) + 1
    return found


def whole(text, least=SPAN):
    """A text of ``least`` words or more as a unit, from the first word to the last."""
    first = list(islice(WORD.finditer(text), least))
    if len(first) < least:
        return []
    end = len(text)
    while not WORD.match(text, end - 1):
        end -= 1
    return [(first[0].start(), end, hashlib.blake2b(b"\0" + text.encode(), digest_size=16).digest())]


@cache
def letter_values():
    """By code point: a number for the lower-case letter, 0 outside words; and which letters are words by themselves."""
    plain = "".join(map(chr, range(sys.maxunicode + 1)))
    values = points_mixed(np.frombuffer(plain.replace("\u0130", "i").lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    inside, alone = np.zeros((2, len(plain)), bool)
    for pattern, marks in ((NORMAL, inside), (LETTER, alone)):
        for found in re.finditer(f"(?:{pattern.pattern})+", plain):
            marks[slice(*found.span())] = True
    values[~(inside | alone)] = 0
    return values, alone


def points_mixed(points):
    """A 64-bit number for every code point; only that of 0 is 0."""
    value = (points.astype(np.uint64) << np.uint64(1)) * np.uint64(BASES[1])
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(32))


def powers(memory, count):
    """``count`` powers of a base at least, and those of its inverse; ``memory`` keeps them."""
    if len(memory.get("powers", ())) < count:
        bases = (BASES[0], pow(BASES[0], -1, 2**64))
        memory["powers"], memory["back"] = (np.multiply.accumulate(np.full(max(count, 2 * PORTION), b, np.uint64)) for b in bases)
    return memory["powers"], memory["back"]


def cut_words(text, memory):
    """``(codes, starts, ends)``: a hash of every word in lower case, and where it stands, for all letters at once."""
    values, alone = letter_values()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    value = values[points]
    inside = value != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    if not text.isascii():
        own = alone[points]
        first |= own
        first[1:] |= own[:-1] & inside[1:]
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, back = powers(memory, len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(points)], dtype=np.uint64)])
    codes = (sums[ends] - sums[starts]) * back[starts]
    # Two letters whose lower case is not one letter of its own.
    odd = np.flatnonzero((points == 0x130) | (points == 0x3A3)) if "\u0130" in text or "\u03a3" in text else ()
    for i in np.unique(np.searchsorted(starts, odd, side="right") - 1) if len(odd) else ():
        lower = points_mixed(np.frombuffer(text[starts[i] : ends[i]].lower().encode("utf-32-le"), np.uint32))
        power, back = powers(memory, len(lower))
        codes[i : i + 1] = (lower * power[: len(lower)]).sum(keepdims=True, dtype=np.uint64) * back[:1]
    return spread(codes), starts, ends


def spread(value):
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(33))


def portions(texts):
    """The texts joined to strings of about ``PORTION`` characters, long ones cut between words.

    Of every string also the places of its pieces, the texts they are of, and how far they stand from their place there.
    """
    held, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = BREAK.search(text, start + PORTION)
            end = stop.start() if stop else len(text)
            held.append((size, number, start - size, text[start:end]))
            size += end - start + 1
            start = end
            if size > PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


def word_table(texts, memory):
    """``(codes, owners, starts, ends)`` of the words of all texts: hashes, numbers of the texts, places in them."""
    found = [(np.zeros(0, np.uint64), *np.zeros((3, 0), np.int64))]
    for held in portions(texts):
        places, numbers, moved, pieces = zip(*held)
        codes, starts, ends = cut_words("\n".join(pieces), memory)
        piece = np.searchsorted(places, starts, side="right") - 1
        moved = np.array(moved)[piece]
        found.append((codes, np.array(numbers)[piece], starts + moved, ends + moved))
    return tuple(map(np.concatenate, zip(*found)))


def word_codes(text, memory):
    """The hashes of the words of a text."""
    return word_table([text], memory)[0]


def gram_codes(codes, width, base=BASES[0]):
    """A 64-bit hash of every run of ``width`` words."""
    count = len(codes) - width + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.full(len(codes), base, np.uint64))
    back = np.multiply.accumulate(np.full(count, pow(base, -1, 2**64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    return spread((sums[width:] - sums[:-width]) * back)


def own_anchors(grams, span=SPAN, gram=GRAM):
    """The place of the smallest gram, the first of them, of every run of ``span`` words, run by run."""
    window = span - gram + 1
    if len(grams) < window:
        return np.zeros(0, np.int64)

    def smaller(left, right):
        return np.where(grams[right] < grams[left], right, left)

    least, size = np.arange(len(grams)), 1
    while 2 * size <= window:
        least, size = smaller(least[:-size], least[size:]), 2 * size
    return smaller(least[: len(grams) - window + 1], least[window - size :])


def anchors(grams, span=SPAN, gram=GRAM):
    """The places of the smallest gram of every run of ``span`` words."""
    return np.unique(own_anchors(grams, span, gram))


def mixed(grams):
    """Hashes of grams whose leading bits are spread evenly, also those of small ones, and the same turned by half."""
    first = grams * np.uint64(BASES[0])
    return first, first << np.uint64(32) | first >> np.uint64(32)


def within(owners, span=SPAN):
    """Which runs of ``span`` words lie in one text."""
    count = max(0, len(owners) - span + 1)
    return owners[:count] == owners[len(owners) - count :]


def text_anchors(texts, memory):
    """The anchors of all texts, one for each place."""
    codes, owners, _, _ = word_table(texts, memory)
    grams = gram_codes(codes, GRAM)
    return grams[np.unique(own_anchors(grams)[within(owners)])]


def passage_arrays(texts, known, memory, span=SPAN, gram=GRAM):
    """Texts' numbers, starts, ends and digests (two numbers each) of the runs of ``span`` words whose own anchor is known.

    Equal runs have equal anchors at the same place of the run, so no other run can be a repeat.
    ``known`` tells of anchors whether they are.
    """
    codes, owners, starts, ends = word_table(texts, memory)
    grams = gram_codes(codes, gram)
    at = np.flatnonzero(known(grams)[own_anchors(grams, span, gram)] & within(owners, span))
    digests = np.stack([gram_codes(codes, span, base)[at] for base in BASES], axis=1)
    return owners[at], starts[at], ends[at + span - 1], digests


def passages(text, known, memory, span=SPAN, gram=GRAM):
    """``(start, end, digest)`` of every run of ``span`` words of a text that may be a repeat by its anchor."""
    _, starts, ends, digests = passage_arrays([text], lambda grams: np.isin(grams, known), memory, span, gram)
    return [(a, b, digest.tobytes()) for a, b, digest in zip(starts.tolist(), ends.tolist(), digests)]


def passage_table(documents, key="doc_id", text="text"):
    """``(doc_id, text_key, start, end, digest)`` of the runs of words that may be repeats, of the first copy of a text.

    Two bitmaps tell which anchors repeat, as ``repeated`` does for units, so no text is shuffled to its anchors.
    """

    def anchored(batches):
        memory = {}
        for batch in few(batches, 0):
            flat = mixed(text_anchors([body or "" for body in batch.column(0).to_pylist()], memory))[0]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["anchor"])

    def cut(batches):
        memory = {}

        def known(grams):
            first, turned = mixed(grams)
            return marked(bitmaps.value[0], first) & marked(bitmaps.value[1], turned)

        for batch in few(batches, 2):
            found = passage_arrays([body or "" for body in batch.column(2).to_pylist()], known, memory)
            for start in range(0, len(found[0]), 50_000):
                yield joined(batch, *(column[start : start + 50_000] for column in found))

    def joined(batch, owners, starts, ends, digests):
        places = pa.py_buffer(np.arange(len(owners) + 1, dtype=np.int32) * 16)
        columns = [batch.column(c).take(pa.array(owners)) for c in range(2)] + [pa.array(v, pa.int32()) for v in (starts, ends)]
        columns.append(pa.Array.from_buffers(pa.binary(), len(owners), [None, places, pa.py_buffer(digests.tobytes())]))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "end", "digest"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    copies = rows.groupBy("text_key").agg(F.min(F.struct("doc_id")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(checked_broadcast(copies), "text_key", "left").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    seen = rows.select("text").mapInArrow(anchored, "anchor long")
    several = checkpointed(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    turned = several.select(F.shiftleft("anchor", 32).bitwiseOR(F.shiftrightunsigned("anchor", 32)).alias("anchor"))
    size = several.count()
    bitmaps = rows.sparkSession.sparkContext.broadcast(tuple(hash_bitmap(v, "anchor", size) for v in (several, turned)))
    return rows.select("doc_id", "text_key", "text").mapInArrow(cut, "doc_id long, text_key long, start int, end int, digest binary")


def unit_table(documents, key="doc_id", text="text", least=MIN_WORDS):
    """``(doc_id, text_key, start, end, digest)``, a row per unit."""

    def cut(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, mark, body in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b, digest in units(body or "", least) + whole(body or ""):
                    for column, value in zip(rows, (doc, mark, a, b, digest)):
                        column.append(value)
                if len(rows[0]) >= 50_000:
                    yield packed(rows)
                    rows = [[], [], [], [], []]
            yield packed(rows)

    def packed(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "text_key", "start", "end", "digest"]
        )

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, text_key long, start int, end int, digest binary")


def repeated(rows):
    """The units whose digest occurs more than once, and few others.

    Hashes of the digests are counted first, eight bytes a unit; a bitmap of those that repeat tells
    which units go on, so most units are never shuffled.
    """
    several = rows.groupBy(F.xxhash64("digest").alias("mark")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = checkpointed(several.select("mark"))
    bitmap = rows.sparkSession.sparkContext.broadcast(hash_bitmap(several, "mark", several.count()))

    def kept(batches):
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(marked(bitmap.value, hashes)))

    hashed = rows.withColumn("mark", F.xxhash64("digest"))
    return hashed.mapInArrow(kept, hashed.schema).drop("mark")


def repeats(documents, key="doc_id", text="text", least=MIN_WORDS):
    """``(doc_id, text_key, start, end, first_doc_id, copies)``: every unit that is not the first of its digest."""
    rows = repeated(stored(unit_table(documents, key, text, least).unionByName(passage_table(documents, key, text))))
    groups = rows.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_key", "start", "end")).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    known = hot_lookup(rows, groups.filter("copies > 1"), ["digest"], "copies", how="inner")
    here = F.struct("doc_id", "text_key", "start", "end")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    known = known.filter((here != F.col("first")) & ~(same & (F.col("start") < F.col("first.end"))))
    return known.select("doc_id", "text_key", "start", "end", F.col("first.doc_id").alias("first_doc_id"), "copies")


def deduplicated(documents, key="doc_id", text="text", least=MIN_WORDS):
    """``(doc_id, text_key, removed array<struct<start,end>>, first_doc_id)`` of the documents that lose something, spans merged."""
    spans = repeats(documents, key, text, least).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    return spans.select("doc_id", "text_key", merged.alias("removed"), "first_doc_id")


def without(text, removed):
    """The text with the given spans cut out."""
    return F.aggregate(
        F.coalesce(removed, F.array().cast("array<struct<start:int,end:int>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("out")
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)),
    )
