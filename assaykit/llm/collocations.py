"""Phrase collocations, counted level by level in counting quotient filters.

Words get ids: hashes cut to as few bits as keep every frequent word apart from all others, which
is checked on the whole vocabulary.  No dictionary has to reach the tasks.  A phrase can only be frequent if
its words, and its phrases of one word less, are; bitmaps of bounded size tell tasks most of what is not, and
letting too much pass costs time only.  A task counts the grams of its texts in filters of bounded
size and sends their parts, a part per range of quotients; the parts of a range are merged in order.  As
quotients are scattered evenly, a word or phrase that makes up a third of a corpus is one entry per filter.

Cases: a null text is empty, a null language is ``und``.  Blanks are space and tab; pieces end at
``.,;:!?`` and at line ends; other characters are parts of words.  Empty and blank texts have no words.  Texts are
read whole, in windows that end between pieces; one piece is held at a time.  Repeated rows count repeatedly.  Ties of
score and count go by the phrase.  Other columns, whatever their names, are ignored.  An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.llm import quotient_filter as qf
from assaykit.llm.common import hot_lookup
from assaykit.session import checkpointed

LEAST = 10  # occurrences of a candidate
LONGEST = 3  # words
BEST = 2000  # rows of a language
SHARE = 50  # per cent of its occurrences in a longer candidate that make a phrase redundant
SCALE = 1_000_000
UNKNOWN = "und"

WINDOW = 1 << 20  # bytes of text looked at together
HELD = 1 << 18  # entries of a filter that a task holds before it sends them
WORDS_HELD = 1 << 19
PLACE_BITS = 27  # the largest bitmap has 2 ** PLACE_BITS bits (16 MB)
BITS_PER_GRAM = 16
LEAST_BITS = 32  # of an id

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = _BLANK
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _windows(texts, size):
    """Cuts of a string array: lowered bytes, and where texts begin in them."""
    texts = texts.drop_null().cast(pa.large_binary())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        cut, step = end, size
        while at + step < end:
            inside = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, at + step, "right")]
            breaks = np.flatnonzero(_CLASS[data[at : at + step]] == _BREAK)
            last = max(int(inside[-1]) if len(inside) else 0, at + int(breaks[-1]) + 1 if len(breaks) else 0)
            if last > at:
                cut = last
                break
            step *= 2  # a piece longer than the window
        inside = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, cut, "left")]
        yield _LOWER[data[at:cut]], inside - at
        at = cut


def words_of(texts, size=WINDOW):
    """``(words, pieces)`` by window: dictionary-encoded words, and numbers that change between pieces."""
    for data, begins in _windows(texts, size):
        kinds = _CLASS[data]
        word = kinds == _WORD
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        breaks = kinds == _BREAK
        first[begins] |= word[begins]
        last[begins - 1] |= word[begins - 1]
        breaks[begins] = True
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[word]))]
        words = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
        yield words, np.cumsum(breaks, dtype=np.int64)[starts]


def _hashes(words, lang, seed):
    of_lang = xxhash.xxh3_64_intdigest(lang.encode(), seed)
    return np.array([xxhash.xxh3_64_intdigest(w, of_lang) for w in words.to_pylist()], np.uint64)


def _by_lang(batches):
    """``(lang, texts)`` of the record batches ``(lang, text)``."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, batch.column(1).filter(pa.array(codes == code))


def vocabulary(rows, seed):
    """``(lang, word, hash, n)`` of all words of ``(lang, text)``."""

    def summed(tables):
        sums = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

    def named(lang, table):
        for batch in table.to_batches(max_chunksize=1 << 16):
            hashes = pa.array(_hashes(batch.column(0), lang, seed).view(np.int64))
            columns = [pa.repeat(lang, batch.num_rows), batch.column(0), hashes, batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "hash", "n"])

    def counted(batches):
        pending, size = {}, 0
        for lang, texts in _by_lang(batches):
            for words, _ in words_of(texts):
                found = words.dictionary
                counts = np.bincount(words.indices.to_numpy(), minlength=len(found))
                pending.setdefault(lang, []).append(pa.table([found, pa.array(counts)], names=["word", "n"]))
                size += len(found)
                if size >= WORDS_HELD:
                    pending = {of: [summed(tables)] for of, tables in pending.items()}
                    size = sum(t[0].num_rows for t in pending.values())
                    if size >= WORDS_HELD // 2:
                        for of, tables in pending.items():
                            yield from named(of, tables[0])
                        pending, size = {}, 0
        for of, tables in pending.items():
            yield from named(of, summed(tables))
        pa.default_memory_pool().release_unused()

    counts = rows.mapInArrow(counted, "lang string, word binary, hash long, n long")
    return counts.groupBy("lang", "word").agg(F.min("hash").alias("hash"), F.sum("n").alias("n"))


def _identified(words, least):
    """``(words, bits, seed, frequent)``: ``words(seed)`` with ids of so many bits that no frequent word shares its id."""
    for seed in range(16):
        found = checkpointed(words(seed))
        size, frequent = found.agg(F.count(F.lit(1)), F.count_if(F.col("n") >= least)).first()
        enough = size.bit_length() + frequent.bit_length() + 6
        for bits in sorted({min(64, max(LEAST_BITS, enough)), 64}):
            named = found.withColumn("id", F.shiftrightunsigned("hash", 64 - bits))
            several = named.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"))
            if several.filter((F.col("words") > 1) & (F.col("most") >= least)).isEmpty():
                return named, bits, seed, frequent
    raise RuntimeError("no seed keeps the words apart")


def _bitmap(places, size):
    """Bytes of a bitmap of the places (of ``PLACE_BITS`` bits), wide enough for ``size`` of them, and its shift."""
    bits = min(PLACE_BITS, max(15, (BITS_PER_GRAM * size).bit_length()))
    shift = PLACE_BITS - bits
    at = F.shiftright("place", shift) + 1
    blocks = places.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("marks")
    )
    whole = bytearray(1 << (bits - 3))
    for row in blocks.collect():  # 4,096 blocks of 4 KB at most
        start = (row["block"] - 1) * len(row["marks"])
        whole[start : start + len(row["marks"])] = row["marks"]
    return bytes(whole), shift


def _place(limbs, bits):
    return limbs[0] >> np.uint64(bits - PLACE_BITS)


def _marked(bitmap, places):
    data, shift = bitmap
    places = (places >> np.uint64(shift)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1


def _grams(texts, lang, order, bits, seed, bitmaps):
    """Permuted grams of ``order`` words whose words and shorter phrases may all be frequent."""
    for words, pieces in words_of(texts):
        if len(pieces) < order:
            continue
        ids = _hashes(words.dictionary, lang, seed) >> np.uint64(64 - bits)
        at = words.indices.to_numpy()
        common = _marked(bitmaps[0], _place([ids], bits))[at]
        ids = ids[at]
        stop = len(ids) - order + 1
        good = pieces[:stop] == pieces[order - 1 :]
        for i in range(order):
            good &= common[i : i + stop]
        begins = np.flatnonzero(good)
        if order > 2:
            for i in (0, 1):
                shorter = qf.permuted([ids[begins + i + j] for j in range(order - 1)], bits)
                begins = begins[_marked(bitmaps[-1], _place(shorter, bits))]
        if len(begins):
            yield qf.permuted([ids[begins + j] for j in range(order)], bits)


def _counted(rows, order, bits, seed, bitmaps, least, bucket_bits):
    """``(ids, n, place)`` of the grams of ``order`` words that occur ``least`` times."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)

    def parts(limbs, counts):
        buckets = (limbs[0] >> np.uint64(bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(counts), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        data = [
            qf.encoded([x[a:b] for x in limbs], counts[a:b], bits, bucket_bits) for a, b in zip(starts, [*starts[1:], len(counts)])
        ]
        return pa.RecordBatch.from_arrays([pa.array(buckets[starts].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "part"])

    def filled(batches):
        held, pending, size = [], [], 0
        for lang, texts in _by_lang(batches):
            for limbs in _grams(texts, lang, order, bits, seed, shared.value):
                pending.append((limbs, np.ones(len(limbs[0]), np.int64)))
                size += len(limbs[0])
                if size >= HELD:
                    held = [qf.merged([*held, *pending], bits)]
                    pending, size = [], 0
                    if len(held[0][1]) >= HELD:
                        yield parts(*held[0])
                        held = []
        if held or pending:
            yield parts(*qf.merged([*held, *pending], bits))

    def frequent(limbs, counts):
        keep = counts >= least
        limbs = [x[keep] for x in limbs]
        places = _place(limbs, bits).astype(np.int64)
        ids = np.stack(qf.restored(limbs, bits), axis=1).reshape(-1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * order), pa.array(ids))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts[keep]), pa.array(places)], names=["ids", "n", "place"])

    def joined(batches):
        at, held, pending, size = None, [], [], 0
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != at and at is not None:
                    yield frequent(*qf.merged([*held, *pending], bits))
                    held, pending, size = [], [], 0
                at = bucket
                pending.append(qf.decoded(part.as_buffer(), order, bits, bucket, bucket_bits))
                size += len(pending[-1][1])
                if size >= max(HELD, len(held[0][1]) if held else 0):
                    held, pending, size = [qf.merged([*held, *pending], bits)], [], 0
        if at is not None:
            yield frequent(*qf.merged([*held, *pending], bits))

    filters = rows.mapInArrow(filled, "bucket int, part binary")
    dealt = filters.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(joined, "ids array<long>, n long, place long")


def _looked_up(rows, lookup, key):
    """``rows`` with the columns of ``lookup`` (each ``key`` once); frequent keys of ``rows`` meet theirs by broadcast."""
    asked = rows.groupBy(key).agg(F.count(F.lit(1)).alias("asked"))
    return hot_lookup(rows, lookup.join(asked, key), [key], "asked", how="inner").drop("asked")


def counted_phrases(documents, lang="lang", text="text", longest=LONGEST, least=LEAST):
    """``(words, grams)``: ``(lang, word, id, n)`` of every word, ``(ids, n)`` of the frequent phrases of two words or more."""
    rows = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")
    ).filter("text is not null")
    words, bits, seed, frequent = _identified(lambda s: vocabulary(rows, s), least)
    words = words.withColumn("word", F.col("word").cast("string"))
    common = words.filter(F.col("n") >= least)
    occurrences = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A range of quotients holds HELD entries on average if no two grams were equal.
    bucket_bits = min(20, max(5, (occurrences // HELD).bit_length()))
    bitmaps = [_bitmap(common.select(F.shiftrightunsigned("hash", 64 - PLACE_BITS).alias("place")), frequent)]
    levels = []
    for order in range(2, longest + 1):
        grams = checkpointed(_counted(rows, order, bits, seed, bitmaps, least, bucket_bits))
        levels.append(grams.select("ids", "n"))
        if order < longest:
            size = grams.count()
            if not size:
                break
            bitmaps = [bitmaps[0], _bitmap(grams.select("place"), size)]
    grams = levels[0]
    for more in levels[1:]:
        grams = grams.unionByName(more)
    return words, grams


def scored(words, grams, scale=SCALE):
    """``grams`` with ``a``, and ``score``, ``l`` and ``r`` of the cut that scores lowest."""
    counts = words.select(F.array("id").alias("part"), "n").unionByName(grams.select(F.col("ids").alias("part"), "n"))
    cuts = grams.select("ids", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("cut"))
    sides = F.array(
        F.struct(F.lit(True).alias("first"), F.expr("slice(ids, 1, cut)").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("slice(ids, cut + 1, size(ids))").alias("part")),
    )
    asking = cuts.withColumn("side", F.explode(sides)).select("ids", "a", "cut", "side.first", "side.part")
    found = _looked_up(asking, counts, "part").groupBy("ids", "a", "cut").agg(
        F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r")
    )
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * {scale}) div ({wide('l')} * {wide('r')})")
    least = found.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    return least.select("ids", "a", "least.score", "least.l", "least.r")


def contained(grams):
    """``(ids, within)``: phrases inside longer ones, and the largest count of those."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))"
    )
    longer = grams.filter(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "n")
    return longer.groupBy("ids").agg(F.max("n").alias("within"))


def collocations(documents, lang="lang", text="text", longest=LONGEST, least=LEAST, best=BEST, share=SHARE):
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``best`` phrases of each language."""
    words, grams = counted_phrases(documents, lang, text, longest, least)
    kept = scored(words, grams).join(contained(grams), "ids", "left")
    kept = kept.filter(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a"))).drop("within")
    spelled = _looked_up(kept.select("ids", F.posexplode("ids").alias("at", "id")), words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(
        F.min("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"),
    )
    rows = checkpointed(kept.join(spelled, "ids").select("lang", "phrase", "a", "l", "r", "score"))
    # Ranked in parts first, so many that a part and what the parts leave of a language are alike in size.
    parts = 1 + int((rows.count() / best) ** 0.5)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    ranked = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for group in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
