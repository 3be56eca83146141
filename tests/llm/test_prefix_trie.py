"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assaykit.llm import prefix_trie, queries
from assaykit.llm.common import read


def plain_trie(sequences):
    """Rows of the contract from ``{conv_id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in convs if len(sequences[c]) == len(node))
        rows[(min(convs), len(node))] = (
            min(members[node[:-1]]) if node else None,
            len(convs),
            sum(len(m) == len(node) + 1 for m in below),
            sum(not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in below) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return rows


def found(nodes):
    return {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in nodes.collect()
    }


def trie_of(spark, sequences, width=None):
    steps = [(c, d + 1, len(t), role, text) for c, t in sequences.items() for d, (role, text) in enumerate(t)]
    rows = spark.createDataFrame(steps, "conv_id long, depth long, last long, role string, text string")
    steps = rows.select(
        "conv_id", "depth", "last", F.xxhash64(F.lit(1), "role", "text").alias("left"),
        F.xxhash64(F.lit(2), "role", "text").alias("right"), F.octet_length("text").cast("long").alias("bytes"),
    )
    ends = spark.createDataFrame([(c, len(t)) for c, t in sequences.items()], "conv_id long, last long")
    return found(prefix_trie.trie(steps.repartition(3), ends, width))


def random_sequences(draw, n, longest):
    words = ["", "a", "é", "long text"]
    return {c: [(draw.choice("ua"), draw.choice(words)) for _ in range(draw.randrange(longest))] for c in range(-3, n)}


@pytest.mark.parametrize("width", [None, 4])
def test_trie(spark, width):
    """Also with a sketch so small that it proves next to nothing."""
    sequences = random_sequences(random.Random(3), 60, 6)
    assert trie_of(spark, sequences, width) == plain_trie(sequences)


def test_long_conversations(spark, monkeypatch):
    """Conversations of many runs, equal up to their middle; one is a prefix of another."""
    monkeypatch.setattr(prefix_trie.along, "__defaults__", (False, 4))
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    same = [("u", str(i)) for i in range(30)]
    sequences = {c: same[: 12 + c] for c in range(5)} | {9: [*same[:17], ("a", "x")], 10: same, 11: same, 12: [], 13: same[:1], 14: same}
    assert trie_of(spark, sequences) == plain_trie(sequences)


def test_one_and_none(spark):
    assert trie_of(spark, {5: [("u", "a")]}) == plain_trie({5: [("u", "a")]})
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(*queries.rebuilt(prefix_trie.numbered_turns(empty))).count() == 0


def plain_rebuilt(rows):
    """The contract's conversations from ``(conv_id, turn, role, text)`` rows."""
    import zlib

    turns = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=order):
        turns[c].append((role or "", text or ""))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = turns.get(donor, [])[:h] + own[h:]
    return made


def test_query_on_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, a hot conversation, clashing columns."""
    draw = random.Random(5)
    rows = [(draw.randrange(-12, 40), draw.choice([None, 0, 1, 2, 3]), draw.choice(["u", None]), draw.choice(["a", "", None, "ß"])) for _ in range(300)]
    rows += [(20, i, "u", str(i)) for i in range(150)] + [(None, 1, "u", "a"), rows[0], rows[0]]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    for name in ("depth", "last", "a", "place"):
        df = df.withColumn(name, F.lit("x"))
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(queries.op11_prefix_trie(spark, str(tmp_path))) == plain_trie(plain_rebuilt(rows))


def test_screening_proves_most(spark, folder):
    """With the given width next to no prefix of one conversation is shuffled, and no shared one is taken for single."""
    turns = prefix_trie.numbered_turns(read(spark, folder, "conversations"))
    rows = prefix_trie.prefixes(*queries.rebuilt(turns))
    marked = prefix_trie.screened(rows, prefix_trie.sketch_width(rows.count()))
    counted = marked.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("shared").alias("shared"), F.min("shared").alias("least"))
    assert counted.filter("n > 1 and not least").count() == 0
    assert counted.filter("n = 1 and shared").count() <= 2
