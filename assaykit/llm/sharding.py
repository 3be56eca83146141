"""Shards by a keyed permutation of the row numbers: a shuffle that needs no shuffled copy.

Rows are numbered from 0 in the order of their key.  A Feistel network permutes the cells
of a rectangle that is just large enough for the numbers, and a number that comes out
beyond the last row is permuted again until it falls inside (cycle walking).  The
place of a row in the new order gives its shard (the place modulo the number of shards) and
its slot in that shard, so shards differ by a row at most and slots have no gaps.  Both can be
computed from the number alone, and the number back from shard and slot, without the table.

Cases: a null key sorts first.  Rows that tie in every column of the order are
interchangeable: they get neighbouring numbers in any order, and a hot group of them is spread
over the sorted partitions.  Texts, null, empty or long, play no part here.  Other columns are
carried along, but for ``number``, ``shard`` and ``slot``, which are replaced.  An empty table
gives no rows.
"""

import hashlib
import math

from pyspark.sql import functions as F

from assaykit.operators.ranking import row_index

ROUNDS = 8  # an even number, so that the sides of the rectangle end up where they were
PRIME = (1 << 31) - 1  # the round function works in this field; no side is longer
WALKS = 64  # steps taken back into the range; each is needed with a chance of 1 in sqrt(total)
PLACED = ("number", "shard", "slot")


def round_keys(seed, rounds=ROUNDS):
    """Two field elements for each round."""
    digests = [hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(rounds)]
    return [(int.from_bytes(d[:4], "big") % PRIME, int.from_bytes(d[4:8], "big") % PRIME) for d in digests]


def sides(total):
    """``(height, width)`` of a near-square rectangle of ``total`` cells and less than a column more."""
    height = math.isqrt(total - 1) + 1 if total > 1 else 1
    if height > PRIME:
        raise ValueError(f"{total} rows are more than the permutation can number")
    return height, max(1, -(-total // height))


def _long(value):
    return F.lit(value).cast("long")


def _divided(value, by):
    return F.call_function("div", value, _long(by))


def _mixed(value, key):
    """The fifth power, a permutation of the field, of the shifted value, shifted again."""
    t = (value + key["before"]) % _long(PRIME)
    square = t * t % _long(PRIME)
    return ((square * square % _long(PRIME)) * t + key["after"]) % _long(PRIME)


def _network(cell, total, seed, backwards):
    """``cell`` of the rectangle permuted once, or back."""
    height, width = sides(total)
    keys = round_keys(seed)
    schedule = F.array(
        *[F.struct(_long(a).alias("before"), _long(b).alias("after")) for a, b in (reversed(keys) if backwards else keys)]
    )

    def state(x, y, x_side, y_side):
        return F.struct(x.alias("x"), y.alias("y"), x_side.alias("x_side"), y_side.alias("y_side"))

    def forth(s, key):
        return state(s["y"], (s["x"] + _mixed(s["y"], key)) % s["x_side"], s["y_side"], s["x_side"])

    def back(s, key):
        return state(F.pmod(s["y"] - _mixed(s["x"], key), s["y_side"]), s["x"], s["y_side"], s["x_side"])

    start = state(_divided(cell, width), cell % _long(width), _long(height), _long(width))
    return F.aggregate(schedule, start, back if backwards else forth, lambda s: s["x"] * _long(width) + s["y"])


def _walked(number, total, seed, backwards):
    inside = lambda c: c < _long(total)
    step = lambda c: _network(c, total, seed, backwards)
    # A walk visits cells beyond the range only, each once: so many steps always suffice, and WALKS in practice.
    height, width = sides(total)
    steps = min(height * width - total, WALKS)
    first = F.array(step(number))
    if steps:
        again = F.sequence(F.lit(1), F.lit(steps))
        first = F.transform(
            first, lambda c: F.when(inside(c), c).otherwise(F.aggregate(again, c, lambda d, _: F.when(inside(d), d).otherwise(step(d))))
        )
    lost = F.raise_error(F.lit(f"a walk of more than {steps} steps; choose another seed")).cast("long")
    return F.get(F.transform(first, lambda c: F.when(inside(c), c).otherwise(lost)), F.lit(0))


def place(number, total, seed=42):
    """Where row ``number`` (a long column, 0 to ``total`` - 1) comes in the shuffled order."""
    return _walked(number, total, seed, backwards=False)


def number_at(position, total, seed=42):
    """The row number that the shuffled order has at ``position``."""
    return _walked(position, total, seed, backwards=True)


def shard_and_slot(position, shards):
    return (position % _long(shards)).cast("int"), _divided(position, shards)


def position_of(shard, slot, shards):
    return slot.cast("long") * _long(shards) + shard.cast("long")


def shard_rows(total, shards):
    """Rows in each shard."""
    return [(total - s + shards - 1) // shards for s in range(shards)]


def sharded(rows, order, shards, seed=42):
    """``rows`` with ``number`` in the order of the columns ``order``, and ``shard`` and ``slot`` of each.

    The place does not depend on how the rows are partitioned.  Rows are range-sorted, so
    pass narrow ones: join wide columns to the result by key.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = rows.drop(*PLACED)
    spread = "_spread_" + "_".join(rows.columns)  # a name that no column has
    salted = rows.withColumn(spread, F.monotonically_increasing_id())
    numbered = row_index(salted, [*[F.col(f"`{c}`").asc_nulls_first() for c in order], spread], name="number").drop(spread)
    total = numbered.count()
    if not total:
        return numbered.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    placed = numbered.withColumn("slot", place(F.col("number"), total, seed))
    shard, slot = shard_and_slot(F.col("slot"), shards)
    return placed.withColumn("shard", shard).withColumn("slot", slot).select(*rows.columns, *PLACED)
