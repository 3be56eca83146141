"""What travels in a join by cells."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assaykit.operators import cells


def test_a_vector_visits_a_region_once():
    regions = np.array([0, 1, 0, 1, 2])
    found = cells.visiting([np.array([0, 2, 3]), np.array([], dtype=int), np.array([4, 1, 3])], regions)
    assert [list(r) for r in found["regions"]] == [[0, 1], [], [1, 2]]
    assert [[sorted(c) for c in row] for row in found["cells"]] == [[[0, 2], [3]], [], [[1, 3], [4]]]


def test_a_self_join_sends_a_row_once_to_a_pair_of_blocks(spark, monkeypatch):
    """Every unordered pair is met once; a row is sent to as many pairs of blocks as its cell has blocks."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    rows = spark.range(57).select(F.col("id").alias("row_id"), F.when(F.col("id") < 50, 0).otherwise(F.col("id")).alias("cell"))
    payload = rows.select("row_id", (F.col("row_id") * 2).alias("twice"))

    def compare(left, right, same):
        n = len(left) * (len(left) - 1) // 2 if same else len(left) * len(right)
        assert (left["twice"] == 2 * left["row_id"]).all()
        return pd.DataFrame({"pairs": [n], "sent": [len(left) if same else len(left) + len(right)]})

    for few in (True, False):
        found = cells.cell_self_join(rows, compare, "pairs long, sent long", few, payload).toPandas()
        assert found["pairs"].sum() == 50 * 49 // 2 and found["sent"].sum() == 50 * 4


def test_squares_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(cells, "SQUARE", 4)
    met = [(a, b) for i, j in cells.squares(np.arange(10), np.arange(7)) for a in i for b in j]
    assert sorted(met) == [(a, b) for a in range(10) for b in range(7)]
    met = {(a, b) for i, j in cells.squares(np.arange(10), np.arange(10), below=True) for a in i for b in j}
    assert met >= {(a, b) for a in range(10) for b in range(a, 10)} and (9, 0) not in met


def test_copies_are_sent_in_rounds(spark, monkeypatch):
    """Where many copies of a table would be sent, every pair of blocks is met in one of several rounds, with the same results."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 20).alias("cell"))
    written = []
    kept = cells.checkpointed
    monkeypatch.setattr(cells, "checkpointed", lambda df: written.append(df.columns) or kept(df))

    def each(left, right):
        return pd.DataFrame({"pairs": [len(left) * len(right)], "low": [min([*left["row_id"], *right["row_id"]])]})

    for few in (True, False):
        for join, table, compare in ((cells.cell_self_join, (rows,), lambda a, b, same: each(a, b)), (cells.cell_join, (rows, rows), each)):
            monkeypatch.setattr(cells, "ROUND_BYTES", 1 << 30)
            given = {"table_rows": 300} if join is cells.cell_self_join else {}
            whole = join(*table, compare, "pairs long, low long", few).toPandas()
            monkeypatch.setattr(cells, "ROUND_BYTES", 8 * 300)
            monkeypatch.setattr(cells, "ROUND_COPIES", 2)
            written.clear()
            found = join(*table, compare, "pairs long, low long", few, row_bytes=8, **given).toPandas()
            assert sum(c == ["pairs", "low"] for c in written) > 2
            assert sorted(map(tuple, found.values)) == sorted(map(tuple, whole.values))
