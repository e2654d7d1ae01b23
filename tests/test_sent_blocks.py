"""Rows go to blocks packed and in no order, blocks are few, and asked rows are met in runs."""

import numpy as np
from pyspark.sql import functions as F

from adspark.operators import neighbours, recall
from tests.test_neighbours import communities


def test_blocks_are_few_and_nothing_is_sorted_on_its_way(spark):
    pairs = spark.createDataFrame(communities(40), "user_id string, product_id string, weight double")
    _, _, rows = neighbours.packed(pairs)
    asked, blocks = neighbours.dealt(rows, "user_id", [F.col("user_id")], 1, 1)
    assert blocks == neighbours.BLOCKS and {r.block for r in asked.collect()} <= set(range(blocks))
    lists, _ = recall.itemcf_lists(pairs, pairs.select("user_id"), 2)
    text = lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Sort [block" not in text and "struct<i:int,x:double>>" not in text


def test_needed_rows_name_their_blocks(spark):
    asked = spark.createDataFrame([("u", [(1, 1.0)], 0), ("v", [(2, 1.0)], 47)], "user_id string, row array<struct<i:int,x:double>>, block int")
    entries = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "user_id string, i int")
    assert sorted(tuple(r) for r in neighbours.needed(asked, entries).collect()) == [("a", 1 | 1 << 47), ("b", 1 << 47)]


def test_numbers_survive_packing():
    rng = np.random.default_rng(1)
    for many in (0, 1, 1000):
        items, values = rng.integers(0, 1 << 30, many).astype(np.int32), rng.random(many)
        found = np.cumsum(neighbours._numbers(neighbours._bytes(neighbours._steps(items)), many, np.int32), dtype=np.int32)
        assert (found == items).all() and (neighbours._numbers(neighbours._bytes(values), many, np.float64) == values).all()


def test_runs_of_any_size_give_the_same_sums():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 9, 60)
    items, values = np.concatenate([rng.choice(40, n, False) for n in lengths]).astype(np.int32), rng.random(lengths.sum())
    found = []
    for at_once, pairs, users in ((1 << 17, 1 << 22, 1 << 16), (8, 1, 1), (300, 20, 7)):
        block = neighbours._Block()
        block.ask(list(range(60)), lengths, items, values)
        block.need(lengths, items, values)
        found.append({(u + int(r), int(ids[c])): round(s, 12) for u, _, ids, row, column, sums in block.sums(at_once, None, pairs, users, np.full(40, 2.0)) for r, c, s in zip(row, column, sums, strict=True)})
    assert found[0] and found[0] == found[1] == found[2]
