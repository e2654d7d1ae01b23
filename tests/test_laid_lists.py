"""Lists are laid by user once, and global ones join them there; sums keep what a best list needs, whatever rows' lengths."""

import numpy as np

from adspark.operators import neighbours, recall

LISTS = "user_id string, candidate_ad_id string, rank int"


def test_fusing_laid_lists_takes_one_shuffle(spark):
    own = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "b", 5), ("v", "c", 1)], LISTS)
    popular = spark.createDataFrame([("b", 1), ("d", 2)], "candidate_ad_id string, rank int")
    fused = recall.rrf(recall.laid_lists({"itemcf": own}, popular), {"itemcf": 2.0, "popularity": 1.0}, 10, 2, laid=True)
    text = fused._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    want = {("u", "a", round(2 / 11, 12), 1), ("u", "b", round(2 / 12 + 1 / 11, 12), 2), ("v", "c", round(2 / 11, 12), 1), ("v", "b", round(1 / 11, 12), 1)}
    assert {tuple(r) for r in fused.collect()} == want


def test_global_list_for_given_users(spark):
    own = spark.createDataFrame([("u", "a", 1), ("v", "a", 1)], LISTS)
    popular = spark.createDataFrame([("a", 1)], "candidate_ad_id string, rank int")
    users = spark.createDataFrame([("u",), ("u",), ("w",)], "user_id string")
    found = [tuple(r) for r in recall.laid_lists({"itemcf": own}, popular, users).collect()]
    assert sorted(found) == [("u", "a", "itemcf", 1), ("u", "a", "popularity", 1), ("v", "a", "itemcf", 1), ("w", "a", "popularity", 1)]
    assert recall.laid_lists({"itemcf": own.where("false")}, popular.where("false"), users).count() == 0


def test_sums_of_uneven_rows():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 40, 3, 17, 16, 0, 33])
    items = np.concatenate([rng.choice(60, n, False) for n in lengths]).astype(np.int32)
    block = neighbours._Block()
    block.ask(["x", "y"], np.array([2, 3]), np.array([5, 9, 5, 1, 2], np.int32), np.array([1.0, 3.0, 1.0, 1.0, 3.0]))
    values = rng.random(len(items))
    block.need(lengths, items, values)
    rows = [dict(zip(i, v, strict=True)) for i, v in zip(np.split(items, np.cumsum(lengths)[:-1]), np.split(values, np.cumsum(lengths)[:-1]), strict=True)]
    for name, asked in enumerate(({5: 1.0, 9: 3.0}, {5: 1.0, 1: 1.0, 2: 3.0})):
        want = {c: sum(sum(w * r.get(i, 0.0) for i, w in asked.items()) * r.get(c, 0.0) for r in rows) for c in range(60) if c not in asked}
        kept = {}
        for u, _, ids, row, column, sums in block.sums(64, keep=(3, 1e-9)):
            kept |= {int(ids[c]): s for r, c, s in zip(row, column, sums, strict=True) if r + u == name}
        assert {c: round(kept[c], 9) for c in kept} == {c: round(want[c], 9) for c in sorted(want, key=want.get)[-3:]}
        every = {int(ids[c]) for u, _, ids, row, column, _ in block.sums(64) for r, c in zip(row, column, strict=True) if r + u == name}
        assert every == {c for c, s in want.items() if s}
