"""Candidate lists from ALS factors, and their part in the fused lists."""

import os
from collections import defaultdict

import numpy as np
import pytest

from adspark import queries
from adspark.operators import models
from tests.test_queries import DATA


def test_lists_from_factors(spark, monkeypatch):
    data = [(f"u{u}", f"p{p}", float(1 + (u + p) % 3)) for u in range(12) for p in range(15) if (u * 7 + p * 3) % 4 == 0]
    pairs = spark.createDataFrame(data, "user_id string, product_id string, weight double")
    rows, *tables = models.numbered_ids(pairs)
    model = models.fit_factors(rows, 4)
    monkeypatch.setattr(models, "fit_factors", lambda *_: model)
    names = [{r[number]: r[key] for r in t.collect()} for t, number, key in zip(tables, "ui", ("user_id", "product_id"), strict=True)]
    assert [sorted(n) for n in names] == [list(range(12)), list(range(15))]
    of = lambda df, name: {name[r["id"]]: np.array(r["features"], float) for r in df.collect()}
    users, items, seen = of(model.userFactors, names[0]), of(model.itemFactors, names[1]), {x[:2] for x in data}
    asked = ["u1", "u4", "u5"]
    want = []
    for u in asked:
        best = sorted((-round(float(users[u] @ v), 9), i) for i, v in items.items() if (u, i) not in seen)[:3]
        want += [(u, i, r + 1) for r, (_, i) in enumerate(best)]
    found = models.factor_lists(pairs, spark.createDataFrame([(u,) for u in asked], "user_id string"), 3)
    assert sorted((r[0], r[1], r[3]) for r in found.collect()) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_fused_lists_have_the_source(spark):
    assert {r["source"] for r in queries.QUERIES["source_overlap_all"](spark, DATA).collect()} == {"itemcf", "two_tower", "popularity"}
    by = defaultdict(list)
    for r in queries.QUERIES["fusion_sweep_all"](spark, DATA).collect():
        by[r["variant"]].append((r["cutoff"], r["recall"]))
    assert any(sorted(by[f"rrf_k{k}_i2_t1_p2"]) != sorted(by[f"rrf_k{k}_i1_t2_p2"]) for k in (10, 30, 60, 100))
