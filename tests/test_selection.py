"""A selection orders only the rows whose score a fraction cuts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adspark.operators import auction, ordering


def test_ties_at_the_cuts_alone_are_ordered(spark, monkeypatch):
    rng = random.Random(2)
    data = [(f"e{i:04}", i % 2, float(rng.randint(0, 50)), float(rng.choice([1, 1, 1, 2, 3, 4, 9])), rng.random()) for i in range(400)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "event_id string, conversion_label int, conversion_value_eur double, few double, many double")
    sizes, plain = [], ordering.dealt
    monkeypatch.setattr(ordering, "dealt", lambda rows, order: sizes.append((rows.columns, rows.count())) or plain(rows, order))
    fractions = (0.001, 0.1, 0.5, 0.55, 1.0)
    found = {(r.policy, r.fraction): (r.selected, r.conversions, round(r.value, 6)) for r in auction.selection(df, {"few": F.col("few"), "many": F.col("many")}, fractions).collect()}
    for at, name in ((3, "few"), (4, "many")):
        order = sorted(data, key=lambda r: (-round(r[at], 9), r[0]))
        for f in fractions:
            first = order[: max(1, math.ceil(len(data) * f))]
            assert found[name, f] == (len(first), sum(r[1] for r in first), pytest.approx(sum(r[2] for r in first)))
    assert found["random_baseline", 1.0][:2] == (400, 200) and found["random_baseline", 0.1][0] == 40
    with_keys = [n for columns, n in sizes if "k" in columns]
    assert sum(with_keys) < 400  # three orders of all rows before


def test_empty_selection(spark):
    df = spark.createDataFrame([], "event_id string, conversion_label int, conversion_value_eur double, s double")
    assert auction.selection(df, {"s": F.col("s")}, (0.5,)).count() == 0
