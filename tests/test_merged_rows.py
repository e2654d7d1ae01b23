"""Trees learn the same from rows that are merged with their weights, and the rankers' rows are written narrow and once."""

import pytest

from adspark import queries, queries_ranking
from adspark.operators import models


def test_merged_rows_teach_the_same(spark):
    data = [(float(i % 7), float(i % 5), float((i * i) % 3 == 1), 3.0 if (i * i) % 3 == 1 else 1.0) for i in range(400)]
    rows = spark.createDataFrame(data, "a double, b double, label double, sample_weight double")
    merged = models.merged_rows(rows, ["a", "b"])
    assert merged.count() < 100 and merged.groupBy().sum("sample_weight").first()[0] == sum(d[3] for d in data)
    asked = rows.select("a", "b").distinct()
    want, got = ({(r.a, r.b): r.p for r in models.positive_probability(models.fit_coarse_ranker(x, ["a", "b"]), asked, "p").collect()} for x in (rows, merged))
    assert len({round(p, 6) for p in want.values()}) > 1 and got == pytest.approx(want, abs=1e-9)


def test_training_rows_are_written_once(spark, monkeypatch):
    written, kept = [], queries_ranking.staged
    monkeypatch.setattr(queries_ranking, "staged", lambda df, name: (written.append((name, df.columns)), kept(df, name))[1])
    past, future = queries_ranking._training(spark, "/root/testdata/sf0.001", "user_id", "conversion_label")
    assert written == [("training", ["click_timestamp", "user_id", "conversion_label"])]
    want = [x.count() for x in queries._past_future(spark, "/root/testdata/sf0.001", "user_id")]
    assert [past.count(), future.count()] == want and all(want)
