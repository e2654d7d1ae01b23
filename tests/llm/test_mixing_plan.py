"""The mix sends no table that grows with the texts through the driver."""

from pyspark.sql import functions as F

from adspark.llm import mixing


def test_pieces_are_never_broadcast(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.expr("array_join(transform(sequence(1, 500), x -> 'w'), ' ')").alias("text"))
    texts, slots = mixing.mix_sources(df)
    found = mixing.taken_words(texts, slots)
    rows = found.select("size", "taken", "target", "source").collect()  # AQE has the last say
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 300 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for name in ("s0", "s1", "s2"):
        mine = [r for r in rows if r.source == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.05 * mine[0].target
