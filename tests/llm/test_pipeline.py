"""The pipeline's stages against brute force on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from adspark.llm import queries
from tests.llm.test_operators import brute_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        function(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "token_output":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda rows: Counter(r.doc_id for r in rows)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    kept = con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op8_quality_rules']}) WHERE kept").fetchdf()
    assert ids(seen["quality_rules"][1]) == Counter(kept["doc_id"].tolist())
    before, after = seen["jaccard_join"]
    parts = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert ids(after) == Counter({c for _, _, c in parts})
    before, after = seen["decontamination"]
    bad = set(con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op10_decontamination']}) WHERE contaminated").fetchdf()["doc_id"])
    assert ids(after) == Counter(r.doc_id for r in before if r.doc_id not in bad)
    before, after = seen["mixing"]
    words = lambda rows: sum(len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in rows)
    assert abs(words(after) - words(before)) < 256 * 20 and ids(after).keys() <= ids(before).keys()
    before, after = seen["token_output"]
    assert ids(after) == ids(before) and sorted(r.start for r in after)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in after)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for name, function in corpus_pipeline.STAGES:
        function(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
