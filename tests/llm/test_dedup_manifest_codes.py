"""MinHash near-dedup, the Merkle manifest and vector codes against brute force and on their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import decontamination, merkle, minhash, queries, toxicity, vector_codes
from tests.llm.test_operators import BASE, SCHEMA, TEXTS, brute_components, edited, text

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def near_copies():
    """Chains whose ends are not alike, short texts around the threshold, and a bucket's worth of copies with one word changed."""
    out = list(TEXTS)
    chain = text(120, 11)
    for k in range(8):
        chain = edited(chain, [10 * k + 3])
        out.append(chain)
    for n in (5, 6, 8, 11, 15, 30):
        short = text(n, 100 + n)
        out += [short, short + " more", short + " more and more", edited(short, [0])]
    out += [edited(BASE, [k]) for k in range(20, 60)]
    out += [text(60, 900) + " " + text(15, 1000 + k) for k in range(30)]  # a passage that many share
    return out


def test_near_duplicates(spark, width=5):
    others = ("x", "x", 1, *("x",) * 7)
    rows = [(i, t, *others) for i, t in enumerate(near_copies())] + [(None, BASE, *others), (None, None) + (None,) * 10, (7, None, *others)]
    clashing = "cid long, cls string"
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], f"{SCHEMA}, {clashing}").repartition(5)
    got = minhash.near_duplicates(df, width, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([r[:2] for r in rows], width, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    wordless = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(wordless).collect()) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    for size, shared in ((6, 5), (40, 36), (2000, 1800)):
        agree, differ = [], []
        for _ in range(200):
            h = rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(h[:size]), np.sort(h[-size:])
            a, b = minhash.bin_values(a), minhash.bin_values(b)
            agree.append(np.mean(a == b))
            differ.append(np.mean(np.unpackbits((minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint8))))
        alike = shared / (2 * size - shared)
        assert abs(np.mean(agree) - alike) < 0.03 and abs(np.mean(differ) - (1 - alike) / 2) < 0.02
        assert max(differ) * minhash.BINS <= minhash.most_different(round(100 * alike))


def brute_tree(leaves):
    """(subroot, for each leaf its siblings a level)."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // 8 * 8 : place // 8 * 8 + 8]
            proofs[i].append((run[: place % 8], run[place % 8 + 1 :]))
        level, at = [H("".join(level[k : k + 8])) for k in range(0, len(level), 8)], [p // 8 for p in at]
    return (level[0] if level else None), proofs


def brute_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(one(x) for x in (r[0], r[3], r[2], r[4], t)))
    by = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        altered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1]
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, altered), r[0]))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by[g])]) for g in groups]
    root, tops = brute_tree([t[0] for t in trees])
    out = []
    for g, (sub, proofs), top in zip(groups, trees, tops, strict=True):
        for (_, _, own, altered, doc_id), proof in zip(sorted(by[g]), proofs, strict=True):
            node = altered
            for left, right in proof + top:
                node = H("".join(left) + node + "".join(right))
            out.append((doc_id, own, sub, root, H("".join("".join(a + b) for a, b in proof + top)), node, node == root))
    return out


@pytest.mark.parametrize("size", [3, merkle.BLOCK])
def test_manifest(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    langs = [None, "", "de", "en", "é", "one"]
    rows = [(i, rng.choice([None, "", f"Text {i}", "SAME", BASE]), langs[min(4, int(rng.expovariate(0.7)))], rng.choice([None, "s"]), rng.choice([None, i])) for i in range(150)]
    rows += [rows[3], rows[3], rows[5], (None, "Null", "en", None, 1), (None, "Null", "en", None, 2), (9, None, "one", None, None)]
    rows += [(500 + i, "Hot", "hot", "s", 1) for i in range(600)] + [(7, "Copy", "hot", "s", 1)] * 40
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, path long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    full = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: full(*a, size))
    monkeypatch.setattr(merkle, "GIVEN", 16)
    got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]
    want = brute_manifest(rows)
    assert Counter(r[:4] + r[5:] for r in got) == Counter(r[:4] + r[5:] for r in want)
    assert Counter(got) == Counter(want)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_manifest_of_many_groups_and_of_none(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 10)
    rows = [(i, f"T{i}", f"l{i % 90}", None, None) for i in range(200)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()) == Counter(brute_manifest(rows))
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op12_merkle(spark, str(tmp_path / "none")).count() == 0


def test_blocks_ask_for_what_they_lack():
    for n in (1, 2, 8, 9, 64, 65, 513, 1000):
        for first in range(0, n, 37):
            many = min(37, n - first)
            known = {(level, i) for level, (low, nodes) in enumerate(merkle.subtrees(["0" * 64] * many, first, n)) for i in range(low, low + len(nodes))}
            asked = set(merkle.runs_asked(first, many, n))
            size = n
            for level in range(merkle.height(n)):
                for i in range(first // 8**level, (first + many - 1) // 8**level + 1):
                    run = i // 8
                    whole = all((level, j) in known for j in range(8 * run, min(8 * run + 8, size)))
                    assert whole or (level, run) in asked
                size = -(-size // 8)


def brute_codes(rows, entries):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = next(len(r[1]) for r in kept if len(r[1]) and len(r[1]) % 4 == 0)
    fit = [r for r in kept if len(r[1]) == length]
    width = length // 4
    parts = [[[math.floor(1024 * x) for x in r[1][p * width : (p + 1) * width]] for r in fit] for p in range(4)]
    books = [[list(v) for v in parts[p][:entries]] for p in range(4)]
    way = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (way(v, book[e]), e))
    for _ in range(4):
        for p in range(4):
            own = [near(v, books[p]) for v in parts[p]]
            for e in set(own):
                of = [v for v, o in zip(parts[p], own, strict=True) if o == e]
                books[p][e] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    found, sums = [], Counter()
    for i, r in enumerate(fit):
        own = [near(parts[p][i], books[p]) for p in range(4)]
        error = sum(way(parts[p][i], books[p][own[p]]) for p in range(4))
        found.append((r[0], "".join(f"{o:02x}" for o in own), error, r[2]))
        sums[r[2]] += error
    digest = H(",".join(str(x) for book in books for v in book for x in v))
    coded = [(i, c, e, sums[label], digest) for i, c, e, label in found]
    labels = {r[2] for r in fit}
    return coded + [(r[0], None, None, sums[r[2]] if r[2] in labels else None, digest) for r in kept if len(r[1]) != length]


def vectors(n, seed, length=8, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, length)) * scale
    return [[float(x) for x in np.float32(centres[i % 12] + rng.normal(size=length) * 0.1)] for i in range(n)]


@pytest.mark.parametrize(("entries", "scale"), [(5, 0.003), (256, 1.0), (16, 500.0)])
def test_codes(spark, monkeypatch, entries, scale):
    monkeypatch.setattr(vector_codes, "ENTRIES", entries)
    rows = [(1000 - 2 * i, v, i % 5 or None) for i, v in enumerate(vectors(220, 1, scale=scale))]
    rows += [(3, rows[4][1], 2), (3, rows[4][1], 2), (3, rows[9][1], 2), (None, rows[7][1], 9), (5, None, 1), (6, [], 1), (7, [1.0] * 7 + [None], 1), (9, [1.0] * 7 + [math.inf], 1), (11, [math.nan] * 8, 1), (13, [0.5] * 4, 77), (2000, [0.0] * 8, 3)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, own string, upper double").repartition(4)
    got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.codes(df).collect()]
    assert Counter(got) == Counter(brute_codes([(a, None if v is None else v, c) for a, v, c in rows], entries))


def test_bounds_spare_scans_and_change_nothing(spark, monkeypatch):
    rows = [(i, v, 1) for i, v in enumerate(vectors(3000, 5, 16))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    seen = []
    real = vector_codes.stage
    monkeypatch.setattr(vector_codes, "stage", lambda d, name: seen.append((name, real(d, name))) or seen[-1][1])
    books, states, _ = vector_codes.learn(df)
    scans = {name: d.agg(F.sum("scanned")).first()[0] for name, d in seen if name.startswith("states")}
    assert scans["states0"] == 4 * 3000 and scans["states4"] < scans["states0"]
    for r in states.collect():
        points = np.array(r.ints).reshape(4, 4)
        assert [int(((books[p] - points[p]) ** 2).sum(1).argmin()) for p in range(4)] == list(r.own)


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.codes(empty).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0], 4), (2, None, 4)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.codes(odd).collect()] == [(1, None, None, None)]
    with pytest.raises(ValueError, match="exact"):
        vector_codes.codes(spark.createDataFrame([(1, [1e30] * 4, 4)], "vec_id long, embedding array<double>, label int"))


def test_item_without_an_id_keeps_its_hits(spark):
    words = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(None, words), (5, words), (6, "other " * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, words), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.match_benchmark(docs, items).collect()}
    assert got == {1: (20, 20, ["", "5"]), 2: (0, 0, [])}


def test_toxicity_reads_no_other_columns(spark):
    rows = [(i, ("awful nasty words " if i % 4 == 0 else "kind gentle talk ") + text(10, 300 + i), "x", 1, "y") for i in range(40)]
    clashing = spark.createDataFrame(rows, "doc_id long, text string, _own string, _toxic int, _key string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(30)], "doc_id long, toxic int")
    score = lambda df: sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_texts(df, toxicity.fit(df, labels, F.col("doc_id") >= 0)).collect())
    assert score(clashing) == score(clashing.select("doc_id", "text"))
