"""The vector index, gradient steps, towers and joint rankers: against exhaustive search, finite differences and invariants."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adspark.operators import candidates, joint, learning, metrics, recall, towers, vector_index, windows
from adspark.operators.joint import Esmm, ValueNetwork
from adspark.operators.towers import Settings, Tower
from adspark.sources import artefacts

RNG = np.random.default_rng(4)


@pytest.fixture(scope="module")
def vectors(spark):
    centres = RNG.normal(size=(30, 12))
    rows = [(f"u{i}", [float(x) for x in centres[i % 30] + 0.3 * RNG.normal(size=12)]) for i in range(900)]
    return recall.unit_vectors(spark.createDataFrame([*rows, ("none", None)], "id string, embedding array<double>").where("embedding IS NOT NULL")).cache()


def pairs(df):
    return {(r["query"], r["item"]): round(r["score"], 6) for r in df.collect()}


def test_index_is_exact_with_all_cells_and_near_with_few(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ITEMS", 16)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 8)
    index = vector_index.build(vectors, "id", "embedding", cells=24)
    asked = vectors.where("id LIKE '%7'")
    exact = recall.vector_top_k(asked, vectors, 10, "id", "embedding").cache()
    assert pairs(vector_index.search(index, asked, "id", "embedding", 10, 24, same=True)) == pairs(exact)
    probes, tried = vector_index.choose_probes(index, asked, exact, "id", "embedding", 10, 0.9, same=True)
    assert tried[-1] == (probes, pytest.approx(tried[-1][1])) and tried[-1][1] >= 0.9 and probes < 24
    assert vector_index.compared(index, asked, "embedding", probes) < asked.count() * 900 / 3
    assert Counter(r["cell"] for r in index.items.collect()).total() == 900


def test_width_doubles_until_enough_is_unseen(spark, vectors):
    index = vector_index.build(vectors, "id", "embedding", cells=9)
    asked = vectors.where("id IN ('u1', 'u2', 'u3')")
    exact = {r["query"]: [] for r in asked.selectExpr("id AS query").collect()}
    for r in sorted(recall.vector_top_k(asked, vectors, 900, "id", "embedding", same=False).collect(), key=lambda r: r["rank"]):
        exact[r["query"]].append(r["item"])
    gone = {"u1": exact["u1"][:300], "u2": exact["u2"][:3], "u3": exact["u3"][:897]}
    seen = spark.createDataFrame([(q, i) for q, of in gone.items() for i in of], "query string, item string")
    got = defaultdict(list)
    for r in sorted(vector_index.search_unseen(index, asked, "id", "embedding", seen, 5, 9).collect(), key=lambda r: r["rank"]):
        got[r["query"]].append(r["item"])
    assert dict(got) == {q: [i for i in exact[q] if i not in gone[q]][:5] for q in exact} and len(got["u3"]) == 3


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    index = vector_index.build(empty, "id", "v")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert vector_index.search(index, empty, "id", "v", 3, 2).count() == 0
    one = vector_index.build(some, "id", "v")
    assert [tuple(r) for r in vector_index.search(one, some, "id", "v", 3, 2).collect()] == [(1, 1, 1.0, 1)]


def examples(n=24, products=6):
    item = RNG.integers(0, products, n)
    return pd.DataFrame({
        "user_feats": [list(RNG.choice(20, RNG.integers(1, 4), replace=False)) for _ in range(n)], "user_numbers": [list(RNG.normal(size=2)) for _ in range(n)],
        "feats": [[int(i), 10 + int(i) % 3] for i in item], "numbers": [[float(i)] for i in item], "item": item, "weight": RNG.choice([1.0, 3.0], n),
        "drawn": [[{"feats": [int(j), 10 + int(j) % 3], "numbers": [float(j)]} for j in RNG.integers(0, products, RNG.integers(0, 5))] for _ in range(n)],
    })


def check_gradient(gradient, parameters, df):
    grads, loss, weight = gradient(parameters, df)
    for name, matrix in parameters.items():
        full = np.zeros_like(matrix)
        at, g = grads[name]
        full[at] = g
        for _ in range(6):
            i, j = RNG.integers(matrix.shape[0]) if not len(at) else RNG.choice(at), RNG.integers(matrix.shape[1])
            moved = []
            for step in (1e-5, -1e-5):
                other = {n: p.copy() for n, p in parameters.items()}
                other[name][i, j] += step
                moved.append(gradient(other, df)[1])
            assert math.isclose((moved[0] - moved[1]) / 2e-5, full[i, j], rel_tol=1e-4, abs_tol=1e-5), name
    return loss, weight


@pytest.mark.parametrize("loss", ["sampled", "in_batch"])
def test_tower_gradients(loss):
    tower, settings = Tower("t", ("c",), ("x",), (), ("a", "b"), loss=loss), Settings(size=5, rows=20, temperature=0.5)
    p = {"user_rows": RNG.normal(size=(20, 5)), "item_rows": RNG.normal(size=(20, 5)), "user_numbers": RNG.normal(size=(2, 5)), "item_numbers": RNG.normal(size=(1, 5))}
    check_gradient(towers.gradient_of(tower, settings), p, examples())


def test_in_batch_loss_counts_copies_as_positives():
    u, v = RNG.normal(size=(5, 3)), RNG.normal(size=(3, 3))
    items, w = np.array([0, 1, 0, 2, 0]), np.array([1.0, 2.0, 1.0, 3.0, 1.0])
    want = 0.0
    for i in range(5):
        z = [math.exp(float(u[i] @ v[items[j]]) / 0.3) for j in range(5)]
        want -= w[i] * math.log(sum(z[j] for j in range(5) if items[j] == items[i]) / sum(z))
    assert math.isclose(towers.in_batch_loss(u, v[items], items, w, 0.3)[0], want)


def test_mixed_negatives(spark):
    pool = spark.createDataFrame([(f"p{i}", i) for i in range(12)], "candidate_ad_id string, pos long")
    seen_rows = [("a", "p0"), ("a", "p1"), ("b", "p2"), *(("c", f"p{i}") for i in range(11)), *(("d", f"p{i}") for i in range(12))]
    seen = spark.createDataFrame(seen_rows, "user_id string, product_id string")
    hard = spark.createDataFrame([("a", f"p{i}") for i in range(7)] + [("b", "p2"), ("b", "p5"), ("c", "p3")], "user_id string, candidate_ad_id string")
    got = defaultdict(list)
    for r in towers.mixed_negatives(seen, seen, pool, hard, 3, 3).collect():
        got[r.user_id, r.product_id].append((r.candidate_ad_id, r.hard))
    known = defaultdict(set)
    for u, p in seen_rows:
        known[u].add(p)
    for (u, _), rows in got.items():
        ids = [c for c, _ in rows]
        assert len(set(ids)) == len(ids) <= 6 and not known[u] & set(ids)
    assert all(sum(h for _, h in got["a", p]) == 3 for p in ("p0", "p1")) and sum(h for _, h in got["b", "p2"]) == 1
    assert {c for c, _ in got["c", "p4"]} == {"p11"} and not any(u == "d" for u, _ in got)


@pytest.fixture(scope="module")
def clicks(spark):
    """Users of three tastes who click products of their own brand."""
    rows = [(f"u{u}", f"p{p}", int((u + p) % 5 == 0), f"b{p % 3}", 100.0 + p, 1000 + 7 * u + p, "web") for u in range(45) for p in range(30) if u % 3 == p % 3 and (u * 7 + p) % 4]
    return spark.createDataFrame(rows, "user_id string, product_id string, conversion_label int, product_brand string, product_price double, click_timestamp long, device_type string").cache()


def trained(spark, clicks, tower, settings=Settings(size=8, rows=1 << 10, steps=2, epochs=8)):
    catalogue = spark.createDataFrame([(f"p{p}", f"b{p % 3}", 100.0 + p) for p in range(36)], "product_id string, product_brand string, product_price double")
    users = clicks.groupBy("user_id").agg({"product_price": "avg"}).withColumnRenamed("avg(product_price)", "mean")
    items, asked = towers.item_inputs(catalogue, clicks, tower, settings), towers.user_inputs(users, tower, settings)
    return towers.train(clicks, items, asked, tower, settings), items, asked


@pytest.mark.parametrize("loss", ["sampled", "in_batch"])
def test_towers_learn_and_give_cold_products_lists(spark, clicks, loss):
    tower = Tower("t", ("product_brand",), ("product_price",), (), ("mean",), loss=loss)
    model, items, asked = trained(spark, clicks, tower)
    assert model.losses[-1] < model.losses[0]
    assert {r.product_id for r in items.where("cold").collect()} == {f"p{p}" for p in range(30, 36)}
    found = towers.lists(model, items, asked, clicks, 6).collect()
    seen = {(r.user_id, r.product_id) for r in clicks.collect()}
    assert all((r.user_id, r.candidate_ad_id) not in seen for r in found) and Counter(r.user_id for r in found) == {f"u{u}": 6 for u in range(45)}
    cold = [r for r in found if int(r.candidate_ad_id[1:]) >= 30]
    own = [int(r.user_id[1:]) % 3 == int(r.candidate_ad_id[1:]) % 3 for r in cold]
    assert len(cold) > 20 and np.mean(own) > 0.6


def test_training_does_not_depend_on_partitions(spark, clicks, monkeypatch):
    tower = Tower("t", ("product_brand",))
    settings = Settings(size=4, rows=256, steps=2, epochs=2)
    one = trained(spark, clicks.coalesce(1), tower, settings)[0]
    monkeypatch.setattr(towers, "by_step", lambda rows, key, steps: (lambda f: lambda s: f(s).repartition(16))(learning.by_step(rows, key, steps)))
    many = trained(spark, clicks.repartition(9), tower, settings)[0]
    assert np.allclose(one.losses, many.losses) and all(np.allclose(one.parameters[n], many.parameters[n]) for n in one.parameters)


def test_hard_lists_are_unseen_past_products_after_the_first(spark, clicks):
    model, items, asked = trained(spark, clicks, Tower("t", ("product_brand",)), Settings(size=8, rows=1 << 10, steps=2, epochs=1))
    hard = towers.hard_lists(model, items, asked, clicks, 10, 3).collect()
    seen = {(r.user_id, r.product_id) for r in clicks.collect()}
    assert Counter(r.user_id for r in hard) == {f"u{u}": 7 for u in range(45)}
    assert all((r.user_id, r.candidate_ad_id) not in seen and int(r.candidate_ad_id[1:]) < 30 for r in hard)


def encoded_rows(n=40):
    return pd.DataFrame({
        "_fields": [[int(RNG.integers(0, 10)), int(RNG.integers(10, 20)), -1 if RNG.random() < 0.2 else int(RNG.integers(20, 30))] for _ in range(n)], "_numbers": [list(RNG.normal(size=2)) for _ in range(n)],
        "_click": (c := RNG.integers(0, 2, n)), "_both": c * RNG.integers(0, 2, n), "_y": RNG.integers(0, 2, n), "_known": (k := RNG.integers(0, 2, n)), "_target": np.where(k, RNG.normal(size=n), 99.0),
    })


NETWORKS = [Esmm(("a", "b", "c"), ("x", "y"), size=3, rows=30, hidden=4, joint_weight=0.7), ValueNetwork(("a", "b", "c"), ("x", "y"), size=3, rows=30, hidden=4, crosses=2), ValueNetwork(("a", "b", "c"), ("x", "y"), size=3, rows=30, hidden=4, crosses=1, factors=True, value_weight=0.5)]


@pytest.mark.parametrize("network", NETWORKS)
def test_joint_gradients(network):
    p = {n: RNG.normal(0, 0.3, s) for n, s in network.shapes().items()}
    check_gradient(joint.gradient_of(network), p, encoded_rows())


def test_crosses_and_factors_by_hand():
    network = NETWORKS[2]
    p, df = {n: RNG.normal(0, 0.7, s) for n, s in network.shapes().items()}, encoded_rows(5)
    x, _ = joint._inputs(network, p, df)
    out = network.outputs(p, x)
    for i, r in enumerate(df.itertuples(index=False)):
        e = [np.zeros(3) if f < 0 else p["rows"][f] for f in r[0]]
        x0 = np.concatenate([r[1], *e])
        x1 = x0 * (x0 @ p["cross0"][:-1] + p["cross0"][-1]) + x0
        h = np.maximum(x0 @ p["hidden"][:-1] + p["hidden"][-1], 0)
        z = np.concatenate([x1, h])
        logit = z @ p["conversion"][:-1, 0] + p["conversion"][-1, 0] + e[0] @ e[1] + e[0] @ e[2] + e[1] @ e[2]
        assert math.isclose(out["pcvr"][i], 1 / (1 + math.exp(-logit))) and math.isclose(out["value"][i], z @ p["value"][:-1, 0] + p["value"][-1, 0])


@pytest.fixture(scope="module")
def impressions(spark):
    rows = []
    for i in range(1200):
        good, keen = i % 3 == 0, i % 5 == 0
        click = int(RNG.random() < (0.7 if good else 0.1))
        sold = int(click and RNG.random() < (0.8 if keen else 0.1))
        rows.append((i, f"c{i % 3}" if i % 97 else None, f"u{i % 5}", float(i % 7) if i % 50 else None, click, sold, 50.0 * (1 + i % 3) if sold else None))
    return spark.createDataFrame(rows, "id long, campaign string, user string, x double, click int, click_and_conversion int, value double").cache()


def test_esmm_multiplies_and_learns_both(spark, impressions):
    network = Esmm(("campaign", "user"), ("x",), rows=256, epochs=12, steps=2)
    model = joint.fit_esmm(impressions, network, "id")
    assert model.losses[-1] < 0.9 * model.losses[0]
    rows = joint.predict(model, impressions, "id").join(impressions, "id").toPandas()
    assert (rows["raw_pctcvr"] == rows["raw_pctr"] * rows["raw_pcvr"]).all() and rows["raw_pcvr"].between(0, 1).all()
    by = rows[rows["campaign"].notna()].groupby("campaign")["raw_pctr"].mean()
    assert by["c0"] > by["c1"] + 0.3 and by["c0"] > by["c2"] + 0.3
    keen = rows.groupby("user")["raw_pcvr"].mean()
    assert keen["u0"] > keen.drop("u0").max() + 0.2
    assert joint.predict(model, impressions.where("false"), "id").count() == 0
    with pytest.raises(ValueError, match="leak"):
        joint.fit_esmm(impressions, Esmm(("campaign", "click")), "id")


def test_value_counts_where_it_is_known(spark, impressions):
    rows = impressions.selectExpr("*", "log1p(value) AS log_value", "int(value IS NOT NULL) AS known")
    network = ValueNetwork(("campaign", "user"), ("x",), rows=256, epochs=12, steps=2)
    model = joint.fit_value_network(rows, network, "id", "click_and_conversion", "log_value", "known")
    found = joint.predict(model, rows, "id").join(rows, "id").toPandas()
    assert np.allclose(found["expected_value_score"], found["pCVR"] * found["predicted_conversion_value"]) and (found["predicted_conversion_value"] >= 0).all()
    sold = found[found["value"].notna() & found["campaign"].notna()]
    assert (abs(sold["predicted_conversion_value"] - sold["value"]) < 40).mean() > 0.7
    spoiled = rows.withColumn("log_value", F.coalesce("log_value", F.lit(1e6)))
    other = joint.fit_value_network(spoiled, network, "id", "click_and_conversion", "log_value", "known")
    assert np.allclose(model.losses, other.losses)


def test_artefacts_are_refused_when_they_differ(spark, impressions, tmp_path):
    path = f"file://{tmp_path}/model"
    parameters = {"a": RNG.normal(size=(3, 2)), "b": RNG.normal(size=(1, 4))}
    meta = {"fields": ["x"], "seed": 1, "rows": artefacts.rows_fingerprint(impressions)}
    sha = artefacts.save_parameters(spark, path, parameters, meta)
    found, kept = artefacts.load_parameters(spark, path, {"seed": 1}, sha)
    assert kept == meta and all((found[n] == parameters[n]).all() for n in parameters)
    with pytest.raises(FileExistsError):
        artefacts.save_parameters(spark, path, parameters, meta)
    with pytest.raises(ValueError, match="other inputs"):
        artefacts.load_parameters(spark, path, {"seed": 2})
    with pytest.raises(ValueError, match="fingerprint"):
        artefacts.load_parameters(spark, path, sha256="0" * 64)
    spark.createDataFrame([("a", 0, [0.0, 0.0])], "name string, row long, v array<double>").write.mode("append").parquet(f"{path}/parameters")
    with pytest.raises(ValueError, match="fingerprint"):
        artefacts.load_parameters(spark, path)
    with pytest.raises(FileNotFoundError):
        artefacts.load_parameters(spark, f"file://{tmp_path}/none")
    assert artefacts.rows_fingerprint(impressions.repartition(7)) == meta["rows"] != artefacts.rows_fingerprint(impressions.where("id > 0"))


def test_datasets_are_built_once(spark, tmp_path):
    source, root, built = str(tmp_path / "source"), f"file://{tmp_path}/sets", []
    spark.range(10).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS twice")

    first, was = artefacts.build_or_reuse(spark, root, [source], {"seed": 1}, build)
    again, there = artefacts.build_or_reuse(spark, root, [source], {"seed": 1}, build)
    assert (was, there, len(built)) == (False, True, 1) and sorted(r[0] for r in again.collect()) == sorted(r[0] for r in first.collect())
    artefacts.build_or_reuse(spark, root, [source], {"seed": 2}, build)
    spark.range(3).write.mode("append").parquet(source)
    rows, there = artefacts.build_or_reuse(spark, root, [source], {"seed": 1}, build)
    assert not there and rows.count() == 13 and len(built) == 3
    with pytest.raises(ZeroDivisionError):
        artefacts.build_or_reuse(spark, root, [source], {"seed": 9}, lambda: 1 / 0)
    assert not list((tmp_path / "sets").glob(".building*"))


def test_sketch_is_near_and_merges(spark):
    values = [0.0] * 5 + [float(x) for x in np.concatenate([RNG.lognormal(0, 3, 700), -RNG.lognormal(0, 2, 300)])]
    df = spark.createDataFrame([("a", x) for x in values] + [("b", 2.5), ("b", float("nan")), ("b", None), ("c", math.inf)], "name string, x double")
    whole = metrics.sketched(df, "x", ["name"])
    parts = metrics.sketched(df.where("x > 1"), "x", ["name"]).unionByName(metrics.sketched(df.where("x <= 1"), "x", ["name"]))
    levels = (0.0, 0.01, 0.25, 0.301, 0.5, 0.9, 1.0)
    found = {(r["name"], r["level"]): r["value"] for r in metrics.sketch_quantiles(whole, ["name"], levels).collect()}
    assert found == pytest.approx({(r["name"], r["level"]): r["value"] for r in metrics.sketch_quantiles(parts, ["name"], levels).collect()})
    order = sorted(values)
    for q in levels:
        exact = order[math.floor(q * (len(order) - 1))]
        assert abs(found["a", q] - exact) <= 0.01 * abs(exact) + 1e-12 and abs(found["b", q] - 2.5) <= 0.025
    assert not any(n == "c" for n, _ in found)


def quota_by_hand(rows, weights, quotas, k, top):
    out = {}
    for user in {r[0] for r in rows}:
        by = {n: {c: r for u, c, s, r in rows if u == user and s == n} for n in weights}
        score = {c: round(sum(weights[n] / (k + by[n][c]) for n in weights if c in by[n]), 12) for n in weights for c in by[n]}
        chosen = []
        for n in weights:
            for c in sorted(by[n], key=lambda c: (by[n][c], c)):
                if len(chosen) < top and sum(x in by[n] for x in chosen) < quotas.get(n, 0) and c not in chosen:
                    chosen.append(c)
        chosen += [c for c in sorted(score, key=lambda c: (-score[c], c)) if c not in chosen][: top - len(chosen)]
        out[user] = {c: score[c] for c in chosen}
    return out


@pytest.mark.parametrize(("quotas", "top"), [({"s2": 4}, 6), ({"s0": 2, "s1": 3, "s2": 5}, 8), ({"s0": 9, "s1": 9}, 7), ({}, 5)])
def test_quotas(spark, quotas, top):
    weights = {"s0": 1.0, "s1": 0.5, "s2": 0.1}
    rows = [(u, f"c{int(c):02d}", s, r) for u in "abc" for s in weights for r, c in enumerate(RNG.choice(20, RNG.integers(3, 12), replace=False), 1)]
    df = spark.createDataFrame(rows, "user_id string, candidate_ad_id string, source string, rank long")
    got = defaultdict(dict)
    for r in recall.rrf_with_quotas(df, weights, quotas, 10, top).collect():
        got[r.user_id][r.candidate_ad_id] = r.rrf_score
    assert dict(got) == quota_by_hand(rows, weights, quotas, 10, top)


def test_windows_are_written_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "CASE WHEN id < 20 THEN 'past' ELSE 'future' END AS window")
    path = f"file://{tmp_path}/w"
    assert artefacts.write_windows(df, path, ["past", "future", "later"]) == {"past": 20, "future": 30, "later": 0}
    assert spark.read.parquet(f"{path}/window=past").count() == 20
    with pytest.raises(FileExistsError):
        artefacts.write_windows(df, path, ["past", "future"])
    for odd in ("CASE WHEN id < 49 THEN 'past' END", "CASE WHEN id < 49 THEN 'past' ELSE 'x' END"):
        with pytest.raises(ValueError, match="outside"):
            artefacts.write_windows(df.selectExpr("id", f"{odd} AS window"), f"file://{tmp_path}/odd", ["past"])
    assert {p.name for p in tmp_path.iterdir()} == {"w"}
    windows.assert_disjoint(df, "id")
    with pytest.raises(ValueError, match="in windows"):
        windows.assert_disjoint(df.selectExpr("id % 25 AS id", "window"), "id")


def test_clicked_only(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "id long, click int")
    assert [r.id for r in candidates.clicked_only(df).collect()] == [1]
