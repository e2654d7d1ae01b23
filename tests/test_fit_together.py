"""Networks with the same inputs are fitted from steps that are written once, and outcomes go along with their predictions."""

from dataclasses import replace

import pytest

from adspark.operators import joint


def test_networks_share_their_steps(spark, monkeypatch):
    data = [(i, f"b{i % 3}", float(i % 5), i % 2, float(i % 7) if i % 2 else None, i % 2) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, brand string, size double, bought int, log_value double, known int")
    one = joint.ValueNetwork(("brand",), ("size",), size=2, rows=64, hidden=2, epochs=1, steps=2)
    two = replace(one, factors=True, crosses=0)
    apart = [joint.fit_value_network(rows, n, "id", "bought", "log_value", "known") for n in (one, two)]
    written = []
    kept = joint.by_step
    monkeypatch.setattr(joint, "by_step", lambda rows, *rest: (lambda f: (written.append(f(0).columns), f)[1])(kept(rows, *rest)))
    together = joint.fit_value_networks(rows, [one, two], "id", "bought", "log_value", "known")
    assert written == [["_fields", "_numbers", "_y", "_target", "_known"]]
    for a, b in zip(apart, together, strict=True):
        assert a.losses == pytest.approx(b.losses)
    hashed = joint.fit_value_networks(rows.selectExpr("xxhash64(id) AS h", "*"), [one], "h", "bought", "log_value", "known", hashed=True)
    assert hashed[0].losses == pytest.approx(apart[0].losses)
    with pytest.raises(ValueError):
        joint.fit_value_networks(rows, [one, replace(two, steps=3)], "id", "bought", "log_value", "known")
    found = {r.id: r for r in joint.predict(together[0], rows, "id", keep=("bought", "log_value")).collect()}
    assert {(i, r.bought, r.log_value) for i, r in found.items()} == {(d[0], d[3], d[4]) for d in data}
