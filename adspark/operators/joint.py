"""Joint rankers: several outputs of one network over shared embeddings, learned by synchronised gradient steps.

`Esmm`: a hidden layer over the embedded fields and the numbers, and two heads. Clicks are learned from the first, conversions
of impressions from the product of both, so the second is the probability of a conversion given a click without ever being fit
on clicked rows alone; pctcvr = pctr * pcvr holds by construction.

`ValueNetwork`: explicit crosses (each layer multiplies the input, elementwise, with a linear map of the layer below, and adds
that layer) beside a hidden layer, and heads for the conversion and the standardised log value. With `factors` the conversion
head also has the inner products of all pairs of fields. The value counts only where it is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.operators.features import assert_no_leakage
from adspark.operators.learning import Parameters, by_step, descend, embedded, scattered


@dataclass(frozen=True)
class Network:
    """Inputs and sizes of a joint ranker."""

    fields: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    size: int = 8
    rows: int = 1 << 14
    hidden: int = 16
    epochs: int = 2
    steps: int = 4
    rate: float = 0.1
    seed: int = 2026

    @property
    def width(self) -> int:
        return len(self.numbers) + len(self.fields) * self.size


@dataclass(frozen=True)
class Esmm(Network):
    joint_weight: float = 1.0
    epsilon: float = 1e-7

    def shapes(self) -> dict[str, tuple[int, int]]:
        return {"rows": (self.rows, self.size), "hidden": (self.width + 1, self.hidden), "click": (self.hidden + 1, 1), "conversion": (self.hidden + 1, 1)}

    def outputs(self, p: Parameters, x: np.ndarray) -> dict[str, np.ndarray]:
        h = np.maximum(_with_one(x) @ p["hidden"], 0)
        pctr, pcvr = _sigmoid(_with_one(h) @ p["click"])[:, 0], _sigmoid(_with_one(h) @ p["conversion"])[:, 0]
        return {"h": h, "pctr": pctr, "pcvr": pcvr, "pctcvr": pctr * pcvr}

    def back(self, p: Parameters, x: np.ndarray, df: pd.DataFrame) -> tuple[Parameters, np.ndarray, float, float]:
        """(gradients of the matrices, of x, loss, weight)."""
        click, both = df["_click"].to_numpy(float), df["_both"].to_numpy(float)
        out = self.outputs(p, x)
        a, b, joint = out["pctr"], out["pcvr"], out["pctcvr"]
        safe = np.clip(joint, self.epsilon, 1 - self.epsilon)
        loss = _entropy(a, click) + self.joint_weight * _entropy(safe, both)
        inside = (joint > self.epsilon) & (joint < 1 - self.epsilon)
        d_joint = self.joint_weight * np.where(inside, (safe - both) / (safe * (1 - safe)), 0.0)
        d_click, d_conversion = (a - click) + d_joint * b * a * (1 - a), d_joint * a * b * (1 - b)
        hb = _with_one(out["h"])
        grads = {"click": hb.T @ d_click[:, None], "conversion": hb.T @ d_conversion[:, None]}
        d_h = (d_click[:, None] @ p["click"][:-1].T + d_conversion[:, None] @ p["conversion"][:-1].T) * (out["h"] > 0)
        grads["hidden"] = _with_one(x).T @ d_h
        return grads, d_h @ p["hidden"][:-1].T, float(loss.sum()), float(len(df))


@dataclass(frozen=True)
class ValueNetwork(Network):
    crosses: int = 2
    factors: bool = False
    value_weight: float = 1.0

    def shapes(self) -> dict[str, tuple[int, int]]:
        d = self.width
        crosses = {f"cross{k}": (d + 1, d) for k in range(self.crosses)}
        return {"rows": (self.rows, self.size), "hidden": (d + 1, self.hidden), "conversion": (d + self.hidden + 1, 1), "value": (d + self.hidden + 1, 1), **crosses}

    def outputs(self, p: Parameters, x: np.ndarray) -> dict[str, np.ndarray]:
        layers, inner = [x], []
        for k in range(self.crosses):
            inner.append(_with_one(layers[-1]) @ p[f"cross{k}"])
            layers.append(x * inner[-1] + layers[-1])
        h = np.maximum(_with_one(x) @ p["hidden"], 0)
        z = np.concatenate([layers[-1], h], 1)
        logit = (_with_one(z) @ p["conversion"])[:, 0]
        e = x[:, len(self.numbers) :].reshape(len(x), len(self.fields), self.size)
        if self.factors:
            logit = logit + 0.5 * ((e.sum(1) ** 2).sum(1) - (e * e).sum((1, 2)))
        return {"layers": layers, "inner": inner, "h": h, "z": z, "e": e, "pcvr": _sigmoid(logit), "value": (_with_one(z) @ p["value"])[:, 0]}

    def back(self, p: Parameters, x: np.ndarray, df: pd.DataFrame) -> tuple[Parameters, np.ndarray, float, float]:
        y, target, known = (df[c].to_numpy(float) for c in ("_y", "_target", "_known"))
        out = self.outputs(p, x)
        off = np.where(known > 0, out["value"] - np.where(known > 0, target, 0.0), 0.0)
        loss = _entropy(out["pcvr"], y) + self.value_weight * off * off
        d_logit, d_value = out["pcvr"] - y, 2 * self.value_weight * off
        zb = _with_one(out["z"])
        grads = {"conversion": zb.T @ d_logit[:, None], "value": zb.T @ d_value[:, None]}
        d_z = d_logit[:, None] @ p["conversion"][:-1].T + d_value[:, None] @ p["value"][:-1].T
        d_layer, d_h = d_z[:, : self.width], d_z[:, self.width :] * (out["h"] > 0)
        grads["hidden"] = _with_one(x).T @ d_h
        d_x = d_h @ p["hidden"][:-1].T
        for k in reversed(range(self.crosses)):
            d_inner = d_layer * x
            grads[f"cross{k}"] = _with_one(out["layers"][k]).T @ d_inner
            d_x = d_x + d_layer * out["inner"][k]
            d_layer = d_layer + d_inner @ p[f"cross{k}"][:-1].T
        d_x = d_x + d_layer
        if self.factors:
            pair = (out["e"].sum(1, keepdims=True) - out["e"]) * d_logit[:, None, None]
            d_x = d_x + np.concatenate([np.zeros((len(x), len(self.numbers))), pair.reshape(len(x), -1)], 1)
        return grads, d_x, float(loss.sum()), float(len(df))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _entropy(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _inputs(network: Network, p: Parameters, df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers and embedded fields side by side, rows of the fields)."""
    rows = np.array(df["_fields"].tolist(), np.int64).reshape(len(df), len(network.fields))
    numbers = np.array(df["_numbers"].tolist(), float).reshape(len(df), len(network.numbers))
    return np.concatenate([numbers, embedded(p["rows"], rows[:, :, None]).reshape(len(df), -1)], 1), rows


def gradient_of(network: Network):
    """The gradient of a frame of encoded rows."""

    def gradient(p: Parameters, df: pd.DataFrame):
        x, rows = _inputs(network, p, df)
        grads, d_x, loss, weight = network.back(p, x, df)
        out = {n: (np.arange(len(g)), g) for n, g in grads.items()}
        d_e = d_x[:, len(network.numbers) :].reshape(len(df), len(network.fields), network.size)
        out["rows"] = scattered(rows[:, :, None], d_e)
        return out, loss, weight

    return gradient


@dataclass
class JointModel:
    network: Network
    parameters: Parameters
    scales: dict[str, tuple[float, float]]  # mean and deviation of the numbers, and of the value
    losses: list[float] = field(default_factory=list)


def _scales(rows: DataFrame, numbers: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    if not numbers:
        return {}
    r = rows.agg(*(f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (float(r[f"m_{c}"] or 0.0), float(r[f"s_{c}"] or 1.0)) for c in numbers}


def encoded(rows: DataFrame, network: Network, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """rows with _fields, the table rows of the fields (-1 for nulls), and _numbers, z-scores (0 for nulls)."""
    at = [F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(network.rows))).otherwise(-1).cast("long") for c in network.fields]
    z = [F.coalesce((F.col(c) - F.lit(scales[c][0])) / F.lit(scales[c][1]), F.lit(0.0)).cast("double") for c in network.numbers]
    return rows.withColumns({"_fields": F.array(*at), "_numbers": F.array(*z).cast("array<double>")})


def _refuse(network: Network, outcomes: set[str]) -> None:
    inputs = [*network.fields, *network.numbers]
    assert_no_leakage(inputs)
    if own := sorted(outcomes & set(inputs)):
        raise ValueError(f"inputs that leak the outcome: {own}")


def _steps(rows: DataFrame, network: Network, targets: dict[str, Column], scales: dict[str, tuple[float, float]], key: Column, hashed: bool = False) -> Callable[[int], DataFrame]:
    made = encoded(rows, network, scales).select("_fields", "_numbers", key.alias("_key"), *(c.alias(n) for n, c in targets.items()))
    return by_step(made, F.col("_key"), network.steps, ("_key",), hashed)


def _learn(step_rows: Callable[[int], DataFrame], network: Network, scales: dict[str, tuple[float, float]]) -> JointModel:
    rng = np.random.default_rng(network.seed)
    start = {n: rng.normal(0, 0.05 if n == "rows" else 1 / np.sqrt(s[0]), s) * (0.1 if n.startswith("cross") else 1.0) for n, s in network.shapes().items()}
    parameters, losses = descend(step_rows, network.steps, network.epochs, start, gradient_of(network), network.rate)
    return JointModel(network, parameters, scales, losses)


def fit_esmm(rows: DataFrame, network: Esmm, key: str, click: str = "click", both: str = "click_and_conversion") -> JointModel:
    """The joint model of clicks and conversions over all impressions."""
    _refuse(network, {click, both})
    scales = _scales(rows, network.numbers)
    return _learn(_steps(rows, network, {"_click": F.col(click), "_both": F.col(both)}, scales, F.col(key)), network, scales)


def fit_value_network(rows: DataFrame, network: ValueNetwork, key: str, label: str, log_value: str, mask: str) -> JointModel:
    """The joint model of conversions and, where mask is 1, of the log value."""
    return fit_value_networks(rows, [network], key, label, log_value, mask)[0]


def fit_value_networks(rows: DataFrame, networks: list[ValueNetwork], key: str, label: str, log_value: str, mask: str, hashed: bool = False) -> list[JointModel]:
    """fit_value_network of several networks that read the same inputs in the same steps: these are written once. hashed: the
    key is xxhash64 of a key."""
    first = networks[0]
    for network in networks:
        _refuse(network, {label, log_value, mask})
        if (network.fields, network.numbers, network.rows, network.steps) != (first.fields, first.numbers, first.rows, first.steps):
            raise ValueError("networks that are fitted together must have the same inputs and steps")
    scales = _scales(rows, first.numbers) | {"": _scales(rows.where(F.col(mask) == 1), (log_value,))[log_value]}
    target = F.coalesce((F.col(log_value) - F.lit(scales[""][0])) / F.lit(scales[""][1]), F.lit(0.0))
    step_rows = _steps(rows, first, {"_y": F.col(label), "_target": target, "_known": F.col(mask)}, scales, F.col(key), hashed)
    return [_learn(step_rows, network, scales) for network in networks]


def predict(model: JointModel, rows: DataFrame, key: str, log_max: float = 20.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """key with raw_pctr, raw_pcvr and raw_pctcvr, or with pCVR, predicted_conversion_value and expected_value_score; then the
    columns of rows to keep, so that outcomes need not be joined."""
    shared = rows.sparkSession.sparkContext.broadcast((model.network, model.parameters, model.scales))
    kind = rows.schema[key].dataType.simpleString()
    names = ["raw_pctr", "raw_pcvr", "raw_pctcvr"] if isinstance(model.network, Esmm) else ["pCVR", "predicted_conversion_value", "expected_value_score"]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network, parameters, scales = shared.value
        for df in frames:
            if not len(df):
                continue
            out = network.outputs(parameters, _inputs(network, parameters, df)[0])
            if isinstance(network, Esmm):
                values = [out["pctr"], out["pcvr"], out["pctcvr"]]
            else:
                mean, deviation = scales[""]
                value = np.expm1(np.clip(out["value"] * deviation + mean, 0, log_max))
                values = [out["pcvr"], value, out["pcvr"] * value]
            yield pd.DataFrame({key: df[key], **dict(zip(names, values, strict=True)), **{n: df[n] for n in keep}})

    made = encoded(rows, model.network, model.scales).select(key, "_fields", "_numbers", *keep)
    kept = "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in keep)
    return made.mapInPandas(score, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names) + kept)
