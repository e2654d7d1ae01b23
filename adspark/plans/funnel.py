"""The recall, fusion and ranking funnel, and the one-way final holdout."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.operators import models, recall, windows
from adspark.sources.delimited import report


def temporal_split(rows: DataFrame, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(past, future) of interactions at the exact order statistic; ties stay in the past."""
    split = windows.split(rows, "click_timestamp", ratio)
    return split.where(F.col("window") == "past"), split.where(F.col("window") == "future")


def positives(future: DataFrame, conversions_only: bool = False) -> DataFrame:
    """Distinct (user_id, product_id) of a later window."""
    rows = future.where("conversion_label = 1") if conversions_only else future
    return rows.select("user_id", "product_id").distinct()


def recall_lists(pairs: DataFrame, users: DataFrame, top_k: int = 50, towers: bool = False) -> dict[str, DataFrame]:
    """itemcf lists of users, with towers also those of ALS factors, and the popular products, from past pairs and their weights
    only."""
    lists = {"itemcf": recall.itemcf(pairs, users, top_k), "popularity": recall.popular_pairs(pairs, top_k)}
    return lists | ({"two_tower": models.factor_lists(pairs, users, top_k)} if towers else {})


def fused(lists: dict[str, DataFrame], weights: dict[str, float], k: float = 100, top_k: int = 100) -> DataFrame:
    """Fused lists with ranks, best first."""
    personal = {n: df for n, df in lists.items() if n != "popularity"}
    every = recall.personalised(personal, lists.get("popularity"))
    out = recall.rrf(every, weights, k, top_k)
    return recall.ranked(out, ["user_id"], [F.desc("rrf_score"), F.col("candidate_ad_id")])


class FinalHoldout:
    """The last window may be opened once: opening leaves a marker, and later runs may only render what was found."""

    def __init__(self, folder: str) -> None:
        self.marker = Path(folder) / "holdout_opened.json"
        self.results = Path(folder) / "holdout_metrics.json"

    def open(self, frozen: list[str]) -> None:
        """Check that all frozen artefacts are there and that the window was never opened; then mark it as opened."""
        if missing := [p for p in frozen if not Path(p).exists()]:
            raise FileNotFoundError(f"frozen artefacts are missing: {missing}")
        if self.marker.exists():
            raise RuntimeError("the final holdout was opened before")
        self.marker.parent.mkdir(parents=True, exist_ok=True)
        self.marker.write_text(json.dumps({"artefacts": frozen}))

    def record(self, metrics: DataFrame) -> None:
        self.results.write_text(report(metrics))

    def render(self) -> list[dict]:
        """The recorded metrics, without reading the window."""
        if not self.results.exists():
            raise FileNotFoundError("nothing was recorded")
        return json.loads(self.results.read_text())
