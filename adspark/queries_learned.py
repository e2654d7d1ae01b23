"""Registered queries on the vector index, the learned towers and the joint rankers."""

from __future__ import annotations

import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.operators import auction, candidates, fusion_report, joint, metrics, recall, towers, user_lists, vector_index, windows
from adspark.operators.joint import Esmm, ValueNetwork
from adspark.operators.metrics import recall_at
from adspark.operators.towers import Settings, Tower
from adspark.plans import funnel
from adspark.queries import GROUPED_SQL, ITEMCF_SQL, LISTS_SQL, PREDICTIONS_SQL, SPLIT_SQL, _grouped, _laid, _past_future, query, rounded
from adspark.sources import artefacts
from adspark.sources.adapters import impressions, interactions, predictions, table
from adspark.sources.staging import shared_folder, staged

# --- vector index ---------------------------------------------------------------------------------------------------


def _index(spark, sf_dir):
    """(index, queries, exact lists, probes, [(probes, recall)]) of all vectors; queries are those whose id 20 divides."""
    unit = staged(recall.unit_vectors(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")), "unit")
    asked = unit.where("vec_id % 20 = 0")
    index = vector_index.build(unit, "vec_id", "embedding")
    exact = staged(recall.vector_top_k(asked, unit, 10), "exact")
    return index, asked, exact, *vector_index.choose_probes(index, asked, exact, "vec_id", "embedding", 10, 0.95, same=True)


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """The ten nearest vectors by the index, with as many probes as a recall of 0.95 needs."""
    index, asked, _, probes, _ = _index(spark, sf_dir)
    return rounded(vector_index.search(index, asked, "vec_id", "embedding", 10, probes, same=True), "score")


@query("vector_index_recall")
def vector_index_recall(spark, sf_dir):
    """(probes, recall, compared, all_pairs): what each number of probes finds of the exact lists, and at what work."""
    index, asked, _, _, tried = _index(spark, sf_dir)
    every = asked.count() * index.items.count()
    rows = [(p, round(r, 6), vector_index.compared(index, asked, "embedding", p), every) for p, r in tried]
    return spark.createDataFrame(rows, "probes int, recall double, compared long, all_pairs long")


# --- towers ---------------------------------------------------------------------------------------------------------

CONTENT, CONTEXT = ("product_brand", "product_category_1"), ("device_type",)
STATS = ("clicks", "conversions", "mean_price")
TOWERS = (
    Tower("v0_id_only"),
    Tower("v1_item_content", CONTENT, ("log_price",)),
    Tower("v2_user_context_stats", CONTENT, ("log_price",), CONTEXT, STATS),
    Tower("v3_in_batch_negatives", CONTENT, ("log_price",), CONTEXT, STATS, loss="in_batch"),
    Tower("v4_hard_negatives", CONTENT, ("log_price",), CONTEXT, STATS, hard=4),
)
SETTINGS = Settings(epochs=1)


def _tower_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(past, future, catalogue as of the split, users): the catalogue also has the products nobody clicked so far."""
    past, future = (staged(x, "window") for x in _past_future(spark, sf_dir))
    parts = table(spark, sf_dir, "part")
    price = F.log1p(F.greatest("p_retailprice", F.lit(0.0)))
    catalogue = parts.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("product_brand"), F.col("p_type").alias("product_category_1"), price.alias("log_price"))
    latest = recall.latest_users(past, ["device_type"], ["click_timestamp", "event_id"])
    stats = past.groupBy("user_id").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("clicks"), F.log1p(F.sum("conversion_label").cast("double")).alias("conversions"), F.avg(F.log1p("product_price")).alias("mean_price"))
    return past, future, staged(catalogue, "catalogue"), staged(latest.join(stats, "user_id"), "users")


def _trained(past: DataFrame, catalogue: DataFrame, users: DataFrame, tower: Tower, hard: DataFrame | None = None):
    items, asked = towers.item_inputs(catalogue, past, tower, SETTINGS), towers.user_inputs(users, tower, SETTINGS)
    items, asked = staged(items, "items"), staged(asked, "asked")
    return towers.train(past, items, asked, tower, SETTINGS, hard), items, asked


@query("tower_ablation")
def tower_ablation(spark, sf_dir):
    """(variant, cutoff, recall, hit_rate, first_loss, last_loss) of the five towers over users of both windows. The last one
    learns from negatives that the third ranks high among a user's unseen past products."""
    past, future, catalogue, users = _tower_inputs(spark, sf_dir)
    positives = staged(funnel.positives(future).join(users.select("user_id"), "user_id", "left_semi"), "positives")
    cohort = positives.select("user_id").distinct()
    out, hard = None, None
    for tower in TOWERS:
        model, items, asked = _trained(past, catalogue, users, tower, hard if tower.hard else None)
        if tower.name == "v2_user_context_stats":
            hard = staged(towers.hard_lists(model, items, asked, past), "hard")
        found = towers.lists(model, items, asked.join(cohort, "user_id", "left_semi"), past, 50)
        measured = recall_at(staged(found, "lists"), positives, (10, 50))
        measured = measured.select(F.lit(tower.name).alias("variant"), "cutoff", "recall", "hit_rate", F.lit(model.losses[0] if model.losses else None).cast("double").alias("first_loss"), F.lit(model.losses[-1] if model.losses else None).cast("double").alias("last_loss"))
        out = measured if out is None else out.unionByName(measured)
    return rounded(out, "recall", "hit_rate", "first_loss", "last_loss", digits=4)


@query("content_tower_cold_lists")
def content_tower_cold_lists(spark, sf_dir):
    """The 20 best products of each user of both windows by the content tower, cold ones (never clicked before) included."""
    past, future, catalogue, users = _tower_inputs(spark, sf_dir)
    model, items, asked = _trained(past, catalogue, users, TOWERS[1])
    found = towers.lists(model, items, asked.join(future.select("user_id").distinct(), "user_id", "left_semi"), past, 20)
    return rounded(found.join(items.select(F.col("product_id").alias("candidate_ad_id"), "cold"), "candidate_ad_id"), "two_tower_score")


# --- joint rankers and frozen artefacts -----------------------------------------------------------------------------

ESMM = Esmm(("campaign_id", "user_id", "hour"))
VALUE = ValueNetwork(("product_brand", "product_category_1", "device_type", "partner_id"), ("log_price", "clicks_last_7d"))


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    hour = F.floor(F.pmod("timestamp", F.lit(86_400)) / 3_600).cast("int")
    rows = windows.split(impressions(spark, sf_dir).withColumn("hour", hour), "timestamp", 0.5, ("fit", "later"))
    rows = staged(rows, "impressions")
    return rows.where("window = 'fit'"), rows.where("window = 'later'")


@query("esmm_predictions")
def esmm_predictions(spark, sf_dir):
    """Probabilities of the later half's impressions from the joint model of the earlier half, by way of a frozen artefact."""
    fit, later = _halves(spark, sf_dir)
    model = joint.fit_esmm(fit, ESMM, "event_id")
    path = f"{shared_folder(spark)}/esmm-{uuid.uuid4().hex}"
    meta = {"network": asdict(ESMM), "rows": artefacts.rows_fingerprint(fit), "scales": model.scales}
    sha = artefacts.save_parameters(spark, path, model.parameters, meta)
    parameters, found = artefacts.load_parameters(spark, path, {"network": asdict(ESMM)}, sha)
    frozen = joint.JointModel(ESMM, parameters, {n: tuple(v) for n, v in found["scales"].items()})
    return rounded(joint.predict(frozen, later, "event_id"), "raw_pctr", "raw_pcvr", "raw_pctcvr", digits=9)


def _value_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(past, future): what the networks read and learn, and event_hash, the hash of the event's key, which deals steps. Written once."""
    read = {"event_id", "conversion_label", "conversion_value_eur", "product_price", "clicks_last_7d", *VALUE.fields}
    rows = interactions(spark, sf_dir).select("click_timestamp", *sorted(read)).withColumn("event_hash", F.xxhash64("event_id")).drop("event_id")
    made = {"log_price": F.log1p("product_price"), "log_value": F.log1p("conversion_value_eur"), "known": F.col("conversion_value_eur").isNotNull().cast("int")}
    past, future = funnel.temporal_split(staged(rows, "interactions"))
    return past.withColumns(made), future.withColumns(made)


@query("value_networks")
def value_networks(spark, sf_dir):
    """(network, roc_auc, average_precision, log_loss, value_mae, first_loss, last_loss) of the cross network and of the one with
    factors, learned from past clicks and judged on future ones."""
    past, future = _value_rows(spark, sf_dir)
    networks, out = {"crosses": VALUE, "factors": replace(VALUE, factors=True, crosses=0)}, None
    fitted = joint.fit_value_networks(past, list(networks.values()), "event_hash", "conversion_label", "log_value", "known", hashed=True)
    for name, model in zip(networks, fitted, strict=True):
        found = joint.predict(model, future, "event_hash", keep=("conversion_label", "conversion_value_eur"))
        scored = staged(found.select("conversion_label", "conversion_value_eur", "pCVR", "predicted_conversion_value"), "scored")
        quality = metrics.ranking_quality(scored, "conversion_label", "pCVR").crossJoin(metrics.probability_losses(scored, "conversion_label", "pCVR"))
        error = scored.where("conversion_value_eur IS NOT NULL").agg(F.avg(F.abs(F.col("predicted_conversion_value") - F.col("conversion_value_eur"))).alias("value_mae"))
        one = quality.crossJoin(error).select(F.lit(name).alias("network"), "roc_auc", "average_precision", "log_loss", "value_mae", F.lit(model.losses[0]).alias("first_loss"), F.lit(model.losses[-1]).alias("last_loss"))  # single rows
        out = one if out is None else out.unionByName(one)
    return rounded(out, "roc_auc", "average_precision", "log_loss", "value_mae", "first_loss", "last_loss", digits=4)


# --- fusion with quotas, diagnostics, splits ------------------------------------------------------------------------

QUOTAS = {"itemcf": 8, "popularity": 10}


def _quota_sql(weights: dict[str, float], quotas: dict[str, int], k: float, top: int) -> str:
    """Each source in turn adds its first free items up to its quota; what room is left goes by score."""
    rank = ", ".join(f"min(rank) FILTER (source = '{n}') AS r_{n}" for n in weights)
    score = " + ".join(f"coalesce({w}::DOUBLE / ({k}::DOUBLE + r_{n}), 0)" for n, w in weights.items())
    count = " + ".join(f"(r_{n} IS NOT NULL)::INT" for n in weights)
    steps, before = [], "s0"
    for i, (n, quota) in enumerate(quotas.items(), 1):
        steps.append(f"""s{i} AS (SELECT * EXCLUDE (held, taken, nth), c OR (NOT c AND r_{n} IS NOT NULL AND nth <= least({quota} - held, {top} - taken)) AS c FROM (
  SELECT *, sum((c AND r_{n} IS NOT NULL)::INT) OVER u AS held, sum(c::INT) OVER u AS taken,
    row_number() OVER (PARTITION BY user_id ORDER BY (NOT c AND r_{n} IS NOT NULL) DESC, r_{n}, candidate_ad_id) AS nth FROM {before} WINDOW u AS (PARTITION BY user_id)))""".replace("EXCLUDE (held", "EXCLUDE (c, held"))
        before = f"s{i}"
    return f"""s0 AS (SELECT *, round({score}, 12) AS rrf_score, {count} AS source_count, false AS c FROM (SELECT user_id, candidate_ad_id, {rank} FROM lists GROUP BY ALL)),
{", ".join(steps)}
SELECT user_id, candidate_ad_id, round(rrf_score, 9) AS rrf_score, source_count FROM (
  SELECT *, sum(c::INT) OVER (PARTITION BY user_id) AS taken, row_number() OVER (PARTITION BY user_id ORDER BY c, rrf_score DESC, candidate_ad_id) AS nth FROM {before})
WHERE c OR nth <= {top} - taken"""


_WEIGHTS = {"itemcf": 2.0, "popularity": 0.5}


@query("rrf_quota_lists", f"WITH {LISTS_SQL}, {_quota_sql(_WEIGHTS, QUOTAS, 100, 40)}")
def rrf_quota_lists(spark, sf_dir):
    """The best 40 of the itemcf and popularity lists, with places held for each."""
    lists = _laid(spark, sf_dir)
    found = user_lists.fused(lists, (_WEIGHTS["itemcf"], _WEIGHTS["popularity"]), 100, 40, {TWO.index(n): q for n, q in QUOTAS.items()})
    return rounded(user_lists.candidates(found, lists.products), "rrf_score", digits=9)


def _diagnostics_sql(columns: list[str], levels: tuple[float, ...], error: float = 0.01) -> str:
    gamma = (1 + error) / (1 - error)
    named = ", ".join(f"max(v) FILTER (upto > floor({q}::DOUBLE * (total - 1)) AND upto - n <= floor({q}::DOUBLE * (total - 1))) AS q{round(100 * q)}" for q in levels)
    values = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS x FROM predictions" for c in columns)
    return f"""long AS ({values}),
b AS (SELECT name, sign(x) AS s, CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / ln({gamma!r}::DOUBLE))::BIGINT END AS k, count(*) AS n FROM long WHERE isfinite(x) GROUP BY ALL),
q AS (SELECT name, n, s * 2 * pow({gamma!r}::DOUBLE, k) / ({gamma!r}::DOUBLE + 1) AS v, sum(n) OVER (PARTITION BY name ORDER BY s, s * k) AS upto, sum(n) OVER (PARTITION BY name) AS total FROM b),
z AS (SELECT name, {named} FROM q GROUP BY name),
t AS (SELECT name, count(*) AS rows, count(*) FILTER (x IS NULL OR NOT isfinite(x)) AS nonfinite, count(*) FILTER (x = 0) AS zeros, avg(x) FILTER (isfinite(x)) AS mean, stddev_pop(x) FILTER (isfinite(x)) AS std, min(x) FILTER (isfinite(x)) AS min, max(x) FILTER (isfinite(x)) AS max FROM long GROUP BY name)
SELECT name, rows, nonfinite, zeros, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "min", "max", *(f"q{round(100 * q)}" for q in levels)))} FROM t LEFT JOIN z USING (name)"""


@query("prediction_diagnostics", f"WITH {PREDICTIONS_SQL}, {_diagnostics_sql(['raw_pctr', 'raw_pctcvr', 'cost'], (0.01, 0.5, 0.99))}")
def prediction_diagnostics(spark, sf_dir):
    found = metrics.prediction_diagnostics(predictions(spark, sf_dir), ["raw_pctr", "raw_pctcvr", "cost"])
    return rounded(found, "mean", "std", "min", "max", "q1", "q50", "q99")


@query("future_halves", f"""WITH {SPLIT_SQL}, m AS (SELECT min(ts) AS m FROM (SELECT ts, sum(n) OVER (ORDER BY ts) AS upto, sum(n) OVER () AS total FROM (SELECT click_timestamp AS ts, count(*) AS n FROM future GROUP BY 1)) WHERE upto > ceil(0.5::DOUBLE * (total - 1)))
SELECT CASE WHEN click_timestamp <= m THEN 'future_a' ELSE 'future_b' END AS "window", count(*) AS rows, count(DISTINCT user_id) AS users, min(click_timestamp) AS min_timestamp, max(click_timestamp) AS max_timestamp FROM future, m GROUP BY 1""")
def future_halves(spark, sf_dir):
    """The later window's halves at the median, in order and without a row in both; they are written by window in one pass."""
    halves = windows.split(_past_future(spark, sf_dir)[1].drop("window"), "click_timestamp", 0.5, ("future_a", "future_b"))
    path = f"{shared_folder(spark)}/halves-{uuid.uuid4().hex}"
    artefacts.write_windows(halves, path, ["future_a", "future_b"])
    written = spark.read.parquet(path)
    windows.assert_disjoint(written, "event_id")
    stats = windows.window_stats(written).select("window", "rows", "users", "min_timestamp", "max_timestamp")
    windows.assert_window_order(stats, ["future_a", "future_b"])
    return stats


@query("clicked_reliability", f"""WITH {PREDICTIONS_SQL}, p AS (SELECT conversion, least(greatest(raw_pctcvr / raw_pctr, 0), 1) AS raw_pcvr FROM predictions WHERE click = 1),
f AS (SELECT least(floor(raw_pcvr * 10), 9)::INT AS bin, count(*) AS n, avg(raw_pcvr) AS mean_score, avg(conversion) AS mean_label FROM p GROUP BY 1)
SELECT t.bin::INT AS bin, coalesce(n, 0) AS n, round(mean_score, 9) AS mean_score, round(mean_label, 9) AS mean_label, round(coalesce(abs(mean_score - mean_label), 0), 9) AS gap FROM range(10) AS t(bin) LEFT JOIN f ON f.bin = t.bin""")
def clicked_reliability(spark, sf_dir):
    """Reliability of conversion given a click, over clicked rows alone."""
    rows = candidates.clicked_only(predictions(spark, sf_dir)).withColumn("raw_pcvr", F.least(F.greatest(F.col("raw_pctcvr") / F.col("raw_pctr"), F.lit(0.0)), F.lit(1.0)))
    return rounded(metrics.reliability(rows, "conversion", "raw_pcvr", 10), "mean_score", "mean_label", "gap", digits=9)


# --- coverage of sources and variants -------------------------------------------------------------------------------

TWO = ("itemcf", "popularity")
MASKS_SQL = f"""{ITEMCF_SQL}, lists AS (
  SELECT user_id, candidate_ad_id, 'itemcf' AS source, rank FROM itemcf
  UNION ALL SELECT user_id, candidate_ad_id, 'popularity', rank FROM (SELECT DISTINCT user_id FROM positives), popular),
masks AS (SELECT user_id, candidate_ad_id, bit_or(CASE source WHEN 'itemcf' THEN 1 ELSE 2 END) AS mask FROM lists WHERE rank <= 100 GROUP BY ALL),
sliced AS (SELECT user_id, product_id, CASE WHEN product_id IN (SELECT product_id FROM past) THEN 'seen' ELSE 'unseen' END AS slice FROM positives),
hits AS (SELECT user_id, product_id, slice, mask FROM sliced JOIN masks USING (user_id) WHERE candidate_ad_id = product_id)"""


def _covered(spark, sf_dir) -> tuple[user_lists.UserLists, DataFrame]:
    """(lists, fused rows, whose masks say which sources list a positive) of users with positives; both written once."""
    lists = _laid(spark, sf_dir, popular_to_all=True)
    lists = replace(lists, rows=staged(lists.rows, "lists"))
    return lists, staged(user_lists.fused(lists, (1.0, 1.0), 60, 0), "covered")


@query("union_ceilings", f"""WITH {MASKS_SQL}, sets AS (SELECT * FROM (VALUES (1, 'itemcf'), (2, 'popularity'), (3, 'itemcf+popularity')) AS v(m, sources)),
total AS (SELECT slice, count(*) AS positive_pairs FROM sliced GROUP BY 1),
per_user AS (SELECT slice, user_id, m, count(*) FILTER (mask & m <> 0) AS n FROM hits, sets GROUP BY ALL),
sums AS (SELECT slice, m, sum(n)::BIGINT AS h, sum(least(n, 100))::BIGINT AS o FROM per_user GROUP BY ALL)
SELECT t.slice, s.sources, positive_pairs, coalesce(h, 0) AS hit_pairs, round(coalesce(h, 0) / positive_pairs, 9) AS coverage, coalesce(o, 0) AS oracle_pairs, round(coalesce(o, 0) / positive_pairs, 9) AS oracle_coverage
FROM total t CROSS JOIN sets s LEFT JOIN sums u ON u.slice = t.slice AND u.m = s.m""")
def union_ceilings(spark, sf_dir):
    """What each set of sources covers of seen and unseen products' positives."""
    return rounded(user_lists.union_ceilings(_covered(spark, sf_dir)[1], TWO), "coverage", "oracle_coverage", digits=9)


@query("source_baselines", f"""WITH {MASKS_SQL}, l AS (SELECT * FROM lists WHERE rank <= 100 AND user_id IN (SELECT user_id FROM positives)),
c AS (SELECT source, count(DISTINCT (user_id, candidate_ad_id)) AS candidate_rows, count(DISTINCT user_id) AS candidate_users, count(DISTINCT candidate_ad_id) AS unique_items FROM l GROUP BY 1),
h AS (SELECT source, count(*) AS h, count(DISTINCT l.user_id) AS hu FROM l JOIN positives p ON p.user_id = l.user_id AND p.product_id = l.candidate_ad_id GROUP BY 1),
z AS (SELECT count(*) AS pairs, count(DISTINCT user_id) AS users FROM positives)
SELECT source, candidate_rows, candidate_users, unique_items, coalesce(h, 0) AS hit_pairs, coalesce(hu, 0) AS hit_users, round(coalesce(h, 0) / pairs, 9) AS coverage, round(coalesce(hu, 0) / users, 9) AS hit_rate FROM c LEFT JOIN h USING (source), z""")
def source_baselines(spark, sf_dir):
    return rounded(user_lists.source_baselines(*_covered(spark, sf_dir), TWO), "coverage", "hit_rate", digits=9)


VARIANTS = recall.fusion_variants()


@query("fusion_variant_report", f"""WITH {MASKS_SQL}, variants AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {k}::DOUBLE, {a}::DOUBLE, {p}::DOUBLE)" for i, (n, k, a, _, p) in enumerate(VARIANTS))}) AS v(place, variant, k, a, p)),
scored AS (SELECT variant, user_id, candidate_ad_id, round(sum(CASE WHEN source = 'itemcf' THEN a ELSE p END / (k + rank)), 12) AS score FROM lists, variants GROUP BY ALL),
best AS (SELECT * FROM scored WHERE user_id IN (SELECT user_id FROM positives) QUALIFY row_number() OVER (PARTITION BY variant, user_id ORDER BY score DESC, candidate_ad_id) <= 100),
r AS (SELECT b.*, mask, p.product_id IS NOT NULL AS hit FROM best b JOIN masks m ON m.user_id = b.user_id AND m.candidate_ad_id = b.candidate_ad_id LEFT JOIN positives p ON p.user_id = b.user_id AND p.product_id = b.candidate_ad_id),
s AS (SELECT variant, count(DISTINCT user_id) AS output_users, count(DISTINCT candidate_ad_id) AS unique_items, avg(bit_count(mask)::DOUBLE) AS mean_sources, count(*) FILTER (hit) AS h, count(DISTINCT user_id) FILTER (hit) AS hu,
  avg((mask & 1)::DOUBLE) AS share_itemcf, avg(((mask >> 1) & 1)::DOUBLE) AS share_popularity, coalesce(sum(mask & 1) FILTER (hit), 0) AS k0, coalesce(sum((mask >> 1) & 1) FILTER (hit), 0) AS k1 FROM r GROUP BY 1),
z AS (SELECT count(*) AS pairs, count(DISTINCT user_id) AS users FROM positives), l AS (SELECT sum(mask & 1) AS l0, sum((mask >> 1) & 1) AS l1 FROM hits),
o AS (SELECT place, variant, output_users, unique_items, mean_sources, h / pairs AS coverage, hu / users AS hit_rate, share_itemcf, share_popularity, coalesce(k0 / nullif(l0, 0), 0) AS retention_itemcf, coalesce(k1 / nullif(l1, 0), 0) AS retention_popularity,
  CASE WHEN l0 >= l1 THEN coalesce(k0 / nullif(l0, 0), 0) ELSE coalesce(k1 / nullif(l1, 0), 0) END AS tie FROM variants JOIN s USING (variant), z, l)
SELECT variant, output_users, unique_items, round(mean_sources, 9) AS mean_sources, round(coverage, 9) AS coverage, round(hit_rate, 9) AS hit_rate, round(share_itemcf, 9) AS share_itemcf, round(share_popularity, 9) AS share_popularity,
  round(retention_itemcf, 9) AS retention_itemcf, round(retention_popularity, 9) AS retention_popularity, (row_number() OVER (ORDER BY coverage DESC, hit_rate DESC, tie DESC, place) = 1)::INT AS best FROM o""")
def fusion_variant_report(spark, sf_dir):
    """Composition, coverage and retention of every variant without quotas, and which to take."""
    lists, found = _covered(spark, sf_dir)
    strongest = fusion_report.strongest_source(user_lists.source_baselines(lists, found, TWO), TWO)
    out = user_lists.variant_report(lists, [(n, k, i, p) for n, k, i, _, p in VARIANTS], strongest)
    return rounded(out, *(c for c, kind in out.dtypes if kind == "double"), digits=9)


# --- policies, budgets and pacing -----------------------------------------------------------------------------------

POLICIES = {"fixed": (1.0, None), "ctr": (1.0, "score_pctr"), "ctcvr": (1.0, "score_pctcvr"), "target_cpa": (10.0, "score_pctcvr")}
BUDGETS = (5.0, 60.0)


def _policies_cleared(spark, sf_dir) -> DataFrame:
    rows, out = staged(_grouped(spark, sf_dir).withColumn("quality", F.col("score_pctr")), "grouped"), None
    for name, (base, score) in POLICIES.items():
        bid = F.lit(base) if score is None else base * F.col(score)
        one = auction.clear_auctions(rows.withColumn("bid", bid), "quality", "bid").withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("pacing_comparison", f"""WITH RECURSIVE {GROUPED_SQL},
q AS ({' UNION ALL '.join(f"SELECT '{n}' AS policy, auction_id, event_id, score_pctr AS quality, {b}::DOUBLE{'' if s is None else f' * {s}'} AS bid FROM auctions" for n, (b, s) in POLICIES.items())}),
w AS (SELECT *, row_number() OVER v AS r, lead(quality * bid) OVER v AS nxt FROM q WINDOW v AS (PARTITION BY policy, auction_id ORDER BY quality * bid DESC, event_id)),
o AS MATERIALIZED (SELECT policy, least(bid, coalesce(nxt, quality * bid) / greatest(quality, 1e-12)) AS p, row_number() OVER (PARTITION BY policy ORDER BY auction_id) AS i, count(*) OVER (PARTITION BY policy) AS n FROM w WHERE r = 1),
f AS (
  SELECT policy, budget, pacing, 0::BIGINT AS i, 0::BIGINT AS n, 0 AS won, 0.0::DOUBLE AS total, 1.0::DOUBLE AS m
  FROM (SELECT DISTINCT policy FROM o), (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUDGETS)}) AS v(budget), (VALUES ('no_pacing'), ('feedback')) AS g(pacing)
  UNION ALL
  SELECT policy, budget, pacing, i, n, won, total, CASE WHEN pacing = 'feedback' THEN least(3.0::DOUBLE, greatest(0.1::DOUBLE, m * pow((i::DOUBLE / n) / greatest(total / budget, 1e-12::DOUBLE), 0.1::DOUBLE))) ELSE 1.0::DOUBLE END
  FROM (SELECT f.policy, budget, pacing, o.i, o.n, (total + p * m <= budget + 1e-12)::INT AS won, CASE WHEN total + p * m <= budget + 1e-12 THEN total + p * m ELSE total END AS total, m FROM f JOIN o ON o.policy = f.policy AND o.i = f.i + 1)),
e AS (SELECT policy, budget, pacing, b, max(total) / budget AS spent, max(ceil(n * b / 10) / n) AS horizon FROM f, range(1, 11) AS t(b) WHERE i > 0 AND i <= ceil(n * b / 10) GROUP BY policy, budget, pacing, b),
h AS (SELECT policy, budget, pacing, avg(abs(spent - horizon)) AS smoothness FROM e GROUP BY policy, budget, pacing)
SELECT policy, budget, pacing, count(*) AS auctions, round(avg(won), 6) AS win_rate, round(max(total), 6) AS spend, round(min(i) FILTER (total >= budget * 0.99) / count(*), 6) AS exhausted_at,
  round(max(total) / budget, 6) AS utilisation, coalesce(min(i) FILTER (total >= budget * 0.99) / count(*) < 0.9, false) AS exhausted_early, round(any_value(smoothness), 6) AS smoothness
FROM f JOIN h USING (policy, budget, pacing) WHERE i > 0 GROUP BY policy, budget, pacing""")
def pacing_comparison(spark, sf_dir):
    """Four bidding policies, two budgets, with and without feedback pacing, side by side over the same auctions."""
    grid = auction.policy_grid(_policies_cleared(spark, sf_dir), list(BUDGETS), (0.1, 3.0, 0.1))
    return rounded(auction.pacing_comparison(grid), "win_rate", "spend", "exhausted_at", "utilisation", "smoothness")
