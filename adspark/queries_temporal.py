"""Registered queries on evaluations of lists and on coarse ranking under a temporal contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.operators import audit, evaluation, metrics, sampling, temporal, user_lists
from adspark.plans import funnel
from adspark.queries import _HASH, FUSED, FUSED_SQL, SPLIT_SQL, _laid, _past_future, _weights, query, rounded
from adspark.sources.adapters import interactions, table
from adspark.sources.staging import staged

BEST_SQL = f"""{FUSED_SQL}, f AS (
  SELECT user_id, candidate_ad_id, rrf_score, row_number() OVER (PARTITION BY user_id ORDER BY rrf_score DESC, candidate_ad_id) AS rank FROM fused QUALIFY rank <= 100)"""


def _half_sql(rows: str, name: str) -> str:
    return f"""{name} AS (SELECT min(ts) AS {name}_t FROM (
  SELECT ts, sum(n) OVER (ORDER BY ts) AS upto, sum(n) OVER () AS total FROM (SELECT click_timestamp AS ts, count(*) AS n FROM {rows} GROUP BY 1)) WHERE upto > ceil(0.5::DOUBLE * (total - 1)))"""


HALVES_SQL = f"""{_half_sql('past', 'pm')}, {_half_sql('future', 'fm')},
past_a AS (SELECT past.* FROM past, pm WHERE click_timestamp <= pm_t), past_b AS (SELECT past.* FROM past, pm WHERE click_timestamp > pm_t),
future_a AS (SELECT future.* FROM future, fm WHERE click_timestamp <= fm_t)"""


def _best(spark, sf_dir, judged=None) -> tuple[user_lists.UserLists, DataFrame]:
    """(lists, fused rows) of users of both windows; the fused rows are written once."""
    lists = _laid(spark, sf_dir, judged=judged)
    return lists, staged(user_lists.fused(lists, _weights(lists, **FUSED), 100, 100), "fused")


# --- evaluations of lists -------------------------------------------------------------------------------------------


def _coverage_row(c: int) -> str:
    return f"""SELECT {c} AS cutoff, count(*) AS users, round(avg(size), 9) AS positives_per_user, round(avg(n), 9) AS candidates_per_user, any_value(unique_items) AS unique_items,
  count(*) FILTER (h{c} > 0) AS users_with_hit, round(avg(h{c} / size), 9) AS recall, round(avg((h{c} > 0)::INT), 9) AS hit_rate FROM e, i"""


@query("recall_coverage", f"""WITH {BEST_SQL}, sizes AS (SELECT user_id, count(*) AS size FROM positives GROUP BY 1),
a AS (SELECT f.user_id, f.candidate_ad_id, rank, p.product_id IS NOT NULL AS hit FROM f JOIN sizes s ON s.user_id = f.user_id LEFT JOIN positives p ON p.user_id = f.user_id AND p.product_id = f.candidate_ad_id),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (hit AND rank <= 10) AS h10, count(*) FILTER (hit AND rank <= 50) AS h50 FROM a GROUP BY 1),
e AS (SELECT size, coalesce(n, 0) AS n, coalesce(h10, 0) AS h10, coalesce(h50, 0) AS h50 FROM sizes LEFT JOIN g USING (user_id)),
i AS (SELECT count(DISTINCT candidate_ad_id) AS unique_items FROM a)
{_coverage_row(10)} UNION ALL {_coverage_row(50)}""")
def recall_coverage(spark, sf_dir):
    """Recall of the fused lists with how many candidates and items they have."""
    found = user_lists.list_coverage(_best(spark, sf_dir)[1], (10, 50))
    return rounded(found, "positives_per_user", "candidates_per_user", "recall", "hit_rate", digits=9)


def _catalogue_row(c: int) -> str:
    return f"""SELECT {c} AS cutoff, count(*) AS users, count(*) FILTER (warm > 0) AS warm_users, round(avg(coalesce(1 / first, 0)), 9) AS mrr, round(avg(gain / ideal), 9) AS ndcg, any_value(unique_items) AS unique_items,
  round(any_value(unique_items / known), 9) AS catalogue_coverage, any_value(candidate_users) AS candidate_users,
  round(avg(h{c} / size), 9) AS recall, round(avg(CASE WHEN warm > 0 THEN w{c} / warm END), 9) AS warm_recall, round(avg((h{c} > 0)::INT), 9) AS hit_rate FROM u JOIN ideals ON n = least(size, 100), l, k"""


@query("catalogue_evaluation", f"""WITH {BEST_SQL}, t AS (SELECT user_id, product_id, product_id IN (SELECT product_id FROM past) AS is_warm FROM positives),
ideals AS (SELECT n, sum(1 / log2(n_ + 1)) AS ideal FROM range(1, 101) AS x(n), range(1, 101) AS y(n_) WHERE n_ <= n GROUP BY 1),
j AS (SELECT t.*, rank FROM t LEFT JOIN f ON f.user_id = t.user_id AND f.candidate_ad_id = t.product_id),
u AS (SELECT user_id, count(*) AS size, count(*) FILTER (is_warm) AS warm, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 100), 0) AS gain, min(rank) FILTER (rank <= 100) AS first,
  count(*) FILTER (rank <= 50) AS h50, count(*) FILTER (rank <= 50 AND is_warm) AS w50, count(*) FILTER (rank <= 100) AS h100, count(*) FILTER (rank <= 100 AND is_warm) AS w100 FROM j GROUP BY 1),
l AS (SELECT count(DISTINCT user_id) AS candidate_users, count(DISTINCT candidate_ad_id) FILTER (rank <= 100) AS unique_items FROM f), k AS (SELECT count(DISTINCT p_partkey) AS known FROM part)
{_catalogue_row(50)} UNION ALL {_catalogue_row(100)}""")
def catalogue_evaluation(spark, sf_dir):
    """Recall of all and of warm products, rank quality and catalogue coverage of the fused lists, whose ranks have no gaps."""
    catalogue = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"))
    found = user_lists.catalogue_evaluation(_best(spark, sf_dir)[1], catalogue, (50, 100))
    return rounded(found, "mrr", "ndcg", "catalogue_coverage", "recall", "warm_recall", "hit_rate", digits=9)


THREE = ("itemcf", "popularity", "fused")
_HITS_SQL = f"""{BEST_SQL}, every AS (SELECT user_id, candidate_ad_id, source, rank FROM lists UNION ALL SELECT user_id, candidate_ad_id, 'fused', rank FROM f),
h AS (SELECT DISTINCT e.user_id, e.candidate_ad_id, source FROM every e JOIN positives p ON p.user_id = e.user_id AND p.product_id = e.candidate_ad_id WHERE rank <= 100),
s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(THREE))}) AS v(place, source))"""


def _hit_masks(spark, sf_dir) -> DataFrame:
    return user_lists.by_mask(_best(spark, sf_dir)[1], 100, 1 << THREE.index("fused"))


@query("source_hit_overlap", f"""WITH {_HITS_SQL}, n AS (SELECT s.source, count(h.source) AS n FROM s LEFT JOIN h USING (source) GROUP BY 1),
c AS (SELECT a.source AS l, b.source AS r, count(*) AS shared FROM h a JOIN h b ON a.user_id = b.user_id AND a.candidate_ad_id = b.candidate_ad_id AND a.source <> b.source GROUP BY ALL)
SELECT x.source AS "left", y.source AS "right", coalesce(shared, 0) AS shared, round(coalesce(shared / nullif(x.n + y.n - coalesce(shared, 0), 0), 0), 9) AS jaccard, round(coalesce(shared / nullif(y.n, 0), 0), 9) AS right_kept
FROM n x JOIN n y ON x.source <> y.source LEFT JOIN c ON c.l = x.source AND c.r = y.source""")
def source_hit_overlap(spark, sf_dir):
    """Which hits the sources and the fused lists share, and what fusion keeps of each source."""
    return rounded(evaluation.hit_overlap(_hit_masks(spark, sf_dir), THREE), "jaccard", "right_kept", digits=9)


@query("incremental_coverage", f"""WITH {_HITS_SQL}, first AS (SELECT user_id, candidate_ad_id, min(place) AS place FROM h JOIN s USING (source) GROUP BY ALL),
a AS (SELECT s.place, s.source, count(x.place) AS added FROM s LEFT JOIN first x ON x.place = s.place GROUP BY ALL), z AS (SELECT count(*) AS total FROM positives)
SELECT place, source, added, round(added / total, 9) AS added_coverage, round(sum(added) OVER (ORDER BY place) / total, 9) AS union_coverage FROM a, z""")
def incremental_coverage(spark, sf_dir):
    """What each source adds to those before it."""
    return rounded(evaluation.incremental_hits(_hit_masks(spark, sf_dir), THREE), "added_coverage", "union_coverage", digits=9)


CHECKED = ["product_price", "product_brand", "product_category_1", "device_type", "clicks_last_7d"]


@query("leakage_report", f"""WITH {SPLIT_SQL}, c AS (SELECT 'forbidden_features' AS "check", 0::BIGINT AS found
UNION ALL SELECT 'past_rows_not_before', count(*) FROM past WHERE click_timestamp >= (SELECT min(click_timestamp) FROM future)
UNION ALL SELECT 'keys_in_both', count(*) FROM (SELECT event_id FROM past INTERSECT SELECT event_id FROM future)
UNION ALL SELECT 'constant_features', {' + '.join(f'(min({c}) IS NOT DISTINCT FROM max({c}))::BIGINT' for c in CHECKED)} FROM future)
SELECT "check", found, found = 0 AS passed FROM c""")
def leakage_report(spark, sf_dir):
    """Whether features, windows and keys keep the later window out of the past."""
    return evaluation.leakage_report(*_past_future(spark, sf_dir), CHECKED)


@query("validation_comparison", f"""WITH {SPLIT_SQL}, d AS (SELECT *, {_HASH.format("'2026' || chr(31) || event_id")} % 10000 < 2000 AS held FROM interactions),
w AS (SELECT 'by_time' AS validation, product_id, conversion_label AS y, click_timestamp > (SELECT t FROM bound) AS held FROM interactions WHERE click_timestamp IS NOT NULL UNION ALL SELECT 'random', product_id, conversion_label, held FROM d),
g AS (SELECT validation, avg(y) AS g FROM w WHERE NOT held GROUP BY 1),
r AS (SELECT validation, product_id, count(*) AS n, sum(y) AS c FROM w WHERE NOT held GROUP BY ALL),
p AS (SELECT w.validation, y, round(coalesce((c + 20.0::DOUBLE * g) / (n + 20.0::DOUBLE), g), 9) AS s FROM w JOIN g ON g.validation = w.validation LEFT JOIN r ON r.validation = w.validation AND r.product_id = w.product_id WHERE held),
h AS (SELECT validation, s, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
o AS (SELECT *, sum(tp) OVER v AS ctp, sum(n) OVER v AS cn FROM h WINDOW v AS (PARTITION BY validation ORDER BY s DESC)),
q AS (SELECT validation, sum(n)::BIGINT AS "rows", sum(tp)::BIGINT AS positives, sum((n - tp) * (ctp - tp) + 0.5::DOUBLE * tp * (n - tp)) / (sum(tp) * (sum(n) - sum(tp))) AS a, sum(tp * ctp / cn) / sum(tp) AS ap FROM o GROUP BY 1),
l AS (SELECT validation, avg(-(y * ln(greatest(least(s, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(s, 1 - 1e-7), 1e-7)))) AS ll, avg((s - y) * (s - y)) AS b FROM p GROUP BY 1)
SELECT validation, "rows", positives, round(a, 6) AS roc_auc, round(ap, 6) AS average_precision, round(ll, 6) AS log_loss, round(b, 6) AS brier FROM q JOIN l USING (validation)""")
def validation_comparison(spark, sf_dir):
    """Smoothed product rates judged on rows held out at random and on the later window."""
    rows = staged(interactions(spark, sf_dir), "interactions").withColumn("held", sampling.is_validation(F.col("event_id")))
    past, future = funnel.temporal_split(rows)
    scored = {}
    for name, fit, held in (("random", rows.where("NOT held"), rows.where("held")), ("by_time", past, future)):
        scored[name] = staged(audit.prior_predictions(fit, held).withColumn("score", F.round("p_product", 9)).select("conversion_label", "score"), name)
    found = evaluation.validation_comparison(scored, "conversion_label", "score")
    return rounded(found, "roc_auc", "average_precision", "log_loss", "brier")


# --- coarse ranking under a temporal contract -----------------------------------------------------------------------


def _windows(spark, sf_dir, *columns: str) -> temporal.Windows:
    return temporal.four_windows(*_past_future(spark, sf_dir, "user_id", "product_id", *columns))


@query("temporal_training_rows", f"""WITH {SPLIT_SQL}, {HALVES_SQL}, tp AS (SELECT user_id, product_id, max(conversion_label) AS converted FROM past_b GROUP BY ALL),
pool AS (SELECT product_id AS candidate_ad_id, row_number() OVER (ORDER BY count(*) DESC, product_id) - 1 AS pos, count(*) OVER () AS size FROM past_a GROUP BY 1),
u AS (SELECT user_id, count(*) AS n FROM tp GROUP BY 1),
v AS (SELECT user_id, n, candidate_ad_id, ((pos - {_HASH.format("'2026' || chr(31) || user_id")} % size) % size + size) % size AS step FROM u, pool),
free AS (SELECT v.* FROM v ANTI JOIN tp p ON p.user_id = v.user_id AND p.product_id = v.candidate_ad_id)
SELECT user_id, product_id AS candidate_ad_id, 1 AS label, CASE WHEN converted = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS sample_weight FROM tp
UNION ALL SELECT user_id, candidate_ad_id, 0, 1.0::DOUBLE FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step) <= n * 5)""")
def temporal_training_rows(spark, sf_dir):
    """Clicked pairs of the past's later half, and five of the earlier half's products for each."""
    parts = _windows(spark, sf_dir, "conversion_label")
    return temporal.training_rows(parts.past_a, parts.past_b, 5)


CUTOFFS = (20, 30, 50, 70)


@query("fused_retention", f"""WITH {BEST_SQL}, {HALVES_SQL}, t AS (SELECT DISTINCT user_id, product_id FROM future_a),
j AS (SELECT t.user_id, rank FROM t LEFT JOIN f ON f.user_id = t.user_id AND f.candidate_ad_id = t.product_id)
SELECT c AS cutoff, count(*) AS positives, count(rank) AS in_inventory, count(*) FILTER (rank <= c) AS retained, round(count(*) FILTER (rank <= c) / nullif(count(rank), 0), 9) AS retention,
  count(DISTINCT user_id) FILTER (rank IS NOT NULL) AS users_before, count(DISTINCT user_id) FILTER (rank <= c) AS users_after FROM j, (VALUES {', '.join(f'({c})' for c in CUTOFFS)}) AS v(c) GROUP BY c""")
def fused_retention(spark, sf_dir):
    """What the first candidates by fused score keep of the clicks of the future's earlier half."""
    early = lambda past, future: temporal.four_windows(past, future).future_a.select("user_id", "product_id").distinct()
    return rounded(user_lists.retention_at(_best(spark, sf_dir, early)[1], CUTOFFS), "retention", digits=9)


@query("temporal_coarse")
def temporal_coarse(spark, sf_dir):
    """(sorted_by, cutoff, retention and its counts, roc_auc, average_precision, log_loss): candidates sorted by a coarse model of the
    past's later clicks and by their fused score, judged by the future's earlier half."""
    parts = _windows(spark, sf_dir, "event_id", "conversion_label", "product_price", "clicks_last_7d")
    lists, found = _best(spark, sf_dir)
    fused = staged(user_lists.candidates(found, lists.products), "candidates")
    model = temporal.fit_temporal_coarse(parts)
    judged = staged(temporal.judged_candidates(temporal.score_candidates(model, fused, parts.past_a), parts.future_a), "judged")
    out = None
    for name, score in (("coarse_score", F.col("coarse_score")), ("rrf_score", F.col("rrf_score"))):
        kept = temporal.retention_at(judged, parts.future_a, [F.desc(name), F.desc("rrf_score"), F.col("candidate_ad_id")], CUTOFFS)
        quality = metrics.ranking_quality(judged.withColumn("_s", score), "label", "_s").select("roc_auc", "average_precision")
        losses = metrics.probability_losses(judged, "label", "coarse_score").select(F.when(F.lit(name == "coarse_score"), F.col("log_loss")).alias("log_loss"))
        one = kept.crossJoin(quality).crossJoin(losses).select(F.lit(name).alias("sorted_by"), "*")  # single rows
        out = one if out is None else out.unionByName(one)
    return rounded(out, "retention", "roc_auc", "average_precision", "log_loss")
