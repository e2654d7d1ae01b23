"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.llm import chat_formatting, decontamination, jaccard_join, language_id, lm_scoring, merkle, minhash, mixing, quality_rules, sharding, token_output, toxicity, vector_codes
from adspark.llm.common import new_path, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of all sources takes."""
    texts, slots = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixing.taken_words(texts, slots).select("doc_id", "size", "source_size", "target", "taken")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 4-word shingle sets at 0.85."""
    found = jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def _links_sql(width: int, percent: int, more: str = "") -> str:
    """Set sizes and smallest reachable ids under links of shingle sets; `more` is added to the columns."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
f AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY ALL)
SELECT doc_id, n_shingles, component_id{more} FROM f"""


OP2_SQL = _links_sql(4, 85)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 5-word shingle sets at 0.85, and the document that each keeps."""
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), width=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP11_SQL = _links_sql(5, 85, ", doc_id = component_id AS kept")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written and read back."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    token_output.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.token_digests(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict under the production rules."""
    judged = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op8_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    bounds = []
    for r in quality_rules.RULES:
        bounds += [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)),
q AS (
  SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS chars_per_word,
    coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbols_per_word,
    coalesce(n_stop_words::DOUBLE / nullif(n_words, 0), 0) AS stop_word_ratio,
    coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(bounds)} AS kept FROM q"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40, its slot there, and its shard among 41."""
    placed = sharding.number_slots(sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 40).drop("text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
    FROM range(256) AS t(n)))"""


def _op7_sql() -> str:
    def jump(n: int) -> str:
        return f"""(SELECT r, min(b) FILTER (WHERE nxt >= {n})::INT AS shard FROM steps GROUP BY r)"""

    step = f"((key * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT)"
    further = "floor((b + 1) * (2147483648.0::DOUBLE / ((key >> 33) + 1)::DOUBLE))::BIGINT"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS bytes, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
h AS (SELECT r, hex(bytes) AS x, octet_length(bytes) AS n FROM d),
c AS (
  SELECT r, n, xor(list_reduce(range(n), lambda a, i: xor(a >> 8, tab[xor(a & 255, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) + 1]), 4294967295), 4294967295) AS crc
  FROM h, crc),
steps AS (
  SELECT r, b, key, {further} AS nxt FROM (
    SELECT r, 0::BIGINT AS b, {step.replace("key *", "k0 *")} AS key FROM (SELECT r, ('0x' || substr(m, 1, 16))::UBIGINT::HUGEINT AS k0 FROM d))
  UNION ALL
  SELECT r, b, key, {further} FROM (SELECT r, nxt AS b, {step} AS key FROM steps WHERE nxt < 41)),
p AS (
  SELECT d.doc_id, (c.n + 16)::BIGINT AS size, c.crc::BIGINT AS text_crc32, s.shard, g.shard AS grown_shard,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || c.crc || '|' || (c.n + 16)), 1, 8))::BIGINT % {sharding.PARTS} AS part
  FROM d JOIN c USING (r) JOIN {jump(40)} AS s USING (r) JOIN {jump(41)} AS g USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id) - 1)::BIGINT AS slot, grown_shard FROM p"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat_formatting.format_chats(read(spark, sf_dir, "conversations"))


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
e AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM u WHERE pos = n GROUP BY ALL),
k AS (SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM u WHERE pos < n))
SELECT k.conv_id, x.part, k.n AS n_turns, k.n_copies, length(x.text) AS n_chars, x.text
FROM k JOIN (
  SELECT conv_id, ((pos - 1) // {chat_formatting.BLOCK})::INT AS part, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS text
  FROM t GROUP BY ALL) AS x ON x.conv_id IS NOT DISTINCT FROM k.conv_id"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of benchmark windows."""
    found = decontamination.match_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


_ITEM_WORDS = f"""list_filter(string_split_regex(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 11, 2))) AS u(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, s)),
span AS (SELECT r, i, i + n AS e, max(i + n) OVER (PARTITION BY r ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT DISTINCT r, i, n FROM hit)),
words AS (SELECT r, sum(greatest(0, e - greatest(i, coalesce(p, 0))))::BIGINT AS n_hit FROM span GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def fold(folds: int) -> Column:
    """Remainder of a document's key hash, by which folds are told apart; 0 for a null key."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of the other folds."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = toxicity.score_texts(docs, toxicity.fit(docs, labels, fold(5) != 0))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document under the model and the unigram baseline, learned from the other folds."""
    docs = read(spark, sf_dir, "documents")
    model, counts, least = lm_scoring.fit(docs, fold(5) != 1)
    found = lm_scoring.score_texts(docs, model, counts, least)
    return found.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those of the other folds."""
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_text() -> Column:
    """The text, with A-Z lowered where 3 divides the CRC-32 of the decimal doc_id (a null doc_id: as it is)."""
    changed = F.translate("text", decontamination.UPPER, decontamination.UPPER.lower())
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed).otherwise(F.col("text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the proof holds for what may have been tampered with."""
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    altered = merkle.leaf_digest([tampered_text() if f == "text" else F.col(f) for f in FIELDS])
    found = merkle.manifest(docs, "doc_id", "lang", merkle.leaf_digest([F.col(f) for f in FIELDS]), altered)
    found = found.withColumn("folded_root", merkle.fold(F.col("other"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _op12_sql(levels: int = 8, group_levels: int = 4) -> str:
    def leaf(text: str) -> str:
        one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
        return "sha256(" + " || ".join(one(text if f == "text" else f) for f in FIELDS) + ")"

    def tree(t: str, count: int) -> str:
        """Levels of the trees over {t}0 (g, i, d, n), and the paths of {t}w0 (k, g, i, proof, folded)."""
        out = []
        for k in range(count):
            out.append(f"{t}r{k} AS MATERIALIZED (SELECT g, i // 8 AS run, list(d ORDER BY i) AS ds, any_value(n) AS n FROM {t}{k} WHERE n > 1 GROUP BY ALL)")
            out.append(f"{t}{k + 1} AS MATERIALIZED (SELECT g, run AS i, sha256(array_to_string(ds, '')) AS d, (n + 7) // 8 AS n FROM {t}r{k})")
            left, right = "array_to_string(ds[1:i % 8], '')", "array_to_string(ds[i % 8 + 2:], '')"
            out.append(f"""{t}w{k + 1} AS MATERIALIZED (
  SELECT k, w.g, i // 8 AS i, CASE WHEN ds IS NULL THEN proof ELSE proof || {left} || {right} END AS proof,
    CASE WHEN ds IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded
  FROM {t}w{k} AS w LEFT JOIN {t}r{k} AS r ON r.g = w.g AND r.run = w.i // 8)""")
        out.append(f"{t}s AS ({' UNION ALL '.join(f'SELECT g, d FROM {t}{k} WHERE n = 1' for k in range(count + 1))})")
        return ",\n".join(out)

    lower = f"translate(text, '{decontamination.UPPER}', '{decontamination.UPPER.lower()}')"
    return f"""
WITH {_CRC_TABLE},
h AS (SELECT row_number() OVER () AS k, *, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
c AS (
  SELECT h.*, xor(list_reduce(range(length(x) // 2), lambda a, i: xor(a >> 8, tab[xor(a & 255, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) + 1]), 4294967295), 4294967295) AS crc
  FROM h, crc),
l AS MATERIALIZED (
  SELECT k, doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS d, {leaf("altered")} AS folded
  FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN {lower} ELSE text END AS altered FROM c)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
a0 AS (SELECT g, i, d, n FROM o),
aw0 AS (SELECT k, g, i, '' AS proof, folded FROM o),
{tree("a", levels)},
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, d, count(*) OVER () AS n FROM as_),
e AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM as_),
bw0 AS (SELECT w.k, '' AS g, e.i, w.proof, w.folded FROM aw{levels} AS w JOIN e ON e.g = w.g),
{tree("b", group_levels)}
SELECT o.doc_id, o.d AS leaf, s.d AS subroot, r.d AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.d AS verified
FROM o JOIN as_ AS s ON s.g = o.g JOIN bw{group_levels} AS w ON w.k = o.k CROSS JOIN bs AS r""".replace("as AS (", "as_ AS (")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code, and its error under the codebooks."""
    found = vector_codes.codes(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql() -> str:
    entries, parts = vector_codes.ENTRIES, vector_codes.PARTS
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""n{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, struct_pack(w := way, e := e)) AS e, min(way) AS way
  FROM (SELECT c.r, c.p, b.e, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.v[i]) * (c.v[i] - b.v[i])))::BIGINT AS way
    FROM cut AS c JOIN book{k} AS b ON b.p = c.p) GROUP BY ALL)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} AS b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS v FROM (
      SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s
      FROM (SELECT n.p, n.e, u.i, c.v[u.i] AS x FROM n{k} AS n JOIN cut AS c ON c.r = n.r AND c.p = n.p, unnest(range(1, len(c.v) + 1)) AS u(i)) GROUP BY ALL)
    GROUP BY ALL) AS m ON m.p = b.p AND m.e = b.e)""")
    last = vector_codes.ROUNDS
    return f"""
WITH rows_ AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {vector_codes.SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM rows_, range({parts}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r AS e, v FROM cut WHERE r < {entries}),
{", ".join(steps)},
f AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(way)::BIGINT AS error FROM n{last} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS books FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256 FROM rows_ JOIN f USING (r), h"""


QUERIES = {
    "op10_decontamination": op10_decontamination,
    "op11_minhash": op11_minhash,
    "op12_merkle": op12_merkle,
    "op13_vector_codes": op13_vector_codes,
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_output": op3_token_output,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
}
ORACLES = {"op2_jaccard_join": OP2_SQL, "op11_minhash": OP11_SQL, "op12_merkle": _op12_sql(), "op13_vector_codes": _op13_sql(), "op10_decontamination": OP10_SQL, "op5_chat_formatting": OP5_SQL, "op7_sharding": _op7_sql(), "op8_quality_rules": _op8_sql()}
