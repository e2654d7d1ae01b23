"""Operators against brute force and on their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from adspark.llm import chat_formatting, common, decontamination, jaccard_join, language_id, lm_scoring, mixing, quality_rules, queries, sharding, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, n string, part string, words string, h string, rank string"
random.seed(5)
WORDS = ["".join(random.choice("abcdeéßñ") for _ in range(random.randint(2, 6))) for _ in range(300)]


def text(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def edited(t, places):
    w = t.split(" ")
    for p in places:
        w[p] = "zzz"
    return " ".join(w)


BASE = text(200, 1)
TEXTS = [None, "", " \n\t ", "one", "two words", "one", BASE, BASE, BASE.upper(), edited(BASE, [5]), edited(BASE, [5, 80, 120]), text(150, 2), text(20_000, 3), text(200, 4) + " " + text(200, 4), "a\n\nb\n a \nb\n" * 9, "# $ % &" * 12, text(90, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1) + ("x",) * 7 for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, TEXTS[11], None, None, None) + (None,) * 7, (None, None, None, None, None) + (None,) * 7]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_rules(docs, empty):
    for r in quality_rules.apply_rules(docs).collect():
        w, at = split(r.text), defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "") and r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality_rules.apply_rules(empty).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = math.floor((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs, empty, spark, tmp_path):
    placed = sharding.number_slots(sharding.assign_shards(docs, 7)).collect()
    by = defaultdict(list)
    for r in placed:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 7), jump(key, 8)) and r.grown_shard in (r.shard, 7)
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by[r.shard].append(r.slot)
    assert len(placed) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.number_slots(sharding.assign_shards(empty, 7)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "s"), 7)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(placed)


def test_chat_formatting(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", None), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", ""), (5, 0, None, "c"), (6, 0, "user", "b"), (6, 1, "user", "a")]
    df = spark.createDataFrame([t + ("x",) for t in turns], "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_formatting.format_chats(df).collect()}
    assert set(got) == {3, 5, 6} and got[3] == (3, 2, "<|user|>\na\n<|assistant|>\nb\n<|user|>\n\n")
    assert chat_formatting.format_chats(df.where("false")).count() == 0
    orphans = spark.createDataFrame([(None, 0, "user", "q"), (None, None, "user", "p")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat_formatting.format_chats(orphans).collect()] == [(None, 2)]


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_formatting, "BLOCK", 4)
    df = spark.createDataFrame([(c, t, "user", f"m{t}") for c, n in ((1, 10), (2, 9), (3, 10)) for t in range(n)], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.part, r.n_turns, r.n_copies) for r in chat_formatting.format_chats(df).collect())
    assert got == [(1, p, 10, 2) for p in range(3)]


def test_mixing(docs, empty):
    texts, slots = mixing.mix_sources(docs, block_words=16)
    rows = mixing.taken_words(texts, slots, 16).collect()
    again = mixing.taken_words(*mixing.mix_sources(docs.repartition(5), block_words=16), 16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert math.isclose(sum(target.values()), sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 17 and target[s] <= 3 * size[s] + 1e-6 for s in size)
    assert mixing.taken_words(*mixing.mix_sources(empty)).count() == 0


def test_water_filling_and_permutations():
    assert mixing.water_fill([10, 90, 0], [1, 1, 1]) == [30.0, 70.0, 0.0]
    for n in (1, 2, 3, 100, 1000):
        got = mixing.permuted(np.arange(n), n, np.full(n, 9, np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    counts = mixing.draw_counts(np.array([5, 0, 100]), 7, 3)
    assert counts.sum(axis=0).tolist() == [5, 0, 100]


def test_mixed_documents_keep_words(docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    out = mixing.mixed_documents(docs.select(*cols), block_words=16)
    assert out.columns == cols
    got = Counter()
    whole = defaultdict(str)
    for r in docs.collect():
        whole[r.doc_id, r.source] += "\n" + (r.text or "")
    for r in out.collect():
        assert r.text in whole[r.doc_id, r.source] and r.n_chars == len(r.text)
        got[r.doc_id] += len(split(r.text))
    want = Counter()
    for r in mixing.taken_words(*mixing.mix_sources(docs, block_words=16), 16).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def brute_components(rows, width, percent):
    sets, ids = [], []
    for i, t in rows:
        w = split(lower(t))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
        ids.append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for x in range(len(rows)):
        least[find(x)].append(ids[x])
    return Counter((ids[x], len(sets[x]), min((i for i in least[find(x)] if i is not None), default=None)) for x in range(len(rows)))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(docs, empty, width, percent):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], width, percent)
    got = jaccard_join.jaccard_components(docs, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard_join.jaccard_components(empty, width, percent).count() == 0


def near_copies(n, seed):
    rng, base = random.Random(seed), text(60, seed)
    out = []
    for i in range(n):
        out.append((seed * 1000 + i, edited(base, rng.sample(range(60), rng.choice([0, 1, 1, 2, 2, 3])))))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_many_near_copies_by_stars(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard_join, "MOST_ROUNDS", rounds)
    if rounds:  # force star rounds before the exact one
        monkeypatch.setattr(jaccard_join, "cross_count", lambda labelled, left=[rounds]: (0, left.__setitem__(0, left[0] - 1) or left[0] + 0.5))
    rows = [r for seed in (11, 12) for r in near_copies(60, seed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_keep_one(docs):
    kept = jaccard_join.keep_one(docs, 5, 80)
    got = Counter(r.doc_id for r in kept.collect())
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    empty = Counter(i for (i, n, _), k in want.items() for _ in range(k) if n == 0)
    first = Counter({c for (i, n, c) in want if n > 0})
    assert got == empty + first and kept.columns == docs.columns


def item_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def test_decontamination(docs, empty, spark):
    items = [(1, text(30, 4)), (2, "one"), (3, None), (4, "..."), (2, text(13, 2)), (10, " ".join(BASE.split()[40:60]).upper()), (10, " ".join(BASE.split()[40:60])), (7, "b a b")]
    bench = spark.createDataFrame([i + ("x",) for i in items], "item_id long, text string, words string")
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for r in decontamination.match_benchmark(docs, bench).collect():
        w, hit, found = item_words(r.text), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                for i in windows.get(tuple(w[k : k + n]), ()) if k + n <= len(w) else ():
                    found.add(i)
                    hit.update(range(k, k + n))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found)), r.doc_id
    assert decontamination.match_benchmark(empty, bench).count() == 0
    none = decontamination.match_benchmark(docs, bench.where("false")).collect()
    assert len(none) == docs.count() and not any(r.n_hit for r in none)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 50_000, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[: n // 50] = 2**32 - 1
            data = token_output.pack(ids)
            assert (token_output.unpack(data) == ids).all()
            assert n < 256 or (token_output.unpack(data, 1, 2) == ids[128:256]).all()
    assert len(token_output.pack(np.arange(128_000, dtype=np.uint32) % 1000)) < 128_000 * 4 / 2


def test_tokens(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    odd = ["a  b", "x\n\ny", "  q", "don't 's", "<|endoftext|> t", "é ß　z", "w\r\nv", "\x1c a"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    token_output.write_tokens(rows, str(tmp_path / "t"), path, 2)
    table = spark.read.parquet(str(tmp_path / "t"))
    got = token_output.read_tokens(table).orderBy("start").collect()
    assert len(got) == rows.count() and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    at, seen = 0, Counter()
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        seen[r.doc_id, tuple(r.ids)] += 1
    want = Counter((r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in rows.collect())
    assert seen == want
    crc = {(r.part, r.seq, r.place): r.ids_crc32 for r in token_output.token_digests(table).collect()}
    assert all(crc[r.part, r.seq, r.place] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    token_output.write_tokens(empty, str(tmp_path / "e"), path, 2)
    assert token_output.token_digests(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(token_output, "PIECE", 64)
    t = (text(300, 9) + "\n" + "x" * 400 + " é é  b").encode()
    parts = token_output._safe_pieces(t)
    assert b"".join(parts) == t and len(parts) > 5
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = e.tokenizer.encode(t.decode(), add_special_tokens=False).ids
    assert np.concatenate([e.encode(p, np.array([len(p)]))[0] for p in parts]).tolist() == whole


def test_lm_scoring(docs, empty):
    trained = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 1
    got = lm_scoring.score_texts(docs, *lm_scoring.fit(docs, trained)).collect()
    toks = lambda t: split(lower(t)) + [None]
    c = Counter(w for r in docs.collect() if (r.doc_id or 0) % 4 != 1 for w in toks(r.text))
    n, v = sum(c.values()), len(c)
    by = defaultdict(list)
    for r in docs.collect():
        by[r.doc_id].append(r.text)
    for r in got:
        assert r.train_tokens == n and r.score < 0
        options = [(len(toks(t)), sum(c[w] > 0 for w in toks(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for t in by[r.doc_id]]
        assert any(r.n_tokens == a and r.n_known == b and math.isclose(r.base_score, s, rel_tol=1e-9) for a, b, s in options)
    assert lm_scoring.score_texts(empty, *lm_scoring.fit(empty, F.lit(True))).count() == 0


def test_lm_rare_words_are_joined(docs, monkeypatch):
    want = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score) for r in lm_scoring.score_texts(docs, *lm_scoring.fit(docs, F.lit(True))).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 8)
    for r in lm_scoring.score_texts(docs, *lm_scoring.fit(docs, F.lit(True))).collect():
        assert want[r.doc_id, r.n_tokens][0] == r.n_known and math.isclose(want[r.doc_id, r.n_tokens][1], r.base_score, rel_tol=1e-9)


def test_lm_class_softmax_sums_to_one():
    model = lm_scoring.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), 0, 0, np.zeros(lm_scoring.CLASSES), np.zeros(lm_scoring.CLASSES, np.float32), np.random.default_rng(0).normal(size=(64, lm_scoring.CLASSES)).astype(np.float32))
    p = lm_scoring._softmax(lm_scoring._logits(model, np.arange(40).reshape(10, 4)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def lm_scores_by_hand(texts, trained, classes_of, rows):
    """Scores of all texts with the model's steps written out, one token after the other; classes_of: word -> class."""
    c = Counter(w for part in trained for t in part for w in split(lower(t)) + [None])
    n_c, v_c = Counter(), Counter()
    for w, n in c.items():
        n_c[classes_of(w)] += n
        v_c[classes_of(w)] += 1
    size = lm_scoring.CLASSES
    share = np.array([n_c[k] + 1 for k in range(size)]) / (sum(n_c.values()) + size)
    weights = np.zeros((rows, size))

    def walk(t):
        tokens, _, sizes = lm_scoring.tokens_of([None if t is None else t.encode()])
        return zip(split(lower(t)) + [None], lm_scoring.features(tokens, sizes, rows).tolist(), strict=True)

    def probabilities(at):
        e = np.exp(np.log(share) + sum(weights[i] for i in at))
        return e / e.sum()

    for part in trained:
        seen, expected = np.zeros((rows, size)), np.zeros((rows, size))
        for t in part:
            for w, at in walk(t):
                p = probabilities(at)
                for i in at:
                    seen[i, classes_of(w)] += 1
                    expected[i] += p
        weights = weights + lm_scoring.STEP * np.log((seen + lm_scoring.PRIOR * share) / (expected + lm_scoring.PRIOR * share))
    inside = lambda w: math.log10((c[w] + 0.5) / (n_c[classes_of(w)] + 0.5 * (v_c[classes_of(w)] + 1)))
    return [sum(math.log10(probabilities(at)[classes_of(w)]) + inside(w) for w, at in walk(t)) for t in texts]


def test_lm_scores_against_steps_by_hand(docs):
    rows = [r.asDict() for r in docs.where("doc_id is null or doc_id <> 12").select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm_scoring.STEPS)).alias("step")).collect()]
    some = docs.where("doc_id is null or doc_id <> 12")
    model, counts, least = lm_scoring.fit(some, F.lit(True))

    def classes_of(w):
        tokens, own, _ = lm_scoring.tokens_of([None if w is None else w.encode()])
        return 0 if w is None else int(model.classes(tokens[:1], own[:1])[0])

    trained = [[r["text"] for r in rows if r["step"] == k] for k in range(lm_scoring.STEPS)]
    want = lm_scores_by_hand([r["text"] for r in rows], trained, classes_of, len(model.weights))
    got = lm_scoring.score_texts(some, model, counts, least).collect()
    key = lambda pair: (pair[0] is None, pair[0] or 0, pair[1])
    for (a, x), (b, y) in zip(sorted([(r["doc_id"], w) for r, w in zip(rows, want, strict=True)], key=key), sorted([(r.doc_id, r.score) for r in got], key=key), strict=True):
        assert a == b and math.isclose(x, y, rel_tol=1e-4)


def test_lm_partitions_change_nothing(docs):
    found = [{(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score_texts(docs, *lm_scoring.fit(docs.repartition(n), F.lit(True))).collect()} for n in (1, 16)]
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][k], found[1][k], rel_tol=1e-5) for k in found[0])


def test_lm_rows_follow_the_vocabulary():
    assert [lm_scoring.table_rows(v) for v in (0, 1, 1 << 17, (1 << 17) + 32, 1 << 18, 1 << 30)] == [1 << 12, 1 << 12, 1 << 12, 1 << 13, 1 << 13, 1 << 14]


LETTERS = {"aa": "abcde", "bb": "vwxyz", "cc": "éèçàô"}


def lang_text(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(5)) for _ in range(n))


def test_language_id(spark, docs, empty):
    rows = [(i, lang_text(lang, 30, i), lang, "x") for i, lang in enumerate(list(LETTERS) * 20)]
    rows += [(900, None, "aa", "x"), (901, "123 .. \n", "bb", "x"), (None, lang_text("cc", 9, 3), None, "x"), (902, lang_text("bb", 60_000, 4), "bb", "x"), (903, "", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, entropy string")
    got = {r.doc_id: r for r in language_id.identify(df, F.coalesce(F.col("doc_id"), F.lit(1)) % 4 != 2).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang, _ in rows[:60])
    assert [got[i].lang_pred for i in (900, 901, 903, None, 902)] == ["und", "und", "und", "cc", "bb"] and got[900].score == 0
    assert language_id.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}


def test_letters_by_category():
    for t in ("½ ² ①", "123 ..", "", "Ⅷ ⅓", "\u0301 \u0308", "_"):
        assert language_id.normal(t) == "  "
    assert language_id.normal("E\u0301a-ÑB²c") == " e\u0301a ñb c "


def test_long_texts_are_read_in_pieces(monkeypatch):
    model = language_id.fit([(lang, [lang_text(lang, 40, i) for i in range(12)]) for lang in LETTERS])
    texts = [language_id.normal(lang_text("bb", 3000, 4)), language_id.normal(lang_text("aa", 5, 1)), language_id.normal("q" * 5000)]
    want = language_id.entropies(model, texts)
    monkeypatch.setattr(language_id, "SLICE", 501)
    assert np.allclose(language_id.entropies(model, texts), want, rtol=1e-4)


def test_language_ties_go_to_the_first():
    model = language_id.fit([("xx", ["abc abd"]), ("ww", ["abc abd"])])
    cost = language_id.entropies(model, [language_id.normal("abc")])[0]
    assert model.languages == ["ww", "xx"] and cost[0] == cost[1] and int(np.argmin(cost)) == 0


def brute_kneser_ney(texts, text):
    """Cross-entropy of a text by interpolated Kneser-Ney over dictionaries, in nats a character."""
    counts = [Counter() for _ in range(language_id.ORDER + 1)]
    for t in map(language_id.normal, texts):
        for n in range(1, language_id.ORDER + 1):
            counts[n].update(t[i : i + n] for i in range(len(t) - n + 1))
    letters = len(counts[1]) + 1
    use = {language_id.ORDER: counts[language_id.ORDER]}
    for n in range(1, language_id.ORDER):
        lead = Counter(g[1:] for g in counts[n + 1])
        use[n] = {g: lead[g] or 1 for g in counts[n]}

    def chance(g):
        n = len(g)
        under = {h: c for h, c in use[n].items() if h[:-1] == g[:-1]}
        shorter = chance(g[1:]) if n > 1 else 1 / letters
        if not under:
            return shorter
        total = sum(under.values())
        return max(under.get(g, 0) - language_id.DISCOUNT, 0) / total + language_id.DISCOUNT * len(under) / total * shorter

    t = language_id.normal(text)
    return -sum(math.log(chance(t[max(0, i + 1 - language_id.ORDER) : i + 1])) for i in range(1, len(t))) / (len(t) - 1)


def test_entropies_are_those_of_kneser_ney():
    texts = [lang_text("aa", 6, i) for i in range(4)]
    model = language_id.fit([("aa", texts)])
    for t in (texts[0], lang_text("aa", 9, 50), "edcba aaaa bcd"):
        found = language_id.entropies(model, [language_id.normal(t)])[0, 0]
        assert math.isclose(found, brute_kneser_ney(texts, t), rel_tol=1e-3), t


def test_language_model_is_a_distribution():
    model = language_id.fit([("aa", [lang_text("aa", 200, 1)]), ("bb", [lang_text("bb", 200, 2)])])
    letters = " " + "abcde"
    for context in ("abc", "aab", "zzz"):
        codes = [language_id._codes(context + c) for c in letters]
        total = sum(math.exp(float(model.costs(c)[-1, 0])) for c in codes)
        assert 0.9 <= total <= 1.02


def toxic_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def brute_toxicity(rows, marks, trained):
    """{doc_id: (cosines of the nearest examples, vote)} from whole texts, all words and all pairs."""
    texts = {i: Counter(toxic_words(t)) for i, t in rows}
    label = {}
    for i, y in marks:
        if y is not None and i is not None and trained(i):
            label[i] = max(y, label.get(i, 0))
    examples = sorted(i for i in label if i in dict(rows) and dict(rows)[i] is not None)
    toxic = [label[i] for i in examples]
    share = [sum(v == y for v in label.values()) / toxic.count(y) for y in toxic]
    weight = {}
    for w in {w for i in examples for w in texts[i]}:
        a = sum(w in texts[i] for i, y in zip(examples, toxic, strict=True) if y)
        b = sum(w in texts[i] for i, y in zip(examples, toxic, strict=True) if not y)
        n1, n0, n = toxic.count(1), toxic.count(0), len(toxic)
        spread = math.sqrt(max((a + b) * (n - a - b) * n1 * n0, 1e-9))
        phi = abs(a * (n0 - b) - b * (n1 - a)) / spread
        weight[w] = phi * (math.log((1 + len(rows)) / (1 + sum(w in c for c in texts.values()))) + 1)

    def vector(i):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in texts[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    held = {i: vector(i) for i in texts}
    rate = sum(s * y for s, y in zip(share, toxic, strict=True)) / sum(share)
    prior = 0.05 * sum(share) / len(share)
    out = {}
    for i, v in held.items():
        near = [(min(1.0, sum(x * held[e].get(w, 0) for w, x in v.items())), k) for k, e in enumerate(examples)]
        near = sorted(((c, k) for c, k in near if c > 1e-15), key=lambda p: -p[0])[: toxicity.NEAREST]
        each = [(share[k] * c / (1.05 - c), toxic[k]) for c, k in near]
        out[i] = ([c for c, _ in near], (sum(z * y for z, y in each) + prior * rate) / (sum(z for z, _ in each) + prior))
    return out


def test_toxicity(spark, docs, empty):
    rows, marks = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, text(40, 1000 + i) + (" " + " ".join(random.Random(i).choices(["idiot,", "Moron", "scum."], k=3)) if bad else ""), "x"))
        marks += [(i, int(bad))] * (1 + (i == 5))
    more = [(500, None, "x"), (501, "", "x"), (502, "moron scum", "x"), (503, text(20_000, 77), "x"), (504, "neverseen", "x")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame(marks + [(9999, 1), (None, 1), (7, None), (7, 0)], "doc_id long, toxic int")
    index = toxicity.fit(df, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score_texts(df, index).collect()}
    held = [i for i in range(240) if i % 5 == 0]
    assert all(got[i].predicted == int(i % 3 == 0) for i in held)
    assert got[500].score == got[501].score == got[504].score < 0.5 and got[502].predicted == 1 and got[502].evidence and not got[504].evidence
    assert not any(int(e.key) % 5 == 0 for r in got.values() for e in r.evidence)
    want = brute_toxicity([r[:2] for r in rows + more], [*marks, (9999, 1), (7, None), (7, 0)], lambda i: i % 5 != 0)
    for i, (cosines, vote) in want.items():
        assert np.allclose([e.cosine for e in got[i].evidence], cosines) and math.isclose(got[i].score, index.score(vote), rel_tol=1e-6), i
    nothing = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score_texts(docs, nothing).collect()} == {0.0}
    assert {r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, labels.where("toxic = 1"), F.lit(True))).collect()} == {1.0}
    assert toxicity.score_texts(empty, toxicity.fit(empty, labels, F.lit(True))).count() == 0


def test_toxicity_ties_go_to_the_earlier_example(spark):
    df = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(60)], "doc_id long, text string")
    index = toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"), F.lit(True))
    who, cosine = index.nearest(*index.vectors[-1])
    assert np.allclose(cosine, 1) and who.tolist() == sorted(who.tolist()) and len(who) == toxicity.NEAREST
    assert [index.keys[e] for e in who] == sorted(index.keys[e] for e in who) or len(set(index.toxic[who].tolist())) == 1


def thue_morse(n, first="a", other="b"):
    return "".join((first, other)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark, tmp_path):
    from tokenizers import Tokenizer

    a, b = (thue_morse(4096, *x) for x in ("ab", "ba"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, plain = token_output.Encoder(path), Tokenizer.from_file(path)
    for t in (a, b):
        assert e.encode(t.encode(), np.array([len(t)]))[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_output, "span_hash", lambda data, start, end: (end - start).astype(np.uint64))
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("one two six", "ten old men", "one"):
        assert e.encode(t.encode(), np.array([len(t)]))[0].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_what_an_encoder_remembers_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_output, "HELD", 1 << 14)
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    most = 0
    for k in range(40):
        texts = [text(60, 100 * k + i) + f" w{k}x{i}" + "y" * (500 if i == 3 else 0) for i in range(5)] + [""]
        raw = [t.encode() for t in texts]
        got, counts = e.encode(memoryview(b"".join(raw)), np.cumsum([len(r) for r in raw]))
        want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]
        most = max(most, e.held())
    assert most < 4 * (1 << 14)


def test_words_of_long_texts(monkeypatch):
    texts = [text(4000, 3).encode(), b"x" * 9000, b"", None, b"a " * 3000 + "é".encode()]
    want = common.hashed_words(texts)
    monkeypatch.setattr(common, "PIECE", 1000)
    found = common.hashed_words(texts)
    assert (found[0] == want[0]).all() and (found[1] == want[1]).all()
    assert all(b"".join(common.pieces(t, 1000)) == t for t in texts if t)
    assert [len(s) for s in jaccard_join.shingle_sets(texts, 5)] == [len({tuple(split(lower((t or b"").decode()))[i : i + 5]) for i in range(max(1, len(split((t or b"").decode())) - 4))}) if t else 0 for t in texts]


def test_span_hash_depends_on_the_bytes_alone():
    words = [b"x" * n for n in range(1, 150)] + [b"a", b"ab", b"abc" * 30, b"abc" * 29 + b"abd"]
    for lead in (b"", b"zz "):
        data = np.frombuffer(lead + b" ".join(words), np.uint8)
        start, end = common.word_spans(data)
        h = common.span_hash(data, start, end)[len(lead) // 3 :].tolist()
        assert len(set(h)) == len(words) and h == [common.span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]


def test_stages_of_others_stay(spark, docs):
    mine = docs.select("doc_id")
    with common.recorded() as outer:
        a = common.stage(mine, "kept")
        with common.recorded() as inner:
            b = common.stage(mine, "gone")
        common.delete(spark, inner)
        assert len(outer) == 2 and not inner and a.count() == docs.count()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        b.count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="share"):
        common.shared_folder(bare("spark://host:7077"))
    assert common.shared_folder(bare("local[2]")).startswith("file:")


def test_registered_queries_cover_the_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
