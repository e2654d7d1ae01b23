"""Language identification by interpolated Kneser-Ney character models.

Texts are lowered, and each run of other characters than letters and combining marks becomes one space. For each language the character
n-grams of a sample give Kneser-Ney estimates, interpolated down to single characters. The tables of all languages are
kept as sorted arrays of n-gram hashes beside a matrix of log-probabilities, so one search serves all languages. The
language of lowest cross-entropy a character is chosen; a choice is rejected, in a column of its own, when its entropy
is higher than that of nearly all of the language's training texts that a model for this purpose was not fitted on.

Defined cases: null texts and texts without a letter are "und" with score 0; repeated rows are predicted alike; ties go to
the first language in code point order; without training texts everything is "und"; an empty table gives an empty
result; other columns are not read; texts of any length are read whole. The model is fitted on a bounded sample: about
SAMPLED texts a language, those with the lowest key hashes, each whole; its tables are bounded by the sample's characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import mix

ORDER = 4
DISCOUNT = 0.75
SAMPLED = 400
#: Share of a language's training texts whose entropy lies under the bound of rejection.
ACCEPTED = 0.995
#: Characters that are looked up together.
SLICE = 1 << 19
#: Training texts of a language that bounds of rejection are set on, one in so many; the model for that leaves them out.
LEFT_OUT = 5
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def normal(text: str) -> str:
    """Letters (Unicode category L) in lower case with their combining marks, everything else as single spaces, with one space
    before and after; nothing between these where there is no letter."""
    if not _LETTER.search(text):
        return "  "
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n - 1 on."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)]
        return mix(h)


@dataclass
class Model:
    languages: list[str]
    #: One sorted array of n-gram hashes an order, from ORDER down to 1, and log-probabilities a language beside it.
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    #: Sorted context hashes an order, and the log of the weight that goes to the shorter n-gram.
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    unseen: float
    bounds: np.ndarray

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each character from the second on, by language, given those before it."""
        n = len(codes) - 1
        out = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n)
        for k, order in enumerate(range(ORDER, 0, -1)):
            if not len(todo):
                break
            ready = todo[todo + 1 >= order - 1]
            early = todo[todo + 1 < order - 1]
            grams = _grams(codes, order)[ready + 2 - order]
            at = np.minimum(np.searchsorted(self.keys[k], grams), max(len(self.keys[k]) - 1, 0))
            hit = self.keys[k][at] == grams if len(self.keys[k]) else np.zeros(len(grams), bool)
            out[ready[hit]] += self.logs[k][at[hit]]
            missed = ready[~hit]
            if order > 1 and len(missed):
                before = _grams(codes[:-1], order - 1)[missed + 2 - order]
                at = np.minimum(np.searchsorted(self.contexts[k], before), max(len(self.contexts[k]) - 1, 0))
                known = self.contexts[k][at] == before if len(self.contexts[k]) else np.zeros(len(before), bool)
                out[missed[known]] += self.backs[k][at[known]]
            todo = np.concatenate([early, missed])
        out[todo] += self.unseen
        return out


def fit(rows: list[tuple[str, list[str]]]) -> Model:
    """The models of (language, texts). Bounds of rejection are set on texts that a second fit leaves out."""
    rows = sorted(rows)
    model = _fitted(rows)
    kept = [(lang, [t for i, t in enumerate(texts) if i % LEFT_OUT or len(texts) < LEFT_OUT]) for lang, texts in rows]
    judge = _fitted(kept)
    for i, (_, texts) in enumerate(rows):
        cost = entropies(judge, [normal(t) for t in texts[::LEFT_OUT]])[:, i]
        model.bounds[i] = np.quantile(cost, ACCEPTED) if len(cost) else np.inf
    return model


def _fitted(rows: list[tuple[str, list[str]]]) -> Model:
    names = [lang for lang, _ in rows]
    tables = []
    for _, texts in rows:
        codes = [_codes(normal(t)) for t in texts]
        grams = {}
        for n in range(1, ORDER + 1):
            h = [_grams(c, n) for c in codes]
            ctx = [_grams(c, n - 1)[: len(g)] if n > 1 else np.zeros(len(g), np.uint64) for c, g in zip(codes, h, strict=True)]
            low = [_grams(c[1:], n - 1)[: len(g)] if n > 1 else np.zeros(len(g), np.uint64) for c, g in zip(codes, h, strict=True)]
            h, ctx, low = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (h, ctx, low))
            key, first, count = np.unique(h, return_index=True, return_counts=True)
            grams[n] = [key, count.astype(float), ctx[first], low[first]]
        for n in range(ORDER - 1, 0, -1):  # shorter n-grams count the characters before them, not their places
            key, _, ctx, low = grams[n]
            kinds, times = np.unique(grams[n + 1][3], return_counts=True)
            at = np.minimum(np.searchsorted(kinds, key), max(len(kinds) - 1, 0))
            grams[n][1] = np.where(kinds[at] == key, times[at], 1.0) if len(kinds) else np.ones(len(key))
        tables.append(grams)
    letters = len(np.unique(np.concatenate([t[1][0] for t in tables]))) + 1 if tables else 1
    prob: list[dict] = []
    for grams in tables:
        own = {}
        for n in range(1, ORDER + 1):
            key, count, ctx, low = grams[n]
            seen, which, kinds = np.unique(ctx, return_inverse=True, return_counts=True)
            total = np.bincount(which, count, len(seen))
            weight = DISCOUNT * kinds / np.maximum(total, 1)
            if n == 1:
                shorter = np.full(len(key), 1.0 / letters)
            else:
                lows = own[n - 1]
                at = np.searchsorted(lows[0], low)
                shorter = lows[1][np.minimum(at, len(lows[0]) - 1)] if len(lows[0]) else np.zeros(0)
            own[n] = (key, np.maximum(count - DISCOUNT, 0) / np.maximum(total[which], 1) + weight[which] * shorter, seen, weight)
        prob.append(own)
    keys, logs, contexts, backs = [], [], [], []
    floor = np.log(DISCOUNT / letters / 100)
    for n in range(ORDER, 0, -1):
        keys.append(np.unique(np.concatenate([p[n][0] for p in prob])) if prob else np.zeros(0, np.uint64))
        contexts.append(np.unique(np.concatenate([p[n][2] for p in prob])) if prob else np.zeros(0, np.uint64))
        log, back = np.full((len(keys[-1]), len(names)), np.nan, np.float32), np.zeros((len(contexts[-1]), len(names)), np.float32)
        for i, p in enumerate(prob):
            log[np.searchsorted(keys[-1], p[n][0]), i] = np.log(p[n][1])
            back[np.searchsorted(contexts[-1], p[n][2]), i] = np.log(p[n][3])
        logs.append(log)
        backs.append(back)
    model = Model(names, keys, logs, contexts, backs, float(floor), np.zeros(len(names)))
    _fill(model, rows)
    return model


def _fill(model: Model, rows: list[tuple[str, list[str]]]) -> None:
    """Where a language lacks an n-gram that another has, put the backed-off estimate that it would get."""
    seen = {}
    for _, texts in rows:
        for t in texts:
            c = _codes(normal(t))
            for n in range(1, ORDER + 1):
                g = _grams(c, n)
                ctx = _grams(c, n - 1)[: len(g)] if n > 1 else np.zeros(len(g), np.uint64)
                low = _grams(c[1:], n - 1)[: len(g)] if n > 1 else np.zeros(len(g), np.uint64)
                key, first = np.unique(g, return_index=True)
                seen.setdefault(n, []).append(np.stack([key, ctx[first], low[first]]))
    for n in range(1, ORDER + 1):
        k = ORDER - n
        if n not in seen:
            continue
        rows_ = np.concatenate(seen[n], axis=1)
        key, first = np.unique(rows_[0], return_index=True)
        log = model.logs[k]
        if n == 1:
            log[np.isnan(log)] = model.unseen
            continue
        low = np.searchsorted(model.keys[k + 1], rows_[2][first])
        at = np.searchsorted(model.contexts[k], rows_[1][first])
        other = model.logs[k + 1][low] + model.backs[k][at]
        log[:] = np.where(np.isnan(log), other, log)


def entropies(model: Model, texts: list[str]) -> np.ndarray:
    """Cross-entropy in nats a character of normalised texts, by language."""
    out = np.zeros((len(texts), len(model.languages)))
    size = np.array([max(len(t) - 1, 1) for t in texts], float)
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= SLICE):
            n += len(texts[to])
            to += 1
        if to - at == 1:
            codes = _codes(texts[at])
            for begin in range(0, len(codes) - 1, SLICE):  # pieces overlap by what the next character depends on
                lead = min(begin, ORDER)
                out[at] -= model.costs(codes[begin - lead : begin + SLICE + 1])[lead:].sum(axis=0, dtype=float)
        else:
            whole = _codes("".join(texts[at:to]))
            ends = np.cumsum([len(t) for t in texts[at:to]])
            cost = model.costs(whole)
            cost[ends[:-1] - 1] = 0  # the space that begins a text
            sums = np.add.reduceat(cost, np.concatenate([[0], ends[:-1]]), axis=0, dtype=float)
            out[at:to] = -sums
        at = to
    return out / size[:, None]


def sample_texts(df: DataFrame, trained: Column, key: str, text: str, lang: str) -> list[tuple[str, list[str]]]:
    """About SAMPLED training texts of each language. A language's share is set from its count, and texts are chosen by
    a hash of their key and text."""
    rows = df.where(trained & F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("_u", F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) / (1 << 30))
    count = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in count.items():
        share = F.when(F.col(lang) == name, min(1.0, SAMPLED / n)).otherwise(share)
    out: dict[str, list[str]] = {name: [] for name in count}
    for r in rows.where(F.col("_u") <= share).select(lang, text).orderBy(lang, "_u").toLocalIterator():
        out[r[lang]].append(r[text])
    return list(out.items())


def identify(df: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """df's rows with key, lang_pred, score (0 to 1: how far the choice is from the next language), entropy and rejected.
    Languages are learned from the rows for which `trained` holds."""
    return predict(df, fit(sample_texts(df, trained, key, text, lang)), key, text)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Predictions of a fitted model."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = [normal(t or "") for t in batch.column("_text").to_pylist()]
            named = [len(t) > 2 and len(held.languages) > 0 for t in texts]
            lang, score, entropy, rejected = [], [], [], []
            cost = entropies(held, texts) if held.languages else np.zeros((len(texts), 0))
            for ok, c, t in zip(named, cost, texts, strict=True):
                if not ok:
                    lang.append("und")
                    score.append(0.0)
                    entropy.append(None)
                    rejected.append(True)
                    continue
                i = int(np.argmin(c))
                chance = np.exp(np.maximum((c[i] - c) * min(len(t), 200), -700))
                lang.append(held.languages[i])
                score.append(float(1 / chance.sum()))
                entropy.append(float(c[i]))
                rejected.append(bool(c[i] > held.bounds[i]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(lang), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], names=[key, "lang_pred", "score", "entropy", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(predicted, f"{key} {kind}, lang_pred string, score double, entropy double, rejected boolean")
