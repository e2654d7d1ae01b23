"""Toxicity: nearest labelled examples by exact cosine of TF-IDF vectors, found with a block-max inverted index.

Vectors hold every word of a text that some example has. A word weighs (1 + log count) * idf * phi, where idf comes from
all documents and phi is the correlation of the word's presence with the label among the examples: without it, cosines
find texts of like subject, not of like label. No word is left out by it.

Examples stand in blocks; for each word the largest weight in each block with it is kept. A text's words are taken from the
one that can add most on; when the rest cannot lift an example without any of them to the k-th best sum so far, only blocks
whose bounds on the rest still can are opened, which leaves the result exact.
The nearest examples vote with a weight that falls with distance; a logistic curve, fitted on the examples without their
own votes, turns votes into probabilities. The nearest examples are returned as evidence.

Defined cases: null and empty texts, and texts without any word of an example, get the score of a vote at the rate of toxic
labels; repeated rows are scored alike; ties of cosine go to the earlier example; several labels of one key count as toxic
if one is; several texts of one labelled key give one example; without labels of both kinds the score is the rate of toxic
labels (0 where there are none); an empty table gives an empty result; other columns are not read; texts are read whole.

Examples are a sample, chosen by key hash, of about EXAMPLES toxic and EXAMPLES other labelled rows whose texts have at
most LONGEST bytes: the classifier's documented bound, and its index's. Everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.llm.common import IS_PUNCTUATION, hashed_words, stage

EXAMPLES = 1500
LONGEST = 1 << 20
NEAREST = 15
#: Examples of a block, and postings that are taken before there is a threshold.
IN_BLOCK, FIRST = 32, 512

Vector = tuple[np.ndarray, np.ndarray]


def term_counts(texts: list[bytes | None]) -> list[Vector]:
    """(term hashes, counts) of each text."""
    words, counts = hashed_words(texts, IS_PUNCTUATION)
    return [np.unique(w, return_counts=True) for w in np.split(words, np.cumsum(counts)[:-1])] if len(texts) else []


def label_correlation(found: list[Vector], toxic: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Absolute phi coefficient, 0 to 1, of each term's presence and the label."""
    at = np.searchsorted(terms, np.concatenate([h for h, _ in found])) if found else np.zeros(0, np.int64)
    which = np.repeat(toxic, [len(h) for h, _ in found])
    a, b = np.bincount(at, which == 1, len(terms)), np.bincount(at, which == 0, len(terms))
    n1, n0 = float((toxic == 1).sum()), float((toxic == 0).sum())
    spread = (a + b) * (n1 + n0 - a - b) * n1 * n0
    return np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.maximum(spread, 1e-9))


@dataclass
class Index:
    """Examples over their terms. A cell is a term in a block; cells stand in order of term and block, and postings in order
    of cell and example."""

    terms: np.ndarray
    weights: np.ndarray
    keys: list
    toxic: np.ndarray
    share: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)
    vectors: list[Vector] = field(default_factory=list)
    blocks: int = 0
    #: By term, where its cells begin and its largest weight; by cell, its block, largest weight and where its postings begin.
    cells: np.ndarray | None = None
    cell_block: np.ndarray | None = None
    most: np.ndarray | None = None
    top: np.ndarray | None = None
    starts: np.ndarray | None = None
    examples: np.ndarray | None = None
    values: np.ndarray | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> Vector:
        """(places of terms, weights) of a text, of length 1."""
        value = (1 + np.log(counts)) * self.weights[terms]
        return terms, value / max(float(np.sqrt((value * value).sum())), 1e-12)

    def build(self, found: list[Vector]) -> None:
        """Put the examples in: those with the same strongest term stand together, which keeps block bounds tight."""
        vectors = [self.vector(*f) for f in found]
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, str(self.keys[i])))
        self.keys = [self.keys[i] for i in order]
        self.toxic, self.share = self.toxic[order], self.share[order]
        self.vectors = [vectors[i] for i in order]
        self.blocks = max(1, -(-len(order) // IN_BLOCK))
        example = np.repeat(np.arange(len(order)), [len(t) for t, _ in self.vectors]) if order else np.zeros(0, np.int64)
        term = np.concatenate([t for t, _ in self.vectors]) if order else np.zeros(0, np.int64)
        value = np.concatenate([v for _, v in self.vectors]) if order else np.zeros(0)
        by = np.lexsort((example, term))
        self.examples, self.values = example[by].astype(np.int32), value[by]
        cell, first = np.unique(term[by] * self.blocks + self.examples // IN_BLOCK, return_index=True)
        self.starts = np.append(first, len(by))
        self.most = np.maximum.reduceat(self.values, first) if len(first) else np.zeros(0)
        self.top = np.zeros(len(self.terms))
        np.maximum.at(self.top, term, value)
        self.cell_block = (cell % self.blocks).astype(np.int32)
        self.cells = np.searchsorted(cell, np.arange(len(self.terms) + 1) * self.blocks)

    def _add(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray, weights: np.ndarray) -> None:
        """Add weights times the postings from first to last to the sums of their examples."""
        at = _ranges(first, last)
        sums += np.bincount(self.examples.take(at), np.repeat(weights, last - first) * self.values.take(at), len(sums))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the NEAREST examples of positive cosine, best first.

        Terms are taken by how much they can add at most. Sums so far are lower bounds, so the k-th best of them is a threshold;
        once all further terms together cannot reach it, an example without any term so far is none of the best. Of the
        others, only blocks in which some sum and the block's bounds on the further terms reach the threshold are opened."""
        most = weights * self.top[terms]
        order = np.argsort(-most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        first, last = self.starts[self.cells[terms]], self.starts[self.cells[terms + 1]]
        further = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        sums = np.zeros(len(self.keys))
        done, upto = 0, int(np.searchsorted(np.cumsum(last - first), FIRST)) + 1
        while done < len(terms):
            self._add(sums, first[done:upto], last[done:upto], weights[done:upto])
            done = min(upto, len(terms))
            if without >= 0:
                sums[without] = 0
            least = np.partition(sums, len(sums) - NEAREST)[len(sums) - NEAREST] - 1e-12 if len(sums) > NEAREST else -1.0
            enough = np.flatnonzero(further[done:] < least)
            upto = done + int(enough[0]) if len(enough) else len(terms)
            if upto == done:
                break
        opened = sums > 0
        if done < len(terms):
            cells = _ranges(self.cells[terms[done:]], self.cells[terms[done:] + 1])
            by = np.repeat(weights[done:], self.cells[terms[done:] + 1] - self.cells[terms[done:]])
            bound = np.bincount(self.cell_block[cells], by * self.most[cells], self.blocks)
            reach = opened & (sums + bound[np.arange(len(sums)) // IN_BLOCK] >= least)
            blocks = np.zeros(self.blocks, bool)
            blocks[np.flatnonzero(reach) // IN_BLOCK] = True
            mine = blocks[self.cell_block[cells]]
            self._add(sums, self.starts[cells[mine]], self.starts[cells[mine] + 1], by[mine])
            opened = reach
            if without >= 0:
                sums[without] = 0
        who = np.flatnonzero(opened & (sums > 0))
        best = np.minimum(sums[who], 1.0)
        keep = np.lexsort((who, -np.round(best, 12)))[:NEAREST]
        return who[keep], best[keep]

    @cached_property
    def mean_share(self) -> float:
        return float(self.share.mean())

    @cached_property
    def rate(self) -> float:
        """Share of toxic labels among all labelled rows."""
        return float((self.share * self.toxic).sum() / max(self.share.sum(), 1e-9))

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes: an example votes by its part of all labelled rows, more the nearer it is. A vote of
        little weight for the overall rate is added, so that far examples alone decide nothing."""
        if not len(self.share):
            return 0.0
        each = self.share[who] * cosine / (1.05 - cosine)
        prior = 0.05 * self.mean_share
        return float(((each * self.toxic[who]).sum() + prior * self.rate) / (each.sum() + prior))

    def score(self, vote: float) -> float:
        """The probability that belongs to a vote."""
        if not 0 < self.rate < 1:
            return self.rate
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _logit(vote), -30, 30))))

    def calibrate(self) -> None:
        """Fit the curve on the examples, each without its own vote."""
        if not 0 < self.rate < 1:
            return
        x = _logit(np.array([self.vote(*self.nearest(t, v, i)) for i, (t, v) in enumerate(self.vectors)]))
        y, w = self.toxic.astype(float), self.share
        rows, theta = np.stack([np.ones(len(x)), x], 1), np.array([0.0, 1.0])

        def loss(theta: np.ndarray) -> float:
            z = rows @ theta
            return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.025 * ((theta - [0, 1]) ** 2).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
            grad = rows.T @ (w * (y - p)) - 0.05 * (theta - [0, 1])
            step = np.linalg.solve((rows * (w * p * (1 - p))[:, None]).T @ rows + 0.05 * np.eye(2), grad)
            while loss(theta + step) > loss(theta) and np.abs(step).max() > 1e-9:
                step = step / 2
            theta = theta + step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (float(theta[0]), float(max(theta[1], 1e-3)))


def _logit(vote: np.ndarray | float) -> np.ndarray:
    held = np.clip(vote, 1e-4, 1 - 1e-4)
    return np.log(held / (1 - held))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers from first to last - 1 of each range after the other."""
    size = last - first
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _sampled(marks: DataFrame, most: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """About `most` marks of each kind, by key hash, and how many there are of each."""
    count = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in count.items():
        share = F.when(F.col("_toxic") == kind, min(1.0, most / n)).otherwise(share)
    return marks.where(F.pmod(F.xxhash64("_own"), F.lit(1 << 30)) / (1 << 30) <= share), count


def find_examples(df: DataFrame, marks: DataFrame, key: str, text: str) -> tuple[list, np.ndarray, np.ndarray, list[Vector]]:
    """(keys, labels, shares, term counts) of the examples, in order of the key. The sample is drawn from the labels, so few
    texts move, and of a key with several texts that of the smallest hash is taken."""
    chosen, count = _sampled(marks)
    fits = F.octet_length(text) <= LONGEST
    rows = df.where(fits).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_own"))
    rows = rows.select("_key", "_toxic", "_text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = term_counts(batch.column("_text").cast(pa.binary()).to_pylist())
            lists = [pa.array([v.astype(np.int64) if k else v.view(np.int64) for v in held], pa.list_(pa.int64())) for k, held in enumerate(zip(*found, strict=True))]
            hashed = pa.array([int(h.view(np.int64)[0]) if len(h) else 0 for h, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_toxic"), hashed, *lists], names=["_key", "_toxic", "_first", "terms", "counts"])

    kind = df.schema[key].dataType.simpleString()
    made = rows.mapInArrow(counted, f"_key {kind}, _toxic int, _first long, terms array<long>, counts array<long>")
    one = F.min(F.struct("_first", "terms", "counts", "_toxic")).alias("one")
    held = made.groupBy("_key").agg(one).orderBy("_key").collect()
    toxic = np.array([r["one"]["_toxic"] for r in held], np.int64)
    part = {kind: n / max(int((toxic == kind).sum()), 1) for kind, n in count.items()}
    found = [(np.array(r["one"]["terms"], np.int64).view(np.uint64), np.array(r["one"]["counts"], np.int64)) for r in held]
    return [r["_key"] for r in held], toxic, np.array([part[t] for t in toxic.tolist()], float), found


def _known(texts: list[bytes | None], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, count), in order, of the terms that texts hold."""
    words, counts = hashed_words(texts, IS_PUNCTUATION)
    if not len(terms) or not len(words):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    own = terms[at] == words
    both, times = np.unique(np.repeat(np.arange(len(texts)), counts)[own] * len(terms) + at[own], return_counts=True)
    return both // len(terms), both % len(terms), times


def document_frequency(df: DataFrame, terms: np.ndarray, text: str) -> tuple[int, np.ndarray]:
    """(rows of df, rows with each term). Each task adds up its own rows first."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = shared.value, 0
        n = np.zeros(len(held), np.int64)
        for batch in batches:
            rows += len(batch)
            n += np.bincount(_known(batch.column("_text").cast(pa.binary()).to_pylist(), held)[1], minlength=len(held))
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n[found], rows))], names=["term", "n"])

    sums = df.select(F.col(text).alias("_text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    often = np.zeros(len(terms), np.int64)
    often[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), often


def fit(df: DataFrame, labels: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """The index of examples from labelled rows for which `trained` holds."""
    known = labels.where(trained & F.col(label).isNotNull())
    marks = stage(known.groupBy(F.col(key).alias("_own")).agg(F.max(label).cast("int").alias("_toxic")), "labels")
    keys, toxic, share, found = find_examples(df, marks, key, text)
    terms = np.unique(np.concatenate([h for h, _ in found])) if found else np.zeros(0, np.uint64)
    rows, often = document_frequency(df, terms, text)
    idf = np.log((1 + rows) / (1 + often)) + 1
    index = Index(terms, idf * label_correlation(found, toxic, terms), keys, toxic, share)
    index.build([(np.searchsorted(terms, h), n) for h, n in found])
    index.calibrate()
    return index


def score_texts(df: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), predicted (1 from 0.5 on) and evidence (nearest examples: key, cosine, toxic) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            row, term, times = _known(batch.column("_text").cast(pa.binary()).to_pylist(), held.terms)
            ends = np.searchsorted(row, np.arange(len(batch) + 1))
            score, near = np.zeros(len(batch)), []
            for d in range(len(batch)):
                own = slice(ends[d], ends[d + 1])
                near.append(held.nearest(*held.vector(term[own], times[own])) if held.keys else (term[:0], np.zeros(0)))
                score[d] = held.score(held.vote(*near[d]))
            who, cosine = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (term[:0], np.zeros(0))
            names = pa.array([str(k) for k in held.keys], pa.string()).take(pa.array(who.astype(np.int64)))
            of = pa.StructArray.from_arrays([names, pa.array(cosine, pa.float64()), pa.array(held.toxic[who].astype(np.int32))], ["key", "cosine", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(w) for w, _ in near)]).astype(np.int32)), of)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), evidence], names=[key, "score", "predicted", "evidence"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(scored, f"{key} {kind}, score double, predicted int, evidence array<struct<key: string, cosine: double, toxic: int>>")
