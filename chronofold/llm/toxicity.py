"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled rows gives the vocabulary (terms that lean towards the label), its document
frequencies and the example vectors. A text's nearest examples are found exactly: blocks of examples are visited
by the upper bound that their largest weights allow, until no block can hold a nearer one. Distance-weighted votes
are calibrated by isotonic regression on votes that leave each example itself out; evidence names the examples.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER

#: Labelled rows that the fit uses at most, of each label, by hash of doc_id.
MAX_PER_LABEL = 4000
#: The vectors hold the VOCABULARY terms that lean most towards label 1: the cosine is over those, not over all words.
#: README has held-out figures of this against all words.
NEIGHBOURS, BLOCK, VOCABULARY = 15, 64, 512
THRESHOLD = 0.3
#: Labelled rows whose words are so similar to those of another row of their label are copies of it.
COPY = 0.8
NOT_WORD_BYTE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(LOWER).translate(NOT_WORD_BYTE).split()


def terms_of(raw: bytes | None) -> Counter:
    """Words (lower-cased; ASCII letters, digits and all beyond ASCII) and their first four and five letters."""
    out = Counter()
    for w, n in Counter(words_of(raw)).items():
        out[w] += n
        if len(w) > 5:
            text = w.decode("utf-8", "ignore")
            for k in (4, 5):
                if len(text) > k:
                    out[b"^" + text[:k].encode()] += n
    return out


def distinct_examples(rows: list[tuple[int, bytes, int]]) -> list[tuple[int, bytes, int]]:
    """The rows without copies: a row goes if its words are COPY or more similar (Jaccard, whole sets) to an earlier kept one of its label.

    Sets so similar share a word among the first few of both, rarest first; only those are looked up, and each match
    is then confirmed on the whole sets. Texts of under eight words always stay, texts without words go.
    """
    numbers: dict[bytes, int] = {}
    words = [np.array(sorted({numbers.setdefault(w, len(numbers)) for w in words_of(raw)}), np.int32) for _, raw, _ in rows]
    frequency = np.bincount(np.concatenate([np.zeros(0, np.int32), *words]), minlength=1)
    kept: dict[tuple[int, int], list[int]] = defaultdict(list)
    out = []
    for i, (own, row) in enumerate(zip(words, rows, strict=True)):
        n, label = len(own), row[2]
        if not n:
            continue
        if n >= 8:
            rare = own[np.lexsort((own, frequency[own]))][: n - math.ceil(COPY * n - 1e-9) + 1].tolist()
            near = {j for t in rare for j in kept.get((label, t), ()) if COPY * n - 1e-9 <= len(words[j]) <= n / COPY + 1e-9}
            if any((both := len(np.intersect1d(own, words[j], assume_unique=True))) >= COPY * (n + len(words[j]) - both) - 1e-9 for j in near):
                continue
            for t in rare:
                kept[label, t].append(i)
        out.append(row)
    return out


def counted(examples: list[tuple[int, bytes, int]]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """All terms, and for each example the numbers of its terms and how often they stand there: arrays, not one dict a text."""
    numbers: dict[bytes, int] = {}
    out = []
    for _, raw, _ in examples:
        terms = terms_of(raw)
        out.append((np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int32), np.array(list(terms.values()), np.int32)))
    return list(numbers), out


def leaning_terms(names: list[bytes], counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, least: int = 5) -> list[int]:
    """The numbers of the terms most associated with label 1 by chi-squared, among those of at least `least` positive examples."""
    none = np.zeros(0, np.int32)
    a, b = (np.bincount(np.concatenate([none, *[c[0] for c, y in zip(counts, labels, strict=True) if y == label]]), minlength=len(names)).astype(float) for label in (1, 0))
    p = max(1, int(labels.sum()))
    n = max(1, len(labels) - p)
    rate = (a + b) / (p + n)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (a - p * rate) ** 2 / (p * rate) + (b - n * rate) ** 2 / (n * rate)
    # ten is beyond the 0.1 % point of one degree of freedom
    good = np.flatnonzero((a >= least) & (a / p > 4 * b / n) & (rate < 1) & (score > 10)).tolist()
    return sorted(good, key=lambda t: (-score[t], names[t]))[:size]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step values of y over sorted x by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([x[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
            blocks[-1][0] = last[0]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Neighbours:
    """Example vectors with an inverted index in blocks; learn() fits it, score() searches it."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: postings[term]: {block: (places in the block, values)}
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    empty_score: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    @classmethod
    def learn(cls, rows: list[tuple[int, bytes, int]], rates: dict[int, int]) -> Neighbours:
        """rows: (key, text, label), a sample; rates: rows of each label before sampling, which weigh the votes."""
        examples = distinct_examples(rows)
        labels = np.array([y for *_, y in examples], np.int64)
        names, counts = counted(examples)
        chosen = leaning_terms(names, counts, labels, VOCABULARY)
        terms = [names[t] for t in chosen]
        place_of = np.full(len(names) + 1, -1, np.int64)
        place_of[chosen] = np.arange(len(chosen))
        own = [place_of[ids] for ids, _ in counts]
        self = cls()
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        drawn = Counter(labels.tolist())
        share = {y: rates[y] / drawn[y] for y in drawn}
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *[t[t >= 0] for t in own]]), minlength=len(terms))
        self.idf = np.array([math.log((1 + len(examples)) / (1 + n)) + 1 for n in df[: len(terms)]])
        bare: dict[int, float] = defaultdict(float)
        vectors, kept = [], []
        for (key, _, y), at, (_, n) in zip(examples, own, counts, strict=True):
            v = self.weighed(at[at >= 0], n[at >= 0])
            if v is None:
                bare[y] += share[y]
            else:
                vectors.append(v)
                kept.append((key, y, share[y]))
        total = sum(bare.values())
        everywhere = sum(rates.values()) or 1
        self.empty_score = (bare[1] + rates.get(1, 0) / everywhere) / (total + 1)
        order = sorted(range(len(kept)), key=lambda i: (vectors[i][0][0], len(vectors[i][0]), kept[i][0]))  # like examples share blocks
        self.keys = np.array([kept[i][0] for i in order], np.int64)
        self.labels = np.array([kept[i][1] for i in order], float)
        self.weights = np.array([kept[i][2] for i in order], float)
        n_blocks = -(-len(order) // BLOCK)
        self.block_max = np.zeros((len(terms), n_blocks))
        lists: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in terms]
        for place, i in enumerate(order):
            for t, x in zip(*vectors[i], strict=True):
                lists[t][place // BLOCK].append((place % BLOCK, x))
                self.block_max[t, place // BLOCK] = max(self.block_max[t, place // BLOCK], x)
        self.postings = [{b: (np.array([p for p, _ in e]), np.array([x for _, x in e])) for b, e in d.items()} for d in lists]
        votes = np.array([self.vote(vectors[i], own=place)[0] for place, i in enumerate(order)])
        if len(votes):
            self.steps = isotonic(votes, self.labels, self.weights)
        return self

    def weighed(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(term numbers ascending, weights) of unit length; None without terms."""
        if not len(ids):
            return None
        order = np.argsort(ids)
        ids = ids[order]
        w = (1 + np.log(counts[order])) * self.idf[ids]
        return ids, w / np.linalg.norm(w)

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray] | None:
        """(term numbers, weights) of unit length; None if the text has no term of the vocabulary."""
        known = self.vocabulary
        own = [(known[t], n) for t, n in counts.items() if t in known] if len(counts) <= len(known) else [(i, counts[t]) for t, i in known.items() if t in counts]
        return self.weighed(np.array([i for i, _ in own], np.int64), np.array([n for _, n in own], np.int64))

    def nearest(self, v: tuple[np.ndarray, np.ndarray], k: int, own: int = -1) -> list[tuple[float, int]]:
        """The k largest cosines above 0, exactly, with their examples' places; ties go to the lower place."""
        ids, w = v
        bounds = w @ self.block_max[ids]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < best[-1][0] - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for t, x in zip(ids.tolist(), w.tolist(), strict=True):
                if (entry := self.postings[t].get(b)) is not None:
                    scores[entry[0]] += x * entry[1]
            found = [(float(scores[p]), b * BLOCK + p) for p in np.flatnonzero(scores > 0).tolist() if b * BLOCK + p != own]
            best = sorted(best + found, key=lambda s: (-round(s[0], 12), s[1]))[:k]
        return best

    def vote(self, v: tuple[np.ndarray, np.ndarray], own: int = -1) -> tuple[float, list[tuple[float, int]]]:
        """Label 1's share of the neighbours' votes; a vote counts 1 / (0.05 + distance) and its sampling weight."""
        near = self.nearest(v, NEIGHBOURS, own)
        places = np.array([p for _, p in near], np.int64)
        votes = self.weights[places] / (0.05 + 1 - np.array([c for c, _ in near]))
        return (float(votes @ self.labels[places] / votes.sum()) if len(near) else self.empty_score), near

    def score(self, raw: bytes | None) -> tuple[float, list[int]]:
        """(calibrated score, doc_ids of the nearest examples, nearest first)."""
        v = self.vector(terms_of(raw))
        if v is None:
            return self.empty_score, []
        share, near = self.vote(v)
        x, y = self.steps
        # texts at one step share its value; a small part of the raw share keeps their order
        level = float(y[min(np.searchsorted(x, share), len(y) - 1)])
        return 0.98 * level + 0.02 * share, [int(self.keys[p]) for _, p in near]


def held_out_rule(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL) -> Neighbours:
    """Fit on at most per_label rows of each label, those with the smallest hashes, none of them held out.

    One task fits the model, so that the texts and their terms never reach the driver: it gets the finished model, whose
    size the sample and the vocabulary bound. Where rows share a labelled doc_id, the smallest text counts; null and
    empty texts, null ids and labels other than 0 and 1 are left out. Without examples every
    text scores label 1's share of the labelled rows, 0 if there are none.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out_rule(F.col("doc_id")), F.lit(True)))
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    rates = {0: 0, 1: 0} | {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    # bounded by 2 * per_label rows
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").filter(F.octet_length("text") > 0)
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(key.as_py(), raw.as_py(), y.as_py()) for batch in batches for key, raw, y in zip(*batch.columns, strict=True)]
        model = Neighbours.learn(sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0])), rates)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = sample.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else Neighbours.learn([], rates)


def score_toxicity(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, text) as doc_id, score in 0..1, evidence (doc_ids of nearest examples). Null and empty texts score as texts without terms do."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the vocabulary

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.score(raw.as_py()) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(judge, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A score for every document, null and empty texts included; the model learns from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    held = F.coalesce(held_out_rule(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))
