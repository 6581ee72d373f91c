"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, from document labels.

A sentence's score is the logistic function of a bias and the weights of its distinct words and of
their beginnings; a document is toxic if
any sentence is: 1 - prod(1 - p).  Weights are trained, by gradient descent on the labels'
likelihood, on a bounded sample of labelled rows (``SAMPLE`` rows, those with the smallest hash of
their id): executors split its texts and count, and the driver gets counts and numbers of telling
words alone.  Scoring then reads every whole text where it lies and names the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, write_table

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8_000
#: A sentence of at least this score is named.
OFFENDING = 0.3
#: How far above the expected extreme of chance a word's likelihood ratio must be.
MARGIN = 4.0
PREFIXES = (4, 5, 6, 7)
EPOCHS, RATE, PENALTY = 150, 0.15, 1e-4
#: Toxic texts that must hold a word for it to carry weight.
LEAST = 3
_SENTENCE = r"[^.!?\n]+"
_WORD = r"[^\W_]+"


@dataclass
class Model:
    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)


def _features(words) -> set[str]:
    """Words and, for inflected and compound forms, their beginnings."""
    return {x for w in words for x in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n))}


def _sentences(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [set(words) for x in re.findall(_SENTENCE, (text or "").lower()) if (words := re.findall(_WORD, x))]


def _limit(candidates: int) -> float:
    """What a likelihood ratio must reach: of so many candidates some go with the label by chance, so one must do
    so beyond what the most extreme of them would (Bonferroni)."""
    return 2 * math.log(candidates + 1) + MARGIN


def _ratio(n: float, k: float, share: float) -> float:
    """Likelihood ratio of ``k`` toxic among ``n`` texts where ``share`` are."""
    part = lambda a, e: a * math.log(a / e) if a else 0.0
    return 2 * (part(k, n * share) + part(n - k, n * (1 - share)))


def _plain(positive: int, n: int) -> Model:
    """The model where labels can't be told apart, or nothing tells."""
    if not 0 < positive < n:
        return Model(bias=float(np.log(1e-6)) if not positive else 0.0)
    base = (positive + 0.5) / (n + 1)
    return Model(bias=float(np.log(base / (1 - base))))


def _descend(features: list[str], texts: list[tuple[int, int, list[int], list[int]]], positive: int, epochs: int, rate: float, penalty: float) -> Model:
    """Weights by gradient descent (Adam).  A text: label, sentences without features, and the others' sizes
    and feature numbers, one after another."""
    texts = [t for t in texts if t[1] or t[2]]
    y = np.array([t[0] for t in texts])
    blank = np.array([t[1] for t in texts], float)
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.asarray(t[2], np.int64) for t in texts)])
    word = np.concatenate([np.zeros(0, np.int64), *(np.asarray(t[3], np.int64) for t in texts)])
    doc = np.repeat(np.arange(len(texts)), [len(t[2]) for t in texts])
    sentence, n = np.repeat(np.arange(len(sizes)), sizes), blank.sum() + len(sizes)
    w, b = np.zeros(len(features)), -np.log(n / max(1, positive))
    first_w, second_w, first_b, second_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, w[word], len(sizes)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-np.clip(b, -30, 30)))  # of a sentence without features
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + blank * np.log1p(-min(p0, 1 - 1e-9)))
        odds = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)
        pull = p * odds[doc]
        g_w = np.bincount(word, pull[sentence], len(w)) / len(y) - penalty * w
        g_b = (pull.sum() + (blank * p0 * odds).sum()) / len(y)
        first_w, second_w = 0.9 * first_w + 0.1 * g_w, 0.99 * second_w + 0.01 * g_w**2
        first_b, second_b = 0.9 * first_b + 0.1 * g_b, 0.99 * second_b + 0.01 * g_b**2
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w = w + rate * (first_w / a) / (np.sqrt(second_w / c) + 1e-6)
        b = b + rate * (first_b / a) / (np.sqrt(second_b / c) + 1e-6)
    return Model(float(b), {k: float(w[i]) for i, k in enumerate(features) if abs(w[i]) > 1e-3})


def _numbered(spans: list[set[str]], number: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(sentences without features, sizes of the others, their feature numbers)."""
    found = [[number[x] for w in sorted(words) for x in sorted(_features((w,))) if x in number] for words in spans]
    return sum(not x for x in found), [len(x) for x in found if x], [i for x in found for i in x]


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, least: int = LEAST) -> Model:
    """A model of (text, label) rows in memory; words in fewer than ``least`` toxic texts carry no weight."""
    rows = [(_sentences(t), int(y)) for t, y in rows if y is not None]
    positive = sum(y for _, y in rows)
    if not 0 < positive < len(rows):
        return _plain(positive, len(rows))
    seen, toxic = Counter(), Counter()
    for spans, label in rows:
        features = _features(set().union(*spans))
        seen.update(features)
        toxic.update(features if label else ())
    toxic, share = {x: k for x, k in toxic.items() if k >= least}, positive / len(rows)
    features = sorted(x for x, k in toxic.items() if k > seen[x] * share and _ratio(seen[x], k, share) >= _limit(len(toxic)))
    if not features:
        return _plain(positive, len(rows))
    number = {x: i for i, x in enumerate(features)}
    return _descend(features, [(label, *_numbered(spans, number)) for spans, label in rows], positive, epochs, rate, penalty)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, least: int = LEAST) -> Model:
    """:func:`fit` on at most ``sample`` rows of ``labels`` (doc_id, toxic) with their texts, distributed; of several
    labels of a document the largest holds, of several texts the first.  Other columns are not looked at."""
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "y")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["id"]).groupBy("id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y"))
    rows = write_table(rows.select("y", "text"), "toxicity-sample")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return _plain(positive, n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                features = sorted(_features(set().union(*_sentences(text.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array([y] * len(features), pa.int32())], names=["feature", "y"])

    counts = rows.mapInArrow(tidy(each), "feature string, y int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    counts = write_table(counts.where(F.col("k") >= least), "toxicity-counts")
    share, k, m = positive / n, F.col("k"), F.col("n")
    part = lambda a, e: F.when(a > 0, a * F.ln(a / e)).otherwise(0.0)
    ratio = 2 * (part(k, m * share) + part(m - k, m * (1 - share)))
    telling = counts.where((k > m * share) & (ratio >= _limit(counts.count()))).select("feature")
    features = sorted(r[0] for r in telling.collect())
    if not features:
        return _plain(positive, n)
    number = {x: i for i, x in enumerate(features)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            out = [(y, *_numbered(_sentences(text.as_py()), number)) for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), kind, kind), strict=True)], names=["y", "blank", "sizes", "words"])

    found = rows.mapInArrow(tidy(numbers), "y int, blank int, sizes array<int>, words array<int>").toArrow()
    texts = list(zip(*(found.column(i).to_pylist() for i in range(4)), strict=True))
    return _descend(features, texts, positive, epochs, rate, penalty)


def score(docs: DataFrame, model: Model, offending: float = OFFENDING) -> DataFrame:
    """(doc_id, score, offending): a row for each row of ``docs``; offending sentences as
    array<struct<start,end,score>> in code points, worst first.  A text without words scores as the
    model's bias alone."""
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentence, word, prefixes = re.compile(_SENTENCE), re.compile(_WORD).findall, PREFIXES

        class Weight(dict):
            def __missing__(self, w):
                if len(self) > 300_000:
                    self.clear()
                out = self[w] = weights.get(w, 0.0) + sum(weights.get(f"{w[:n]}*", 0.0) for n in prefixes if len(w) > n)
                return out

        get = Weight().__getitem__
        squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        named = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            ids, scores, spans = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                clean, found, any_ = 0.0, [], False
                for m in sentence.finditer(text.as_py() or ""):
                    words = set(word(m[0].lower()))
                    if not words:
                        continue
                    any_ = True
                    p = squash(bias + sum(map(get, words)))
                    clean += math.log1p(-min(p, 1 - 1e-9))
                    if p >= offending:
                        found.append((m.start(), m.end(), p))
                ids.append(doc_id)
                scores.append(-math.expm1(clean) if any_ else squash(bias))
                spans.append([dict(zip(("start", "end", "score"), x, strict=True)) for x in sorted(found, key=lambda x: (-x[2], x[0]))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, named)], names=["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, score double, offending array<struct<start:int,end:int,score:double>>")
