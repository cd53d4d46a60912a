"""Toxic spans by a linear-chain conditional random field.

Labels are given per document, so tokens are labelled first: a feature (a word, or its
first letters) that occurs in several toxic documents of the training rows and almost
only there marks its tokens in toxic documents as toxic; all other tokens are clean.
On these labelled tokens a two-state chain is trained: state scores from the features
of the token and its neighbours, and transition scores, by gradient steps on the exact
conditional likelihood. A chain covers every token that has a toxic feature within
RADIUS tokens; farther away nothing but the bias speaks, and the token is clean. Forward
and backward passes give each token's marginal. A
document's score is a logistic function, fitted on the training rows, of its largest
marginal and its expected number of toxic tokens; the offsets of tokens with a marginal
above one half are the offending spans.

The model is fitted on a bounded sample: at most SAMPLE labelled documents of each
label, those with the smallest hash of their id, with their whole texts; of several
texts under one id one is taken, so repeated rows do not add to the sample. Scoring
covers every row and whole texts. Only the text is looked at. Null or empty text: no tokens, the score of an empty document. Null ids
are not held out by any remainder and pass through; repeated rows are scored alike.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import Memo, bound_batches, ids_and_texts

THRESHOLD, SPAN_MARGINAL = 0.7, 0.5
SAMPLE = 2500
FOLDS, HELD_OUT = 3, 1
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.9
RADIUS = 8
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
BATCH_TOKENS = 1 << 20


def normal(word: str) -> str:
    return EDGES.sub("", word.lower())


def features_of(word: str) -> list[str]:
    """The word itself and its first letters, marked so that they differ from words."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


@dataclass
class Model:
    bias: float = 0.0
    weights: dict = field(default_factory=dict)  # of a token's own features
    around: float = 0.0  # for a neighbour with a toxic feature
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    document: tuple = (0.0, 0.0, 0.0)  # intercept, of the largest marginal's logit, of log(1 + expected count)


# --- the chain -----------------------------------------------------------------------------


def chains(own: np.ndarray, lengths: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens within ``radius`` of a feature in their document, and the lengths of the chains."""
    hot = np.flatnonzero(own)
    ends = np.cumsum(lengths)
    of = np.searchsorted(ends, hot, side="right")
    begin = np.maximum(hot - radius, (ends - lengths)[of])
    end = np.minimum(hot + radius + 1, ends[of])
    if not len(hot):
        return hot, hot
    joined = np.r_[False, (begin[1:] <= end[:-1]) & (of[1:] == of[:-1])]
    first = np.flatnonzero(~joined)
    begin, end = begin[first], end[np.r_[first[1:] - 1, len(hot) - 1]]
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def emissions(model: Model, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Score of the toxic state over the clean one, for chains laid end to end."""
    strong = (own > 0).astype(float)
    near = np.zeros_like(own)
    near[1:] += strong[:-1]
    near[:-1] += strong[1:]
    ends = np.cumsum(lengths)[:-1]
    near[ends] -= strong[ends - 1]  # neighbours in other chains do not count
    near[ends - 1] -= strong[ends]
    return model.bias + own + model.around * near


def marginals(model: Model, score: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and of each pair (previous, own state), by forward and backward passes.

    All chains advance together, longest first, so a step is a few array operations.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    t, n = model.transition, len(score)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than the step
    for k in range(steps):
        at = first[:alive[k]] + k
        if k == 0:
            a = np.tile(model.start, (len(at), 1))
        else:
            before = forward[at - 1]
            a = np.stack([np.logaddexp(before[:, 0] + t[0, y], before[:, 1] + t[1, y]) for y in (0, 1)], axis=1)
        a[:, 1] += score[at]
        forward[at] = a - np.logaddexp(a[:, 0], a[:, 1])[:, None]
    for k in range(steps - 2, -1, -1):
        at = first[:alive[k + 1]] + k
        after = backward[at + 1] + np.stack([np.zeros(len(at)), score[at + 1]], axis=1)
        b = np.stack([np.logaddexp(after[:, 0] + t[x, 0], after[:, 1] + t[x, 1]) for x in (0, 1)], axis=1)
        backward[at] = b - np.logaddexp(b[:, 0], b[:, 1])[:, None]
    both = forward + backward
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])), np.stack([forward, backward])


def pair_counts(model: Model, score: np.ndarray, lengths: np.ndarray, passes: np.ndarray) -> np.ndarray:
    """Expected transitions over all chains."""
    inside = np.ones(len(score), dtype=bool)
    inside[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inside)
    joint = passes[0][at - 1][:, :, None] + model.transition[None] + (
        passes[1][at] + np.stack([np.zeros(len(at)), score[at]], axis=1))[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


# --- training on a bounded sample ------------------------------------------------------------


def learn_features(documents: list[tuple[list[str], int]]) -> dict[str, float]:
    """Toxic features with the logarithm of their odds."""
    seen = {0: Counter(), 1: Counter()}
    totals = Counter(label for _, label in documents)
    for words, label in documents:
        seen[label].update(set(chain.from_iterable(map(features_of, set(words)))))
    out = {}
    for name, n in seen[1].items():
        with_it, without = n / max(1, totals[1]), seen[0][name] / max(1, totals[0])
        if n >= LEAST_DOCUMENTS and with_it / (with_it + without) >= LEAST_SHARE:
            out[name] = float(np.log((with_it + 1e-3) / (without + 1e-3)))
    return out


def train(sample: list[tuple[str, int]], rounds: int = 60) -> Model:
    # Equal words share one object, and so do their features: the sample has millions of tokens.
    cleaned: dict[str, str] = {}
    documents = [([cleaned.get(w) or cleaned.setdefault(w, normal(w)) for w in text.split()], label) for text, label in sample]
    toxic = learn_features(documents)
    names = {name: i for i, name in enumerate(toxic)}
    sizes = np.array([len(w) for w, _ in documents], dtype=np.int64)
    marked = {w: [names[f] for f in features_of(w) if f in names] for w in set(cleaned.values())}
    found = [marked[w] for w in chain.from_iterable(w for w, _ in documents)]
    place, lengths = chains(np.array([len(f) for f in found], dtype=float), sizes)
    found = [found[i] for i in place]
    of_token = np.repeat(np.arange(len(found)), [len(f) for f in found])
    of_feature = np.fromiter(chain.from_iterable(found), np.int64, len(of_token))
    label = np.zeros(len(found), dtype=int)
    label[of_token] = 1
    label &= np.repeat([y for _, y in documents], sizes)[place].astype(int)
    weights = np.array([0.2 * x for x in toxic.values()], dtype=float)
    model, rate = Model(bias=-3.0), 0.5
    inside = np.ones(len(found), dtype=bool)
    inside[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inside)
    real_pairs = np.array([[np.sum((label[at - 1] == x) & (label[at] == y)) for y in (0, 1)] for x in (0, 1)], dtype=float)
    heads = np.cumsum(lengths) - lengths
    real_heads = float(label[heads].sum()) if len(heads) else 0.0
    per_feature = np.maximum(1, np.bincount(of_feature, minlength=len(names)))
    for _ in range(rounds if found else 0):
        own = np.bincount(of_token, weights[of_feature], minlength=len(found))
        score = emissions(model, own, lengths)
        p, passes = marginals(model, score, lengths)
        error = label - p
        beside = emissions(Model(around=1.0), own, lengths) - own
        weights += rate * (np.bincount(of_feature, error[of_token], minlength=len(names)) / per_feature - 1e-3 * weights)
        model.bias += rate * error.sum() / max(1.0, (label + p).sum())
        model.around += rate * (error * beside).sum() / max(1.0, beside.sum())
        model.transition += 0.1 * (real_pairs - pair_counts(model, score, lengths, passes)) / np.sqrt(1 + real_pairs)
        model.transition = np.clip(model.transition - model.transition[0, 0], -3, 3)
        model.start[1] = np.clip(model.start[1] + 0.1 * (real_heads - p[heads].sum()) / np.sqrt(1 + real_heads), -3, 3)
        model.around = float(np.clip(model.around, -1, 1))
        model.bias = float(np.clip(model.bias, -8, 0))
    model.weights = {name: float(weights[i]) for name, i in names.items()}
    x = document_features(model, [w for w, _ in documents])
    y = np.array([label for _, label in documents], dtype=float)
    w = np.zeros(3)
    for _ in range(100 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
        w -= step / max(1.0, float(np.abs(step).max()))
    model.document = tuple(w.tolist())
    return model


class Tagger:
    """Marginals of tokens for one model."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(lambda words: [self._weight(normal(w)) for w in words])

    def _weight(self, word: str) -> float:
        get = self.model.weights.get
        return sum([get(f, 0.0) for f in features_of(word)])

    def tag(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        known = self.memo.many(set(chain.from_iterable(documents)))
        lengths = np.array([len(w) for w in documents], dtype=np.int64)
        own = np.fromiter(map(known.__getitem__, chain.from_iterable(documents)), float, int(lengths.sum()))
        place, size = chains(own, lengths)
        p = np.zeros(len(own))
        if len(place):
            p[place] = marginals(self.model, emissions(self.model, own[place], size), size)[0]
        return p, lengths


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row of document features each: 1, logit of the largest marginal, log(1 + expected count)."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    largest, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        largest[full], total[full] = np.maximum.reduceat(p, starts), np.add.reduceat(np.where(p >= 0.05, p, 0), starts)
    bound = np.clip(largest, 1e-6, 1 - 1e-6)
    out[:, 1], out[:, 2] = np.log(bound / (1 - bound)), np.log1p(total)
    return out


def document_features(model: Model, documents: list[list[str]]) -> np.ndarray:
    p, lengths = Tagger(model).tag(documents)
    return summary(p, lengths)


def training_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``size`` labelled rows of each class outside the held-out fold."""
    open_ = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != HELD_OUT)).distinct()
    order = F.xxhash64("id")
    chosen = open_.where("toxic = 1").orderBy(order, "id").limit(size).union(
        open_.where("toxic = 0").orderBy(order, "id").limit(size))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).collect()  # 2 x size rows
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["id"], r["toxic"]))]


def scored(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; with ``spans`` also offending offsets."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(asdict(model))  # features of a bounded sample
    schema = "doc_id bigint, held_out boolean, score double, predicted int"
    schema += ", spans array<struct<start: int, end: int, marginal: double>>" if spans else ""
    names = ["doc_id", "held_out", "score", "predicted", "spans"]

    def offsets(text: str, p: np.ndarray) -> list[dict]:
        return [{"start": m.start(), "end": m.end(), "marginal": float(x)}
                for m, x in zip(re.finditer(r"\S+", text), p) if x >= SPAN_MARGINAL]

    def groups(texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
        first, held, tokens = 0, [], 0
        for i, text in enumerate(texts):
            held.append(text.split())
            tokens += len(held[-1])
            if tokens >= BATCH_TOKENS:
                yield first, held
                first, held, tokens = i + 1, [], 0
        yield first, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(**sent.value))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            scores, found = [], []
            for first, words in groups(texts):
                if not words:
                    continue
                p, lengths = tagger.tag(words)
                x = summary(p, lengths) @ np.array(tagger.model.document)
                scores += (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist()
                if spans:
                    parts = np.split(p, np.cumsum(lengths)[:-1])
                    found += [offsets(texts[first + i], part) for i, part in enumerate(parts)]
            columns = [
                batch.column("doc_id"), pa.array([None if i is None else is_held_out(i) for i in ids], pa.bool_()),
                pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
                columns.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    return ids_and_texts(docs).mapInArrow(run, schema)


def toxicity_table(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    return scored(docs, train(training_sample(docs, labels)), spans)
