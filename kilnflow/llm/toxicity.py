"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences and toxic if any of them is. Sentence
probabilities from hashed words and their beginnings are combined by noisy-or and fitted to document labels; the fitted sentence scores locate what
offends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.labelled import remainder, sample

BUCKETS = 1 << 18
#: The most labelled documents of class 0 and 1 that are fitted; clean documents are more, as in the tables.
PER_CLASS, EPOCHS = (4500, 1500), 10
#: A feature must be in so many fitted documents to have a weight; a parameter, to be lowered for few labels.
MIN_SEEN = 6
#: Lengths in bytes of a word's beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[.!?\n]")
_ENDS = frozenset(b".!?\n")
_CACHED = 500_000
_END = float("-inf")
_OFFENDING = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))


def buckets(word: bytes) -> list[int]:
    """The features of a word. A beginning as long as the word counts, too, so that stems meet their inflections."""
    parts = [b"=" + word, *[b"<" + word[:n] for n in BEGINNINGS if len(word) >= n]]
    return [crc32(p) % BUCKETS for p in parts]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Slope and offset of the document's log odds.
    a: float = 1.0
    b: float = 0.0
    known: dict[bytes, float] = field(default_factory=dict)
    listed: list[float] = field(init=False)

    def __post_init__(self) -> None:
        self.listed = self.weights.tolist()  # faster than the array for a few places at a time

    def _score(self, word: bytes) -> float:
        return _END if word[0] in _ENDS else sum(self.listed[b] for b in buckets(word))

    def words(self, text: bytes) -> np.ndarray:
        """The score of each word in order, minus infinity for a sentence's end; words that recur are scored once while remembered."""
        found = _TOKEN.findall(text.lower())
        try:
            return np.array(list(map(self.known.__getitem__, found)))
        except KeyError:
            if len(self.known) > _CACHED:
                self.known.clear()
            for w in set(found):
                if w not in self.known:
                    self.known[w] = self._score(w)
            return np.array(list(map(self.known.__getitem__, found)))

    def sentences(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sentences that have words, and the log odds of each."""
        scores = self.words(text)
        word = scores != _END
        if not word.any():
            return np.empty(0, np.int64), np.empty(0)
        number = np.cumsum(~word)
        z = np.bincount(number[word], weights=scores[word])
        has = np.bincount(number[word]) > 0
        return np.flatnonzero(has), z[has] + self.bias

    def probability(self, text: bytes) -> float:
        """Noisy-or: one minus the product of the sentences' complements. A text without words has the chance of one neutral sentence."""
        _, z = self.sentences(text)
        return self.combined(z if len(z) else np.array([self.bias]))

    def combined(self, z: np.ndarray) -> float:
        """The document's probability from its sentences' log odds, set to the held-back documents' scale."""
        return float(1 / (1 + np.exp(-(self.a * log_odds(z) + self.b))))


def log_odds(z: np.ndarray) -> float:
    """Of the noisy-or, kept within 15 either way."""
    total = float(np.logaddexp(0, z).sum())  # minus the log of the complement
    return float(np.clip(np.log(np.maximum(np.expm1(min(total, 50.0)), 1e-300)), -15, 15))


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels on log odds, by damped Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = q - y, q * (1 - q) + 1e-6
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, [(g * x).sum() + (a - 1), g.sum()])
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a), float(b)


def _bag(text: bytes, known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence) of a text's features."""
    bucket, sentence, number = [], [], 0
    for w in _TOKEN.findall(text.lower()):
        if w[0] in _ENDS:
            number += 1
        else:
            own = known.get(w)
            if own is None:
                own = known[w] = buckets(w)
            bucket += own
            sentence += [number] * len(own)
    return np.array(bucket, np.int32), np.array(sentence, np.int32)


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.8, decay: float = 1e-4, sparsity: float = 6e-4, seed: int = 7, min_seen: int = MIN_SEEN) -> Model:
    """AdaGrad on the noisy-or likelihood of documents, with weights drawn to zero; every fifth document is held back to scale the result.

    Only features seen in ``min_seen`` documents or more are fitted. Without both
    classes every score is near that class's.
    """
    model = Model(np.zeros(BUCKETS), -5.0)
    if len(set(y.tolist())) < 2:
        model.bias = 4.0 if len(y) and y[0] else (-4.0 if len(y) else 0.0)
        return model
    aside = np.arange(len(y)) % 5 == 4
    held, held_y = [t for t, x in zip(texts, aside) if x], y[aside]
    texts, y = [t for t, x in zip(texts, aside) if not x], y[~aside]
    words: dict[bytes, list[int]] = {}
    bags = [_bag(t, words) for t in texts]
    words.clear()
    seen = np.zeros(BUCKETS, np.int64)
    for b, _ in bags:
        seen[np.unique(b)] += 1
    bags = [(b[seen[b] >= min_seen], np.unique(s[seen[b] >= min_seen], return_inverse=True)[1].astype(np.int32)) for b, s in bags]
    speed, bias_speed, r = np.full(BUCKETS, 1e-6), 1e-6, np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            picks = order[at : at + batch]
            bucket = np.concatenate([bags[i][0] for i in picks])
            sizes = [int(bags[i][1].max()) + 1 if len(bags[i][1]) else 0 for i in picks]
            sentence = np.concatenate([bags[i][1] + o for i, o in zip(picks, np.concatenate([[0], np.cumsum(sizes)[:-1]]))]).astype(np.int64)
            n = int(sum(sizes))
            if not n:
                continue
            z = np.bincount(sentence, weights=model.weights[bucket], minlength=n) + model.bias
            doc = np.repeat(np.arange(len(picks)), sizes)
            total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(picks))
            pull = np.where(y[picks] > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
            dz = pull[doc] / (1 + np.exp(-np.clip(z, -30, 30))) / len(picks)
            all_g = np.bincount(bucket, weights=dz[sentence], minlength=BUCKETS)
            touched = np.flatnonzero(all_g)
            g = all_g[touched] + decay * model.weights[touched]
            speed[touched] += g * g
            step = rate / np.sqrt(speed[touched])
            w = model.weights[touched] - step * g
            model.weights[touched] = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
            gb = float(dz.sum())
            bias_speed += gb * gb
            model.bias -= 0.5 * rate * gb / bias_speed**0.5
    model = Model(model.weights, model.bias)
    if len(set(held_y.tolist())) == 2:
        odds = [log_odds(z if len(z) else np.array([model.bias])) for _, z in map(model.sentences, held)]
        model.a, model.b = _scale(np.array(odds), held_y)
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2, threshold: float = 0.3, per_class: tuple[int, int] = PER_CLASS, offends: float = 0.3, min_seen: int = MIN_SEEN) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold``), worst_sentence (its number from 0, null without words), worst_score and offending.

    ``offending`` has the number and score of every sentence whose own
    probability is ``offends`` or more, in order; it may be empty.

    Fits at most ``per_class[y]`` labelled documents of class y that aren't
    held out; only texts are inputs. Null texts are empty and get a score, too.
    A null doc_id isn't held out. Sentences end with . ! ? or a line feed.
    """
    texts, y, rarer = sample(docs, labels, label, mod, held_out, per_class)
    model = fit(texts, y, min_seen=min_seen)
    model.b += rarer
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.a, model.b))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            s, worst, worst_score, offending = np.zeros(b.num_rows), [], [], []
            for i, text in enumerate(b.column(2)):
                numbers, z = own.sentences(text.as_py() or b"")
                s[i] = own.combined(z if len(z) else np.array([own.bias]))
                k = int(z.argmax()) if len(z) else None
                own_score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                worst.append(None if k is None else int(numbers[k]))
                worst_score.append(None if k is None else float(own_score[k]))
                offending.append([{"sentence": int(numbers[j]), "score": float(own_score[j])} for j in np.flatnonzero(own_score >= offends)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(worst, pa.int32()), pa.array(worst_score, pa.float64()), pa.array(offending, _OFFENDING)],
                ["doc_id", "held_out", "score", "predicted", "worst_sentence", "worst_score", "offending"],
            )

    held = F.coalesce(remainder(mod) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, worst_sentence int, worst_score double, offending array<struct<sentence: int, score: double>>")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, numbered as worst_sentence and offending count them."""
    return re.split(r"[.!?\n]", text or "")
