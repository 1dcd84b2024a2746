"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it. Learned filters
run over each chunk's bytes, their largest responses in the chunk go through a
small hidden layer to a chunk's score, and the mean over chunks makes the
document's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, functions as F

from kilnflow.llm.labelled import remainder, sample

CHUNK, HOP = 256, 192
#: Filters see KERNEL bytes at every STRIDE-th place.
KERNEL, STRIDE, EMBED, FILTERS, HIDDEN = 8, 4, 8, 32, 24
#: The most labelled documents of class 0 and 1 that are fitted, with all their chunks.
PER_CLASS, EPOCHS = (800, 800), 8
#: Chunks of one gradient step, more only where one document has them.
STEP_CHUNKS = 256
#: Chunks scored at a time.
SLAB = 512


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes; chunks start every HOP bytes, the last ends with the text and is padded with zeros if the text is shorter."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        out = np.zeros((1, CHUNK), np.uint8)
        out[0, : len(data)] = data
        return out
    starts = np.arange(0, len(data) - CHUNK + HOP, HOP)
    starts[-1] = len(data) - CHUNK
    return data[starts[:, None] + np.arange(CHUNK)]


@dataclass
class Net:
    """Parameters: byte embedding e, filters w and b, hidden layer v and c, output u and d."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return Net({
            "e": draw(256, EMBED, scale=0.5), "w": draw(KERNEL * EMBED, FILTERS, scale=(2 / (KERNEL * EMBED)) ** 0.5), "b": np.zeros(FILTERS, np.float32),
            "v": draw(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), "c": np.zeros(HIDDEN, np.float32), "u": draw(HIDDEN, scale=HIDDEN**-0.5), "d": np.zeros(1, np.float32),
        })

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(n, places, KERNEL * EMBED) of embedded bytes, overlapping in memory."""
        e = self.p["e"][x]
        n, s = len(x), e.strides
        return as_strided(e, (n, (CHUNK - KERNEL) // STRIDE + 1, KERNEL * EMBED), (s[0], STRIDE * s[1], s[2]), writeable=False)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        patches = self.patches(x)
        flat = np.ascontiguousarray(patches).reshape(-1, KERNEL * EMBED)
        a = (flat @ self.p["w"]).reshape(len(x), -1, FILTERS)
        return flat, a, np.maximum(a.max(axis=1) + self.p["b"], 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The score of each chunk before the mean."""
        _, _, m = self.pooled(x)
        h = np.maximum(m @ self.p["v"] + self.p["c"], 0)
        return h @ self.p["u"] + self.p["d"][0]

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of documents; ``doc`` is each chunk's place in y."""
        flat, a, m = self.pooled(x)
        z = m @ self.p["v"] + self.p["c"]
        h = np.maximum(z, 0)
        per_doc = np.bincount(doc, minlength=len(y)).astype(np.float32)
        logit = np.bincount(doc, weights=h @ self.p["u"] + self.p["d"][0], minlength=len(y)) / per_doc
        d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        ds = (d_logit / per_doc)[doc]
        dz = np.outer(ds, self.p["u"]) * (z > 0)
        dm = (dz @ self.p["v"].T) * (m > 0)
        best = a.argmax(axis=1)  # (chunks, filters)
        places = a.shape[1]
        rows = (np.arange(len(x))[:, None] * places + best).ravel()
        picked = flat[rows].reshape(len(x), FILTERS, -1)
        dw = np.einsum("nf,nfk->kf", dm, picked, optimize=True)
        back = dm[:, :, None] * self.p["w"].T[None]  # (chunks, filters, kernel * embed)
        offset = best[:, :, None] * STRIDE + np.arange(KERNEL)
        bytes_at = x[np.arange(len(x))[:, None, None], offset].ravel()
        de = np.zeros_like(self.p["e"])
        np.add.at(de, bytes_at, back.reshape(-1, EMBED))
        return {"e": de, "w": dw, "b": dm.sum(0), "v": m.T @ dz, "c": dz.sum(0), "u": h.T @ ds, "d": np.array([ds.sum()], np.float32)}


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> Net:
    """Adam on mini-batches of whole documents, up to ``batch`` of them and STEP_CHUNKS chunks. Without both classes the net stays as drawn, near one half."""
    net, r = Net.start(seed), np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        net.p["u"][:] = 0
        net.p["d"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    sizes = np.array([len(chunks(t)) for t in texts])
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    t = 0
    for epoch in range(epochs):
        step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
        batches: list[list[int]] = [[]]
        held = 0
        for i in r.permutation(len(y)):
            if batches[-1] and (len(batches[-1]) == batch or held + sizes[i] > STEP_CHUNKS):
                batches.append([])
                held = 0
            batches[-1].append(int(i))
            held += sizes[i]
        for picks in batches:
            g = net.gradients(np.concatenate([chunks(texts[i]) for i in picks]), np.repeat(np.arange(len(picks)), sizes[picks]), y[picks])
            t += 1
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] -= (step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def probability(net: Net, texts: list[bytes]) -> np.ndarray:
    """A number in [0, 1] for each text; chunks of many texts are scored together, SLAB at a time."""
    out = np.zeros(len(texts))
    counts = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        x, of = np.concatenate(held), np.concatenate(owner)
        for at in range(0, len(x), SLAB):
            np.add.at(out, of[at : at + SLAB], net.scores(x[at : at + SLAB]))
        np.add.at(counts, of, 1)
        held.clear(), owner.clear()

    for i, text in enumerate(texts):
        c = chunks(text)
        held.append(c)
        owner.append(np.full(len(c), i))
        size += len(c)
        if size >= SLAB * 4:
            flush()
            size = 0
    if held:
        flush()
    return 1 / (1 + np.exp(-np.clip(out / np.maximum(counts, 1), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, threshold: float = 0.3, per_class: tuple[int, int] = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold``).

    Fits at most ``per_class[y]`` labelled documents of class y that aren't
    held out; only texts are inputs. Null texts are empty and get a score, too.
    A null doc_id isn't held out. Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    net = fit(*sample(docs, labels, label, mod, held_out, per_class)[:2])
    shared = spark.sparkContext.broadcast(net.p)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Net(shared.value)
        for b in batches:
            s = probability(model, [x.as_py() or b"" for x in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder(mod) == held_out, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
