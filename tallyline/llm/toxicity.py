"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network twice: as the class of its own evidence, and as the class of the strongest evidence among
its character n-grams (3 to 5 bytes of the word between markers).  Evidence is a cautious log odds of a
word's or n-gram's document counts in the two classes; while the network learns, a document's own fold is
left out of the counts.  Both classes have learned embeddings.  The network reads windows of 48 words, 24 apart, in
both directions; attention pools the states; a text's score is that of its highest window.  All windows are scored;
equal windows (by class) are computed once per batch.
"""

from __future__ import annotations

import bisect
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, free_name, plain_words, text_bytes
from tallyline.llm.labelled import held_out, sample, trainable

THRESHOLD = 0.3
SAMPLE = {0: 2_400, 1: 1_200}  # labelled rows of each class that are learned from
SAMPLE_BYTES = 40_000  # longer texts are not learned from; they are scored whole
WINDOW, STEP = 48, 24
HIDDEN, EMBED = 8, 6
FOLDS = 5
EDGES = np.array([-1.0, 0.05, 0.4, 0.8, 1.2, 1.7, 2.2, 2.8, 3.5])  # classes of evidence
CLASSES = len(EDGES) + 1
_EDGES = EDGES.tolist()
PAD = 0
LIMIT = 300_000  # words whose class a worker keeps
LONG = 40  # bytes of a word above which its n-grams are kept once


def each_gram(word: bytes) -> Iterator[bytes]:
    w = b"<" + word + b">"
    return (w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))


def grams(word: bytes) -> list[bytes]:
    """N-grams of the whole word; of a long one each once."""
    return list(each_gram(word) if len(word) <= LONG else dict.fromkeys(each_gram(word)))


def evidence(t: np.ndarray, c: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """Cautious log odds of presence in t of nt toxic and c of nc clean documents: 1.5 standard errors nearer to 0, or 0."""
    t, c = t + 0.5, c + 0.5
    odds = np.log(t / (nt + 1)) - np.log(c / (nc + 1))
    return np.sign(odds) * np.maximum(np.abs(odds) - 1.5 * np.sqrt(1 / t + 1 / c), 0)


def code(word_z: np.ndarray, gram_z: np.ndarray) -> np.ndarray:
    """1 + word class * CLASSES + n-gram class; 0 is no word."""
    return (1 + np.searchsorted(EDGES, word_z) * CLASSES + np.searchsorted(EDGES, gram_z)).astype(np.uint8)


def windows(codes: np.ndarray) -> np.ndarray:
    """All windows of a text's codes, the last one filled up with PAD; one empty window for no words."""
    n = max(1, -(-(len(codes) - WINDOW) // STEP) + 1) if len(codes) > WINDOW else 1
    full = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    full[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STEP]


class Network:
    """Embeddings, two gated recurrent directions, attention, logistic output."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.default_rng(seed)
        h, e = hidden, embed
        self.h = h
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        ramp = np.concatenate([EDGES[:1], EDGES])[:, None]
        self.p = {
            "ew": np.hstack([ramp, 0.1 * rng.standard_normal((CLASSES, e - 1))]).astype(np.float32),
            "ec": np.hstack([0.1 * rng.standard_normal((CLASSES, e - 1)), ramp]).astype(np.float32),
            "wo": init(2 * h), "bo": np.zeros(1, np.float32), "wa": init(2 * h, h), "ba": np.zeros(h, np.float32), "va": init(h),
        }
        for d in "fb":
            self.p |= {f"w{d}": init(e, 3 * h), f"g{d}": np.zeros(3 * h, np.float32), f"u{d}": init(h, 3 * h)}

    def table(self, d: str) -> np.ndarray:
        """Input projection of every code; row 0 (PAD) is unused."""
        x = (self.p["ew"][:, None] + self.p["ec"][None]).reshape(-1, self.p["ew"].shape[1])
        return np.vstack([np.zeros((1, 3 * self.h), x.dtype), x @ self.p[f"w{d}"] + self.p[f"g{d}"]])

    def forward(self, codes: np.ndarray, keep: bool = False):
        """Logits of windows of codes; with ``keep`` also what backward() needs."""
        n, t, h = len(codes), codes.shape[1], self.h
        dtype = self.p["wo"].dtype
        states = np.zeros((t, n, 2 * h), dtype)
        mask = (codes != PAD).T
        memo = {}
        for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            g, u = self.table(d), self.p[f"u{d}"]
            s, at = np.zeros((n, h), dtype), slice(0, h) if d == "f" else slice(h, 2 * h)
            for i in order:
                if not mask[i].any():
                    states[i, :, at] = s
                    continue
                x, q = g[codes[:, i]], s @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + q[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * q[:, 2 * h :])
                new = np.where(mask[i][:, None], c + z * (s - c), s)
                if keep:
                    memo[d, i] = (s, z, r, c, q[:, 2 * h :])
                s = new
                states[i, :, at] = s
        a = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = np.where(mask, a @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        w = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", w, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (codes, mask, memo, states, a, w, pooled)) if keep else logit

    def backward(self, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        codes, mask, memo, states, a, w, pooled = kept
        p, h, t = self.p, self.h, codes.shape[1]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["wo"], grad["bo"][0] = pooled.T @ dlogit, dlogit.sum()
        dpool = dlogit[:, None] * p["wo"]
        dw = np.einsum("tnk,nk->tn", states, dpool)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[..., None] * p["va"] * (1 - a * a)
        grad["va"], grad["ba"] = np.einsum("tn,tnk->k", de, a), da.sum(axis=(0, 1))
        grad["wa"] = np.einsum("tnk,tnj->kj", states, da)
        dstate = w[..., None] * dpool + da @ p["wa"].T
        x = (p["ew"][:, None] + p["ec"][None]).reshape(-1, p["ew"].shape[1])
        dx = np.zeros_like(x)
        for d, order in (("f", range(t - 1, -1, -1)), ("b", range(t))):
            at = slice(0, h) if d == "f" else slice(h, 2 * h)
            carry, dg = np.zeros((len(codes), h), states.dtype), np.zeros((len(x) + 1, 3 * h), states.dtype)
            for i in order:
                ds = dstate[i, :, at] + carry
                if (d, i) not in memo:
                    carry = ds
                    continue
                s, z, r, c, q = memo[d, i]
                m = mask[i][:, None]
                dz, dc = ds * (s - c) * z * (1 - z) * m, ds * (1 - z) * (1 - c * c) * m
                dr = dc * q * r * (1 - r)
                dq = np.hstack([dz, dr, dc * r])
                grad[f"u{d}"] += s.T @ dq
                np.add.at(dg, codes[:, i], np.hstack([dz, dr, dc]))
                carry = np.where(m, ds * z, ds) + dq @ p[f"u{d}"].T
            dg = dg[1:]
            grad[f"w{d}"], grad[f"g{d}"] = x.T @ dg, dg.sum(axis=0)
            dx += dg @ p[f"w{d}"].T
        dx = dx.reshape(CLASSES, CLASSES, -1)
        grad["ew"], grad["ec"] = dx.sum(axis=1), dx.sum(axis=0)
        return grad


class Lexicon:
    """Evidence of words and character n-grams, from documents' word sets."""

    def __init__(self, words: dict[bytes, float], grams_: dict[bytes, float]):
        self.words, self.grams = words, grams_

    def code(self, word: bytes) -> int:
        known = self.grams.keys() & (grams(word) if len(word) <= LONG else each_gram(word))
        best = max(map(self.grams.__getitem__, known)) if known else 0.0
        return 1 + bisect.bisect_left(_EDGES, self.words.get(word, 0.0)) * CLASSES + bisect.bisect_left(_EDGES, best)


def train(texts: list[bytes], y: np.ndarray, epochs: int = 14, seed: int = 5, clean_weight: float = 1.0) -> tuple[Lexicon, Network, tuple[float, float]]:
    """Lexicon, network and calibration (slope, intercept) from labelled texts; a clean text stands for ``clean_weight`` toxic ones."""
    docs = [plain_words(t) for t in texts]
    vocab: dict[bytes, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in d], np.int64) for d in docs]
    gram_id: dict[bytes, int] = {}
    flat, ends = [], []
    for w in vocab:
        flat += [gram_id.setdefault(g, len(gram_id)) for g in grams(w)]
        ends.append(len(flat))
    flat, starts = np.array(flat, np.int64), np.array([0, *ends[:-1]], np.int64)
    ends = np.array(ends, np.int64)
    fold = np.arange(len(docs)) % FOLDS
    cw = np.zeros((2, FOLDS, max(1, len(vocab))), np.int32)
    cg = np.zeros((2, FOLDS, max(1, len(gram_id))), np.int32)
    for d, k, label in zip(ids, fold, y, strict=True):
        u = np.unique(d)
        cw[label, k, u] += 1
        if len(u):
            cg[label, k, np.unique(np.concatenate([flat[a:b] for a, b in zip(starts[u], ends[u], strict=True)]))] += 1
    n = np.array([[np.sum((y == b) & (fold == k)) for k in range(FOLDS)] for b in (0, 1)])

    def codes_without(k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        use = [j for j in range(FOLDS) if j != k]
        zw = evidence(cw[1, use].sum(axis=0), cw[0, use].sum(axis=0), int(n[1, use].sum()), int(n[0, use].sum()))
        zg = evidence(cg[1, use].sum(axis=0), cg[0, use].sum(axis=0), int(n[1, use].sum()), int(n[0, use].sum()))
        best = np.maximum.reduceat(zg[flat], starts) if len(flat) else np.zeros(len(vocab))
        return zw, zg, code(zw[: len(vocab)], np.maximum(best, 0))

    per_fold = [codes_without(k)[2] for k in range(FOLDS)]
    candidates, owner = [], []
    for i, (d, k) in enumerate(zip(ids, fold, strict=True)):
        w = windows(per_fold[k][d])
        strength = ((w.astype(np.int64) - 1) % CLASSES).max(axis=1) * 100 + (w >= 1 + 4 * CLASSES).sum(axis=1) + (((w.astype(np.int64) - 1) % CLASSES) >= 4).sum(axis=1)
        for j in np.argsort(-strength, kind="stable")[:4]:
            candidates.append(w[j])
            owner.append(i)
    candidates, owner = np.array(candidates, np.uint8), np.array(owner)
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        logit = net.forward(candidates)
        order = np.lexsort((-logit, owner))
        top = order[np.unique(owner[order], return_index=True)[1]]  # each document learns at its highest window
        top = top[rng.permutation(len(top))]
        for at in range(0, len(top), 128):
            pick = top[at : at + 128]
            logit, kept = net.forward(candidates[pick], keep=True)
            label = y[owner[pick]]
            weight = np.where(label == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
            grad = net.backward(kept, ((1 / (1 + np.exp(-logit)) - label) * weight / len(pick)).astype(np.float32))
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k in net.p:
                g = grad[k] + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logit = net.forward(candidates)
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logit)
    zw, zg, _ = codes_without(None)
    lexicon = Lexicon(
        {w: float(z) for w, z in zip(vocab, zw, strict=False) if z != 0}, {g: float(z) for g, z in zip(gram_id, zg, strict=False) if z > _EDGES[1]}
    )
    return lexicon, net, _calibrated(top, y, np.where(y == 1, 1.0, clean_weight))


def _calibrated(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    x = np.clip(logit, -12, 12)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * x + b)))
        s, d = weight * (q * (1 - q) + 1e-6), weight * (q - y)
        g = np.array([(d * x).sum() + 0.01 * (a - 1), d.sum()])
        hess = np.array([[(s * x * x).sum() + 0.01, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        da, db = np.linalg.solve(hess, g)
        a, b = max(0.1, a - np.clip(da, -1, 1)), b - np.clip(db, -1, 1)
    return float(a), float(b)


class _Codes(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        c = self.lexicon.code(word)
        if len(self) >= LIMIT:
            self.clear()
        self[word] = c
        return c


def score_texts(texts: Iterator[bytes], codes: dict, net: Network, calibration: tuple[float, float]) -> np.ndarray:
    """Scores of whole texts: the highest of all their windows."""
    parts, owner = [], []
    for i, data in enumerate(texts):
        w = windows(np.frombuffer(bytes(map(codes.__getitem__, plain_words(data))), np.uint8))
        parts.append(w)
        owner.append(np.full(len(w), i))
    if not parts:
        return np.zeros(0)
    every, owner = np.concatenate(parts), np.concatenate(owner)
    _, first, back = np.unique(np.ascontiguousarray(every).view(f"V{WINDOW}").ravel(), return_index=True, return_inverse=True)
    logit = np.concatenate([net.forward(every[first[a : a + 4096]]) for a in range(0, len(first), 4096)])
    top = np.full(len(parts), -np.inf)
    np.maximum.at(top, owner, logit[back.ravel()])
    return 1 / (1 + np.exp(-(calibration[0] * np.clip(top, -12, 12) + calibration[1])))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: dict[int, int] | None = None):
    """A model from at most ``bound`` labelled documents of each class that are not held out and not above SAMPLE_BYTES.

    None without documents of both classes.
    """
    chosen = sample(labels, label, bound or SAMPLE)
    text = F.coalesce("text", F.lit(""))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    )
    rows = sorted(rows, key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.int64)
    if len(y) < 4 or y.min() == y.max():
        return None, (float(y.sum()) + 1) / (len(y) + 2)
    every = {r["y"]: r["count"] for r in trainable(labels, label).groupBy("y").count().collect()}  # two rows
    clean_weight = (every[0] / (len(y) - y.sum())) / (every[1] / y.sum())
    return train([r["text"].encode() for r in rows], y, clean_weight=clean_weight), 0.5


def with_scores(docs: DataFrame, model, column: str = "score", share: float = 0.5) -> DataFrame:
    """``docs`` and the score of each text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = _Codes(model[0]) if model else None
        for batch in batches:
            values = score_texts(text_bytes(batch["text"]), codes, *model[1:]) if model else np.full(len(batch), share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, column])

    return arrow_map(kept, score, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have one empty window and get its score; repeated rows are scored each; extra columns are not
    read.  Without labels of both classes every score is the smoothed share of label 1.
    """
    model, share = learn(docs, labels)
    out = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, share=share)
    return out.select("doc_id", held_out(), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored at or above the threshold; columns as they were.

    Null and empty texts and repeated rows are scored like any other.  Without labels of both classes there is no model, and
    all documents stay, with a warning.
    """
    model, share = learn(docs, labels)
    if model is None:
        warnings.warn("no toxicity model without labels of both classes: all documents stay", stacklevel=2)
        return docs
    column = free_name(docs, "__toxicity")
    return with_scores(docs, model, column, share).where(F.col(column) < threshold).select(*docs.columns)
