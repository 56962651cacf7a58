"""Quality by a sparse rule ensemble.

Small trees are grown over text statistics of labelled documents; every path from a root to a node is a rule (a
conjunction of threshold tests); a lasso logistic fit keeps few rules; the kept rules and weights are compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, durable, text_bytes
from tallyline.llm.labelled import held_out, sample

THRESHOLD = 0.7
PER_CLASS = 4_000  # labelled rows of each class that are learned from
STATS = (
    "words", "word_len", "upper", "bang", "symbols", "pipes", "digits", "commas", "lines", "caps_words", "repeats", "distinct", "top_word", "line_repeats", "marked_words", "spaces",
)
PREFIX = "__stat_"
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"$%&*#@^~=<>_\\")] = True
_MARKS = frozenset(b"$%&*#!|")


def statistics(data: bytes) -> tuple[float, ...]:
    """The statistics of a text, in the order of STATS; all 0 for an empty text."""
    if not data:
        return (0.0,) * len(STATS)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    k = max(1, len(words))
    upper, letters = int(c[65:91].sum()), int(c[65:91].sum() + c[97:123].sum())
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    return (
        float(len(words)), sum(map(len, words)) / k, upper / max(1, letters), int(c[33]) / k, int(c[_SYMBOLS].sum()) / k, int(c[124]) / k,
        int(c[48:58].sum()) / n, int(c[44]) / k, len(lines) / k, sum(map(bytes.isupper, words)) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, len(counts) / k, max(counts.values(), default=0) / k, 1 - len(set(lines)) / max(1, len(lines)),
        sum(w[-1] in _MARKS for w in words) / k, int(c[32]) / n,
    )


def with_statistics(docs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """``docs`` and one column per statistic (their names start with ``prefix``)."""
    names = [prefix + s for s in STATS]
    kept = docs.drop(*names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in text_bytes(batch["text"])], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=[*batch.schema.names, *names])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return arrow_map(kept, add, StructType([*kept.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) all of which hold


def _tree(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, path: Rule, out: set[Rule]) -> None:
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return
    best = (1e-9, None)
    p = y.mean()
    for j in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        if not len(cuts[j]):
            continue
        above = x[:, j, None] > cuts[j][None, :]
        n1 = above.sum(axis=0)
        s1 = (above * y[:, None]).sum(axis=0)
        n0, s0 = len(y) - n1, y.sum() - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n1 >= 3) & (n0 >= 3), p * (1 - p) * len(y) - s1 * (n1 - s1) / n1 - s0 * (n0 - s0) / n0, 0)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (int(j), float(cuts[j][k])))
    if best[1] is None:
        return
    j, cut = best[1]
    side = x[:, j] > cut
    for above in (True, False):
        _tree(x[side == above], y[side == above], cuts, rng, depth - 1, (*path, (j, above, cut)), out)


def rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rows: int = 1_500, seed: int = 7) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    found: set[Rule] = set()
    for _ in range(trees):
        pick = rng.integers(0, len(y), min(rows, len(y)))
        _tree(x[pick], y[pick], cuts, rng, depth, (), found)
    return sorted(found)


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > cut) if above else (x[:, j] <= cut) for j, above, cut in rule])


def fit_lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient."""
    n, m = r.shape
    a, b = np.zeros(m), 0.0
    va, vb, t = a, b, 1.0
    rate = 4.0 / (m * max(1e-9, r.mean(axis=0).max()) + 1)
    rate = max(rate, 4.0 / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 / n * weight.max() + 1e-9))
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ va + vb))) - y) * weight / n
        na = va - rate * (r.T @ g)
        na = np.sign(na) * np.maximum(np.abs(na) - rate * penalty, 0)
        nb = vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        va, vb = na + (t - 1) / nt * (na - a), nb + (t - 1) / nt * (nb - b)
        a, b, t = na, nb, nt
    return float(b), a


def train(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept (log-odds) and the weighted rules; without both classes the smoothed share alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return float(np.log(share / (1 - share))), []
    found = rules(x, y)
    if not found:
        return float(np.log(share / (1 - share))), []
    r = np.stack([fires(q, x) for q in found], axis=1).astype(np.float64)
    b, a = fit_lasso(r, y.astype(np.float64), np.ones(len(y)), penalty)
    return b, [(float(w), q) for w, q in zip(a, found, strict=True) if abs(w) > 1e-6]


def compiled(model: tuple[float, list[tuple[float, Rule]]], prefix: str = PREFIX) -> Column:
    """The model as a column expression: a probability between 0 and 1."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        test = None
        for j, above, cut in rule:
            c = F.col(prefix + STATS[j])
            one = c > F.lit(cut) if above else c <= F.lit(cut)
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """A model from statistics of labelled documents that are not held out; at most ``per_class`` of each class."""
    chosen = sample(labels, label, {0: per_class, 1: per_class})
    rows = stats.select("doc_id", *[PREFIX + s for s in STATS]).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *[PREFIX + s for s in STATS]).limit(4 * per_class).collect()  # at most a few thousand
    x = np.array([[r[PREFIX + s] for s in STATS] for r in rows], np.float64).reshape(-1, len(STATS))
    return train(x, np.array([r["y"] for r in rows], np.float64))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have zero statistics and are scored like any other; repeated rows are scored each; extra columns
    are not read.  Empty labels give every document the score 0.5.
    """
    stats = durable(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    score = compiled(learn(stats, labels))
    return stats.select("doc_id", held_out(), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored below the threshold; columns as they were.

    Null and empty texts and repeated rows are scored like any other.  Without labels of both classes the model has no rules,
    and all documents stay, with a warning.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(with_statistics(slim.join(F.broadcast(sample(labels, "quality", {0: PER_CLASS, 1: PER_CLASS}).select("doc_id")), "doc_id", "left_semi")), labels)
    if not model[1]:
        warnings.warn("no quality rules without labels of both classes: all documents stay", stacklevel=2)
        return docs
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_statistics(docs, prefix).where(compiled(model, prefix) >= threshold).select(*docs.columns)
