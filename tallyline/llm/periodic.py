"""Periodic runs of words by recompression.

The words of a batch of texts are one string of numbers, with a number of its own before, between and after the texts,
so that no run leaves its text.  For a period q, the grid points 0, q, 2q, ... are looked at: a run of length 4q or more
has at least three neighbouring grid points i with word i equal to word i + q.  Only texts with such points can hold a run.

For these a run-length grammar is made: block compression replaces a repeated symbol c^k by one symbol, pair compression then
replaces a pair of a left and a right symbol (a bit of the symbol's hash decides the side) by one symbol, and so on by turns.
Equal stretches are replaced alike except near their ends.  So the longest common extension of two places is found by jumps
over whole symbols: up the levels while both places are the same symbol's border, and down again.  At the words themselves
the jumps end at a word that differs, so every extension is exact, whatever the grammar looks like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, base, text_bytes

EXPONENT, LEAST = 4, 6  # a run is at least four periods and six words long
TOP = 32  # a level of so few symbols is the last
BESIDE = 4  # words beside a grid point that are looked at before it is extended
PHASES = (16, 256)  # periods up to each bound are done before longer ones
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """Levels of (start of the block, symbol, words in a symbol, symbols in the block) over a string of numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.levels = ids, []
        start, symbol, width = np.arange(len(ids)), np.unique(ids, return_inverse=True)[1].astype(np.int64), np.ones(len(ids), np.int64)
        for level in range(64):
            head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            count = np.diff(np.append(head, len(symbol)))
            start, symbol, width = start[head], symbol[head], width[head]
            self.levels.append((start, symbol, width, count))
            if len(head) <= TOP:
                break
            block = np.unique(symbol * (count.max() + 1) + count, return_inverse=True)[1].astype(np.int64)
            width = width * count
            side = ((block.astype(np.uint64) + np.uint64(level + 1)) * _MIX) >> np.uint64(63)
            at = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))  # left then right: no two of these pairs overlap
            kinds = block.max() + 1
            block[at] += kinds + kinds * block[at + 1]
            width[at] += width[at + 1]
            keep = np.ones(len(block), bool)
            keep[at + 1] = False
            start, width = start[keep], width[keep]
            symbol = np.unique(block[keep], return_inverse=True)[1].astype(np.int64)

    def _jump(self, level: int, p: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
        """Words that both places can go on by at this level: none unless both are borders of the same symbol."""
        start, symbol, width, count = self.levels[level]
        side = "left" if back else "right"
        x, y = start.searchsorted(p, side) - 1, start.searchsorted(q, side) - 1
        in_x, in_y, w = p - start[x], q - start[y], width[x]
        same = (symbol[x] == symbol[y]) & (in_x % w == 0) & (in_y % w == 0)
        least = np.minimum(in_x, in_y) if back else np.minimum(count[x] * w - in_x, count[y] * w - in_y)
        return np.where(same, least, 0)

    def extension(self, p: np.ndarray, q: np.ndarray, back: bool) -> np.ndarray:
        """Equal words from p and q on (back: before p and q).  The string's first and last numbers occur once."""
        p, q, far = p.astype(np.int64), q.astype(np.int64), np.zeros(len(p), np.int64)
        sign, near = (-1, -1) if back else (1, 0)

        def go(level: int, at: np.ndarray) -> np.ndarray:
            """Those of ``at`` that could jump."""
            jump = self._jump(level, p[at] + sign * far[at], q[at] + sign * far[at], back)
            far[at] += jump
            return at[jump > 0]

        def equal(at: np.ndarray) -> np.ndarray:
            return at[self.ids[p[at] + sign * far[at] + near] == self.ids[q[at] + sign * far[at] + near]]

        live = equal(np.arange(len(p)))
        while len(live):
            up, level = live, 0
            for level in range(len(self.levels)):
                moved = go(level, up)
                if level and len(moved) < len(up):
                    # between two symbols that are a pair one level up: past the second one
                    moved = np.concatenate([moved, go(level, go(level - 1, np.setdiff1d(up, moved, assume_unique=True)))])
                up = moved
                if not len(up):
                    break
            for below in range(level, -1, -1):
                at = live
                for _ in range(2):
                    at = go(below, at)
                    if not len(at):
                        break
            live = equal(live)
        return far


def grid_points(ids: np.ndarray, ends: np.ndarray, sizes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) with low < period <= high: at least one of any run of that period.  Texts lie longest first."""
    places, periods = [], []
    for q in range(low + 1, min(high, int(sizes[0]) // EXPONENT if len(sizes) else 0) + 1):
        # texts long enough for this period come first
        fit = int(np.searchsorted(-sizes, -max(LEAST, EXPONENT * q), "right"))
        if not fit:
            break
        grid = ids[: ends[fit - 1] + 1 : q]
        same = grid[1:] == grid[:-1]
        if len(same) < 3 or not (same[2:] & same[1:-1] & same[:-2]).any():
            continue
        at = np.flatnonzero(same)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(at) != 1]), at, 0))
        # of three neighbours, one is tested
        chosen = at[(at - first) % 3 == 2] * q
        places.append(chosen)
        periods.append(np.full(len(chosen), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate(places), np.concatenate(periods)
    # of the 3q equal places of a run, q or more lie on one side of the point
    ahead, before = np.ones(len(place), bool), np.ones(len(place), bool)
    for k in range(1, BESIDE + 1):
        far, back = np.minimum(place + k, len(ids) - 1), np.maximum(place - k, 0)
        ahead &= (k > period) | (ids[far] == ids[np.minimum(far + period, len(ids) - 1)])
        before &= (k > period) | (ids[back] == ids[back + period])
    return place[ahead | before], period[ahead | before]


def _known(place: np.ndarray, period: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether a point lies, with three periods after it, in a run found before whose period divides its own."""
    if not len(runs):
        return np.zeros(len(place), bool)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    x = np.searchsorted(runs[:, 0], place, "right") - 1
    r = runs[np.maximum(x, 0)]
    return (x >= 0) & (place + 2 * period < r[:, 1]) & (period % r[:, 2] == 0)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text (numbers of its words), the rows (start, length, period) of all runs, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    order = sorted((k for k, x in enumerate(texts) if len(x) >= LEAST), key=lambda k: -len(texts[k]))
    # a first look at the grid, without a grammar, leaves the texts that can hold a run
    ids, begins, sizes = _joined([texts[k] for k in order])
    place, _ = grid_points(ids, begins + sizes, sizes, 0, 2**62)
    hold = np.unique(np.searchsorted(begins, place, "right") - 1)
    order = [order[k] for k in hold if k >= 0]
    if not order:
        return out
    ids, begins, sizes = _joined([texts[k] for k in order])
    grammar, runs = Grammar(ids), none
    for low, high in zip((0, *PHASES), (*PHASES, 2**62), strict=True):
        p, q = grid_points(ids, begins + sizes, sizes, low, high)
        new = ~_known(p, q, runs)
        p, q = p[new], q[new]
        ahead, before = grammar.extension(p, p + q, False), grammar.extension(p, p + q, True)
        rows = np.stack([p - before, p + q + ahead, q], 1)[ahead + before + q >= np.maximum(LEAST, EXPONENT * q)]
        runs = np.concatenate([runs, rows])
        # a stretch of smaller period is one run of the smallest: its multiples end at the same words
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    cut = np.searchsorted(text, np.arange(len(order) + 1))
    for k, which in enumerate(order):
        r = runs[cut[k] : cut[k + 1]]
        rows = np.stack([r[:, 0] - begins[k], r[:, 1] - r[:, 0], r[:, 2]], 1)
        out[which] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The string of all texts, negative numbers of their own around them; the texts' first places and sizes."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.full(int(sizes.sum()) + len(texts) + 1, -1, np.int64)
    for b, x in zip(begins, texts, strict=True):
        ids[b : b + len(x)] = x
    marks = np.concatenate([[0], begins + sizes])
    ids[marks] = -1 - np.arange(len(marks))
    return ids, begins, sizes


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period), collapsed text of every row of ``docs``.

    Words are what white space of ASCII parts.  collapsed: the words left when every run keeps its first period only, joined by
    one space.  Null and empty texts have no words, no runs and an empty collapsed text.  Repeated rows and ids stay rows
    of their own; a null id stays null.  Other columns are not read.  An empty table gives no rows.
    """
    base(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _Numbers()
            words = [data.split() for data in text_bytes(batch["text"])]
            found = find_runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
            collapsed = []
            for w, runs in zip(words, found, strict=True):
                if len(runs):
                    drop = np.zeros(len(w) + 1, np.int64)
                    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                collapsed.append(b" ".join(w))
            flat, ends = np.concatenate(found), np.cumsum([0, *map(len, found)], dtype=np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n_words": pa.array(map(len, words), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
            })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(slim, run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten, by the crc32 of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")
    changed = F.expr("array_join(transform(__w, (w, i) -> if(i < __a, w, __w[CAST(__a + (i - __a) % __p AS INT)])), ' ')")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("__h"))
    some = some.withColumn("__w", F.when(F.col("__h") % 10 == 0, words)).withColumn("__g", F.expr("__h div 10"))
    some = some.withColumn("__a", F.when(F.size("__w") > 0, F.col("__g") % F.size("__w"))).withColumn("__p", F.expr("1 + (size(__w) - __a) div (3 + __g % 8)"))
    return some.select("doc_id", F.when(F.size("__w") > 0, changed).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """One row of fixed size for each row of ``periodic_runs``: the longest run and digests of the runs and the collapsed text."""
    best: Column = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return runs.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"), F.col("__best.length").alias("length"),
        (-F.col("__best.period")).alias("period"), F.expr("(1000 * __best.length) div -__best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
