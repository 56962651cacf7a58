"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Words of all items are numbered; the automaton accepts every run of words of an item.  A document streams its words
through it and keeps the longest run that ends at each word.  Where that run has a whole window (13 words, or a
shorter item whole) the window's words are hit, and the items that hold the window are those of the state reached.
Words that no item has end a run, so only stretches of item words that can hold a window are walked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, durable, free_name, plain_words, text_bytes

WINDOW = 13
ITEM_BYTES = 2_000_000  # item text per automaton; more items are walked in further passes
ROW = "__row"
RESULT = "__row long, doc_id long, n_words long, spans array<long>, items array<string>"


class Automaton:
    """States of the item words' runs, with suffix links, the items of each state's window and the short items that end there."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        self.names: list[str] = []
        texts = []
        for name, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab)) for w in plain_words(text)]
            if words:
                self.names.append(name)
                texts.append(words)
        for k, words in enumerate(texts):
            last = 0
            for w in words:
                last = self._extend(last, w, own)
                own[last].add(k)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in order:  # a state's items are those of all that have it as a suffix; short suffixes aren't asked for
            if self.length[self.link[v]] >= window:
                own[self.link[v]] |= own[v]
        self.items = [frozenset(s) for s in own]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.link]  # (length, item) of short items whose whole run is in the state
        self.least = window
        for k, words in enumerate(texts):
            if len(words) < window:
                v = 0
                for w in words:
                    v = self.next[v][w]
                self.short[v].append((len(words), k))
                self.least = min(self.least, len(words))
        self.short_up = [False] * len(self.link)
        for v in reversed(order):
            self.short_up[v] = bool(self.short[v]) or self.short_up[self.link[v]]

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # the run exists already: split its state if it holds longer runs
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, own)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w: int, q: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append(set())
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint hit spans (first word, end) and the items with an occurring window."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._walk(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _walk(self, run: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = n = 0
        for i, w in enumerate(run, at + 1):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            hit = 0
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.items[u]
                hit = window
            if self.short_up[v]:
                u = v
                while u > 0:
                    for size, k in self.short[u]:
                        if size <= n:
                            found.add(k)
                            hit = max(hit, size)
                    u = link[u]
            if hit:
                first = i - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))


def _groups(items: DataFrame) -> tuple[int, DataFrame]:
    """Number of groups and the distinct items with their group ``g``: about ITEM_BYTES of text in each; one group unless the benchmark outgrows one automaton."""
    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // ITEM_BYTES))
    return n, rows.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))


def _listed(rows: DataFrame) -> list[tuple[str, bytes]]:
    return [(r["item_id"], r["text"].encode()) for r in rows.orderBy("item_id", "text").collect()]  # about ITEM_BYTES at most


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, row: str | None = None) -> DataFrame:
    """ROW, doc_id, n_words, spans (flat pairs of word positions), items (ids with an occurring window) of every document.

    ROW is the column ``row`` of ``docs``, else a number made here; a column of that name is not read.
    """
    spark = docs.sparkSession
    n, rows = _groups(items)
    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    numbered = docs.select(number.alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n > 1:
        numbered = durable(numbered)
    out = None
    for g in range(n):
        part = arrow_map(numbered, _matcher(spark.sparkContext.broadcast(_listed(rows.where(F.col("g") == g))), window), RESULT)
        out = part if out is None else out.unionByName(part)
    if n > 1:
        out = out.groupBy(ROW, "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return out


_BUILT: dict[str, Automaton] = {}


def _automaton(group: list[tuple[str, bytes]], window: int) -> Automaton:
    """One per worker process and item list."""
    key = hashlib.sha1(repr((window, group)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(group, window)
    return _BUILT[key]


def _matcher(shared, window: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared.value, window)
        for batch in batches:
            n_words, spans, names = [], [], []
            for data in text_bytes(batch["text"]):
                words = plain_words(data)
                found, items = auto.matches(words)
                n_words.append(len(words))
                spans.append([x for s in found for x in s])
                names.append(sorted({auto.names[k] for k in items}))
            yield pa.RecordBatch.from_pydict({
                ROW: batch[ROW], "doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(names, pa.list_(pa.string())),
            })

    return match


def _covered(spans: list[int]) -> int:
    total, end = 0, -1
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = 20, row: str | None = None) -> DataFrame:
    """ROW, doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and coverage * n_hit >= n_words).

    Null and empty texts have no words; items without words or id have no windows; repeated items count once by id; repeated
    documents are reported each.  With several item groups, spans of one document are merged.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [_covered(s) for s in batch["spans"].to_pylist()]
            names = [sorted(x) for x in batch["items"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                ROW: batch[ROW], "doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(map(len, names), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                "contaminated": pa.array([h > 0 and coverage * h >= w for h, w in zip(hit, batch["n_words"].to_pylist(), strict=True)]),
            })

    return arrow_map(hits(docs, items, window, row), digest, "__row long, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """``docs`` without the matched spans of contaminated documents: a document over the coverage limit loses the text of its
    spans, one whose words are all hit is left out, all others stay as they are.

    Null and empty texts have no words and stay; repeated rows are cut each.  Works for any number of item groups.
    """
    row, found = free_name(docs, "__row"), free_name(docs, "__spans")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = hits(numbered, items, window, row).select(F.col(ROW).alias(row), F.struct("n_words", "spans").alias(found))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for data, hit in zip(text_bytes(batch["text"]), batch[found].to_pylist(), strict=True):
                own = _merged(hit["spans"])
                n = sum(b - a for a, b in own)
                over = n > 0 and coverage * n >= hit["n_words"]
                keep.append(not over or n < hit["n_words"])
                texts.append(_without(data, own).decode() if over and keep[-1] else None)
            batch = batch.select(docs_columns)
            at = batch.schema.get_field_index("text")
            new = pa.array([o if t is None else t for o, t in zip(batch["text"].to_pylist(), texts, strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new).filter(pa.array(keep, pa.bool_()))

    docs_columns = docs.columns
    return arrow_map(numbered.join(spans, row), cut, docs.schema)


def _merged(spans: list[int]) -> list[tuple[int, int]]:
    """Flat pairs as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join((*out, data[done:]))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """``docs`` without contaminated documents; columns and other rows as they were.

    Null and empty texts have no words and stay; repeated rows are judged each.
    """
    n, rows = _groups(items)
    if n > 1:  # a document can reach the limit by several groups together
        row = free_name(docs, "__row")
        numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
        bad = report(numbered, items, window, coverage, row).where("contaminated").select(F.col(ROW).alias(row))
        return numbered.join(bad, row, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(_listed(rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared.value, window)
        for batch in batches:
            verdict = []
            for data in text_bytes(batch["text"]):
                words = plain_words(data)
                hit = sum(b - a for a, b in auto.matches(words)[0])
                verdict.append(not (hit and coverage * hit >= len(words)))
            yield batch.filter(pa.array(verdict, pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
