"""Ranked lexical search by hashed max-sketches.

The items are the queries, in blocks of bounded size.  For a block, each document is cut down to the counts of the block's
terms (one table); corpus counts come from that table.  A document's impact of a term is what one occurrence of the
term in a query adds to its score.  A sketch folds these impacts: coordinate h holds the largest impact of the document's terms with hash
h.  One product of the sketches of a batch with the queries' counts by coordinate gives an upper bound of every score.  For
each query the documents are then rescored exactly in descending order of the bound, until it falls below the k-th score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, base, durable, plain_words, text_bytes

K = 10
COORDINATES = 1024
BLOCK_BYTES = 1_000_000  # item text of one block
STEP = 32  # documents rescored at once
PARTS = 64  # of an item's candidates, by document
SCALE = 1_000_000_000


def vocabulary(texts: list[bytes]) -> tuple[dict[bytes, int], list[Counter]]:
    """Numbers of the terms of some items, and each item's terms with their counts."""
    numbers: dict[bytes, int] = {}
    return numbers, [Counter(numbers.setdefault(w, len(numbers)) for w in plain_words(t)) for t in texts]


def reduced(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and tf (those with numbers, ascending) of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, counts = [], [], []
            for data in text_bytes(batch["text"]):
                words = plain_words(data)
                known = sorted((numbers[w], c) for w, c in Counter(words).items() if w in numbers)
                n.append(len(words))
                ids.append([i for i, _ in known])
                counts.append([c for _, c in known])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n": pa.array(n, pa.int64()), "terms": pa.array(ids, pa.list_(pa.int32())), "tf": pa.array(counts, pa.list_(pa.int64())),
            })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(slim, run, "doc_id long, n long, terms array<int>, tf array<long>").where("n > 0")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


class Block:
    """The queries of a block against batches of documents, with the best scores so far."""

    def __init__(self, queries: list[Counter], weight: np.ndarray, documents: int, terms: int, k: int = K, coordinates: int = COORDINATES):
        self.weight, self.documents, self.terms, self.k, self.coordinates = weight, documents, terms, k, coordinates
        self.place = np.fromiter((xxhash.xxh3_64_intdigest(int(t).to_bytes(8, "little")) % coordinates for t in range(len(weight))), np.int64, len(weight))
        self.queries = [(np.fromiter(q.keys(), np.int64, len(q)), np.fromiter(q.values(), np.int64, len(q))) for q in queries]
        self.counts = np.zeros((len(queries), coordinates))
        for row, (t, c) in zip(self.counts, self.queries, strict=True):
            np.add.at(row, self.place[t], c)
        self.best: list[list[tuple[int, tuple, int]]] = [[] for _ in queries]
        self.seen = self.rescored = 0

    def add(self, ids: list, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """A batch of documents; ``rows``: the document of each of its (term, tf)."""
        m = 25 + (75 * n * self.documents) // self.terms
        impact = self.weight[terms] * ((SCALE * tf) // (1000 * tf + 8 * m[rows]))
        sketch = np.zeros((len(ids), self.coordinates))
        np.maximum.at(sketch, (rows, self.place[terms]), impact)
        bounds = sketch @ self.counts.T * (1 + 1e-9)  # above the sum's rounding
        dense = None
        self.seen += bounds.size
        for q, (mine, count) in enumerate(self.queries):
            best = self.best[q]
            bound = bounds[:, q]
            least = best[-1][0] if len(best) == self.k else 1
            may = np.flatnonzero(bound >= least)
            if not len(may):
                continue
            if dense is None:
                dense = _Rows(rows, terms, impact, len(ids), len(self.weight))
            may = may[np.argsort(-bound[may], kind="stable")]
            for a in range(0, len(may), STEP):
                if len(best) == self.k:
                    least = best[-1][0]
                if bound[may[a]] < least:
                    break
                some = may[a : a + STEP]
                self.rescored += len(some)
                scores = dense.of(some, mine) @ count
                best += [(int(s), _order(ids[d]), ids[d]) for s, d in zip(scores, some, strict=True) if s >= least]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[self.k :]


class _Rows:
    """Impacts of single documents as whole numbers."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, impact: np.ndarray, documents: int, vocabulary: int):
        self.terms, self.impact, self.size = terms, impact, vocabulary
        self.ends = np.searchsorted(rows, np.arange(documents + 1))

    def of(self, documents: np.ndarray, mine: np.ndarray) -> np.ndarray:
        out = np.zeros((len(documents), len(mine)), np.int64)
        for line, d in zip(out, documents, strict=True):
            terms = self.terms[self.ends[d] : self.ends[d + 1]]
            at = np.searchsorted(terms, mine)
            there = at < len(terms)
            there[there] = terms[at[there]] == mine[there]
            line[there] = self.impact[self.ends[d] + at[there]]
        return out


def _order(doc_id: int | None) -> tuple:
    return (doc_id is None, doc_id or 0)


def _candidates(short: DataFrame, queries: list[tuple[int, Counter]], weight: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """item row, doc_id, score: the k best documents of each task, for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block([q for _, q in queries], weight, documents, terms, k)
        for batch in batches:
            lists = batch["terms"]
            sizes = np.diff(lists.offsets.to_numpy())
            if len(lists.flatten()):
                block.add(
                    batch["doc_id"].to_pylist(), batch["n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes),
                    lists.flatten().to_numpy().astype(np.int64), batch["tf"].flatten().to_numpy(),
                )
        for (row, _), best in zip(queries, block.best, strict=True):
            yield pa.RecordBatch.from_pydict({
                "__item": pa.array([row] * len(best), pa.int64()), "doc_id": pa.array([d for _, _, d in best], pa.int64()), "score": pa.array([s for s, _, _ in best], pa.int64()),
            })

    return arrow_map(short, run, "__item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 of every row of ``items``.

    Equal scores go by ascending doc_id, null ids last.  Rows that repeat an id or a text are documents, or items, of their own.
    Null and empty texts have no terms: such documents count for nothing, such items have no rows; with empty tables there are no rows.
    Other columns are not read.  Items are taken in blocks of about ``block_bytes`` of text; every block reads all documents.
    """
    spark = base(docs.sparkSession)
    rows = durable(items.select("item_id", "text").withColumn("__item", F.monotonically_increasing_id()).withColumn("__bytes", F.coalesce(F.octet_length("text"), F.lit(0))))
    size = rows.agg(F.sum("__bytes")).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    found = None
    for b in range(blocks):
        # about block_bytes of text, or one longer item
        mine = rows.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == b).select("__item", "text").collect()
        numbers, queries = vocabulary([(r["text"] or "").encode() for r in mine])
        asked = [(r["__item"], q) for r, q in zip(mine, queries, strict=True) if q]
        if not asked:
            continue
        short = durable(reduced(docs, numbers))
        documents, terms = short.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = np.zeros(len(numbers), np.int64)
        for r in short.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
            df[r["t"]] = r["count"]
        part = durable(_candidates(short, asked, weights(df, documents), documents, terms, k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "__item long, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # the lists of all tasks meet in two steps
    part = found.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("__item", "__part").orderBy(*order))).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("__item").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(rows.select("__item", "item_id"), "__item").select("item_id", "rank", "doc_id", "score")
