"""Best-fit packing of token pieces into sequences of a fixed capacity.

The packing depends on lengths only, and a length is 1..capacity, so it is planned on the count of pieces per
length (at most ``capacity`` numbers) and then dealt to the pieces by joins:

* lengths above a third of the capacity are matched greedily, the longest with the longest partner that fits,
  at most two per sequence;
* shorter lengths, longest first, go into the sequence with the smallest gap that holds them.

A plan is a list of patterns (lengths in order, number of sequences).  A pattern uses a contiguous range of the
pieces of each of its lengths, so a piece finds its sequence from its number among the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, durable
from tallyline.llm.numbering import number_rows
from tallyline.llm.tokens import crc, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids; only documents longer than that are cut."""
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_pydict(dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "row"), zip(*rows, strict=True), strict=True)), schema=SCHEMA)

        for batch in batches:
            rows = []
            for row, (doc, ids) in zip(batch["row"].to_pylist(), encoded([batch], tokenizer), strict=True):
                view = memoryview(ids)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = view[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, crc(part), row))
            if rows:
                yield out(rows)

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return arrow_map(numbered, cut, PIECES)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have them."""
    left = {k: v for k, v in counts.items() if v > 0}
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap -> patterns with their number of sequences
    order: list[int] = []  # the gaps that occur, ascending

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((pattern, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            put(capacity - a, (a,), left[a])
            large.pop()
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            put(capacity - a - b, (a, b), n)
            left[a] -= n
            left[b] -= n
        if a == b and left[a] == 1:  # the odd one looks for a shorter partner
            if at == 0:
                put(capacity - a, (a,), 1)
                left[a] = 0
            else:
                b = large[at - 1]
                put(capacity - a - b, (a, b), 1)
                left[a] -= 1
                left[b] -= 1
        large = [k for k in large if left[k] > 0]
    for s in sorted((k for k in left if 3 * k <= capacity and left[k] > 0), reverse=True):
        need = left[s]
        while need:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                put(capacity, (), -(-need // (capacity // s)))  # open as many sequences as this length fills
                continue
            gap = order[at]
            pattern, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // s
            full = min(n, need // each)
            put(gap - each * s, pattern + (s,) * each, full)
            need -= full * each
            if full < n:
                rest = min(need, each)
                if rest:
                    put(gap - rest * s, pattern + (s,) * rest, 1)
                    need -= rest
                    full += 1
                put(gap, pattern, n - full)
    return [(p, n) for gap in order for p, n in gaps[gap] if p]


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first piece number, count, first sequence, offset, repeats per sequence) of every run in a pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        at, i = 0, 0
        while i < len(pattern):
            k = i
            while k < len(pattern) and pattern[k] == pattern[i]:
                k += 1
            length, each = pattern[i], k - i
            first = used.get(length, 0)
            out.append((length, first, n * each, sequence, at, each))
            used[length] = first + n * each
            at, i = at + each * length, k
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is its end id alone.  Repeated rows (also repeated ids) are packed each for itself.  Other
    columns are not read; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = _ranges(plan(counts, capacity))
    schema = "length long, lo long, n long, sequence long, at long, each long, bucket long"
    numbered = number_rows(cut, ["length"], ["row", "piece"], "k", sum(counts.values()))
    if not runs:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = spark.createDataFrame([(*r, 0) for r in runs], schema).drop("bucket")
    # The piece number falls into exactly one run of its length: runs of a length are a sorted array of structs.
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "sequence", "at", "each"))).alias("runs"))
    found = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("k")) & (F.col("k") < r["lo"] + r["n"])), 1)
    j = F.col("k") - F.col("r.lo")
    return numbered.join(F.broadcast(by_length), "length").withColumn("r", found).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r.sequence") + F.floor(j / F.col("r.each"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + F.pmod(j, F.col("r.each")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_texts(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """sequence_id, doc_ids (in order of their offset) and tokens: one row per sequence of at most ``capacity`` ids."""
    return pack(docs, tokenizer, capacity).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("members"), F.sum("length").alias("tokens")
    )
