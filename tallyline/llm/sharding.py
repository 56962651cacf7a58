"""K-d tree sharding: documents are split at distributed weighted medians of their metadata until leaves have the target bytes.

Only DataFrame functions run here.  Every document is a point of fixed integer coordinates (text bytes, characters,
source, language, id), each 0 to 65535 in order of the value.  A node splits along the coordinate with the widest
spread of its documents, at the byte-weighted median.  A split position is a 60-bit number: 16 bits coordinate,
24 bits text hash (so equal texts stay side by side), 20 bits hash of the row's number (so that a hot group can be cut).  The median
is found 12 bits at a time from sums per digit, so a pass moves at most 4096 sums per node and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import durable
from tallyline.llm.numbering import number_rows

DIGITS = 5
BITS = 12
CELLS = 65_536
AXES = ("a_size", "a_chars", "a_source", "a_lang", "a_id")


def _hash(column: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)


def _cell(value: Column, low, high) -> Column:
    """0..65535 in order of the value; null is 0."""
    span = max(1.0, float((high or 0) - (low or 0)))
    return F.coalesce(F.floor((value - F.lit(low or 0)) / F.lit(span) * (CELLS - 1)), F.lit(0)).cast("int")


def points(docs: DataFrame) -> DataFrame:
    """uid, doc_id, size, text_crc32, tie (44 bits) and the coordinates; null text has size 1 and the empty text's crc."""
    text = F.coalesce(F.col("text"), F.lit(""))
    have = set(docs.columns)
    col = lambda name, kind: (F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.coalesce(col("n_chars", "long"), F.char_length(text).cast("long")).alias("n_chars"),
        _hash(F.coalesce(col("source", "string"), F.lit("")), 16).cast("int").alias("a_source"),
        _hash(F.coalesce(col("lang", "string"), F.lit("")), 16).cast("int").alias("a_lang"),
    )
    slim = durable(slim.withColumn("uid", F.monotonically_increasing_id()))
    low = slim.agg(*[f(c).alias(f"{n}_{c}") for c in ("doc_id", "size", "n_chars") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    tie = F.shiftleft(F.shiftrightunsigned("h", 40), 20).bitwiseOR(_hash(F.col("uid"), 20))
    log = lambda c: F.log2(F.greatest(F.col(c), F.lit(0)) + 1.0)
    out = slim.select(
        "uid", "doc_id", "size", "text_crc32", tie.alias("tie"), "a_source", "a_lang",
        _cell(log("size"), 0.0, 40.0).alias("a_size"), _cell(log("n_chars"), 0.0, 40.0).alias("a_chars"),
        _cell(F.col("doc_id"), low["lo_doc_id"], low["hi_doc_id"]).alias("a_id"),
    )
    return out, int(low["n"]), int(low["bytes"] or 0)


def _pick(column: dict[int, int | str], name: str = "node") -> Column:
    """A choice by node; there are as many branches as nodes, at most the number of leaves."""
    out = None
    for node, value in column.items():
        value = F.col(value) if isinstance(value, str) else F.lit(value)
        out = F.when(F.col(name) == node, value) if out is None else out.when(F.col(name) == node, value)
    return out


def kd_shards(docs: DataFrame, leaves: int) -> DataFrame:
    """doc_id, size, text_crc32, shard (0..leaves-1), slot (gapless within the shard).

    Nulls: a null text has size 1; null coordinates are the lowest; a null id is kept.  Repeated rows are kept
    as rows of their own.  An empty table gives no rows.  Other columns are not read.
    """
    rows, n, total = points(docs)
    rows = durable(rows.withColumn("node", F.lit(0)))
    spans = {0: (0, leaves)}  # node -> first leaf, number of leaves
    while n and any(k > 1 for _, k in spans.values()):
        rows, spans = _split(rows, spans)
    shard = _pick({node: first for node, (first, _) in spans.items()})
    placed = durable(rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "uid"))
    return number_rows(placed, ["shard"], ["uid"], "slot", n).drop("uid")


def _split(rows: DataFrame, spans: dict) -> tuple[DataFrame, dict]:
    open_nodes = [k for k, (_, m) in spans.items() if m > 1]
    stats = rows.where(F.col("node").isin(open_nodes)).groupBy("node").agg(
        F.sum("size").alias("bytes"), *[(F.max(a) - F.min(a)).alias(a) for a in AXES]
    ).collect()  # one row per node, at most the number of leaves
    axis = {r["node"]: max(AXES, key=lambda a: r[a]) for r in stats}
    # bytes that belong left of the cut: the left child's share of the leaves
    goal = {r["node"]: r["bytes"] * (spans[r["node"]][1] // 2) / spans[r["node"]][1] for r in stats}
    key = F.shiftleft(_pick(axis).cast("long"), 44).bitwiseOR(F.col("tie"))
    work = rows.where(F.col("node").isin(list(axis))).select("node", "size", key.alias("key"))
    prefix, before = dict.fromkeys(axis, 0), dict.fromkeys(axis, 0)
    for digit in range(DIGITS):
        shift = BITS * (DIGITS - 1 - digit)
        inside = work if digit == 0 else work.where(F.shiftrightunsigned("key", shift + BITS) == _pick(prefix).cast("long"))
        sums = inside.groupBy("node", F.shiftrightunsigned("key", shift).bitwiseAND((1 << BITS) - 1).alias("d")).agg(F.sum("size").alias("s"))
        run = F.sum("s").over(Window.partitionBy("node").orderBy("d"))
        upto = sums.select("node", "d", "s", run.alias("run")).withColumn("goal", _pick({k: float(goal[k] - before[k]) for k in axis}))
        cut = upto.where("run >= goal").groupBy("node").agg(F.min(F.struct("d", "run", "s")).alias("c")).collect()
        for r in cut:
            prefix[r["node"]] = (prefix[r["node"]] << BITS) | r["c"]["d"]
            before[r["node"]] += r["c"]["run"] - r["c"]["s"]
    nodes, new = {}, {}
    for node, (first, m) in spans.items():
        left = 2 * node + 1
        if node in axis:
            new[left], new[left + 1] = (first, m // 2), (first + m // 2, m - m // 2)
        elif m == 1:
            new[node] = (first, m)
    whole = F.shiftleft(_pick(axis).cast("long"), 44).bitwiseOR(F.col("tie"))
    side = F.when(F.col("node").isin(list(axis)), F.col("node") * 2 + F.when(whole <= _pick(prefix).cast("long"), 1).otherwise(2)).otherwise(F.col("node"))
    return durable(rows.withColumn("node", side.cast("int"))), new
