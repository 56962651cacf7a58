"""Closures, levels, longest paths and cascades over edge tables.

A key (a run) of at most ``block`` rows, nodes and edges together, is walked by one task: rows are dealt and sorted by key
once and a task holds one key at a time, so the work does not follow the depth of the graphs.  Keys above that walk a
frontier: one equi join and one partial aggregate per level, the level kept as a table in the shared folder; they advance
together, so rounds follow the deepest of them.  There a frontier holds a node once, so a node with very many edges is a
one-to-many join whose large side AQE splits (``session.RUNTIME``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tallyline.functions.columns import ceil_div
from tallyline.session import durable

COMPACT = 16
BLOCK = 50_000
BITS = {ByteType(): 7, ShortType(): 15, IntegerType(): 31, LongType(): 63}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _known(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _parts(rows: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of keys of at most ``block`` rows, and of the others if there are any."""
    big = durable(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block).select(*keys))
    if big.isEmpty():
        return rows, None
    return rows.join(big, keys, "left_anti"), rows.join(big, keys, "left_semi")


def _values(column: pa.Array) -> list:
    """``to_pylist``; whole numbers go through numpy, which takes a tenth of the time."""
    if not pa.types.is_integer(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _fold(rows: DataFrame, keys: list[str], out: DataFrame, walk: Callable[[list[tuple]], Iterable[tuple]]) -> DataFrame:
    """``walk`` over the rows (without their keys) of every key, as rows of the schema of ``out``; keys are not null."""
    n, schema = len(keys), out.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, types = None, [], None

        def made(found: list[tuple]) -> pa.RecordBatch:
            cols = zip(*found, strict=True) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)

        for batch in batches:
            cols = [_values(c) for c in batch.columns]
            types = [batch.schema.field(c).type for c in schema.names]
            ids = list(zip(*cols[:n], strict=True))
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)] if ids else []
            found = []
            for lo, hi in pairwise(cuts):
                if ids[lo] != key:
                    found += [(*key, *r) for r in walk(held)] if held else []
                    key, held = ids[lo], []
                held += zip(*[c[lo:hi] for c in cols[n:]], strict=True)
            yield made(found)
        if held:
            yield made([(*key, *r) for r in walk(held)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold, schema)


def _reach(rows: list[tuple]) -> Iterator[tuple]:
    """Nodes of one key reachable from its seeds; an end that is not known is found anew by each level."""
    ahead, level = defaultdict(list), set()
    for node, dst, seed in rows:
        if seed:
            level.add(node)
        else:
            ahead[node].append(dst)
    seen = set()
    while level:
        seen |= level
        yield from ((node,) for node in level)
        found = {dst for node in level if node is not None for dst in ahead.get(node, ())}
        level = {dst for dst in found if dst is None or dst not in seen}


def closure(edges: DataFrame, seeds: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Nodes reachable from ``seeds`` (keys, node) along ``edges`` (keys, src, dst), seeds included."""
    keys = list(keys)
    kind = seeds.select("node").union(edges.select("src")).union(edges.select("dst")).schema["node"].dataType
    node = lambda c, name: F.col(c).cast(kind).alias(name)
    starts = seeds.select(*keys, node("node", "node")).distinct()
    hops = edges.where(_known([*keys, "src"])).select(*keys, node("src", "node"), node("dst", "dst"), F.lit(False).alias("seed"))
    rows = durable(hops.unionByName(starts.where(_known(keys)).select(*keys, "node", F.lit(None).cast(kind).alias("dst"), F.lit(True).alias("seed"))))
    small, big = _parts(rows, keys, block)
    found = [_fold(small, keys, rows.select(*keys, "node"), _reach), starts.where(~_known(keys))]
    if big is not None:
        found.append(_reach_rounds(big.where("not seed").withColumnRenamed("node", "src"), big.where("seed"), keys))
    return _union(found)


def _reach_rounds(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    edges = durable(edges.select(*keys, "src", "dst").distinct())
    frontier = durable(seeds.select(*keys, "node"))
    seen = [frontier]
    while not frontier.isEmpty():
        step = edges.join(frontier.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
        found = step.select(*keys, F.col("dst").alias("node")).distinct()
        frontier = durable(found.join(_union(seen), [*keys, "node"], "left_anti"))
        seen.append(frontier)
        if len(seen) > COMPACT:
            seen = [durable(_union(seen))]
    return _union(seen)


def levels(edges: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Topological level of every node on an edge src -> dst; NULL for nodes on or behind a cycle."""
    keys = list(keys)
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = back.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("__one", F.lit(1).cast("long"))
    return longest_path(nodes, back, keys, "__one", block).select(*keys, "node", (F.col("rank") - 1).alias("level"))


def longest_path(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], weight: str, block: int = BLOCK) -> DataFrame:
    """Own weight plus the heaviest chain of what follows along src -> dst; NULL on overflow.

    ``nodes``: keys, node, weight; unknown edge ends are ignored.  Nodes on a cycle, or with one ahead of them, have no
    heaviest chain: their rank is NULL, and the other nodes keep theirs.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in nodes.schema}
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = nodes.select(*keys, "node", blank(kinds["node"], "dst"), F.col(weight).alias("rank"))
    hops = edges.where(_known([*keys, "src", "dst"])).select(*keys, F.col("src").alias("node"), "dst", blank(kinds[weight], "rank"))
    known = _known([*keys, "node"])
    rows = durable(own.where(known).unionByName(hops))
    bits = BITS.get(kinds[weight])
    small, big = _parts(rows, keys, block)
    found = [_fold(small, keys, rows.select(*keys, "node", "rank"), lambda held: _peel(held, bits)),
             own.where(~known).select(*keys, "node", blank(kinds[weight], "rank"))]
    if big is not None:
        ends = big.where("dst is not null").withColumnRenamed("node", "src")
        found.append(_peel_rounds(big.where("dst is null").select(*keys, "node", "rank"), ends.select(*keys, "src", "dst"), keys))
    return _union(found).select(*[F.col(c).cast(kinds[c]).alias(c) for c in (*keys, "node")], "rank")


def _peel(rows: list[tuple], bits: int | None) -> Iterator[tuple]:
    """Ranks of the nodes of one key, by the rounds of ``_peel_rounds``; ``bits``: the width of whole numbers."""
    own, edges = defaultdict(list), set()
    for node, dst, weight in rows:
        if dst is None:
            own[node].append(weight)
        else:
            edges.add((node, dst))
    into, ahead = defaultdict(list), defaultdict(int)
    for src, dst in edges:
        if src in own and dst in own:
            into[dst] += [(src, weight) for weight in own[src]]
            ahead[src] += len(own[src])
    last = [(node, weight) for node, weights in own.items() if node not in ahead for weight in weights]
    best, open_ = defaultdict(list), {}  # open: nodes of which some successors are ranked: how many, and the best so far
    while last:
        met = {}
        for node, rank in last:
            best[node].append(rank)
            for src, weight in into.get(node, ()):
                step = None if rank is None or weight is None else weight + rank
                if step is not None and bits and not -(1 << bits) <= step < 1 << bits:
                    step = None
                seen, top = open_.get(src, (0, step))
                open_[src] = met[src] = (seen + 1, None if step is None or top is None else max(step, top))
        last = [(node, top) for node, (seen, top) in met.items() if seen == ahead[node]]
        for node, (seen, _) in met.items():
            if seen >= ahead[node]:
                del open_[node]
    for node, weights in own.items():
        for _ in weights:
            yield from ((node, rank) for rank in best.get(node, (None,)))


def _peel_rounds(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """One peel from the last nodes: a node is ranked in the round in which the last of its successors was, so an edge is
    read by one round and a round writes one table.
    """
    own = nodes.select(*keys, "node", "rank", F.col("rank").isNull().alias("bad"))
    w = nodes.select(*keys, F.col("node").alias("src"), F.col("rank").alias("__w"))
    ends = nodes.select(*keys, F.col("node").alias("dst"))
    hops = edges.select(*keys, "src", "dst").distinct().join(w, [*keys, "src"]).join(ends, [*keys, "dst"], "left_semi")
    hops = durable(hops)
    ahead = durable(hops.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("__ahead")))
    ranked = [durable(own.join(ahead, [*keys, "node"], "left_anti"))]
    open_ = None  # nodes of which some successors are ranked: how many, and the best so far
    while not ranked[-1].isEmpty():
        last = ranked[-1].select(*keys, F.col("node").alias("dst"), "rank", "bad")
        step = F.try_add(F.col("__w"), F.col("rank"))
        found = hops.join(last, [*keys, "dst"]).select(
            *keys, F.col("src").alias("node"), F.lit(1).cast("long").alias("__seen"), step.alias("rank"), (F.col("bad") | step.isNull()).alias("bad"))
        found = found if open_ is None else found.unionByName(open_.select(*found.columns))
        state = found.groupBy(*keys, "node").agg(F.sum("__seen").alias("__seen"), F.max("rank").alias("rank"), F.bool_or("bad").alias("bad"))
        state = durable(state.join(ahead, [*keys, "node"]))
        open_ = state.where("__seen < __ahead")
        ranked.append(state.where("__seen = __ahead").select(*keys, "node", "rank", "bad"))
        if len(ranked) > COMPACT:
            ranked = [durable(_union(ranked[:-1])), ranked[-1]]
    best = _union(ranked).select(*keys, "node", F.when(~F.col("bad"), F.col("rank")).alias("rank"))
    return own.select(*keys, "node").join(best, [*keys, "node"], "left")


def critical_path(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], weight: str, block: int = BLOCK) -> DataFrame:
    """Heaviest chain per run, NULL where a node on any chain is undefined or overflows."""
    r = longest_path(nodes, edges, keys, weight, block)
    return r.groupBy(*keys).agg(F.when(F.count_if(F.col("rank").isNull()) == 0, F.max("rank")).alias("critical_path"))


def transfer_ms(size: Column, bandwidth: Column) -> Column:
    """ceil(bytes * 8000 / bandwidth); 0 for nothing to move, NULL at zero bandwidth or overflow."""
    bits = F.try_multiply(size, F.lit(8000).cast("long"))
    return F.when(size == 0, F.lit(0).cast("long")).when(bandwidth > 0, F.when(bits.isNotNull(), ceil_div(bits, F.when(bandwidth > 0, bandwidth))))


def skip_cascade(edges: DataFrame, skipped: DataFrame, protected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work behind skipped work; protected work behind it refuses the run.

    ``edges``: keys, src (dependency), dst (task); ``skipped`` and ``protected``: keys, node.
    """
    hit = closure(edges, skipped, keys)
    p = protected.select(*keys, "node").distinct().withColumn("__p", F.lit(True))
    own = skipped.select(*keys, "node").distinct().withColumn("__own", F.lit(True))
    x = hit.join(p, [*keys, "node"], "left").join(own, [*keys, "node"], "left")
    reason = F.when(F.col("__p").isNotNull() & F.col("__own").isNull(), "required_dependency_skipped").when(
        F.col("__own").isNotNull(), "skipped").otherwise("dependency_skipped")
    return x.select(*keys, "node", reason.alias("reason"))
