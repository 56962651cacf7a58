"""Near-duplicate components by bottom-k sketches of one hash function.

A document is the set of its 2-word shingles, hashed to 64 bits; its sketch is the K smallest values.  Documents
with equal sets are one class from the start.

Of two sets with similarity 0.8 or more, each of the K smallest values of the union is shared with a chance of at
least 0.8, and a shared one of them is retained in both sketches.  Fewer than SHARED of 48 are shared with a chance
below 1e-9; sets of up to K values are retained whole and share a certain number.  So, with the values of a sketch
ordered rarest first, two linked sketches have two values in common among the first few (size - shared + 2): the pairs of
these are the keys of the inverted lists.  (Sets that differ share two values at least; single values would also bring
together the more unrelated texts, the larger the corpus is.)  Values that a single class holds are dropped, as are
lists with the same members as another one.

1. A list's leader is its most central member (the one whose values are held by the most classes).  Members that the sketch
   estimate allows to be near it, or that share with it as many values as a link asks for, are compared with it; the full
   sets decide and give the difference from the leader.
2. Lists that lie in one component are done: their further pairs cannot change a component.
3. Of two members x, y compared with one leader c, with r removed and a added shingles, the sets share |c| - r(x) - r(y) + s, where s
   is the number of differences they have in common.  A link of an x that c does not link needs s > (5 r(y) + 4 a(y)) / 9,
   so more than about half of y's differences: x and y meet in inverted lists of the rarest of these, in components that
   differ, where both still have enough differences left at the first one they share; s decides.
   Members that c links need no test among themselves.
4. The other members are far: they share k values with the leader, fewer than the m that any link of theirs asks for.  A link of a far
   member, to whatever member of the list, then needs m - k shared values that the leader does not have.  So far members
   meet the list's others in new inverted lists of the values outside the leader's sketch, by the rarest (outside - (m - k) + 1) of theirs;
   what many members have in common with the leader, and so with each other, brings no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, base, durable, free_name, space_words, text_bytes
from tallyline.llm.components import components, extended

K, SHARED = 48, 20
PERCENT = 80
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LIMIT = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= LIMIT:
            self.clear()
        self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes (signed) of the 2-word shingles; of the one word if there is only one; none without words."""
    words = space_words(data)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    x = _mixed(h[:-1] * _MIX[0] + ((h[1:] << np.uint64(23)) | (h[1:] >> np.uint64(41)))) if len(h) > 1 else _mixed(h + _MIX[0])
    return np.unique(x.view(np.int64))


def sketches(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, ``row`` (a column of ``docs``) as __row, n_shingles, set_hash (null for empty sets), text_hash, sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, key, sketch = [], [], []
            for data in text_bytes(batch["text"]):
                s = shingles(data, hashes)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:K])
            flat = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, sketch)], dtype=np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "__row": batch["__row"], "n_shingles": pa.array(n, pa.int64()), "set_hash": pa.array(key, pa.binary()),
                "text_hash": batch["text_hash"], "sketch": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            })

    number = F.col(row) if row else F.lit(None)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("long").alias("__row"), "text", F.xxhash64("text").alias("text_hash"))
    return arrow_map(slim, run, "doc_id long, __row long, n_shingles long, set_hash binary, text_hash long, sketch array<long>")


def _led(classes: DataFrame) -> DataFrame:
    """(v, a, b): the members b, other than its leader a, of every inverted list v."""
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    size = F.least(F.col("n"), F.lit(K))
    # at most K values of a node
    held = values.join(counts, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"), (F.sum(F.log2("df")) / F.first(size)).alias("central"))
    first = held.withColumn("first", F.size("held") - _need("n") + 2).where("first > 1")
    posted = durable(first.select("node", "central", F.transform(F.expr("slice(held, 1, CAST(least(first, size(held)) AS INT))"), lambda x: x["v"]).alias("held")))
    pairs = "flatten(transform(held, (x, i) -> transform(slice(held, i + 2, size(held)), y -> xxhash64(x, y))))"
    keys = posted.select("node", "central", F.explode(F.expr(pairs)).alias("v"))
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    lists = keys.groupBy("v").agg(F.count("*").alias("m"), mark(1).alias("one"), mark(2).alias("two"), F.max(F.struct("central", "node")).alias("top")).where("m > 1")
    alone = lists.groupBy("m", "one", "two").agg(F.min("v").alias("v"), F.max("top.node").alias("a"))
    return keys.join(alone.select("v", "a"), "v").where("node != a").select("v", "a", F.col("node").alias("b"))


def _need(n: str) -> Column:
    """Shared values of the sketches that a link of a set of ``n`` shingles asks for."""
    return F.when(100 * F.col(n) < PERCENT * K, F.ceil(F.col(n) * PERCENT / 100)).otherwise(F.lit(SHARED))


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes na, nb and the sketches sa, sb of both."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _allowed() -> Column:
    """Whether the union sketch of sa and sb allows the similarity."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return shared * K >= SHARED * F.size(union)


def _lacking() -> Column:
    """Values that a link of b needs beyond those it shares with a: of b's, as many must be outside a's sketch."""
    return _need("nb") - F.size(F.array_intersect("sb", "sa"))


def _far_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, one of them far from a leader of both, that can be linked and lie in different components.

    ``members``: a (a leader), b (a member of its open lists), met (whether the two were compared).
    """
    both = _rooted(_sketched(members, classes), roots, "b", "root").withColumn("outside", F.array_except("sb", "sa"))
    each = durable(both.select("a", "b", "nb", "root", (~F.col("met")).alias("far"), F.size("outside").alias("size"), _lacking().alias("asks"), F.explode("outside").alias("v")))
    held = each.groupBy("a", "v").agg(F.count("*").alias("df"), F.bool_or("far").alias("asked")).where("df > 1 and asked").drop("asked")
    w = Window.partitionBy("a", "b")  # at most K rows
    ranked = each.join(held, ["a", "v"]).withColumn("place", F.row_number().over(w.orderBy("df", "v")) + F.col("size") - F.count("*").over(w))
    posted = durable(ranked.where("not far or place <= size - asks + 1"))
    sided = lambda x: posted.select("a", "v", *(F.col(c).alias(c + x) for c in ("b", "nb", "root", "far")))
    sizes = 100 * F.least("nbx", "nby") >= PERCENT * F.greatest("nbx", "nby")
    once = ~F.col("fary") | (F.col("bx") < F.col("by"))
    pairs = sided("x").where("farx").join(sided("y"), ["a", "v"]).where((F.col("bx") != F.col("by")) & (F.col("rootx") != F.col("rooty")) & once & sizes)
    return pairs.select(F.least("bx", "by").alias("a"), F.greatest("bx", "by").alias("b")).distinct()


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, linked, r, added, diff of the estimated pairs: b's set against a's.

    r shingles of a are not in b, ``added`` of b are not in a; diff has both, told apart.
    """
    pairs = durable(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    where = classes.join(nodes, "node").select("node", "doc_id", "text_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = durable(texts.join(where, (texts["text_hash"] == where["text_hash"]) & texts["doc_id"].eqNullSafe(where["doc_id"])).groupBy("node").agg(F.first("text").alias("text")))
    both = pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(found.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = WordHashes(), None, None
        for batch in batches:
            linked, gone, new, diffs = [], [], [], []
            for a, ta, tb in zip(batch["a"].to_pylist(), text_bytes(batch["ta"]), text_bytes(batch["tb"]), strict=True):
                if a != last:
                    last, left = a, shingles(ta, hashes)
                right = shingles(tb, hashes)
                removed, added = np.setdiff1d(left, right, assume_unique=True), np.setdiff1d(right, left, assume_unique=True)
                common = len(left) - len(removed)
                linked.append(100 * common >= PERCENT * (len(right) + len(removed)))
                gone.append(len(removed))
                new.append(len(added))
                diffs.append(np.concatenate([removed, ~added]))
            ends = np.cumsum([0, *map(len, diffs)], dtype=np.int32)
            flat = np.concatenate(diffs) if diffs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "a": batch["a"], "b": batch["b"], "na": batch["na"], "nb": batch["nb"], "linked": pa.array(linked, pa.bool_()), "r": pa.array(gone, pa.int64()),
                "added": pa.array(new, pa.int64()), "diff": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            })

    return durable(arrow_map(both.select("a", "b", "na", "nb", "ta", "tb"), compare, "a long, b long, na long, nb long, linked boolean, r long, added long, diff array<long>"))


def _by_difference(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) of members near one leader that lie in different components."""
    placed = _rooted(_rooted(stars, roots, "a", "ra"), roots, "b", "rb")
    placed = durable(placed.select("a", "b", "na", "nb", "r", "added", "diff", "rb", (~F.col("linked") & (F.col("ra") != F.col("rb"))).alias("loose")))
    open_ = placed.where("loose").select("a").distinct()
    members = durable(placed.join(open_, "a", "left_semi"))
    parts = members.select("a", "b", "na", "nb", "r", "added", "rb", "loose", F.size("diff").alias("size"), F.explode("diff").alias("e"))
    shared = parts.join(parts.groupBy("a", "e").agg(F.count("*").alias("df")).where("df > 1"), ["a", "e"])
    w = Window.partitionBy("a", "b")  # the differences of one member
    ranked = shared.withColumn("rank", F.row_number().over(w.orderBy("df", "e"))).withColumn("alone", F.col("size") - F.count("*").over(w))
    place = F.col("rank") + F.col("alone")
    asks = F.greatest(F.lit(1), F.ceil((4 * (F.col("nb") + F.col("na")) - 9 * F.col("na") + 9 * F.col("r")) / 9))
    gives = F.floor((5 * F.col("r") + 4 * F.col("added")) / 9) + 1
    facts = ("a", "e", "b", "rb", "nb", "na", "r", "loose", (F.col("size") - place + 1).alias("rest"))
    ranked = durable(ranked.select(*facts, (F.col("loose") & (place <= F.col("size") - asks + 1)).alias("x"), (place <= F.col("size") - gives + 1).alias("y")).where("x or y"))
    sided = lambda x: ranked.where(x).select("a", "e", *(F.col(c).alias(c + x) for c in ("b", "rb", "nb", "r", "rest", "loose")), *(["na"] if x == "x" else []))
    # at the first difference two members share, neither has more left than what follows it: too few left, no link
    left = 9 * F.least("restx", "resty") >= 4 * (F.col("nbx") + F.col("nby")) + 9 * (F.col("rx") + F.col("ry") - F.col("na"))
    once = ~F.col("loosey") | (F.col("bx") < F.col("by"))
    pairs = sided("x").join(sided("y"), ["a", "e"]).where((F.col("bx") != F.col("by")) & (F.col("rbx") != F.col("rby")) & once & left)
    pairs = pairs.select("a", F.least("bx", "by").alias("bx"), F.greatest("bx", "by").alias("by")).distinct()
    side = lambda x: members.select("a", F.col("b").alias(f"b{x}"), F.col("nb").alias(f"n{x}"), F.col("r").alias(f"r{x}"), F.col("diff").alias(f"d{x}"), F.col("rb").alias(f"root{x}"), *(["na"] if x == "x" else []))
    both = pairs.join(side("x"), ["a", "bx"]).join(side("y"), ["a", "by"]).where("rootx <> rooty")
    common = F.col("na") - F.col("rx") - F.col("ry") + F.size(F.array_intersect("dx", "dy"))
    return durable(both.where(100 * common >= PERCENT * (F.col("nx") + F.col("ny") - common)).select(F.col("bx").alias("a"), F.col("by").alias("b")).distinct())


def _rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    found = roots.select(F.col("node").alias(node), F.col("root").alias("__root"))
    return rows.join(found, node, "left").withColumn(root, F.coalesce("__root", node)).drop("__root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Null and empty texts, and texts of white space alone, have an empty set and are their own component.  Repeated rows
    are rows of one class.  Extra columns are not read.  component_id is the smallest doc_id of the component.
    """
    joined = _placed(docs)
    least = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _shuffled(spark: SparkSession) -> None:
    """Joins go through shuffles: lists and sketches grow with the documents, so that broadcasts of 10 MB, several at once, fill a small driver."""
    base(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "256k")


def _placed(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, __row, n_shingles, root of every row; rows of one component have one root, rows with empty sets have none."""
    _shuffled(docs.sparkSession)
    rows = durable(sketches(docs, row))
    classes = durable(
        rows.where("set_hash is not null").dropDuplicates(["set_hash"])
        .select(F.monotonically_increasing_id().alias("node"), "set_hash", F.col("n_shingles").alias("n"), "doc_id", "text_hash", "sketch")
    )
    led = durable(_led(classes))
    met = _sketched(led.select("a", "b").distinct(), classes).where(_allowed() | (_lacking() <= 0)).select("a", "b", "na", "nb")
    stars = _compared(met, classes, docs)
    roots = durable(components(stars.where("linked").select("a", "b")))
    roots = durable(extended(roots, _by_difference(stars, roots)))
    known = stars.select("a", "b", F.lit(True).alias("__met"))
    # a leader has met its whole list, or is too far from a member, so only pairs of two other members are open; a list of two is done
    placed = _rooted(led, roots, "b", "root").join(known, ["a", "b"], "left").withColumn("met", F.col("__met").isNotNull())
    placed = durable(placed.select("v", "a", "b", "root", "met"))
    open_lists = placed.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_and("met").alias("all_met")).where("lo <> hi and not all_met").select("v")
    members = placed.join(open_lists, "v", "left_semi").select("a", "b", "met").distinct()
    rest = _sketched(_far_pairs(members, classes, roots), classes).where(_allowed()).select("a", "b", "na", "nb")
    more = _compared(rest, classes, docs).where("linked").select("a", "b")
    roots = durable(extended(roots, more))
    of_class = classes.join(roots, "node", "left").select("set_hash", F.coalesce("root", "node").alias("root"))
    return durable(rows.select("doc_id", "__row", "n_shingles", "set_hash").join(of_class, "set_hash", "left").drop("set_hash"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of several the first by row number; null ids come last.

    Rows with empty sets all stay.  Row numbers are written with the rows before anything is decided by them.
    """
    row = free_name(docs, "__row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = _placed(rows, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    keep = placed.where("root is not null").groupBy("root").agg(first).select(F.col("first.__row").alias(row))
    keep = keep.unionByName(placed.where("root is null").select(F.col("__row").alias(row)))
    return rows.join(keep, row, "left_semi").select(*docs.columns)
