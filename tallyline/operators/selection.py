"""Qualified choices, rankings, skylines and greedy selection under caps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.admission import BLOCK as ROWS
from tallyline.operators.admission import admit
from tallyline.operators.scan import rcount, running
from tallyline.session import durable

# The three lexicographic orders of a choice; a leading minus means descending.
CHEAPEST = ("cost", "tokens", "context", "failure", "-quality", "p95", "provider", "name")
TOKEN_FIRST = ("tokens", "cost", "context", "p95", "provider", "name")
HIGHEST_QUALITY = ("-quality", "p95", "cost", "tokens", "context", "failure", "provider", "name")


def qualified(profiles: DataFrame, quality: str, floor: str, p95: str, task_deadline: str,
              run_deadline: str) -> DataFrame:
    """Profiles at or above the floor that fit the tighter deadline."""
    limit = F.least(F.coalesce(task_deadline, run_deadline), F.col(run_deadline))
    return profiles.where((F.col(quality) >= F.col(floor)) & (F.col(p95) <= limit))


def best(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str], options: DataFrame | None = None,
         on: Sequence[str] = ()) -> DataFrame:
    """First row per key by a lexicographic order, as one partial aggregate.

    With ``options``, a row of ``df`` (keys, on) may take any of the options of its ``on``, which hold the columns of ``order`` and ``keep``.
    They are numbered in order once, and a key takes its least number: no task sorts the pairs of rows and options.
    """
    parts = [
        (-F.col(o[1:]) if o.startswith("-") else F.col(o)).alias(f"o{i}") for i, o in enumerate(order)
    ]
    if options is None:
        top = F.min(F.struct(*parts, *[F.col(k).alias(f"k_{k}") for k in keep]))
        return df.groupBy(*keys).agg(top.alias("__b")).select(*keys, *[F.col(f"__b.k_{k}").alias(k) for k in keep])
    place = [*[f"o{i}" for i in range(len(order))], *keep]
    ranked = options.select(*dict.fromkeys([*on, *keep]), *parts).repartitionByRange(*place).sortWithinPartitions(*place)
    ranked = durable(ranked.select(*dict.fromkeys([*on, *keep]), F.monotonically_increasing_id().alias("__n")))
    first = ranked.groupBy(*on).agg(F.min("__n").alias("__n"))
    least = df.select(*keys, *on).join(first, list(on)).groupBy(*keys).agg(F.min("__n").alias("__n"))
    return least.join(ranked.select("__n", *keep), "__n").select(*keys, *keep)


def ready_rank(tasks: DataFrame, keys: Sequence[str], protected: str, slack: str, rank: str, value: str,
               task: str) -> DataFrame:
    """Dispatch position: protected first, least slack, longest rank, highest value, id."""
    x = (
        tasks.withColumn("__class", F.when(F.col(protected), 0).otherwise(1))
        .withColumn("__rank", -F.col(rank))
        .withColumn("__value", -F.col(value))
    )
    out = running(x, keys, slack, {"position": rcount()}, tie=["__rank", "__value", task], lead=["__class"])
    return out.drop("__class", "__rank", "__value")


# --- skyline ---------------------------------------------------------------------------------------

BLOCK = 4096
_WIDE = 1e300  # sums of clipped dimensions stay finite, so the order of the sums is one of all rows


def _undominated(points: list[np.ndarray], against: list[np.ndarray]) -> np.ndarray:
    """Mask of points no row of ``against`` beats in all dimensions and betters in one; both hold one array a dimension."""
    keep = np.ones(len(points[0]), dtype=bool)
    for i in range(0, len(against[0]), 256):
        live = np.flatnonzero(keep)
        if not len(live):
            break
        beats = np.ones((256 if i + 256 <= len(against[0]) else len(against[0]) - i, len(live)), dtype=bool)
        better = np.zeros_like(beats)
        for p, a in zip(points, against, strict=True):
            mine, theirs = p[live][None, :], a[i : i + 256, None]
            beats &= theirs <= mine
            better |= theirs < mine
        keep[live[(beats & better).any(axis=0)]] = False
    return keep


def pareto(df: DataFrame, keys: Sequence[str], minimise: Sequence[str], maximise: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Vectors of a group no other vector dominates (G5); equal vectors are kept once.

    Equal vectors are merged first.  Arrow batches, each sorted so that one hot group spreads over all tasks, drop what
    their own batch dominates.  What is left is range-partitioned by a score that every dominated vector has at least
    as high as its victor, and cut into blocks in that order.  Each round merges pairs of neighbouring nodes, first
    blocks, then what earlier rounds left of two, four, eight: only the node of higher scores can lose rows, so its
    rows meet those of the lower node, in pieces of about ``block`` rows (BLOCK if none is given).  A group of n blocks takes
    log2(n) rounds, and a task holds two pieces.  Where rounds leave few rows a node is one piece; a group whose
    vectors are all undominated has to compare all its pieces once.

    Dimensions are compared in their own type, integers as int64.  A vector with a null or NaN dimension is not
    comparable: it is kept and dominates nothing.  Rows with a null key belong to no group and are left out.
    """
    keys, dims, block = list(keys), [*minimise, *maximise], block or BLOCK
    kinds = dict(df.dtypes)
    vectors = df.select(*keys, *dims).dropna(subset=keys).distinct()
    odd = F.lit(False)
    for d in dims:
        odd = odd | F.col(d).isNull() | (F.isnan(d) if kinds[d] in ("float", "double") else F.lit(False))
    schema = vectors.schema

    def columns(pdf: pd.DataFrame) -> list[np.ndarray]:
        # ~v is -v - 1: the order of integers is turned without an overflow
        turned = [~v if v.dtype.kind == "i" else -v for v in (pdf[m].to_numpy() for m in maximise)]
        return [pdf[m].to_numpy() for m in minimise] + turned

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        points = columns(pdf)
        return pdf[_undominated(points, points)]

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [own(pdf.iloc[rows]) for rows in pdf.groupby(keys, sort=False).indices.values()]
            yield pd.concat(parts) if parts else pdf

    def beaten(high: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        gone = high[~_undominated(columns(high), columns(low))] if len(high) and len(low) else high[:0]
        return gone[[*keys, *dims]]

    spread = vectors.where(~odd).repartition(*keys, F.pmod(F.xxhash64(*dims), F.lit(64)))
    left = durable(spread.sortWithinPartitions(*keys).mapInPandas(prune, schema))

    total = F.lit(0.0)
    for d in dims:
        v = F.least(F.greatest(F.col(d).cast("double"), F.lit(-_WIDE)), F.lit(_WIDE))
        total = total + (v if d in minimise else -v)
    # A victor has a sum no higher, and on equal sums comes first by the dimensions themselves.
    order = [*keys, "__score", *minimise, *[F.desc(m) for m in maximise]]
    placed = durable(
        left.withColumn("__score", total).repartitionByRange(*order).sortWithinPartitions(*order).drop("__score")
        .withColumn("__run", F.call_function("div", F.monotonically_increasing_id(), F.lit(block)))
    )
    one = Window.partitionBy(*keys).orderBy("__run")  # one row for each block of rows
    nodes = placed.select(*keys, "__run").distinct().withColumn("__node", F.row_number().over(one) - 1)
    state = placed.join(nodes, [*keys, "__run"]).drop("__run")
    state = durable(state.groupBy(*keys, "__node").applyInPandas(own, state.schema))

    depth = (state.agg(F.max("__node")).first()[0] or 0).bit_length()
    at, meet = [*keys, "__node"], [*keys, "__pair", "__i", "__j"]
    for _ in range(depth):
        pieces = state.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("__own"))
        other = pieces.select(*keys, F.col("__node").bitwiseXOR(F.lit(1)).alias("__node"), F.col("__own").alias("__there"))
        x = state.join(pieces.join(other, at), at).withColumn("__pair", F.shiftright("__node", 1))
        mine, theirs = F.pmod(F.xxhash64(*dims), F.col("__own")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("__there") - 1))
        upper = x.where("__node % 2 = 1").select(*keys, *dims, "__pair", mine.alias("__i"), theirs.alias("__j"))
        lower = x.where("__node % 2 = 0").select(
            *[F.col(c).alias(c) for c in (*keys, *dims, "__pair")], theirs.alias("__i"), mine.alias("__j")
        )
        gone = upper.groupBy(*meet).cogroup(lower.groupBy(*meet)).applyInPandas(beaten, schema)
        kept = state.join(gone.distinct(), [*keys, *dims], "left_anti")
        state = durable(kept.withColumn("__node", F.shiftright("__node", 1)))
    return state.drop("__node").unionByName(vectors.where(odd))


# --- first fit -------------------------------------------------------------------------------------

def first_fit(
    items: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: str,
    sizes: Sequence[str],
    caps: Sequence[str],
    block: int = ROWS,
) -> DataFrame:
    """Greedy admission in order: an item is taken when every size still fits, else skipped.

    Groups of every size go through ``admission.admit``; ties of the order go by item.  (keys, item, admitted).
    """
    return admit(items, None, keys, [*order, item], item, sizes, caps, block)


def fraction_digits(top: Column, bottom: Column) -> list[Column]:
    """Columns that order the fractions top / bottom exactly, for int64 tops and bottoms from 1 up to 5 * 2**63.

    The quotient and three groups of 18 digits after it: different fractions differ by more than 10**-54.
    """
    wide = "decimal(38,0)"
    bottom, scale = bottom.cast(wide), F.lit(10**18).cast(wide)
    rest = F.pmod(top.cast(wide), bottom)
    out = [((top.cast(wide) - rest) / bottom).cast(wide)]
    for _ in range(3):
        scaled = (rest * scale).cast(wide)  # a remainder is below 5e19: 38 digits
        rest = F.pmod(scaled, bottom).cast(wide)
        out.append(((scaled - rest) / bottom).cast(wide))
    return out


def pack_context(blocks: DataFrame, budgets: DataFrame, key: str, block: int = ROWS) -> DataFrame:
    """Every block of every context with its inclusion and reason.

    ``blocks``: key, ref, bytes, tokens, value, mandatory, valid; ``budgets``: key, max_bytes, max_tokens.
    All mandatory blocks must be valid and fit together, else the context is refused; optional blocks enter
    by value density (value over bytes + 4 tokens), highest first, while they fit.
    """
    m = F.col("mandatory")
    total = blocks.groupBy(key).agg(
        *[F.sum(F.when(m, F.col(c).cast("decimal(38,0)")).otherwise(0)).alias(n) for c, n in (("bytes", "__mb"), ("tokens", "__mt"))],
        F.count_if(m & ~F.col("valid")).alias("__bad"),
    ).join(budgets, key)
    total = total.select(
        key, "__bad", (F.col("max_bytes") - F.col("__mb")).alias("__cb"), (F.col("max_tokens") - F.col("__mt")).alias("__ct"),
    ).withColumn("__state", F.when(F.col("__bad") > 0, "invalid").when((F.col("__cb") < 0) | (F.col("__ct") < 0), "over").otherwise("packed"))
    x = blocks.join(total, [key], "inner")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    foot = F.greatest(F.lit(1).cast("decimal(38,0)"), wide("bytes") + 4 * wide("tokens"))
    digits = [f"__density_{k}" for k in range(4)]
    optional = x.where((F.col("__state") == "packed") & ~m & F.col("valid")).withColumns(
        {n: -c for n, c in zip(digits, fraction_digits(F.col("value"), foot), strict=True)} | {"__value": -F.col("value")})
    fit = first_fit(optional, [key], [*digits, "__value", "bytes", "tokens"], "ref", ["bytes", "tokens"], ["__cb", "__ct"], block)
    out = x.join(fit, [key, "ref"], "left")
    s = F.col("__state")
    reason = (
        F.when(m & ~F.col("valid"), "required_block_invalid")
        .when(m & (s == "invalid"), "another_obligation_failed")
        .when(m & (s == "over"), "required_context_exceeds_cap")
        .when(m, "mandatory")
        .when(s != "packed", "not_evaluated_after_refusal")
        .when(~F.col("valid"), "optional_block_invalid")
        .when(F.col("admitted"), "selected_by_value_density")
        .otherwise("does_not_fit")
    )
    return out.select(key, "ref", reason.alias("reason")).withColumn("included", F.col("reason").isin("mandatory", "selected_by_value_density"))


def shed_optional(tasks: DataFrame, deps: DataFrame, key: str, block: int = ROWS) -> DataFrame:
    """Optional tasks kept by value under the headroom, then dropped with what they depend on (T4).

    ``tasks``: key, task_id, value, use, headroom (optional tasks only); ``deps``: key, task_id, dep_id.
    """
    from tallyline.operators.graph import closure

    x = tasks.withColumn("__value", -F.col("value"))
    fit = durable(first_fit(x, [key], ["__value", "task_id"], "task_id", ["use"], ["headroom"], block))
    shed = fit.where("not admitted").select(key, F.col("task_id").alias("node"))
    among = deps.join(fit.select(key, "task_id"), [key, "task_id"], "left_semi")
    hit = closure(among.select(key, F.col("dep_id").alias("src"), F.col("task_id").alias("dst")), shed, [key])
    gone = hit.select(key, F.col("node").alias("task_id"), F.lit(True).alias("__gone"))
    return fit.join(gone, [key, "task_id"], "left").select(key, "task_id", F.col("admitted").alias("fits"),
                                                            (F.col("admitted") & F.col("__gone").isNull()).alias("kept"))
