"""Evidence audit: claims, contradictions, causality, as-of lookup, sealed sets, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import is_fresh
from tallyline.operators.checks import flagged, holds
from tallyline.operators.scan import rlast, running
from tallyline.session import durable


def assess_claims(claims: DataFrame, artifacts: DataFrame, as_of: Column) -> DataFrame:
    """Status of every claim by fixed precedence.

    ``claims``: claim_id, status, evidence (array), created, valid.  ``artifacts``: ref, created,
    fresh_until, valid; one row per ref.
    """
    refs = claims.select("claim_id", F.explode_outer("evidence").alias("ref")).distinct()
    known = artifacts.select("ref", F.lit(True).alias("__known"), F.col("valid").alias("__valid"),
                             is_fresh(F.col("created"), F.col("fresh_until"), as_of).alias("__fresh"))
    facts = refs.join(known, ["ref"], "left").groupBy("claim_id").agg(
        F.count("ref").alias("refs"),
        F.bool_or(F.col("ref").isNotNull() & F.col("__known").isNull()).alias("missing"),
        F.bool_or(F.col("__known").isNotNull() & ~holds(F.col("__valid"))).alias("invalid"),
        F.bool_or(F.col("__known").isNotNull() & ~holds(F.col("__fresh"))).alias("stale"),
    )
    x = claims.join(facts, "claim_id")
    status = (
        F.when(~holds(F.col("valid")), "invalid")
        .when(F.col("created") > as_of, "invalid")
        .when(F.col("status").isin("unverified", "stale", "contradicted", "retracted"), F.col("status"))
        .when((F.col("refs") == 0) | F.col("missing"), "unverified")
        .when(F.col("invalid"), "invalid")
        .when(F.col("stale"), "stale")
        .otherwise("supported")
    )
    return x.select("claim_id", "contradicts", status.alias("assessed"))


def contradictions(assessed: DataFrame) -> DataFrame:
    """Supported claims in explicit conflict, either way, with another supported claim."""
    ok = assessed.where("assessed = 'supported'").select("claim_id")
    said = assessed.select("claim_id", F.explode("contradicts").alias("other"))
    edges = said.unionByName(said.select(F.col("other").alias("claim_id"), F.col("claim_id").alias("other")))
    edges = edges.where("claim_id <> other").distinct()
    ok = durable(ok)  # read twice below
    live = edges.join(ok, ["claim_id"], "left_semi").join(ok.select(F.col("claim_id").alias("other")), ["other"], "left_semi")
    return live.groupBy("claim_id").agg(F.count("*").alias("conflicts"))


def evidence_causality(uses: DataFrame, artifacts: DataFrame, keys: Sequence[str], ident: Sequence[str], ref: str,
                       position: str, at: str, strict: bool = True) -> DataFrame:
    """Uses of missing, later-produced, or not-fresh evidence.

    ``artifacts``: keys, ref, produced_at (position of the producing event), created, fresh_until.
    """
    a = artifacts.select(*keys, ref, F.col("produced_at").alias("__p"), F.col("created").alias("__c"),
                         F.col("fresh_until").alias("__f"), F.lit(True).alias("__known"))
    x = uses.join(a, [*keys, ref], "left")
    late = (F.col("__p") >= F.col(position)) if strict else (F.col("__p") > F.col(position))
    late = F.col("__p").isNull() | late  # no producing event: never produced before a use
    code = (
        F.when(F.col("__known").isNull(), "missing_evidence_artifact")
        .when(late, "evidence_causality_violation")
        .when(~holds(is_fresh(F.col("__c"), F.col("__f"), F.col(at))), "stale_or_future_evidence")
    )
    return x.select(*keys, *ident, ref, code.alias("code")).where("code is not null")


def lineage_order(artifacts: DataFrame, events: DataFrame, ref: str, parents: str, producer: str, event: str,
                  position: str, at: str) -> DataFrame:
    """Parents must be known and produced earlier; an artifact may not predate its producer."""
    e = events.select(F.col(event).alias(producer), F.col(position).alias("__pos"), F.col(at).alias("__at"))
    x = artifacts.join(e, [producer], "left")
    own = x.select(ref, F.when(F.col("__pos").isNull(), "artifact_producer_mismatch")
                   .when(F.col("created") < F.col("__at"), "artifact_time_causality").alias("code")).where("code is not null")
    links = x.select(ref, F.col("__pos").alias("__mine"), F.explode(parents).alias("__parent"))
    up = x.select(F.col(ref).alias("__parent"), F.col("__pos").alias("__theirs"), F.lit(True).alias("__known"))
    y = links.join(up, ["__parent"], "left")
    code = F.when(F.col("__known").isNull(), "missing_artifact_parent").when(
        F.col("__theirs").isNull() | F.col("__mine").isNull() | (F.col("__theirs") >= F.col("__mine")), "artifact_lineage_causality"
    )
    return own.unionByName(y.select(ref, code.alias("code")).where("code is not null"))


def as_of_lookup(calls: DataFrame, snapshots: DataFrame, keys: Sequence[str], at: str, ident: Sequence[str],
                 bits: int = 21) -> DataFrame:
    """Newest snapshot at or before each call, and whether it is still valid.

    ``snapshots``: keys, snapshot_at, valid_until, digest.  Both sides form one timeline that is scanned in
    chunks, so no call is paired with more than one snapshot.
    """
    snap = F.struct("snapshot_at", "valid_until", "digest")
    # Equal times of one key keep the snapshot with the largest digest.
    s = snapshots.groupBy(*keys, "snapshot_at").agg(F.max(snap).alias("__s")).select(
        *keys, F.col("snapshot_at").alias("__at"), F.lit(0).alias("__side"), "__s", F.lit(None).cast(calls.select(F.struct(*ident, at)).schema[0].dataType).alias("__call")
    )
    c = calls.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"),
                     F.lit(None).cast(s.schema["__s"].dataType).alias("__s"), F.struct(*ident, at).alias("__call"))
    x = running(s.unionByName(c), keys, "__at", {"__found": rlast(F.col("__s"))}, tie=["__side", "__call"], bits=bits)
    code = (
        F.when(F.col("__found").isNull(), "snapshot_missing")
        .when(F.col("__at") > F.col("__found.valid_until"), "snapshot_stale")
        .otherwise("ok")
    )
    return x.where("__side = 1").select(*keys, "__call.*", F.col("__found.snapshot_at").alias("snapshot_at"),
                                        F.col("__found.digest").alias("digest"), code.alias("code"))


def snapshot_admission(tasks: DataFrame, snapshots: DataFrame, keys: Sequence[str], required: bool, as_of: Column) -> DataFrame:
    """First reason a selected profile has no usable snapshot, and snapshots of work that was not selected.

    ``tasks``: keys, profile, provider, declared (digest or NULL), one row per key; ``snapshots``: keys, profile, provider, digest,
    snapshot_at, valid_until.  Of several snapshots of a key the newest at ``as_of`` counts, equal times by digest; a key
    with later ones only is stale.  A task without a snapshot passes if none is ``required`` and it declares no digest.
    """
    keys = list(keys)
    live = F.col("snapshot_at") <= as_of
    fields = F.struct(live.alias("live"), "snapshot_at", "digest", "profile", "provider", "valid_until")
    s = snapshots.groupBy(*keys).agg(F.max(fields).alias("__s"))
    t = tasks.select(*keys, F.struct("profile", "provider", "declared").alias("__t"))
    x = t.join(s, keys, "full_outer")
    none = F.col("__s").isNull()
    code = (
        F.when(F.col("__t").isNull(), "unselected_snapshot")
        .when(none & (F.lit(required) | F.col("__t.declared").isNotNull()), "snapshot_missing")
        .when(none, F.lit(None).cast("string"))
        .when(~holds(F.col("__s.live") & (as_of <= F.col("__s.valid_until"))), "snapshot_stale")
        .when(~holds(F.col("__s.profile") == F.col("__t.profile")), "identity_mismatch")
        .when(~holds(F.col("__s.provider") == F.col("__t.provider")), "provider_mismatch")
        .when(F.col("__t.declared").isNotNull() & ~holds(F.col("__s.digest") == F.col("__t.declared")), "digest_mismatch")
    )
    return x.select(*keys, code.alias("code")).where("code is not null")


def set_digest(df: DataFrame, keys: Sequence[str], digest: str, order: str | None = None, spread: bool = True) -> DataFrame:
    """Digest of a set, or with ``order`` of a chain, of record digests per key: a hash tree of fixed fan-in.

    A record's place is a string of hex digits: the first digits of the SHA-256 of its digest (sets), or its order number and
    then those (chains).  Equal records are one leaf with their number.  Records of one place hash to a node, and up to 4,096
    nodes that agree on all but the last three digits hash to the next, so the value is fixed by the records alone and no task
    gathers more than a node's children.  A NULL digest is a record of its own; NULL orders come last.  ``spread``: False where
    rows are dealt by one of the keys already, so that they stay where they are.
    """
    keys = list(keys)
    name = F.substring(F.sha2(F.coalesce(F.col(digest).cast("string"), F.lit("")), 256), 1, 9)
    place, width, top = name, 9, 3
    if order is not None:
        place, width, top = F.concat(F.coalesce(F.lpad(F.hex(F.col(order).cast("long")), 16, "0"), F.lit("Z" * 16)), name), 25, 13
    text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__d"))), lambda i: i["__d"]))
    node = [F.sha2(text, 256).alias("__d"), F.sum("__n").alias("__n")]
    x = df.groupBy(*keys, place.alias("__p"), F.col(digest).cast("string").alias("__o")).agg(F.count("*").alias("__n"))
    x = x.withColumns({"__top": F.substring("__p", 1, top), "__d": F.concat_ws(" ", "__o", "__n")})
    x = x.repartition(*keys, "__top") if spread else x
    x = x.groupBy(*keys, "__top", "__p").agg(*node)  # this level and those down to "__top" lie in one partition each
    for at in range(width - 3, -1, -3):
        x = x.withColumnRenamed("__p", "__o")
        x = x.groupBy(*keys, *(["__top"] if at >= top else []), F.substring("__o", 1, at).alias("__p")).agg(*node)
    if at > 0:
        x = x.withColumnRenamed("__p", "__o").groupBy(*keys).agg(*node)
    return x.select(*keys, F.col("__n").alias("records"), F.col("__d").alias("set_digest"))


def manifest_breaches(declared: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Exact id set, size and digest of declared against payload.

    ``declared``: key, bytes, sha256, one row per key; ``payloads``: key, bytes, sha256 of the content.
    """
    d = declared.select(key, F.col("bytes").alias("__db"), F.col("sha256").alias("__dh"), F.lit(True).alias("__d"))
    p = payloads.select(key, F.col("bytes").alias("__pb"), F.col("sha256").alias("__ph"), F.lit(True).alias("__p"))
    x = d.join(p, key, "full_outer")
    code = (
        F.when(F.col("__p").isNull(), "missing_payload").when(F.col("__d").isNull(), "unknown_payload")
        .when(~F.col("__db").eqNullSafe(F.col("__pb")), "size_mismatch")
        .when(~F.col("__dh").eqNullSafe(F.col("__ph")), "digest_mismatch")
    )
    return x.select(key, code.alias("code")).where("code is not null")


def packed_context_breaches(manifest: DataFrame, blocks: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Manifest entries equal blocks; sums equal recorded use and fit the caps.

    ``headers``: key, used_bytes, used_tokens, byte_cap, token_cap.
    """
    m = manifest.groupBy(key, "kind", "ref").agg(F.max(F.struct("bytes", "tokens")).alias("__m"), F.count("*").alias("__mn"))
    b = blocks.groupBy(key, "kind", "ref").agg(F.max(F.struct("bytes", "tokens")).alias("__b"), F.count("*").alias("__bn"))
    pair = m.join(b, [key, "kind", "ref"], "full_outer")
    bad = pair.where(~(F.col("__m").eqNullSafe(F.col("__b")) & F.col("__mn").eqNullSafe(F.col("__bn")))).select(key).distinct()
    bad = bad.withColumn("code", F.lit("entry_mismatch"))
    use = blocks.groupBy(key).agg(F.sum("bytes").alias("__sb"), F.sum("tokens").alias("__st"))
    h = headers.join(use, key, "left").withColumns({"__sb": F.coalesce("__sb", F.lit(0)), "__st": F.coalesce("__st", F.lit(0))})
    sums = flagged(h, {
        "recorded_use_mismatch": (F.col("used_bytes") != F.col("__sb")) | (F.col("used_tokens") != F.col("__st")),
        "over_cap": (F.col("__sb") > F.col("byte_cap")) | (F.col("__st") > F.col("token_cap")),
    }, [key])
    return bad.unionByName(sums)


def ingest(new: DataFrame, existing: DataFrame, ident: str, content: str) -> DataFrame:
    """Outcome of storing records once per id (S8): inserted, duplicate, conflict.

    Copies are reduced to one row per (id, content) first; the lowest content digest of a new id wins and
    other contents of the same id conflict.
    """
    n = new.groupBy(ident, content).agg(F.count("*").alias("copies"))
    first = n.groupBy(ident).agg(F.min(content).alias("__first"))
    e = existing.groupBy(ident).agg(F.min(content).alias("__stored"))
    x = n.join(first, ident).join(e, ident, "left")
    keep = F.coalesce("__stored", "__first")
    fresh = F.when((F.col(content) == keep) & F.col("__stored").isNull(), 1).otherwise(0).cast("long")
    return x.groupBy(ident).agg(
        F.sum(fresh).alias("inserted"),
        F.sum(F.when(F.col(content) == keep, F.col("copies") - fresh).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col(content) != keep, F.col("copies")).otherwise(0)).alias("conflicts"),
    )


def claim_citation_gaps(required: DataFrame, cited: DataFrame, known: DataFrame, keys: Sequence[str], ref: str) -> DataFrame:
    """Required, given and known citations: missing, duplicate, unknown (U4)."""
    r = required.select(*keys, ref).distinct().withColumn("__r", F.lit(True))
    c = cited.groupBy(*keys, ref).agg(F.count("*").alias("__n"))
    k = known.select(ref).distinct().withColumn("__k", F.lit(True))
    x = r.join(c, [*keys, ref], "full_outer")
    x = x.join(k, [ref], "left")
    given = F.col("__n").isNotNull()
    return flagged(x, {
        "missing_citation": F.col("__r").isNotNull() & ~given,
        "unknown_citation": given & F.col("__k").isNull(),
        "duplicate_citation": F.col("__n") > 1,
    }, [*keys, ref])
