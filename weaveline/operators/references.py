"""References whose target record is missing, was deleted or came too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaveline.scratch import hot_keys

#: A reference key with more than 1/HOT_SHARE of all references is salted, so at most HOT_SHARE keys are hot.
HOT_SHARE = 256

_SPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def clean_reference(ref: Column) -> Column:
    """White space at the ends, everything from `#`, leading `/` and a final `.md` dropped; empty becomes null."""
    trim = lambda c: F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")
    bare = trim(F.regexp_replace(trim(ref), r"(?s)#.*$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^/+", ""), r"\.md$", "")
    ends = lambda i: F.substring(ref, i, 1)
    clean = (F.length(ref) > 0) & ~(ref.contains("#") | ref.startswith("/") | ref.endswith(".md") | ends(1).rlike(_SPACE) | ends(-1).rlike(_SPACE))
    return F.when(clean, ref).otherwise(F.when(F.length(bare) > 0, bare))  # most are clean, and seen to be without a search


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parent_spans(parents: DataFrame, key: str, arrived: str, deleted: str, grace_hours: int = 24) -> DataFrame:
    """Disjoint spans [start, end) in microseconds during which a parent key exists: (key, start, end).

    Rows without a key or an arrival never exist.  Rows never deleted reduce to
    one minimum per key before any sort; deleted rows are made distinct, those
    inside the open span dropped, and the rest merged with gaps and islands,
    first within 64 hash shares of a key, then across them.
    """
    rows = parents.select(
        F.col(key).alias("key"),
        (_micros(F.col(arrived)) - F.lit(grace_hours * 3_600_000_000)).alias("start"),
        _micros(F.col(deleted)).alias("end"),
    ).filter("key is not null and start is not null and (end is null or end > start)")
    open_from = rows.filter("end is null").groupBy("key").agg(F.min("start").alias("open_start"))
    closed = rows.filter("end is not null").distinct().join(open_from, "key", "left").filter("open_start is null or start < open_start")
    merged = closed.select("key", "start", F.when(F.col("end") < F.col("open_start"), F.col("end")).when(F.col("open_start").isNull(), F.col("end")).otherwise(F.col("open_start")).alias("end"))
    for part in (["key", "share"], ["key"]):
        if "share" in part:
            merged = merged.withColumn("share", F.pmod(F.xxhash64("start", "end"), F.lit(64)))
        by = Window.partitionBy(*part).orderBy("start", "end")
        before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
        merged = merged.withColumn("island", island).groupBy(*part, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island", "share")
    return merged.unionByName(open_from.select("key", F.col("open_start").alias("start"), F.lit(None).cast("long").alias("end")))


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str,
    sides: dict[str, str],
    recorded: str,
    parent_key: str,
    arrived: str,
    deleted: str,
    grace_hours: int = 24,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Every reference that no parent row backs at its time: (child_id, side, key, recorded_at, reason).

    `sides` maps a side's name to the child column with its reference.  Parent
    spans and child references are united in long form, tagged, and grouped by
    key; a running count of open spans is the parent flag of the moment, and
    rows where it is zero stay.  A key with more than 1/hot_share of all
    references is salted over its children (its few spans are repeated per
    salt), so no group exceeds about that share.

    `reason` is `missing` (key never seen), `deleted` (seen before) or `late`
    (seen only afterwards).  A null or blank reference is no case.  A null
    `recorded` time lies in no span: the reference is an orphan (`missing`
    when the key is unknown, else `untimed`).  Repeated child rows each count.
    Extra columns are ignored, so their names cannot clash.
    """
    refs = children.select(
        F.col(child_id).alias("child_id"),
        F.col(recorded).alias("recorded_at"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("side"), clean_reference(F.col(c)).alias("key")) for s, c in sides.items()])).alias("r"),
    ).select("child_id", "recorded_at", "r.side", "r.key").filter("key is not null")
    hot = hot_keys(refs.select("key"), ["key"], hot_share)
    spans = parent_spans(parents, parent_key, arrived, deleted, grace_hours)
    as_child = {f: F.lit(None).cast(refs.schema[f].dataType).alias(f) for f in ("child_id", "side", "recorded_at")}
    edges = (
        spans.join(hot, "key", "left")
        .select("key", "start", "end", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        .select("key", "salt", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("delta")))).alias("e"))
        .filter("e.at is not null")
        .select("key", "salt", "e.at", "e.delta", *as_child.values())
    )
    asked = refs.join(hot, "key", "left").select(
        "key",
        F.pmod(F.xxhash64("child_id", "side"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        _micros(F.col("recorded_at")).alias("at"),
        F.lit(0).alias("delta"),
        "child_id",
        "side",
        "recorded_at",
    )
    group = Window.partitionBy("key", "salt")
    # a span's edges come before references of the same moment; untimed references sort first and see no span
    walk = group.orderBy(F.col("at").asc_nulls_first(), F.abs("delta").desc(), "delta")
    run = walk.rowsBetween(Window.unboundedPreceding, 0)
    flagged = edges.unionByName(asked).select(
        "*",
        F.sum("delta").over(run).alias("alive"),
        F.sum(F.abs("delta")).over(run).alias("seen"),
        F.max(F.abs("delta")).over(group).alias("known"),
    )
    reason = F.when(F.col("known") == 0, "missing").when(F.col("at").isNull(), "untimed").when(F.col("seen") > 0, "deleted").otherwise("late")
    return flagged.filter("delta = 0 and alive = 0").select("child_id", "side", "key", "recorded_at", reason.alias("reason"))


def orphans_by_period(orphans: DataFrame, unit: str = "month") -> DataFrame:
    """Orphans per side, period of the reference and reason: (side, period, reason, n_refs).

    Counts are summed map-side; a null time gives a null period.
    """
    return orphans.groupBy("side", F.date_format(F.date_trunc(unit, "recorded_at"), "yyyy-MM-dd").alias("period"), "reason").agg(F.count("*").alias("n_refs"))


def orphan_keys(orphans: DataFrame) -> DataFrame:
    """Dangling keys per side: (side, key, n_refs, first_seen, last_seen)."""
    return orphans.groupBy("side", "key").agg(F.count("*").alias("n_refs"), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"))
