"""Splits without leakage: items that share any identifier stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaveline.operators.graph import connected_components
from weaveline.scratch import materialize

SPLITS = ("train", "val", "test")
#: Groups that the driver assigns one by one, largest first; smaller ones go by hash shares.
GREEDY_GROUPS = 10_000


def three_way(items: DataFrame, key: str, identifiers: list[str], val: float, test: float, seed: int = 0) -> DataFrame:
    """Items with `split` (train, val, test): no identifier of a kind is on two sides.

    Items and identifiers make components; the largest groups go, one by one,
    to the split that lacks most of its share (ties train, val, test; equal
    sizes in hash order).  Beyond the largest GREEDY_GROUPS groups, whose sizes
    the driver reads, the rest is dealt by hash in proportion to what each
    split still lacks.  A null identifier ties nothing.
    """
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("fractions must be in [0, 1) and leave room for training")
    node = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    own = F.concat(F.lit("item:"), F.col(key).cast("string"))
    edges = items.select(own.alias("a"), F.explode(F.array_compact(F.array(*[node(c) for c in identifiers]))).alias("b"))
    cc = connected_components(edges)
    placed = materialize(items.select(key, own.alias("node")).join(cc, "node", "left").select(key, F.coalesce("component", "node").alias("grp")), "groups")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n"))
    total = placed.count()
    lack = {"train": (1 - val - test) * total, "val": val * total, "test": test * total}
    dealt = []
    for r in sizes.orderBy(F.desc("n"), F.xxhash64("grp", F.lit(seed)), "grp").limit(GREEDY_GROUPS).collect():
        best = max(SPLITS, key=lambda s: lack[s])
        lack[best] -= r["n"]
        dealt.append((r["grp"], best))
    fixed = items.sparkSession.createDataFrame(dealt, "grp string, split string")
    room = {s: max(v, 0.0) for s, v in lack.items()}
    scale = sum(room.values()) or 1.0
    u = F.pmod(F.xxhash64("grp", F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000
    rest = F.when(u < room["train"] / scale, "train").when(u < (room["train"] + room["val"]) / scale, "val").otherwise("test")
    by_group = placed.join(F.broadcast(fixed), "grp", "left").select(key, F.coalesce("split", rest).alias("split"))  # at most GREEDY_GROUPS rows
    return items.join(by_group, key)
