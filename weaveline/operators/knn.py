"""Exact nearest neighbours by blocks, search with given queries, and what is measured on neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions.vectors import dot, normalize
from weaveline.scratch import bounded_broadcast, materialize

#: Vectors a side of one task.
BLOCK = 2_048
#: Vectors below which exact search is chosen.
EXACT_ROWS = 50_000


def _top(sim: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row by (similarity falling, id rising); `ids` rise, so a stable sort keeps ties in order."""
    if sim.shape[1] > 4 * k:
        edge = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        sim = np.where(sim >= edge, sim, -np.inf)
    return np.argsort(-sim, axis=1, kind="stable")[:, :k]


def exact_top_k(table: DataFrame, key: str, vector: str, k: int, within: str | None = None, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors by dot product: (part, unit, neighbor, sim, rank), similarities rounded to 9 places.

    Without `queries` every row asks for its neighbours but itself; with them,
    (key, vector[, within]) rows ask and identical vectors are found too.  Ties
    go to the smaller key.  Rows meet only where `within` is equal.  Each side
    is cut into blocks by hash; a task multiplies one block with another, and
    per-task top k lists are merged, so nothing is broadcast and no task grows
    with the table.  k < 1 and unequal dimensions are errors; rows whose vector is null are left out; k over the
    number of rows gives what there is.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    part = F.col(within).cast("string") if within else F.lit("")
    shape = lambda df: df.select(F.coalesce(part, F.lit("\u0000")).alias("part"), F.col(key).alias("unit"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    held = shape(table)
    asked = held if queries is None else shape(queries)
    count = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = count(held, "held_blocks").join(count(asked, "ask_blocks"), "part")
    sizes, _ = bounded_broadcast(materialize(sizes, "blocks"))
    h = F.xxhash64("unit")
    left = held.join(sizes, "part").select("part", F.pmod(h, "held_blocks").cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("r"), F.lit(False).alias("asks"), "unit", "v")
    right = asked.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("held_blocks") - 1)).alias("l"), F.pmod(h, "ask_blocks").cast("int").alias("r"), F.lit(True).alias("asks"), "unit", "v")
    unit = table.schema[key].dataType
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("unit", unit), T.StructField("neighbor", unit), T.StructField("sim", T.DoubleType())])
    alone = queries is None

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        b = group[~group["asks"]].sort_values("unit")
        q = group[group["asks"]]
        if not len(b) or not len(q):
            return pd.DataFrame(columns=schema.names)
        x, y = np.stack(b["v"].to_numpy()), np.stack(q["v"].to_numpy())
        if x.shape[1] != y.shape[1]:
            raise ValueError("vectors of unequal length")
        ids, asks = b["unit"].to_numpy(), q["unit"].to_numpy()
        sim = np.round(y @ x.T, 9)
        if alone:
            sim[asks[:, None] == ids[None, :]] = -np.inf
        at = _top(sim, ids, k)
        r = np.arange(len(asks))[:, None]
        out = pd.DataFrame({"part": group["part"].iloc[0], "unit": np.repeat(asks, at.shape[1]), "neighbor": ids[at].reshape(-1), "sim": sim[r, at].reshape(-1)})
        return out[np.isfinite(out["sim"])]

    met = left.unionByName(right).groupBy("part", "l", "r").applyInPandas(multiply, schema)
    by = Window.partitionBy("part", "unit").orderBy(F.desc("sim"), "neighbor")
    return met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def pair_ranks(table: DataFrame, key: str, vector: str, pairs: DataFrame, k: int, block: int = 8_192, share: int = 16) -> DataFrame:
    """(query, item, rank) of the `pairs` (query, item) whose item is among the query's k nearest by cosine, as `exact_top_k` ranks them: similarities rounded to 9 places, ties to the smaller key.

    How many others are nearer than the item is counted, so no lists are made.
    Pairs with k nearer ones among 1/`share` of the vectors are out already;
    only the others meet all vectors.  `vector` is array<float>, not zero.
    """
    held = table.select(F.col(key).alias("unit"), F.col(vector).cast("array<float>").alias("v"))
    of = lambda name, v: held.select(F.col("unit").alias(name), F.col("v").alias(v))
    both = pairs.select("query", "item").join(of("query", "v"), "query").join(of("item", "w"), "item")
    asked = materialize(both.select("query", "item", "v", F.round(dot(normalize(F.col("v")), normalize(F.col("w"))), 9).alias("least")), "pairs")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        b, q = group[~group["asks"]].sort_values("unit"), group[group["asks"]]
        if not len(b) or not len(q):
            return pd.DataFrame({"unit": [], "item": [], "n": []})
        unit = lambda v: (x := np.stack(v.to_numpy()).astype(np.float64)) / np.sqrt(np.vecdot(x, x))[:, None]
        x, ids, nearer = unit(b["v"]), b["unit"].to_numpy(), []
        for i in range(0, len(q), 512):
            some = q.iloc[i : i + 512]
            sim, least = unit(some["v"]) @ x.T, some["least"].to_numpy()[:, None]
            for name in ("unit", "item"):
                at = np.minimum(np.searchsorted(ids, some[name]), len(ids) - 1)
                r = np.flatnonzero(ids[at] == some[name].to_numpy())
                sim[r, at[r]] = -np.inf
            above = sim > least + 2e-9
            n = np.count_nonzero(above, axis=1)
            r, c = np.nonzero((sim > least - 2e-9) & ~above)
            s, t = np.round(sim[r, c], 9), least[r, 0]
            nearer.append(n + np.bincount(r[(s > t) | (s == t) & (ids[c] < some["item"].to_numpy()[r])], minlength=len(n)))
        return pd.DataFrame({"unit": q["unit"], "item": q["item"], "n": np.concatenate(nearer)})

    def counted(among: DataFrame, asks: DataFrame) -> DataFrame:
        wide, high = (max(1, -(-df.count() // block)) for df in (among, asks))
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        nothing = F.lit(None)
        left = among.select(place("unit", wide).alias("l"), every(high).alias("r"), F.lit(False).alias("asks"), "unit", nothing.cast(kind).alias("item"), "v", nothing.cast("double").alias("least"))
        right = asks.select(every(wide).alias("l"), place("query", high).alias("r"), F.lit(True).alias("asks"), F.col("query").alias("unit"), "item", "v", "least")
        met = left.unionByName(right).repartition(wide * high, "l", "r").groupBy("l", "r").applyInPandas(count, f"unit {kind}, item {kind}, n long")
        return met.groupBy(F.col("unit").alias("query"), "item").agg(F.sum("n").alias("n"))

    kind = table.schema[key].dataType.simpleString()
    some = held.filter(F.pmod(F.xxhash64("unit", F.lit(5)), F.lit(share)) == 0)
    out = counted(some, asked).filter(F.col("n") >= k).select("query", "item")
    left = materialize(asked.join(out, ["query", "item"], "left_anti"), "open-pairs")
    return counted(held, left).filter(F.col("n") < k).select("query", "item", (F.col("n") + 1).alias("rank"))


def search(table: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """The `limit` vectors of highest dot product with one query: (key, sim); one scan, and a top-k without a full sort."""
    sim = F.round(dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 9)
    return table.filter(F.size(vector) == len(query)).select(F.col(key), sim.alias("sim")).orderBy(F.desc("sim"), key).limit(limit)


def choose_backend(n: int, exact_rows: int = EXACT_ROWS) -> str:
    """`exact` below `exact_rows` vectors, else `approximate`."""
    return "exact" if n < exact_rows else "approximate"


def train_centroids(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        total = np.zeros_like(c)
        np.add.at(total, (x @ c.T).argmax(1), x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def approximate_top_k(table: DataFrame, key: str, vector: str, k: int, within: str | None = None, *, cells: int | None = None, probes: int | None = None, train_rows: int = 20_000, block: int = BLOCK) -> DataFrame:
    """Like `exact_top_k` on unit vectors, but rows meet only in the `probes` partitions nearest to the asking row.

    Partitions come from k-means on at most `train_rows` rows chosen by hash
    (four a partition if these are more, up to 200,000); every row is put into
    one.  Candidates are scored exactly.  A row that meets fewer than k others
    asks its whole part.
    """
    part = F.coalesce(F.col(within).cast("string"), F.lit("\u0000")) if within else F.lit("")
    rows = table.select(part.alias("part"), F.col(key).alias("unit"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    n = rows.count()
    if n == 0:
        return exact_top_k(table, key, vector, k, within)
    cells = cells or max(1, round(n**0.5 / 2))
    wanted = min(200_000, max(train_rows, 4 * cells))
    drawn = rows.filter(F.pmod(F.xxhash64("unit"), F.lit(max(1, n // wanted))) == 0) if n > 2 * wanted else rows
    sample = drawn.orderBy(F.xxhash64("unit", F.lit(3)), "unit").limit(wanted).toPandas()
    centroids = train_centroids(np.stack(sample["v"].to_numpy()), cells)
    probes = min(probes or int(np.ceil(2 * len(centroids) ** 0.5)), len(centroids))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("unit", table.schema[key].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("near", T.ArrayType(T.IntegerType()))])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(near=list(np.argsort(-(np.stack(b["v"].to_numpy()) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    placed = materialize(rows.mapInPandas(assign, schema), "cells")
    cell = F.concat_ws("\u0001", F.col("cell").cast("string"), "part")
    held = placed.select("part", "unit", "v", F.col("near")[0].alias("cell")).withColumn("cell", cell)
    asks = placed.select("part", "unit", "v", F.explode("near").alias("cell")).withColumn("cell", cell)
    met = exact_top_k(held, "unit", "v", k + 1, "cell", asks, block).filter("unit <> neighbor").withColumn("part", F.regexp_replace("part", "^[0-9]+\u0001", ""))
    by = Window.partitionBy("part", "unit").orderBy(F.desc("sim"), "neighbor")
    found = materialize(met.select("part", "unit", "neighbor", "sim").distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k), "near")
    sizes, _ = bounded_broadcast(placed.groupBy("part").agg(F.count("*").alias("n")))
    got = found.groupBy("unit").agg(F.count("*").alias("got"))
    short = placed.join(sizes, "part").join(got, "unit", "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("part", "unit", "v")
    short = materialize(short, "short")
    if not short.limit(1).count():
        return found
    again = exact_top_k(placed, "unit", "v", k + 1, "part", short, block).filter("unit <> neighbor").drop("rank").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return found.join(short.select("unit"), "unit", "left_anti").select(*again.columns).unionByName(again)


def top_k(table: DataFrame, key: str, vector: str, k: int, within: str | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Nearest neighbours by the backend that `choose_backend` names for each part's number of vectors."""
    part = F.coalesce(F.col(within).cast("string"), F.lit("\u0000")) if within else F.lit("")
    sizes = table.filter(F.col(vector).isNotNull()).groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    large = materialize(sizes.filter(F.col("_n") >= exact_rows).select("_part"), "large-parts")  # under n / exact_rows
    if not large.limit(1).count():
        return exact_top_k(table, key, vector, k, within)
    large, _ = bounded_broadcast(large)
    tagged = table.withColumn("_part", part)
    small = exact_top_k(tagged.join(large, "_part", "left_anti"), key, vector, k, within)
    return small.unionByName(approximate_top_k(tagged.join(large, "_part", "left_semi"), key, vector, k, within).select(*small.columns))


def local_density(neighbors: DataFrame, first: int = 10) -> DataFrame:
    """(unit, density): mean similarity of a unit's first neighbours."""
    return neighbors.filter(F.col("rank") <= first).groupBy("unit").agg(F.avg("sim").alias("density"))


def csls(neighbors: DataFrame, density: DataFrame) -> DataFrame:
    """Neighbour lists with 2 sim - density(unit) - density(neighbor), which demotes hubs; a missing density is 0."""
    d = lambda c, n: density.select(F.col("unit").alias(c), F.col("density").alias(n))
    joined = neighbors.join(d("unit", "d_unit"), "unit", "left").join(d("neighbor", "d_neighbor"), "neighbor", "left")
    return joined.withColumn("csls", 2 * F.col("sim") - F.coalesce("d_unit", F.lit(0.0)) - F.coalesce("d_neighbor", F.lit(0.0)))
