"""Operators on edge tables: adjacency, components, distances, neighbourhoods, propagation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.scratch import hot_keys, materialize


def undirected(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Distinct (a, b) in both directions, without loops and nulls."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def simple_edges(edges: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Distinct unordered edges a < b."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct()


def degrees(adjacency: DataFrame) -> DataFrame:
    """(node, degree) of nodes with an edge."""
    return adjacency.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, held: int = 200_000) -> DataFrame:
    """(node, component), the component's smallest node, of every node with an edge.

    Alternates large and small stars: every node's larger, then smaller,
    neighbours are tied to the smallest of its neighbourhood.  The number of
    rounds grows with the logarithm of the size, also on long paths, and each
    round keeps at most as many edges as there were.  A node's minimum is an
    aggregate with partial sums, so a hub is never collected; each round goes
    to a table in the shared folder.  Loops make components of their own.  Up
    to `held` distinct edges, by count, are joined up in one task instead, with
    the same result.
    """
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = own.select(F.col("u").alias("node")).union(own.select("v")).distinct()
    e = materialize(own.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= held:
        label = materialize(_components_in_one_task(e), "components")
        return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    label = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of a counted small number of edges (u, v)."""
    schema = T.StructType([T.StructField("node", edges.schema["u"].dataType), T.StructField("component", edges.schema["u"].dataType)])

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                u, v = root(u), root(v)
                above[max(u, v)] = min(u, v)
        if above:
            nodes = list(above)
            yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]})

    return edges.coalesce(1).mapInPandas(join_up, schema)


def alias_map(edges: DataFrame, present: DataFrame, kind: str = "alias") -> DataFrame:
    """(node, canonical): the smallest present member of a node's alias class, else the smallest; `present` is (id)."""
    cls = connected_components(edges.filter(F.col("kind") == kind), "source", "target")
    here = cls.join(present.select(F.col("id").alias("node"), F.lit(True).alias("here")), "node", "left")
    best = here.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("here"), F.col("node"))), F.min("node")).alias("canonical"))
    return cls.join(best, "component").select("node", "canonical")


def canonical_edges(edges: DataFrame, aliases: DataFrame, kind: str = "alias") -> DataFrame:
    """Edges of other kinds with both ends replaced by their canonical node."""
    out = edges.filter(F.col("kind") != kind)
    for side in ("source", "target"):
        out = out.join(aliases.select(F.col("node").alias(side), F.col("canonical").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return out


def hops(adjacency: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(start, node, hops) of all nodes within `most` edges of each start, the start itself at 0; `starts` is (start).

    A frontier join a level, less the pairs already reached.
    """
    reached = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    frontier = reached = materialize(reached, "reached")
    for level in range(1, most + 1):
        step = frontier.select("start", F.col("node").alias("a")).join(adjacency, "a").select("start", F.col("b").alias("node")).distinct().join(reached.select("start", "node"), ["start", "node"], "left_anti")
        frontier = materialize(step.withColumn("hops", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def pair_distances(adjacency: DataFrame, pairs: DataFrame, most: int = 5, unreachable: float = 6.0, hub_share: int = 1_000) -> DataFrame:
    """(source, target, graph_distance) of given pairs: hops up to `most`, else `unreachable`; 0 for a pair of one node.

    A shortest path passes a hub or it doesn't.  Hubs, the under `hub_share`
    nodes that hold more than 1/hub_share of all ends, are walked from once
    each, which gives the best way over a hub; the rest of the graph, where
    neighbourhoods are small, is walked from both ends of a pair by turns, and
    only for pairs that have no shorter way yet.  A pair of distance t meets in
    a node at ceil(t / 2) from its source and t // 2 from its target.
    """
    ends = hot_keys(adjacency.select("a"), ["a"], hub_share).select(F.col("a").alias("start"))
    hubs = F.broadcast(materialize(ends, "hubs"))
    inner = adjacency.join(hubs.select(F.col("start").alias("a")), "a", "left_anti").join(hubs.select(F.col("start").alias("b")), "b", "left_anti").select("a", "b")
    far_hubs = materialize(hops(adjacency, hubs, most), "hub-distances")
    left = materialize(pairs.select("source", "target").distinct(), "pairs")
    found = left.filter("source = target").withColumn("graph_distance", F.lit(0.0))
    left = left.filter("source <> target")
    side = lambda c, h: far_hubs.select("start", F.col("node").alias(c), F.col("hops").alias(h))
    over = left.join(side("source", "h1"), "source").join(side("target", "h2"), ["start", "target"]).groupBy("source", "target").agg(F.min(F.col("h1") + F.col("h2")).alias("over"))
    nodes = adjacency.select("a").distinct()
    joined = lambda c: nodes.select(F.col("a").alias(c), F.lit(True).alias(f"{c}_joined"))
    left = materialize(left.join(over, ["source", "target"], "left").join(joined("source"), "source", "left").join(joined("target"), "target", "left"), "pairs")
    alone = F.col("source_joined").isNull() | F.col("target_joined").isNull()  # an end without an edge is never reached
    found = found.unionByName(left.filter(alone).select("source", "target", F.lit(float(unreachable)).alias("graph_distance")))
    left = left.filter(~alone).select("source", "target", "over")
    seen = {c: left.filter("over is null or over > 1").select(F.col(c).alias("start"), F.col(c).alias("node")).distinct() for c in ("source", "target")}
    edge = dict(seen)
    for t in range(1, most + 1):
        found = found.unionByName(left.filter(F.col("over") <= t).select("source", "target", F.col("over").cast("double").alias("graph_distance")))
        left = left.filter(F.col("over").isNull() | (F.col("over") > t))
        c = "source" if t % 2 else "target"
        step = edge[c].join(left.select(F.col(c).alias("start")).distinct(), "start", "left_semi").select("start", F.col("node").alias("a")).join(inner, "a").select("start", F.col("b").alias("node")).distinct()
        edge[c] = materialize(step.join(seen[c], ["start", "node"], "left_anti"), "frontier")
        seen[c] = seen[c].unionByName(edge[c])
        near = edge["source"].select(F.col("start").alias("source"), "node")
        far = edge["target"].select(F.col("start").alias("target"), "node")
        met = left.join(near, "source").join(far, ["target", "node"], "left_semi").select("source", "target", F.lit(True).alias("met")).distinct()
        told = materialize(left.join(met, ["source", "target"], "left"), "pairs")
        found = found.unionByName(told.filter("met").select("source", "target", F.lit(float(t)).alias("graph_distance")))
        left = told.filter("met is null").drop("met")
        if left.isEmpty():
            break
    return found.unionByName(left.select("source", "target", F.lit(float(unreachable)).alias("graph_distance")))


def common_neighbors(adjacency: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, n) of given pairs, 0 included.

    The neighbours of a pair's end of smaller degree are looked up among the
    other's by an equi-join on both, so a hub's neighbours are listed only for
    pairs of two hubs.
    """
    p = pairs.select("source", "target").distinct()
    d = adjacency.groupBy("a").agg(F.count("*").alias("d"))
    degree = lambda c: d.select(F.col("a").alias(c), F.col("d").alias(f"d_{c}"))
    both = p.join(degree("source"), "source").join(degree("target"), "target")  # an end without edges shares none
    first = F.col("d_source") <= F.col("d_target")
    asked = both.select("source", "target", F.when(first, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("other"))
    n = asked.join(adjacency.select("a", F.col("b").alias("x")), "a").join(adjacency.select(F.col("a").alias("other"), F.col("b").alias("x")), ["other", "x"]).groupBy("source", "target").agg(F.count("*").alias("n"))
    return p.join(n, ["source", "target"], "left").na.fill({"n": 0})


def normalized_adjacency(adjacency: DataFrame) -> DataFrame:
    """(a, b, w) of D^-1/2 (A + I) D^-1/2, degrees counting the loop."""
    loops = adjacency.select("a").distinct().select("a", F.col("a").alias("b"))
    full = adjacency.unionByName(loops)
    d = full.groupBy("a").agg(F.count("*").alias("d"))
    return full.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("d").alias("d_b")), "b").select("a", "b", (1 / F.sqrt(F.col("d") * F.col("d_b"))).alias("w"))


def propagate(weights: DataFrame, signal: DataFrame) -> DataFrame:
    """One step of weights x signal: (node, x), `signal` is (node, x); summed map-side."""
    return weights.join(signal.select(F.col("node").alias("b"), "x"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def label_agreement(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edges with both labels, those with equal ones, and their share; `labels` is (node, label)."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = edges.join(left, "a").join(right, "b")
    same = F.coalesce(F.sum((F.col("la") == F.col("lb")).cast("long")), F.lit(0))
    return both.agg(F.count("*").alias("n_edges"), same.alias("n_same"), (same / F.count("*")).alias("share"))


def rewired(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Edges with targets dealt anew: the i-th source by one hash order takes the i-th target by another, within 64 hash shares."""
    share = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(64))
    rank = lambda tag: F.row_number().over(Window.partitionBy("share").orderBy(F.xxhash64(F.lit(tag), F.lit(seed), "a", "b"), "a", "b"))
    base = edges.select("a", "b").withColumn("share", share)
    return base.withColumn("i", rank("s")).select("share", "i", "a").join(base.withColumn("i", rank("t")).select("share", "i", "b"), ["share", "i"]).select("a", "b")


def ancestor_index(pages: DataFrame, indexes: DataFrame) -> DataFrame:
    """(page, index_page): the deepest index page above a page; `pages` is (page), `indexes` (page) with `index` as the root's."""
    parts = F.split("page", "/")
    up = pages.select("page", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("depth", "folder"))
    wanted = up.withColumn("index_page", F.when(F.col("folder") == "", "index").otherwise(F.concat("folder", F.lit("/index")))).filter("index_page <> page")
    return wanted.join(indexes.select(F.col("page").alias("index_page")), "index_page", "left_semi").groupBy("page").agg(F.max_by("index_page", "depth").alias("index_page"))
