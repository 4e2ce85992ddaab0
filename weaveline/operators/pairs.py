"""From unit neighbours to document pairs: collapse, blocking, bounds and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaveline.functions.vectors import dot
from weaveline.operators import graph

#: Matches kept for a pair; similarities in the top mean; scale of the support breadth; distance of unreachable pairs.
MATCHES, TOP_R, BREADTH, UNREACHABLE = 8, 3, 6, 6.0


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def missing_units(index: DataFrame, units: DataFrame) -> DataFrame:
    """Index rows whose unit the corpus lacks."""
    return index.join(units.select("unit"), "unit", "left_anti")


def unit_matches(neighbors: DataFrame, units: DataFrame) -> DataFrame:
    """Neighbour rows as matches of unordered document pairs: (source, target, src_unit, tgt_unit, view, sim).

    source < target; a match found from both sides is one row with its larger
    similarity; matches inside one document go.
    """
    u = lambda c, d: units.select(F.col("unit").alias(c), F.col("doc").alias(d))
    m = neighbors.join(u("unit", "doc_a"), "unit").join(u("neighbor", "doc_b"), "neighbor").filter("doc_a <> doc_b")
    flip = F.col("doc_a") > F.col("doc_b")
    return m.select(
        F.least("doc_a", "doc_b").alias("source"),
        F.greatest("doc_a", "doc_b").alias("target"),
        F.when(flip, F.col("neighbor")).otherwise(F.col("unit")).alias("src_unit"),
        F.when(flip, F.col("unit")).otherwise(F.col("neighbor")).alias("tgt_unit"),
        F.col("part").alias("view"),
        "sim",
    ).groupBy("source", "target", "src_unit", "tgt_unit", "view").agg(F.max("sim").alias("sim"))


def unblocked(matches: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Matches of pairs that no edge of the given kinds or of kind `exclusion` joins, in either direction."""
    blocked = graph.simple_edges(edges.filter(F.col("kind").isin([*kinds, "exclusion"]))).select(F.col("a").alias("source"), F.col("b").alias("target"))
    return matches.join(blocked, ["source", "target"], "left_anti")


def kept_matches(matches: DataFrame, most: int = MATCHES) -> DataFrame:
    """The best matches of each pair, by (similarity falling, units, view), with their place."""
    by = Window.partitionBy("source", "target").orderBy(F.desc("sim"), "src_unit", "tgt_unit", "view")
    return matches.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def bounded_pairs(matches: DataFrame, per_document: int, limit: int | None = None) -> DataFrame:
    """(source, target, best): pairs among the best `per_document` of both their ends, then the best `limit`."""
    best = matches.groupBy("source", "target").agg(F.max("sim").alias("best"))
    ends = best.select("source", "target", "best", F.explode(F.array("source", "target")).alias("doc"))
    by = Window.partitionBy("doc").orderBy(F.desc("best"), "source", "target")
    ok = ends.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= per_document).groupBy("source", "target", "best").agg(F.count("*").alias("n")).filter("n = 2").drop("n")
    return ok if limit is None else ok.orderBy(F.desc("best"), "source", "target").limit(limit)


def hubness(units: DataFrame, density: DataFrame) -> DataFrame:
    """(doc, hubness): mean density of a document's document-view units, 0 without any."""
    own = units.filter("view = 'document'").join(density, "unit").groupBy("doc").agg(F.avg("density").alias("h"))
    return units.select("doc").distinct().join(own, "doc", "left").select("doc", F.coalesce("h", F.lit(0.0)).alias("hubness"))


def document_sizes(units: DataFrame) -> DataFrame:
    """(doc, chunks, tokens) over section units, else document units, else all."""
    by_view = units.groupBy("doc", "view").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("view") == "section", F.col(c))), F.max(F.when(F.col("view") == "document", F.col(c))), F.sum(c)).cast("double")
    return by_view.groupBy("doc").agg(pick("n").alias("chunks"), pick("t").alias("tokens"))


def cross_similarities(pairs: DataFrame, units: DataFrame, density: DataFrame) -> DataFrame:
    """Similarities over all units of the two documents of each pair, 0 where a view is missing.

    (source, target, document_similarity, title_similarity, best_chunk_similarity,
    top_r_mean_similarity, csls_best_chunk_similarity, forward, backward):
    `forward` compares the source's sections with the target's document view.
    """
    u = units.join(density, "unit", "left").select("doc", "unit", "view", "v", F.coalesce("density", F.lit(0.0)).alias("density"))
    side = lambda s, d: u.select(F.col("doc").alias(d), *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "view", "v", "density")])
    wanted = (F.col("view_a") == F.col("view_b")) | ((F.col("view_a") == "section") & (F.col("view_b") == "document")) | ((F.col("view_a") == "document") & (F.col("view_b") == "section"))
    cells = pairs.select("source", "target").join(side("a", "source"), "source").join(side("b", "target"), "target").filter(wanted).select("source", "target", "unit_a", "unit_b", "view_a", "view_b", "density_a", "density_b", F.round(dot(F.col("v_a"), F.col("v_b")), 9).alias("sim"))
    of = lambda a, b: (F.col("view_a") == a) & (F.col("view_b") == b)
    peak = lambda a, b, name: F.coalesce(F.max(F.when(of(a, b), F.col("sim"))), F.lit(0.0)).alias(name)
    maxima = cells.groupBy("source", "target").agg(peak("document", "document", "document_similarity"), peak("title", "title", "title_similarity"), peak("section", "document", "forward"), peak("document", "section", "backward"))
    by = Window.partitionBy("source", "target").orderBy(F.desc("sim"), "unit_a", "unit_b")
    first = cells.filter(of("section", "section")).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= TOP_R)
    sections = first.groupBy("source", "target").agg(F.max("sim").alias("best"), F.avg("sim").alias("top"), F.max(F.when(F.col("r") == 1, 2 * F.col("sim") - F.col("density_a") - F.col("density_b"))).alias("csls_best"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return (
        pairs.select("source", "target").join(maxima, ["source", "target"], "left").join(sections, ["source", "target"], "left")
        .select("source", "target", *[zero(c, c) for c in ("document_similarity", "title_similarity", "forward", "backward")], zero("best", "best_chunk_similarity"), zero("top", "top_r_mean_similarity"), zero("csls_best", "csls_best_chunk_similarity"))
    )


def support_breadth(kept: DataFrame) -> DataFrame:
    """(source, target, support_breadth): distinct sections of both sides in kept matches over 6, at most 1."""
    n = F.count_distinct(F.when(F.col("view") == "section", F.col("src_unit"))) + F.count_distinct(F.when(F.col("view") == "section", F.col("tgt_unit")))
    return kept.groupBy("source", "target").agg(F.least(F.lit(1.0), n / BREADTH).alias("support_breadth"))


def lexical_similarity(pairs: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(source, target, lexical_similarity): Jaccard of token sets (doc, tokens), 0 where both are empty or missing."""
    side = lambda s, d: doc_tokens.select(F.col("doc").alias(d), F.col("tokens").alias(f"t_{s}"))
    both = pairs.select("source", "target").join(side("a", "source"), "source", "left").join(side("b", "target"), "target", "left")
    inter, union = F.size(F.array_intersect("t_a", "t_b")), F.size(F.array_union("t_a", "t_b"))
    return both.select("source", "target", F.when(F.col("t_a").isNull() | F.col("t_b").isNull() | (union == 0), 0.0).otherwise(inter / union).alias("lexical_similarity"))


def near_duplicate_probability(doc: Column, lexical: Column, ratio: Column) -> Column:
    return clamp((doc - 0.95) / 0.05) * (0.6 + 0.25 * clamp((lexical - 0.5) / 0.5) + 0.15 * clamp((ratio - 0.5) / 0.5))


def pair_features(pairs: DataFrame, kept: DataFrame, units: DataFrame, density: DataFrame, doc_tokens: DataFrame, adjacency: DataFrame) -> DataFrame:
    """All features of bounded pairs as columns; computed after bounding, so only survivors cost."""
    keys = ["source", "target"]
    hub, size = hubness(units, density), document_sizes(units)
    out = pairs.select(*keys).join(cross_similarities(pairs, units, density), keys).join(support_breadth(kept), keys, "left").join(lexical_similarity(pairs, doc_tokens), keys)
    out = out.join(graph.pair_distances(adjacency, pairs), keys).join(graph.common_neighbors(adjacency, pairs).withColumnRenamed("n", "common_neighbor_count"), keys)
    for side in keys:
        out = out.join(hub.select(F.col("doc").alias(side), F.col("hubness").alias(f"hubness_{side}")), side).join(size.select(F.col("doc").alias(side), F.col("chunks").alias(f"{side}_chunk_count"), F.col("tokens").alias(f"{side}_token_count")), side)
    ratio = F.when(F.greatest("source_token_count", "target_token_count") > 0, F.least("source_token_count", "target_token_count") / F.greatest("source_token_count", "target_token_count")).otherwise(0.0)
    return (
        out.na.fill({"support_breadth": 0.0})
        .withColumn("csls_similarity", 2 * F.col("document_similarity") - F.col("hubness_source") - F.col("hubness_target"))
        .withColumn("near_duplicate_probability", near_duplicate_probability(F.col("document_similarity"), F.col("lexical_similarity"), ratio))
    )
