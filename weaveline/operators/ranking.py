"""Ranking of document pairs: scores, direction, diversity, confidence and reviews."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.operators.pairs import clamp

# Fixed values of the score.
WEIGHTS = {"document": 0.35, "local": 0.30, "breadth": 0.15, "lexical": 0.10, "bridge": 0.10, "hub": 0.10, "duplicate": 0.20, "redundancy": 0.10}
CAPS = {"common_neighbor_count": 16.0, "chunk_count": 64.0, "token_count": 8192.0}
NEAR_DUPLICATE, DIRECTION_GAP, BANDS, DECILE_RATES, LEAST_DECISIONS = 0.98, 0.02, (0.45, 0.25), (2 / 3, 1 / 3), 20


def steps(c: Column, bounds: list[tuple[float, float]], beyond: float) -> Column:
    """Piecewise constant: the value of the first bound that `c` doesn't exceed."""
    out = None
    for bound, value in bounds:
        out = F.when(c <= bound, value) if out is None else out.when(c <= bound, value)
    return out.otherwise(beyond)


def graph_redundancy(distance: Column) -> Column:
    return steps(distance, [(1, 1.0), (2, 0.7), (3, 0.3), (4, 0.1)], 0.0)


def bridge_value(strength: Column, distance: Column) -> Column:
    return clamp(strength) * steps(distance, [(2, 0.0), (3, 0.5), (4, 0.8)], 1.0)


def squash(c: Column, cap: float) -> Column:
    return clamp(F.log1p(F.greatest(c.cast("double"), F.lit(0.0))) / F.log1p(F.lit(cap)))


def normalized(pairs: DataFrame) -> DataFrame:
    """Every raw feature in [0, 1] under its name with `_norm`."""
    plain = ["document_similarity", "title_similarity", "best_chunk_similarity", "top_r_mean_similarity", "support_breadth", "hubness_source", "hubness_target", "near_duplicate_probability", "forward", "backward"]
    out = {f"{c}_norm": clamp(F.col(c)) for c in plain}
    out |= {f"{c}_norm": clamp((F.col(c) + 1) / 2) for c in ("csls_similarity", "csls_best_chunk_similarity")}
    out |= {"lexical_similarity_norm": clamp(F.col("lexical_similarity") / 0.5), "graph_distance_norm": clamp(F.col("graph_distance") / 6)}
    out |= {"common_neighbor_count_norm": squash(F.col("common_neighbor_count"), CAPS["common_neighbor_count"])}
    out |= {f"{side}_{what}_norm": squash(F.col(f"{side}_{what}"), CAPS[what]) for side in ("source", "target") for what in ("chunk_count", "token_count")}
    return pairs.withColumns(out)


def direction(forward: Column, backward: Column, has_section: Column) -> Column:
    """Which side hosts the link: the one with clearer section evidence, else undirected."""
    return F.when(~has_section, "undirected").when(forward - backward > DIRECTION_GAP, "source-to-target").when(backward - forward > DIRECTION_GAP, "target-to-source").otherwise("undirected")


def scored(pairs: DataFrame, minimum_relatedness: float = 0.0, weights: dict[str, float] = WEIGHTS, present: DataFrame | None = None) -> DataFrame:
    """Pairs past the filters, with score, relatedness, usefulness, missingness and quality.

    Takes the columns of `pairs.pair_features`.  Near-duplicates, pairs under
    `minimum_relatedness` and, with `present` (doc), pairs of a document that
    isn't there or has no text are left out.
    """
    for side in ("source", "target") if present is not None else ():
        pairs = pairs.join(present.select(F.col("doc").alias(side)).distinct(), side, "left_semi")
    p = normalized(pairs.filter(F.col("near_duplicate_probability") <= NEAR_DUPLICATE))
    p = p.withColumns({
        "graph_redundancy_penalty": graph_redundancy(F.col("graph_distance")),
        "cross_neighborhood_value": bridge_value(F.col("csls_similarity_norm"), F.col("graph_distance")),
        "hubness_penalty": clamp((F.col("hubness_source") + F.col("hubness_target")) / 2),
    })
    c, w = F.col, weights
    dup = c("near_duplicate_probability_norm")
    p = p.withColumns({
        "score": clamp(
            w["document"] * c("csls_similarity_norm") + w["local"] * c("best_chunk_similarity_norm") + w["breadth"] * c("support_breadth_norm") + w["lexical"] * c("lexical_similarity_norm")
            + w["bridge"] * c("cross_neighborhood_value") - w["hub"] * c("hubness_penalty") - w["duplicate"] * dup - w["redundancy"] * c("graph_redundancy_penalty")
        ),
        "relatedness": clamp(0.4 * c("document_similarity_norm") + 0.4 * c("best_chunk_similarity_norm") + 0.2 * c("top_r_mean_similarity_norm")),
        "usefulness": clamp(0.5 + 0.25 * c("support_breadth_norm") + 0.25 * c("cross_neighborhood_value") - 0.25 * c("hubness_penalty") - 0.5 * dup),
        "missingness": F.least(F.greatest(0.3 + 0.175 * (c("graph_distance") - 2), F.lit(0.1)), F.lit(1.0)),
    })
    return p.filter(F.col("relatedness") >= minimum_relatedness).withColumn("quality", F.col("relatedness") * F.col("usefulness"))


def proposal_id(source: Column, target: Column, way: Column, version: str) -> Column:
    """`sha256:` and the digest of the canonical JSON list of the four strings (printable ASCII without quotes and backslashes)."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", q(source), q(target), q(way), F.lit(f'"{version}"')), F.lit("]")), 256))


def diverse_order(pairs: DataFrame, doc_tokens: DataFrame, diversity: float = 0.3, per_document: int = 10, pool: int = 2_000) -> DataFrame:
    """Maximal marginal relevance within each source: `pairs` (source, target, score) gain `position` from 0, the first `per_document` stay.

    Greedy by nature, so one Python call a source; a source's pairs are already
    bounded by its pair limit upstream, and a source with more than `pool` is an error.
    """
    joined = pairs.select("source", "target", "score").join(doc_tokens.select(F.col("doc").alias("target"), "tokens"), "target", "left")
    schema = T.StructType([pairs.schema["source"], pairs.schema["target"], T.StructField("score", T.DoubleType()), T.StructField("position", T.IntegerType())])

    def order(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > pool:
            raise ValueError("bound the pairs of a source before ordering them")
        rows = group.sort_values(["score", "target"], ascending=[False, True])
        bags = [frozenset(t) if t is not None else frozenset() for t in rows["tokens"]]
        names, scores = rows["target"].tolist(), rows["score"].tolist()
        worst, left, out = [0.0] * len(rows), list(range(len(rows))), []
        while left and len(out) < per_document:
            pick = min(left, key=lambda i: (-((1 - diversity) * scores[i] - diversity * worst[i]), -scores[i], names[i]))
            out.append(pick)
            left.remove(pick)
            for i in left:
                both = bags[i] | bags[pick]
                worst[i] = max(worst[i], len(bags[i] & bags[pick]) / len(both) if both else 0.0)
        got = rows.iloc[out]
        return pd.DataFrame({"source": got["source"], "target": got["target"], "score": got["score"], "position": range(len(out))})

    return joined.groupBy("source").applyInPandas(order, schema)


def total_order(ordered: DataFrame) -> DataFrame:
    """Global rank by (position, score falling, source, target), computed in shares of one position and put together from their sizes."""
    local = Window.partitionBy("position").orderBy(F.desc("score"), "source", "target")
    sizes = ordered.groupBy("position").agg(F.count("*").alias("n"))  # a row a position
    before = sizes.select("position", (F.sum("n").over(Window.orderBy("position")) - F.col("n")).alias("before"))
    return ordered.withColumn("r", F.row_number().over(local)).join(before, "position").select(*ordered.columns, (F.col("before") + F.col("r")).alias("rank"))


def latest_decisions(reviews: DataFrame) -> DataFrame:
    """(id, decision, reason): the decision of highest `seq` of each proposal."""
    return reviews.groupBy("id").agg(F.max_by("decision", "seq").alias("decision"), F.max_by("reason", "seq").alias("reason"))


def with_reviews(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposals with `review_status` (unreviewed without a decision) and `review_reason`."""
    return proposals.join(latest_decisions(reviews), "id", "left").select(*proposals.columns, F.coalesce("decision", F.lit("unreviewed")).alias("review_status"), F.col("reason").alias("review_reason"))


def band_thresholds(decided: DataFrame) -> DataFrame:
    """One row (high, medium), null where no decile qualifies: `decided` is (id, quality, accepted).

    Under 20 decisions the fixed thresholds hold.  Deciles go by quality
    falling; the high band runs through the leading deciles of at least 2/3
    accepted, the medium band on through those of at least 1/3.
    """
    n = decided.agg(F.count("*").alias("n"))
    d = decided.withColumn("decile", F.ntile(10).over(Window.orderBy(F.desc("quality"), "id")))  # reviewed proposals only
    rates = d.groupBy("decile").agg(F.avg(F.col("accepted").cast("double")).alias("rate"), F.min("quality").alias("low"))
    run = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    flagged = rates.withColumn("high_ok", F.min(F.col("rate") >= DECILE_RATES[0]).over(run)).withColumn("ok", F.min(F.col("rate") >= DECILE_RATES[1]).over(run))
    cut = flagged.agg(F.min(F.when(F.col("high_ok"), F.col("low"))).alias("h"), F.min(F.when(F.col("ok"), F.col("low"))).alias("m"))
    few = F.col("n") < LEAST_DECISIONS
    return n.join(cut).select(F.when(few, BANDS[0]).otherwise(F.col("h")).alias("high"), F.when(few, BANDS[1]).otherwise(F.col("m")).alias("medium"))


def banded(proposals: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Proposals with `confidence` by quality; a null threshold admits nothing."""
    b = F.when(F.coalesce(F.col("quality") >= F.col("high"), F.lit(False)), "high").when(F.coalesce(F.col("quality") >= F.col("medium"), F.lit(False)), "medium").otherwise("low")
    return proposals.join(F.broadcast(thresholds)).withColumn("confidence", b).drop("high", "medium")  # one row


def evidence(kept: DataFrame, spans: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, evidence): each pair's best matches with both units' spans; a unit without spans gives an empty list; `spans` is (unit, spans)."""
    side = lambda c: spans.select(F.col("unit").alias(c), F.col("spans").alias(f"{c}_spans"))
    rows = kept.filter(F.col("place") <= most).join(side("src_unit"), "src_unit", "left").join(side("tgt_unit"), "tgt_unit", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(spans.schema["spans"].dataType))
    item = F.struct("place", "src_unit", "tgt_unit", "sim", empty("src_unit_spans").alias("src_spans"), empty("tgt_unit_spans").alias("tgt_spans"))
    return rows.groupBy("source", "target").agg(F.array_sort(F.collect_list(item)).alias("evidence"))  # at most `most`


def review_queue(proposals: DataFrame, size: int, seed: int = 0, near: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """A stratified queue of `size` proposals in rank order: (columns, stratum).

    About 40% top ranked, 20% with a score within `near`, 20% by a seeded hash,
    20% from sources with the fewest proposals, and the rest from the top.  The
    hash order replaces a seeded shuffle.  Each stratum is a top-k; the queue
    itself has `size` rows.
    """
    fifth, order = size // 5, ["rank", "id"]
    counted = proposals.join(proposals.groupBy("source").agg(F.count("*").alias("per_source")), "source")
    taken = None

    def take(pool: DataFrame, by: list, n: int, name: str) -> None:
        nonlocal taken
        fresh = pool if taken is None else pool.join(F.broadcast(taken.select("id")), "id", "left_anti")
        part = fresh.orderBy(*by).limit(n).withColumn("stratum", F.lit(name))
        taken = part if taken is None else taken.unionByName(part)

    take(counted, order, size - 3 * fifth, "top")
    take(counted.filter(F.col("score").between(*near)), order, fifth, "near")
    take(counted, [F.xxhash64("id", F.lit(seed)), "id"], fifth, "random")
    take(counted, ["per_source", *order], fifth, "rare")
    take(counted, order, max(size, 0), "fill")
    return taken.orderBy(F.when(F.col("stratum") == "fill", 1).otherwise(0), *order).limit(max(size, 0)).drop("per_source").orderBy(*order)
