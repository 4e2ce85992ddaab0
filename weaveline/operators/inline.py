"""Inline proposals: scores of three heads, combination, selection under budget without overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions import text as X
from weaveline.functions.vectors import cosine
from weaveline.operators.pairs import clamp

# Fixed values of the scores and the selection.
KEYPHRASE_WEIGHT, MATCH_WEIGHT, SATURATION, SINGLE_WORD, LONG_DECAY, LONG_FLOOR = 0.7, 0.3, 0.3, 0.7, 0.15, 0.3
COMMONNESS_WEIGHT, EMBEDDING_WEIGHT, EDIT_WEIGHT, POSITION_PENALTY, OFF_PROSE = 0.4, 0.35, 0.25, 0.25, 0.05
COMBINE = {"naturalness": 0.35, "target_score": 0.45, "placement": 0.20}
ACCEPT, NATURAL_FLOOR, RESCUE, WORDS_PER_LINK, MOST_LINKS, RELEVANCE, SAME_TARGET = 0.5, 0.2, 0.7, 175, 10, 0.6, 0.3


def naturalness(keyphraseness: Column, matched: Column, words: Column) -> Column:
    mixed = (KEYPHRASE_WEIGHT * clamp(keyphraseness / SATURATION) + MATCH_WEIGHT * matched.cast("double")) / (KEYPHRASE_WEIGHT + MATCH_WEIGHT)
    factor = F.when(words < 2, SINGLE_WORD).when(words <= 3, 1.0).otherwise(F.greatest(F.lit(LONG_FLOOR), 1.0 - LONG_DECAY * (words - 3)))
    return clamp(mixed * factor)


def target_score(commonness: Column, similarity: Column, edit: Column, pool: Column) -> Column:
    mixed = (COMMONNESS_WEIGHT * clamp(commonness) + EMBEDDING_WEIGHT * clamp(similarity) + EDIT_WEIGHT * clamp(edit)) / (COMMONNESS_WEIGHT + EMBEDDING_WEIGHT + EDIT_WEIGHT)
    return clamp(mixed / (1 + F.log(F.greatest(pool.cast("double"), F.lit(1.0)))))


def placement(prose: Column, position: Column) -> Column:
    return clamp(F.greatest(prose * (1 - POSITION_PENALTY * clamp(position)), F.lit(OFF_PROSE)))


def geometric(scores: dict[str, Column], weights: dict[str, float] = COMBINE) -> Column:
    """Weighted geometric mean; a zero vetoes; a score outside [0, 1] is an error."""
    total = sum(weights.values())
    veto = bad = F.lit(False)
    logs = F.lit(0.0)
    for name, w in weights.items():
        s = scores[name]
        veto, bad = veto | (s == 0), bad | (s < 0) | (s > 1)
        logs = logs + w * F.log(F.greatest(s, F.lit(1e-300)))
    return F.when(bad, F.raise_error(F.lit("score outside [0, 1]")).cast("double")).when(veto, 0.0).otherwise(F.exp(logs / total))


def drafts(features: DataFrame, shortlist: DataFrame, titles: DataFrame, span_vectors: DataFrame | None = None, target_vectors: DataFrame | None = None) -> DataFrame:
    """The best target of each span, by the cube root of the product of the three scores, ties to the smallest id; spans without a target give none.

    `shortlist` is (source, mention, target, commonness, pool, is_title), `titles` (id, title).
    With `span_vectors` (doc, start, end, v) and `target_vectors` (target, v) the
    target score has their cosine, 0 where one is missing; without, that term is 0.
    """
    c = features.withColumnRenamed("doc", "source").join(shortlist, ["source", "mention"]).join(titles.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target", "left")
    edit = X.edit_similarity(F.lower("text"), F.lower(F.coalesce("target_title", F.lit(""))))
    similarity = F.lit(0.0)
    if span_vectors is not None and target_vectors is not None:
        c = c.join(span_vectors.select(F.col("doc").alias("source"), "start", "end", F.col("v").alias("span_v")), ["source", "start", "end"], "left").join(target_vectors.select("target", F.col("v").alias("target_v")), "target", "left")
        similarity = cosine(F.col("span_v"), F.col("target_v"))
    scored = c.withColumns({
        "naturalness": naturalness(F.col("keyphraseness"), (F.col("is_title_match") > 0) | (F.col("is_alias_match") > 0), F.col("words")),
        "target_score": target_score(F.col("commonness"), similarity, edit, F.col("pool")),
        "placement": placement(F.col("region_prose"), F.col("sentence_position")),
    }).withColumn("product", F.round(F.pow(F.col("naturalness") * F.col("target_score") * F.col("placement"), 1 / 3), 12))
    by = Window.partitionBy("source", "start", "end").orderBy(F.desc("product"), "target")
    best = scored.withColumn("r", F.row_number().over(by)).filter("r = 1").drop("r", "product", "target_title", "span_v", "target_v")
    return best.withColumn("score", geometric({n: F.col(n) for n in COMBINE}))


def check_drafts(found: DataFrame, docs: DataFrame, links: DataFrame) -> None:
    """An error if a draft's document is unknown or its span meets an existing link."""
    from weaveline.operators.spans import not_overlapping

    if found.join(docs.select(F.col("id").alias("source")), "source", "left_anti").limit(1).count():
        raise ValueError("drafts of unknown documents")
    d = found.withColumnRenamed("source", "doc")
    if d.count() != not_overlapping(d, links).count():
        raise ValueError("drafts that overlap existing links")


def partitioned(found: DataFrame, abstained: Column | None = None) -> DataFrame:
    """Drafts with `reason` (null if eligible) and `suggest_better_anchor`."""
    low = F.col("naturalness") < NATURAL_FLOOR
    rescue = low & (F.col("target_score") >= RESCUE)
    reason = F.when(abstained if abstained is not None else F.lit(False), "abstained_upstream").when(F.col("score") < ACCEPT, "below_accept_threshold").when(low & ~rescue, "below_naturalness_floor")
    return found.withColumn("reason", reason).withColumn("suggest_better_anchor", reason.isNull() & rescue)


def budget(words: Column, per_link: int = WORDS_PER_LINK, most: int = MOST_LINKS) -> Column:
    """Links a document may get: one per `per_link` words, at least one, at most `most`."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.floor(words / per_link))).cast("int")


def selected(found: DataFrame, budgets: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """Eligible drafts (source, start, end, target, score) with `adjusted` and `reason`: null if chosen, else overlaps_selected_span or over_budget.

    Greedy a document: relevance against the targets chosen so far; each choice
    drops the spans it overlaps.  `budgets` is (source, budget).  A document's
    drafts are bounded by its text.  Targets are as similar as `similar`
    (target_a, target_b, sim) says, in either order, 1 to themselves and else 0.
    """
    joined = found.select("source", "start", "end", "target", "score").join(budgets.select("source", "budget"), "source", "left")
    if similar is None:
        joined = joined.withColumn("near", F.lit(None).cast("map<string,double>"))
    else:  # each draft brings its target's similarity to the other targets of its document
        t = found.select("source", "target").distinct()
        both = similar.select("target_a", "target_b", "sim", F.lit(0).alias("turn")).unionByName(similar.select(F.col("target_b").alias("target_a"), F.col("target_a").alias("target_b"), "sim", F.lit(1).alias("turn")))
        met = t.withColumnRenamed("target", "target_a").join(both, "target_a").join(t.withColumnRenamed("target", "target_b"), ["source", "target_b"])
        one = met.groupBy("source", "target_a", "target_b").agg(F.min_by("sim", "turn").alias("sim"))
        near = one.groupBy("source", F.col("target_a").alias("target")).agg(F.map_from_entries(F.collect_list(F.struct("target_b", "sim"))).alias("near"))
        joined = joined.join(near, ["source", "target"], "left").select("source", "start", "end", "target", "score", "budget", "near")
    schema = T.StructType([joined.schema[c] for c in ("source", "start", "end", "target", "score")] + [T.StructField("adjusted", T.DoubleType()), T.StructField("reason", T.StringType())])

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        rest = g.sort_values(["start", "end", "target"]).to_dict("records")
        room = rest[0]["budget"]
        room = 1 if pd.isna(room) else int(room)
        chosen, done = [], []
        while rest and len(chosen) < room:
            targets = [c["target"] for c in chosen]

            def value(d: dict) -> float:
                same = targets.count(d["target"])
                near = dict(d["near"]) if d["near"] else {}
                most = max((1.0 if t == d["target"] else near.get(t, 0.0) for t in targets), default=0.0)
                return RELEVANCE * d["score"] - (1 - RELEVANCE) * most - SAME_TARGET * same

            best = max(rest, key=lambda d: (value(d), -d["start"], -d["end"]))
            done.append({**best, "adjusted": value(best), "reason": None})
            chosen.append(best)
            left = []
            for d in rest:
                if d is best:
                    continue
                if d["start"] < best["end"] and best["start"] < d["end"]:
                    done.append({**d, "adjusted": None, "reason": "overlaps_selected_span"})
                else:
                    left.append(d)
            rest = left
        done += [{**d, "adjusted": None, "reason": "over_budget"} for d in rest]
        return pd.DataFrame(done)[schema.names].astype({"adjusted": float})

    return joined.groupBy("source").applyInPandas(pick, schema)


def ranked_in_shares(rows: DataFrame, score: str, ties: list[str], shares: int = 1_000) -> DataFrame:
    """Rows with `rank` by (score falling, `ties`): ranked within shares of the score's range [0, 1] and put together from the shares' sizes, so no task sorts all rows."""
    cut = rows.withColumn("_share", F.floor((1 - F.col(score)) * shares).cast("int"))
    sizes = cut.groupBy("_share").agg(F.count("*").alias("_n"))  # at most `shares` + 1 rows
    before = F.broadcast(sizes.select("_share", (F.sum("_n").over(Window.orderBy("_share")) - F.col("_n")).alias("_before")))
    local = Window.partitionBy("_share").orderBy(F.desc(score), *ties)
    return cut.withColumn("_r", F.row_number().over(local)).join(before, "_share").withColumn("rank", (F.col("_before") + F.col("_r")).cast("int")).drop("_share", "_r", "_before")


def presented(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """All drafts: accepted ones ranked by score, then the rejected, which stay with their reason and no rank."""
    ok = chosen.filter("reason is null")
    ranked = ranked_in_shares(ok, "score", ["source", "start", "end"])
    out = chosen.filter("reason is not null").unionByName(rejected.select(*[c for c in chosen.columns if c != "adjusted"], F.lit(None).cast("double").alias("adjusted")))
    return ranked.unionByName(out.withColumn("rank", F.lit(None).cast("int")))
