"""Consensus, agreement and reliability from annotators who disagree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaveline.operators import audit
from weaveline.scratch import bounded_broadcast, materialize

#: Pseudo-answers at the field's mean accuracy that smooth an annotator's own.
SMOOTHING = 5.0
#: Pairs of annotator and field whose accuracies the driver updates; more stay in tables.
MOST_NAMED = 500_000
#: Votes on a field of an item that lie in one row; larger items are summed by joins.
MOST_VOTES = 4_096


def _name(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(bare) > 0, bare)


def latest_votes(labels: DataFrame, item: str, annotator: str, fields: list[str], at: str, key: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Long votes (item, field, annotator, answer) of each annotator's latest sheet for an item.

    Names and answers are trimmed and lower-cased; sheets without a name or
    item and null answers do not count, nor do answers outside `allowed`.  The
    latest sheet by (`at`, `key`) counts as a whole, its null answers too; a
    null time is the earliest.
    """
    answers = F.struct(*[_name(F.col(f)).alias(f) for f in fields])
    sheets = labels.select(F.col(item).alias("item"), _name(F.col(annotator)).alias("annotator"), answers.alias("answers"), F.struct(F.col(at), F.col(key)).alias("order")).filter("item is not null and annotator is not null")
    last = sheets.groupBy("item", "annotator").agg(F.max_by("answers", "order").alias("answers"))
    long = last.select("item", "annotator", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("answers")[f].alias("answer")) for f in fields])).alias("v")).select("item", "v.field", "annotator", "v.answer").filter("answer is not null")
    for f, values in (allowed or {}).items():
        long = long.filter((F.col("field") != f) | F.col("answer").isin(values))
    return long


def _weighted(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Votes with their annotator's weight, 1 in the first round."""
    if weights is None:
        return votes.withColumn("w", F.lit(1.0))
    return votes.join(weights.select("annotator", "field", F.col("weight").alias("w")), ["annotator", "field"])


def _standings(weighted: DataFrame, blanks: DataFrame) -> DataFrame:
    """Per (item, field, answer): summed weight, votes, the best other answer's weight, and the answer's place.

    `blanks` adds the answers of the field that nobody gave for the item; so a
    vote of negative weight speaks for the others.  Places go by weight, then
    number of votes, then the smaller answer.
    """
    totals = weighted.select("item", "field", "answer", "w", F.lit(1).alias("one")).unionByName(blanks).groupBy("item", "field", "answer").agg(F.round(F.sum("w"), 9).alias("weight"), F.sum("one").alias("n"))
    group = Window.partitionBy("item", "field")  # as many rows as the field has answers
    order = group.orderBy(F.desc("weight"), F.desc("n"), "answer")
    return totals.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.sum("n").over(group).alias("n_votes"),
        F.sum(F.exp(F.least("weight", F.lit(50.0)))).over(group).alias("mass"),
        F.lead("weight").over(order).alias("next"),
        F.max("weight").over(group).alias("best"),
    ).withColumn("rival", F.when(F.col("place") == 1, F.coalesce("next", F.lit(0.0))).otherwise(F.col("best")))


def blank_answers(votes: DataFrame) -> DataFrame:
    """Every answer of a field for every item voted on, at weight 0."""
    answers = votes.select("field", "answer").distinct()
    return votes.select("item", "field").distinct().join(answers, "field").select("item", "field", "answer", F.lit(0.0).alias("w"), F.lit(0).alias("one"))


def _judged(weighted: DataFrame, blanks: DataFrame) -> DataFrame:
    """(annotator, field, hits, n_judged): votes scored against the consensus of the item's other votes, by joins."""
    standings = _standings(weighted, blanks).filter("n > 0 and n_votes > 1").select("item", "field", "answer", "weight", "rival")
    own = F.round(F.col("weight") - F.col("w"), 9)
    hit = F.when(own > F.col("rival"), 1.0).when(own == F.col("rival"), 0.5).otherwise(0.0)
    return weighted.join(standings, ["item", "field", "answer"]).groupBy("annotator", "field").agg(F.sum(hit).alias("hits"), F.count("*").alias("n_judged"))


def judge(row: np.ndarray, voter: np.ndarray, answer: np.ndarray, weights: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Hit (1, 0.5, 0) of every vote against its row's other votes: `row` in order, `answers` the number of answers that each row's field has."""
    w, width = weights[voter], int(answer.max()) + 1
    cell, at, n = np.unique(row * width + answer, return_inverse=True, return_counts=True)
    total, owner = np.round(np.bincount(at, w, len(cell)), 9), cell // width
    order = np.lexsort((-total, owner))
    first = np.searchsorted(owner, np.arange(len(answers)))  # cells lie in order of their rows, before and after sorting within them
    given = np.diff(np.append(first, len(cell)))
    floor = np.where(given < answers, 0.0, -np.inf)  # an answer that nobody gave stands at 0
    best = np.maximum(total[order[first]], floor)
    second = np.maximum(np.where(given > 1, total[order[np.minimum(first + 1, len(cell) - 1)]], -np.inf), floor)
    second = np.where(np.isinf(second), 0.0, second)
    rival = best[owner]
    rival[order[first]] = second
    own = np.round(total[at] - w, 9)
    return np.where(own > rival[at], 1.0, np.where(own == rival[at], 0.5, 0.0))


def _log_odds(accuracy, k):
    sure = np.clip(accuracy, 0.02, 0.98)
    return np.log(sure * (k - 1) / (1 - sure))


def reliability(
    votes: DataFrame, *, rounds: int = 100, tolerance: float = 5e-3, smoothing: float = SMOOTHING, most_named: int = MOST_NAMED, most_votes: int = MOST_VOTES
) -> DataFrame:
    """Reliability of every annotator per field: (annotator, field, n_judged, accuracy, weight, rounds, stable).

    Iteratively reweighted voting.  Each round weighs all votes, and scores a
    vote against the consensus of the item's other votes (its own weight taken
    out; a tie counts half); an annotator's accuracy is smoothed towards the
    field's mean and averaged with the one before, and the next weight is its
    log-odds against the other answers, negative below chance.  It stops when
    no accuracy moves by `tolerance`; `stable` says whether it did within
    `rounds`.  A vote alone on its item is not judged.

    Votes are laid out once, a row an item and field; a round is then a pass
    over these rows with the weights, and one exchange of sums an annotator.
    Items with more than `most_votes` votes on a field are summed by joins
    instead, map-side first, and so is everything where (annotator, field) pairs
    are more than `most_named`, which then never reach the driver.
    """
    spark = votes.sparkSession
    votes = votes.select("item", "field", "annotator", "answer")
    named = materialize(votes.groupBy("annotator", "field").agg(F.count("*").alias("n_votes")), "annotators")
    k = votes.groupBy("field").agg(F.greatest(F.count_distinct("answer"), F.lit(2)).alias("k"))
    if named.count() > most_named:
        return _reliability_by_joins(votes, named, materialize(k, "answers-a-field"), rounds, tolerance, smoothing)
    names = named.join(k, "field").orderBy("field", "annotator").toPandas()  # at most `most_named`
    schema = "annotator string, field string, n_judged long, accuracy double, weight double, rounds int, stable boolean"
    if not len(names):
        return spark.createDataFrame([], schema)
    names["code"] = np.arange(len(names))
    field_code, fields = pd.factorize(names["field"])
    ks = names["k"].to_numpy()
    codes = F.broadcast(spark.createDataFrame(names[["annotator", "field", "code"]].assign(f=field_code)))
    places = votes.select("field", "answer").distinct().withColumn("y", F.row_number().over(Window.partitionBy("field").orderBy("answer")) - 1)
    places, _ = bounded_broadcast(materialize(places, "answers"))
    sizes = votes.groupBy("item", "field").agg(F.count("*").alias("n"))
    large, _ = bounded_broadcast(materialize(sizes.filter(F.col("n") > most_votes).select("item", "field"), "large-items"))
    numbered = votes.join(large, ["item", "field"], "left_anti").join(codes, ["annotator", "field"]).join(places, ["field", "answer"])
    rows = numbered.groupBy("item", "f").agg(F.collect_list("code").alias("a"), F.collect_list("y").alias("y")).filter(F.size("a") > 1)  # up to `most_votes` each
    rows = materialize(rows.select("f", "a", "y"), "vote-rows")
    hot = materialize(votes.join(large, ["item", "field"], "left_semi").join(codes.select("annotator", "field", "code"), ["annotator", "field"]), "votes-on-large-items") if large.limit(1).count() else None
    blanks = materialize(blank_answers(hot), "blanks") if hot is not None else None
    field_answers = np.array([ks[field_code == i][0] for i in range(len(fields))])

    def tally(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hits, n = np.zeros(len(sent.value)), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                if len(batch):
                    row = np.repeat(np.arange(len(batch)), batch["a"].str.len())
                    voter, answer = (np.concatenate(batch[c].to_list()).astype(np.int64) for c in "ay")
                    hits += np.bincount(voter, judge(row, voter, answer, sent.value, field_answers[batch["f"]]), len(hits))
                    n += np.bincount(voter, minlength=len(hits))
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"code": seen, "hits": hits[seen], "n": n[seen]})

        parts = rows.mapInPandas(run, "code long, hits double, n long")
        if hot is not None:
            w = F.broadcast(spark.createDataFrame(pd.DataFrame({"code": np.arange(len(weights)), "w": weights})))
            of_hot = _judged(hot.join(w, "code"), blanks).join(codes, ["annotator", "field"])
            parts = parts.unionByName(of_hot.select("code", "hits", F.col("n_judged").alias("n")))
        hits, n = np.zeros(len(weights)), np.zeros(len(weights), np.int64)
        for r in parts.groupBy("code").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect():  # at most `most_named`
            hits[r["code"]], n[r["code"]] = r["hits"], r["n"]
        sent.destroy()
        return hits, n

    weights, accuracy = np.ones(len(names)), None
    for step in range(1, rounds + 1):
        hits, judged = tally(weights)
        in_field = np.bincount(field_code, judged)
        mean = np.where(in_field > 0, np.bincount(field_code, hits) / np.maximum(in_field, 1), 0.5)[field_code]
        fresh = (hits + smoothing * mean) / (judged + smoothing)
        fresh = fresh if accuracy is None else (fresh + accuracy) / 2
        moved = np.inf if accuracy is None else float(np.abs(fresh - accuracy).max())
        accuracy, weights = fresh, _log_odds(fresh, ks)
        if moved < tolerance:
            break
    found = names[["annotator", "field"]].assign(n_judged=judged, accuracy=accuracy, weight=weights, rounds=step, stable=moved < tolerance)
    return spark.createDataFrame(found, schema)


def _reliability_by_joins(votes: DataFrame, named: DataFrame, k: DataFrame, rounds: int, tolerance: float, smoothing: float) -> DataFrame:
    """`reliability` without anything on the driver."""
    votes, blanks, weights = materialize(votes, "votes"), materialize(blank_answers(votes), "blanks"), None
    for step in range(1, rounds + 1):
        tally = named.join(_judged(_weighted(votes, weights), blanks), ["annotator", "field"], "left").na.fill({"hits": 0.0, "n_judged": 0})
        mean = tally.groupBy("field").agg(F.coalesce(F.sum("hits") / F.nullif(F.sum("n_judged"), F.lit(0)), F.lit(0.5)).alias("mean"))
        fresh = (F.col("hits") + smoothing * F.col("mean")) / (F.col("n_judged") + smoothing)
        new = tally.join(mean, "field").join(k, "field")
        if weights is not None:
            new = new.join(weights.select("annotator", "field", F.col("accuracy").alias("was")), ["annotator", "field"])
            fresh = (fresh + F.col("was")) / 2
        else:
            new = new.withColumn("was", F.lit(None).cast("double"))
        sure = F.least(F.greatest(fresh, F.lit(0.02)), F.lit(0.98))
        weights = materialize(
            new.select("annotator", "field", "n_judged", fresh.alias("accuracy"), F.log(sure * (F.col("k") - 1) / (1 - sure)).alias("weight"), F.lit(step).alias("rounds"), F.abs(fresh - F.col("was")).alias("moved")), "reliability"
        )
        moved = weights.agg(F.max("moved")).first()[0] if step > 1 else None
        if moved is not None and moved < tolerance:
            break
    stable = step > 1 and (moved is None or moved < tolerance)
    return weights.drop("moved").withColumn("stable", F.lit(stable))


def consensus(votes: DataFrame, weights: DataFrame, *, least: int = 3) -> DataFrame:
    """Weighted consensus of every item and field with at least `least` votes: (item, field, answer, n_votes, share, confidence).

    `share` is the part of the votes that gave the answer, `confidence` its
    posterior under the annotators' weights.
    """
    best = _standings(_weighted(votes, weights), blank_answers(votes)).filter((F.col("place") == 1) & (F.col("n_votes") >= least))
    return best.select("item", "field", "answer", "n_votes", (F.col("n") / F.col("n_votes")).alias("share"), (F.exp(F.least("weight", F.lit(50.0))) / F.col("mass")).alias("confidence"))


def agreement(votes: DataFrame) -> DataFrame:
    """Chance-corrected agreement for missing ratings per field: see `audit.alpha`."""
    return audit.alpha(votes)
