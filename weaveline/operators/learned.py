"""Learned heads on Spark ML: training rows, hard negatives, naturalness and reranking, recommendation, graph classifier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaveline.operators import knn
from weaveline.scratch import materialize, spread

# Class prior of unlabelled spans, score under which a span is a confirmed negative.
PRIOR, CONFIRMED = 0.05, 0.2


def naturalness_label(tier: Column) -> Column:
    """1 for tier a, 0 for d, null (left out) for b and c."""
    return F.when(tier == "a", 1.0).when(tier == "d", 0.0)


def training_weight(labeled: Column, best_target: Column) -> Column:
    """1 for judged rows and confirmed negatives, the class prior for other unlabelled rows; an unknown best score confirms nothing."""
    return F.when(labeled | F.coalesce(best_target < CONFIRMED, F.lit(False)), 1.0).otherwise(PRIOR)


def training_rows(spans: DataFrame, tiers: DataFrame) -> DataFrame:
    """Spans (span_id, best_target, ...) with `label` and `weight`: judged ones by tier (span_id, tier), the rest as weak negatives; b and c are left out."""
    j = spans.join(tiers, "span_id", "left")
    judged = F.col("tier").isNotNull()
    label = F.when(judged, naturalness_label(F.col("tier"))).otherwise(0.0)
    return j.withColumn("label", label).withColumn("weight", training_weight(judged, F.col("best_target"))).filter("label is not null")


def hard_negatives(queries: DataFrame, targets: DataFrame, positives: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """(query, target, rank): the k nearest targets of each query but its positives; ties by target.

    `queries` is (query, v), `targets` (target, v), `positives` (query, target).
    As many more neighbours are sought as a query has positives at most, so
    none of the k is lost.
    """
    held = targets if exclude is None else targets.join(exclude.select("target"), "target", "left_anti")
    most = positives.groupBy("query").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    near = knn.exact_top_k(held.select(F.col("target").alias("id"), "v"), "id", "v", k + most, queries=queries.select(F.col("query").alias("id"), "v"))
    left = near.select(F.col("unit").alias("query"), F.col("neighbor").alias("target"), "sim").join(positives, ["query", "target"], "left_anti")
    by = Window.partitionBy("query").orderBy(F.desc("sim"), "target")
    return left.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.na.fill(0.0, features))


def fit_head(rows: DataFrame, features: list[str], ridge: float = 0.01) -> LogisticRegressionModel:
    """A weighted logistic head on (features, label, weight); the same for naturalness and for reranking pairs."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=ridge, maxIter=50).fit(assembled(rows, features))


def head_scores(model: LogisticRegressionModel, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    """Rows with `name`, the head's probability, and `name`_logit."""
    out = model.transform(assembled(rows, features))
    return out.withColumn(name, vector_to_array("probability")[1]).withColumn(f"{name}_logit", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def catalog_softmax(candidates: DataFrame, query: str, score: str, scale: float = 1.0) -> DataFrame:
    """Candidates with `share`: the softmax of scaled scores within each query, shifted by the maximum so that nothing overflows."""
    top = candidates.groupBy(query).agg(F.max(score).alias("_top"), F.count("*").alias("_n"))
    e = candidates.join(top, query).withColumn("_e", F.exp(scale * (F.col(score) - F.col("_top"))))
    return e.join(e.groupBy(query).agg(F.sum("_e").alias("_sum")), query).withColumn("share", F.col("_e") / F.col("_sum")).drop("_top", "_n", "_e", "_sum")


def groups_in_batches(sizes: dict[str, int], batch: int) -> list[list[str]]:
    """Whole groups, in order of their key, in batches of at most `batch` rows; a larger group is a batch of its own."""
    out: list[list[str]] = []
    room = 0
    for key in sorted(sizes):
        if not out or sizes[key] > room:
            out.append([])
            room = batch
        out[-1].append(key)
        room -= sizes[key]
    return out


def recommend(ratings: DataFrame, user: str, item: str, strength: str, k: int, rank: int = 16, rounds: int = 6, seed: int = 7, most_asked: int = 500, most_held: int = 32_000_000) -> DataFrame:
    """(user, item, rank): the k best items of each user by implicit matrix factorization, items it has left out.

    Up to `most_held` numbers of item factors are held by every task, which reads
    its users once and sends k items of each.  With more, the model ranks all
    items: k plus the most items of a user are asked for
    before those it has are taken out.  Users for whom that is more than
    `most_asked` are ranked apart over all items they don't have.
    """
    model = ALS(userCol=user, itemCol=item, ratingCol=strength, implicitPrefs=True, rank=rank, maxIter=rounds, seed=seed, coldStartStrategy="drop", checkpointInterval=1).fit(ratings)  # each round lets go of its shuffles
    if model.itemFactors.count() * rank <= most_held:
        best = _best_by_scan(model, ratings, user, item, k, rank)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), item))).drop("score")
    owned = materialize(ratings.groupBy(user).agg(F.count("*").alias("n")), "owned-items")
    light, heavy = owned.filter(F.col("n") + k <= most_asked), owned.filter(F.col("n") + k > most_asked).select(user)
    crowded = heavy.count()
    most = light.agg(F.max("n")).first()[0] or 0
    asked = model.recommendForUserSubset(light.select(user), k + most) if crowded else model.recommendForAllUsers(k + most)
    flat = asked.select(user, F.posexplode("recommendations").alias("i", "r")).select(user, F.col(f"r.{item}").alias(item), "i")
    fresh = flat.join(ratings.select(user, item), [user, item], "left_anti")
    out = fresh.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy("i", item))).filter(F.col("rank") <= k).drop("i")
    if not crowded:
        return out
    best = _best_unowned(model, ratings.select(user, item).join(heavy, user, "left_semi"), user, item, k, crowded)
    return out.unionByName(best.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), item))).filter(F.col("rank") <= k).drop("score"))


def _best_by_scan(model: ALSModel, ratings: DataFrame, user: str, item: str, k: int, rank: int, users: int = 256, tile: int = 4_096) -> DataFrame:
    """(user, item, score): the k best items that each user of `ratings` lacks; ties by item.

    Items come by falling norm, so a user is done once the norms' product is
    under its kth score.  Products in single precision only choose what is
    scored in double precision, with room for their error.
    """
    table = model.itemFactors.orderBy("id").toArrow()
    held = table["features"].combine_chunks().flatten().to_numpy().reshape(-1, rank)
    size = np.linalg.norm(held.astype(np.float64), axis=1)
    order = np.argsort(-size, kind="stable")
    sent = ratings.sparkSession.sparkContext.broadcast((table["id"].to_numpy().astype(np.int32)[order], held[order], size[order]))
    has = ratings.groupBy(F.col(user).cast("int").alias("id")).agg(F.collect_set(F.col(item).cast("int")).alias("has"))

    def best(u: np.ndarray, has: list, ids: np.ndarray, held: np.ndarray, size: np.ndarray, known: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, length = len(ids), np.linalg.norm(u, axis=1)
        own = np.sort(np.concatenate([r * n + place[np.searchsorted(known, h)] for r, h in enumerate(has)]))
        least, narrow = np.full(len(u), -np.inf), u.astype(np.float32)
        row, at, score = np.empty(0, int), np.empty(0, int), np.empty(0)
        cuts = [0, *[c for c in (64, 256, 1_024) if c < min(n, tile)], *range(tile, n, tile), n]  # few at first, as all of these are candidates
        for i, stop in zip(cuts, cuts[1:]):
            live = np.flatnonzero(length * size[i] * (1 + 1e-9) >= least)
            if not len(live):
                break
            room = 1e-5 * length[live] * size[i]
            r, c = np.nonzero(narrow[live] @ held[i:stop].T >= (least[live] - room)[:, None])
            r, c = live[r], c + i
            key = r * n + c
            new = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] != key
            r, c = r[new], c[new]
            row, at, score = np.concatenate([row, r]), np.concatenate([at, c]), np.concatenate([score, np.einsum("nk,nk->n", u[r], held[c].astype(np.float64))])
            o = np.lexsort((ids[at], -score, row))
            row, at, score = row[o], at[o], score[o]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, at, score, nth = (x[nth < k] for x in (row, at, score, nth))
            least[row[nth == k - 1]] = score[nth == k - 1]
        return row, ids[at], score

    def run(batches):
        ids, held, size = sent.value
        place = np.argsort(ids)
        known = ids[place]
        for b in batches:
            for i in range(0, len(b), users):
                some = b.iloc[i : i + users]
                row, items, score = best(np.stack(some["features"]).astype(np.float64), list(some["has"]), ids, held, size, known, place)
                yield pd.DataFrame({user: some["id"].to_numpy()[row], item: items, "score": score})

    asks = spread(model.userFactors.join(has, "id"), "id")
    return materialize(asks.mapInPandas(run, f"`{user}` int, `{item}` int, score double"), "recommended")


def _best_unowned(model: ALSModel, owned: DataFrame, user: str, item: str, k: int, users: int, user_block: int = 256, item_block: int = 4_096) -> DataFrame:
    """(user, item, score): of every block of items the k best ones that each of `users` users of `owned` (user, item) lacks; ties by item."""
    users_of, items_of = (F.lit(max(1, -(-n // size))) for n, size in ((users, user_block), (model.itemFactors.count(), item_block)))
    place = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("int")), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = model.userFactors.join(owned.select(F.col(user).cast("int").alias("id")).distinct(), "id", "left_semi").select(place("id", users_of).alias("ub"), every(items_of).alias("ib"), F.lit(True).alias("asks"), "id", "features")
    held = model.itemFactors.select(every(users_of).alias("ub"), place("id", items_of).alias("ib"), F.lit(False).alias("asks"), "id", "features")
    has = owned.select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i")).distinct().select(place("u", users_of).alias("ub"), place("i", items_of).alias("ib"), "u", "i")

    def score(block: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        u, i = block[block["asks"]], block[~block["asks"]]
        if not len(u) or not len(i):
            return pd.DataFrame({user: [], item: [], "score": []})
        scores = np.stack(u["features"]).astype(np.float64) @ np.stack(i["features"]).astype(np.float64).T
        ids, kinds = u["id"].to_numpy(), i["id"].to_numpy()
        scores[np.searchsorted(ids, had["u"]), np.searchsorted(kinds, had["i"])] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(scores, top, 1)
        out = pd.DataFrame({user: np.repeat(ids, top.shape[1]), item: kinds[top].reshape(-1), "score": best.reshape(-1)})
        return out[np.isfinite(out["score"])]

    return asks.unionByName(held).groupBy("ub", "ib").cogroup(has.groupBy("ub", "ib")).applyInPandas(score, f"`{user}` int, `{item}` int, score double")


def smoothed_features(weights: DataFrame, features: DataFrame, hops: int = 2) -> DataFrame:
    """(node, features) after `hops` steps of normalised propagation; `weights` is (a, b, w), `features` (node, features as an ML vector)."""
    for _ in range(hops):
        features = materialize(
            weights.join(features.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(Summarizer.sum(F.col("features"), F.col("w")).alias("features")), "propagated"
        )
    return features


def graph_classifier(weights: DataFrame, features: DataFrame, labels: DataFrame, hops: int = 2, seed: int = 0) -> DataFrame:
    """(node, label, predicted, train): a linear classifier on features propagated over the graph, fitted on half the nodes by hash; 0 hops is the plain ablation."""
    rows = smoothed_features(weights, features, hops).join(labels, "node").withColumn("train", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2)) == 0)
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, maxIter=50).fit(rows.filter("train"))
    return model.transform(rows).select("node", "label", F.col("prediction").alias("predicted"), "train")
