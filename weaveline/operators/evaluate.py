"""Evaluation: holdout, recovery, review quality, ranking agreement, detection, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE_BUCKETS = ("1", "2-4", "5+")


def degree_bucket(degree: Column) -> Column:
    return F.when(degree <= 1, "1").when(degree <= 4, "2-4").otherwise("5+")


def holdout(edges: DataFrame, key: str, fraction: float, seed: int = 0, kinds: tuple[str, ...] = ("explicit-link",)) -> DataFrame:
    """Edges with `bucket` and `held`: of each out-degree bucket of eligible edges, round-half-even(fraction n) by hash order are held out.

    Other kinds stay visible.  Instead of one sort of a bucket, the hash that
    cuts off so many is found by ranks within 256 hash ranges and their counts.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    ok = F.col("kind").isin(list(kinds))
    deg = edges.filter(ok).groupBy("source").agg(F.count("*").alias("deg"))
    e = edges.join(deg, "source", "left").withColumn("bucket", F.when(ok, degree_bucket(F.col("deg"))))
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    e = e.withColumn("h", h).withColumn("slot", F.floor(F.col("h") / (1 << 32)).cast("int"))
    counts = e.filter("bucket is not null").groupBy("bucket", "slot").agg(F.count("*").alias("n"))  # 3 x 256 rows
    w = Window.partitionBy("bucket")
    quota = counts.select("bucket", "slot", (F.sum("n").over(w.orderBy("slot")) - F.col("n")).alias("before"), F.expr("bround(%r * sum(n) over (partition by bucket), 0)" % fraction).alias("quota"))
    ranked = e.join(F.broadcast(quota), ["bucket", "slot"], "left").withColumn("r", F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("h", key)))
    return ranked.withColumn("held", F.coalesce(F.col("bucket").isNotNull() & (F.col("before") + F.col("r") <= F.col("quota")), F.lit(False))).drop("h", "slot", "before", "quota", "r", "deg")


def unordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a < b").distinct()


def recovery(proposals: DataFrame, held: DataFrame, ks: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """One row: recall@k of held-out pairs in either end's list, MRR of the better one, recovered and held-out pairs; zeros on empty input.

    `proposals` is (source, target, rank, id); a document's list holds the
    proposals that touch it, in rank order, one a partner.
    """
    ends = proposals.select(F.col("source").alias("doc"), F.col("target").alias("other"), "rank", "id").unionByName(proposals.select(F.col("target").alias("doc"), F.col("source").alias("other"), "rank", "id"))
    first = ends.filter("doc <> other").groupBy("doc", "other").agg(F.min(F.struct("rank", "id")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"), "place")
    best = placed.groupBy("a", "b").agg(F.min("place").alias("place"))
    hits = unordered(held).join(best, ["a", "b"], "left")
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.sum(c) / n).otherwise(0.0)
    return hits.agg(
        *[F.coalesce(share(F.when(F.col("place") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(share(F.coalesce(1 / F.col("place"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.count("place").alias("recovered"),
        n.alias("held_out"),
    )


def recovery_by_degree(proposals: DataFrame, held: DataFrame, visible: DataFrame, k: int = 10) -> DataFrame:
    """(bucket, recall, held_out) by the source's visible out-degree; all buckets are present."""
    deg = visible.groupBy("source").agg(F.count("*").alias("deg"))
    h = held.select("source", "target").distinct().join(deg, "source", "left").withColumn("bucket", degree_bucket(F.coalesce("deg", F.lit(0))))
    got = proposals.filter(F.col("rank") <= k).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().withColumn("hit", F.lit(1.0))
    rows = h.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).join(got, ["a", "b"], "left").groupBy("bucket").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"), F.count("*").alias("held_out"))
    every = held.sparkSession.createDataFrame([(b,) for b in DEGREE_BUCKETS], "bucket string")
    return every.join(rows, "bucket", "left").na.fill({"recall": 0.0, "held_out": 0})


def gini(values: DataFrame) -> DataFrame:
    """One row `gini` of column x: 2 sum(i x_i) / (n sum x) - (n + 1) / n over rising x; 0 for no or all zero values.

    Equal values share their mean rank, so counts of distinct values are enough and no global sort is needed.
    """
    c = values.groupBy("x").agg(F.count("*").alias("c"))
    run = Window.orderBy("x")  # distinct counts only
    r = c.withColumn("before", F.sum("c").over(run) - F.col("c"))
    t = r.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum(F.col("x") * F.col("c") * (F.col("before") + (F.col("c") + 1) / 2)).alias("w"))
    return t.select(F.coalesce(F.when(F.col("s") > 0, 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")), F.lit(0.0)).alias("gini"))


def reviewer_quality(proposals: DataFrame, decisions: DataFrame, ks: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """One row: precision@k over decided proposals, acceptance, coverage of documents at the largest k, Gini of proposals per document."""
    d = proposals.join(decisions.select("id", "decision"), "id")
    ok = (F.col("decision") == "accept").cast("double")
    rates = d.agg(*[F.coalesce(F.avg(F.when(F.col("rank") <= k, ok)), F.lit(0.0)).alias(f"precision_at_{k}") for k in ks], F.coalesce(F.avg(ok), F.lit(0.0)).alias("acceptance_rate"))
    ends = proposals.select("rank", F.explode(F.array("source", "target")).alias("doc"))
    per = ends.groupBy("doc").agg(F.count("*").alias("x"), F.min("rank").alias("best"))
    cover = per.agg(F.coalesce(F.avg((F.col("best") <= max(ks)).cast("double")), F.lit(0.0)).alias("coverage"))
    return rates.join(cover).join(gini(per.select("x")).withColumnRenamed("gini", "concentration"))  # one row each


def rank_agreement(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    """One row comparing the top k unordered pairs of two rankings: jaccard, spearman, score_divergence, shared_pairs."""
    def top(p: DataFrame, s: str) -> DataFrame:
        first = p.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min(F.struct("rank", "id", "score")).alias("at"))
        best = first.orderBy("at.rank", "at.id").limit(k)
        return best.select("a", "b", F.row_number().over(Window.orderBy("at.rank", "at.id")).alias(f"p{s}"), F.col("at.score").alias(f"s{s}"))  # k rows

    both = top(a, "1").join(top(b, "2"), ["a", "b"], "full")
    shared = F.col("p1").isNotNull() & F.col("p2").isNotNull()
    dense = both.withColumn("shared", shared).withColumn("r1", F.row_number().over(Window.partitionBy("shared").orderBy("p1"))).withColumn("r2", F.row_number().over(Window.partitionBy("shared").orderBy("p2")))
    n = F.count(F.when(F.col("shared"), 1))
    d2 = F.sum(F.when(F.col("shared"), (F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2"))).otherwise(0))
    return dense.agg(
        F.when(F.count("*") == 0, 1.0).otherwise(n / F.count("*")).alias("jaccard"),
        F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1 - 6 * d2 / (n * (n * n - 1))).alias("spearman"),
        F.coalesce(F.max(F.abs(F.col("s1") - F.col("s2"))), F.lit(0.0)).alias("score_divergence"),
        n.alias("shared_pairs"),
    )


def exact_span_f1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row (precision, recall, f1, matched) of multiset matching on equal keys."""
    p = predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    t = p.join(g, keys, "full").na.fill({"p": 0, "g": 0}).agg(F.coalesce(F.sum(F.least("p", "g")), F.lit(0)).alias("m"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("g"), F.lit(0)).alias("g"))
    return _f1(t)


def _f1(t: DataFrame) -> DataFrame:
    zero = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    pr, rc = zero(F.col("m"), F.col("p")), zero(F.col("m"), F.col("g"))
    return t.select(pr.alias("precision"), rc.alias("recall"), zero(2 * F.col("m"), F.col("p") + F.col("g")).alias("f1"), F.col("m").alias("matched"))


def overlap_span_f1(predicted: DataFrame, gold: DataFrame, doc: str, least: float = 0.8) -> DataFrame:
    """One row (precision, recall, f1, matched): spans of one document matched one to one, greedily by Jaccard of at least `least`."""
    import pandas as pd

    both = predicted.select(F.col(doc).alias("doc"), "start", "end", F.lit(True).alias("p")).unionByName(gold.select(F.col(doc).alias("doc"), "start", "end", F.lit(False).alias("p")))

    def match(g: pd.DataFrame) -> pd.DataFrame:
        ps, gs = (g[g["p"] == side][["start", "end"]].drop_duplicates().sort_values(["start", "end"]).to_numpy() for side in (True, False))
        cand = []
        j0 = 0
        for i, (a, b) in enumerate(ps):
            while j0 < len(gs) and gs[j0][1] <= ps[0][0]:
                j0 += 1
            for j in range(j0, len(gs)):
                c, d = gs[j]
                if c >= b:
                    break
                inter = min(b, d) - max(a, c)
                if inter > 0 and inter / (max(b, d) - min(a, c)) >= least:
                    cand.append((-inter / (max(b, d) - min(a, c)), i, j))
        used_p, used_g = set(), set()
        for _, i, j in sorted(cand):
            if i not in used_p and j not in used_g:
                used_p.add(i)
                used_g.add(j)
        return pd.DataFrame({"m": [len(used_p)], "p": [len(ps)], "g": [len(gs)]})

    t = both.groupBy("doc").applyInPandas(match, "m long, p long, g long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "mpg"])
    return _f1(t)


def retrieval_metrics(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row recall@k and MRR: `results` is (query, item, rank), `gold` one (query, item) a query; a query without its item counts 0."""
    at = gold.join(results, ["query", "item"], "left")
    return at.groupBy("query").agg(F.min("rank").alias("rank")).agg(
        *[F.coalesce(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks], F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count("*").alias("queries")
    )


def judged_precision(ranked: DataFrame, ks: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """One row: precision@k over judged, not abstained rows in their order, and the judged share; `ranked` is (rank, judged boolean or null, abstained)."""
    live = ranked.filter(~F.coalesce("abstained", F.lit(False)))
    order = Window.orderBy("rank")  # a report's ranked list
    j = live.filter("judged is not null").withColumn("place", F.row_number().over(order))
    share = live.agg(F.coalesce(F.avg(F.col("judged").isNotNull().cast("double")), F.lit(0.0)).alias("judged_fraction"))
    return j.agg(*[F.coalesce(F.avg(F.when(F.col("place") <= k, F.col("judged").cast("double"))), F.lit(0.0)).alias(f"precision_at_{k}") for k in ks]).join(share)


def bpref(judged: DataFrame) -> DataFrame:
    """(query, bpref): `judged` is (query, rank, relevant); 1 - min(nonrelevant above, R) / min(R, N) averaged over the relevant, 0 if R = 0, terms 1 if N = 0."""
    by = Window.partitionBy("query")
    up = by.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rel = F.col("relevant").cast("long")
    x = judged.select("query", "relevant", F.sum(rel).over(by).alias("r"), F.sum(1 - rel).over(by).alias("n"), F.coalesce(F.sum(1 - rel).over(up), F.lit(0)).alias("above"))
    term = F.when(F.col("n") == 0, 1.0).otherwise(1 - F.least("above", "r") / F.least("r", "n"))
    return x.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("relevant"), term)) / F.nullif(F.max("r"), F.lit(0)), F.lit(0.0)).alias("bpref"))


def slices(cases: DataFrame, kinds: list[str]) -> DataFrame:
    """(slice, n, correct, accuracy) for every kind, overall and hard cases: `cases` is (kind, hard, correct); absent slices are zeros."""
    every = cases.sparkSession.createDataFrame([(k,) for k in [*kinds, "hard_case", "overall"]], "slice string")
    tagged = cases.select("correct", F.explode(F.array_compact(F.array(F.col("kind"), F.when(F.col("hard"), F.lit("hard_case")), F.lit("overall")))).alias("slice"))
    got = tagged.groupBy("slice").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"))
    return every.join(got, "slice", "left").na.fill({"n": 0, "correct": 0}).withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(0.0))


def pr_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall, accepted): `scored` is (prob, label); a score equal to a threshold is accepted.

    One pass: each row is counted once, in the last threshold it reaches, and
    the sums run down the thresholds.
    """
    if not thresholds:
        raise ValueError("thresholds must not be empty")
    cuts = sorted(set(thresholds))
    reach = F.lit(-1)
    for i, t in enumerate(cuts):
        reach = F.when(F.col("prob") >= t, i).otherwise(reach)
    base = scored.groupBy(reach.alias("i")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("p"))
    every = scored.sparkSession.createDataFrame([(i, float(t)) for i, t in [(-1, math.nan), *enumerate(cuts)]], "i int, threshold double")
    down = Window.orderBy(F.desc("i"))  # a row a threshold
    run = every.join(base, "i", "left").na.fill({"n": 0, "p": 0}).select("i", "threshold", F.sum("n").over(down).alias("accepted"), F.sum("p").over(down).alias("tp"), F.sum("p").over(Window.partitionBy()).alias("positives"))
    return run.filter("i >= 0").select("threshold", F.when(F.col("accepted") > 0, F.col("tp") / F.col("accepted")).otherwise(0.0).alias("precision"), F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"), "accepted")


def operating_point(sweep: DataFrame, least_precision: float) -> DataFrame:
    """The sweep row of highest recall with enough precision, ties by precision, then the smaller threshold; empty if none."""
    return sweep.filter(F.col("precision") >= least_precision).orderBy(F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def killed(precision_at_1: float, recall: float, *, floor_precision: float = 0.7, floor_recall: float = 0.2) -> bool:
    return recall < floor_recall or precision_at_1 < floor_precision


def with_temperature(c: Column, temperature: float) -> Column:
    """The logistic function of c / temperature, stable at both ends."""
    z = c / temperature
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def fit_temperature(scored: DataFrame, low: float = 0.05, high: float = 20.0, rounds: int = 60) -> float:
    """The temperature of least negative log-likelihood of (logit, label), searched on its inverse to 1e-9; never worse than 1.

    Each round is one aggregate over the table, of ten points of a bracket that shrinks to 2/9, as the loss is convex.
    """
    both = scored.agg(F.count_distinct("label")).first()[0]
    if both != 2:
        raise ValueError("both classes are needed")

    def losses(betas: list[float]) -> list[float]:
        z = F.when(F.col("label"), -F.col("logit")).otherwise(F.col("logit"))
        soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        return list(scored.agg(*[F.avg(soft(z * b)).alias(f"b{i}") for i, b in enumerate(betas)]).first())

    a, b = 1 / high, 1 / low
    while b - a > 1e-9 and rounds > 0:
        points = [a + (b - a) * i / 9 for i in range(10)]
        loss = losses(points)
        at = min(range(10), key=lambda i: (loss[i], i))
        a, b, rounds = points[max(at - 1, 0)], points[min(at + 1, 9)], rounds - 1
    mid = (a + b) / 2
    got, plain = losses([mid, 1.0])
    return 1 / mid if got <= plain else 1.0


def reliability_table(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, share_true) of equal-width bins, 1.0 in the last; empty bins are zeros."""
    at = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg(F.col("label").cast("double")).alias("share_true"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").na.fill({"n": 0, "mean_prob": 0.0, "share_true": 0.0})


def calibration_error(table: DataFrame) -> DataFrame:
    """One row `ece`: gaps of a reliability table weighted by size."""
    return table.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share_true"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))


def conformal_threshold(scored: DataFrame, epsilon: float) -> float:
    """Score above which answers are accepted: the ceil((n + 1)(1 - epsilon))-th smallest of the calibration scores, where right answers count as minus infinity.

    Only errors above the cut have to be ranked: the rank among all, less the
    right answers, is a rank among the errors, a top-k from below.
    """
    n, wrong = scored.agg(F.count("*"), F.coalesce(F.sum((~F.col("correct")).cast("long")), F.lit(0))).first()
    rank = math.ceil((n + 1) * (1 - epsilon))
    if rank > n:
        raise ValueError("too few calibration rows for this epsilon")
    if rank <= n - wrong:
        return -math.inf
    place = rank - (n - wrong)
    errors = scored.filter("not correct")
    if place <= wrong - place:
        return errors.orderBy("prob").limit(place).agg(F.max("prob")).first()[0]
    return errors.orderBy(F.desc("prob")).limit(wrong - place + 1).agg(F.min("prob")).first()[0]




def leave_last_out(events: DataFrame, user: str, at: str, tie: str) -> DataFrame:
    """Rows with `held`: each user's latest row by (at, tie)."""
    last = events.groupBy(user).agg(F.max(F.struct(at, tie)).alias("last"))
    return events.join(last, user).withColumn("held", F.struct(at, tie) == F.col("last")).drop("last")
