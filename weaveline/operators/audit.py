"""Audit of links: agreement between annotators, tiers, report, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers from best to worst, region kinds (up to a `_`) that serve the graph only.
TIERS = ("a", "b", "c", "d")
GRAPH_ONLY = ("related", "heading", "table", "code")


def latest_sheets(labels: DataFrame, item: str, annotator: str, at: str, key: str, fields: list[str]) -> DataFrame:
    """(item, annotator, fields): each annotator's last sheet for an item by (`at`, `key`); names trimmed and lower-cased, nameless sheets dropped."""
    name = F.lower(F.trim(F.col(annotator)))
    rows = labels.select(F.col(item).alias("item"), name.alias("annotator"), F.struct(*[F.lower(F.trim(F.col(f).cast("string"))).alias(f) for f in fields]).alias("x"), F.struct(at, key).alias("o")).filter("item is not null and annotator <> ''")
    return rows.groupBy("item", "annotator").agg(F.max_by("x", "o").alias("x")).select("item", "annotator", "x.*")


def long_votes(sheets: DataFrame, fields: list[str]) -> DataFrame:
    """(item, field, annotator, answer) without null answers."""
    return sheets.select("item", "annotator", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("answer")) for f in fields])).alias("v")).select("item", "v.field", "annotator", "v.answer").filter("answer is not null")


def pairwise_kappa(votes: DataFrame) -> DataFrame:
    """(field, rater_a, rater_b, n, kappa): chance-corrected agreement of two annotators on their shared items; 1 where both always give one and the same answer.

    Shared items are summed to contingency counts map-side; the result has a
    row a pair of annotators.
    """
    side = lambda s: votes.select("item", "field", F.col("annotator").alias(f"rater_{s}"), F.col("answer").alias(f"answer_{s}"))
    both = side("a").join(side("b"), ["item", "field"]).filter("rater_a < rater_b")
    cell = both.groupBy("field", "rater_a", "rater_b", "answer_a", "answer_b").agg(F.count("*").alias("c"))
    by = ["field", "rater_a", "rater_b"]
    total = cell.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("answer_a") == F.col("answer_b"), F.col("c")).otherwise(0)).alias("same"))
    margin = lambda s: cell.groupBy(*by, F.col(f"answer_{s}").alias("answer")).agg(F.sum("c").alias(f"m_{s}"))
    chance = margin("a").join(margin("b"), [*by, "answer"]).groupBy(*by).agg(F.sum(F.col("m_a") * F.col("m_b")).alias("p"))
    o, e = F.col("same") / F.col("n"), F.coalesce("p", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, by, "left").select(*by, "n", F.when(e == 1, F.when(o == 1, 1.0).otherwise(0.0)).otherwise((o - e) / (1 - e)).alias("kappa"))


def alpha(votes: DataFrame) -> DataFrame:
    """Chance-corrected agreement for missing ratings (nominal alpha) per field: (field, n_units, n_ratings, observed, expected, alpha).

    Units with fewer than two ratings do not count; a field without pairable
    units has no row, and alpha is 1 where a single answer occurs.  Counts per
    answer are enough, so ratings of an item are never paired.
    """
    cells = votes.groupBy("field", "item", "answer").agg(F.count("*").cast("double").alias("n"))
    units = cells.groupBy("field", "item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter("m > 1")
    seen = units.groupBy("field").agg(F.count("*").alias("n_units"), F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("apart"))
    kept = cells.join(units.select("field", "item"), ["field", "item"], "left_semi").groupBy("field", "answer").agg(F.sum("n").alias("n"))
    chance = kept.groupBy("field").agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    observed = F.col("apart") / F.col("total")
    expected = (F.col("total") * F.col("total") - F.col("sq")) / (F.col("total") * (F.col("total") - 1))
    return seen.join(chance, "field").select("field", "n_units", F.col("total").cast("long").alias("n_ratings"), observed.alias("observed"), expected.alias("expected"), F.when(expected == 0, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def agreement_report(votes: DataFrame) -> DataFrame:
    """(field, kappa, alpha): mean pairwise kappa and alpha; empty without any shared item."""
    k = pairwise_kappa(votes).groupBy("field").agg(F.avg("kappa").alias("kappa"))
    return k.join(alpha(votes).select("field", "alpha"), "field", "left")


def derived_tier(target_correct: Column, anchor_natural: Column, placement_valid: Column, region: Column) -> Column:
    """d for a wrong target, c at best in regions that serve the graph only, a with a natural anchor validly placed, else b; null without a judged target."""
    good = F.coalesce(anchor_natural & placement_valid, F.lit(False))
    return F.when(target_correct.isNull(), None).when(~target_correct, "d").when(F.substring_index(region, "_", 1).isin(*GRAPH_ONLY), "c").when(good, "a").otherwise("b")


def consensus_tier(votes: DataFrame) -> DataFrame:
    """(item, tier): the majority tier, ties to the worse one."""
    n = votes.groupBy("item", "answer").agg(F.count("*").alias("n"))
    return n.groupBy("item").agg(F.max_by("answer", F.struct("n", "answer")).alias("tier"))


def audit_report(items: DataFrame, tiers: DataFrame, agreement: DataFrame, min_kappa: float = 0.6, min_clean: int = 150) -> DataFrame:
    """One row: n_items, n_labeled, tier counts, least kappa, and `go`: kappa and clean positives (a and b) reach their floors."""
    counts = tiers.agg(F.count("*").alias("n_labeled"), *[F.count(F.when(F.col("tier") == t, 1)).alias(f"tier_{t}") for t in TIERS])
    rows = items.agg(F.count("*").alias("n_items")).join(counts).join(agreement.agg(F.min("kappa").alias("min_kappa")))  # one row each
    return rows.withColumn("go", F.coalesce((F.col("min_kappa") >= min_kappa) & (F.col("tier_a") + F.col("tier_b") >= min_clean), F.lit(False)))


def allocate(counts: dict[str, int], size: int) -> dict[str, int]:
    """Quotas a stratum: proportional with at least one each, the rest to the largest remainders, ties by key; the largest strata get one each if they are more than `size`."""
    if size >= sum(counts.values()):
        return dict(counts)
    if len(counts) >= size:
        return dict.fromkeys(sorted(counts, key=lambda k: (-counts[k], k))[: max(size, 0)], 1)
    spare = {k: n - 1 for k, n in counts.items()}
    rest, room = size - len(counts), sum(spare.values())
    share = {k: rest * n / room for k, n in spare.items()}
    quota = {k: 1 + min(int(share[k]), spare[k]) for k in counts}
    while (short := size - sum(quota.values())) > 0:
        open_ = [k for k in sorted(counts, key=lambda k: (-(share[k] - int(share[k])), k)) if quota[k] < counts[k]]
        for k in open_[:short]:
            quota[k] += 1
    return quota


def stratified_sample(items: DataFrame, key: str, stratum: str, size: int, seed: int = 0) -> DataFrame:
    """About `size` items, by quotas a stratum and hash order within it.

    Only the counts a stratum reach the driver.  A hash order replaces a seeded
    shuffle, so the sample doesn't depend on partitioning.
    """
    counts = {r[stratum]: r["n"] for r in items.groupBy(stratum).agg(F.count("*").alias("n")).filter(F.col(stratum).isNotNull()).collect()}
    quota = items.sparkSession.createDataFrame(list(allocate(counts, size).items()) or [("", 0)], f"{stratum} string, quota int")
    by = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return items.join(F.broadcast(quota), stratum).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= F.col("quota")).drop("r", "quota")


def word_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def strata_key(region: Column, words: Column, topic: Column, kind: Column) -> Column:
    return F.concat_ws("|", region, word_bucket(words), topic, kind)
