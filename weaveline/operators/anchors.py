"""The anchor dictionary: which texts link where, how often, and how often they occur."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.scratch import materialize, spread

# Fixed values of the dictionary.
KEYPHRASENESS_FLOOR, MOST_WORDS, LEAST_CHARS = 0.065, 5, 3
_PIECE = rf"({X.WORD}+|[^\p{{L}}\p{{N}}_])"


def admissible(mention: Column) -> Column:
    return mention.isNotNull() & (F.length(mention) >= LEAST_CHARS) & (F.size(F.split(mention, " ")) <= MOST_WORDS)


def anchor_counts(links: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, target, origin, cnt): `links` is (source, target, anchor_text), `docs` (id, title), `aliases` (id, alias).

    Linked anchors count where both ends are documents; titles and aliases
    count once each.  Keys are normalised; short, long and empty ones go.
    """
    here = docs.select("id").distinct()
    linked = links.join(here.select(F.col("id").alias("source")), "source", "left_semi").join(here.select(F.col("id").alias("target")), "target", "left_semi").select(X.mention_key(F.col("anchor_text")).alias("mention"), "target", F.lit("linked").alias("origin"))
    titles = docs.select(X.mention_key(F.col("title")).alias("mention"), F.col("id").alias("target"), F.lit("title").alias("origin")).distinct()
    other = aliases.select(X.mention_key(F.col("alias")).alias("mention"), F.col("id").alias("target"), F.lit("alias").alias("origin")).distinct()
    return linked.unionByName(titles).unionByName(other).filter(admissible(F.col("mention"))).groupBy("mention", "target", "origin").agg(F.count("*").alias("cnt"))


def commonness(counts: DataFrame) -> DataFrame:
    """(mention, target, cnt, commonness): a target's share of all counts of the mention; sums by key, without a window over a hot mention."""
    per = counts.groupBy("mention", "target").agg(F.sum("cnt").alias("cnt"))
    return per.join(per.groupBy("mention").agg(F.sum("cnt").alias("total")), "mention").select("mention", "target", "cnt", (F.col("cnt") / F.col("total")).alias("commonness"))


def pieces(c: Column) -> Column:
    """Lower-cased word runs and single other characters, white space collapsed to one blank."""
    return F.regexp_extract_all(F.lower(X.collapse_space(c)), F.lit(_PIECE), F.lit(1))


def occurrences(docs: DataFrame, text: str, mentions: DataFrame, most_held: int = 200_000) -> DataFrame:
    """(mention, occurrences): how often each of `mentions` (mention) stands in the texts at word boundaries, 0 included.

    Texts and mentions are cut into the same pieces, so an occurrence is a run
    of pieces, built only where a mention's first piece stands.  Up to
    `most_held` mentions are held by every task, which reads its texts once and
    sends sums; more are met by a join on the first piece.
    """
    m = mentions.select("mention").distinct().withColumn("p", pieces(F.col("mention"))).select("mention", F.size("p").alias("width"), F.col("p")[0].alias("head"), F.array_join("p", "").alias("run"))
    m = materialize(m, "mentions")
    n, size = m.agg(F.count("*"), F.coalesce(F.sum(F.length("run")), F.lit(0))).first()
    texts = docs.select(pieces(F.col(text)).alias("p")).filter("p is not null")
    if n <= most_held and size <= 20 * most_held:
        counted = _counted_in_one_pass(texts, {r["run"]: (r["head"], r["width"]) for r in m.collect()})
    else:
        begun = texts.select("p", F.posexplode("p").alias("i", "head")).join(m.select("head", "width").distinct(), "head").filter(F.col("i") + F.col("width") <= F.size("p"))
        counted = begun.select(F.array_join(F.slice("p", F.col("i") + 1, F.col("width")), "").alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    return m.join(counted, "run", "left").select("mention", F.coalesce("n", F.lit(0)).alias("occurrences"))


def _counted_in_one_pass(texts: DataFrame, mentions: dict[str, tuple[str, int]]) -> DataFrame:
    """(run, n) of mentions that every task can hold: texts are read once, and a run is built only where its first piece begins a mention of its width."""
    widths: dict[str, set[int]] = {}
    for head, width in mentions.values():
        widths.setdefault(head, set()).add(width)
    sent = texts.sparkSession.sparkContext.broadcast(({h: sorted(w) for h, w in widths.items()}, frozenset(mentions)))
    mark = "\u0001"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins, known = sent.value
        found: Counter[str] = Counter()
        for batch in batches:
            for joined in batch["joined"]:
                p = joined.split(mark)
                for i, w in enumerate(p):
                    for width in begins.get(w, ()):
                        run = "".join(p[i : i + width]) if width > 1 else w
                        if run in known and i + width <= len(p):
                            found[run] += 1
        yield pd.DataFrame(list(found.items()), columns=["run", "n"]).astype({"run": str, "n": "int64"})

    return spread(texts.select(F.array_join("p", mark).alias("joined")), "joined").mapInPandas(count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def keyphraseness(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(mention, linked, occurrences, keyphraseness): min(1, linked / occurrences), 0 without occurrences; titles and aliases don't count as links."""
    linked = counts.groupBy("mention").agg(F.sum(F.when(F.col("origin") == "linked", F.col("cnt")).otherwise(0)).alias("linked"))
    k = F.when(F.col("occurrences") > 0, F.least(F.lit(1.0), F.col("linked") / F.col("occurrences"))).otherwise(0.0)
    return linked.join(seen, "mention").select("mention", "linked", "occurrences", k.alias("keyphraseness"))


def eligible(counts: DataFrame, phrases: DataFrame, floor: float = KEYPHRASENESS_FLOOR) -> DataFrame:
    """(mention, is_title, is_alias, keyphraseness) of titles, aliases and mentions linked often enough."""
    kinds = counts.groupBy("mention").agg(F.max(F.col("origin") == "title").alias("is_title"), F.max(F.col("origin") == "alias").alias("is_alias"))
    return kinds.join(phrases.select("mention", "keyphraseness"), "mention").filter(F.col("is_title") | F.col("is_alias") | (F.col("keyphraseness") >= floor))


def anchor_stats(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(stat, value): numbers of mentions and counts by origin, and the deciles of keyphraseness, linearly interpolated."""
    totals = counts.agg(F.count_distinct("mention").cast("double").alias("mentions"), *[F.sum(F.when(F.col("origin") == o, F.col("cnt")).otherwise(0)).cast("double").alias(o) for o in ("linked", "title", "alias")])
    tens = phrases.agg(F.percentile("keyphraseness", F.array(*[F.lit(i / 10) for i in range(11)])).alias("p"))
    flat = totals.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in totals.columns]), F.array(*totals.columns))).alias("stat", "value"))
    return flat.unionByName(tens.select(F.posexplode("p").alias("i", "value")).select(F.concat(F.lit("p"), F.col("i") * 10).alias("stat"), "value"))


def targets_of(mentions: DataFrame, common: DataFrame, titles: DataFrame, most: int = 5) -> DataFrame:
    """(source, mention, target, commonness, pool, is_title): the shortlist of each (source, mention), never the source itself.

    Dictionary targets and exact titles, by (count, title match, id); `pool` is
    the number of all targets.  `titles` is (mention, target).
    """
    asked = mentions.select("source", "mention").distinct()
    t = titles.select("mention", "target").distinct().withColumn("is_title", F.lit(True))
    merged = common.join(t, ["mention", "target"], "full").select("mention", "target", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("commonness", F.lit(0.0)).alias("commonness"), F.coalesce("is_title", F.lit(False)).alias("is_title"))
    cand = asked.join(merged, "mention").filter("source <> target")
    by = Window.partitionBy("source", "mention")
    ranked = cand.withColumn("pool", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("cnt"), F.desc("is_title"), "target")))
    return ranked.filter(F.col("r") <= most).select("source", "mention", "target", "commonness", "pool", "is_title")
