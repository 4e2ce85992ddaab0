"""Word statistics: inverted index, TF-IDF, co-occurrence, PPMI, search, taxonomy and fuzzy matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions import text as X
from weaveline.scratch import bounded_broadcast, materialize, spread


def inverted_index(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(word, doc, n) for every word of a document; documents without words have no row.  Repeated keys add up."""
    return docs.select(F.col(key).alias("doc"), F.explode(terms).alias("word")).groupBy("word", "doc").agg(F.count("*").alias("n"))


def tfidf(index: DataFrame) -> DataFrame:
    """(word, doc, n, tf, idf, tfidf) with tf = n / document length and idf = ln(documents / documents with the word), unsmoothed.

    Both sides of the idf join are aggregates by word, so a frequent word meets
    one row; the document lengths are a window-free aggregate joined by doc.
    """
    length = index.groupBy("doc").agg(F.sum("n").alias("len"))
    n_docs = length.agg(F.count("*").alias("docs"))  # one row
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n_docs)).select("word", F.log(F.col("docs") / F.col("df")).alias("idf"))
    tf = F.col("n") / F.col("len")
    return index.join(length, "doc").join(idf, "word").select("word", "doc", "n", tf.alias("tf"), "idf", (tf * F.col("idf")).alias("tfidf"))


def tfidf_search(weights: DataFrame, query: list[str], limit: int = 10) -> DataFrame:
    """The `limit` documents of highest sum of tf idf idf over the query's words (a repeated query word counts again); ties by document."""
    spark = weights.sparkSession
    q = spark.createDataFrame([(w,) for w in query], "word string").groupBy("word").agg(F.count("*").alias("times"))
    hits = weights.join(F.broadcast(q), "word")  # as many rows as the query has words
    return hits.groupBy("doc").agg(F.sum(F.col("tfidf") * F.col("idf") * F.col("times")).alias("score")).orderBy(F.desc(F.round("score", 12)), "doc").limit(limit)


def vocabulary(docs: DataFrame, text: str, size: int = 10_000, least: int = 3) -> DataFrame:
    """The `size` most frequent lower-cased words of at least `least` letters: (word, n), ties by word."""
    w = docs.select(F.explode(X.words(F.col(text))).alias("word")).filter(F.length("word") >= least)
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def cooccurrence(docs: DataFrame, key: str, text: str, vocab: DataFrame, reach: int = 20) -> DataFrame:
    """(a, b, n): ordered pairs of vocabulary words within `reach` positions, counted after other words are left out.

    Words become numbers of the vocabulary, which its size parameter bounds and
    every task holds; pairs are counted as numbers within a batch and summed
    before the one shuffle.
    """
    words = [r["word"] for r in vocab.select("word").orderBy("word").collect()]
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    size, mark = max(len(words), 1), "\u0001"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, n = sent.value, [], 0

        def summed() -> pd.DataFrame:
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"i": codes // size, "j": codes % size, "n": times})

        for batch in batches:
            for joined in batch["joined"]:
                at = np.array([i for i in map(known.get, joined.split(mark)) if i is not None], np.int64)
                for d in range(1, min(reach, len(at) - 1) + 1):
                    held.append(at[:-d] * size + at[d:])
                    n += len(at) - d
                if n > 8_000_000:
                    yield summed()
                    held, n = [], 0
        if n:
            yield summed()

    source = spread(docs.select(F.array_join(X.words(F.col(text)), mark).alias("joined")).filter("joined is not null"), "joined")
    half = source.mapInPandas(count, "i long, j long, n long")
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(words)), "i long, word string"))
    return both.join(names, "i").withColumnRenamed("word", "a").join(names.select(F.col("i").alias("j"), F.col("word").alias("b")), "j").select("a", "b", "n")


def ppmi(counts: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(a, b, n, ppmi) with max(0, log2(n total / (row column))), pairs above 0 only."""
    counts = materialize(counts, "counts")
    total = counts.agg(F.sum("n").alias("total"))  # one row
    margin, _ = bounded_broadcast(materialize(counts.groupBy("a").agg(F.sum("n").alias("m")), "margins"))
    joined = counts.join(margin, "a").join(margin.select(F.col("a").alias("b"), F.col("m").alias("m_b")), "b").join(F.broadcast(total))
    value = F.greatest(F.lit(0.0), F.log2(F.col("n") * F.col("total") / ((F.col("m") + eps) * (F.col("m_b") + eps))))
    return joined.select("a", "b", "n", value.alias("ppmi")).filter("ppmi > 0")


def shared_word_links(index: DataFrame, least_docs: int = 2, most_share: float = 0.02, top: int = 1000) -> DataFrame:
    """(word, df, docs) of the `top` words that are in at least `least_docs` and at most `most_share` of the documents.

    `docs` lists at most most_share of the documents, so a common word is never collected.
    """
    n = index.select("doc").distinct().agg(F.count("*").alias("docs"))  # one row
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    kept = df.join(F.broadcast(n)).filter((F.col("df") >= least_docs) & (F.col("df") <= F.greatest(F.lit(float(least_docs)), most_share * F.col("docs")))).orderBy(F.desc("df"), "word").limit(top).select("word", "df")
    return index.join(F.broadcast(kept), "word").groupBy("word", "df").agg(F.array_sort(F.collect_set("doc")).alias("docs"))


def top_keywords(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k words of highest TF-IDF of every document: (doc, word, rank); ties by word."""
    by = Window.partitionBy("doc").orderBy(F.desc(F.round("tfidf", 12)), "word")
    return weights.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("doc", "word", "rank")


def keyword_index(keywords: DataFrame) -> DataFrame:
    """Keyword to sorted documents and their number."""
    return keywords.groupBy("word").agg(F.array_sort(F.collect_set("doc")).alias("docs")).withColumn("n_docs", F.size("docs"))


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def sparse_values(counts: DataFrame, below: int) -> DataFrame:
    return counts.filter(F.col("n") < below)


def spelling_collisions(df: DataFrame, value: Column, key: Column) -> DataFrame:
    """Normal forms written in several ways: (key, variants, n)."""
    return df.select(value.alias("value"), key.alias("key")).filter("value is not null and key is not null").groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("variants"), F.count("*").alias("n")).filter(F.size("variants") > 1)


def untagged_mentions(docs: DataFrame, key: str, text: str, tags: DataFrame, tagged: DataFrame) -> DataFrame:
    """(doc, tag): documents whose text has a tag's words in a row, without carrying the tag.

    Instead of testing every tag on every document, runs of as many words as
    the longest tag has are looked up by equality.  `tags` is (tag), `tagged`
    (doc, tag).
    """
    keyed = tags.select("tag", F.array_join(X.words(F.col("tag")), " ").alias("run")).filter("run <> ''").withColumn("width", F.size(F.split("run", " ")))
    widths = [r["width"] for r in keyed.select("width").distinct().orderBy("width").collect()]  # at most the words of the longest tag
    grams = docs.select(F.col(key).alias("doc"), X.words(F.col(text)).alias("w"))
    runs = None
    for width in widths:
        part = grams.filter(F.size("w") >= width).select(
            "doc", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(width)), " ")))).alias("run")
        )
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return tagged.limit(0).select("doc", "tag")
    return runs.join(keyed.select("tag", "run"), "run").select("doc", "tag").distinct().join(tagged, ["doc", "tag"], "left_anti")


def fuzzy_pairs(strings: DataFrame, value: str, threshold: float = 0.8, grams: int = 2) -> DataFrame:
    """Pairs a < b of distinct strings with edit similarity of at least `threshold`: (a, b, similarity).

    A string within distance d of another keeps all but `grams` d of its grams,
    so of its rarest `grams` d + 1 grams one is shared: an index on these, of
    strings of fitting length, meets every pair without comparing all.  Strings
    too short for that bound are met through their length.
    """
    s = strings.select(F.col(value).alias("s")).filter("s is not null").distinct().withColumn("len", F.length("s"))
    padded = F.concat(F.lit("\u0001"), "s", F.lit("\u0001"))
    cut = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (grams - 1)))
    listed = s.select("s", "len", F.explode(F.transform(cut, lambda i: F.struct(F.substring(padded, i, F.lit(grams)).alias("g"), i.alias("i")))).alias("x")).select("s", "len", "x.g", F.row_number().over(Window.partitionBy("s", "x.g").orderBy("x.i")).alias("nth"))
    rarity = listed.groupBy("g", "nth").agg(F.count("*").alias("df"))
    most = F.floor((1.0 - threshold) * F.col("len") / threshold + 1e-9)  # edits that a pair with this string may have
    rank = F.row_number().over(Window.partitionBy("s").orderBy("df", "g", "nth"))
    kept = listed.join(rarity, ["g", "nth"]).withColumn("r", rank).filter(F.col("r") <= grams * most + 1).select("s", "len", "g", "nth")
    short = s.filter(F.col("len") + 1 <= grams * most + 1).select("s", "len")
    pair = lambda x, y, on: x.select(F.col("s").alias("a"), F.col("len").alias("la"), *on).join(y.select(F.col("s").alias("b"), F.col("len").alias("lb"), *on), on)
    near = F.abs(F.col("la") - F.col("lb")) <= (1.0 - threshold) * F.greatest("la", "lb") + 1e-9
    met = pair(kept, kept, ["g", "nth"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    band = short.withColumn("near", F.explode(F.sequence(F.greatest(F.lit(0), F.col("len") - F.ceil((1.0 - threshold) * F.col("len") / threshold).cast("int")), F.col("len"))))
    brief = pair(short.withColumn("near", F.col("len")), band, ["near"]).filter("a <> b").filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(brief).distinct().withColumn("similarity", X.edit_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold - 1e-12)


def metadata_index(pages: DataFrame, title: str, category: str, tags: str, description: str) -> DataFrame:
    """(kind, value, title): the titles that each category, tag and description word stands on, and each title itself.

    `tags` is text with commas or an array; tags and categories are trimmed and
    lower-cased.  Pages of one title are one entry, as titles are the index's
    keys; untitled pages have none.
    """
    listed = F.col(tags) if isinstance(pages.schema[tags].dataType, T.ArrayType) else F.split(tags, ",")
    bare = lambda c: F.lower(F.trim(c))
    p = pages.select(F.trim(title).alias("title"), F.array(bare(F.col(category))).alias("category"), F.transform(listed, bare).alias("tag"), X.words(F.col(description)).alias("description")).filter("title <> ''")
    kinds = {"title": F.array("title"), "category": F.col("category"), "tag": F.col("tag"), "description": F.col("description")}
    out = None
    for kind, values in kinds.items():
        part = p.select(F.lit(kind).alias("kind"), F.explode(values).alias("value"), "title").filter("value is not null and value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
