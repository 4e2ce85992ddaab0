"""Evaluation passages inside training text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.scratch import bounded_broadcast, materialize, spread

_WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width space, non-joiner and joiner, word joiner, zero-width no-break space (fixed values).
_DROPPED = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_DROPPED_RE = re.compile("[­​-‍⁠﻿]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Copies of the test side where it is too large to broadcast; a passage that a third of the corpus holds then meets so many tasks.
SALTS = 32
#: Characters of test items that every task may hold.
BROADCAST_CHARS = 32_000_000


def words_of(text: str) -> list[str]:
    """Words of `text`: NFKC, soft hyphens and zero-width characters dropped, lower case, runs of letters and digits."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if _DROPPED_RE.search(text):
            text = text.translate(_DROPPED)
    return _WORD.findall(text.lower())


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions kept by winnowing: the rightmost minimum of each run of `window` hashes; a shorter array keeps its minimum."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.arange(len(views)) + (window - 1 - np.argmin(views[:, ::-1], axis=1))
    return at[np.r_[True, at[1:] != at[:-1]]]


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, from 64-bit word hashes."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * _BASE + word_hashes[j : j + n]
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total


def fingerprints(texts: DataFrame, key: str, text: str, *, shared: int = 12, k: int = 8) -> DataFrame:
    """Winnowed fingerprints of whole texts: (key, fp), each once a text.

    The window of shared - k + 1 hashes keeps, of any run of `shared` words,
    at least one k-gram, and the choice depends on that run alone; so two texts
    with `shared` consecutive words in common share a fingerprint.
    """
    if not 0 < k <= shared:
        raise ValueError("k must be from 1 to shared")
    source = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null"), "key")
    schema = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            keys, fps = [], []
            for key_, t in zip(batch["key"], batch["text"]):
                found = fingerprints_of(words_of(t), shared, k, known)
                keys.append(np.full(len(found), key_))
                fps.append(found)
            yield pd.DataFrame({"key": np.concatenate(keys) if keys else [], "fp": np.concatenate(fps) if fps else np.empty(0, np.int64)})

    return source.mapInPandas(run, schema)


def fingerprints_of(words: list[str], shared: int, k: int, known: dict[str, int]) -> np.ndarray:
    """Distinct winnowed fingerprints of a text's words, none under `shared` words; `known` remembers words' hashes."""
    if len(words) < shared:
        return np.empty(0, np.int64)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    grams = gram_hashes(np.fromiter((known[w] for w in words), np.uint64, len(words)), k)
    return np.unique(grams[winnow(grams, shared - k + 1)].view(np.int64))


def longest_shared_run(a: list[str], b: list[str], shared: int) -> int:
    """Words of the longest run that `a` and `b` have in common, 0 if under `shared`: seeds of `shared` words in both, extended to the right."""
    seeds: dict[tuple, list[int]] = {}
    for j in range(len(b) - shared + 1):
        seeds.setdefault(tuple(b[j : j + shared]), []).append(j)
    best = 0
    for i in range(len(a) - shared + 1):
        for j in seeds.get(tuple(a[i : i + shared]), ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue  # inside a run that began earlier
            n = shared
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def leaks(corpus: DataFrame, tests: DataFrame, *, doc_key: str, doc_text: str, item_key: str, item_text: str, shared: int = 12, k: int = 8, broadcast_rows: int = 200_000) -> DataFrame:
    """Documents that share at least `shared` consecutive words with a test item: (doc_key, item_key, run_words).

    Winnowed fingerprints of both sides are joined on their hash.  If the test
    side is counted to have at most `broadcast_rows` fingerprints and 32 million
    characters, every task holds it sorted and settles a corpus text as it reads
    it, so the corpus is tokenized once and never shuffled.  Beyond that both
    sides are shuffled by fingerprint, the test side repeated over salts so that
    a passage in a third of the corpus is spread.  Each pair that meets is
    settled by extending shared words over both whole texts, so hash clashes
    drop out.  `run_words` is the longest common run.

    Null, empty and short texts (under `shared` words) match nothing.  Repeated
    corpus rows and items that overlap each give their own pair.  Columns other
    than the four named are ignored.
    """
    items = tests.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).filter("item_text is not null")
    test_fp = materialize(fingerprints(items, "item", "item_text", shared=shared, k=k).select(F.col("key").alias("item"), "fp"), "test-fingerprints")
    schema = T.StructType([T.StructField(doc_key, corpus.schema[doc_key].dataType), T.StructField(item_key, tests.schema[item_key].dataType), T.StructField("run_words", T.IntegerType())])

    n_fps, (n_items, chars) = test_fp.count(), items.agg(F.count("*"), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    if max(n_fps, n_items) <= broadcast_rows and chars <= BROADCAST_CHARS:
        return _leaks_in_one_pass(corpus, doc_key, doc_text, items.toPandas(), test_fp.toPandas(), shared, k, schema)
    train_fp = fingerprints(corpus, doc_key, doc_text, shared=shared, k=k).select(F.col("key").alias("doc"), "fp")
    met = train_fp.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(
        test_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["fp", "salt"]
    )
    pairs = materialize(met.select("doc", "item").distinct(), "leak-candidates")
    asked, _ = bounded_broadcast(pairs.select("doc").distinct())
    docs = corpus.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("doc_text")).join(asked, "doc", "left_semi")
    both = pairs.join(docs.hint("merge"), "doc").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    both = both.join(items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["item", "salt"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, seen = [], {}
            for d, i, dt, it in zip(batch["doc"], batch["item"], batch["doc_text"], batch["item_text"]):
                if len(seen) > 2000:
                    seen.clear()
                for t in (dt, it):
                    if t not in seen:
                        seen[t] = words_of(t)
                n = longest_shared_run(seen[dt], seen[it], shared)
                if n:
                    rows.append((d, i, n))
            yield pd.DataFrame(rows, columns=schema.names)

    return both.mapInPandas(extend, schema)


def _leaks_in_one_pass(corpus: DataFrame, doc_key: str, doc_text: str, items: pd.DataFrame, test_fp: pd.DataFrame, shared: int, k: int, schema: T.StructType) -> DataFrame:
    """`leaks` against test items that every task can hold."""
    items = items.drop_duplicates()
    test_fp = test_fp.drop_duplicates().sort_values("fp", kind="stable")
    by_item = items.groupby("item").indices
    pairs = [(fp, row) for fp, item in zip(test_fp["fp"], test_fp["item"]) for row in by_item[item]]
    sent = corpus.sparkSession.sparkContext.broadcast((np.array([fp for fp, _ in pairs], np.int64), np.array([row for _, row in pairs], np.int64), items["item"].tolist(), items["item_text"].tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fps, owners, names, texts = sent.value
        known: dict[str, int] = {}
        item_words: dict[int, list[str]] = {}
        for batch in batches:
            rows = []
            for d, t in zip(batch["key"], batch["text"]):
                words = words_of(t)
                found = fingerprints_of(words, shared, k, known)
                start, end = np.searchsorted(fps, found), np.searchsorted(fps, found, "right")
                best: dict = {}
                for at in {int(owners[j]) for a, b in zip(start[start < end], end[start < end]) for j in range(a, b)}:
                    if at not in item_words:
                        item_words[at] = words_of(texts[at])
                    n = longest_shared_run(words, item_words[at], shared)
                    if n:
                        best[names[at]] = max(n, best.get(names[at], 0))
                rows += [(d, item, n) for item, n in best.items()]
            yield pd.DataFrame(rows, columns=schema.names)

    source = spread(corpus.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).filter("text is not null"), "key")
    return source.mapInPandas(run, schema)


def leaked_items(found: DataFrame, item_key: str) -> DataFrame:
    """Leaked test items: (item_key, n_docs, longest_run)."""
    return found.groupBy(item_key).agg(F.count("*").alias("n_docs"), F.max("run_words").alias("longest_run"))
