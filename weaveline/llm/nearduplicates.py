"""Near-duplicate records by consistent sampling over shingles, weighted by TF-IDF or all alike."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.operators.graph import connected_components
from weaveline.scratch import bounded_broadcast, materialize, salted_join, spread

#: Counters of the document-frequency sketch, whatever the size of the corpus.
SKETCH = 1 << 18
_SKETCH_PART = 1 << 12
#: Passes, and bins a pass, of a signature; ROWS samples make a band, so there are 48 bands.
PASSES, BINS, ROWS = 12, 16, 4
#: Least IDF weight of a shingle, that of one in every record; 1 is the weight of one in a single record.
WEIGHTED_FLOOR, SET_FLOOR = 0.5, 0.85
#: Distinct texts of a bucket beyond which its pairs are verified block by block instead of listed.
WIDE_BUCKET = 200
#: Distinct texts a block.
BLOCK = 512
#: Copies of a text that one task pairs with other rows.
COPIES = 1_024

_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Hash of a word without letter case, remembered for the worker's batch."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.lower())
        return value


def shingles(text: str, known: WordHash, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(distinct shingle hashes in order, how often each occurs), None for a text under `least_words` words."""
    words = _WORD.findall(text)
    n = len(words) - width + 1
    if len(words) < max(least_words, 1) or n < 1:
        return None
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = h[:n].copy()
    for j in range(1, width):
        total = total * _M1 + h[j : j + n]
    return np.unique(mix(total), return_counts=True)


def idf_sketch(records: DataFrame, width: int, least_words: int) -> tuple[np.ndarray, int]:
    """(document frequency by counter, documents) over all records.

    Every partition counts into SKETCH counters and sends them as binary parts;
    these are summed in levels of 64 each, so neither a task nor the driver
    holds more than a fixed size, however many partitions there are.
    """
    parts = SKETCH // _SKETCH_PART
    schema = "part int, share int, counts binary, docs long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counters, docs = WordHash(), np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            found = [s[0] for s in (shingles(t, known, width, least_words) for t in batch["text"]) if s]
            if found:
                docs += len(found)
                counters += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        if docs:
            from pyspark import TaskContext

            share = TaskContext.get().partitionId()
            yield pd.DataFrame({"part": range(parts), "share": share, "counts": [p.tobytes() for p in counters.reshape(parts, -1)], "docs": [docs] + [0] * (parts - 1)})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "share": [0], "counts": [counts.tobytes()], "docs": [int(group["docs"].sum())]})

    def total_of(group: pd.DataFrame) -> pd.DataFrame:
        return total(group).assign(share=[int(group["share"].iloc[0]) // 64])

    summed, partitions = records.select("text").mapInPandas(count, schema), records.rdd.getNumPartitions()
    while partitions > 64:
        summed = summed.groupBy("part", F.floor(F.col("share") / 64)).applyInPandas(total_of, schema)
        partitions = -(-partitions // 64)
    summed = summed.groupBy("part").applyInPandas(total, schema)
    out, docs = np.zeros((parts, _SKETCH_PART), np.int64), 0
    for row in summed.collect():  # SKETCH counters
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
        docs += row["docs"]
    return out.reshape(-1), docs


def idf_weights(counts: np.ndarray, docs: int, floor: float = WEIGHTED_FLOOR) -> np.ndarray:
    """Damped IDF by counter, from `floor` (in every record) to 1 (in one).

    A counter's mean load by other shingles is taken off.  Damping bounds what
    weighting does to a pair: a share s of common shingles becomes at least
    floor s / (floor s + 1 - s) by weight: 0.43 for 0.6 at a floor of 0.5, 0.56 at 0.85.
    """
    df = np.maximum(counts - counts.sum() / len(counts), 1.0)
    return (floor + (1 - floor) * np.log1p(docs / df) / np.log1p(max(docs, 1))).clip(floor, 1.0).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling, bin by bin.

    For a feature of weight w, a hash gives r, c ~ Gamma(2, 1) and b ~ U(0, 1);
    t = floor(ln w / r + b), and the sample is the (feature, t) of least
    ln c - r (t - b) - r.  A pass hashes features to bins and samples in each,
    so a signature costs PASSES evaluations a feature; an empty bin takes the
    sample of the next one that isn't.
    """

    def __init__(self, passes: int = PASSES, bins: int = BINS, seed: int = 5):
        self.passes, self.bins = passes, bins
        rng = np.random.default_rng(seed)
        self.r = np.maximum(rng.gamma(2.0, 1.0, 1 << 16), 1e-3).astype(np.float32)
        self.log_c = np.log(np.maximum(rng.gamma(2.0, 1.0, 1 << 16), 1e-6)).astype(np.float32)
        self.b = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.seeds = rng.integers(1, 1 << 63, passes, dtype=np.uint64)

    def sign(self, features: np.ndarray, log_weights: np.ndarray, record: np.ndarray, records: int) -> np.ndarray:
        """(records, passes x bins) samples of the features, `record` giving each one's record."""
        low, bins = np.uint64(0xFFFF), self.bins
        out = np.empty((records, self.passes, bins), np.uint32)
        base = record.astype(np.int64) * bins
        for p in range(self.passes):
            x = mix(features ^ self.seeds[p])
            r = self.r[(x & low).astype(np.int64)]
            b = self.b[((x >> np.uint64(16)) & low).astype(np.int64)]
            t = np.floor(log_weights / r + b)
            # costs lie over -64, so with 64 added their bits sort as they do
            raw = (self.log_c[((x >> np.uint64(32)) & low).astype(np.int64)] - r * (t - b + np.float32(1)) + np.float32(64)).view(np.uint32)
            name = (x * _M1 + t.astype(np.int64).view(np.uint64) * _M3) >> np.uint64(32)
            best = np.full(records * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
            np.minimum.at(best, base + ((x >> np.uint64(60)) % np.uint64(bins)).astype(np.int64), (raw.astype(np.uint64) << np.uint64(32)) | name)
            best = best.reshape(records, bins)
            empty = best == np.uint64(0xFFFFFFFFFFFFFFFF)
            for step in range(1, bins):
                if not empty.any():
                    break
                lent = np.roll(best, -step, axis=1)
                take = empty & (np.roll(empty, -step, axis=1) == False) & (lent != np.uint64(0xFFFFFFFFFFFFFFFF))  # noqa: E712
                best = np.where(take, lent + np.uint64(step), best)
                empty = best == np.uint64(0xFFFFFFFFFFFFFFFF)
            out[:, p] = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.reshape(records, -1)


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(records, bands) 64-bit hashes of `rows` samples each and the band's number."""
    bands = signature.shape[1] // rows
    cut = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1, cut.shape[:2]).copy()
    for j in range(rows):
        total = mix(total * _M2 + cut[:, :, j])
    return total.view(np.int64)


def signatures(records: DataFrame, weights: np.ndarray, width: int, least_words: int, rows: int = ROWS, counted: bool = True) -> DataFrame:
    """(kind, key, set_a, set_b, n_shingles, bands): equal sets of shingles have equal (set_a, set_b).

    A shingle weighs its IDF (`weights` by counter), times 1 + ln of its occurrences if they are `counted`.
    """
    schema = T.StructType(
        [records.schema["kind"], records.schema["key"]]
        + [T.StructField(n, T.LongType()) for n in ("set_a", "set_b")]
        + [T.StructField("n_shingles", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sampler = WordHash(), Sampler()
        log_idf = np.log(weights)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.iloc[i : i + 1000]
                found = [shingles(t, known, width, least_words) for t in part["text"]]
                keep = [s is not None for s in found]
                found = [s for s in found if s]
                if not found:
                    continue
                sizes = np.array([len(s[0]) for s in found])
                features = np.concatenate([s[0] for s in found])
                logs = log_idf[(features & np.uint64(SKETCH - 1)).astype(np.int64)]
                if counted:
                    tf = np.concatenate([s[1] for s in found])
                    logs = np.where(tf > 1, logs + np.log1p(np.log(tf)), logs).astype(np.float32)
                bands = band_hashes(sampler.sign(features, logs, np.repeat(np.arange(len(found)), sizes), len(found)), rows)
                bands += np.array([xxhash.xxh3_64_intdigest(str(k)) for k in part["kind"][keep]], np.uint64).view(np.int64)[:, None]
                sets = [xxhash.xxh3_128_intdigest(s[0].tobytes()) for s in found]
                ids = np.array([[(s >> 64) & 0xFFFFFFFFFFFFFFFF, s & 0xFFFFFFFFFFFFFFFF] for s in sets], np.uint64).view(np.int64)
                yield pd.DataFrame({"kind": part["kind"][keep].values, "key": part["key"][keep].values, "set_a": ids[:, 0], "set_b": ids[:, 1], "n_shingles": sizes.astype(np.int32), "bands": list(bands)})

    return records.mapInPandas(run, schema)


def _weighted(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, idf: np.ndarray) -> tuple[float, float]:
    """(set, TF-IDF weighted) Jaccard similarity of two records' shingles with their counts."""
    wa = idf[(a & np.uint64(SKETCH - 1)).astype(np.int64)] * (1 + np.log(na))
    wb = idf[(b & np.uint64(SKETCH - 1)).astype(np.int64)] * (1 + np.log(nb))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum())
    return len(i) / (len(a) + len(b) - len(i)), low / (float(wa.sum()) + float(wb.sum()) - low)


def near_duplicates(
    records: DataFrame, *, width: int = 5, threshold: float = 0.8, measure: str = "weighted", least_words: int = 1, rows: int = ROWS, wide_bucket: int = WIDE_BUCKET, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the near-duplicates among records (kind, key, text) of one kind.

    links: (kind, rep_a, rep_b, jaccard, weighted), rep_a < rep_b, every found
    pair of different shingle sets with `measure` (`set` or `weighted`
    similarity) of at least `threshold`.  members: (kind, rep, key) for every
    record of `least_words` words: records with equal sets of shingles form a
    class named by its smallest key, so copies are never paired.

    Consistent samples of shingles, weighted by TF-IDF for `weighted` and by IDF
    alone for `set` (a set has no counts), are cut into bands; texts that share a
    band are candidates, and candidates are verified on all their shingles.  For
    sets the IDF is damped so that a pair at 0.6 has at least 0.56 by weight and
    so shares one of the 48 bands with probability 0.993 or more, whatever the
    weights.  The document frequencies come from a fixed-size sketch over all
    records.  A bucket of more than `wide_bucket` different texts lists no
    pairs: its texts are verified block against block, so no task grows with
    the bucket and no pair in it is left out.

    Null and short texts take no part.  Keys are unique within a kind; other
    columns are not read.
    """
    if measure not in ("set", "weighted"):
        raise ValueError("measure must be set or weighted")
    records = spread(records.select("kind", "key", "text").filter("text is not null"), "key")
    counts, docs = idf_sketch(records, width, least_words)
    idf = idf_weights(counts, docs, SET_FLOOR if measure == "set" else WEIGHTED_FLOOR)
    signed = materialize(signatures(records, idf, width, least_words, rows, measure == "weighted"), "signatures")
    sets = ["kind", "set_a", "set_b"]
    counted = materialize(signed.groupBy(*sets).agg(F.min("key").alias("rep"), F.count("*").alias("n")), "sets")
    copied, _ = bounded_broadcast(counted.filter("n > 1").select(*sets, "rep"))
    copies = materialize(salted_join(signed.select(*sets, "key"), copied, sets, "key").select("kind", "rep", "key"), "copies")
    members = counted.filter("n = 1").select("kind", "rep", F.col("rep").alias("key")).unionByName(copies)
    others, _ = bounded_broadcast(copies.filter("rep <> key").select("kind", "key"))
    texts = signed.join(others, ["kind", "key"], "left_anti").select("kind", F.col("key").alias("rep"), "n_shingles", "bands")
    posts = texts.select("kind", "rep", F.explode("bands").alias("bucket"))
    # a bucket's hash holds the kind, so that one number is the key
    shared = materialize(posts.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    met = materialize(posts.join(shared, "bucket"), "bucket-members")
    few, wide = met.filter(F.col("n") <= wide_bucket), met.filter(F.col("n") > wide_bucket)
    a, b = few.select("kind", "bucket", F.col("rep").alias("rep_a")), few.select("kind", "bucket", F.col("rep").alias("rep_b"))
    pairs = materialize(a.join(b, ["kind", "bucket"]).filter("rep_a < rep_b").select("kind", "rep_a", "rep_b").distinct(), "pairs")

    key_type = records.schema["key"].dataType
    sided = T.StructType([records.schema["kind"], T.StructField("rep", key_type), T.StructField("shingles", T.BinaryType()), T.StructField("tf", T.BinaryType())])

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for batch in batches:
            found = [shingles(t, known, width, least_words) for t in batch["text"]]
            yield pd.DataFrame({"kind": batch["kind"], "rep": batch["key"], "shingles": [s[0].tobytes() for s in found], "tf": [s[1].astype(np.uint32).tobytes() for s in found]})

    asked = pairs.select("kind", F.col("rep_a").alias("key")).union(pairs.select("kind", F.col("rep_b"))).union(wide.select("kind", F.col("rep"))).distinct()
    asked, _ = bounded_broadcast(materialize(asked, "asked"), 500_000)
    laid = materialize(records.join(asked, ["kind", "key"], "left_semi").mapInPandas(lay_out, sided), "shingles")

    linked = T.StructType([records.schema["kind"], T.StructField("rep_a", key_type), T.StructField("rep_b", key_type), T.StructField("jaccard", T.DoubleType()), T.StructField("weighted", T.DoubleType())])
    at = linked.names.index("jaccard" if measure == "set" else "weighted")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, ra, rb, sa, ta, sb, tb in batch.itertuples(index=False):
                got = (kind, ra, rb, *_weighted(np.frombuffer(sa, np.uint64), np.frombuffer(ta, np.uint32), np.frombuffer(sb, np.uint64), np.frombuffer(tb, np.uint32), idf))
                if got[at] >= threshold - 1e-12:
                    out.append(got)
            yield pd.DataFrame(out, columns=linked.names)

    side = lambda s: laid.select("kind", F.col("rep").alias(f"rep_{s}"), F.col("shingles").alias(f"s_{s}"), F.col("tf").alias(f"t_{s}"))
    listed = pairs.join(side("a"), ["kind", "rep_a"]).join(side("b"), ["kind", "rep_b"]).select("kind", "rep_a", "rep_b", "s_a", "t_a", "s_b", "t_b").mapInPandas(verify, linked)

    def verify_block(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        sets = {side: [(r.rep, np.frombuffer(r.shingles, np.uint64), np.frombuffer(r.tf, np.uint32)) for r in part.itertuples()] for side, part in (("l", left), ("r", right))}
        out, kind, within = [], group["kind"].iloc[0], group["l"].iloc[0] == group["r"].iloc[0]
        for ra, sa, ta in sets["l"]:
            for rb, sb, tb in sets["r"]:
                if (ra < rb or not within) and (measure == "weighted" or min(len(sa), len(sb)) >= (threshold - 1e-12) * max(len(sa), len(sb))):
                    got = (kind, min(ra, rb), max(ra, rb), *_weighted(sa, ta, sb, tb, idf))
                    if got[at] >= threshold - 1e-12:
                        out.append(got)
        return pd.DataFrame(out, columns=linked.names)

    blocks = wide.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    upper, lower = F.explode(F.sequence("own", F.col("blocks") - 1)), F.explode(F.sequence(F.lit(0), "own"))  # every two blocks meet once
    lefts = blocks.withColumn("l", F.col("own")).withColumn("r", upper).withColumn("left", F.lit(True))
    rights = blocks.withColumn("r", F.col("own")).withColumn("l", lower).withColumn("left", F.lit(False))
    tasks = lefts.select("kind", "bucket", "l", "r", "left", "rep").unionByName(rights.select("kind", "bucket", "l", "r", "left", "rep"))
    blocked = tasks.join(laid, ["kind", "rep"]).groupBy("kind", "bucket", "l", "r").applyInPandas(verify_block, linked)
    return materialize(listed.unionByName(blocked).dropDuplicates(["kind", "rep_a", "rep_b"]), "links"), members


def expanded_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records (kind, key_a, key_b), copies included, smaller key first.

    The copies of a text are cut into parts of about COPIES by hash, and parts
    are paired with parts, so no task lists all pairs of a text with many copies.
    """
    parts = members.groupBy("kind", "rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), (F.count("*") > 1).alias("copied"))
    parts = materialize(parts, "copy-parts").filter("copied or parts > 1").drop("copied")
    few, _ = bounded_broadcast(parts)
    sized = members.join(few, ["kind", "rep"], "left").withColumn("copied", F.col("parts").isNotNull()).na.fill({"parts": 1})
    cut = sized.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    side = lambda s: cut.select("kind", F.col("rep").alias(f"rep_{s}"), F.col("part").alias(f"part_{s}"), F.col("key").alias(f"k_{s}"))
    asked = links.select("kind", "rep_a", "rep_b")
    for s in "ab":
        every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        asked = asked.join(few.withColumnRenamed("rep", f"rep_{s}"), ["kind", f"rep_{s}"], "left").withColumn(f"part_{s}", every).drop("parts")
    met = asked.join(side("a"), ["kind", "rep_a", "part_a"]).join(side("b"), ["kind", "rep_b", "part_b"])
    across = met.select("kind", F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"))
    copies = materialize(cut.filter("copied").select("kind", "rep", "parts", "part", "key"), "copies")
    left = copies.select("kind", "rep", "part", F.col("key").alias("key_a"))
    right = copies.select("kind", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("key_b"))
    inside = left.join(right, ["kind", "rep", "part"]).filter("key_a < key_b").select("kind", "key_a", "key_b")
    return across.unionByName(inside)


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every record's group: (kind, key, group_key, rep, n_links).

    A group is a component of the links between different texts and of copies;
    `group_key` is its smallest key, `rep` the smallest key with the record's
    own set of shingles, `n_links` the number of other texts that one is linked
    to.  Records without a partner are groups of their own.
    """
    node = lambda c: F.concat_ws("|", F.col("kind"), F.col(c).cast("string"))
    cc = connected_components(links.select(node("rep_a").alias("a"), node("rep_b").alias("b")))
    counted = links.select("kind", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("n_links"))
    placed = members.withColumn("node", node("rep")).join(cc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("key").alias("group_key"))
    return placed.join(smallest, "component").join(counted, ["kind", "rep"], "left").select("kind", "key", "group_key", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))
