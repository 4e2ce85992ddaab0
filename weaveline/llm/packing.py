"""Filling containers of fixed capacity with texts."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.scratch import bounded_broadcast, materialize, spread, worker_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of that vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of one length that a single task ranks.
RANK_ROWS = 500_000
#: Ranks of a length by which planned runs and pieces meet.
SPAN_RANKS = 100_000


def load_encoding(vocabulary: str = VOCABULARY):
    """The byte-level BPE of `vocabulary`, loaded once a worker."""
    cache = worker_cache()
    if vocabulary not in cache:
        import tiktoken

        with open(os.path.realpath(vocabulary), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        cache[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[vocabulary]


def token_sizes(texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row with a text, counted over the whole text."""
    source = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null"), "key")
    schema = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    return source.mapInPandas(count, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, items, first container, offset) runs.

    Item `first rank + i` of a length goes to container `first container + i`
    at the given offset.  Containers with the same room are kept as runs of
    ids, so time and memory depend on the number of lengths, not of items.
    """
    rooms: list[int] = []  # ascending rooms that some container has
    open_runs: dict[int, list[tuple[int, int]]] = {}
    plan, containers = [], 0

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                insort(rooms, room)
                open_runs[room] = []
            open_runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, first, n = capacity, containers, -(-left // (capacity // length))
                containers += n
            each = room // length
            full = min(n, left // each)
            for layer in range(each if full else 0):
                plan.append((length, rank, full, first, capacity - room + layer * length))
                rank += full
            left -= full * each
            put_back(room - each * length, first, full)
            if full < n:
                rest = min(left, each)
                for layer in range(rest):
                    plan.append((length, rank, 1, first + full, capacity - room + layer * length))
                    rank += 1
                left -= rest
                put_back(room - rest * length, first + full, 1 if rest else 0)
                put_back(room, first + full + bool(rest), n - full - bool(rest))
    return plan


def pack(texts: DataFrame, key: str, text: str, *, capacity: int = 2048, vocabulary: str = VOCABULARY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Assignment of all texts to containers: (key, piece, n_pieces, token_start, token_end, container_id, container_offset).

    A text over `capacity` tokens is cut into pieces of `capacity` tokens and a
    rest; no other text is cut.  Only the histogram of piece lengths, at most
    `capacity` rows, reaches the driver, where best-fit decreasing over counts
    plans runs of slots; pieces take their slots by rank within their length.
    A length with more than `rank_rows` pieces is ranked in several tasks,
    whose first ranks are running sums of their counts.

    A null text has no row.  A text without tokens takes no room: its
    container is null.  Repeated rows are packed each; other columns are
    ignored.  Slots go by key, so the result doesn't depend on partitioning.
    """
    spark = texts.sparkSession
    sizes = materialize(token_sizes(texts, key, text, vocabulary), "token-sizes")
    whole = sizes.select("key", "n_tokens", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int").alias("n_pieces"))
    pieces = (
        whole.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .withColumn("token_start", F.col("piece").cast("long") * capacity)
        .withColumn("token_end", F.least("n_tokens", F.col("token_start") + capacity))
        .withColumn("length", (F.col("token_end") - F.col("token_start")).cast("int"))
    )
    histogram = {r["length"]: r["n"] for r in pieces.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    most = max(rank_rows, sum(histogram.values()) // 100_000)
    parts = spark.createDataFrame([(length, -(-n // most)) for length, n in histogram.items()], "length int, parts int")
    plan = spark.createDataFrame(
        [(length, rank, rank + n, first - rank, offset) for length, rank, n, first, offset in plan_best_fit(histogram, capacity)],
        "length int, rank_from long, rank_to long, shift long, container_offset long",
    )
    placed = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.col("parts")).cast("int"))
    # at most capacity + 100,000 rows; one row a length unless a length is hot
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    by = Window.partitionBy("length", "part").orderBy("key", "piece")
    ranked = placed.join(F.broadcast(first), ["length", "part"]).withColumn("rank", F.col("before") + F.row_number().over(by) - 1)
    out = ["key", "piece", "n_pieces", "token_start", "token_end"]
    # runs by the spans of ranks they meet, so that a join beyond the broadcast bound has no hot length
    spans = plan.withColumn("span", F.explode(F.sequence(F.floor(F.col("rank_from") / SPAN_RANKS), F.floor((F.col("rank_to") - 1) / SPAN_RANKS))))
    runs, _ = bounded_broadcast(materialize(spans, "plan"))
    taken = (
        ranked.withColumn("span", F.floor(F.col("rank") / SPAN_RANKS))
        .join(runs, ["length", "span"])
        .filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(*out, (F.col("rank") + F.col("shift")).alias("container_id"), "container_offset")
    )
    empty = pieces.filter("length = 0").select(*out, F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("container_offset"))
    return taken.unionByName(empty).withColumnRenamed("key", key)


def fill_report(assignment: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of their room that is used (null without containers)."""
    per = assignment.filter("container_id is not null").groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("pieces"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * capacity)).alias("utilization"),
    )
