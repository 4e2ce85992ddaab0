"""Structured Streaming: windows over event time, and incremental runs over changed documents.

The batch operators cover what a run computes; this module adds what a
continuous run needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weaveline.operators.chunking import fingerprint
from weaveline.scratch import materialize


def tumbling(events: DataFrame, at: str, length: str, keys: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) of each window of `length`; the same on batches and streams."""
    e = events.withWatermark(at, watermark) if watermark else events
    return e.groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, length: str, slide: str, keys: list[str], value: str, watermark: str | None = None) -> DataFrame:
    e = events.withWatermark(at, watermark) if watermark else events
    return e.groupBy(F.window(at, length, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events less than `gap` apart; the end is the last event plus the gap."""
    e = events.withWatermark(at, watermark) if watermark else events
    return e.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def latest_by(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each key's latest row by (at, tie): an aggregate, so a hot key is reduced before the shuffle."""
    row = F.struct(*events.columns)
    return events.groupBy(key).agg(F.max_by(row, F.struct(at, tie)).alias("r")).select("r.*")


def fresh_units(units: DataFrame, cache: DataFrame, model: str, options: dict | None = None) -> DataFrame:
    """Units whose vector the cache lacks: an anti-join on the key of content, model and options; batch size and device aren't in it."""
    tag = fingerprint([model, options or {}])
    return units.withColumn("cache_key", F.sha2(F.concat_ws("|", "content_hash", F.lit(tag)), 256)).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def embed_through(units: DataFrame, cache: DataFrame, model: str, embed, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors of all units, cache with the new ones): only units that the cache lacks are embedded; wrong lengths count as missing."""
    tag = fingerprint([model, options or {}])
    keyed = units.withColumn("cache_key", F.sha2(F.concat_ws("|", "content_hash", F.lit(tag)), 256))
    missing = keyed.dropDuplicates(["cache_key"]).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    new = materialize(missing.select("cache_key", embed(F.col("text")).alias("v")), "new-vectors")
    grown = cache.unionByName(new)
    return keyed.join(grown, "cache_key").select("unit", "v"), grown


def changed_documents(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents of a batch whose (id, revision) is new, each id's last arrival."""
    last = Window.partitionBy("id").orderBy(F.desc("arrived_at"), F.desc("doc_key"))
    return batch.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r").join(seen.select("id", "revision"), ["id", "revision"], "left_anti")


def follow_documents(stream: DataFrame, state_path: str, build, checkpoint: str) -> StreamingQuery:
    """Run `build(changed documents, batch)` for every micro-batch, and record the revisions handled under `state_path`.

    A batch that is retried after a failure writes its revisions to the same
    place, so it is counted once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths = [f"{state_path}/batch={i}" for i in range(number)]
        seen = spark.read.parquet(*paths) if paths else spark.createDataFrame([], "id string, revision string")
        new = materialize(changed_documents(batch, seen), "changed")
        build(new, number)
        new.select("id", "revision").write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream without repeats of `key` within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
