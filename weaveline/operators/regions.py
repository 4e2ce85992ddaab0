"""Region tables and links of document tables, by Python workers over the scan."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.operators import markdown as M
from weaveline.operators.chunking import grouped
from weaveline.scratch import spread

_REGION = [
    T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("language", T.StringType()),
]


#: Headings, in small letters, over lists of links that serve the graph; a corpus passes its own.
RELATED_HEADINGS = ("related", "related pages")


def region_table(docs: DataFrame, key: str, text: str, title: str | None = None, media_type: str | None = None) -> DataFrame:
    """(doc, ordinal, kind, start, end, text, level, language) of every document with text.

    A media type other than Markdown (null counts as Markdown) is read as plain
    text with its title.  Excluded documents are to be filtered before, as no
    filter moves through a Python operator.  Rows never move.
    """
    source = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("body"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), (F.col(media_type) if media_type else F.lit(None)).cast("string").alias("media")).filter("body is not null"), "doc")
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), *_REGION])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body, head, media in b.itertuples(index=False):
                found = M.plain_regions(body, head) if isinstance(media, str) and "markdown" not in media else M.regions(body)
                rows += [(doc, i, r.kind, r.start, r.end, r.text, r.level, r.language) for i, r in enumerate(found)]
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"level": "Int32"})

    return source.mapInPandas(parse, schema)


def related_regions(docs: DataFrame, key: str, text: str, related: tuple[str, ...] = RELATED_HEADINGS) -> DataFrame:
    """(doc, start, end) of the regions whose last heading is among `related`, whatever its letter case and punctuation.

    Headings and regions that sections leave out (code, metadata) are none of them.
    """
    source = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).filter(F.lower(text).contains("related")), "doc")
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body in b.itertuples(index=False):
                for path, group in grouped([vars(r) for r in M.regions(body)]):
                    if path and re.sub(r"[^a-z0-9]+", " ", path[-1].lower()).strip() in related:
                        rows += [(doc, r["start"], r["end"]) for r in group]
            yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(find, schema)


def link_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, start, end, style, target, anchor, display) of every link outside code, in document order by `start`."""
    source = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).filter(F.col(text).isNotNull() & F.col(text).contains("[")), "doc")
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("style", "target", "anchor", "display")]])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(doc, *found) for doc, body in b.itertuples(index=False) for found in M.links(body)], columns=schema.names)

    return source.mapInPandas(extract, schema)


def resolved_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links with `resolved` (null if unresolved) and `kind`; `ids` is (id).

    An empty target is the document itself.  A leading `/` and a final `.md`
    go.  A Markdown link is tried next to its document first, then from the
    root; a wiki link from the root only.
    """
    bare = F.regexp_replace(F.regexp_replace("target", "^/+", ""), r"\.md$", "")
    folder = F.regexp_extract("doc", r"^(.*)/[^/]*$", 1)
    l = links.withColumn("bare", bare).withColumn("near", F.when((F.col("style") == "markdown") & ~F.col("target").startswith("/"), _join_path(folder, bare)))
    known = ids.select("id").distinct()
    hit = l.join(known.select(F.col("id").alias("near_id")), F.col("near") == F.col("near_id"), "left").join(known.select(F.col("id").alias("root_id")), F.col("bare") == F.col("root_id"), "left")
    to = F.when(F.col("bare") == "", F.col("doc")).otherwise(F.coalesce("near_id", "root_id"))
    return hit.withColumn("resolved", to).withColumn("kind", F.when(to.isNull(), "unresolved-link").otherwise("explicit-link")).drop("bare", "near", "near_id", "root_id")


def _join_path(folder, path):
    """folder/path with `.` and `..` segments resolved; null if it leaves the root."""
    parts = F.split(F.concat_ws("/", F.when(folder != "", folder), path), "/")
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")),
        lambda s, x: F.when((x == ".") | (x == ""), s)
        .when(x == "..", F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), (s["ok"] & (F.size(s["p"]) > 0)).alias("ok")))
        .otherwise(F.struct(F.concat(s["p"], F.array(x)).alias("p"), s["ok"].alias("ok"))),
    )
    return F.when(walked["ok"], F.array_join(walked["p"], "/"))


def eligible(docs: DataFrame) -> DataFrame:
    """Documents neither excluded, generated nor archived; a null flag is false."""
    return docs.filter(~F.coalesce("is_excluded", F.lit(False)) & ~F.coalesce("is_generated", F.lit(False)) & ~F.coalesce("is_archived", F.lit(False)))
