"""Semantic units: section chunks, document and title views, identities."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions import text as X

_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
EXCLUDED = ("code", "metadata", "boilerplate")

UNIT = T.StructType([
    T.StructField("unit", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("view", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("section_path", T.ArrayType(T.StringType())),
    T.StructField("region_kinds", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("text", T.StringType()), T.StructField("token_count", T.LongType()), T.StructField("content_hash", T.StringType()),
])


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def canonical_json(value) -> str:
    """Sorted keys, compact separators, ASCII; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def fingerprint(value) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def combine_fingerprints(*parts: str) -> str:
    """Fingerprint of the list of parts: order counts, at least one part."""
    if not parts:
        raise ValueError("no parts")
    return fingerprint(list(parts))


def unit_ids(doc: str, drafts: list[tuple[str, list[str], str]]) -> list[str]:
    """Ids of (view, path, text) drafts: document, view and 12 hexadecimal digits of their content; repeats get ~1, ~2 in order."""
    seen: dict[str, int] = {}
    out = []
    for view, path, text in drafts:
        base = f"{doc}#{view}#{hashlib.sha256(canonical_json([view, path, text]).encode()).hexdigest()[:12]}"
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(base if n == 0 else f"{base}~{n}")
    return out


def grouped(regions: list[dict], excluded: tuple[str, ...] = EXCLUDED) -> list[tuple[list[str], list[dict]]]:
    """Regions with text in runs under their path of headings."""
    out: list[tuple[list[str], list[dict]]] = []
    path: list[tuple[int, str]] = []
    fresh = True
    for r in regions:
        if r["kind"] == "heading":
            level = r["level"] or 1
            path = [p for p in path if p[0] < level]
            if r["text"].strip():
                path = [*path, (level, r["text"].strip())]
            fresh = True
        elif r["kind"] != "title" and r["kind"] not in excluded and r["text"].strip():
            if fresh:
                out.append(([t for _, t in path], []))
                fresh = False
            out[-1][1].append(r)
    return out


def _windows(text: str, room: int, overlap: int) -> list[str]:
    """Substrings of whole words with at most `room` tokens, each behind the last words, up to `overlap` tokens, of the one before it.

    A word of more than `room` tokens is a window of its own.
    """
    words = [m.span() for m in re.finditer(r"\S+", text)]
    upto = list(accumulate((count_tokens(text[a:b]) for a, b in words), initial=0))
    cuts = [0]
    while cuts[-1] < len(words):
        cuts.append(max(bisect_right(upto, upto[cuts[-1]] + room) - 1, cuts[-1] + 1))
    out = []
    for before, i, j in zip([0, *cuts], cuts, cuts[1:]):
        k = max(bisect_left(upto, upto[i] - overlap), before) if overlap else i
        body = text[words[i][0] : words[j - 1][1]]
        out.append(f"{text[words[k][0] : words[i - 1][1]]} {body}" if k < i else body)
    return out


def section_chunks(title: str, path: list[str], group: list[dict], target: int, most: int, overlap: int) -> list[tuple[str, list[dict]]]:
    """(text, regions) chunks of a group, each under its context of title and headings.

    A group that fits `most` with its context stays whole.  Else a region that
    doesn't fit gives its paragraphs, and a paragraph that doesn't fit gives
    runs of words, which repeat the end of the run before in prose; then these
    pieces are packed in order up to `target`.  Tokens add up over white space,
    so sizes are sums.
    """
    context = " > ".join(x for x in [title.strip(), *path] if x)
    own = count_tokens(context)
    fits = lambda text: own + count_tokens(text) <= most
    under = lambda texts: "\n\n".join([context] * bool(context) + texts)
    if own + sum(count_tokens(r["text"]) for r in group) <= most:
        return [(under([r["text"] for r in group]), group)]
    chunks: list[tuple[list[str], list[dict]]] = []
    size = 0
    for r in group:
        paragraphs = [r["text"]] if fits(r["text"]) else [p.strip() for p in _PARAGRAPH.split(r["text"]) if p.strip()]
        repeat = overlap if r["kind"] == "prose" else 0
        for piece in chain.from_iterable([p] if fits(p) else _windows(p, max(1, min(target, most - repeat) - own), repeat) for p in paragraphs):
            n = count_tokens(piece)
            if not chunks or size + n > target:
                chunks.append(([], []))
                size = own
            chunks[-1][0].append(piece)
            if not chunks[-1][1] or chunks[-1][1][-1] is not r:
                chunks[-1][1].append(r)
            size += n
    return [(under(texts), used) for texts, used in chunks]


def section_units(regions: DataFrame, titles: DataFrame, *, target: int = 200, most: int = 250, overlap: int = 30, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Section-view units of documents: `regions` of `region_table`, `titles` (doc, title).

    One document's regions meet in one task, which its size bounds.  A document
    without text has no unit.
    """
    if not 0 <= overlap < target <= most:
        raise ValueError("need 0 <= overlap < target <= most")

    def build(g: pd.DataFrame) -> pd.DataFrame:
        doc, title = g["doc"].iloc[0], g["title"].iloc[0] if isinstance(g["title"].iloc[0], str) else ""
        rows = g.sort_values("ordinal")[["kind", "level", "text", "start", "end"]].to_dict("records")
        for r in rows:
            r["level"] = None if pd.isna(r["level"]) else int(r["level"])
        drafts = [(path, text, used) for path, group in grouped(rows, excluded) for text, used in section_chunks(title, path, group, target, most, overlap)]
        ids = unit_ids(doc, [("section", path, text) for path, text, _ in drafts])
        out = [
            (i, doc, "section", n, path, list(dict.fromkeys(r["kind"] for r in used)), [{"start": r["start"], "end": r["end"]} for r in used], text, count_tokens(text), "sha256:" + hashlib.sha256(text.encode()).hexdigest())
            for n, (i, (path, text, used)) in enumerate(zip(ids, drafts))
        ]
        return pd.DataFrame(out, columns=UNIT.names)

    return regions.join(titles.select("doc", "title"), "doc", "left").groupBy("doc").applyInPandas(build, UNIT)


def document_view(regions: DataFrame, titles: DataFrame, most: int = 512, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(doc, text, token_count): title, headings, then body, whole regions up to the first that would pass `most` tokens.

    Token counts add up over blank lines, so a running sum finds the cut.
    """
    body = regions.filter(~F.col("kind").isin("title", *excluded) & (X.strip_space(F.col("text")) != "")).select("doc", (F.col("kind") != "heading").cast("int").alias("late"), "ordinal", X.strip_space(F.col("text")).alias("text"))
    head = titles.filter(X.strip_space(F.coalesce("title", F.lit(""))) != "").select("doc", F.lit(-1).alias("late"), F.lit(-1).alias("ordinal"), X.strip_space(F.col("title")).alias("text"))
    by = Window.partitionBy("doc").orderBy("late", "ordinal")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    sized = head.unionByName(body).withColumn("n", X.token_count(F.col("text"))).withColumn("sum", F.sum("n").over(run))
    kept = sized.withColumn("out", F.max(((F.col("late") >= 0) & (F.col("sum") > most)).cast("int")).over(run)).filter("out = 0")
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("late", "ordinal", "text"))), lambda s: s["text"]), "\n\n").alias("text"), F.sum("n").alias("token_count"))


def title_view(title: Column, aliases: Column, description: Column) -> Column:
    """Title, aliases and description, one a line, blanks left out; null if nothing is left."""
    lines = F.filter(F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")), F.array(description)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def word_windows(paragraph: Column, size: int = 100, overlap: int = 20) -> Column:
    """Windows of `size` words with a stride of size - overlap, as array<string>.

    A paragraph of more words than `overlap` also ends in a window of its last
    `overlap` words, as the sliding goes on until it makes no progress.
    """
    w = X.split_space(paragraph)
    n = F.size(w)
    stride = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)))
    reach = F.filter(starts, lambda s: (s == 0) | (s + overlap < n))
    cut = F.transform(reach, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))
    extra = F.when(n > overlap, F.array(F.array_join(F.slice(w, n - overlap + 1, F.lit(overlap)), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(n > 0, F.concat(cut, extra)).otherwise(F.array().cast("array<string>"))


def header_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, doc_title, section, heading, level, paragraph, text) of paragraphs between ATX headers.

    Headers inside code count too; text before the first header is dropped when
    there is one; the document's title is its first level-1 header.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("doc_title", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("paragraph", T.IntegerType()), T.StructField("text", T.StringType())])
    header = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, body in b.itertuples(index=False):
                body = body.replace("\r\n", "\n").replace("\r", "\n")
                heads = list(header.finditer(body))
                title = next((h.group(2) for h in heads if len(h.group(1)) == 1), None)
                parts = [(h.group(2), len(h.group(1)), body[h.end() : n.start() if n else len(body)]) for h, n in zip(heads, [*heads[1:], None])] or [(None, 0, body)]
                for i, (heading, level, part) in enumerate(parts):
                    rows += [(doc, title, i, heading, level, j, p.strip()) for j, p in enumerate(q for q in re.split(r"\n\s*\n", part) if q.strip())]
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).filter("body is not null").mapInPandas(cut, schema)


def unit_views(names: list[str], regions: DataFrame, titles: DataFrame, **options) -> DataFrame:
    """(doc, view, ordinal, text, token_count) of the named views, in one table; an unknown view is a ValueError.

    `regions` of `region_table`, `titles` (doc, title[, aliases, description]).
    """
    has = lambda c, kind: F.col(c) if c in titles.columns else F.lit(None).cast(kind)

    def title_units() -> DataFrame:
        v = titles.select("doc", title_view(F.col("title"), has("aliases", "array<string>"), has("description", "string")).alias("text")).filter("text is not null")
        return v.select("doc", F.lit("title").alias("view"), F.lit(0).alias("ordinal"), "text", X.token_count(F.col("text")).cast("long").alias("token_count"))

    builders = {
        "section": lambda: section_units(regions, titles, **options).select("doc", "view", "ordinal", "text", "token_count"),
        "document": lambda: document_view(regions, titles).select("doc", F.lit("document").alias("view"), F.lit(0).alias("ordinal"), "text", F.col("token_count").cast("long").alias("token_count")),
        "title": title_units,
    }
    if unknown := [n for n in names if n not in builders]:
        raise ValueError(f"unknown view {unknown[0]}, not among {', '.join(builders)}")
    out = None
    for name in dict.fromkeys(names):
        part = builders[name]()
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("name at least one view")
    return out


def in_unit_order(units: DataFrame) -> DataFrame:
    """Units by (doc, unit), the order in which vectors are written."""
    return units.orderBy("doc", "unit")
