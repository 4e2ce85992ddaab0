"""Scans: Markdown trees, JSON lines, delimited files, content indexes, configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.operators import markdown as M


@dataclass(frozen=True)
class MarkdownOptions:
    """What a Markdown scan takes and how it flags; unknown names are errors."""

    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ("category", "tags", "aliases", "description", "date")
    excluded_if: tuple[tuple[str, object], ...] = (("draft", True), ("private", True))
    archived_if: tuple[tuple[str, object], ...] = (("archived", True), ("status", "archived"))
    generated_marker: str = "<!-- generated -->"

    @staticmethod
    def of(**options) -> "MarkdownOptions":
        unknown = set(options) - {f.name for f in fields(MarkdownOptions)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return MarkdownOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob: `**/` is any folders or none, `**` anything, `*` and `?` stay in a segment."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`, from a file's full path."""
    return F.regexp_replace(path, "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")


def matches(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    hit = lambda globs: path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)
    return hit(include) & ~hit(exclude)


def within_depth(path: Column, most: int = 8, extensions: tuple[str, ...] = (".md", ".txt"), ignored: tuple[str, ...] = (".git", "node_modules")) -> Column:
    """Files at most `most` folders deep, with one of the extensions, in no ignored folder."""
    parts = F.split(path, "/")
    ok = F.lit(False)
    for e in extensions:
        ok = ok | path.endswith(e)
    return (F.size(parts) - 1 <= most) & ok & ~F.arrays_overlap(parts, F.array(*[F.lit(i) for i in ignored]))


DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("revision", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("source_ref", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("is_excluded", T.BooleanType()), T.StructField("is_generated", T.BooleanType()), T.StructField("is_archived", T.BooleanType()),
])


def _strings(value) -> list[str]:
    if value is None:
        return []
    return [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]


def read_markdown(spark: SparkSession, root: str, options: MarkdownOptions | None = None) -> DataFrame:
    """The documents of a folder tree: id (path without .md), revision (digest of the bytes), content, title, metadata and flags.

    The path filter runs before any file is parsed.  Bytes that aren't UTF-8
    are an error.  The title is the front matter's, else the first level-1
    heading outside code, else the file's name.
    """
    o = options or MarkdownOptions()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select(relative_path(F.col("path"), root).alias("source_ref"), "content").filter(matches(F.col("source_ref"), o.include, o.exclude)).select("source_ref", "content", F.sha2("content", 256).alias("revision"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ref, raw, revision in b.itertuples(index=False):
                text = bytes(raw).decode("utf-8")
                meta, _, _ = M.front_matter(text)
                name = ref.rpartition("/")[2].removesuffix(".md")
                title = str(meta.get("title") or "").strip() or M.first_heading(text) or name
                flag = lambda rules: any(meta.get(k) == v and k in meta for k, v in rules)
                generated = o.generated_marker.lower().encode() in bytes(raw)[:500].lower() or meta.get("generated") is True
                kept = {k: "\n".join(_strings(meta[k])) for k in o.metadata if meta.get(k) is not None}
                out.append((ref.removesuffix(".md"), revision, "text/markdown", text, title, ref, kept, _strings(meta.get("aliases")), _strings(meta.get("tags")), flag(o.excluded_if), generated, flag(o.archived_if)))
            yield pd.DataFrame(out, columns=DOCUMENTS.names)

    return rows.mapInPandas(parse, DOCUMENTS)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a malformed one is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | T.StructType, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can read, columns by the names of `schema`.

    The file is opened read-only by `parts` tasks, each taking a range of row
    numbers; nothing passes the driver but their bounds.  A missing column or
    table is an error.
    """
    import sqlite3

    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
    if low is None:
        return spark.createDataFrame([], wanted)
    step = -(-(high - low + 1) // parts)
    bounds = spark.createDataFrame([(a, min(a + step, high + 1)) for a in range(low, high + 1, step)], "a long, b long").repartition(parts, "a")
    ask = f"SELECT {', '.join(map(quoted, wanted.names))} FROM {quoted(table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for a, b in batch.itertuples(index=False):
                    rows = db.execute(ask, (int(a), int(b)))
                    while part := rows.fetchmany(10_000):
                        yield pd.DataFrame(part, columns=wanted.names)

    return bounds.mapInPandas(read, wanted)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False, encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited rows with a given schema, without inference."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding)


def read_citations(spark: SparkSession, content: str, cites: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of white-space rows `id words... label` and `cited citing`; edges keep known ends only."""
    parts = F.split(F.trim("value"), r"\s+")
    nodes = spark.read.text(content).filter(F.trim("value") != "").select(parts.alias("p")).select(F.col("p")[0].alias("id"), F.transform(F.slice("p", 2, F.size("p") - 2), lambda x: x.cast("double")).alias("words"), F.element_at("p", -1).alias("label"))
    edges = spark.read.text(cites).filter(F.trim("value") != "").select(parts[1].alias("source"), parts[0].alias("target"))
    return nodes, known_edges(edges, nodes)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    for side in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(side)).distinct(), side, "left_semi")
    return edges


def read_content_index(spark: SparkSession, path: str) -> DataFrame:
    """(slug, title, links, tags, content) of a JSON object keyed by slug."""
    entry = "struct<title:string,links:array<string>,tags:array<string>,content:string>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("slug", "e"))
    return raw.select("slug", "e.*")


def changed(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose (id, revision) isn't among the seen ones."""
    return current.join(seen.select("id", "revision"), ["id", "revision"], "left_anti")


def read_config(text: str, known: dict[str, dict[str, object]]) -> dict[str, dict[str, object]]:
    """Settings from YAML over defaults, section by section; unknown sections, keys and types are errors, and so are targets over the maximum."""
    import yaml

    given = yaml.safe_load(text) or {}
    out = {s: dict(v) for s, v in known.items()}
    for section, values in given.items():
        if section not in known:
            raise ValueError(f"unknown section {section}")
        for key, value in (values or {}).items():
            if key not in known[section]:
                raise ValueError(f"unknown key {section}.{key}")
            if type(value) is not type(known[section][key]) and not (isinstance(value, int) and isinstance(known[section][key], float)):
                raise ValueError(f"{section}.{key} should be {type(known[section][key]).__name__}")
            out[section][key] = value
    p = out.get("preprocess", {})
    if p.get("target_tokens", 0) > p.get("max_tokens", p.get("target_tokens", 0)) or p.get("overlap_tokens", 0) >= p.get("target_tokens", 1) > 0:
        raise ValueError("need overlap < target <= max tokens")
    return out


def load_plugin(spec: str, *methods: str) -> object:
    """An instance of `package.module:Class`, built without arguments, which must have the methods named."""
    import importlib

    module, _, name = spec.partition(":")
    if not module or not name:
        raise ValueError(f"not of the form module:name: {spec}")
    instance = getattr(importlib.import_module(module), name)()
    missing = [m for m in methods if not callable(getattr(instance, m, None))]
    if missing:
        raise TypeError(f"{spec} lacks {', '.join(missing)}")
    return instance
