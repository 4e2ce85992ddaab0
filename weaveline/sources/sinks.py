"""Sinks and reports: JSON lines, Markdown, artifacts by fingerprint, manifests, upserts, vector tables."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weaveline.operators.chunking import canonical_json, fingerprint


def json_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line): each row as JSON with its columns by name, ordered."""
    return df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines in one file a task; Spark's committer makes the folder appear whole."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_text(path: str, text: str) -> None:
    """A small file written whole: to a temporary name, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def excerpt(text, most: int = 240):
    """A text's first characters with white space collapsed."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, most)


def proposals_markdown(proposals: DataFrame, titles: DataFrame | None = None, limit: int = 500) -> str:
    """A report of the best `limit` proposals, grouped by source in order of their best rank, and how many more there are."""
    rows = proposals.orderBy("rank").limit(limit).collect()  # the report's size
    if not rows:
        return "# Proposed links\n\nThe run was successful and found nothing to propose.\n"
    names = {r["id"]: r["title"] for r in titles.join(proposals.orderBy("rank").limit(limit).select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id").select("id", "title").collect()} if titles is not None else {}
    esc = lambda s: "".join("\\" + c if c in "\\`*_[]#<>{}|" else c for c in str(s))
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    out = ["# Proposed links", ""]
    for source, items in groups.items():
        out += [f"## {esc(names.get(source) or source)}", ""]
        for r in items:
            out.append(f"- [ ] {r['rank']}. {esc(names.get(r['target']) or r['target'])} (score {r['score']:.3f})")
            out += [f"  - {esc(k)}: {v:.4f}" for k, v in sorted(r.asDict().items()) if isinstance(v, float) and not k.endswith("_norm") and k != "score"]
        out.append("")
    if len(rows) == limit and (more := proposals.count() - limit):
        out += [f"{more} more of lower rank are not listed.", ""]
    return "\n".join(out)


def inline_markdown(drafts: DataFrame, limit: int = 500) -> str:
    """The best `limit` accepted drafts by document, how many more there are, and rejected ones counted by reason."""
    rows = drafts.filter("rank is not null").orderBy("rank").limit(limit).collect()
    counts = drafts.filter("rank is null").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()
    out = ["# Inline proposals", ""]
    sources: dict[str, list] = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    for source, items in sorted(sources.items()):
        out += [f"## {source}", "", *[f"- {r['start']}-{r['end']} to {r['target']} ({r['score']:.3f})" for r in items], ""]
    if len(rows) == limit and (more := drafts.filter("rank is not null").count() - limit):
        out += [f"{more} more accepted ones of lower rank are not listed.", ""]
    if not rows:
        out += ["Nothing was accepted.", ""]
    return "\n".join([*out, *[f"- {r['reason']}: {r['n']}" for r in counts], ""])


class ArtifactStore:
    """Tables by content address under a shared folder: group/key/, complete once its marker is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hits, self.misses = spark, root.rstrip("/"), 0, 0

    def path(self, group: str, key: str) -> str:
        for part in (group, key):
            if not part or not all(c.isalnum() or c in "-_.:" for c in part) or part.startswith("."):
                raise ValueError(f"unsafe name {part!r}")
        return f"{self.root}/{group}/{key.replace(':', '-')}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def has(self, group: str, key: str) -> bool:
        return self._exists(self.path(group, key) + "/_SUCCESS")

    def write(self, group: str, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(group, key))

    def read(self, group: str, key: str) -> DataFrame:
        if not self.has(group, key):
            raise FileNotFoundError(f"no complete artifact {group}/{key}")
        return self.spark.read.parquet(self.path(group, key))

    def through(self, group: str, inputs: list, build) -> DataFrame:
        """The table for these inputs, built only if it isn't there."""
        key = fingerprint(inputs)
        if self.has(group, key):
            self.hits += 1
        else:
            self.misses += 1
            self.write(group, key, build())
        return self.read(group, key)


def run_manifest(run_id: str, stages: list[dict], config: dict) -> str:
    """The manifest of a run, to be written last: that it exists shows that the run ended."""
    return canonical_json({"config": config, "config_fingerprint": fingerprint(config), "run_id": run_id, "stages": stages})


def proposals_json(proposals: DataFrame, limit: int | None = None) -> str:
    """A whole set as one canonical JSON document in rank order; the set, or its best `limit`, must fit the driver."""
    rows = proposals.orderBy("rank")
    return canonical_json({"proposals": [r.asDict(True) for r in (rows if limit is None else rows.limit(limit)).collect()]})


def inline_json_lines(drafts: DataFrame) -> DataFrame:
    """(line) of every draft: accepted ones by rank, then rejected ones by place."""
    order = [F.col("rank").isNull(), "rank", "source", "start", "end"]
    return drafts.orderBy(*order).select(F.to_json(F.struct(*sorted(drafts.columns))).alias("line"))


def save_reviews(path: str, reviews: list[dict]) -> None:
    """A review history as canonical JSON in the order given, put in place at once; a row without proposal and decision is an error."""
    for r in reviews:
        if not r.get("proposal_id") or r.get("decision") not in ("accept", "reject", "defer"):
            raise ValueError(f"not a review: {r}")
    write_text(path, canonical_json({"reviews": reviews}))


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(seq, id, decision, reason) of a saved history, `seq` its order."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["reviews"]
    return spark.createDataFrame([(i, r["proposal_id"], r["decision"], r.get("reason")) for i, r in enumerate(rows)], "seq long, id string, decision string, reason string")


def write_embeddings(chunks: DataFrame, path: str, text: str, encoder: str = "hashing", **options) -> None:
    """JSON lines {meta, embedding} of chunks of files (all columns but the text are the meta data), a file a task."""
    from weaveline.operators.encoders import embedded

    keyed = chunks.withColumn("_key", F.to_json(F.struct(*[c for c in sorted(chunks.columns) if c != text])))
    v = embedded(keyed, "_key", text, encoder, **options)
    meta = F.from_json("_key", chunks.drop(text).schema)
    v.select(F.to_json(F.struct(meta.alias("meta"), F.col("v").alias("embedding"))).alias("value")).write.mode("errorifexists").text(path)


def upserted(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows by key, the one of highest `seq` stays, of equal ones the first as JSON; columns missing on a side are null."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq), F.to_json(F.struct(*both.columns))))).filter("_r = 1").drop("_r")


def save_vectors(df: DataFrame, path: str, unit: str = "unit", vector: str = "v") -> None:
    df.select(unit, F.col(vector).cast("array<float>").alias(vector)).write.mode("errorifexists").parquet(path)


def load_vectors(spark: SparkSession, path: str, units: DataFrame, unit: str = "unit") -> DataFrame:
    """A vector table, checked to hold just the given units."""
    v = spark.read.parquet(path)
    if v.join(units.select(unit), unit, "left_anti").limit(1).count() or units.join(v.select(unit), unit, "left_anti").limit(1).count():
        raise ValueError("vectors and units disagree")
    return v


def vector_reference(ref):
    """(key, row) of `key#row`; null unless the row is digits."""
    return F.when(ref.rlike(r"^.+#[0-9]+$"), F.struct(F.regexp_extract(ref, r"^(.+)#([0-9]+)$", 1).alias("key"), F.regexp_extract(ref, r"^(.+)#([0-9]+)$", 2).cast("long").alias("row")))


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2)
