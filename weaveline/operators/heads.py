"""Learned target choice: catalogue and span vectors, a projected softmax head, reranking, calibrated drafts, saved bundles."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions import text as X
from weaveline.functions import vectors as V
from weaveline.operators import learned
from weaveline.scratch import materialize, spread

#: Linked spans in a block of the fit at least, and blocks at most; a round sends one d x d sum of each block.
BLOCK, BLOCKS = 2_048, 1_024
#: Linked spans, and pairs of a span and a different target, of which one task does all rounds; with more, every round is a job.
HELD_SPANS, HELD_PAIRS = 200_000, 100_000_000
#: Linked spans and targets whose scores are held at once.
ROWS, COLUMNS = 512, 512
#: Characters of text whose states are held at once.
TOGETHER = 1_000_000
RERANK_FEATURES = ["share", "interaction", "commonness", "edit", "is_title_target"]


def target_catalog(docs: DataFrame, key: str, title: str, description: str, dims: int = 32) -> DataFrame:
    """(target, v): mean token state of each document's title and description; zeros where both are empty."""

    @F.pandas_udf("array<double>")
    def mean(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, np.mean(s, axis=0))) if len(s) else [0.0] * dims for _, _, s in V.token_states_of(list(texts), dims)])

    return docs.select(F.col(key).alias("target"), mean(F.concat_ws(" ", title, description)).alias("v"))


def span_interiors(docs: DataFrame, spans: DataFrame, dims: int = 32) -> DataFrame:
    """(doc, start, end, v): mean state of the tokens that meet each span, zeros where none does; `docs` is (doc, body).

    States depend on the text before them, so a document's states are computed
    once, for all its spans, which its text bounds.
    """
    asked = spans.select("doc", "start", "end").distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    source = spread(docs.select("doc", "body").filter("body is not null").join(asked, "doc").select("doc", "body", F.col("spans.start").alias("start"), F.col("spans.end").alias("end")), "doc")
    schema = T.StructType([spans.schema["doc"], spans.schema["start"], spans.schema["end"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def of(b: pd.DataFrame) -> pd.DataFrame:
        held = []
        for (begins, ends, states), start, end in zip(V.token_states_of(list(b["body"]), dims), b["start"], b["end"]):
            upto = np.concatenate([np.zeros((1, dims)), np.cumsum(states, axis=0)])
            i, j = np.searchsorted(ends, start, "right"), np.searchsorted(begins, end)
            held.append(np.where((j > i)[:, None], (upto[j] - upto[i]) / np.maximum(j - i, 1)[:, None], 0.0))
        n = [len(x) for x in held]
        return pd.DataFrame({"doc": b["doc"].repeat(n).to_numpy(), "start": np.concatenate(list(b["start"])), "end": np.concatenate(list(b["end"])), "v": list(np.concatenate(held))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = (b["body"].str.len().cumsum() // TOGETHER).to_numpy()
            for _, some in b.groupby(part):
                yield of(some)

    return source.mapInPandas(run, schema)


def expected_products(spans: np.ndarray, weights: np.ndarray, held: np.ndarray, span: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Sum of weight x span x (mean of the target vectors by the span's softmax over all of them).

    `held` is [times x target vector, times] of different targets; `span` and
    `target` project both, with the scale in `span`.  Scores are in single
    precision and held by tiles; sums are in double precision.
    """
    targets = held[:, :-1] / held[:, -1:]
    a, b = (spans @ span).astype(np.float32), np.ascontiguousarray((targets @ target).astype(np.float32).T)
    longest = float(np.sqrt((b * b).sum(0).max()))
    out = np.zeros((spans.shape[1], targets.shape[1]))
    for i in range(0, len(a), ROWS):
        some = a[i : i + ROWS]
        small = float(np.sqrt((some * some).sum(1).max())) * longest <= 40  # so no score has to be shifted for its exponential
        top, mass = np.full((len(some), 1), -np.inf, np.float32), np.zeros((len(some), held.shape[1]))
        for j in range(0, b.shape[1], COLUMNS):
            prob = some @ b[:, j : j + COLUMNS]
            if not small:
                above = np.maximum(top, prob.max(1, keepdims=True))
                mass *= np.exp(top - above)
                prob, top = prob - above, above
            np.exp(prob, out=prob)
            mass += prob @ held[j : j + COLUMNS]
        out += (spans[i : i + ROWS].astype(np.float64) * weights[i : i + ROWS, None]).T @ (mass[:, :-1] / mass[:, -1:])
    return out


class TargetHead:
    """Two projections to a common space; a target's score for a span is their scaled product."""

    def __init__(self, span: np.ndarray, target: np.ndarray, scale: float):
        self.span, self.target, self.scale = span, target, scale

    @staticmethod
    def fit(spans: np.ndarray, chosen: np.ndarray, catalog: np.ndarray, **options) -> "TargetHead":
        """The head of arrays; `chosen` numbers rows of the catalogue."""
        held = np.hstack([catalog, np.ones((len(catalog), 1))]).astype(np.float32)
        blocks = [(np.asarray(spans[i : i + BLOCK], np.float32), np.ones(len(spans[i : i + BLOCK]))) for i in range(0, len(spans), BLOCK)]
        sizes = (float(np.sqrt((x * x).mean())) for x in (spans, catalog))
        return TargetHead.descend(lambda a, b: sum(expected_products(*block, held, a, b) for block in blocks), len(spans), spans.T @ catalog[chosen], *sizes, **options)

    @staticmethod
    def descend(expected: Callable[[np.ndarray, np.ndarray], np.ndarray], n: float, linked: np.ndarray, span_size: float, target_size: float, width: int = 16, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-4, seed: int = 13) -> "TargetHead":
        """Adaptive gradient steps on the softmax of each of n spans' target over the whole catalogue.

        The slopes need only two sums over the spans of d x d products: `linked`,
        of each span and its target, and what `expected` gives for two
        projections, of each span and its mean target.  The sizes are root mean
        squares.
        """
        rng = np.random.default_rng(seed)
        own = [rng.normal(size=(d, width)) / (d**0.5 * max(size, 1e-9)) for d, size in zip(linked.shape, (span_size, target_size))]
        first, second = [np.zeros_like(w) for w in own], [np.zeros_like(w) for w in own]
        scale = width**-0.5
        for t in range(1, rounds + 1):
            off = scale / n * (expected(scale * own[0], own[1]) - linked)
            for i, step in enumerate((off @ own[1], off.T @ own[0])):
                step = step + ridge * own[i]
                first[i], second[i] = 0.9 * first[i] + 0.1 * step, 0.999 * second[i] + 0.001 * step * step
                own[i] = own[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-9)
        return TargetHead(own[0], own[1], scale)

    def score(self, spans: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Scores of spans and targets row by row."""
        return self.scale * np.einsum("nk,nk->n", spans @ self.span, targets @ self.target)


def _sums(rows: Iterable, held: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """`expected_products` of each block (block, spans, weights)."""
    return [(n, expected_products(np.frombuffer(x, np.float32).reshape(-1, len(a)), np.frombuffer(w), held, a, b)) for n, x, w in rows]


def _fit_in_one_task(packed: DataFrame, held, args: tuple, options: dict) -> TargetHead:
    """All rounds in one task: workers have one thread for matrix products, which are too small for more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = pd.concat(list(batches)).sort_values("block").to_numpy()
        head = TargetHead.descend(lambda a, b: sum(x for _, x in _sums(blocks, held.value, a, b)), *args, **options)
        yield pd.DataFrame({"span": [head.span.tobytes()], "target": [head.target.tobytes()], "scale": [head.scale]})

    got = packed.select("block", "spans", "weights").coalesce(1).mapInPandas(run, "span binary, target binary, scale double").first()
    return TargetHead(*(np.frombuffer(got[w]).reshape(d, -1) for w, d in zip(("span", "target"), args[1].shape)), got["scale"])


def _fit_by_jobs(packed: DataFrame, held, args: tuple, options: dict) -> TargetHead:
    """The same with a job a round, planned once; blocks' sums are added in order."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    blocks = materialize(packed.select("block", "spans", "weights").repartitionByRange(4 * cores, "block"), "span-blocks").rdd

    def expected(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = blocks.mapPartitions(lambda rows: _sums(rows, held.value, a, b)).collect()
        return sum(x for _, x in sorted(got, key=lambda r: r[0]))

    return TargetHead.descend(expected, *args, **options)


def fit_target_head(linked: DataFrame, catalog: DataFrame, held_spans: int = HELD_SPANS, held_pairs: int = HELD_PAIRS, **options) -> TargetHead:
    """The head fitted on all linked spans (v, target) whose target the catalogue (target, v) has, each against the whole catalogue.

    Equal targets' vectors are scored once, with their number; spans are laid
    out once in blocks by hash, in order, so no sum depends on partitioning.  One
    task does the rounds of up to `held_spans` spans and `held_pairs` pairs of a
    span and a different target; with more every round is a job over the blocks.
    """
    narrow = F.col("v").cast("array<float>")
    usable = linked.select("target", narrow.alias("v")).join(catalog.select("target", narrow.alias("named")), "target")
    n = usable.count()
    if not n:
        raise ValueError("linked spans with a known target are needed")
    kinds = catalog.select(narrow.alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("times")).toArrow()
    times = kinds["times"].to_numpy()
    targets = kinds["v"].combine_chunks().flatten().to_numpy().reshape(len(times), -1)
    order = np.lexsort(targets.T[::-1])
    times, targets = times[order, None], targets[order]
    held = np.hstack([times * targets, times]).astype(np.float32)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        x, y, w = np.stack(g["v"]), np.stack(g["named"]), g["n"].to_numpy(np.float64)
        o = np.lexsort(np.hstack([x, y]).T[::-1])
        x, y, w = x[o], y[o].astype(np.float64), w[o]
        weighted = x.astype(np.float64) * w[:, None]
        return pd.DataFrame({"block": [g["block"].iat[0]], "spans": [x.tobytes()], "weights": [w.tobytes()], "linked": [(weighted.T @ y).tobytes()], "squares": [float((weighted * x).sum())]})

    block = F.pmod(F.xxhash64("v", "named"), F.lit(min(BLOCKS, -(-n // BLOCK)))).cast("int")
    different = usable.groupBy("v", "named").agg(F.count("*").alias("n")).withColumn("block", block)
    packed = materialize(different.groupBy("block").applyInPandas(pack, "block int, spans binary, weights binary, linked binary, squares double"), "spans-and-targets")
    rows = packed.select("block", "linked", "squares").orderBy("block").collect()
    products = sum(np.frombuffer(r["linked"]) for r in rows).reshape(-1, targets.shape[1])
    sizes = (sum(r["squares"] for r in rows) / (n * len(products))) ** 0.5, float(np.sqrt((times * targets.astype(np.float64) ** 2).sum() / (times.sum() * targets.shape[1])))
    sent = linked.sparkSession.sparkContext.broadcast(held)
    fit = _fit_in_one_task if n <= held_spans and n * len(held) <= held_pairs else _fit_by_jobs
    head = fit(packed, sent, (n, products, *sizes), options)
    sent.unpersist()
    return head


def interaction(interior, target):
    """Cosine of a span's interior and a target's vector, 0 where one is missing or zero."""
    return V.cosine(interior, target)


def scored_shortlist(shortlist: DataFrame, interiors: DataFrame, catalog: DataFrame, titles: DataFrame, head: TargetHead) -> DataFrame:
    """Shortlisted targets (source, start, end, text, target, commonness, is_title) with `target_score`, `share` (its softmax within the span's shortlist) and the reranking features.

    `titles` is (id, title).  A span or target without a vector scores 0.
    """
    own = interiors.select(F.col("doc").alias("source"), "start", "end", F.col("v").alias("interior"))
    c = shortlist.filter("source <> target").join(own, ["source", "start", "end"], "left").join(catalog.withColumnRenamed("v", "catalogued"), "target", "left")
    c = c.join(titles.select(F.col("id").alias("target"), F.col("title").alias("target_title")), "target", "left")

    @F.pandas_udf("double")
    def score(interior: pd.Series, catalogued: pd.Series) -> pd.Series:
        ok = [a is not None and b is not None for a, b in zip(interior, catalogued)]
        out = np.zeros(len(interior))
        if any(ok):
            out[ok] = head.score(np.stack(interior[ok]), np.stack(catalogued[ok]))
        return pd.Series(out)

    c = c.withColumns({
        "target_score": score("interior", "catalogued"),
        "interaction": interaction(F.col("interior"), F.col("catalogued")),
        "edit": X.edit_similarity(F.lower("text"), F.lower(F.coalesce("target_title", F.lit("")))),
        "is_title_target": F.col("is_title").cast("double"),
        "query": F.concat_ws("|", "source", F.col("start").cast("string"), F.col("end").cast("string")),
    })
    return learned.catalog_softmax(c, "query", "target_score").drop("interior", "catalogued", "target_title")


def fit_reranker(scored: DataFrame, positives: DataFrame):
    """A logistic reranker of shortlisted targets; `positives` is (source, start, end, target), other targets of these spans are negatives."""
    keys = ["source", "start", "end"]
    judged = scored.join(positives.select(*keys).distinct(), keys, "left_semi").join(positives.select(*keys, "target", F.lit(1.0).alias("label")).distinct(), [*keys, "target"], "left")
    return learned.fit_head(judged.na.fill({"label": 0.0}).withColumn("weight", F.lit(1.0)), RERANK_FEATURES)


def learned_drafts(scored: DataFrame, reranker, temperature: float = 1.0, least: float = 0.5) -> DataFrame:
    """(source, start, end, target, share, confidence, abstained): each span's best target by the reranker, ties to the smaller id.

    `confidence` is the logistic of its logit over `temperature`; drafts under
    `least` abstain but stay.
    """
    ranked = learned.head_scores(reranker, scored, RERANK_FEATURES, "rerank")
    by = Window.partitionBy("source", "start", "end").orderBy(F.desc(F.round("rerank_logit", 9)), "target")
    best = ranked.withColumn("r", F.row_number().over(by)).filter("r = 1")
    sure = 1 / (1 + F.exp(-F.col("rerank_logit") / temperature))
    return best.select("source", "start", "end", "target", "share", sure.alias("confidence"), (sure < least).alias("abstained"))


def model_version(weights: dict[str, np.ndarray]) -> str:
    """`sha256:` and the digest of all weights by name, shape and bytes."""
    digest = hashlib.sha256()
    for name in sorted(weights):
        w = np.ascontiguousarray(weights[name], np.float64)
        digest.update(json.dumps([name, list(w.shape)]).encode() + w.tobytes())
    return "sha256:" + digest.hexdigest()


def save_bundle(path: str, weights: dict[str, np.ndarray], encoder: dict, settings: dict) -> str:
    """Write weights, encoder and settings as one JSON file, put in place at once; returns the model version."""
    from weaveline.sources.sinks import write_text

    version = model_version(weights)
    packed = {k: {"shape": list(np.shape(w)), "data": base64.b64encode(np.ascontiguousarray(w, np.float64).tobytes()).decode()} for k, w in weights.items()}
    write_text(path, json.dumps({"encoder": encoder, "model_version": version, "settings": settings, "weights": packed}, sort_keys=True))
    return version


def load_bundle(path: str, encoder: dict) -> tuple[dict[str, np.ndarray], dict, str]:
    """(weights, settings, model version); weights that don't give the recorded version, or another encoder, are errors."""
    with open(path) as f:
        raw = json.load(f)
    if raw["encoder"] != encoder:
        raise ValueError(f"bundle was trained with the encoder {raw['encoder']}")
    weights = {k: np.frombuffer(base64.b64decode(w["data"]), np.float64).reshape(w["shape"]) for k, w in raw["weights"].items()}
    if model_version(weights) != raw["model_version"]:
        raise ValueError("the weights don't give the recorded model version")
    return weights, raw["settings"], raw["model_version"]
