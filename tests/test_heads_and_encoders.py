import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaveline.functions import vectors as V
from weaveline.operators import anchors, chunking, encoders, graph, heads, inline, knn, simulate, textstats
from weaveline.operators import evaluate as E
from weaveline.sources import scan, sinks


def test_batches_are_halved_and_taken_up_again():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        return np.array([[len(t)] for t in texts], float)

    got, failed = encoders.encode_adaptively(encode, ["a" * i for i in range(8)], 12)
    assert got[:, 0].tolist() == list(range(8)) and failed == [12, 6] and calls == [8, 6, 3, 3, 2]
    with pytest.raises(MemoryError):
        encoders.encode_adaptively(lambda t: (_ for _ in ()).throw(MemoryError()), ["x"], 4)
    assert encoders.encode_adaptively(encode, [], 4)[0].size == 0


def test_devices_batches_and_encoders_by_name():
    def probe(device):
        if device != "cpu":
            raise OSError("absent")

    device, events = encoders.qualified_device(["gpu", "cpu"], probe)
    assert device == "cpu" and [e["ok"] for e in events] == [False, True]
    with pytest.raises(RuntimeError):
        encoders.qualified_device(["gpu"], probe)
    assert (encoders.automatic_batch("cpu"), encoders.automatic_batch("gpu"), encoders.automatic_batch("cpu", 5)) == (16, 32, 5)
    with pytest.raises(ValueError):
        encoders.create_encoder("nothing")
    with pytest.raises(RuntimeError):
        encoders.create_encoder("sentence", path="x")
    sent = []
    hosted = encoders.create_encoder("hosted", send=lambda t: sent.append(len(t)) or [[1.0]] * len(t), batch=32)
    assert hosted.encode(["x"] * 70).shape == (70, 1) and sent == [32, 32, 6]
    assert np.allclose(encoders.HashingEncoder(16).encode(["abc def"])[0], V.hash_vector("abc def", 16))


def test_embedded_rows(spark):
    df = spark.createDataFrame([(1, "some words", 0), (2, "", 0), (3, None, 0)], "id long, t string, v int")
    got = {r["id"]: r["v"] for r in encoders.embedded(df, "id", "t", dims=16).collect()}
    assert set(got) == {1, 2} and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[2])


def test_target_head_learns_which_target_a_span_means(spark):
    rng = np.random.default_rng(0)
    catalog = rng.normal(size=(30, 8))
    chosen = rng.integers(0, 30, 300)
    spans = catalog[chosen] @ rng.normal(size=(8, 8)) + 0.05 * rng.normal(size=(300, 8))
    head = heads.TargetHead.fit(spans[:250], chosen[:250], catalog, rounds=400)
    scores = head.scale * (spans[250:] @ head.span) @ (catalog @ head.target).T
    assert (scores.argmax(1) == chosen[250:]).mean() > 0.8
    assert np.allclose(head.score(spans[:5], catalog[chosen[:5]]), (head.scale * (spans[:5] @ head.span) * (catalog[chosen[:5]] @ head.target)).sum(1))


@pytest.mark.parametrize("n_spans, n_targets", [(4_400, 200), (200, 4_600)])
def test_target_head_is_fitted_on_every_span_and_target(spark, n_spans, n_targets):
    rng = np.random.default_rng(4)
    catalog = rng.normal(size=(n_targets, 4)).astype(np.float32).astype(float)
    catalog[-10:] = catalog[:10]  # targets of one vector
    chosen = rng.integers(0, 100, n_spans)
    spans = (catalog[chosen] @ rng.normal(size=(4, 4)) + 0.3 * rng.normal(size=(n_spans, 4))).astype(np.float32).astype(float)
    spans[-100:], chosen[-100:] = spans[:100], chosen[:100]  # linked twice
    targets = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(catalog)], "target string, v array<double>")
    linked = spark.createDataFrame([(f"t{c}", v.tolist()) for c, v in zip(chosen, spans)] + [("nowhere", [9.0] * 4)], "target string, v array<double>")
    scores = lambda head: head.scale * (spans[:50] @ head.span) @ (catalog[:50] @ head.target).T
    assert np.allclose(scores(heads.fit_target_head(linked, targets)), scores(heads.TargetHead.fit(spans, chosen, catalog)), atol=1e-3)
    held, jobs = (heads.fit_target_head(linked.repartition(3), targets.repartition(2), held_pairs=n, rounds=4) for n in (10**9, 0))
    assert np.allclose(held.span, jobs.span, atol=1e-6) and np.allclose(held.target, jobs.target, atol=1e-6)
    with pytest.raises(ValueError):
        heads.fit_target_head(linked.filter("target = 'nowhere'"), targets)


def test_mean_targets_of_large_and_small_scores():
    rng = np.random.default_rng(5)
    spans, targets, times = rng.normal(size=(700, 3)).astype(np.float32), rng.normal(size=(1_300, 3)).astype(np.float32), rng.integers(1, 4, (1_300, 1))
    held, weights = np.hstack([times * targets, times]).astype(np.float32), rng.random(700)
    for size in (1.0, 30.0):
        a, b = rng.normal(size=(3, 2)) * size, rng.normal(size=(3, 2)) * size
        logit = (spans @ a) @ (targets @ b).T + np.log(times[:, 0])
        prob = np.exp(logit - logit.max(1, keepdims=True))
        want = (spans * weights[:, None]).T @ (prob / prob.sum(1, keepdims=True) @ targets)
        got = heads.expected_products(spans, weights, held, a, b)
        assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()


def test_catalog_interiors_and_drafts(spark):
    docs = spark.createDataFrame([("a", "Queue", "waits in line"), ("b", None, None)], "id string, title string, description string")
    got = {r["target"]: r["v"] for r in heads.target_catalog(docs, "id", "title", "description", 8).collect()}
    want = np.mean([s for _, _, s in V.token_states("Queue waits in line", 8)], axis=0)
    assert np.allclose(got["a"], want) and not any(got["b"])
    body = "one two  three\nfour"
    spans = spark.createDataFrame([("d", 4, 14), ("d", 7, 9), ("e", 0, 3)], "doc string, start long, end long")
    inner = {(r["start"], r["end"]): r["v"] for r in heads.span_interiors(spark.createDataFrame([("d", body), ("x", "y")], "doc string, body string"), spans, 8).collect()}
    whole = V.span_representation(body, 4, 14, 8)
    assert np.allclose(inner[(4, 14)], whole[16:24]) and not any(inner[(7, 9)]) and len(inner) == 2


def test_bundles_are_checked(tmp_path):
    path, weights = str(tmp_path / "b.json"), {"w": np.arange(6.0).reshape(2, 3)}
    version = heads.save_bundle(path, weights, {"name": "x"}, {"scale": 2})
    got, settings, loaded = heads.load_bundle(path, {"name": "x"})
    assert loaded == version and settings == {"scale": 2} and (got["w"] == weights["w"]).all()
    with pytest.raises(ValueError):
        heads.load_bundle(path, {"name": "y"})
    raw = json.loads((tmp_path / "b.json").read_text())
    raw["model_version"] = "sha256:0"
    (tmp_path / "b.json").write_text(json.dumps(raw))
    with pytest.raises(ValueError):
        heads.load_bundle(path, {"name": "x"})


def test_similar_targets_wait(spark):
    rows = [("s", 0, 2, "a", 0.9), ("s", 4, 6, "b", 0.85), ("s", 8, 10, "c", 0.6), ("s", 1, 3, "d", 0.1)]
    found = spark.createDataFrame(rows, "source string, start long, end long, target string, score double")
    budgets = spark.createDataFrame([("s", 2)], "source string, budget int")
    chosen = lambda **o: {r["target"]: r["reason"] for r in inline.selected(found, budgets, **o).collect()}
    assert chosen() == {"a": None, "b": None, "c": "over_budget", "d": "overlaps_selected_span"}
    near = spark.createDataFrame([("b", "a", 0.9)], "target_a string, target_b string, sim double")
    assert chosen(similar=near) == {"a": None, "b": "over_budget", "c": None, "d": "overlaps_selected_span"}


def test_guards(spark):
    found = spark.createDataFrame([("s", 0, 5)], "source string, start long, end long")
    docs, links = spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("s", 5, 9)], "doc string, start long, end long")
    inline.check_drafts(found, docs, links)  # touching is no overlap
    with pytest.raises(ValueError):
        inline.check_drafts(found, docs.filter("id <> 's'"), links)
    with pytest.raises(ValueError):
        inline.check_drafts(found, docs, links.withColumn("start", F.lit(4).cast("long")))


def test_ranks_in_shares_are_the_order_of_all(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", round(float(s), 2)) for i, s in enumerate(rng.random(200))] + [("x", 1.0), ("y", 0.0)]
    got = [r["source"] for r in inline.ranked_in_shares(spark.createDataFrame(rows, "source string, score double"), "score", ["source"], 7).orderBy("rank").collect()]
    assert got == [s for s, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_backends_agree_and_lists_are_whole(spark):
    assert (knn.choose_backend(49_999), knn.choose_backend(50_000)) == ("exact", "approximate")
    rng = np.random.default_rng(2)
    x = rng.normal(size=(330, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "big" if i < 300 else ("mid" if i < 326 else None), x[i].tolist()) for i in range(330)], "id long, view string, v array<double>")
    exact = {(r["part"], r["unit"]): [] for r in []}
    read = lambda d: {(r["unit"], r["neighbor"]) for r in d.collect()}
    exact, mixed = read(knn.exact_top_k(df, "id", "v", 4, "view")), read(knn.top_k(df, "id", "v", 4, "view", exact_rows=100))
    assert len(mixed) == len(exact) == 326 * 4 + 4 * 3
    assert len(exact & mixed) >= 0.8 * len(exact)
    few = knn.approximate_top_k(df, "id", "v", 4, "view", cells=40, probes=1)
    assert few.groupBy("unit").count().filter("count < 3").count() == 0


def test_occurrences_both_ways(spark):
    docs = spark.createDataFrame([("A b c. a B-c a",), (None,), ("",)], "t string")
    mentions = spark.createDataFrame([("a",), ("a b",), ("b-c",), ("zz",), ("c. a",)], "mention string")
    want = {"a": 3, "a b": 2, "b-c": 1, "zz": 0, "c. a": 1}
    for held in (200_000, 0):
        assert {r["mention"]: r["occurrences"] for r in anchors.occurrences(docs, "t", mentions, held).collect()} == want


def test_common_neighbours_of_hubs_and_strangers(spark):
    edges = [("h", f"n{i}") for i in range(9)] + [("g", f"n{i}") for i in range(4, 12)] + [("n0", "n1")]
    adj = graph.undirected(spark.createDataFrame(edges, "source string, target string"))
    pairs = spark.createDataFrame([("g", "h"), ("n0", "n1"), ("n0", "n11"), ("h", "nobody")], "source string, target string")
    assert {(r["source"], r["target"]): r["n"] for r in graph.common_neighbors(adj, pairs).collect()} == {("g", "h"): 5, ("n0", "n1"): 1, ("n0", "n11"): 0, ("h", "nobody"): 0}


def test_temperature_is_the_best_of_a_fine_grid(spark):
    rng = np.random.default_rng(3)
    logit = rng.normal(size=500) * 4
    label = rng.random(500) < 1 / (1 + np.exp(-logit / 2.5))
    t = E.fit_temperature(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(logit, label)], "logit double, label boolean"))
    loss = lambda t: np.mean(np.logaddexp(0, np.where(label, -logit, logit) / t))
    grid = np.linspace(0.5, 6, 20_001)
    assert abs(t - grid[np.argmin([loss(g) for g in grid])]) < 1e-3


def test_metadata_index_and_views(spark):
    pages = spark.createDataFrame([("One", "ML", "A, b", "first words"), ("One", "ml", None, None), (" ", "x", "y", "z"), ("Two", None, "b", "")], "title string, category string, tags string, description string")
    got = {tuple(r) for r in textstats.metadata_index(pages, "title", "category", "tags", "description").collect()}
    assert got == {("title", "One", "One"), ("title", "Two", "Two"), ("category", "ml", "One"), ("tag", "a", "One"), ("tag", "b", "One"), ("tag", "b", "Two"), ("description", "first", "One"), ("description", "words", "One")}
    with pytest.raises(ValueError):
        chunking.unit_views(["section", "page"], pages, pages)


def test_sqlite_reviews_and_json(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE embeddings (id TEXT PRIMARY KEY, start INTEGER, embedding BLOB)")
        db.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(f"k{i}", i, bytes([i])) for i in range(25)])
        db.execute("CREATE TABLE bare (id TEXT)")
    got = sorted((r["id"], r["start"], bytes(r["embedding"])) for r in scan.read_sqlite(spark, path, "embeddings", "id string, start long, embedding binary", 4).collect())
    assert got == sorted((f"k{i}", i, bytes([i])) for i in range(25))
    assert scan.read_sqlite(spark, path, "bare", "id string").count() == 0
    reviews = [{"proposal_id": "p", "decision": "accept"}, {"proposal_id": "p", "decision": "reject", "reason": "too_generic"}]
    sinks.save_reviews(str(tmp_path / "r.json"), reviews)
    assert [(r["seq"], r["decision"]) for r in sinks.load_reviews(spark, str(tmp_path / "r.json")).orderBy("seq").collect()] == [(0, "accept"), (1, "reject")]
    with pytest.raises(ValueError):
        sinks.save_reviews(str(tmp_path / "r.json"), [{"proposal_id": "p", "decision": "maybe"}])
    props = spark.createDataFrame([("b", 2, 0.5), ("a", 1, 0.75)], "id string, rank int, score double")
    assert json.loads(sinks.proposals_json(props)) == {"proposals": [{"id": "a", "rank": 1, "score": 0.75}, {"id": "b", "rank": 2, "score": 0.5}]}
    drafts = spark.createDataFrame([("s", 1, 2, None), ("s", 5, 6, 2), ("t", 0, 1, 1)], "source string, start long, end long, rank int")
    assert [json.loads(r["line"]).get("rank") for r in sinks.inline_json_lines(drafts).collect()] == [1, 2, None]
    paths = spark.createDataFrame([("a/b.md",), ("a/.git/c.md",), ("1/2/3/4/5/6/7/8/9/d.md",), ("e.py",), ("f.txt",)], "p string")
    assert [r["p"] for r in paths.filter(scan.within_depth(F.col("p"))).collect()] == ["a/b.md", "f.txt"]
    assert spark.range(1).select(sinks.excerpt(F.lit("a \n b" * 200)).alias("x")).first()["x"][:7] == "a ba ba"
    sinks.write_embeddings(spark.createDataFrame([("f.md", 0, "some text")], "path string, ordinal int, body string"), str(tmp_path / "out"), "body", dims=8)
    row = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert row["meta"] == {"path": "f.md", "ordinal": 0} and len(row["embedding"]) == 8


def test_simulators_by_hand(spark):
    jobs = spark.createDataFrame([("q", i, a, s) for i, (a, s) in enumerate([(0, 10), (1, 10), (2, 10), (11, 5)])], "queue string, job int, arrival long, size long")
    assert {r["job"]: (r["admitted"], r["completion"]) for r in simulate.admitted(jobs, 2).collect()} == {0: (True, 10), 1: (True, 20), 2: (False, None), 3: (True, 25)}
    r = spark.createDataFrame([("q", i, a) for i, a in enumerate([0, 1, 2, 50, 51])], "queue string, request int, arrival long")
    assert {x["request"]: (x["batch"], x["completion"]) for x in simulate.batched(r, 3, 10, 4, 2).collect()} == {0: (0, 12), 1: (0, 12), 2: (0, 12), 3: (1, 68), 4: (1, 68)}
    calls = spark.createDataFrame([(i, i, 1) for i in range(1, 21)], "call int, first long, second long")
    assert {x["call"]: x["latency"] for x in simulate.hedged(calls, 0.9).collect()}[20] == 19
    flows = spark.createDataFrame([("q", 0, p, 64) for p in range(40)] + [("q", 1, p, 1500) for p in range(10)], "queue string, flow int, packet int, size int")
    assert {x["flow"]: x["sent"] for x in simulate.flows_by_deficit(flows, 500, 3).collect()} == {0: 64 * 23, 1: 1500}
    assert simulate.stealing(10, 1) == (177, 177) and simulate.stealing(10, 4)[1] == 177 and 3 < 177 / simulate.stealing(10, 4)[0] <= 4
    low, high = simulate.mesh_latency(4, 0.02, 2000)[0], simulate.mesh_latency(4, 0.45, 2000)[0]
    assert 2.6 < low < 2.8 and low < high < 6
