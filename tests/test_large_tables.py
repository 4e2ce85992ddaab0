"""What keeps queries within their limits on large tables."""

import numpy as np
from pyspark.sql import functions as F

from weaveline.functions import vectors as V
from weaveline.operators import heads, knn, spans
from weaveline.plans import evaluation, inline, learned

SF = "/root/testdata/sf0.001"


def test_the_bundle_needs_no_drafts(spark, monkeypatch):
    monkeypatch.setattr(inline, "_drafts", None)
    monkeypatch.setattr(inline, "_counts", None)
    assert learned.y15_bundle(spark, SF).first().asDict() == {"same_version": True, "same_weights": True}


def test_states_of_many_texts_are_those_of_each():
    texts = ["one two  three\nfour", "", " \t", "two", "ein Wort \U0001d54f und two two " * 40]
    for text, (begins, ends, states) in zip(texts, V.token_states_of(texts, 40), strict=True):
        want = V.token_states(text, 40)
        assert list(zip(begins, ends)) == [w[:2] for w in want] and all((s == w[2]).all() for s, w in zip(states, want))
    assert V.token_states_of([]) == []


def test_the_head_is_fitted_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    spans, catalog, chosen = rng.normal(size=(70, 6)), rng.normal(size=(20, 6)), rng.integers(0, 20, 70)
    whole = heads.TargetHead.fit(spans, chosen, catalog, rounds=20)
    monkeypatch.setattr(heads, "BLOCK", 16)
    parts = heads.TargetHead.fit(spans, chosen, catalog, rounds=20)
    assert np.allclose(whole.span, parts.span) and np.allclose(whole.target, parts.target)


def test_targets_count_anchors_once(spark, monkeypatch):
    calls, counts = [], inline._counts
    monkeypatch.setattr(inline, "_counts", lambda *a: calls.append(a) or counts(*a))
    assert learned._Targets(spark, SF).short.count() and len(calls) == 1


def test_only_runs_that_are_mentions_leave_the_worker(spark):
    docs = spark.createDataFrame([("d", "the  red _cache_ and the red fox, the réd cache `the red` the red\ncache")], "id string, body string")
    got = lambda **o: {r["text"] for r in spans.word_grams(docs, "id", "body", heads=frozenset({"the"}), **o).collect()}
    runs = got()
    kept = got(mentions=frozenset({"the red cache", "the", "the red _cache"}))
    assert kept == {t for t in runs if not t.isascii() or t in ("the", "the  red _cache_", "the red\ncache")} and len(kept) < len(runs)


def test_ranks_of_pairs_are_those_of_whole_lists(spark):
    rng = np.random.default_rng(4)
    own = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in own[i % 60] * (1 + i % 3) + (0.4 * rng.normal(size=8) if i % 2 else 0)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    pairs = spark.createDataFrame([(i, (i * 7 + 60) % 300 if i % 5 else i + 60) for i in range(0, 240)], "query long, item long").filter("query <> item")
    lists = knn.exact_top_k(df.select("id", V.normalize(F.col("v")).alias("v")), "id", "v", 10).select(F.col("unit").alias("query"), F.col("neighbor").alias("item"), "rank")
    want = {tuple(r) for r in lists.join(pairs, ["query", "item"]).select("query", "item", "rank").collect()}
    got = knn.pair_ranks(df, "id", "v", pairs, 10, block=50, share=4)
    assert {tuple(r) for r in got.select("query", "item", "rank").collect()} == want and len(want) > 40


def test_retrieval_makes_no_lists(spark, monkeypatch):
    monkeypatch.setattr(knn, "exact_top_k", None)
    assert evaluation.v8_retrieval_metrics(spark, SF).first()["queries"] > 0


def test_recommendations_by_scan_are_those_by_lists(spark):
    rng = np.random.default_rng(5)
    ratings = spark.createDataFrame([(u, int(i), float(rng.integers(1, 9))) for u in range(60) for i in rng.choice(400, 5 + u, replace=False)], "user int, item int, n float")
    got, want = ({tuple(r) for r in learned.L.recommend(ratings, "user", "item", "n", 5, most_held=n).select("user", "item", "rank").collect()} for n in (10**6, 0))
    assert got == want and len(got) == 300
