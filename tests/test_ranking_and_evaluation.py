import math

import pytest
from pyspark.sql import functions as F

from weaveline.operators import audit as A
from weaveline.operators import evaluate as E
from weaveline.operators import inline as I
from weaveline.operators import knn as K
from weaveline.operators import ranking as R
from weaveline.operators import spans as S
from weaveline.plans import evaluation as EV


def test_recovery_by_hand(spark):
    p = spark.createDataFrame([("1", "a", "b", 1), ("2", "a", "c", 2), ("3", "b", "d", 3)], "id string, source string, target string, rank int")
    h = spark.createDataFrame([("a", "c"), ("b", "e")], "source string, target string")
    r = E.recovery(p, h, (1, 2, 5)).first()
    assert (r["recall_at_1"], r["recall_at_2"], r["recall_at_5"]) == (0.5, 0.5, 0.5) or (r["recall_at_2"], r["recall_at_5"]) == (0.5, 0.5)
    assert (r["recovered"], r["held_out"]) == (1, 2)
    empty = E.recovery(p.limit(0), h.limit(0), (1,)).first()
    assert (empty["recall_at_1"], empty["mrr"], empty["held_out"]) == (0.0, 0.0, 0)


def test_bpref_by_hand(spark):
    rows = [("q", i, rel) for i, rel in enumerate([True, False, True, False, True])]
    assert E.bpref(spark.createDataFrame(rows, "query string, rank int, relevant boolean")).first()["bpref"] == pytest.approx((1 + 0.5 + 0) / 3)


def test_gini_slices_and_sweep(spark):
    assert E.gini(spark.createDataFrame([(1,), (1,), (1,)], "x int")).first()[0] == pytest.approx(0)
    assert E.gini(spark.createDataFrame([(0,), (0,), (3,)], "x int")).first()[0] == pytest.approx(2 / 3)
    assert E.gini(spark.createDataFrame([], "x int")).first()[0] == 0
    s = {r["slice"]: (r["n"], r["accuracy"]) for r in E.slices(spark.createDataFrame([("a", True, True), ("a", False, False)], "kind string, hard boolean, correct boolean"), ["a", "b"]).collect()}
    assert s == {"a": (2, 0.5), "b": (0, 0.0), "hard_case": (1, 1.0), "overall": (2, 0.5)}
    scored = spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True), (0.1, False)], "prob double, label boolean")
    rows = {r["threshold"]: (r["precision"], r["recall"], r["accepted"]) for r in E.pr_sweep(scored, [0.5, 0.95]).collect()}
    assert rows == {0.5: (pytest.approx(2 / 3), 1.0, 3), 0.95: (0.0, 0.0, 0)}
    with pytest.raises(ValueError):
        E.pr_sweep(scored, [])


def test_temperature_and_conformal(spark):
    rows = [(2.0, True)] * 80 + [(2.0, False)] * 20 + [(-2.0, False)] * 80 + [(-2.0, True)] * 20
    t = E.fit_temperature(spark.createDataFrame(rows, "logit double, label boolean"))
    assert t == pytest.approx(2 / math.log(4), rel=1e-3)
    with pytest.raises(ValueError):
        E.fit_temperature(spark.createDataFrame([(1.0, True)], "logit double, label boolean"))
    c = spark.createDataFrame([(i / 20, i >= 10) for i in range(20)], "prob double, correct boolean")
    assert E.conformal_threshold(c, 0.1) == sorted([i / 20 if i < 10 else -math.inf for i in range(20)])[math.ceil(21 * 0.9) - 1]
    with pytest.raises(ValueError):
        E.conformal_threshold(c, 0.01)


def test_holdout_sizes(spark):
    rows = [(i, f"s{i % 7}" if i < 100 else f"t{i}", "explicit-link" if i % 5 else "related") for i in range(200)]
    r = E.holdout(spark.createDataFrame(rows, "id long, source string, kind string"), "id", 0.25).collect()
    assert len(r) == 200 and not any(x["held"] for x in r if x["kind"] == "related")
    for b in ("1", "5+"):
        n = [x["held"] for x in r if x["bucket"] == b]
        assert sum(n) == round(0.25 * len(n))


def test_overlap_f1(spark):
    p = spark.createDataFrame([("d", 0, 10), ("d", 20, 30), ("e", 0, 5)], "doc string, start int, end int")
    g = spark.createDataFrame([("d", 1, 10), ("d", 50, 60)], "doc string, start int, end int")
    r = E.overlap_span_f1(p, g, "doc").first()
    assert (r["matched"], r["precision"], r["recall"]) == (1, pytest.approx(1 / 3), 0.5)


def test_kappa_and_tiers(spark):
    v = spark.createDataFrame([(i, "f", a, "x") for i in range(3) for a in "pq"], "item int, field string, annotator string, answer string")
    assert A.pairwise_kappa(v).first()["kappa"] == 1.0
    assert A.agreement_report(v.filter("annotator = 'p'")).count() == 0
    t = spark.createDataFrame([(True, True, True, "prose"), (True, True, True, "code"), (True, False, True, "prose"), (False, True, True, "prose"), (None, True, True, "prose"), (True, None, True, "list")], "a boolean, b boolean, c boolean, k string")
    assert [r[0] for r in t.select(A.derived_tier(F.col("a"), F.col("b"), F.col("c"), F.col("k"))).collect()] == ["a", "c", "b", "d", None, "b"]
    assert A.consensus_tier(spark.createDataFrame([(1, "a"), (1, "c")], "item int, answer string")).first()["tier"] == "c"


def test_allocation_sums_up():
    counts = {"a": 50, "b": 3, "c": 1, "d": 20}
    q = A.allocate(counts, 20)
    assert sum(q.values()) == 20 and min(q.values()) >= 1 and all(q[k] <= counts[k] for k in q)
    assert A.allocate(counts, 2) == {"a": 1, "d": 1} and A.allocate(counts, 100) == counts


def test_steps_and_score_terms(spark):
    d = spark.createDataFrame([(float(i),) for i in range(7)], "d double")
    assert [r[0] for r in d.select(R.graph_redundancy(F.col("d"))).collect()] == [1.0, 1.0, 0.7, 0.3, 0.1, 0.0, 0.0]
    assert [r[0] for r in d.select(R.bridge_value(F.lit(1.0), F.col("d"))).collect()] == [0, 0, 0, 0.5, 0.8, 1, 1]


def test_mmr_prefers_unlike_targets(spark):
    pairs = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.89), ("s", "c", 0.7)], "source string, target string, score double")
    tokens = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["z"])], "doc string, tokens array<string>")
    order = lambda d: [r["target"] for r in R.diverse_order(pairs, tokens, d).orderBy("position").collect()]
    assert order(0.5) == ["a", "c", "b"] and order(0.0) == ["a", "b", "c"]


def test_bands(spark):
    d = spark.createDataFrame([(f"{i:02}", 1 - i / 100, i < 30) for i in range(60)], "id string, quality double, accepted boolean")
    r = R.band_thresholds(d).first()
    assert (r["high"], r["medium"]) == (pytest.approx(0.71), pytest.approx(0.71))
    few = R.band_thresholds(d.limit(5)).first()
    assert (few["high"], few["medium"]) == (0.45, 0.25)
    none = R.band_thresholds(d.withColumn("accepted", F.lit(False))).first()
    assert (none["high"], none["medium"]) == (None, None)


def test_review_queue_strata(spark):
    rows = [(f"p{i:03}", f"s{i % 9 if i < 90 else i}", i + 1, 1 - i / 100) for i in range(100)]
    q = R.review_queue(spark.createDataFrame(rows, "id string, source string, rank int, score double"), 20).collect()
    assert len(q) == len({r["id"] for r in q}) == 20 and [r["rank"] for r in q] == sorted(r["rank"] for r in q)
    assert sum(r["stratum"] == "top" for r in q) == 8 and sum(r["stratum"] == "rare" for r in q) == 4


def test_exact_knn_blocks_ties_and_errors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(150, 8)), 1)
    x[100:] = x[:50]
    df = spark.createDataFrame([(i, [float(v) for v in row], "v" if i % 4 else None) for i, row in enumerate(x)] + [(999, None, "v")], "id long, e array<double>, g string")
    whole = {tuple(r) for r in K.exact_top_k(df, "id", "e", 5).select("unit", "neighbor", "rank").collect()}
    assert whole == {tuple(r) for r in K.exact_top_k(df, "id", "e", 5, block=17).select("unit", "neighbor", "rank").collect()}
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert whole == {(i, int(j), r + 1) for i in range(150) for r, j in enumerate(np.lexsort((np.arange(150), -s[i]))[:5])}
    assert K.exact_top_k(df, "id", "e", 500, "g").count() == 38 * 37 + 112 * 111
    with pytest.raises(ValueError):
        K.exact_top_k(df, "id", "e", 0)


def test_approximate_knn_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    c = rng.normal(size=(20, 16))
    x = c[rng.integers(0, 20, 1200)] + 0.4 * rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, e array<double>")
    exact = {(r["unit"], r["neighbor"]) for r in K.exact_top_k(df, "id", "e", 5).collect()}
    near = {(r["unit"], r["neighbor"]) for r in K.approximate_top_k(df, "id", "e", 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_inline_selection(spark):
    d = spark.createDataFrame([("n", 0, 10, "a", 0.9), ("n", 5, 12, "b", 0.8), ("n", 12, 20, "a", 0.85), ("n", 30, 40, "c", 0.6), ("m", 0, 3, "a", 0.7)], "source string, start int, end int, target string, score double")
    got = {(r["source"], r["start"]): r["reason"] for r in I.selected(d, spark.createDataFrame([("n", 2)], "source string, budget int")).collect()}
    assert got == {("n", 0): None, ("n", 5): "overlaps_selected_span", ("n", 30): None, ("n", 12): "over_budget", ("m", 0): None}
    b = spark.createDataFrame([(0,), (599,), (10**6,)], "w long").select(I.budget(F.col("w"))).collect()
    assert [r[0] for r in b] == [1, 3, 10]


def test_geometric_mean(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (0.0, 1.0, 1.0)], "naturalness double, target_score double, placement double")
    assert [round(r[0], 9) for r in df.select(I.geometric({c: F.col(c) for c in I.COMBINE})).collect()] == [0.5, 0.0]
    with pytest.raises(Exception, match="score outside"):
        spark.createDataFrame([(1.5, 1.0, 1.0)], df.schema).select(I.geometric({c: F.col(c) for c in I.COMBINE})).collect()


def test_span_joins(spark):
    spans = spark.createDataFrame([(1, "d", 5, 8), (2, "d", 8, 12), (3, "e", 0, 1)], "span_id long, doc string, start int, end int")
    regions = spark.createDataFrame([("d", 0, 20, "big"), ("d", 4, 9, "small"), ("d", 4, 9, "alike")], "doc string, start int, end int, kind string")
    assert {r["span_id"]: r["kind"] for r in S.smallest_container(spans, regions).collect()} == {1: "alike", 2: "big", 3: None}
    masks = spark.createDataFrame([("d", 0, 8)], "doc string, start int, end int")
    assert {r["span_id"] for r in S.not_overlapping(spans, masks).collect()} == {2, 3}
    r = S.span_recall(spans.selectExpr("span_id as item", "doc", "start", "end").limit(0), spans).first()
    assert (r["exact_recall"], r["n_items"]) == (0.0, 0)


def test_a_customer_with_hundreds_of_parts_is_ranked_whole(spark, tmp_path):
    # parts 1 to 300 are bought by customer 1 in order, the last one, of place 300, is the customer's first unowned
    lines = [(1, p, p, f"2024-{1 + p // 300:02d}-01") for p in range(1, 301)] + [(2, p, p, "2024-01-01") for p in range(1, 300)]
    spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = EV.x19_seen_masked_recall(spark, str(tmp_path)).first()
    assert (r["recall_at_10"], r["mrr"], r["queries"]) == (1.0, 1.0, 2)
