import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from weaveline.operators import graph as G
from weaveline.operators import learned as L
from weaveline.operators import linear
from weaveline.operators import simulate as Q
from weaveline.operators import spans as S
from weaveline.operators.splits import three_way
from weaveline.plans import learned as LP


def test_training_rows(spark):
    spans = spark.createDataFrame([("a", 0.9), ("b", None), ("c", 0.9), ("d", 0.9), ("e", 0.1), ("f", 0.9), ("g", None)], "span_id string, best_target double")
    tiers = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")], "span_id string, tier string")
    assert {r["span_id"]: (r["label"], r["weight"]) for r in L.training_rows(spans, tiers).collect()} == {"a": (1, 1), "d": (0, 1), "e": (0, 1), "f": (0, 0.05), "g": (0, 0.05)}


def test_hard_negatives_leave_positives_out(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query string, v array<double>")
    t = spark.createDataFrame([("p", [1.0, 0.0]), ("x", [0.9, 0.1]), ("y", [0.5, 0.5]), ("z", [0.99, 0.0])], "target string, v array<double>")
    p = spark.createDataFrame([("q", "p")], "query string, target string")
    rows = lambda ex: [r["target"] for r in L.hard_negatives(q, t, p, 2, ex).orderBy("rank").collect()]
    assert rows(None) == ["z", "x"] and rows(spark.createDataFrame([("z",)], "target string")) == ["x", "y"]


def test_head_learns_and_softmax_adds_up(spark):
    rng = random.Random(0)
    rows = [(x := rng.random(), float(x > 0.5), 1.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "f double, label double, weight double")
    got = L.head_scores(L.fit_head(df, ["f"]), df, ["f"], "p").collect()
    assert sum((r["p"] > 0.5) == (r["label"] > 0.5) for r in got) > 370
    s = L.catalog_softmax(spark.createDataFrame([("q", "a", 900.0), ("q", "b", 900.0), ("r", "a", -5.0)], "q string, t string, s double"), "q", "s").collect()
    assert {(r["q"], r["t"]): r["share"] for r in s} == {("q", "a"): 0.5, ("q", "b"): 0.5, ("r", "a"): 1.0}
    assert L.groups_in_batches({"a": 3, "b": 3, "c": 9, "d": 1}, 6) == [["a", "b"], ["c"], ["d"]]


def test_propagation_helps_where_neighbours_agree(spark):
    rng = random.Random(1)
    label = {i: float(i % 2) for i in range(120)}
    edges = [(a, b) for a in range(120) for b in rng.sample([x for x in range(120) if label[x] == label[a] and x != a], 4)]
    adj = G.undirected(spark.createDataFrame(edges, "source long, target long"))
    x = spark.createDataFrame([(i, [label[i] + rng.gauss(0, 1.5), 1.0]) for i in label], "node long, f array<double>").select("node", array_to_vector("f").alias("features"))
    y = spark.createDataFrame(list(label.items()), "node long, label double")
    acc = [L.graph_classifier(G.normalized_adjacency(adj), x, y, h).filter("not train").agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] for h in (0, 2)]
    assert acc[1] > max(acc[0], 0.85)


def test_recommendations_are_new(spark):
    rng = random.Random(2)
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(30) for i in {rng.randint(0, 9) + 10 * (u % 2) for _ in range(5)}], "user int, item int, n float")
    got = L.recommend(ratings, "user", "item", "n", 3)
    assert got.join(ratings, ["user", "item"]).count() == 0 and got.groupBy("user").count().filter("count > 3").count() == 0


def test_users_with_most_items_get_recommendations(spark):
    rng = random.Random(3)
    has = {u: set(rng.sample(range(620), 12)) for u in range(1, 40)} | {0: set(range(600))}
    ratings = spark.createDataFrame([(u, i, rng.uniform(1, 9)) for u, items in has.items() for i in items], "user int, item int, n float")
    whole = {u: [] for u in has}
    for r in L.recommend(ratings, "user", "item", "n", 5).orderBy("user", "rank").collect():
        whole[r["user"]].append(r["item"])
    assert all(len(items) == 5 and not has[u] & set(items) for u, items in whole.items())
    apart = {u: [] for u in has}
    for r in L.recommend(ratings, "user", "item", "n", 5, most_asked=0).orderBy("user", "rank").collect():
        apart[r["user"]].append(r["item"])
    assert apart == whole


def _corpus(spark, path, documents, relationships, items):
    flags = "lang string, metadata string, source_ref string, arrived_at timestamp, deleted_at timestamp, is_excluded boolean, is_generated boolean, is_archived boolean"
    rows = [(i, d, *x, *[None] * 8) for i, (d, x) in enumerate(documents.items())]
    spark.createDataFrame(rows, f"doc_key long, id string, title string, content string, {flags}").write.parquet(f"{path}/source_documents.parquet")
    spark.createDataFrame(relationships, "rel_id long, source_id string, target_id string, kind string, span_start long, span_end long, anchor_text string").write.parquet(f"{path}/relationships.parquet")
    spark.createDataFrame(items, "id string, source_document_id string, anchor_text string, span_start long, span_end long, region_kind string").write.parquet(f"{path}/audit_items.parquet")


def test_recall_gate_asks_for_proposed_spans_without_explicit_links(spark, tmp_path):
    body = "The [[walk|random walk]] meets plain words, and a gradient follows.\n"
    span = lambda text: (body.index(text), body.index(text) + len(text))
    documents = {"a": ("A page", body), "walk": ("Random walk", "Steps.\n"), "g": ("Gradient", "Slopes.\n")}
    relationships = [(1, "a", "walk", "explicit-link", *span("[[walk|random walk]]"), "random walk"), (2, "a", "g", "citation", *span("gradient"), "gradient")]
    items = [("linked", "a", "random walk", *span("[[walk|random walk]]"), "prose"), ("unknown", "a", "plain words", *span("plain words"), "prose"), ("cited", "a", "gradient", *span("gradient"), "prose"), ("listed", "a", "random walk", *span("[[walk|random walk]]"), "list")]
    _corpus(spark, tmp_path, documents, relationships, items)
    r = LP.y12_recall_gate(spark, str(tmp_path)).first()
    assert (r["exact_recall"], r["overlap_recall"], r["n_items"]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 3)


def test_links_under_related_headings_are_related(spark, tmp_path):
    body = "# Top\n\nSee [[x]] here.\n\n## Related pages:\n\n- [[y]] first\n\nAlso [[z]].\n\n##\n\nAfter [[w]].\n\n## RELATED\n\n- [[v]]\n"
    span = lambda text: (body.index(text), body.index(text) + len(text))
    links = [(i, "a", t, "explicit-link", *span(f"[[{t}]]"), t) for i, t in enumerate("xyzwv")]
    _corpus(spark, tmp_path, {"a": ("A", body)}, links, [("i", "a", "x", 0, 1, "prose")])
    assert {r["kind"]: r["n"] for r in LP.y7_link_regions(spark, str(tmp_path)).collect()} == {"prose": 2, "related": 3}


def test_anchors_are_narrowed_to_what_is_shown(spark):
    docs = spark.createDataFrame([("d", "x [[caches|cache]] [loss](loss.md) y")], "doc string, body string")
    items = spark.createDataFrame([("wiki", "d", 2, 18, "cache"), ("markdown", "d", 19, 34, "loss"), ("other", "d", 2, 18, "Cache!"), ("gone", "e", 2, 18, "cache"), ("none", "d", 2, 18, None)], "item string, doc string, start long, end long, anchor string")
    got = {r["item"]: (r["start"], r["end"]) for r in S.narrowed(items, docs).collect()}
    assert got == {"wiki": (11, 16), "markdown": (20, 24), "other": (2, 18), "gone": (2, 18), "none": (2, 18)}


def _step_by_step(jobs, name, quantum=1):
    left = {j: s for _, j, s in jobs}
    at = {j: a for a, j, _ in jobs}
    now, done, line = 0, {}, []
    arrived = set()
    while left:
        for a, j, _ in sorted(jobs):
            if a <= now and j not in arrived:
                arrived.add(j)
                line.append(j)
        if not line:
            now = min(at[j] for j in left if j not in arrived)
            continue
        j = min(line, key=lambda x: (left[x], at[x], x)) if name != "rr" else line[0]
        for _ in range(left[j] if name == "sjf" else min(quantum, left[j]) if name == "rr" else 1):
            left[j] -= 1
            now += 1
        for a, k, _ in sorted(jobs):
            if a <= now and k not in arrived:
                arrived.add(k)
                line.append(k)
        line.remove(j)
        if left[j]:
            line.append(j)
        else:
            del left[j]
            done[j] = now
    return done


@pytest.mark.parametrize("name", ["sjf", "srpt", "rr"])
def test_policies_equal_simulation_by_unit_steps(spark, name):
    rng = random.Random(3)
    jobs = [(rng.randint(0, 40), j, rng.randint(1, 9)) for j in range(25)]
    df = spark.createDataFrame([("q", *x) for x in jobs], "queue string, arrival long, job long, size long")
    assert {r["job"]: r["completion"] for r in Q.policy(df, name, 2).collect()} == _step_by_step(jobs, name, 2)


def test_fifo_and_quantiles(spark):
    df = spark.createDataFrame([("q", 0, 1, 5), ("q", 2, 2, 3), ("q", 20, 3, 1)], "queue string, arrival long, job long, size long")
    assert {r["job"]: r["completion"] for r in Q.fifo(df).collect()} == {1: 5, 2: 8, 3: 21}
    q = Q.nearest_rank(spark.createDataFrame([("g", i) for i in range(1, 101)], "g string, x int"), "g", "x").first()
    assert (q["p50"], q["p95"], q["p99"]) == (50, 95, 99)
    assert Q.deficit_round_robin([[64] * 40, [1500] * 10], 500, 3) == [64 * 23, 1500]


def test_splits_share_no_identifier(spark):
    rng = random.Random(4)
    rows = [(i, f"d{rng.randint(0, 150)}", f"a{rng.randint(0, 150)}" if i % 9 else None, f"t{rng.randint(0, 150)}") for i in range(120)]
    got = three_way(spark.createDataFrame(rows, "id long, doc string, anchor string, target string"), "id", ["doc", "anchor", "target"], 0.2, 0.2).collect()
    assert len(got) == 120
    for c in ("doc", "anchor", "target"):
        side = {}
        for r in got:
            if r[c] is not None:
                assert side.setdefault(r[c], r["split"]) == r["split"]
    with pytest.raises(ValueError):
        three_way(spark.createDataFrame(rows, "id long, doc string, anchor string, target string"), "id", ["doc"], 0.6, 0.5)


def test_principal_components(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(5)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]
    assert [r["variance"] for r in linear.explained_variance(df, "v", 3).orderBy("component").collect()] == pytest.approx(want, rel=1e-6)
    p = np.array([r["components"] for r in linear.project(df, "id", "v", 3).orderBy("id").collect()])
    assert p.shape == (300, 3) and p.var(0) == pytest.approx(want, rel=1e-6)
