import random

import pytest

from weaveline.llm import consensus as C

FIELDS = ["tier", "ok"]


def _labels(spark, rows):
    return spark.createDataFrame(rows, "label_id long, item_id string, annotator string, tier string, ok boolean, labeled_at timestamp, extra string")


def test_latest_sheet_names_and_nulls(spark):
    from datetime import datetime as D

    rows = [
        (1, "i", " Ann ", "A", True, D(2025, 1, 1), None),
        (2, "i", "ann", " b", None, D(2025, 1, 2), None),  # replaces sheet 1 as a whole
        (3, "i", None, "c", True, D(2025, 1, 3), None),
        (4, "i", "  ", "c", True, D(2025, 1, 3), None),
        (5, "i", "bob", "x", False, None, None),  # a tier that isn't allowed
        (6, None, "bob", "a", True, None, None),
    ]
    got = {(r["item"], r["field"], r["annotator"], r["answer"]) for r in C.latest_votes(_labels(spark, rows), "item_id", "annotator", FIELDS, "labeled_at", "label_id", {"tier": ["a", "b"]}).collect()}
    assert got == {("i", "tier", "ann", "b"), ("i", "ok", "bob", "false")}


def test_bad_annotators_are_outweighed(spark):
    rng = random.Random(0)
    truth = {f"i{i}": rng.choice("abcd") for i in range(150)}
    skill = {"good1": 0.95, "good2": 0.95, "noise1": 0.3, "noise2": 0.3, "noise3": 0.3, "noise4": 0.3}
    votes = [(i, "tier", a, t if rng.random() < p else rng.choice("abcd")) for i, t in truth.items() for a, p in skill.items()]
    df = spark.createDataFrame(votes, "item string, field string, annotator string, answer string")
    weights = C.reliability(df)
    got = {r["item"]: r["answer"] for r in C.consensus(df, weights).collect()}
    by = {r["annotator"]: r for r in weights.collect()}
    assert by["good1"]["accuracy"] > 0.85 and by["noise1"]["accuracy"] < 0.6
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    majority = sum(max("abcd", key=lambda c: sum(v[3] == c for v in votes if v[0] == i)) == t for i, t in truth.items()) / len(truth)
    assert right > 0.9 and right >= majority


def test_inverted_annotator_speaks_for_the_other_answer(spark):
    rng = random.Random(1)
    votes = []
    for i in range(80):
        t = rng.random() < 0.5
        votes += [(f"i{i}", "ok", a, str(t if rng.random() < 0.9 else not t).lower()) for a in ("x", "y", "z")]
        votes.append((f"i{i}", "ok", "liar", str(not t).lower()))
    w = {r["annotator"]: r["weight"] for r in C.reliability(spark.createDataFrame(votes, "item string, field string, annotator string, answer string")).collect()}
    assert w["liar"] < 0 < w["x"]


def test_few_votes_ties_and_empty(spark):
    schema = "item string, field string, annotator string, answer string"
    df = spark.createDataFrame([("i", "tier", "a", "b"), ("i", "tier", "b", "a"), ("j", "tier", "a", "b"), ("j", "tier", "b", "a"), ("j", "tier", "c", None)], schema).filter("answer is not null")
    w = C.reliability(df)
    assert C.consensus(df, w).count() == 0
    assert {r["item"]: r["answer"] for r in C.consensus(df, w, least=2).collect()} == {"i": "a", "j": "a"}
    none = spark.createDataFrame([], schema)
    assert C.consensus(none, C.reliability(none)).count() == 0 and C.agreement(none).count() == 0


def test_agreement_by_hand(spark):
    # two raters, four units: three agree; coincidence counts 4 a, 4 b
    rows = [("1", "f", "x", "a"), ("1", "f", "y", "a"), ("2", "f", "x", "b"), ("2", "f", "y", "b"), ("3", "f", "x", "a"), ("3", "f", "y", "b"), ("4", "f", "x", "b"), ("4", "f", "y", "a"), ("5", "f", "x", "a")]
    r = C.agreement(spark.createDataFrame(rows, "item string, field string, annotator string, answer string")).first()
    assert (r["n_units"], r["n_ratings"]) == (4, 8)
    assert r["alpha"] == pytest.approx(1 - 0.5 / (32 / 56))


def test_all_ways_of_a_round_agree(spark):
    rng = random.Random(3)
    votes = [(f"i{i}", f, a, rng.choice("abc" if f == "x" else "yn")) for i in range(40) for f in ("x", "y") for a in "pqrst" if rng.random() < 0.7]
    votes += [("hot", "x", f"w{j}", rng.choice("abc")) for j in range(60)]
    df = spark.createDataFrame(votes, "item string, field string, annotator string, answer string")
    run = lambda **o: {(r["annotator"], r["field"]): (r["n_judged"], round(r["accuracy"], 8), round(r["weight"], 6), r["stable"]) for r in C.reliability(df, **o).collect()}
    rows, mixed, joined = run(), run(most_votes=30), run(most_named=0)
    assert rows == mixed == joined and all(v[3] for v in rows.values())
    assert not any(v[3] for v in run(rounds=2, tolerance=0.0).values())
