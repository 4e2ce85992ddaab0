from datetime import datetime as D

import pytest

from weaveline.operators import references as R

CHILD = "rel_id long, source_id string, target_id string, recorded_at timestamp, key string, side string"
PARENT = "id string, arrived_at timestamp, deleted_at timestamp, salt int"


def _run(spark, children, parents, **options):
    c = spark.createDataFrame([(*x, "k", "s") for x in children], CHILD)
    p = spark.createDataFrame([(*x, 1) for x in parents], PARENT)
    return R.orphan_references(c, p, child_id="rel_id", sides={"source": "source_id", "target": "target_id"}, recorded="recorded_at", parent_key="id", arrived="arrived_at", deleted="deleted_at", **options)


def test_cleaning(spark):
    raw = [" a/b.md ", "/a/b", "//a/b.md#x", "a/b #sec", "\ta/b.md\n", "#only", "  ", "", None, "a.md.md", "A/b"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", R.clean_reference(R.F.col("r")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["a/b"] * 5 + [None] * 4 + ["a.md", "A/b"]


def test_times_nulls_and_reasons(spark):
    parents = [("doc", D(2025, 1, 10), D(2025, 2, 1)), ("doc", D(2025, 3, 1), None), ("gone", D(2025, 1, 1), D(2025, 1, 5)), ("late", D(2025, 6, 1), None), (None, D(2025, 1, 1), None), ("never", None, None)]
    children = [
        (1, "doc", "doc", D(2025, 1, 9)),  # within a day before the arrival
        (2, "doc", "doc", D(2025, 1, 8, 23)),  # too early
        (3, "doc", "doc", D(2025, 2, 1)),  # at the moment of deletion
        (4, "doc", "doc", D(2025, 2, 28)),  # the next arrival is within a day
        (5, "gone", "late", D(2025, 2, 1)),
        (6, "never", None, D(2025, 2, 1)),
        (7, "doc", "other", None),
        (8, " ", "#x", D(2025, 2, 1)),
    ]
    got = {(r["child_id"], r["side"], r["reason"]) for r in _run(spark, children, parents).collect()}
    want = {(2, s, "late") for s in ("source", "target")} | {(3, s, "deleted") for s in ("source", "target")} | {(5, "source", "deleted"), (5, "target", "late"), (6, "source", "missing"), (7, "source", "untimed"), (7, "target", "missing")}
    assert got == want


@pytest.mark.parametrize("hot_share", [2, 256, 100_000])
def test_hot_keys_salted_or_not_give_the_same(spark, hot_share):
    import random

    rng = random.Random(0)
    parents = [("hot", D(2025, m, 1), D(2025, m, 15)) for m in range(1, 13)] * 5 + [(f"p{i}", D(2025, rng.randint(1, 12), 3), None) for i in range(20)]
    children = [(i, "hot" if i % 3 else f"p{rng.randint(0, 40)}", "hot", D(2025, rng.randint(1, 12), rng.randint(1, 28))) for i in range(400)]
    from datetime import timedelta

    def dangling(key, at):
        return not any(k == key and a <= at + timedelta(days=1) and (d is None or d > at) for k, a, d in parents)

    want = {(i, s) for i, a, b, at in children for s, k in (("source", a), ("target", b)) if dangling(k, at)}
    rows = _run(spark, children, parents, hot_share=hot_share).collect()
    assert {(r["child_id"], r["side"]) for r in rows} == want and len(rows) == len(want)


def test_reports_and_empty_tables(spark):
    children = [(i, "x", "y", D(2025, 1 + i % 2, 1)) for i in range(4)]
    found = _run(spark, children, [])
    assert {(r["side"], r["period"], r["n_refs"]) for r in R.orphans_by_period(found).collect()} == {(s, p, 2) for s in ("source", "target") for p in ("2025-01-01", "2025-02-01")}
    assert {(r["key"], r["n_refs"]) for r in R.orphan_keys(found).collect()} == {("x", 4), ("y", 4)}
    assert _run(spark, [], [("a", D(2025, 1, 1), None)]).count() == 0
